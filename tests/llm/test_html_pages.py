"""Main text of ordinary pages: forms, unlisted languages, implied ends of heads, comments, code and cells; pass two by brute force."""

import random

import pytest

from ledgerloom.llm import html_main
from ledgerloom.llm.html_main import Block, main_text

EN = (
    "The river had been rising for most of the week, and by the time the mayor of the town had called for help it was "
    "in the streets. Some of the people who live there said that they had never seen it as high as that, but the older "
    "ones remember a year when it was worse. It is not known when the road to the north will be open to cars again."
)
PROSE = {
    "it": [
        "Il fiume era salito per quasi tutta la settimana e quando il sindaco ha chiesto aiuto l'acqua era già nelle strade. "
        "Alcuni abitanti hanno detto che non avevano mai visto il fiume così alto, ma i più anziani ricordano un anno in cui "
        "era andata peggio. Non si sa ancora quando la strada verso nord sarà di nuovo aperta alle macchine.",
        "La scuola resta chiusa fino alla fine del mese e i bambini vanno a lezione nella biblioteca, che si trova sulla "
        "collina e non ha avuto danni. Il comune ha promesso che i lavori cominceranno presto e che ogni famiglia avrà un "
        "posto dove dormire. Chi vuole dare una mano può scrivere al comune o passare in piazza la mattina.",
    ],
    "pl": [
        "Rzeka podnosiła się przez większą część tygodnia i zanim burmistrz poprosił o pomoc, woda była już na ulicach. "
        "Niektórzy mieszkańcy mówili, że nigdy nie widzieli jej tak wysoko, ale starsi pamiętają rok, w którym było gorzej. "
        "Nie wiadomo jeszcze, kiedy droga na północ będzie znowu otwarta dla samochodów.",
        "Szkoła pozostanie zamknięta do końca miesiąca, a dzieci mają lekcje w bibliotece, która stoi na wzgórzu i nie "
        "została uszkodzona. Gmina obiecała, że prace zaczną się wkrótce i że każda rodzina dostanie miejsce do spania. "
        "Kto chce pomóc, może napisać do gminy albo przyjść rano na rynek.",
    ],
    "zh": [
        "这条河在这一周的大部分时间里都在上涨，等到镇长请求帮助的时候，水已经流到了街道上。有些居民说，他们从来没有见过这么高的水位，"
        "但是年纪大的人还记得有一年情况更糟。现在还不知道，通往北方的道路什么时候才能重新开放。",
        "学校将一直关闭到月底，孩子们在山上的图书馆里上课，那里没有受到损坏。镇政府答应，工程很快就会开始，每个家庭都会有地方睡觉。"
        "想要帮忙的人可以给镇政府写信，也可以早上到广场上来。大家都希望，这样的事情以后不要再发生。",
    ],
    "ru": [
        "Река поднималась почти всю неделю, и когда мэр города попросил о помощи, вода уже была на улицах. Некоторые жители "
        "говорили, что никогда не видели её такой высокой, но старики помнят год, когда было ещё хуже. Пока не известно, "
        "когда дорога на север будет снова открыта для машин.",
        "Школа останется закрытой до конца месяца, а дети учатся в библиотеке, которая стоит на холме и не пострадала. "
        "Город обещал, что работы скоро начнутся и что каждая семья получит место для ночлега. Кто хочет помочь, может "
        "написать в мэрию или прийти утром на площадь.",
    ],
    "en": [EN, EN.replace("river", "lake")],
}
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
END = "<div><a href=/i>Imprint</a> <a href=/p>Privacy</a></div><p>\N{COPYRIGHT SIGN} 2024 Example Media Group</p>"


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("lang", PROSE)
def test_unmarked_pages_in_listed_and_unlisted_languages(lang):
    texts = PROSE[lang]
    for body in (texts, texts[:1], [texts[0], texts[1], *texts]):
        page = f"<html><head><title>T</title></head><body>{NAV}<div>{paragraphs(body)}</div>{END}</body></html>"
        assert main_text(page) == "\n".join(body)
    # A short paragraph and a heading between them come along.
    page = f"<body>{NAV}<h1>Titel 1</h1>{paragraphs(texts[:1])}<p>Ok 2.</p>{paragraphs(texts[1:])}{END}"
    assert main_text(page) == f"Titel 1\n{texts[0]}\nOk 2.\n{texts[1]}"
    # A notice in a listed language does not outweigh the page.
    page = f"<body>{NAV}<div>{paragraphs(texts)}</div><div class='cookie-notice'><p>{EN}</p></div>{END}"
    assert main_text(page) == "\n".join(texts)


@pytest.mark.parametrize("lang", PROSE)
def test_pages_inside_a_form(lang):
    texts, wanted = PROSE[lang], "\n".join(PROSE[lang])
    start = "<body><form id='aspnetForm' method='post' action='./'><input type='hidden' name='__VIEWSTATE' value='x'>"
    assert main_text(f"{start}{NAV}<div>{paragraphs(texts)}</div>{END}</form></body>") == wanted
    assert main_text(f"{start}{NAV}<article>{paragraphs(texts)}</article>{END}</form></body>") == wanted
    assert main_text(f"{start}{NAV}<div class='post-content'>{paragraphs(texts)}</div>{END}</form></body>") == wanted
    # A form in the article or beside it is still one.
    form = f"<form action=/j><p>{EN}</p><label>Name <input name=n></label><textarea>{EN}</textarea><button>Send</button></form>"
    assert main_text(f"<body>{NAV}<article>{paragraphs(texts * 2)}{form}</article>{END}") == f"{wanted}\n{wanted}"
    assert main_text(f"<body>{NAV}<div>{paragraphs(texts * 2)}</div><div role=form><p>{EN}</p></div>{END}") == f"{wanted}\n{wanted}"
    assert main_text("<body><form><label>User</label><input><label>Password</label><input><button>Log in</button></form>") == ""


def test_heads_without_an_end():
    body, wanted = paragraphs(PROSE["en"]), "\n".join(PROSE["en"])
    for head in (
        "<html><head><title>T</title>", "<head><meta charset=utf-8><title>T</title><script>var a='<p>x'</script>",
        "<head><title>T</title><noscript><link href=x></noscript>", "<head><title>How to use <p> tags</title>", "<head><title>T",
    ):
        assert main_text(f"{head}{body}") == wanted, head
        assert main_text(f"{head}<div>{body}</div>") == wanted, head
    assert main_text(f"<head><title>T</title><b>{EN}</b>") == EN
    assert main_text(f"<head><title>T</title>\n{EN}") == EN
    assert main_text("<head><title>A title alone</title><meta name=x>\n</head>") == ""


def test_comments_are_left_out_whatever_their_length():
    many = "".join(f"<li class='comment'><p>{t}</p></li>" for t in PROSE["en"] * 4)
    for around in ("<ol class='comments'>", "<ol class='comment-list'>", "<ol id='user-comments'>", "<ol class='replies'>"):
        assert main_text(f"<body>{NAV}<article><h1>Title</h1><p>{EN}</p>{around}{many}</ol></article>{END}") == f"Title\n{EN}"
        assert main_text(f"<body>{NAV}<div><h1>Title</h1><p>{EN}</p></div>{around}{many}</ol>{END}") == f"Title\n{EN}"
    one = f"<div class='post-content'><p>{EN}</p></div><article class='comment-body'>{paragraphs(PROSE['en'] * 3)}</article>"
    assert main_text(f"<body>{NAV}{one}{END}") == EN
    # A name like that around everything takes nothing.
    assert main_text(f"<body><div class='comments'>{NAV}<p>{EN}</p>{END}</div>") == EN


def test_code_and_cells_between_prose():
    code = "<pre>for (i = 0; i &lt; n; ++i) {\n  total[i] += rate[i] * amount[i];\n  print_line(total[i], rate[i], amount[i]);\n}</pre>"
    wanted = "for (i = 0; i < n; ++i) { total[i] += rate[i] * amount[i]; print_line(total[i], rate[i], amount[i]); }"
    cells = "<table><tr><th>Town</th><td>Northfield upper bridge, Southfield lower bridge, Westfield mill, Eastfield harbour, Midfield</td></tr></table>"
    told = "Town\nNorthfield upper bridge, Southfield lower bridge, Westfield mill, Eastfield harbour, Midfield"
    page = f"<body>{NAV}<div><p>{EN}</p>{code}<p>{EN}</p>{cells}<p>{EN}</p></div>{END}"
    assert main_text(page) == f"{EN}\n{wanted}\n{EN}\n{told}\n{EN}"
    # At the end of a page, beside nothing that is good, they stay out.
    assert main_text(f"<body><p>{EN}</p><ul><li><a href=/long>{'A menu of links ' * 6}</a></li></ul>{code}") == EN


def brute(labels):
    """Labels after pass two of unmarked blocks without headings, by looking outwards from each open block."""
    out = []
    for i, kind in enumerate(labels):
        if kind in ("good", "bad"):
            out.append(kind)
            continue
        left = next((k for k in reversed(labels[:i]) if k in ("good", "bad")), "bad")
        right = next((k for k in labels[i + 1 :] if k in ("good", "bad")), "bad")
        out.append(left if left == right else "good" if kind == "near" else "bad")
    if "good" not in out:
        out = ["good" if kind == "near" else k for kind, k in zip(labels, out)]
    return out


def test_pass_two_against_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        labels = rng.choices(("good", "bad", "near", "short"), weights=[rng.random() + 0.01 for _ in range(4)], k=rng.randrange(12))
        found = [Block(False, 0, text="x", label=k) for k in labels]
        html_main.settle(found)
        assert [b.label for b in found] == brute(labels), labels


def test_pass_one_against_its_rules():
    """Labels of random blocks by the plain rules, counted here from the words that built them."""
    rng = random.Random(7)
    stops, others = ["the", "and", "of", "was", "with"], ["river", "bridge", "harbour", "quarry", "zyx"]
    for _ in range(3000):
        share = rng.random()
        words = [rng.choice(stops if rng.random() < share else others) for _ in range(rng.randrange(1, 70))]
        end = rng.choice(("", "."))
        text = " ".join(words) + end
        linked = rng.choice((0, 0, 0, len(text) // 2))
        density = sum(w in stops for w in words) / len(words)
        if len(text) < 70:
            wanted = "short"
        elif linked / len(text) > 0.33:
            wanted = "bad"
        elif density >= 0.25:
            wanted = "near" if density < 0.32 or len(text) <= 200 else "good"
        else:
            wanted = "near" if end and len(text) > 200 else "short"
        assert html_main.judge(Block(False, 0, text=text, linked=linked)) == wanted, text
