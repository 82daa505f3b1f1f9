"""DuckDB SQL for the operators it can express."""

from __future__ import annotations

from ledgerloom.llm import feistel_shards, host_rules, license_dice, odd_sketch_dedup, phrase_automata

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sharding() -> str:
    """Numbers by (doc_id, checksum, size), the Feistel rounds, and cycle walking by recursion."""
    def rounds(source: str) -> str:
        """One pass of all rounds over column x of ``source``."""
        sql = f"(SELECT k, x // b AS l, x % b AS r, a, b, n FROM {source})"
        for i, (m, c, e) in enumerate(feistel_shards.round_keys()):
            to, by, side = ("r", "l", "b") if i % 2 else ("l", "r", "a")
            v = f"({by} * {m} + {c}) % {feistel_shards.PRIME}"
            moved = f"({to} + (({v}) * ({v}) + {by}) % {feistel_shards.PRIME} * {e} % {feistel_shards.PRIME}) % {side}"
            sql = f"(SELECT k, {'l' if to == 'r' else moved} AS l, {moved if to == 'r' else 'r'} AS r, a, b, n FROM {sql})"
        return f"SELECT k, l * b + r AS x, a, b, n FROM {sql}"

    crc = """list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(
            range(0, octet_length(encode(t))::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1]))"""
    return f"""
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS tab),
    texts AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
    sized AS MATERIALIZED (
        SELECT doc_id, octet_length(encode(t))::BIGINT + 1 AS size, xor({crc}, 4294967295::BIGINT) AS text_crc32
        FROM texts, crc_table),
    numbered AS MATERIALIZED (
        SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS k, count(*) OVER () AS n
        FROM sized),
    sides AS (SELECT k, k AS x, ceil(sqrt(n))::BIGINT AS a, n FROM numbered),
    start AS (SELECT k, x, a, (n + a - 1) // a AS b, n FROM sides),
    walk AS (
        {rounds("start")}
        UNION ALL
        {rounds("(SELECT * FROM walk WHERE x >= n)")})
    SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {feistel_shards.SHARDS})::INT AS shard,
           (x // {feistel_shards.SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
    FROM numbered JOIN walk USING (k) WHERE x < walk.n"""


def _quality() -> str:
    r = host_rules
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
    worded AS (
        SELECT *, regexp_extract_all(text, '{_WORD}') AS w,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts),
    places AS (
        SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
    repeated AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, tri) AS c FROM places) WHERE c > 1),
    covered AS (SELECT k, count(DISTINCT i + j) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
    measured AS (
        SELECT k, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            (length(text) - length(translate(text, '{r.SYMBOLS}', '')))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
            coalesce(covered.n, 0)::BIGINT AS n_repeat_words
        FROM worded LEFT JOIN covered USING (k)),
    judged AS (
        SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PERCENT} * n_words AS base_failed
        FROM measured),
    failures AS (
        SELECT source, unnest(['base', 'symbols', 'dup_lines', 'lengths']) AS rule, unnest([
            base_failed, 100 * n_symbols > {r.MAX_SYMBOL_PERCENT} * n_words,
            100 * n_dup_lines > {r.MAX_DUP_LINE_PERCENT} * n_lines,
            word_chars < {r.WORD_LENGTHS[0]} * n_words OR word_chars > {r.WORD_LENGTHS[1]} * n_words]) AS failed
        FROM judged WHERE source IS NOT NULL),
    hosts AS (
        SELECT rule, source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f, f / n AS rate, f <= {r.MAX_HOST_RATE} * n AS usual
        FROM failures GROUP BY rule, source),
    priors AS (
        SELECT rule, source, mean, CASE WHEN spread > 0 THEN greatest(1.0, least({r.MOST_PRIOR_WEIGHT}, mean * (1 - mean) / spread - 1))
            ELSE {r.MOST_PRIOR_WEIGHT} END AS weight, others
        FROM (
            -- the prior of all hosts of a rule, and for each host that of the other usual ones
            SELECT rule, NULL AS source, sum(f) / sum(n) AS mean, sum(n * rate * rate) / sum(n) - mean * mean AS spread, false AS others
            FROM hosts GROUP BY rule
            UNION ALL
            SELECT h.rule, h.source, sum(o.f) / sum(o.n) AS mean, sum(o.n * o.rate * o.rate) / sum(o.n) - mean * mean AS spread, true AS others
            FROM hosts h JOIN hosts o ON o.rule = h.rule AND o.source <> h.source AND o.usual GROUP BY h.rule, h.source)),
    verdicts AS (
        SELECT h.source, bool_or((h.f + p.mean * p.weight) / (h.n + p.weight) > CASE WHEN o.mean IS NULL THEN {r.MAX_HOST_RATE} ELSE
            least({r.MAX_HOST_RATE}, greatest({r.MIN_HOST_LIMIT},
                o.mean + {r.SPREADS} * sqrt(greatest(o.mean * (1 - o.mean), 0) / (o.weight + 1)))) END) AS condemned
        FROM hosts h JOIN priors p ON p.rule = h.rule AND NOT p.others
        LEFT JOIN priors o ON o.rule = h.rule AND o.others AND o.source = h.source GROUP BY h.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT coalesce(condemned, false) AS kept
    FROM judged LEFT JOIN verdicts USING (source)"""


def _licenses() -> str:
    t = license_dice.THRESHOLD

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rows = ",\n".join(
        f"({i}, {text(name)}, {text(terms)}, [{', '.join(map(text, license_dice.bigrams(wording)))}])"
        for i, (name, terms, wording) in enumerate(license_dice.TEMPLATES)
    )
    normal = r"trim(regexp_replace(lower(s), '[^\pL\pN]+', ' ', 'g'))"
    return f"""
    WITH templates(i, license, terms, g) AS (VALUES {rows}),
    texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (
        SELECT k, doc_id, string_split(text, chr(10)) || list_filter(
            regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: contains(trim(p, ' '), chr(10))) AS ss FROM texts),
    normal AS (SELECT k, doc_id, list_filter(list_transform(ss, lambda s: {normal}), lambda s: s <> '') AS ss FROM cut),
    segments AS (
        SELECT k, unnest(range(len(ss))) AS segment, string_split(unnest(ss), ' ') AS w FROM normal),
    grams AS (
        SELECT k, segment, CASE WHEN len(w) = 1 THEN w ELSE
            list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM segments
        WHERE len(w) < 200),
    matched AS (
        SELECT k, segment, i, license, terms, 2.0::DOUBLE * len(list_intersect(grams.g, t.g)) / (len(grams.g) + len(t.g)) AS dice
        FROM grams JOIN templates t ON 2.0 * least(len(grams.g), len(t.g)) / (len(grams.g) + len(t.g)) >= {t}),
    best AS (
        SELECT * FROM matched WHERE dice >= {t}
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, i, segment) = 1),
    counted AS (SELECT k, count(DISTINCT segment) AS n FROM matched WHERE dice >= {t} GROUP BY k)
    SELECT doc_id, len(ss)::BIGINT AS n_segments, coalesce(n, 0)::BIGINT AS n_matches, license, terms, dice, segment::INT AS segment
    FROM normal LEFT JOIN best USING (k) LEFT JOIN counted USING (k)"""


def _near_duplicates() -> str:
    k = odd_sketch_dedup.SHINGLE
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""
    WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
    shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, {gram} AS s FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM worded WHERE len(w) >= {k})
        UNION SELECT doc_id, array_to_string(w, ' ') AS s FROM worded WHERE len(w) BETWEEN 1 AND {k - 1}),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
        GROUP BY 1, 2),
    links AS MATERIALIZED (
        SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
        WHERE 100 * shared >= {odd_sketch_dedup.SIMILARITY} * (x.n + y.n - shared)),
    edges AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
    reach(u, v) AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
    roots AS (SELECT u AS doc_id, least(u, min(v)) AS root FROM reach GROUP BY u)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id,
        doc_id = coalesce(root, doc_id) AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)"""


def _phrases() -> str:
    m = phrase_automata
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS words, array_to_string(w[i:i + {n - 1}], ' ') AS phrase "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM worded)"
        for n in range(1, m.WORDS + 1)
    )
    first, rest = "array_to_string(w[1:k], ' ')", "array_to_string(w[k + 1:], ' ')"
    return f"""
    WITH pieces AS (
        SELECT coalesce(lang, '{m.UNDETERMINED}') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    counted AS MATERIALIZED (SELECT lang, words, phrase, count(*)::BIGINT AS a FROM ({grams}) GROUP BY ALL),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
    candidates AS (
        SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE words >= 2 AND a >= {m.LEAST}),
    cuts AS MATERIALIZED (
        SELECT *, {first} AS first_part, {rest} AS rest_part
        FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates)),
    scored AS (
        SELECT c.lang, c.words, c.phrase, c.a, k, x.a AS l, y.a AS r,
            ({m.SCALE}::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
        FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = first_part
        JOIN counted y ON y.lang = c.lang AND y.phrase = rest_part),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a
        FROM candidates WHERE words = 3),
    longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
    left_over AS (
        SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase)
        WHERE most IS NULL OR 100 * most < {m.SHARE} * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank,
        phrase, a, l, r, n, score
    FROM left_over JOIN totals USING (lang) QUALIFY rank <= {m.TOP}"""


ORACLE: dict[str, str] = {
    "op5_sharding": _sharding(),
    "op7_quality_rules": _quality(),
    "op8_license_scan": _licenses(),
    "op9_near_dedup": _near_duplicates(),
    "op12_phrase_collocations": _phrases(),
}
