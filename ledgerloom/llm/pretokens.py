"""Pre-tokens of a SentencePiece BPE model: stretches of text between which no merge can happen.

The model writes a blank as U+2581 and puts one before every text.  A pre-token is a run of blanks with the other
characters up to the next blank: no piece of the model has a blank after another character.  Long pre-tokens (scripts
without blanks, addresses, letter noise) are also cut between two characters that stand beside each other in no piece;
with ``long=0`` all are, which leaves fewer distinct ones.
Pieces of a pre-token alone are therefore the pieces it has inside its text.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.textnum import text_bytes

BLANK = "▁"
LONG = 40  # bytes above which a pre-token is cut between characters too
COMMON = 1024  # code points whose pairs are looked up in a table


def model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


class PieceModel:
    """The model with what cutting needs: its blank id, bytes of each piece, and neighbouring characters."""

    def __init__(self, path: str | None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        n = self.sp.vocab_size()
        plain = [not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(n)]
        pieces = [self.sp.id_to_piece(i).replace(BLANK, " ") for i in range(n)]
        if any(" " in p.lstrip(" ") for p, ok in zip(pieces, plain) if ok):
            raise ValueError("a piece of this model has a blank after another character")
        self.blank = self.sp.piece_to_id(BLANK)
        self.size = np.array([len(p.encode()) if ok else 1 for p, ok in zip(pieces, plain)], np.int64)
        beside = {(ord(a) << 21) | ord(b) for p, ok in zip(pieces, plain) if ok for a, b in zip(p, p[1:])}
        self.beside = np.array(sorted(beside), np.int64)
        self.common = np.zeros((COMMON, COMMON), bool)
        near = self.beside[(self.beside >> 21 < COMMON) & (self.beside & (1 << 21) - 1 < COMMON)]
        self.common[near >> 21, near & (1 << 21) - 1] = True

    def ids(self, tokens: list[str]) -> list[list[int]]:
        """Piece ids of pre-tokens as they are inside a text.

        The model puts a blank before what it encodes: a pre-token with a blank leaves its first one to it; before any
        other one a line feed keeps that blank apart, and both are taken away again.
        """
        led = [t[1:] if t[0] == " " else "\n" + t for t in tokens]
        coded = self.sp.encode(led, num_threads=1)
        return [
            (i if len(t) > 1 else [self.blank]) if t[0] == " " else i[2:] for t, i in zip(tokens, coded)
        ]


@lru_cache(maxsize=2)
def piece_model(path: str | None = None) -> PieceModel:
    return PieceModel(path)


def pretokens(texts: pa.Array, model: PieceModel, long: int = LONG) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of (large-string, not null) texts in order, and where each text's begin (with the end)."""
    large = pa.large_string()
    texts = pc.replace_substring(texts, BLANK, " ")
    lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", large), pa.scalar(" ", large))
    data, ends = text_bytes(pc.binary_join_element_wise(lead, texts, pa.scalar("", large)))
    if not len(data):
        return pa.array([], large), np.zeros(len(texts) + 1, np.int64)
    blank = data == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[ends[:-1][ends[:-1] < len(data)]] = True
    starts = np.append(np.flatnonzero(first), len(data))
    far = np.flatnonzero(np.diff(starts) > long)
    if len(far):
        more = _inner_cuts(data, starts[far], starts[far + 1], model)
        starts = np.union1d(starts, more)
    offsets = pa.py_buffer(starts.astype(np.int64))
    tokens = pa.Array.from_buffers(large, len(starts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])
    return tokens, np.searchsorted(starts, ends)


def _inner_cuts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, model: PieceModel) -> np.ndarray:
    """Byte places inside the stretches between two characters that no piece has beside each other."""
    size = end - begin
    base = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(begin - base, size)
    part = data[at]
    chars = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
    place = at[(part & 0xC0) != 0x80]  # of each character's first byte
    small = np.minimum(chars, COMMON - 1)
    found = model.common[small[:-1], small[1:]]
    rare = np.flatnonzero(np.maximum(chars[:-1], chars[1:]) >= COMMON - 1)
    pair = chars[rare].astype(np.int64) << 21 | chars[rare + 1]
    found[rare] = model.beside[np.minimum(np.searchsorted(model.beside, pair), len(model.beside) - 1)] == pair
    return place[1:][~found]


class PieceChunks:
    """Piece ids of pre-tokens; those met first are remembered, up to ``limit`` of them."""

    def __init__(self, model: PieceModel, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def encode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each (distinct) pre-token where its ids begin and how many they are."""
        at = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        new = tokens[at < 0]
        coded = self.model.ids(list(new)) if len(new) else []
        known = len(self.starts) - 1
        at[at < 0] = known + np.arange(len(new))
        ids = np.concatenate([self.ids, np.array([i for c in coded for i in c], np.uint32)])
        sizes = np.array([len(c) for c in coded], np.int64)
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        room = min(len(new), self.limit - known)
        if room > 0:
            self.index.update(zip(new[:room], range(known, known + room)))
            self.starts = starts[: known + room + 1]
            self.ids = ids[: self.starts[-1]]
        return ids, starts[at], np.diff(starts)[at]


@lru_cache(maxsize=2)
def _piece_chunks(path: str | None) -> PieceChunks:
    return PieceChunks(piece_model(path))


def encode_pieces(texts: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all (large-string, not null) texts, and where each text's begin (with the end)."""
    tokens, starts = pretokens(texts, piece_model(path))
    if not len(tokens):
        return np.zeros(0, np.uint32), starts
    coded = tokens.dictionary_encode()
    ids, begin, size = _piece_chunks(path).encode(coded.dictionary.to_numpy(zero_copy_only=False))
    codes = coded.indices.to_numpy()
    begin, size = begin[codes], size[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
    return out, ends[starts]
