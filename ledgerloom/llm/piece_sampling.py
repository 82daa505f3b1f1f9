"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice.

A text is cut at blanks into chunks; a blank belongs to the chunk after it, as the piece mark, and a mark is put
before the text.  The lattice of a chunk has a node between any two characters and an edge for every piece, and an
edge of byte pieces for a character without a piece of its own.  Forward filtering sums the weights of all paths to each
node; backward sampling draws one edge at a time from the end, in proportion to the weight of all paths through it.
The draws are a hash of the row's key, the chunk's number and the step, so a segmentation depends on the row alone.

A block of texts is worked on at once: every distinct chunk's lattice is built and filtered once, and one step of all
open draws is one binary search.  Decoding joins the pieces and is exact for every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textnum import blocks, ready_for_python, mix, need_columns, text_bytes

ALPHA = 1.0  # power of the piece weights: 0 draws all segmentations alike, large values come close to the best one
SEED = 20240
BLOCK = 6 << 20
MARK = 0x2581
# A literal mark in a text must not turn into a blank: it stands for itself here and is written as bytes.
LITERAL_MARK = 0x110000 + MARK

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


class Pieces:
    """The pieces of a SentencePiece model: a table of all their beginnings, weights, bytes."""

    def __init__(self, path: str | None, alpha: float):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        rank = np.full(n, np.inf)
        begin: dict[str, int] = {}  # beginning of a piece -> id of the piece it is, or -1
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(chr(MARK), " ").encode()
                rank[i] = -model.get_score(i)
                for k in range(1, len(piece)):
                    begin.setdefault(piece[:k], -1)
                begin[piece] = i
        self.longest = max(map(len, begin), default=1)
        # The scores of a merge model are ranks; a rank's weight falls off as word frequencies do.
        weight = -np.log(rank + 10.0)
        total = np.log(np.exp(weight).sum())
        self.weight = alpha * (weight - total)
        self.byte_weight = alpha * (float(weight[np.isfinite(weight)].min(initial=0.0)) - total - 5.0)
        hashes = np.zeros(len(begin), _U64)
        for j, piece in enumerate(begin):
            for c in piece:
                hashes[j : j + 1] = hashes[j : j + 1] * _BASE + _U64(ord(c) + 1)
        self._place(mix(hashes), np.fromiter(begin.values(), np.int64, len(begin)))

    def _place(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        """Two tables by different bits of the hash: an entry whose place is taken in the first is in the second."""
        self.hash = np.append(hashes, _U64(0))  # the last entry matches nothing
        self.id = np.append(ids, -1).astype(np.int32)
        none = len(hashes)
        self.bits = _TABLE_BITS
        while True:
            place = [(hashes >> _U64(k)).astype(np.int64) & ((1 << self.bits) - 1) for k in (0, 64 - self.bits)]
            self.tables = [np.full(1 << self.bits, none, np.int32) for _ in place]
            self.tables[0][place[0][::-1]] = np.arange(none, dtype=np.int32)[::-1]
            second = np.flatnonzero(self.tables[0][place[0]] != np.arange(none))
            self.tables[1][place[1][second]] = second
            if (self.tables[1][place[1][second]] == second).all():
                return
            self.bits += 1

    def find(self, value: np.ndarray) -> np.ndarray:
        """Entry of each rolling hash; the entry after the last where it is no beginning of a piece."""
        h = mix(value)
        mask = _U64((1 << self.bits) - 1)
        entry = self.tables[0][(h & mask).astype(np.int64)]
        miss = np.flatnonzero(self.hash[entry] != h)
        other = self.tables[1][(h[miss] >> _U64(64 - self.bits)).astype(np.int64)]
        entry[miss] = np.where(self.hash[other] == h[miss], other, len(self.hash) - 1)
        return entry


@lru_cache(maxsize=2)
def pieces_of(path: str | None, alpha: float) -> Pieces:
    return Pieces(path, alpha)


class Lattices:
    """Lattices of distinct chunks, filtered forward: for every node the edges into it and their running shares.

    Chunks are ranked by falling length, and characters and nodes are numbered by depth, then rank.  So all chunks
    advance together, and the edges into the nodes of one depth are neighbours.
    """

    def __init__(self, chunks: pa.Array, pieces: Pieces):
        codes = np.frombuffer(text_bytes(chunks)[0].tobytes().decode().encode("utf-32-le"), np.int32).copy()
        codes[codes == MARK] = LITERAL_MARK
        size = pc.utf8_length(chunks).to_numpy().astype(np.int32) + np.int32(1)  # with the mark in front
        self.rank = np.empty(len(chunks), np.int32)
        by_size = np.argsort(-size, kind="stable")
        self.rank[by_size] = np.arange(len(chunks), dtype=np.int32)
        # Number of chunks with more than d characters, for d = 0, 1, ...
        longer = np.searchsorted(-size[by_size], -np.arange(size.max()), side="left")
        at = np.concatenate([[0], np.cumsum(longer)]).astype(np.int32)  # first character of each depth
        node = np.concatenate([[0, len(chunks)], len(chunks) + np.cumsum(longer)]).astype(np.int32)  # first node
        first = np.cumsum(size) - size
        place = np.arange(len(codes) + len(chunks), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        text = np.empty(len(place), np.int32)
        marks = place == 0
        whole = np.empty(len(place), np.int32)
        whole[marks], whole[~marks] = MARK, codes
        text[at[place] + np.repeat(self.rank, size)] = whole
        step = (text + 1).astype(_U64)
        depth = np.repeat(np.arange(len(longer), dtype=np.int32), longer)
        order = np.arange(len(text), dtype=np.int32) - at[depth]
        sources, targets, weights, tokens = [], [], [], []
        longer_than = np.append(longer, np.zeros(pieces.longest + 1, longer.dtype)).astype(np.int32)
        d, r, rolling = depth, order, np.zeros(len(text), _U64)
        for n in range(1, pieces.longest + 1):
            if n > 1:
                # The character n - 1 further on, where the chunk has one.
                inside = np.flatnonzero(r < longer_than[d + (n - 1)])
                d, r, rolling = d[inside], r[inside], rolling[inside]
            if not len(d):
                break
            rolling = rolling * _BASE + step[at[d + (n - 1)] + r]
            entry = pieces.find(rolling)
            piece = pieces.id[entry]
            hit = np.flatnonzero(piece >= 0)
            if n == 1:
                bare = np.flatnonzero(piece < 0)
            hit_d, hit_r = d[hit], r[hit]
            sources.append(node[hit_d] + hit_r)
            targets.append(node[hit_d + n] + hit_r)
            tokens.append(piece[hit])
            known = np.flatnonzero(entry < len(pieces.hash) - 1)
            d, r, rolling = d[known], r[known], rolling[known]
        size_bare = _utf8_size(text[bare])
        sources.append(node[depth[bare]] + order[bare])
        targets.append(node[depth[bare] + 1] + order[bare])
        # A single byte is a piece; longer spellings are rows of ``spelled``, as negative numbers.
        self.spelled = pieces.byte_id[_utf8_bytes(text[bare])]
        tokens.append(np.where(size_bare == 1, self.spelled[:, 0], -1 - np.arange(len(bare), dtype=np.int32)))
        token, source, target = np.concatenate(tokens), np.concatenate(sources), np.concatenate(targets)
        weight = np.where(token >= 0, pieces.weight[np.maximum(token, 0)], 0.0)
        weight[len(weight) - len(bare) :] = pieces.byte_weight * size_bare
        n_ids = np.ones(len(token), np.int8)
        n_ids[len(token) - len(bare) :] = size_bare
        # Longer pieces first at each node: they are the likelier ones.
        sort = len(target) - 1 - np.argsort(target[::-1], kind="stable")
        self.token, self.source, self.n_ids = token[sort].astype(np.int32), source[sort], n_ids[sort]
        target, weight = target[sort], weight[sort]
        total = np.zeros(node[-1])
        self.running = np.empty(len(target))
        bounds = np.searchsorted(target, node[1:])
        for a, b in zip(bounds[:-1], bounds[1:]):
            value = total[self.source[a:b]] + weight[a:b]
            new = np.empty(b - a, bool)
            new[:1] = True
            np.not_equal(target[a + 1 : b], target[a : b - 1], out=new[1:])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, b - a))
            top = np.maximum.reduceat(value, head)
            part = np.exp(value - np.repeat(top, count))
            mass = np.add.reduceat(part, head)
            total[target[a:b][head]] = top + np.log(mass)
            share = part / np.repeat(mass, count)
            upto = np.cumsum(share)
            self.running[a:b] = upto - np.repeat(upto[head] - share[head], count)
        self.edges_from = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=node[-1]))])
        self.running[self.edges_from[1:][np.diff(self.edges_from) > 0] - 1] = 2.0  # rounding must not lose a draw
        self.last_node = node[size] + self.rank

    def sample(self, chunk: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn for each occurrence of a chunk, in text order, and where each occurrence's begin."""
        node, n_first = self.last_node[chunk], len(self.rank)
        open_ = np.arange(len(chunk))
        steps, edges = [], []
        while len(open_):
            salt = _U64((len(steps) + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
            u = (mix(seed[open_] + salt) >> _U64(11)).astype(float) * 2.0**-53
            edge = self.edges_from[node]
            late = np.flatnonzero(u >= self.running[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= self.running[edge[late]]]
            steps.append(open_)
            edges.append(edge.astype(np.int32))
            node = self.source[edge]
            more = node >= n_first  # the first nodes are numbered first
            open_, node = open_[more], node[more]
        drawn = np.bincount(np.concatenate(steps), minlength=len(chunk)) if steps else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(drawn)])
        out = np.empty(starts[-1], np.int32)
        for k, (who, edge) in enumerate(zip(steps, edges)):
            out[starts[who + 1] - 1 - k] = edge
        return out, starts


def _utf8_size(codes: np.ndarray) -> np.ndarray:
    real = np.where(codes >= 0x110000, codes - 0x110000, codes)
    return 1 + (real >= 0x80) + (real >= 0x800) + (real >= 0x10000)


def _utf8_bytes(codes: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes of each character, in four columns; columns past its size are of no meaning."""
    real = np.where(codes >= 0x110000, codes - 0x110000, codes)
    size = _utf8_size(codes)
    out = np.zeros((len(real), 4), np.int64)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    for k in range(4):
        shift = 6 * np.maximum(size - 1 - k, 0)
        bits = real >> shift
        out[:, k] = np.where(k == 0, np.where(size == 1, real, lead | bits), 0x80 | (bits & 0x3F)) & 0xFF
    return out


def sample_texts(texts: pa.Array, keys: np.ndarray, path: str | None = None, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of large-string texts without nulls, and where each text's begin (with the end)."""
    pieces = pieces_of(path, alpha)
    cut = pc.split_pattern(texts, " ")
    words = pc.list_value_length(cut).to_numpy().astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    lattices = Lattices(coded.dictionary, pieces)
    text_chunks = np.concatenate([[0], np.cumsum(words)])
    number = np.arange(text_chunks[-1]) - np.repeat(text_chunks[:-1], words)
    seed = mix(np.repeat(mix(keys.view(_U64) ^ _U64(SEED)), words) + number.astype(_U64))
    edges, starts = lattices.sample(coded.indices.to_numpy(), seed)
    token, n_ids = lattices.token[edges], lattices.n_ids[edges]
    ends = np.concatenate([[0], np.cumsum(n_ids)])
    ids = np.repeat(token, n_ids)
    rest = np.flatnonzero(token < 0)
    for k in range(4):
        rest = rest[n_ids[rest] > k]
        ids[ends[rest] + k] = lattices.spelled[-1 - token[rest], k]
    # An empty text has no pieces: its lone mark is dropped.
    empty = np.asarray(pc.equal(texts, "").to_numpy(zero_copy_only=False))
    bounds = ends[starts[text_chunks]]
    if empty.any():
        keep = np.repeat(~empty, np.diff(bounds))
        ids = ids[keep]
        bounds = np.concatenate([[0], np.cumsum(np.where(empty, 0, np.diff(bounds)))])
    return ids, bounds


def decode_ids(ids: np.ndarray, path: str | None = None) -> str:
    """The text of piece ids: their bytes, without the mark put before the text."""
    table = pieces_of(path, ALPHA).bytes
    return b"".join([table[i] for i in ids.tolist()])[1:].decode()


def encode_sampled(path: str | None = None, alpha: float = ALPHA):
    """Column function (text, key): the piece ids of a sampled segmentation; null counts as empty."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, key in batches:
            out, at = [], 0
            for block in blocks(text, BLOCK):
                ids, bounds = sample_texts(block, np.asarray(key)[at : at + len(block)], path, alpha)
                at += len(block)
                out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.concat_arrays(out)

    return encode


def decode_pieces(path: str | None = None):
    """Column function: the text of an array of piece ids; null stays null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if i is None else decode_ids(np.array(i, np.int64), path) for i in batch.to_pylist()], pa.string())

    return decode


def row_key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id)


def sampled_segmentations(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id and ``ids`` (array of piece ids) of every row; see :func:`segmentation_digests` for what holds."""
    need_columns(docs, "doc_id", "text")
    ready_for_python(docs.sparkSession)
    return docs.select("doc_id", encode_sampled(path, alpha)(F.col("text"), row_key(F.col("doc_id"))).alias("ids"))


def segmentation_digests(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and ``lossless`` of every row.

    The same sampling and decoding as :func:`sampled_segmentations` and :func:`decode_pieces`, in one pass: ``lossless``
    says whether the decoded pieces equal the text.  Null counts as empty and has no pieces; rows with the same
    ``doc_id`` and text get the same pieces, also rows without ``doc_id``.  An empty table gives no rows; other
    columns are ignored.
    """
    need_columns(docs, "doc_id", "text")
    ready_for_python(docs.sparkSession)

    @F.arrow_udf("struct<n_pieces:bigint,ids_crc32:bigint,lossless:boolean>")
    def digest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, key in batches:
            count, crc, same, at = [], [], [], 0
            for block in blocks(text, BLOCK):
                ids, bounds = sample_texts(block, np.asarray(key)[at : at + len(block)], path, alpha)
                at += len(block)
                packed = ids.astype("<u4")
                for whole, a, b in zip(block.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    count.append(b - a)
                    crc.append(zlib.crc32(packed[a:b].tobytes()))
                    same.append(decode_ids(ids[a:b], path) == whole)
            fields = [pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.StructArray.from_arrays(fields, names=["n_pieces", "ids_crc32", "lossless"])

    told = docs.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        digest(F.col("text"), row_key(F.col("doc_id"))).alias("_d"),
    )
    return told.select("doc_id", "n_chars", "_d.*")
