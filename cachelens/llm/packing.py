"""Bounded-space online packing of documents into fixed-length token sequences.

Each partition packs its documents as they come: full sequences are cut from long documents, and
what is left of each document goes to the open window with the least room that holds it.  When
none of `windows` open windows fits, the fullest is topped up with the start of the piece and
emitted.  Leftovers of a partition are merged at its end, and the last unfilled windows of the
partitions are merged in rounds of FAN_IN, so no task ever holds more than FAN_IN windows.

Token ids come from the `tokenizers` library.  Texts are cut at single spaces and line ends
between two other characters, and before ASCII punctuation after an ASCII letter: places where
byte-level BPE of this vocabulary always starts anew.  Each distinct piece of a block is encoded
once, all of them in one call; ids are dealt out again by the byte length of each token.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import common as C

LENGTH, WINDOWS, END_ID, FAN_IN = 1024, 64, 0, 64
#: Distinct pieces that a worker remembers between blocks.
REMEMBERED = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_LEFT = _SCHEMA.append(pa.field("ids", pa.binary())).append(pa.field("part", pa.int64()))


def _space_like(data: np.ndarray) -> np.ndarray:
    """Bytes of white-space characters, Unicode's included."""
    space = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        b0 = data[lead]
        b1, b2 = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
        two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        three = ((b0 == 0xE1) & (((b1 == 0x9A) & (b2 == 0x80)) | ((b1 == 0xA0) & (b2 == 0x8E)))) | ((b0 == 0xE2) & (((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))) | ((b1 == 0x81) & (b2 == 0x9F)))) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80))
        for k in range(3):
            space[np.minimum(lead[three | (two & (k < 2))] + k, len(data) - 1)] = True
    return space


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in '.,;:!?()"#$%&*']] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Encoder:
    """Token ids of many texts at a time."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, hashes: np.ndarray, data: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Remember the ids of new pieces data[start:end]."""
        lead = (data[starts] == 32) | (data[starts] == 10)
        body = starts + lead
        # in one joined text, a piece must not touch white space of its neighbours
        joins = (body < ends) & ~space[np.minimum(body, len(data) - 1)] & ~space[ends - 1]
        flat, at = [self.flat], len(self.flat)
        for k in (np.flatnonzero(joins), np.flatnonzero(~joins)):
            if not len(k):
                continue
            if joins[k[0]]:
                extra = ~lead[k]  # these get a line end of their own before them, a token that is dropped again
                size = ends[k] - starts[k] + extra
                edge = np.cumsum(size)
                source = np.repeat(starts[k] - extra - edge + size, size) + np.arange(edge[-1])
                text = data[source]
                text[(edge - size)[extra]] = 10
                ids = np.array(self.tokenizer.encode(text.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                cut = np.r_[0, np.searchsorted(np.cumsum(self.bytes_of[ids]), edge, side="left") + 1]
                begin, end = cut[:-1] + extra, cut[1:]
            else:
                texts = [data[a:b].tobytes().decode() for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]
                made = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
                ids = np.array([i for x in made for i in x], np.uint32)
                end = np.cumsum([len(x) for x in made])
                begin = np.r_[0, end[:-1]]
            self.known.update(zip(hashes[k].tolist(), range(len(self.begin), len(self.begin) + len(k)), strict=True))
            self.begin, self.size = np.r_[self.begin, at + begin], np.r_[self.size, end - begin]
            flat.append(ids)
            at += len(ids)
        self.flat = np.concatenate(flat)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, index of each document's first id)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        edge, space = np.zeros(len(data) + 1, bool), _space_like(data)
        if len(data) > 2:
            mid = data[1:-1]
            inner = ((mid == 32) | (mid == 10)) & ~space[:-2] & ~space[2:]
            inner |= _PUNCTUATION[mid] & _LETTER[data[:-2]]
            edge[1:-2] = inner
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        hashes, where, inverse = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        get = self.known.get
        slot = np.fromiter((get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(slot < 0)
        if len(new):
            self._add(hashes[new], data, space, starts[where[new]], ends[where[new]])
            slot[new] = [self.known[h] for h in hashes[new].tolist()]
        begin, size = self.begin[slot][inverse], self.size[slot][inverse]
        total = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Rows:
    """Pieces as columns; a piece without a sequence id is a leftover and keeps its ids."""

    def __init__(self, part: int, first_sequence: int) -> None:
        self.part, self.next, self.rows = part, first_sequence, []

    def sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, None, None))
            at += len(ids)
        self.next += 1

    def leftover(self, pieces: list[tuple]) -> None:
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), None, total, None, None, ids.astype("<u4").tobytes(), self.part))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _LEFT.field(i).type) for i in range(len(_LEFT))], schema=_LEFT)


def _fill(pieces: list[tuple], length: int, out: _Rows) -> list[tuple]:
    """Emit full sequences of the pieces, largest first, cutting at their ends; what is left is one window."""
    window, used = [], 0
    for doc, start, total, ids in sorted(pieces, key=lambda p: (-len(p[3]), p[0] is not None, p[0], p[1])):
        while used + len(ids) >= length:
            room = length - used
            out.sequence([*window, (doc, start, total, ids[:room])])
            window, used, start, ids = [], 0, start + room, ids[room:]
        if len(ids):
            window.append((doc, start, total, ids))
            used += len(ids)
    return window


class Packer:
    """The open windows of one partition."""

    def __init__(self, length: int, windows: int, out: _Rows) -> None:
        self.length, self.windows, self.out = length, windows, out
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.open: dict[int, list[tuple]] = {}
        self.made = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.length:
            self.out.sequence([(doc, start, total, ids[start : start + self.length])])
            start += self.length
        if start == total:
            return
        piece = ids[start:]
        at = bisect.bisect_left(self.rooms, (len(piece), -1))
        if at == len(self.rooms) and len(self.rooms) == self.windows:
            room, w = self.rooms.pop(0)  # none fits: the fullest goes, topped up
            self.out.sequence([*self.open.pop(w), (doc, start, total, piece[:room])])
            start, piece = start + room, piece[room:]
            at = bisect.bisect_left(self.rooms, (len(piece), -1))
        if at < len(self.rooms):
            room, w = self.rooms.pop(at)
        else:
            room, w, self.made = self.length, self.made, self.made + 1
            self.open[w] = []
        self.open[w].append((doc, start, total, piece.copy()))
        if room == len(piece):
            self.out.sequence(self.open.pop(w))
        else:
            bisect.insort(self.rooms, (room - len(piece), w))

    def close(self) -> None:
        self.out.leftover(_fill([p for w in self.open.values() for p in w], self.length, self.out))


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, windows: int = WINDOWS, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs (doc_id, text).

    Every id of a document, the closing end_id included, lies in exactly one piece; offsets have
    no gap; all sequences but the very last are full.  Null and empty texts are one id; repeated
    rows are packed each; a null doc_id stays null; an empty table gives no pieces; other columns
    are ignored.
    """
    spark = docs.sparkSession

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = _Rows(part, part << 32)
        packer, encode = Packer(length, windows, out), _encoder(tokenizer_path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in C.text_blocks(batch.column(1)):
                tokens, first = encode(data, offsets)
                for d in range(hi - lo):
                    packer.add(ids[lo + d], np.append(tokens[first[d] : first[d + 1]], np.uint32(end_id)))
                yield out.take()
        packer.close()
        yield out.take()

    def merged(turn: int, last: bool):  # noqa: ANN202
        def merge(table: pa.Table) -> pa.Table:
            group = table["part"][0].as_py() // FAN_IN
            out = _Rows(group, (turn << 56) | (group << 32))
            window = _fill([(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in table.to_pylist()], length, out)
            if last and window:
                out.sequence(window)
            else:
                out.leftover(window)
            return pa.Table.from_batches([out.take()])

        return merge

    kind = PIECES + ", ids binary, part long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = C.materialise(rows.mapInArrow(packed, kind), "packed")
    done, left, turn = made.where("sequence_id is not null"), made.where("sequence_id is null"), 1
    while True:
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        last = parts < FAN_IN
        made = C.materialise(left.groupBy(F.floor(F.col("part") / FAN_IN).alias("grp")).applyInArrow(merged(turn, last), kind), "merged")
        done, left, turn = done.unionAll(made.where("sequence_id is not null")), made.where("sequence_id is null"), turn + 1
        if last:
            break
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir), default_tokenizer())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces of the documents that are left.

    Null and empty texts are one id each; very long ones are cut; repeated rows are packed each; an
    empty table gives no pieces.
    """
    C.bounded_batches(spark)
    return pack(docs, default_tokenizer())
