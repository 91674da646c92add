"""Packing: exact round trip of ids, gapless sequences, little padding, odd inputs."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cachelens.llm import common as C
from cachelens.llm import packing as K

ODD = ["", None, " a", "  b  c \n\n d", "it's we'll 's 12,34 a.b (c)..,", "\n", "<|endoftext|> hi<|endoftext|>there , . ; é, É. ñ.(x) ’s", "\t\tx\r\ny", "日本 語 、。 x", "…. a…, b", " \n", "a\x1cb \x1c c", "é  é  x 　é\n é", "foo \n", "x" * 3000, "w " * 4000]


def test_encoder_equals_library():
    e = K.Encoder(K.default_tokenizer())
    texts = pa.array(ODD * 2)
    for lo, hi, data, offsets in C.text_blocks(texts, 1 << 12):
        ids, first = e(data, offsets)
        for i in range(hi - lo):
            want = e.tokenizer.encode(texts[lo + i].as_py() or "", add_special_tokens=False).ids
            assert list(ids[first[i] : first[i + 1]]) == want, repr(texts[lo + i])


def check(rows, texts):
    """Every id in one piece, sequences gapless; returns padding as a share of all tokens."""
    tk = K.Encoder(K.default_tokenizer()).tokenizer
    want = {d: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    seen, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen.keys() == want.keys()
    for d, pieces in seen.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[d])
            assert r["ids_crc32"] == zlib.crc32(want[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[d])
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(map(len, want.values()))
    return (len(seqs) * 1024 - used) / used


def test_whole_table(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    rows = [r.asDict() for r in K.op10_packing(spark, sf_dir).collect()]
    assert check(rows, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}) < 0.01


def test_many_partitions_and_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, sequence_id string").repartition(70)
    rows = [r.asDict() for r in K.pack(docs, K.default_tokenizer()).collect()]
    check(rows, dict(enumerate(ODD)))
    assert sum(1 for s in {r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 1024)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert K.pack(empty, K.default_tokenizer()).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in K.pack(twice, K.default_tokenizer()).collect()) == [(0, 2), (1, 3), (1, 3)]


@pytest.mark.parametrize("length", [7, 16])
def test_other_lengths(spark, length):
    docs = spark.createDataFrame([(i, "ab " * (i % 9)) for i in range(60)], "doc_id long, text string")
    got = K.pack(docs, K.default_tokenizer(), length=length, windows=3).collect()
    by = defaultdict(int)
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= length and sum(v < length for v in by.values()) <= 1
