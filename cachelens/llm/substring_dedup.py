"""Substring deduplication by level-wise doubling.

A *window* is `window` (35) consecutive words of one document; every word covered by a window
whose word sequence also starts anywhere else is removed.  Testing all windows at full length
would shuffle a row for each word of the corpus, so repeated windows are found by length:

1. windows of a quarter of the length (9 words), the *seeds*.  Each full window is stood for by the leftmost
   seed of least hash in it; equal windows have equal seeds, so windows whose seed is not
   repeated are done.  Neighbouring windows share seeds: about one row in 14 words.
2. seeds that are repeated are extended to twice that length, to the left and to the right; one
   of the two lies inside any window.  Seeds with neither repeated are done.
3. twice again, cut to the full length: the windows that share a surviving seed decide.  They are
   counted in two steps, which spares most rows where whole passages repeat.  Windows that share a
   seed form a *block* of 35 to 61 words, and blocks that are repeated whole are settled, with all
   their windows.  The windows of the blocks that are left are counted one by one, against each
   other and against the windows of one copy of each settled block.

Windows are compared by 128 bits of hash where they decide one by one, blocks by 96; shorter levels
only prune.

Each level is a grouped count (summed before the shuffle, so a passage that a third of all
documents share is a row per task) and a semi-join that AQE may split.  Texts are joined twice,
and only those that a fixed bitmap of candidate rows lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import common as C

WINDOW = 35


def _blocks(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Blocks of all documents of a text block: runs of windows with one seed."""
    seed = -(-window // 4)
    starts, ends, first = C.words(data, offsets)
    word = C.span_hashes(data, starts, ends)
    n = np.diff(first)
    out = {"first": first, "word": word, "starts": starts, "ends": ends}
    short = C.window_hashes(word, seed)
    wide = C.window_hashes(word, 2 * seed, 1)
    valid = np.zeros(max(len(word) - window + 1, 0), bool)
    for a, k in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if k >= window:
            valid[a : a + k - window + 1] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return out | {k: np.zeros(0, np.int64) for k in ("doc", "seed_at", "lo", "hi", "nth")} | {k: np.zeros(0, np.uint64) for k in ("seed", "left", "right", "block")} | {"has_left": np.zeros(0, bool), "has_right": np.zeros(0, bool), "check": np.zeros(0, np.int32)}
    least = np.lib.stride_tricks.sliding_window_view(short, window - seed + 1).argmin(axis=1)[at] + at
    doc = np.searchsorted(first, at, side="right") - 1
    fresh = np.r_[True, (np.diff(least) != 0) | (np.diff(doc) != 0)]
    head = np.flatnonzero(fresh)
    lo, hi = at[head], at[np.r_[head[1:], len(at)] - 1]
    a, doc = least[head], doc[head]
    has_left, has_right = a - seed >= first[doc], a + 2 * seed <= first[doc + 1]
    pick = lambda ok, i: np.where(ok, wide[np.where(ok, i, 0)] if len(wide) else np.uint64(0), np.uint64(0))
    up, down = C._WORDS.to(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=total[1:])
    whole = C.mix((total[hi + window] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # a second hash, of other values of the words
    np.cumsum(C.mix(word + np.uint64(1)) * up[: len(word)], out=total[1:])
    check = (C.mix((total[hi + window] - total[lo]) * down[lo]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    nth = np.arange(len(a)) - np.searchsorted(doc, doc)
    return out | {"doc": doc, "nth": nth, "lo": lo, "hi": hi, "seed": short[a], "left": pick(has_left, a - seed), "right": pick(has_right, a), "has_left": has_left, "has_right": has_right, "block": whole, "check": check}


def _keys(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    """The two key columns of a batch at the given rows."""
    return [pa.array(batch.column(k).to_numpy()[rows]) for k in (0, 1)]


def _block_rows(window: int):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in C.text_blocks(batch.column(2)):
                b = _blocks(data, offsets, window)
                half = lambda k: pa.array((b[k] >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~b[f"has_{k}"])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*_keys(batch, lo + b["doc"]), pa.array(b["nth"].astype(np.int32)), pa.array(C.signed(b["seed"])), half("left"), half("right"), pa.array(C.signed(b["block"])), pa.array(b["check"])], names=[*C.KEY, "nth", "seed", "left", "right", "block", "block_check"])

    return rows


def _window_rows(window: int):  # noqa: ANN202
    """Windows of unsettled blocks (weight 1) and of one copy of each settled block (weight 2)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = batch.column(3)
            for lo, hi, data, offsets in C.text_blocks(batch.column(2)):
                b = _blocks(data, offsets, window)
                if not len(b["doc"]):
                    continue
                full = C.window_hashes(b["word"], window, 2)
                spare = C.window_hashes(C.mix(b["word"] + np.uint64(1)), window, 3)
                weight = np.full(len(b["doc"]), -1)
                begin = np.searchsorted(b["doc"], np.arange(hi - lo))
                for d in range(hi - lo):
                    s = states[lo + d]
                    if s.is_valid and len(s):
                        own = s.values
                        weight[begin[d] + own.field("nth").to_numpy()] = own.field("state").to_numpy()
                use = np.flatnonzero(np.isin(weight, (0, 2)))
                size = b["hi"][use] - b["lo"][use] + 1
                p = np.repeat(b["lo"][use], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                doc = np.repeat(b["doc"][use], size)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(full[p])), pa.array(C.signed(spare[p])), pa.array(np.repeat(np.where(weight[use] == 2, 2, 1), size).astype(np.int32)), *_keys(batch, lo + doc), pa.array((p - b["first"][doc]).astype(np.int32))], names=["hash", "check", "weight", *C.KEY, "at"])

    return rows


def _spans(window: int):  # noqa: ANN202
    """Removed word spans of each document from its settled blocks and repeated windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, at = batch.column(3), batch.column(4)
            for lo, hi, data, offsets in C.text_blocks(batch.column(2)):
                b = _blocks(data, offsets, window)
                begin = np.searchsorted(b["doc"], np.arange(hi - lo + 1))
                out = []
                for d in range(hi - lo):
                    n = int(b["first"][d + 1] - b["first"][d])
                    edge = np.zeros(n + 1, np.int64)
                    s, w = states[lo + d], at[lo + d]
                    if s.is_valid and len(s):
                        done = begin[d] + s.values.field("nth").to_numpy()[s.values.field("state").to_numpy() > 0]
                        np.add.at(edge, b["lo"][done] - b["first"][d], 1)
                        np.add.at(edge, b["hi"][done] - b["first"][d] + window, -1)
                    if w.is_valid and len(w):
                        p = w.values.to_numpy()
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + window, -1)
                    hit = np.r_[0, np.cumsum(edge[:-1]) > 0, 0].astype(np.int8)
                    step = np.diff(hit)
                    out.append([{"begin": x, "end": y} for x, y in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], names=[*C.KEY, "spans"])

    return rows


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, twin, spans): for each row with repeated windows, the word ranges [begin, end) they cover."""
    texts = C.row_key(docs.select("doc_id", "text").where("text is not null")).select(*C.KEY, "text")
    seeds = C.materialise(texts.mapInArrow(_block_rows(window), "doc long, twin long, nth int, seed long, left int, right int, block long, block_check int"), "seeds")
    # counts are written before each join: its sides are then plain exchanges, which AQE splits where a key is hot
    again = C.materialise(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "again1")
    level = C.materialise(seeds.join(again, "seed", "left_semi"), "level1")
    C.discard(seeds, again)
    sides = level.select(*C.KEY, "nth", "seed", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("twice")), F.struct(F.lit(1).alias("side"), F.col("right").alias("twice")))).alias("s")).select(*C.KEY, "nth", "seed", "s.side", "s.twice").where("twice is not null")
    again = C.materialise(sides.groupBy("seed", "side", "twice").agg(F.count("*").alias("n")).where("n > 1").select("seed", "side", "twice"), "again2")
    alive = sides.join(again, ["seed", "side", "twice"], "left_semi").select(*C.KEY, "nth").distinct()
    second = C.materialise(level.select(*C.KEY, "nth", "block", "block_check").join(alive, [*C.KEY, "nth"], "left_semi"), "level2")
    C.discard(level, again)
    block = ["block", "block_check"]
    again = C.materialise(second.groupBy(*block).agg(F.count("*").alias("n"), F.min(F.struct(*C.KEY, "nth")).alias("copy")).where("n > 1").select(*block, "copy"), "again3")
    state = F.when(F.col("copy").isNull(), 0).when((F.col("copy.doc") == F.col("doc")) & (F.col("copy.twin") == F.col("twin")) & (F.col("copy.nth") == F.col("nth")), 2).otherwise(1)
    states = second.join(again, block, "left").select(*C.KEY, F.struct("nth", state.cast("int").alias("state")).alias("s"))
    states = C.materialise(states.groupBy(*C.KEY).agg(F.collect_set("s").alias("states")), "states")
    C.discard(second, again)
    windows = C.only(texts, C.KEY, states).join(states, C.KEY).select(*C.KEY, "text", "states")
    windows = C.materialise(windows.mapInArrow(_window_rows(window), "hash long, check long, weight int, doc long, twin long, at int"), "windows")
    again = C.materialise(windows.groupBy("hash", "check").agg(F.sum("weight").alias("n")).where("n > 1").select("hash", "check"), "again4")
    found = windows.where("weight = 1").join(again, ["hash", "check"], "left_semi").groupBy(*C.KEY).agg(F.collect_set("at").alias("at"))
    settled = states.where(F.exists("states", lambda s: s["state"] > 0)).select(*C.KEY, "states")
    marks = C.materialise(settled.join(found, C.KEY, "full_outer"), "marks")
    C.discard(states, windows, again)
    rows = C.only(texts, C.KEY, marks).join(marks, C.KEY).select(*C.KEY, "text", "states", "at").mapInArrow(_spans(window), "doc long, twin long, spans array<struct<begin int, end int>>")
    spans = C.materialise(rows.dropDuplicates(C.KEY), "spans")
    C.discard(marks)
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends n_words, n_removed and kept (the words that stay, joined by one space)."""
    for batch in C.pieces(batches):
        texts, spans = batch.column("text"), batch.column("spans")
        n_words, n_removed, kept = [], [], []
        for text, span in zip(texts, spans, strict=True):
            w = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n_words.append(len(w))
            if span.is_valid:
                for s in reversed(span.as_py()):
                    del w[s["begin"] : s["end"]]
            n_removed.append(n_words[-1] - len(w))
            kept.append(b" ".join(w))
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        columns.pop("spans")
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed and kept, the text of the words that stay.

    Words are maximal runs without space, tab..carriage return, unchanged in case; windows are
    judged on the input.  Null and empty texts have no words and kept ''; texts of fewer than
    `window` words lose nothing; repeated rows count as copies of each other; an empty table
    gives an empty result.  Columns of docs named n_words, n_removed, kept, doc, twin,
    spans or _bit are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept", *C.KEY, "spans", "_bit")
    spans = repeated_spans(docs, window)
    made = ",n_words:bigint,n_removed:bigint,kept:string"
    rows = C.row_key(docs)
    bare = rows.withColumn("spans", F.lit(None).cast("array<struct<begin:int,end:int>>"))
    whole, others = C.split(bare, C.KEY, spans, _cut, rows.schema.simpleString()[len("struct<") : -1] + made)
    cut = others.drop("spans").join(spans, C.KEY, "left").drop(*C.KEY).mapInArrow(_cut, docs.schema.simpleString()[len("struct<") : -1] + made)
    return cut if whole is None else whole.drop(*C.KEY).unionAll(cut)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated words go; texts that lose nothing stay as they are, null and empty ones too.

    Every row stays (one whose words all go with an empty text); repeated rows are copies of each
    other; very long texts are cut like others; an empty table stays empty.
    """
    C.bounded_batches(spark)
    out = remove_repeats(docs.select(*C.DOCUMENT_COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))
