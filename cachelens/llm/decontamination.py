"""Benchmark decontamination by template canonicalisation.

Texts become sequences of typed tokens: numbers (digits or number words), units of measure and
names (capitalised words inside a sentence) turn into placeholders, other words are literal and
lower-cased (ASCII and Latin-1).  Windows of `window` tokens of the benchmark's templates are hash-joined with
those of the documents, so a question with other numbers, names or units still meets its original.
Windows with few literal words, and items shorter than a window, are also hashed by their values, so
that copies of dense and short items are found.  By template a window with few words counts only in a
longer alignment: overlapping windows over two windows' length or the whole item, with enough words
together and every value consistent, numbers too.  Windows without any word match by values only.

Slots are then checked for consistency: within a window equal values must stay equal and different
ones different, and over the windows of one alignment (an item at one place of a document) each unit
and name of the item must turn into one value; a number may stand for several quantities.  Windows
that fail are dropped unless all their values are the item's own.

Scale: benchmark windows set bits in a filter of fixed size, documents emit only windows that it
lets through, and the join is broadcast only after a count of the benchmark's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.llm import common as C

WINDOW, SHORTEST, LITERAL, COVERAGE = 10, 5, 6, 0.3
# Words that stand for numbers and for units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice dozen".split()
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mph kmh watt watts volt volts".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(C.span_hashes(data, np.r_[0, ends[:-1]], ends))


_NUMBERS, _UNITS = _word_hashes(NUMBER_WORDS), _word_hashes(UNIT_WORDS)
_TYPES = C.mix(np.arange(1, 4, dtype=np.uint64))  # number, unit, name


def _one_of(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def template(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text block: template code and value of each token, whether it is a slot, first token of each document."""
    data = C.lower_ascii(raw)
    capital = (raw >= 65) & (raw <= 90)
    if len(data) > 1:  # the capitals of Latin-1, two bytes in UTF-8
        wide = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))
        data[wide + 1] += 32
        capital[wide] = capital[wide + 1] = True
    digit = (data >= 48) & (data <= 57)
    if len(data) > 2:
        joint = np.zeros(len(data), bool)
        joint[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        digit |= joint
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    ws, we, _ = C.runs(letter, offsets)
    ns, ne, _ = C.runs(digit, offsets)
    starts, ends, number = np.r_[ws, ns], np.r_[we, ne], np.r_[np.zeros(len(ws), bool), np.ones(len(ns), bool)]
    order = np.argsort(starts, kind="stable")
    starts, ends, number = starts[order], ends[order], number[order]
    first = np.searchsorted(starts, offsets)
    value = C.span_hashes(data, starts, ends)
    number |= _one_of(value, _NUMBERS)
    unit = _one_of(value, _UNITS) & ~number
    # a name: capitalised but not in capitals, of two letters or more, and the last character before it that is not a space is a letter, digit or comma
    space = (data == 32) | (data == 34) | (data == 39) | (data == 40)
    back = np.maximum.accumulate(np.where(space, -1, np.arange(len(data))))
    before = back[np.maximum(starts - 1, 0)]
    opening = np.isin(np.arange(len(starts)), first) | (before < 0)
    inside = ~opening & (letter | digit | (data == 44) | (data == 45))[np.maximum(before, 0)]
    name = capital[starts] & (ends - starts >= 2) & ~capital[ends - 1] & inside & ~number & ~unit if len(starts) else np.zeros(0, bool)
    code = np.where(number, _TYPES[0], np.where(unit, _TYPES[1], np.where(name, _TYPES[2], value)))
    return code, value, number | unit | name, first


def _windows(kinds: list[tuple[int, bool]], window: int, literal: int, bits: np.ndarray | None):  # noqa: ANN202
    """mapInArrow over (doc, twin, text): windows (hash, doc, twin, at, tokens, size, slots, exact, few, before, words).

    kinds: sizes, each by template or by values (exact).  With a filter: all windows that it lets
    through.  Without one (items): the windows of the largest size that the text has room for, by
    values those that the template alone does not settle.  few: fewer than `literal` words;
    before, words: literal words before the window and in it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for lo, _, data, offsets in C.text_blocks(batch.column(2)):
                code, value, slot, first = template(data, offsets)
                marked = value & ~np.uint64(1) | (code == _TYPES[0]).astype(np.uint64)  # numbers are odd
                n = np.diff(first)
                count = np.r_[0, np.cumsum(slot)]
                for size, exact in kinds:
                    own = n >= size if bits is not None or size == window else n == size
                    room = np.where(own, n - size + 1, 0)
                    doc = np.repeat(np.arange(len(n)), room)
                    at = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + first[doc]
                    h = C.signed(C.window_hashes(value if exact else code, size, int(exact))[at]) if len(at) else np.zeros(0, np.int64)
                    words = size - (count[at + size] - count[at])
                    few = words < min(literal, size)
                    if not exact:
                        keep = ~few | ((size == window) & (words > 0))
                    else:
                        keep = np.full(len(at), True) if bits is not None else few | (size < window)
                    if bits is not None:
                        keep &= C.hits(h, bits)
                    k = np.flatnonzero(keep)
                    before = at - first[doc] - (count[at] - count[first[doc]])
                    slots = [C.signed(marked[a : a + size][slot[a : a + size]]) if not exact and count[a + size] > count[a] else h[:0] for a in at[k].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(h[k]), *(pa.array(x[lo + doc[k]]) for x in keys), pa.array((at - first[doc])[k]), pa.array(n[doc[k]]), pa.array(np.full(len(k), size)), pa.array(slots, pa.list_(pa.int64())), pa.array(np.full(len(k), exact)), pa.array(few[k] & (not exact)), pa.array(before[k]), pa.array(words[k])], names=["hash", *C.KEY, "at", "tokens", "size", "slots", "exact", "few", "before", "words"])

    return rows


_WINDOW_SCHEMA = "hash long, doc long, twin long, at long, tokens long, size long, slots array<long>, exact boolean, few boolean, before long, words long"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """Rows (doc, twin, item_id, coverage, n_windows): benchmark items found in documents (doc, twin: see row_key).

    coverage is the share of the item's tokens that lie in matched windows.  Items of fewer tokens
    than `window` are one window as a whole, by values whatever their slots; those of fewer than SHORTEST
    say too little and match nothing.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("doc"), F.lit(0).cast("long").alias("twin"), "text").mapInArrow(_windows([(n, e) for n in range(SHORTEST, window + 1) for e in (False, True)], window, literal, None), _WINDOW_SCHEMA)
    items = C.materialise(items.select("hash", F.col("doc").alias("item_id"), F.col("at").alias("item_at"), F.col("tokens").alias("item_tokens"), "size", F.col("slots").alias("item_slots"), "exact", "few", "before", "words"), "items")
    kinds = [(r["size"], r["exact"]) for r in items.select("size", "exact").distinct().collect()]  # at most 2 * (window - SHORTEST + 1)
    bits = C.id_filter(items.select(F.col("hash").alias("id")), C.python_bit("id"))
    texts = C.row_key(docs.where("text is not null")).select(*C.KEY, "text")
    found = texts.mapInArrow(_windows(kinds, window, literal, bits), _WINDOW_SCHEMA).select("hash", *C.KEY, "at", "slots")
    pattern = lambda c: F.transform(c, lambda v: F.array_position(c, v))
    same = found.join(C.bounded_broadcast(items), "hash").where(pattern(F.col("slots")) == pattern(F.col("item_slots")))
    same = C.materialise(same.select(*C.KEY, "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "item_tokens", "size", "slots", "item_slots", "few", "before", "words"), "matches")
    alignment = [*C.KEY, "item_id", "shift"]
    pairs = same.where(F.size("slots") > 0).select(*alignment, F.explode(F.arrays_zip("slots", "item_slots")).alias("s")).select(*alignment, "s.slots", "s.item_slots").distinct()
    mixed = pairs.groupBy(*alignment, "item_slots").count().where("count > 1").groupBy(*alignment).agg(F.bool_or(F.col("item_slots").bitwiseAND(1) == 0).alias("words_mixed"))
    equal = F.col("slots") == F.col("item_slots")
    judged = same.where(~equal).join(mixed, alignment, "left")
    fit = judged.where(F.when(F.col("few"), F.col("words_mixed").isNull()).otherwise(~F.coalesce("words_mixed", F.lit(False)))).drop("words_mixed")
    fit = same.where(equal).withColumn("few", F.lit(False)).unionAll(fit)
    # runs of overlapping windows: what windows with few words need
    in_order = Window.partitionBy(*alignment).orderBy("item_at", "few", "slots")
    after_gap = F.coalesce(F.lag(F.col("item_at") + F.col("size")).over(in_order) < F.col("item_at"), F.lit(False))
    runs = fit.withColumn("gap", after_gap.cast("int")).withColumn("run", F.sum("gap").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*alignment, "run")
    length = F.max(F.col("item_at") + F.col("size")).over(run) - F.min("item_at").over(run)
    known = F.max(F.col("before") + F.col("words")).over(run) - F.min("before").over(run)
    long = (length >= F.least(F.lit(2 * window), F.col("item_tokens"))) & (known >= literal)
    good = runs.withColumn("long", long).where(~F.col("few") | F.col("long"))
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("item_at", F.col("item_at") + F.col("size") - 1)))))
    return good.groupBy(*C.KEY, "item_id").agg((covered / F.max("item_tokens")).alias("coverage"), F.countDistinct("item_at").alias("n_windows"))


def verdicts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc, twin, item_id, coverage, n_windows) of contaminated rows: their best covered item, the smallest id of equals."""
    found = contamination(docs, benchmark).where(F.col("coverage") >= coverage)
    best = found.groupBy(*C.KEY).agg(F.max(F.struct("coverage", (-F.col("item_id")).alias("less"), "n_windows")).alias("b"))
    return C.materialise(best.select(*C.KEY, (-F.col("b.less")).alias("item_id"), F.col("b.coverage").alias("coverage"), F.col("b.n_windows").alias("n_windows")), "leaks")


def with_verdicts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs with contaminated, item_id, coverage and n_windows (columns of these names are replaced).

    Null texts and texts without a word are clean; repeated rows get the same verdict; items that
    are null or of fewer than SHORTEST tokens match nothing; empty tables give an empty result or clean documents.
    """
    docs = docs.drop("contaminated", "item_id", "coverage", "n_windows", *C.KEY)
    found = verdicts(docs, benchmark, coverage)
    out = C.row_key(docs).join(C.bounded_broadcast(found), C.KEY, "left").drop(*C.KEY)
    return out.withColumn("contaminated", F.col("coverage").isNotNull())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_verdicts(C.documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", "item_id", "coverage", "n_windows")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item, or a re-parameterised form of one, go.

    Null and empty texts stay; very long ones are searched whole; repeated rows share their verdict;
    with an empty benchmark all documents stay, and an empty table stays empty.
    """
    C.bounded_batches(spark)
    return with_verdicts(docs.select(*C.DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*C.DOCUMENT_COLUMNS)
