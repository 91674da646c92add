"""MinHash near-duplicate detection by Chosen-Path set similarity join.

A document is the set of its distinct five-word shingles.  Equal sets are one *class* (no pair
is ever made inside it).  Each class has a signature of minwise tokens.  A tree node branches
its classes by the minwise token at positions that the node itself chooses at random; small
nodes are *leaves*, compared exhaustively on full sets inside one task, larger ones branch again.
Independent trees are repeated: a pair of similarity s survives d choices with probability s**d,
so `trees` trees of depth `depth` miss it with (1 - s**d)**trees.

Two waves keep large families of copies cheap without losing a pair:

* the first `first` trees: leaves, and larger nodes cut into blocks that share the node's first
  class.  Their links give components.
* all other trees, and the larger nodes of the first: only nodes with several components are looked
  at.  A node that is too large has a largest component; if what lies outside of it is little, each
  block of that is compared with each block of the node (linear in the node).  Otherwise the node
  branches on, REPEAT independent times for each two choices, and at `max_depth` it is compared
  block by block, whatever that takes.  Every pair of such a node is compared or already connected.

Recall: a pair at 0.85 is missed by 20 trees of depth 4 with 4e-7.  In nodes that branch on, the
repeats keep it: survival over two more choices is p -> 1 - (1 - s**2 * p)**REPEAT, whose fixed
point is 0.86 at 0.85 (0.71 at 0.80), so all trees miss it with at most 1e-5 at any depth (7e-5 for
28 trees at 0.80).  Leaves judge full sets, so nothing else is lost.

Scale: a leaf holds at most `leaf` units of weight (a class is one, and one more for each WEIGHT
shingles), which bounds a task's memory.  Components come from alternating large-star/small-star
joins.  Nothing grows on the driver but an id filter of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import common as C

SHINGLE = 5
POSITIONS = 128
#: Shingles that count as much as one more class when a leaf's size is measured.
WEIGHT = 4096
#: Independent branchings of a node that stays too large, for each two choices.
REPEAT = 2
#: Leaves up to this size are judged many to a batch.
FEW = 8
#: Shingles that are counted at a time when a leaf is judged.
COLUMNS = 4096
#: The pipeline's stage links texts from 0.8 on: 28 trees of depth 4 miss a pair at that limit with (1 - 0.8**4)**28 = 4e-7.
STAGE = {"percent": 80, "trees": 28, "depth": 4}

FEATURES = "doc_id long, n_shingles long, digest binary, signature binary"


def _shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For blocks of rows: the sorted distinct shingle hashes of each document."""
    for lo, hi, data, offsets in C.text_blocks(column):
        data = C.lower_ascii(data)
        starts, ends, first = C.words(data, offsets)
        word = C.span_hashes(data, starts, ends)
        shingle = C.window_hashes(word, SHINGLE)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                sets.append(np.unique(shingle[a : b - SHINGLE + 1]))
            else:
                sets.append(C.window_hashes(word[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        yield lo, hi, sets


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """POSITIONS minwise tokens of 16 bits for each (not empty) set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    all_ = np.concatenate(sets)
    low, step = (all_ & np.uint64(0xFFFFFFFF)).astype(np.uint32), (all_ >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), POSITIONS), np.uint16)
    for i in range(POSITIONS):
        low += step
        least = np.minimum.reduceat(low, starts)
        least *= np.uint32(0x85EBCA6B)
        out[:, i] = least >> np.uint32(16)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, sets in _shingle_sets(batch.column(1)):
            full = [s for s in sets if len(s)]
            made = iter(_signatures(full)) if full else iter(())
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(made).tobytes()) if len(s) else (0, None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(3))], schema=schema)


# ------------------------------------------------------------------ nodes and leaves
def _with_choices(nodes: DataFrame, steps: int, *others: str) -> DataFrame:
    """Rows (path, id, ...) some levels deeper: each node picks its next position by its own path."""
    path = F.col("path")
    for k in range(steps):
        at = F.pmod(F.xxhash64(path, F.lit(k)), F.lit(POSITIONS)).cast("int")
        path = F.xxhash64(path, at, F.substring("signature", 2 * at + 1, 2))
    return nodes.select(path.alias("path"), "id", *others)


def _sized(nodes: DataFrame) -> DataFrame:
    """nodes (path, id, weight) with size and first of those that hold two classes or more."""
    # written before the join: its sides are then plain exchanges, which AQE splits where a node is large
    sizes = nodes.groupBy("path").agg(F.sum("weight").alias("size"), F.count("*").alias("n"), F.min("id").alias("first"))
    return C.materialise(nodes.join(C.materialise(sizes.where("n > 1").drop("n"), "sizes"), "path"), "nodes")


def _leaves(nodes: DataFrame) -> DataFrame:
    """(members) of nodes that are leaves."""
    return nodes.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("members")).select("members")


def _block(count: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), count)


def _cut(nodes: DataFrame, leaf: int) -> DataFrame:
    """(members) of blocks of nodes that are too large, each with the node's first class."""
    block = _block(F.ceil(F.col("size") * 2 / leaf), "cut")
    cut = nodes.groupBy("path", block.alias("block")).agg(F.collect_set("id").alias("members"), F.min("first").alias("first"))
    return cut.select(F.array_sort(F.array_union("members", F.array("first"))).alias("members"))


def _crossing(nodes: DataFrame, outside: DataFrame, leaf: int) -> DataFrame:
    """(members) of each block of `outside` with each block of its whole node.

    nodes (path, id, weight, component), outside (path, main, size, rest): the component that is
    left out of the one side, the weight of the node and of what lies outside of that component.
    """
    rows = nodes.join(outside, "path")
    pieces = lambda c: F.ceil(F.col(c) * 2 / leaf).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    side = rows.where("component <> main").select("path", "id", _block(pieces("rest"), "a").alias("i"), each(pieces("size")).alias("j"))
    whole = rows.select("path", "id", each(pieces("rest")).alias("i"), _block(pieces("size"), "b").alias("j"))
    return side.unionAll(whole).groupBy("path", "i", "j").agg(F.sort_array(F.collect_set("id")).alias("members")).select("members")


def _open_leaves(nodes: DataFrame, signatures: DataFrame, leaf: int, depth: int, max_depth: int) -> list[DataFrame]:
    """(members) of leaves that compare all pairs of nodes (path, id, weight, component) of several components."""
    out = []
    while True:
        parts = nodes.groupBy("path", "component").agg(F.sum("weight").alias("weight"))
        by = parts.groupBy("path").agg(F.count("*").alias("n"), F.max(F.struct("weight", "component")).alias("top"), F.sum("weight").alias("size"))
        by = C.materialise(by.where("n > 1").select("path", F.col("top.component").alias("main"), "size", (F.col("size") - F.col("top.weight")).alias("rest")), "open")
        out.append(_leaves(nodes.join(by.where(F.col("size") <= leaf).select("path"), "path")))
        large = by.where(F.col("size") > leaf)
        little = large if depth >= max_depth else large.where(F.col("rest") <= 2 * leaf)
        if large.isEmpty():
            return out
        out.append(_crossing(nodes, little, leaf))
        if depth >= max_depth:
            return out
        branching = nodes.join(large.where(F.col("rest") > 2 * leaf).select("path"), "path")
        if branching.isEmpty():
            return out
        again = branching.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(REPEAT)))).withColumn("path", F.xxhash64("path", "turn")).drop("turn")
        nodes, depth = C.materialise(_with_choices(again.join(signatures, "id"), 2, "weight", "component"), "deeper"), depth + 2


# ------------------------------------------------------------------ judging leaves
def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct values."""
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, who = values[order], np.repeat(np.arange(m), [len(s) for s in sets])[order]
    head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(values)])
    shared = np.repeat(size > 1, size)
    who, column = who[shared], np.repeat(np.cumsum(size > 1) - 1, size)[shared]
    edges = np.searchsorted(column, np.arange(0, (size > 1).sum() + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        x = np.zeros((m, COLUMNS), np.float32)
        x[who[a:b], column[a:b] - k * COLUMNS] = 1
        both += x @ x.T
    return both.astype(np.int64)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left = np.ones(len(linked), bool)
    a, b = [], []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            u = queue.pop()
            fresh = np.flatnonzero(linked[u] & left)
            left[fresh] = False
            a += [u] * len(fresh)
            b += fresh.tolist()
            queue += fresh.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def leaf_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect whatever the leaf's links connect; judged on the full sets."""
    size = np.array([len(s) for s in sets])
    both = common_counts(sets)
    linked = 100 * both >= percent * (np.add.outer(size, size) - both)
    np.fill_diagonal(linked, False)
    a, b = forest(linked)
    return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])


def _links(leaves: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct links (a, b) of all leaves (members)."""

    def judge(ids: pa.Array, shingles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return leaf_links(ids.to_numpy(), [np.frombuffer(s.as_buffer(), np.uint64) for s in shingles], percent)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            made = [judge(x.field("id"), x.field("shingles")) for x in (lists.slice(i, 1).flatten() for i in range(len(lists)))]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=["a", "b"])

    def one(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(x) for x in judge(table["id"].combine_chunks(), table["shingles"].combine_chunks())], names=["a", "b"])

    leaves = C.materialise(leaves.where(F.size("members") > 1).distinct().withColumn("leaf", F.xxhash64("members")), "leaves")
    members = leaves.select("leaf", F.size("members").alias("size"), F.explode("members").alias("id")).join(sets, "id")
    # leaves of a few members go through Python many at a time, larger ones one by one
    few = members.where(F.col("size") <= FEW).groupBy("leaf").agg(F.collect_list(F.struct("id", "shingles")).alias("rows")).select("rows").mapInArrow(many, "a long, b long")
    rest = members.where(F.col("size") > FEW).select("leaf", "id", "shingles").groupBy("leaf").applyInArrow(one, "a long, b long")
    return C.materialise(few.unionAll(rest).distinct(), "links")


def _full_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) for the classes in ids (doc_id, digest, id): one more scan, which tokenises only what the filter lets through."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in _shingle_sets(batch.column(1)):
                whole = [s.tobytes() for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([hashlib.blake2b(s, digest_size=16).digest() if s else None for s in whole], pa.binary()), pa.array(whole, pa.binary())], names=["doc_id", "digest", "shingles"])

    rows = C.only(texts.where("doc_id is not null"), ["doc_id"], ids.select("doc_id"), sets, "doc_id long, digest binary, shingles binary")
    return C.materialise(rows.join(ids, ["doc_id", "digest"]).dropDuplicates(["id"]).select("id", "shingles"), "sets")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for the ids of edges (a, b): component is the smallest id reachable.

    Alternates large-star and small-star steps until the edges no longer change; each step is a
    grouped minimum and a join.  Minima and edges are written to the shared folder, so the join's
    sides are plain exchanges, which AQE splits at the hub of a star.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b"), F.col("a")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = C.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        joined = both.join(least, "u")
        out = joined.where(F.col("v") > F.col("u")) if large else joined
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
        return (out if large else out.unionAll(least)).where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = C.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark, now = None, state(edges)
    while now != mark:
        edges = C.materialise(star(star(edges, True), False), name)
        mark, now = now, state(edges)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select("b", "b")).distinct().groupBy("id").agg(F.min("component").alias("component"))


def _classes(features: DataFrame) -> DataFrame:
    """(digest, doc_id, id, weight, signature), one row for each set: doc_id is its smallest.

    id is that doc_id too, but where one doc_id comes with several texts: there it is a number
    made from the set.
    """
    classes = features.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = C.materialise(classes.select("digest", "doc_id", (F.floor(F.col("n_shingles") / WEIGHT) + 1).alias("weight"), "signature"), "classes")
    shared = classes.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return classes.withColumn("id", F.col("doc_id"))
    made = F.xxhash64("digest").bitwiseOR(F.lit(-(1 << 63)))
    return C.materialise(classes.join(shared, "doc_id", "left").withColumn("id", F.when(F.col("shared"), made).otherwise(F.col("doc_id"))).drop("shared"), "classes")


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = 20, depth: int = 4, leaf: int = 512, max_depth: int = 16, first: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Links documents with 100 * |intersection| >= percent * |union| of their shingle sets.

    Null or empty texts have no shingles and are linked with nothing; fewer than five words are
    one shingle; repeated rows are exact copies; rows of one doc_id with different texts are judged
    each by its own text (a component is named by the smallest doc_id of any of its rows); a null
    doc_id is kept out of every class and returned as its own component (null, kept = true); an
    empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = C.materialise(docs.mapInArrow(_features, FEATURES), "features")
    classes = _classes(features)
    signatures = classes.select("id", "signature")
    roots = classes.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("path", F.xxhash64("tree"))
    nodes = _sized(_with_choices(roots, depth, "weight", "tree"))
    sets = _full_sets(docs, classes.select("doc_id", "digest", "id").join(nodes.select("id").distinct(), "id", "left_semi"))
    wave = nodes.where(F.col("tree") <= first)
    small, large = wave.where(F.col("size") <= leaf), wave.where(F.col("size") > leaf)
    links = _links(_leaves(small).unionAll(_cut(large, leaf)), sets, percent)
    found = C.materialise(components(links), "found")
    rest = nodes.where((F.col("tree") > first) | (F.col("size") > leaf)).select("path", "id", "weight")
    rest = C.materialise(rest.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "rest")
    leaves = _open_leaves(rest, signatures, leaf, depth, max_depth)
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionAll(more)
    more = _links(every, sets, percent)
    if not more.isEmpty():
        found = C.materialise(components(links.unionAll(more)), "found")
    named = classes.select("id", "digest", "doc_id").join(found, "id", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = C.materialise(named.join(least, "component", "left").select("digest", F.coalesce("least", "doc_id").alias("component_id")), "named")
    out = features.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the smallest doc_id of each near-duplicate group (at STAGE's limit) stays, in one row.

    Rows without a doc_id and null or empty texts stay (repeated rows of one doc_id as one); of rows
    of one doc_id with several texts one stays where any of them is kept; an empty table stays
    empty.  Only the ids that go are joined, so a bounded list of them needs no shuffle of the texts.
    """
    C.bounded_batches(spark)
    judged = C.materialise(near_duplicates(docs, **STAGE).select("doc_id", "kept"), "judged")
    by = C.materialise(judged.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"), "by")
    C.discard(judged)
    out = docs.join(C.bounded_broadcast(by.where("not kept").select("doc_id")), "doc_id", "left_anti").select(*C.DOCUMENT_COLUMNS)
    if not by.where("kept").isEmpty():
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(out.where("doc_id is null"))
    return out
