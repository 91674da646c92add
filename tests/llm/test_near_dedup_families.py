"""Large families of near copies, bridges and boilerplate against brute force, with production parameters."""

import random

import numpy as np
import pytest

from cachelens.llm import near_dedup
from tests.llm.test_llm_operators import brute_components, frame


def links(texts, percent):
    """(smallest reachable id of each text, number of links) by counting all pairs."""
    codes, sets = {}, []
    for t in texts:
        w = t.split()
        sets.append(sorted({codes.setdefault(tuple(w[k : k + 5]), len(codes)) for k in range(len(w) - 4)}))
    n = len(sets)
    both = np.zeros((n, n), np.float32)
    for a in range(0, len(codes), 2000):
        x = np.zeros((n, 2000), np.float32)
        for i, s in enumerate(sets):
            own = np.array(s)
            x[i, own[(own >= a) & (own < a + 2000)] - a] = 1
        both += x @ x.T
    size = np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (np.add.outer(size, size) - both)
    label = np.arange(n)
    while True:
        least = np.where(linked, label, n).min(1)
        if (least == label).all():
            return label.tolist(), int(np.triu(linked, 1).sum())
        label = least


def edited(rng, base, changes):
    copy = list(base)
    for at in rng.sample(range(len(base)), changes):
        copy[at] = f"x{rng.randrange(10**9)}"
    return " ".join(copy)


def components_of(spark, texts, **options):
    got = near_dedup.near_duplicates(frame(spark, texts), **options).collect()
    return [c for _, c in sorted((r["doc_id"], r["component_id"]) for r in got)]


def test_family_of_thousands(spark):
    """2,300 distinct near copies of one text, and their strays, with default parameters."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = [edited(rng, base, rng.choice([1, 1, 1, 2, 2, 3, 6, 9])) for _ in range(2300)]
    want, _ = links(texts, 85)
    assert len(set(want)) > 100 and max(map(want.count, set(want))) > 1000
    assert components_of(spark, texts) == want


def test_boilerplate_below_the_limit(spark):
    """Texts that share most of their words but mostly lie below the limit: nodes branch on and end in blocks."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(220):
        at = rng.randrange(0, 260)
        own = [*base[:at], *(f"x{rng.randrange(10**9)}" for _ in range(24)), *base[at + 24 :]]
        texts.append(" ".join(own))
        if rng.random() < 0.5:
            texts.append(edited(rng, own, rng.choice([1, 3, 4, 6])))
    want, n = links(texts, 85)
    assert n > 50 and len(set(want)) > 100
    for max_depth in (16, 4):
        assert components_of(spark, texts, leaf=24, max_depth=max_depth) == want


@pytest.mark.parametrize("bridges", [1, 30])
def test_links_beside_a_bridge(spark, bridges):
    """Two texts of 240 shingles at 0.86 and longer ones, at 0.839 from both, that must not hide their link."""
    texts = []
    for group in range(20):
        w = [f"g{group}w{k}" for k in range(400)]
        shared = w[:226]
        texts += [" ".join([*shared, *w[226:244]]), " ".join([*shared, *w[250:268]])]
        for k in range(bridges):
            texts.append(" ".join([*shared[:222], *(f"g{group}b{k}c{j}" for j in range(20)), *w[300:326]]))
    want, _ = links(texts, 85)
    pairs = range(0, len(texts), bridges + 2)
    assert all(want[i] == want[i + 1] == i for i in pairs)
    assert components_of(spark, texts) == want


def test_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    docs = spark.createDataFrame([(7, a), (7, b), (3, b + " more"), (9, a), (9, None), (4, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(3, 57, 3), (4, 0, 4), (7, 56, 3), (7, 56, 7), (9, 0, 9), (9, 56, 7)]
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    assert sorted(r["doc_id"] for r in near_dedup.stage(spark, full, "").collect()) == [3, 4, 7, 9]


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    texts = [" ".join(base), edited(rng, base, 200), edited(rng, base, 900), "short text of six words here"]
    docs = frame(spark, texts).selectExpr("*", "'x' AS id", "'y' AS component", "1 AS kept", "2 AS digest")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(i, n, c) for i, (n, c) in brute_components(dict(enumerate(texts))).items()] and [c for _, _, c in got] == [0, 0, 2, 3]
