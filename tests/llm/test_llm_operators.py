"""Operators against brute-force versions, held-out accuracy, and odd inputs."""

import hashlib
import os
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pytest

from cachelens.llm import common as C
from cachelens.llm import decontamination, language_id, licenses, near_dedup, quality_rules, substring_dedup, tool_calls, toxicity, url_filters
from cachelens.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "one", "one two three four", "é — ñ", "a " * 3000, "x" * 5000, "same text of six words here", "same text of six words here"]


def frame(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return (text or "").encode().split()


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed=3):
    """Families of edited copies, some with hundreds of members, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for size, length in ((150, 120), (30, 60), (3, 300), (2, 8)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(length)] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return texts + [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(40)] + ODD


@pytest.mark.parametrize("leaf", [512, 16])
def test_near_duplicates_equal_brute_force(spark, leaf):
    texts = dict(enumerate(near_copies()))
    got = near_dedup.near_duplicates(frame(spark, texts.values()), leaf=leaf, max_depth=8).collect()
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)] + [(200, 200 + k) for k in range(1, 40)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 103)} | {200 + k: 200 for k in range(40)}


def test_near_duplicates_stage_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (None, "a b c d e f", None, None, None), (3, None, "en", "s", 0)], DOCS)
    assert sorted((r["doc_id"] or -1) for r in near_dedup.stage(spark, docs, "").collect()) == [-1, 1, 3]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_stage_limit(spark):
    """Copies between 0.80 and 0.85 go in the stage."""
    rng = random.Random(11)
    texts = {}
    for family in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 104, 300, 600]))]
        texts[len(texts)] = " ".join(base)
        for changed in (0.005, 0.015, 0.019, 0.021, 0.03):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, round(changed * len(base)))):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    want = brute_components(texts, 80)
    assert want != brute_components(texts, 85)
    got = {r["doc_id"] for r in near_dedup.stage(spark, frame(spark, texts.values()), "").collect()}
    assert got == {i for i, (_, first) in want.items() if i == first}


def brute_cut(texts, window=35):
    seen = {}
    for t in texts.values():
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for i, t in texts.items():
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [35, 8])
def test_substring_dedup_equals_brute_force(spark, window):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n)] for n in (36, 60, 90, 20)]
    texts = list(ODD)
    for _ in range(60):
        parts = [[f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(10)
            parts += [p[a : len(p) - rng.randrange(10)], [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(8))]]
        texts.append(" ".join(x for q in parts for x in q))
    texts = dict(enumerate(texts))
    out = substring_dedup.remove_repeats(frame(spark, texts.values()).withColumn("kept", C.F.lit("clash")), window)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect()}
    assert got == brute_cut(texts, window)


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_toxicity_on_held_out(spark):
    rng = random.Random(1)
    plain, bad = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)], ["blargh", "snarfo", "gnashy"]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, toxic))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.with_toxicity(docs.withColumn("toxicity", C.F.lit(9)), net).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in held]) >= 0.97
    odd = {r["doc_id"]: (r["toxicity"], r["toxicity_windows"]) for r in toxicity.with_toxicity(frame(spark, ODD), net).collect()}
    assert all(0 <= s <= 1 for s, _ in odd.values()) and odd[0] == odd[1] and odd[0][1] == 0 and odd[6][1] == -(-(3000 - 32) // 24) + 1
    empty = toxicity.fit(docs.limit(0), labels)
    assert toxicity.with_toxicity(docs.limit(3), empty).count() == 3


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network.new(rng)
    import pyarrow as pa

    data, offsets = C.utf8_view(pa.array(["ab cd efg ab", "xyz cd " * 20]))
    data, starts, ends, first = toxicity.letter_words(data, offsets)
    lex = toxicity.lexicon(data, starts, ends, net)
    doc, start, size = toxicity.windows_of(first)
    idx, y, w = toxicity.window_index(lex, start, size, len(lex.bucket)), np.array([1.0, 0, 0])[doc], np.ones(len(doc))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, (lambda z: np.where(y == 1, -z, z))(net.run(net.inputs(lex), idx)))))
    g = net.gradient(net.inputs(lex), idx, lex, y, w)
    for k, at in (("fU", (0, 3)), ("bW", (2, 5)), ("att", (1,)), ("char", (int(lex.grams[0]), 0)), ("out", (4,)), ("word", (0, 1))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, k


def test_decontamination(spark):
    item = "A train leaves Boston at 9 and runs 120 miles in 3 hours so how fast does it go in miles per hour on that day"
    again = "A train leaves Denver at 7 and runs 350 km in 5 hours so how fast does it go in km per hour on that day"
    mixed = "A train leaves Denver at 7 and runs 350 km in 5 hours so how fast does it go in feet per minute on that day"
    docs = frame(spark, [f"Intro words here. {item}. More.", f"Before it: {again} and after", f"so {mixed} end", "A train leaves the town and nobody knows how fast it goes or why", item.upper(), *ODD])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "hi")], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontamination.with_verdicts(docs, bench).collect()}
    assert got[0] == (True, 7) and got[1] == (True, 7) and got[3] == (False, None) and len(got) == 15
    assert all(not got[i][0] for i in range(5, 15))
    assert not got[2][0], "miles became km in one place and feet in another"
    assert decontamination.with_verdicts(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.with_verdicts(docs.limit(0), bench).count() == 0


def found_items(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.with_verdicts(frame(spark, texts), bench).collect()}
    return [got[i]["item_id"] for i in range(len(texts))]


def test_decontamination_by_alignment(spark):
    form = "the train leaves {} at {} and runs {} {} in {} hours so how fast does it go to {}".format
    first, second, third = form("Boston", 9, 120, "miles", 3, "Boston"), form("Denver", 7, 350, "km", 5, "Denver"), form("Oslo", 4, 90, "feet", 2, "Oslo")
    twice = "last year the shop sold 12 red hats and 5 caps and this year the shop sold 30 red hats and 9 caps"
    number = "she pays 5 coins for the lamp and then waits for 5 days at home with others"
    other = "she pays 8 coins for the lamp and then waits for 6 days at home with others"
    half = form("Denver", 7, 350, "km", 5, "Oslo")
    texts = [f"see {second} or {third} here", f"see {first} or {second} here", f"see {twice} here", f"see {other} here", f"see {half} here", f"see {half} or {second} here"]
    assert found_items(spark, texts, [first, twice, number]) == [0, 0, 1, 2, None, 0]


def test_decontamination_of_dense_and_short_items(spark):
    dense = "so Tom has 3 apples , 5 pears , 7 figs and 2 plums in 4 bags , Ann has 6 apples , 8 pears , 9 figs and 1 plum in 10 bags"
    table = "12 7 45 88 3 19 204 5 61 33 90 14 27"
    units = "mix 3 kg 5 kg 7 kg 9 kg with 2 liters 4 liters 6 liters 8 liters"
    short, six, seven, eight = "What is 17 times 23", "Is 5 kg over 9 pounds", "At 9 Ann ran 5 miles", "is 5 plus 6 plus 7 or 8"
    goods = "pack 3 kg salt 5 kg rice 7 kg corn 9 kg peas 2 kg figs 4 kg nuts 6 kg oats 8 kg"
    items = [dense, table, units, short, six, seven, eight, goods]
    copies = [f"see here: {t} and then more of the words" for t in items]
    variant = "so Bob has 4 apples , 6 pears , 8 figs and 3 plums in 5 bags , Eve has 7 apples , 9 pears , 11 figs and 2 plum in 12 bags"
    clean = ["it says 13 8 46 89 4 20 205 6 62 34 91 15 28 and ends", "what is 18 times 24 then", "mix 3 kg 5 kg 7 kg 9 kg", "Is 4 kg over 8 pounds", ""]
    others = [variant, "pack 4 pounds salt 6 pounds rice 8 pounds corn 10 pounds peas 3 pounds figs 5 pounds nuts 7 pounds oats 9 pounds", "pack 4 kg salt 6 pounds rice 8 mg corn 10 kg peas 3 kg figs 5 kg nuts 7 kg oats 9 kg"]
    got = found_items(spark, [*copies, *(f"see {t} here" for t in others), *clean], items)
    assert got == [*range(8), 0, 7, None, *[None] * 5]


def test_language_identification(spark):
    rng = random.Random(2)
    make = {"aa": lambda: "".join(rng.choice(["ka", "lo", "mi"]) for _ in range(3)), "bb": lambda: "".join(rng.choice(["str", "eng", "ort"]) for _ in range(2)), "cc": lambda: "".join(rng.choice(["éu", "oi", "ça"]) for _ in range(3))}
    rows = [(i, " ".join(make[k]() for _ in range(rng.randrange(3, 80))), k, "s", 1) for i, k in enumerate(list(make) * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    chain = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.with_language(docs.select("doc_id", "text"), chain).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _, _ in rows)
    mixed = frame(spark, [" ".join([make["aa"]() for _ in range(30)] + [make["bb"]() for _ in range(40)]), *ODD, "1234 — …"])
    odd = [r for r in language_id.with_language(mixed, chain).orderBy("doc_id").collect()]
    assert odd[0]["lang_pred"] == "bb" and odd[0]["n_switches"] == 1
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 11)] == ["und"] * 4 and odd[6]["lang_pred"] != "und"
    assert language_id.with_language(mixed, language_id.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_chain_posteriors_are_exact():
    rng = np.random.default_rng(1)
    em, t, first = rng.normal(size=(200, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 1, 70, 200])
    got = language_id.posteriors(em, t, first)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            e, m = np.exp(em[a:b]), np.exp(t)
            f, g = [np.full(3, 1 / 3) @ m * e[0]], [np.ones(3)]
            for x in e[1:]:
                f.append(f[-1] @ m * x / (f[-1] @ m * x).sum())
            for x in e[:0:-1]:
                g.append(m @ (x * g[-1]) / (m @ (x * g[-1])).sum())
            want = np.array(f) * np.array(g[::-1])
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_license_scan(spark):
    docs = frame(spark, ["some prose\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "the license of the city was under the bridge", "This work is licensed under the GNU General Public License, version 3.", *ODD, *[f"plain words number {k} of the day" for k in range(60)]])
    got = {r["doc_id"]: r["license"] for r in licenses.with_license(docs).collect()}
    assert [got[i] for i in range(4)] == ["MIT", "Apache-2.0", None, "GPL-3.0"] and len(got) == 74
    assert not any(got[i] for i in range(4, 74))


@pytest.mark.parametrize("width", [40, 70, 80])
def test_wrapped_licenses(spark, width):
    texts, want = [], []
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            if len(notice) > 60:
                for prefix in ("", "# "):
                    lines = textwrap.wrap(f"Copyright 2020 some people. {notice}. See there.", width)
                    texts.append("\n".join(["some prose", "", *(prefix + x for x in lines), "", "more"]))
                    want.append(family)
    plain = [f"plain words number {k} of the day" for k in range(60)]
    got = {r["doc_id"]: r for r in licenses.with_license(frame(spark, [*texts, *plain])).collect()}
    assert [got[i]["license"] for i in range(len(texts))] == want
    assert all(got[i]["n_license_paragraphs"] == 1 for i in range(len(texts)))
    assert not any(got[len(texts) + i]["license"] for i in range(60))


def test_url_rules(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y#z"), (4, "http://x.org/fr/q"), (5, "http://x.org?fr"), (6, "ftp://badexample.net/EN/"), (7, "http://www.example.com/de/1"), (8, "http://example.com"), (3, "HTTP://A.Example.NET/en/x?y#z")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", C.F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filters.with_url_verdicts(pages).collect()}
    assert got == {1: ("", "", None), 2: ("", "", None), 3: ("a.example.net", "/en/x", "example.net/en/"), 4: ("x.org", "/fr/q", "org/fr/"), 5: ("x.org", "", None), 6: ("badexample.net", "/EN/", "net/"), 7: ("www.example.com", "/de/1", "example.com/de/"), 8: ("example.com", "", None)}
    assert url_filters.with_url_verdicts(pages.limit(0)).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("c", 1, "a", "add", '{"y": 2, "x": 1}'), ("c", 3, "b", "add", '{"x": "${a}", "y": 1}'), ("c", 5, "d", "add", '{"x": "${b}", "y": "${a}"}'),
        ("c", 7, "l1", "add", '{"x": "${l2}"}'), ("c", 8, "l2", "add", '{"x": "${l1}"}'), ("c", 9, "e", "nope", "not json"), (None, 1, "z", "add", "{}"), ("c", 4, "a", "add", "{}"),
    ], "conv_id string, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([("c", 2, "a", "three"), ("c", 6, "ghost", 'say "hi"'), ("c", 9, "a", "later")], "conv_id string, turn long, call_id string, content string")
    got = {r["call_id"]: r for r in tool_calls.link(calls, results, {"add": {"x": ("BIGINT", True), "y": ("BIGINT", False)}}).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "d": 2, "l1": None, "l2": None, "e": 0, "ghost": None}
    assert got["a"]["json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"three"}'
    assert got["ghost"]["kind"] == "orphan_result" and got["ghost"]["json"] == '{"content":"say \\"hi\\"","tool_call_id":"ghost"}'
    assert got["a"]["errors"] == [] and got["b"]["errors"] == ["x is no BIGINT"] and got["e"]["errors"] == ["unknown tool"]
    assert (got["a"]["n_calls"], got["a"]["n_results"]) == (2, 2)


def test_messages_with_calls(spark):
    rows = [("c", 0, "assistant", '{"tool_calls": [{"id": "q", "name": "answer", "arguments": "{}"}]}'), ("c", 1, "tool", '{"tool_call_id": "q", "content": "42"}'), ("c", 2, "user", "{broken"), ("c", 3, "user", None)]
    calls, results = tool_calls.parse_messages(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert [tuple(r) for r in calls.collect()] == [("c", 0, "q", "answer", "{}")]
    assert [tuple(r) for r in results.collect()] == [("c", 1, "q", "42")]


def test_quality_odd_inputs(spark):
    docs = frame(spark, [*ODD, "line one\nline one\n\nline two", "p q r p q r " * 20, "###$$$ a"]).withColumn("kept", C.F.lit("clash"))
    got = {r["doc_id"]: r for r in quality_rules.with_quality(docs).collect()}
    assert [got[i]["n_words"] for i in range(7)] == [0, 0, 0, 1, 4, 3, 3000]
    assert got[6]["n_repeat_words"] == 3000 and got[10]["n_dup_lines"] == 1 and got[11]["n_repeat_words"] == 120 and got[12]["n_symbols"] == 6
    assert quality_rules.with_quality(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    from tests.test_oracles import TABLES, normal

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    assert normal(QUERIES[name](spark, sf_dir).toPandas()) == normal(c.sql(ORACLES[name]).df())
