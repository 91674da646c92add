"""Repeated rows, null ids, clashing columns, long texts and held-out figures of the operators."""

import textwrap

import numpy as np
import pyarrow as pa
import pytest

from cachelens.llm import common as C
from cachelens.llm import decontamination, language_id, licenses, quality_rules, substring_dedup, tool_calls, toxicity, url_filters
from tests.llm.test_llm_operators import DOCS, ODD, brute_cut, frame

PLAIN = [f"plain words number {k} of the day" for k in range(60)]
BSD = licenses.TEMPLATES["BSD-3-Clause"][0]


def test_license_rows_are_judged_alone(spark):
    """Halves of a notice in rows without an id or in repeated rows don't add up."""
    half = " ".join(BSD.split()[:10])
    rest = " ".join(BSD.split()[10:])
    texts = [(None, half), (None, rest), (5, half), (5, half), (5, half), (6, BSD), (6, BSD), (None, BSD), (7, "long " * 20_000 + "\n" + BSD), *((100 + i, t) for i, t in enumerate(PLAIN))]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts], "doc_id long, text string, license string, gram double")
    got = [(r["doc_id"], r["license"], r["n_license_paragraphs"]) for r in licenses.with_license(docs).collect()]
    assert len(got) == len(texts)
    found = sorted((x for x in got if x[1]), key=str)
    assert found == [(6, "BSD-3-Clause", 1), (6, "BSD-3-Clause", 1), (7, "BSD-3-Clause", 1), (None, "BSD-3-Clause", 1)]


def test_license_unknown_class(spark):
    """Sentences about licences, seen in training or not, are no notices; an empty table has none."""
    other = ["Their licence to trade in the port was renewed.", "He lost permission to enter after the license expired.", "The redistribution of seats followed the census.", "The work of the public library is licensed by the state under general terms."]
    docs = frame(spark, [*licenses.NO_NOTICE, *other, *PLAIN])
    assert not [r for r in licenses.with_license(docs).collect() if r["license"] or r["n_unconfirmed"]]
    assert licenses.with_license(docs.limit(0)).count() == 0
    assert all(licenses.re.search(licenses.TELLING, t) for ts in licenses.TEMPLATES.values() for t in ts)


def test_license_texts_without_telling_words(spark):
    """Shortened notices without any of the telling words are found as well, on one line or wrapped."""
    cut = [("MIT", "hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"), ("BSD-3-Clause", "use in source and binary forms, with or without modification, are permitted provided that the following conditions are met")]
    cut += [(f, "some prose\n# " + t[: t.index(" ", 60)] + "\n# " + t[t.index(" ", 60) + 1 :] + "\nmore") for f, t in cut]
    assert not any(licenses.re.search(licenses.TELLING, t) for _, t in cut)
    got = {r["doc_id"]: r for r in licenses.with_license(frame(spark, [*(t for _, t in cut), *PLAIN])).collect()}
    assert [got[i]["license"] for i in range(len(cut))] == [f for f, _ in cut]
    assert all(got[i]["n_license_paragraphs"] == 1 for i in range(len(cut)))
    assert not any(got[len(cut) + i]["license"] for i in range(len(PLAIN)))


@pytest.mark.parametrize("width", [1, 20])
def test_license_narrow_lines(spark, width):
    """Notices wrapped over more than five lines, down to a word a line, are found once."""
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 100]
    texts = ["some prose\n\n" + "\n".join(textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)) + "\n\nmore" for _, t in notices]
    assert all(t.count("\n") > 8 for t in texts)
    got = {r["doc_id"]: r for r in licenses.with_license(frame(spark, [*texts, *PLAIN])).collect()}
    assert [(got[i]["license"], got[i]["n_license_paragraphs"]) for i in range(len(texts))] == [(f, 1) for f, _ in notices]
    assert not any(got[len(texts) + i]["license"] for i in range(len(PLAIN)))


def test_url_trees(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = url_filters.fit(pages)
    assert model.error_fixed <= 0.25 and model.error_rules <= 0.3  # of a handful of urls
    rows = [(1, "http://cheap-pills-777.test.com/buy/991123?aff=4&ref=88"), (2, "http://win-casino-99.test.org/go?id=7712&s=1&k=2"), (3, "https://www.library.test.com/en/books"), (4, "https://museum.test.org/en/paintings"), (5, "x" * 50_000), (6, "")]
    got = {r["page_id"]: r for r in url_filters.with_url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), model=model).collect()}
    assert [got[i]["verdict"] for i in (1, 2, 3, 4)] == ["block", "block", "allow", "allow"]
    assert all(r["rule"] is None and 0 <= r["block_score"] <= 1 for r in got.values())


CALLS = "conv_id string, turn long, call_id string, name string, arguments string"


def test_levels_of_long_chains(spark):
    """A chain of 100 calls, calls with several references above it, circles and missing calls."""
    rows = [("c", 0, "k0", "t", "{}")] + [("c", i, f"k{i}", "t", f'{{"x": "${{k{i - 1}}}"}}') for i in range(1, 100)]
    rows += [("c", 200, "j", "t", "${k99} ${k3}"), ("c", 201, "m", "t", "${j}"), ("c", 202, "n", "t", "${m} ${k0}"), ("c", 203, "o", "t", "${n}")]
    rows += [("c", 300 + i, f"r{i}", "t", f"${{r{(i + 1) % 3}}}") for i in range(3)] + [("c", 310, "s", "t", "${r0} ${k0}"), ("c", 311, "u", "t", "${gone}"), ("c", 312, "v", "t", "${u}"), ("c", 313, "w", "t", None), ("d", 1, "k1", "t", "${k0}")]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(spark.createDataFrame(rows, CALLS).selectExpr("*", "'x' AS level", "'y' AS refs")).collect()}
    want = {("c", f"k{i}"): i for i in range(100)} | {("c", "j"): 100, ("c", "m"): 101, ("c", "n"): 102, ("c", "o"): 103, ("c", "w"): 0}
    assert got == want | {("c", k): None for k in ("r0", "r1", "r2", "s", "u", "v")} | {("d", "k1"): None}


def test_links_in_order_and_odd_inputs(spark):
    calls = spark.createDataFrame([("c", 1, "z", "t", "${a}"), ("c", 2, "a", "t", "{}"), ("c", 3, "b", None, "y" * 50_000), ("c", 2, "a", "t", "{}"), ("c", None, "n", "t", None), ("c", 1, None, "t", "{}")], CALLS).withColumn("r", C.F.lit("clash"))
    results = spark.createDataFrame([("c", 9, "a", None), ("c", 9, "a", None), (None, 1, "a", "x")], "conv_id string, turn long, call_id string, content string")
    got = tool_calls.link(calls, results, {"t": {}}).collect()
    assert [r["call_id"] for r in got] == ["n", "a", "b", "z"] and [r["level"] for r in got] == [0, 0, 0, 1]
    assert [(r["n_calls"], r["n_results"]) for r in got] == [(1, 0), (2, 2), (1, 0), (1, 0)]
    assert got[0]["errors"] == ["arguments are no object"] and got[2]["errors"] == ["unknown tool"]
    assert tool_calls.link(calls.limit(0), results.limit(0), {}).count() == 0


def test_decontamination_of_repeated_rows(spark):
    item = "A train leaves Boston at 9 and runs 120 miles in 3 hours so how fast does it go on that day"
    texts = [(1, item), (1, item), (1, "clean words"), (None, item), (None, "other words"), (2, "long " * 30_000 + item)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in texts], "doc_id long, text string, coverage int, doc int, item_id string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"][:5], r["contaminated"], r["item_id"]) for r in decontamination.with_verdicts(docs, bench).collect())
    assert got == [("1", "A tra", True, 7), ("1", "A tra", True, 7), ("1", "clean", False, None), ("2", "long ", True, 7), ("None", "A tra", True, 7), ("None", "other", False, None)]


def test_substring_dedup_of_rows_without_ids_and_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(50))
    texts = {None: f"a b {passage} c", 1: f"x {passage}", 2: "u " * 9_000 + passage, 3: " ".join(f"q{k}" for k in range(20_000))}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, doc string, twin int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {i: v[:2] for i, v in brute_cut(texts).items()}


def test_language_of_repeated_rows(spark):
    texts = ["der die das und nicht " * 8, "the of and that with " * 8]
    rows = [(i, texts[i % 2], ("de", "en")[i % 2], "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    same = spark.createDataFrame([(1, texts[0] * 300, "x", 9), (1, texts[0] * 300, "x", 9), (None, texts[1], "x", 9)], "doc_id long, text string, lang_pred string, lang_score int")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.with_language(same, language_id.fit(docs)).collect()]
    assert sorted(got, key=str) == [(1, "de"), (1, "de"), (None, "en")]


def test_quality_host_that_fails(spark):
    """Good documents of a host whose others are nearly all bad go; those without a source stay."""
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(i, "too short", "en", "bad", 1) for i in range(60)] + [(100, good, "en", "bad", 1), (101, good, "en", None, 1)] + [(200 + h * 10 + i, good, "en", f"good{h}", 1) for h in range(20) for i in range(6)]
    got = {r["doc_id"]: r for r in quality_rules.with_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[100]["base_failed"] and got[100]["host_failed"] and not got[100]["kept"]
    assert got[101]["kept"] and all(got[i]["kept"] for i in got if i >= 200) and not any(got[i]["kept"] for i in range(60))


def test_toxicity_scores_equal_brute_force():
    """Scores of whole texts by a plain recurrence over each window, one by one."""
    net = toxicity.Network.new(np.random.default_rng(3))
    net.vocabulary = np.sort(np.array([C.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in ("alpha", "beta", "gamma")]))
    texts = ["Alpha beta", None, "", "... 12", "gamma delta " * 40, "beta " * 33 + "é alpha", *ODD]
    got, count, worst = toxicity.score_texts(net, pa.array(texts, pa.string()))
    sig = lambda x: 1 / (1 + np.exp(-x))
    for i, text in enumerate(texts):
        data, starts, ends, first = toxicity.letter_words(*C.utf8_view(pa.array([text], pa.string())))
        logits = []
        if len(starts):
            lex = toxicity.lexicon(data, starts, ends, net)
            x = net.inputs(lex).astype(np.float64)
            n = len(starts)
            begins = list(range(0, max(n - 32, 0), 24)) + [max(n - 32, 0)]
            for a in dict.fromkeys(begins):
                rows, H, p = x[lex.code[a : a + 32]], toxicity.HIDDEN, net.p
                states = np.zeros((len(rows), 2 * H))
                for d, order, at in (("f", range(len(rows)), 0), ("b", range(len(rows) - 1, -1, -1), H)):
                    h = np.zeros(H)
                    for t in order:
                        g, u = rows[t] @ p[f"{d}W"] + p[f"{d}b"], h @ p[f"{d}U"]
                        z, r = sig(g[:H] + u[:H]), sig(g[H : 2 * H] + u[H : 2 * H])
                        c = np.tanh(g[2 * H :] + r * u[2 * H :])
                        h = states[t, at : at + H] = c + z * (h - c)
                e = np.exp(states @ p["att"])
                logits.append(float(e / e.sum() @ states @ p["out"] + p["bias"][0]))
        assert count[i] == len(logits)
        assert abs(got[i] - sig(max(logits, default=float(net.p["bias"][0])))) < 1e-4

