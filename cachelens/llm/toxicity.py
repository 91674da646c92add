"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Words are runs of letters, ASCII lower-cased.  A word's input is the vector of that word (one for all words
outside a vocabulary of at most BUCKETS words) and the mean of hashed vectors of its character four-grams.  Windows of 32 words, each overlapping the next by 8,
cover every whole text; a document's logit is that of its worst window, calibrated by Platt scaling.

Training (numpy, on the driver) uses at most `sample` labelled documents of at most `chars`
characters, taken in order of a hash of their id: a bounded sample whatever the corpus.  Labels are
of documents, so each round takes the worst windows of every document under the model as it is
(the first round: under word log-odds) and random ones of the clean documents.

Scoring is one pass without a shuffle: the model is a constant of about half a megabyte, and input
projections are computed once for each distinct word of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import common as C

WINDOW, STRIDE, HIDDEN, EMBED, BUCKETS, GRAMS = 32, 24, 8, 8, 4096, 1 << 15
SAMPLE, SAMPLE_CHARS, THRESHOLD = 3000, 20_000, 0.3
#: Natural logarithm of how much rarer than one chance finding a telling word or four-gram must be.
SURE = -1.0
F32 = np.float32


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the letter runs of each document."""
    data = C.lower_ascii(data)
    return data, *C.runs(((data >= 97) & (data <= 122)) | (data >= 128), offsets)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, length) of every window: the last one of a text ends with it."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return doc, first[doc] + start, np.minimum(n[doc], WINDOW)


@dataclass
class Lexicon:
    """The distinct words of a block: rows of its vector and of its four-grams'."""

    bucket: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    code: np.ndarray  # of each word of the block


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, Lexicon]:
    """(hashes of the distinct words, in order; their lexicon with row 0 for each word and a row for each four-gram)."""
    distinct, where, code = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    a, size = starts[where], (ends - starts)[where]
    begin = np.cumsum(size) - size
    at = np.repeat(a - begin, size) + np.arange(size.sum())
    head, tail = np.zeros(len(at), bool), np.zeros(len(at), bool)
    head[begin], tail[begin + size - 1] = True, True
    own = data[at].astype(np.uint32)
    before = np.where(head, 0, data[np.maximum(at - 1, 0)]).astype(np.uint32)
    after = np.where(tail, 0, data[np.minimum(at + 1, len(data) - 1)]).astype(np.uint32)
    end = tail | np.r_[tail[1:], True]
    beyond = np.where(end, 0, data[np.minimum(at + 2, len(data) - 1)]).astype(np.uint32)
    grams = ((before << 24 | own << 16 | after << 8 | beyond) * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return distinct, Lexicon(np.zeros(len(distinct), np.int64), grams, begin, code.astype(np.int32))


def lexicon(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, net: Network) -> Lexicon:
    return known_rows(*distinct_words(data, starts, ends), net)


def known_rows(distinct: np.ndarray, lex: Lexicon, net: Network) -> Lexicon:
    return Lexicon(word_rows(distinct, net.vocabulary), net.grams[lex.grams], lex.begin, lex.code)


def word_rows(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Rows of word vectors for word hashes: 0 for all words outside the vocabulary."""
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at + 1, 0)


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    grams: np.ndarray = field(default_factory=lambda: np.arange(GRAMS))
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        r = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(F32)
        p = {"word": r(BUCKETS, EMBED), "char": r(GRAMS, EMBED, k=0.1), "att": r(2 * HIDDEN), "out": r(2 * HIDDEN), "bias": np.full(1, -2, F32)}
        for d in "fb":
            p |= {f"{d}W": r(2 * EMBED, 3 * HIDDEN), f"{d}U": r(HIDDEN, 3 * HIDDEN), f"{d}b": np.zeros(3 * HIDDEN, F32)}
        return cls(p)

    def inputs(self, lex: Lexicon) -> np.ndarray:
        """Word and character input of each distinct word; the last row is padding."""
        size = np.diff(np.r_[lex.begin, len(lex.grams)])[:, None]
        chars = np.add.reduceat(self.p["char"][lex.grams], lex.begin) / size if len(lex.begin) else np.zeros((0, EMBED), F32)
        x = np.hstack([self.p["word"][lex.bucket], chars]).astype(F32)
        return np.vstack([x, np.zeros((1, 2 * EMBED), F32)])

    def run(self, x: np.ndarray, idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; idx (WINDOW, n) are rows of x, len(x) - 1 where there is no word."""
        p, n, H = self.p, idx.shape[1], HIDDEN
        mask = idx < len(x) - 1
        states = np.empty((WINDOW, n, 2 * H), F32)
        for d in "fb":
            table, U = x @ p[f"{d}W"] + p[f"{d}b"], p[f"{d}U"]
            h, at = np.zeros((n, H), F32), slice(0, H) if d == "f" else slice(H, 2 * H)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, u = table[idx[t]], h @ U
                g[:, : 2 * H] += u[:, : 2 * H]
                zr = g[:, : 2 * H]
                zr *= F32(0.5)
                np.tanh(zr, out=zr)
                zr *= F32(0.5)
                zr += F32(0.5)
                un = u[:, 2 * H :]
                c = g[:, 2 * H :] + zr[:, H:] * un
                np.tanh(c, out=c)
                new = c + zr[:, :H] * (h - c)
                if not mask[t].all():
                    new = np.where(mask[t][:, None], new, h)
                if keep is not None:
                    keep[d, t] = (h, zr[:, :H].copy(), zr[:, H:].copy(), c, un)
                states[t, :, at] = h = new
        e = states @ p["att"]
        e[~mask] = -1e9
        e -= e.max(0)
        np.exp(e, out=e)
        e /= e.sum(0)
        pooled = np.einsum("tn,tnh->nh", e, states)
        if keep is not None:
            keep["pool"] = (mask, states, e, pooled)
        return pooled @ p["out"] + p["bias"]

    def gradient(self, x: np.ndarray, idx: np.ndarray, lex: Lexicon, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted logistic loss by backpropagation through time."""
        keep: dict = {}
        p, H = self.p, HIDDEN
        logit = self.run(x, idx, keep)
        mask, states, a, pooled = keep["pool"]
        d = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(F32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        da = np.einsum("tnh,nh->tn", states, dp)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnh->h", de, states)
        ds = a[:, :, None] * dp + de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for dr in "fb":
            W, U = p[f"{dr}W"], p[f"{dr}U"]
            dtable, dU = np.zeros((len(x), 3 * H), F32), np.zeros_like(U)
            dh, at = np.zeros((idx.shape[1], H), F32), slice(0, H) if dr == "f" else slice(H, 2 * H)
            for t in range(WINDOW - 1, -1, -1) if dr == "f" else range(WINDOW):
                h, z, r, c, un = keep[dr, t]
                dh = dh + ds[t, :, at]
                m = mask[t][:, None]
                dn = np.where(m, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                gate = np.hstack([dn * (h - c) * z * (1 - z), dc * un * r * (1 - r)])
                du = np.hstack([gate, dc * r])
                dU += h.T @ du
                np.add.at(dtable, idx[t], np.hstack([gate, dc]))
                dh = np.where(m, dn * z, dh) + du @ U.T
            g |= {f"{dr}W": x.T @ dtable, f"{dr}U": dU, f"{dr}b": dtable.sum(0)}
            dx += dtable @ W.T
        dx = dx[:-1]
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], lex.bucket, dx[:, :EMBED])
        size = np.diff(np.r_[lex.begin, len(lex.grams)])
        np.add.at(g["char"], lex.grams, np.repeat(dx[:, EMBED:] / size[:, None], size, axis=0))
        return g


def window_index(lex: Lexicon, start: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    at = start + np.arange(WINDOW)[:, None]
    return np.where(np.arange(WINDOW)[:, None] < size, lex.code[np.minimum(at, len(lex.code) - 1)], pad)


def _logits(net: Network, lex: Lexicon, x: np.ndarray, start: np.ndarray, size: np.ndarray, chunk: int = 4096) -> np.ndarray:
    out = np.empty(len(start), F32)
    for a in range(0, len(start), chunk):
        s = slice(a, a + chunk)
        out[s] = net.run(x, window_index(lex, start[s], size[s], len(x) - 1))
    return out


def train(texts: list[str] | pa.Array, toxic: np.ndarray, rounds: int = 4, passes: int = 2, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """A network fitted to document labels; without both labels it scores every text alike."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    toxic = np.asarray(toxic, np.int64)
    n_texts, (data, offsets) = len(texts), C.utf8_view(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    data, starts, ends, first = letter_words(data, offsets)
    base = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3))
    if not len(starts) or len(np.unique(toxic)) < 2:
        net.scale, net.shift = 0.0, float(np.log(base / (1 - base)))
        return net
    distinct, lex = distinct_words(data, starts, ends)
    lone = _lone(distinct[lex.code], first)
    del data, starts, ends
    C.release_memory()
    doc, start, size = windows_of(first)
    has, net.vocabulary, net.grams = _telling_features(lex, distinct, first, lone, toxic)
    C.release_memory()
    lex = known_rows(distinct, lex, net)
    # first round: windows by the log-odds of their words
    odds = np.log((has[1] + 0.1) / (toxic.sum() + 0.2)) - np.log((has[0] + 0.1) / ((1 - toxic).sum() + 0.2))
    run = np.r_[0, np.cumsum(np.maximum(odds, 0)[lex.code] ** 2)]
    score = run[start + size] - run[start]
    moments: dict[str, list] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        order = np.lexsort((-score, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        top = order[rank < np.where(toxic[doc[order]] == 1, 1 if turn == 0 else 2, 3)]
        clean = np.flatnonzero(toxic[doc] == 0)
        chosen = np.unique(np.r_[top, rng.choice(clean, min(len(clean), 2 * len(toxic)))])
        y = toxic[doc[chosen]].astype(F32)
        weight = np.where(y == 1, max(1.0, 0.5 * (1 - y).sum() / max(y.sum(), 1)), 1.0).astype(F32)
        size_of = min(batch, max(32, len(chosen) // 8))
        for _ in range(max(passes, -(-40 * size_of // len(chosen)))):
            shuffled = rng.permutation(len(chosen))
            for a in range(0, len(chosen), size_of):
                b = shuffled[a : a + size_of]
                i = chosen[b]
                idx = window_index(lex, start[i], size[i], len(lex.bucket))
                used, local = np.unique(idx, return_inverse=True)  # only words of this batch
                real = used[used < len(lex.bucket)]
                width = np.diff(np.r_[lex.begin, len(lex.grams)])[real]
                small = Lexicon(lex.bucket[real], lex.grams[np.repeat(lex.begin[real] - np.cumsum(width) + width, width) + np.arange(width.sum())], np.cumsum(width) - width, lex.code)
                g = net.gradient(net.inputs(small), local.reshape(idx.shape), small, y[b], weight[b])
                step += 1
                for k, v in g.items():
                    m, s = moments[k]
                    m += 0.1 * (v - m)
                    s += 0.001 * (v * v - s)
                    net.p[k] -= (rate * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(F32)
        score = _logits(net, lex, net.inputs(lex), start, size)
    worst = np.full(n_texts, net.p["bias"][0], np.float64)
    np.maximum.at(worst, doc, score)
    net.scale, net.shift = _platt(worst, toxic)
    return net


def _lone(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True for texts that count as evidence: of texts that share their least five-word window (near copies
    mostly do) or, where they are shorter, all their words, the first."""
    seen, out = set(), np.zeros(len(first) - 1, bool)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        least = C.window_hashes(word[a:b], min(5, b - a)).min() if b > a else 0
        out[d] = least not in seen
        seen.add(least)
    return out


def _telling_features(lex: Lexicon, distinct: np.ndarray, first: np.ndarray, lone: np.ndarray, toxic: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(texts of each label with each distinct word, vocabulary, row of each four-gram).

    Vectors of their own only for words and four-grams that tell the labels apart by more than
    chance: the others share one, so that a small sample can't be learned by heart.
    """
    wide = len(lone) + 1
    word_doc = np.repeat(np.arange(len(lone)), np.diff(first))
    pairs = np.unique((lex.code * np.int64(wide) + word_doc)[lone[word_doc]])
    del word_doc
    has = [np.bincount(pairs // wide, toxic[pairs % wide] == k, len(lex.bucket)) for k in (0, 1)]
    telling = np.flatnonzero(_telling(*has, toxic[lone]))
    vocabulary = np.sort(distinct[telling[np.argsort(-has[1][telling], kind="stable")[: BUCKETS - 1]]])
    gram_word = np.repeat(np.arange(len(lex.begin)), np.diff(np.r_[lex.begin, len(lex.grams)]))
    of_word = np.unique(lex.grams * np.int64(len(lex.begin)) + gram_word)
    gram, word_of = of_word // len(lex.begin), of_word % len(lex.begin)
    order = np.argsort(word_of, kind="stable")
    gram, word_of = gram[order], word_of[order]
    counts = [np.zeros(GRAMS), np.zeros(GRAMS)]
    pairs = pairs[np.argsort(pairs % wide, kind="stable")]
    edges = np.searchsorted(pairs % wide, np.arange(0, len(lone) + 200, 200))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # 200 documents at a time, to bound memory
        pair_word, pair_doc = pairs[a:b] // wide, pairs[a:b] % wide
        lo, hi = np.searchsorted(word_of, pair_word), np.searchsorted(word_of, pair_word, side="right")
        grams = gram[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())]
        seen = np.unique(grams * wide + np.repeat(pair_doc, hi - lo))
        for k in (0, 1):
            counts[k] += np.bincount(seen // wide, toxic[seen % wide] == k, GRAMS)
    return has, vocabulary, np.where(_telling(*counts, toxic[lone]), np.arange(GRAMS), 0)


def _telling(clean: np.ndarray, toxic: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """True for features whose share of toxic documents is beyond chance among so many features.

    By the Chernoff bound, n documents with a share q of toxic ones where p is usual come up with
    a chance of at most exp(-n * KL(q || p)); SURE is asked for on top of the number of features.
    """
    n, p = clean + toxic, labels.mean()
    q = toxic / np.maximum(n, 1)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    bound = n * (q * (log(q) - log(p)) + (1 - q) * (log(1 - q) - log(1 - p)))
    return (q > p) & (bound >= np.log(max((n > 0).sum(), 1)) + SURE)


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps, lightly regularised towards scale 1."""
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if np.ptp(logit) < 1e-3:
        return 0.0, float(np.log(base / (1 - base)))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        g = np.array([((q - y) * logit).sum() + 0.1 * (a - 1), (q - y).sum() + 1e-3 * b])
        h = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        s = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - s[0], b - s[1]
    return float(max(a, 0.05)), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, chars: int) -> DataFrame:
    """At most `sample` labelled, not held-out documents of at most `chars` characters, by hash of id."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"text is not null and length(text) <= {chars}")
    return texts.join(F.broadcast(rows), "doc_id").orderBy(F.xxhash64("doc_id"), "text")  # at most `sample` rows are broadcast


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Network:
    """A network fitted to at most 2 * `sample` rows (a doc_id may come with several texts)."""
    rows = labelled_sample(docs, labels, "toxic", sample, chars).select("text", F.col("label").cast("long").alias("label")).limit(2 * sample).toArrow()
    net = train(rows["text"].combine_chunks(), rows["label"].to_numpy())
    del rows
    C.release_memory()  # the driver goes on
    return net


def score_texts(net: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, number of windows, first word of the worst window or -1) of each text."""
    n = len(column)
    score, count, worst = np.empty(n), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for lo, hi, data, offsets in C.text_blocks(column):
        logit = np.full(hi - lo, net.p["bias"][0], np.float64)
        data, starts, ends, first = letter_words(data, offsets)
        if len(starts):
            lex = lexicon(data, starts, ends, net)
            doc, start, size = windows_of(first)
            own = _logits(net, lex, net.inputs(lex), start, size)
            order = np.lexsort((start, -own, doc))
            head = order[np.r_[True, np.diff(doc[order]) > 0]]
            logit[doc[head]] = own[head]
            count[lo:hi] = np.bincount(doc, minlength=hi - lo)
            worst[lo + doc[head]] = (start - first[doc])[head]
        score[lo:hi] = 1 / (1 + np.exp(-np.clip(net.scale * logit + net.shift, -30, 30)))
    return score, count, worst


def with_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """docs with toxicity (0 to 1), toxicity_windows and toxicity_worst (first word of the worst window).

    Null and empty texts and texts without a letter have no window and the score of the network's
    bias; ties between windows go to the first; repeated rows are scored alike; columns of these
    three names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("toxicity", "toxicity_windows", "toxicity_worst")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            made = score_texts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, "toxicity", "toxicity_windows", "toxicity_worst"])

    return docs.mapInArrow(score, docs.schema.simpleString()[len("struct<") : -1] + ",toxicity:double,toxicity_windows:bigint,toxicity_worst:bigint")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = with_toxicity(docs, net)
    return out.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxicity_windows").alias("n_windows"), F.col("toxicity_worst").alias("worst_window"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored at the threshold or above go.

    Null and empty texts have the score of the network's bias, as texts without a letter have; very
    long ones are scored whole; repeated rows are judged alike; without labels of both kinds every
    text has the same score, the share of toxic ones; an empty table stays empty.
    """
    C.bounded_batches(spark)
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_toxicity(docs.select(*C.DOCUMENT_COLUMNS), net).where(F.col("toxicity") < THRESHOLD).select(*C.DOCUMENT_COLUMNS)
