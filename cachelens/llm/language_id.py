"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters, ASCII lower-cased) has affix, character n-gram and lexicon features;
transitions between the languages of neighbouring words are learned with them.  Forward-backward
gives the posterior of each word's language, so code-switched texts are labelled word by word; a
document's language has the largest mean posterior.

Training (numpy, on the driver) reads at most `sample` labelled documents of at most `chars`
characters, by hash of id, and fits the chain on sequences spliced from short runs of words of
several documents, which is where transitions are learned from.

Scoring is one pass without a shuffle.  Chains are cut into segments whose transfer matrices are
multiplied for all segments at once; boundary messages then run over segments, not words, so a very
long text costs no more per word than a short one and results are those of the whole chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import common as C
from cachelens.llm.toxicity import letter_words, word_rows

SAMPLE, SAMPLE_CHARS, LEXICON, GRAMS, AFFIXES, SEGMENT = 2000, 20_000, 8192, 1 << 14, 1 << 13, 32
F32 = np.float32


@dataclass
class Features:
    """Features of the distinct words of a block, and the distinct word of each word."""

    lexicon: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    code: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray) -> Features:
    distinct, where, code = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[where], ends[where]
    size = b - a
    begin = np.cumsum(size) - size
    at = np.repeat(a - begin, size) + np.arange(size.sum())
    head, tail = np.zeros(len(at), bool), np.zeros(len(at), bool)
    head[begin], tail[begin + size - 1] = True, True
    last = len(data) - 1
    byte = lambda i, ok: np.where(ok, data[np.clip(i, 0, last)], 0).astype(np.uint32)
    pack = lambda x, y, z, shift: ((x << np.uint32(16) | y << np.uint32(8) | z) * np.uint32(0x9E3779B1) >> np.uint32(shift)).astype(np.int64)
    grams = pack(byte(at - 1, ~head), byte(at, True), byte(at + 1, ~tail), 18)
    prefix = pack(byte(a, True), byte(a + 1, size > 1), byte(a + 2, size > 2), 19)
    suffix = pack(byte(b - 3, size > 2), byte(b - 2, size > 1), byte(b - 1, True), 19)
    return Features(word_rows(distinct, vocabulary), grams, begin, prefix, suffix, code)


@dataclass
class Chain:
    languages: list[str]
    vocabulary: np.ndarray
    weights: dict[str, np.ndarray]  # lexicon, grams, prefix, suffix: (rows, languages)
    transition: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        w = self.weights
        out = w["lexicon"][f.lexicon] + w["prefix"][f.prefix] + w["suffix"][f.suffix]
        return out + np.add.reduceat(w["grams"][f.grams], f.begin) if len(f.begin) else out


def posteriors(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior of each word's label; chains are emission[first[d]:first[d + 1]]."""
    total, k = emission.shape
    e = np.exp(emission - emission.max(1, keepdims=True)).astype(np.float64)
    t = np.exp(transition - transition.max()).astype(np.float64)
    n = np.diff(first)
    per = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[doc] + nth * SEGMENT
    size = np.minimum(n[doc] - nth * SEGMENT, SEGMENT)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    matrix = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
    live = [np.flatnonzero(size > s) for s in range(SEGMENT)]
    for s in range(SEGMENT):
        i = live[s]
        m = (matrix[i] @ t) * e[begin[i] + s][:, None, :]
        matrix[i] = m / m.max((1, 2), keepdims=True)
    # messages between segments: one step for each segment of the longest chain
    into, outof = np.full((len(doc), k), 1 / k), np.ones((len(doc), k))
    order = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order], np.arange(nth.max(initial=-1) + 2))
    for s in range(1, len(cuts) - 1):
        i = order[cuts[s] : cuts[s + 1]]
        into[i] = norm(np.einsum("ni,nij->nj", into[i - 1], matrix[i - 1]))
    for s in range(len(cuts) - 2, 0, -1):
        i = order[cuts[s] : cuts[s + 1]]
        outof[i - 1] = norm(np.einsum("nij,nj->ni", matrix[i], outof[i]))
    forward, a = np.empty((total, k)), into
    for s in range(SEGMENT):
        i = live[s]
        x = norm((a[i] @ t) * e[begin[i] + s])
        forward[begin[i] + s] = x
        a[i] = x
    b = outof
    for s in range(SEGMENT - 1, -1, -1):
        i = live[s]
        at = begin[i] + s
        forward[at] *= b[i]
        b[i] = norm((e[at] * b[i]) @ t.T)
    return norm(forward)


def train(texts: list[str], langs: list[str], epochs: int = 6, sequences: int = 3000, rate: float = 0.1, seed: int = 11) -> Chain:
    """A chain fitted to documents of one labelled language each."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    k = len(languages)
    data, offsets = C.utf8_view(pa.array(texts, pa.string()))
    data, starts, ends, first = letter_words(data, offsets)
    words, count = np.unique(C.span_hashes(data, starts, ends), return_counts=True)
    # the lexicon: words found three times or more, the most frequent ones
    top = np.argsort(-count, kind="stable")[:LEXICON]
    vocabulary = np.sort(words[top[count[top] >= 3]])
    zero = lambda n: np.zeros((n, k), F32)
    chain = Chain(languages, vocabulary, {"lexicon": zero(len(vocabulary) + 1), "grams": zero(GRAMS), "prefix": zero(AFFIXES), "suffix": zero(AFFIXES)}, np.zeros((k, k), F32))
    full = np.flatnonzero(np.diff(first) > 0)
    if k < 2 or not len(full):
        return chain
    f = features(data, starts, ends, vocabulary)
    label = np.searchsorted(languages, np.array(langs, object)[full].astype(str))
    by = [full[label == c] for c in range(k)]
    by = [(c, d) for c, d in enumerate(by) if len(d)]
    words_of, labels_of, bounds = [], [], [0]
    for _ in range(sequences):
        seq, lab = [], []
        for _ in range(rng.integers(2, 5)):
            c, docs = by[rng.integers(len(by))]
            d = docs[rng.integers(len(docs))]
            size = min(int(rng.integers(6, 25)), int(first[d + 1] - first[d]))
            a = int(rng.integers(first[d], first[d + 1] - size + 1))
            seq.append(np.arange(a, a + size))
            lab.append(np.full(size, c))
        words_of.append(np.concatenate(seq))
        labels_of.append(np.concatenate(lab))
        bounds.append(bounds[-1] + len(words_of[-1]))
    word, y, bounds = np.concatenate(words_of), np.concatenate(labels_of), np.array(bounds)
    width = np.diff(np.r_[f.begin, len(f.grams)])
    square = {n: np.full_like(w, 1e-6) for n, w in chain.weights.items()} | {"transition": np.full((k, k), 1e-6, F32)}
    batch = max(1, sequences // 15)
    for _ in range(epochs):
        for s in range(0, sequences, batch):
            lo, hi = bounds[s], bounds[min(s + batch, sequences)]
            own, inner = np.unique(f.code[word[lo:hi]], return_inverse=True)
            sub = Features(f.lexicon[own], f.grams[np.repeat(f.begin[own] - np.cumsum(width[own]) + width[own], width[own]) + np.arange(width[own].sum())], np.cumsum(width[own]) - width[own], f.prefix[own], f.suffix[own], inner)
            em = chain.emissions(sub)[inner]
            cut = bounds[s : min(s + batch, sequences) + 1] - lo
            post = posteriors(em, chain.transition, cut)
            gap = post.copy()
            gap[np.arange(hi - lo), y[lo:hi]] -= 1
            per_word = np.zeros((len(own), k))
            np.add.at(per_word, inner, gap / (hi - lo))
            grad = {n: np.zeros_like(w) for n, w in chain.weights.items()}
            np.add.at(grad["lexicon"], sub.lexicon, per_word)
            np.add.at(grad["prefix"], sub.prefix, per_word)
            np.add.at(grad["suffix"], sub.suffix, per_word)
            np.add.at(grad["grams"], sub.grams, np.repeat(per_word, width[own], axis=0))
            grad["transition"] = _pair_gap(em, chain.transition, post, cut, y[lo:hi]) / (hi - lo)
            for n, g in grad.items():
                w = chain.transition if n == "transition" else chain.weights[n]
                g = g + 1e-6 * w
                square[n] += g * g
                w -= (rate * g / np.sqrt(square[n])).astype(F32)
    return chain


def _pair_gap(em: np.ndarray, transition: np.ndarray, post: np.ndarray, cut: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Expected less observed counts of neighbouring labels.

    The pair posterior of t, t + 1 is taken from the two word posteriors and the local potential,
    scaled to both margins, which is exact for a chain once the margins agree.
    """
    inside = np.ones(len(y) - 1, bool)
    inside[cut[1:-1] - 1] = False
    i = np.flatnonzero(inside)
    pair = np.exp(transition)[None] * np.ones((len(i), 1, 1))
    left, right = post[i] + 1e-12, post[i + 1] + 1e-12
    for _ in range(8):
        pair *= (left / pair.sum(2))[:, :, None]
        pair *= (right / pair.sum(1))[:, None, :]
    out = pair.sum(0)
    np.subtract.at(out, (y[i], y[i + 1]), 1)
    return out


def label_texts(chain: Chain, column: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """(language or None, mean posterior, words, changes of language between words) of each text."""
    n, k = len(column), len(chain.languages)
    lang: list[str | None] = [None] * n
    score, count, switches = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lo, hi, data, offsets in C.text_blocks(column):
        data, starts, ends, first = letter_words(data, offsets)
        size = np.diff(first)
        count[lo:hi] = size
        if not len(starts) or not k:
            continue
        f = features(data, starts, ends, chain.vocabulary)
        post = posteriors(chain.emissions(f)[f.code], chain.transition, first)
        full = np.flatnonzero(size > 0)
        mean = np.add.reduceat(post, first[full]) / size[full, None]
        best = mean.argmax(1)
        score[lo + full] = mean[np.arange(len(full)), best]
        for d, c in zip((lo + full).tolist(), best.tolist(), strict=True):
            lang[d] = chain.languages[c]
        word = post.argmax(1)
        change = np.r_[False, word[1:] != word[:-1]]
        change[first[full]] = False
        switches[lo + full] = np.add.reduceat(change, first[full])
    return lang, np.clip(score, 0, 1), count, switches


def with_language(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with lang_pred, lang_score, n_letter_words and n_switches (such columns are replaced).

    Null and empty texts and texts without a letter are `und` with score 0, as are all texts if
    nothing was learned; ties go to the first language by name; repeated rows are labelled alike;
    an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "lang_score", "n_letter_words", "n_switches")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            made = label_texts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made[0], pa.string()), *map(pa.array, made[1:])], names=[*batch.schema.names, "lang_pred", "lang_score", "n_letter_words", "n_switches"])

    out = docs.mapInArrow(label, docs.schema.simpleString()[len("struct<") : -1] + ",lang_pred:string,lang_score:double,n_letter_words:bigint,n_switches:bigint")
    known = F.col("lang_pred").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_score": F.when(known, F.col("lang_score")).otherwise(0.0), "lang_pred": F.when(known, F.col("lang_pred")).otherwise("und")})


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Chain:
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where(f"text is not null and lang is not null and length(text) <= {chars}").join(F.broadcast(ids), "doc_id", "left_semi")  # at most `sample` ids
    rows = rows.select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "text", "lang").limit(2 * sample).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    out = with_language(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "n_letter_words", "n_switches")
