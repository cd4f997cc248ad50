"""Language identification with a linear-chain conditional random field.

Words (runs of letters, lower-cased) are labelled with languages. A word's emission
score sums the weights of its features: a prefix and suffixes, the byte trigrams
inside it, and its entry in a lexicon of words seen often enough; transitions
between the labels of neighbouring words are learned. Forward-backward gives each
word's marginals; a document's language has the greatest sum of marginals, and its
score is the mean marginal of that language.

Training: a sample of labelled documents, bounded by ``docs_a_language`` in
expectation by a hash of the id, is saved; each of ``rounds`` Spark jobs computes
the gradient by partition, the driver adds the vectors and steps (Adam). Sequences
are runs of words from several documents, so that the data switch language.

Prediction reads whole texts as one chain each. A text of more than ``chain`` words is
worked on in pieces side by side: the product of each piece's transitions carries the
messages over its ends, so the marginals are those of the whole chain.

Defined results: null text, and text without a letter, is ``und`` with score 0, as is
every text if no row has a label; ties go to the first label in code-point order;
repeated rows are alike; very long texts are read whole; extra columns take no part,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.columns import text_of
from strideline.llm.hashing import Spans, blocks, buffer_of, runs
from strideline.sources.scratch import Scratch

#: Sizes of the hashed feature spaces.
LEXICON, AFFIX, TRIGRAM = 1 << 14, 1 << 13, 1 << 14
_SUFFIX3, _SUFFIX2 = LEXICON + AFFIX, LEXICON + 2 * AFFIX
_TRIGRAM = LEXICON + 3 * AFFIX
N_FEATURES = _TRIGRAM + TRIGRAM

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class Training:
    docs_a_language: int = 300
    rounds: int = 24
    rate: float = 0.15
    decay: float = 1e-5
    segment: int = 20
    segments: int = 8
    lexicon_least: int = 3
    chain: int = 1000


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # N_FEATURES x labels
    moves: np.ndarray  # labels x labels, from row to column
    lexicon: np.ndarray  # bool by lexicon bucket


class Words:
    """Words of a block of texts with their feature numbers."""

    def __init__(self, texts: list[str], lexicon: np.ndarray | None):
        data, first = buffer_of([t.lower() for t in texts], lower=True)
        start, end = runs(_LETTER[data])
        self.first = np.searchsorted(start, first)
        self.n = len(start)
        spans = Spans(data)
        mod = lambda h, n, base: base + (h & np.uint64(n - 1)).astype(np.int64)
        self.entry = mod(spans.hash(start, end), LEXICON, 0)
        self.one = np.stack(
            [
                self.entry if lexicon is None else np.where(lexicon[self.entry], self.entry, -1),
                mod(spans.hash(start, np.minimum(start + 3, end)), AFFIX, LEXICON),
                mod(spans.hash(np.maximum(start, end - 3), end), AFFIX, _SUFFIX3),
                mod(spans.hash(np.maximum(start, end - 2), end), AFFIX, _SUFFIX2),
            ],
            axis=1,
        )
        n_tri = np.maximum(end - start - 2, 0)
        self.tri_word = np.repeat(np.arange(self.n), n_tri)
        at = np.arange(len(self.tri_word)) - np.repeat(np.cumsum(n_tri) - n_tri, n_tri) + np.repeat(start, n_tri)
        code = (data[at].astype(np.uint32) << 16 | data[at + 1].astype(np.uint32) << 8 | data[at + 2]) * np.uint32(0x9E3779B1)
        self.tri = _TRIGRAM + (code >> np.uint32(32 - 14)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        padded = np.vstack([weights, np.zeros((1, weights.shape[1]))])  # row -1: no feature
        out = padded[self.one].sum(axis=1)
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(self.tri_word, weights[self.tri, k], minlength=self.n)
        return out

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        out = np.zeros((N_FEATURES + 1, residual.shape[1]))
        for k in range(residual.shape[1]):
            r = residual[:, k]
            out[:, k] = np.bincount(self.one.ravel() + 1, np.repeat(r, self.one.shape[1]), minlength=N_FEATURES + 1)
            out[:, k] += np.bincount(self.tri + 1, r[self.tri_word], minlength=N_FEATURES + 1)
        return out[1:]


def messages(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray):
    """What enters each piece at its first word and comes back to its last one from the rest of its text.

    Pieces of a text follow each other; ``first`` marks the first of each. Products of
    transitions and scores over a piece are taken for all pieces together, then carried
    from piece to piece.
    """
    k = moves.shape[0]
    enter, after = np.ones((len(start), k)), np.ones((len(start), k))
    joined = np.flatnonzero(~first | ~np.append(first[1:], True))  # pieces of texts that have several
    if not len(joined):
        return enter, after
    step = np.exp(moves - moves.max())
    begin, size = start[joined], length[joined]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    product = np.where(first[joined][:, None, None], np.eye(k), step) * emit[begin][:, None, :]
    for t in range(1, size.max()):
        on = np.flatnonzero(size > t)
        p = (product[on] @ step) * emit[begin[on] + t][:, None, :]
        product[on] = p / p.sum(axis=(1, 2), keepdims=True)
    ahead = np.ones(k)
    for i, p in zip(joined, product, strict=True):
        if first[i]:
            ahead = np.ones(k)
        else:
            enter[i] = ahead @ step
        ahead = ahead @ p
        ahead = ahead / ahead.sum()
    behind = np.ones(k)
    for i, p in zip(joined[::-1], product[::-1], strict=True):
        after[i] = behind
        behind = np.ones(k) if first[i] else p @ behind
        behind = behind / behind.sum()
    return enter, after


def forward_backward(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, length: np.ndarray, ends=None):
    """Marginals of every word, and the expected number of moves between labels.

    Chains are ``length`` words from ``start``; all advance together, longest first.
    ``ends``: messages into the first and back to the last word of every chain.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    enter, after = (np.ones((len(start), scores.shape[1])),) * 2 if ends is None else (x[order] for x in ends)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(moves - moves.max())
    ahead, behind = np.ones_like(emit), np.ones_like(emit)
    if len(start):
        behind[start + length - 1] = after
    alive = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")
    for t, n in enumerate(alive):
        at = start[:n] + t
        a = emit[at] * enter[:n] if t == 0 else (ahead[at - 1] @ step) * emit[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros_like(moves)
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        b = emit[at + 1] * behind[at + 1]
        back = b @ step.T
        pair = ahead[at][:, :, None] * step * b[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        behind[at] = back / back.sum(axis=1, keepdims=True)
    m = ahead * behind
    return m / m.sum(axis=1, keepdims=True) if len(m) else m, expected


def _sequences(first: np.ndarray, y: np.ndarray, cfg: Training):
    """A new order of the words: segments of documents, shuffled and chained."""
    pieces = [
        np.arange(a, min(a + cfg.segment, hi)) for lo, hi in zip(first[:-1], first[1:], strict=True) for a in range(lo, hi, cfg.segment)
    ]
    picks = np.random.Generator(np.random.PCG64(7)).permutation(len(pieces))
    order = np.concatenate([pieces[i] for i in picks]) if pieces else np.zeros(0, np.int64)
    size = np.array([sum(len(pieces[i]) for i in picks[k : k + cfg.segments]) for k in range(0, len(picks), cfg.segments)], np.int64)
    return order, np.cumsum(size) - size, size


def _gradient_job(sample: DataFrame, labels: list[str], cfg: Training, model: Model) -> np.ndarray:
    """Sum over the sample of the gradient of the log-likelihood: weights, then moves."""
    sent = sample.sparkSession.sparkContext.broadcast(model)
    number = {x: i for i, x in enumerate(labels)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        total = np.zeros((N_FEATURES + len(labels), len(labels)))
        words = 0
        for pdf in batches:
            at = 0
            for block in blocks(list(pdf["text"])):
                w = Words(block, m.lexicon)
                lang = np.array([number[x] for x in pdf["lang"].iloc[at : at + len(block)]], np.int64)
                at += len(block)
                if not w.n:
                    continue
                y = np.repeat(lang, np.diff(w.first))
                order, start, size = _sequences(w.first, y, cfg)
                marginal, expected = forward_backward(w.scores(m.weights)[order], m.moves, start, size)
                seen = np.eye(len(labels))[y[order]]
                residual = np.empty_like(marginal)
                residual[order] = seen - marginal
                total[:N_FEATURES] += w.gradient(residual)
                inside = np.ones(len(order), bool)
                inside[start] = False
                pairs = np.zeros_like(expected)
                np.add.at(pairs, (y[order][:-1][inside[1:]], y[order][1:][inside[1:]]), 1)
                total[N_FEATURES:] += pairs - expected
                words += len(order)
        yield pd.DataFrame({"words": [words], "g": [total.astype(np.float32).tobytes()]})

    rows = sample.mapInPandas(work, "words bigint, g binary").collect()  # one bounded vector a partition of the sample
    sent.destroy()
    n = max(1, sum(r["words"] for r in rows))
    return sum(np.frombuffer(r["g"], np.float32).astype(float) for r in rows).reshape(-1, len(labels)) / n


def _lexicon(sample: DataFrame, least: int) -> np.ndarray:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(LEXICON, np.int64)
        for pdf in batches:
            for block in blocks(list(pdf["text"])):
                seen += np.bincount(Words(block, None).entry, minlength=LEXICON)
        yield pd.DataFrame({"n": [seen.tobytes()]})

    rows = sample.select("text").mapInPandas(work, "n binary").collect()
    return sum((np.frombuffer(r["n"], np.int64) for r in rows), np.zeros(LEXICON, np.int64)) >= least


def fit(docs: DataFrame, cfg: Training = Training(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model learned from the rows of ``docs`` with a language; None if there are none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    labelled = docs.select(F.col(key).alias("key"), text_of(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull()
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    labels = sorted(counts)
    ticket = F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000))
    share = F.element_at(
        F.create_map(*[F.lit(x) for k in labels for x in (k, min(1_000_000, 1 + 1_000_000 * cfg.docs_a_language // counts[k]))]), F.col("lang")
    )
    sample = scratch.save(labelled.filter(ticket < share).repartition(6, "key").sortWithinPartitions("key", "text"), "sample")
    k = len(labels)
    model = Model(labels, np.zeros((N_FEATURES, k)), np.zeros((k, k)), _lexicon(sample, cfg.lexicon_least))
    first = second = np.zeros((N_FEATURES + k, k))
    for step in range(1, cfg.rounds + 1):
        all_weights = np.vstack([model.weights, model.moves])
        g = _gradient_job(sample, labels, cfg, model) - cfg.decay * all_weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        all_weights = all_weights + cfg.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model = Model(labels, all_weights[:N_FEATURES], all_weights[N_FEATURES:], model.lexicon)
    scratch.drop("sample")
    return model


def label_texts(texts: list[str], model: Model, chain: int) -> tuple[list[str], list[float]]:
    """Language and score of every text."""
    labels, scores = [], []
    for block in blocks(texts):
        w = Words(block, model.lexicon)
        cuts = [np.arange(lo, hi, chain) for lo, hi in zip(w.first[:-1], w.first[1:], strict=True)]
        start = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
        end = np.minimum(start + chain, np.repeat(w.first[1:], [len(c) for c in cuts]))
        emissions = w.scores(model.weights)
        first = np.concatenate([np.arange(len(c)) == 0 for c in cuts]) if cuts else np.zeros(0, bool)
        ends = messages(emissions, model.moves, start, end - start, first)
        marginal, _ = forward_backward(emissions, model.moves, start, end - start, ends)
        n = np.diff(w.first)
        of = np.repeat(np.arange(len(block)), n)
        sums = np.stack([np.bincount(of, marginal[:, k], minlength=len(block)) for k in range(len(model.labels))], axis=1)
        for t, row, words in zip(block, sums, n, strict=True):
            if not words or not any(c.isalpha() for c in t):
                labels.append("und")
                scores.append(0.0)
            else:
                best = int(row.argmax())
                labels.append(model.labels[best])
                scores.append(float(min(1.0, row[best] / words)))
    return labels, scores


def predict(docs: DataFrame, model: Model | None, keep: dict[str, Column], text: str = "text", chain: int = Training.chain) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], text_of(text).alias("__text"))
    if model is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            labels, scores = label_texts(list(texts), sent.value, chain)
            yield pd.DataFrame({"lang_pred": labels, "score": scores})

    return rows.withColumn("__out", work("__text")).select(*keep, "__out.lang_pred", "__out.score")
