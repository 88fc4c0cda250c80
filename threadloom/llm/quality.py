"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few numbers (lengths, shares of kinds of bytes, repetition, words of a learnt
lexicon).  The model is a lookup table for the bins of each feature, and one for the bins of each
chosen pair of features.  They are learnt by boosting: in each round the features take turns, and a
shallow tree on the feature's bins, fitted to the residuals of the logistic loss, is added to its
table; the strongest pairs are boosted afterwards in the same way.  Scoring adds up table entries of
whole batches.  The target is quality 1 and toxic 0.

Training uses at most `SAMPLE` labelled documents, the least by a seeded hash of doc_id (of several rows
of a doc_id the least text); everything else reads every document.  Words in `MIN_DOCS` sampled documents
or more, most of them toxic, make up the lexicon.  As the lexicon comes from the labels, a document to
train on is measured with the lexicon of the other two of three folds, so that the model learns what a
listed word is worth in a document that it wasn't listed for; texts to score meet the lexicon of all.

Defined results: a null text and a text without a word are rejected; several labels of a document
count as their worst; null labels are ignored; without labels of both kinds every text with a word
is accepted with score 1; the score of equal texts is equal; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.llm import textkernel as tk
from threadloom.llm.common import cut, pick, small_or_hashed

SAMPLE, MIN_DOCS, SEED, FOLDS = 20_000, 4, 7, 3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
THRESHOLD = 0.5
FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "bang", "bar", "symbol", "stop", "other_punct", "distinct", "echo", "top_word", "lexicon", "lexicon_share")
_KIND = np.full(256, 10, np.uint8)
_KIND[97:123] = _KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
for _chars, _kind in ((" \t\r", 3), ("\n", 4), ("!", 5), ("|", 6), ("#$%&*@^~=+<>{}[]\\", 7), (".,;:?", 8)):
    for _c in _chars:
        _KIND[ord(_c)] = _kind


def features(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """n x len(FEATURES); rows without a word are NaN. `lexicon`: sorted word hashes."""
    out = np.full((len(texts), len(FEATURES)), np.nan)
    for lo, hi in tk.slices(texts):
        data, offsets = tk.raw(texts.slice(lo, hi - lo))
        row, h, start, end = tk.words(data, offsets)
        if not row.size:
            continue
        n = hi - lo
        size = np.diff(offsets).astype(float)
        full = np.flatnonzero(size > 0)
        kind = _KIND[data]
        by_kind = np.zeros((n, 11))
        for k in range(1, 11):
            if (is_kind := kind == k).any():
                by_kind[full, k] = np.add.reduceat(is_kind, offsets[full], dtype=np.int64)
        words = np.bincount(row, minlength=n).astype(float)
        some = np.maximum(words, 1)
        size = np.maximum(size, 1)
        echo = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=n)
        listed = np.zeros(row.size, bool)
        if lexicon.size:
            listed = lexicon[np.minimum(np.searchsorted(lexicon, h), lexicon.size - 1)] == h
        bad = np.bincount(row[listed], minlength=n)
        order = np.lexsort((h, row))
        r, s = row[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])]))
        times = np.diff(np.concatenate([first, [r.size]]))
        top = np.zeros(n)
        np.maximum.at(top, r[first], times)
        cols = [np.log(size), np.log(some), np.bincount(row, end - start, n) / some]
        cols += [by_kind[:, k] / size for k in (1, 2, 3, 4, 5, 6, 7, 8)] + [by_kind[:, 10] / size]
        cols += [np.bincount(r[first], minlength=n) / some, echo / some, top / some, np.minimum(bad, 20), bad / some]
        got = np.stack(cols, 1)
        got[words == 0] = np.nan
        out[lo:hi] = got
    return out


def _tree(grad: np.ndarray, hess: np.ndarray, rate: float) -> np.ndarray:
    """Steps for the bins of one feature: the best tree of at most three leaves (two cuts)."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    n, ridge = grad.size, 1.0

    def gain(gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
        return gs * gs / (hs + ridge)

    a, b = np.arange(n)[:, None], np.arange(n)[None, :]
    whole = gain(g[a], h[a]) + gain(g[b] - g[a], h[b] - h[a]) + gain(g[-1] - g[b], h[-1] - h[b])
    whole[b < a] = -1
    i, j = np.unravel_index(int(whole.argmax()), whole.shape)
    out = np.empty(n)
    for lo, hi in ((0, i + 1), (i + 1, j + 1), (j + 1, n)):
        out[lo:hi] = rate * grad[lo:hi].sum() / (hess[lo:hi].sum() + ridge)
    return out


def _square(grad: np.ndarray, hess: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """Steps for the bins of a pair: one cut of each feature, four leaves; and the gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    corners = []
    for m in (g, h):
        corners.append((m, m[-1:, :] - m, m[:, -1:] - m, m[-1, -1] - m[-1:, :] - m[:, -1:] + m))
    gain = sum(x * x / (y + 1.0) for x, y in zip(*corners, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(grad)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = rate * grad[rows, cols].sum() / (hess[rows, cols].sum() + 1.0)
    return out, float(gain.max())


@dataclass
class AdditiveModel:
    """Lookup tables: `tables[f][bin]`, `pair_tables[p][coarse bin, coarse bin]`."""

    lexicon: np.ndarray
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    constant: bool = False

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, lexicon: np.ndarray) -> AdditiveModel:
        """x: features without NaN, y: 0 or 1."""
        if not len(y) or y.min() == y.max():
            return cls(lexicon, constant=True)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        share = y.mean()
        model = cls(lexicon, float(np.log(share / (1 - share))), edges, [np.zeros(e.size + 1) for e in edges])
        bins = model.bins(x)
        score = np.full(len(y), model.base)
        for _ in range(ROUNDS):
            for f, table in enumerate(model.tables):
                p = 1 / (1 + np.exp(-score))
                step = _tree(np.bincount(bins[f], y - p, table.size), np.bincount(bins[f], p * (1 - p), table.size), RATE)
                table += step
                score += step[bins[f]]
        coarse = model.coarse(bins)
        p = 1 / (1 + np.exp(-score))
        ranked = []
        for a in range(len(edges)):
            for b in range(a + 1, len(edges)):
                cell = coarse[a] * PAIR_BINS + coarse[b]
                g, h = (np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, -1) for w in (y - p, p * (1 - p)))
                ranked.append((-_square(g, h, RATE)[1], a, b))
        model.pairs = [(a, b) for _, a, b in sorted(ranked)[:PAIRS]]
        model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-score))
                cell = coarse[a] * PAIR_BINS + coarse[b]
                g, h = (np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, -1) for w in (y - p, p * (1 - p)))
                step, _ = _square(g, h, RATE)
                table += step
                score += step.reshape(-1)[cell]
        return model

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)]

    def coarse(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        return [b * PAIR_BINS // (e.size + 1) for b, e in zip(bins, self.edges, strict=True)]

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of being accepted; NaN for rows without a word."""
        x = features(texts, self.lexicon)
        out = np.full(len(x), np.nan)
        some = ~np.isnan(x[:, 0])
        if self.constant:
            out[some] = 1.0
        elif some.any():
            bins = self.bins(x[some])
            total = np.full(int(some.sum()), self.base)
            for b, table in zip(bins, self.tables, strict=True):
                total += table[b]
            coarse = self.coarse(bins)
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
            out[some] = 1 / (1 + np.exp(-total))
        return out


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, good, toxic, fold) of the sampled labelled documents."""
    labels = pick(labels, "doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = pick(docs, "doc_id", "text").filter("text is not null")
    some = small_or_hashed(cut(labels.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(size)), 32)
    good = (F.col("quality") > 0) & (F.col("toxic") <= 0)
    rows = texts.join(some, "doc_id").select("doc_id", "text", good.cast("int").alias("good"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    return rows.groupBy("doc_id", "good", "toxic").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int"))


def lexicons(words: np.ndarray, documents: np.ndarray, toxic: np.ndarray, least: int = MIN_DOCS) -> list[np.ndarray]:
    """Sorted listed words without each fold in turn, and of all; rows are words, columns counts by fold."""
    out = []
    for left in [*range(documents.shape[1]), None]:
        others = [f for f in range(documents.shape[1]) if f != left]
        n, t = documents[:, others].sum(1), toxic[:, others].sum(1)
        out.append(np.sort(words[(n >= least) & (t >= 0.7 * n)]))
    return out


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> AdditiveModel:
    """Fits the model on at most `size` labelled documents."""
    sample = cut(_sample(docs, labels, size))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h = tk.distinct(*tk.words(*tk.raw(b.column(0)))[:2])
            columns = [pa.array(b.column(i).to_numpy()[row].astype(np.int32)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *columns], ["word", "toxic", "fold"])

    words = sample.select("text", "toxic", "fold").mapInArrow(vocabulary, "word long, toxic int, fold int")
    counts = [f(F.when(F.col("fold") == k, x)).alias(f"{c}{k}") for k in range(FOLDS) for c, f, x in (("n", F.count, F.lit(1)), ("t", F.sum, F.col("toxic")))]
    # a word that no fold's lexicon can have stays where it is
    counted = words.groupBy("word").agg(*counts, F.count("*").alias("n"), F.sum("toxic").alias("t")).filter((F.col("n") >= MIN_DOCS) & (F.col("t") >= 0.7 * MIN_DOCS)).toPandas().fillna(0)
    by_fold = [counted[[f"{c}{k}" for k in range(FOLDS)]].to_numpy(np.int64) for c in "nt"]
    *without, lexicon = lexicons(counted["word"].to_numpy(np.int64).view(np.uint64), *by_fold)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(3).to_numpy()
            for k in np.unique(fold):
                mine = pa.array(fold == k)
                x = features(b.column(1).filter(mine), without[k])
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mine), pa.array(list(x), pa.list_(pa.float64())), b.column(2).filter(mine)], ["doc_id", "x", "good"])

    rows = sample.select("doc_id", "text", "good", "fold").mapInArrow(measured, "doc_id long, x array<double>, good int").orderBy("doc_id", "x").toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, len(FEATURES)))
    some = ~np.isnan(x[:, 0])
    return AdditiveModel.fit(x[some], rows["good"].to_numpy(float)[some], lexicon)


def scores(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score) of the accepted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1))
            keep = pa.array(np.nan_to_num(s, nan=-1.0) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(s).filter(keep)], ["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The accepted rows of `docs`, all columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.nan_to_num(model.score(b.column(text)), nan=-1.0) >= threshold))

    to_arrow_schema(plain.schema)  # a type that Arrow lacks fails here, not in a task
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
