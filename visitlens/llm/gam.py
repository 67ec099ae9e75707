"""Text quality by a generalised additive model with pairwise interactions.

A score is the logistic of an intercept plus one table entry per feature and per chosen pair of features. The
tables grow by cyclic boosting: round after round, each feature in turn gets a shallow tree fitted to the
current gradient over its bins, scaled down and added to its table; pairs follow on what the single features
leave. Scoring looks bins up and adds table entries for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.shared import stage, total, word_hashes

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id.
SAMPLE = 60_000
#: Score from which a text counts as good.
GOOD = 0.7
BINS, PAIR_BINS, PAIRS = 48, 16, 12
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.15, 20.0

FEATURES = [
    "log_bytes", "log_words", "bytes_a_word", "words_a_line", "capitals", "digits", "commas_and_stops", "symbols", "bars",
    "high_bytes", "blanks", "word_repeats", "distinct_words", "top_word", "line_repeats", "symbol_words", "longest_run",
]

# Classes of bytes: 0 letters and all of a character above ASCII, 1 capitals, 2 digits, 3 usual punctuation, 4 blanks, 5 other symbols.
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = 5
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 3
_CLASS[[32, *range(9, 14)]] = 4


def features(text: str) -> list[float]:
    """Shape of a whole text; the empty text has zeros."""
    data = text.encode()
    n = len(data)
    words = word_hashes(text)
    m = len(words)
    if not m:
        return [np.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=6) / n
    _, counts = np.unique(words, return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    runs = np.diff(np.concatenate([[-1], np.flatnonzero(words[1:] != words[:-1]), [m - 1]]))
    spaced = np.concatenate([[True], _CLASS[raw] == 4])
    begins = np.flatnonzero(spaced[:-1] & ~spaced[1:])
    marked = np.add.reduceat(_CLASS[raw] == 5, begins) > 0
    return [
        np.log1p(n), np.log1p(m), n / m, np.log1p(m / len(lines)), kinds[1], kinds[2], kinds[3], kinds[5], data.count(b"|") / n,
        float((raw >= 128).mean()), kinds[4], 1 - len(runs) / m, len(counts) / m, counts.max() / m,
        1 - len(set(lines)) / len(lines), float(marked.mean()), float(runs.max()),
    ]


def feature_table(texts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Intercept, bin edges and tables; a few thousand numbers whatever the corpus."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 if none helps."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * leaf(gl, hl) + gr * leaf(gr, hr) - g.sum() * leaf(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree of ``depth`` levels over one feature's bins."""
    _, cut = best_split(g, h) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), leaf(g.sum(), h.sum()))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one feature of a pair, then the other on each side."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, cut = best_split(a.sum(1), b.sum(1))
        if not cut:
            continue
        own, gain = np.empty_like(a), -a.sum() * leaf(a.sum(), b.sum())
        for part in (slice(None, cut), slice(cut, None)):
            tree = shallow_tree(a[part].sum(0), b[part].sum(0), 1)
            own[part] = tree
            gain += float((tree * a[part].sum(0)).sum())
        if gain > best:
            best, values = gain, own.T if turned else own
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables on a bounded sample. Without rows of both labels the model is their smoothed share."""
    model = Model(intercept=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 0.01))))
    if not 0 < y.sum() < len(y):
        return model
    n, k = x.shape
    model.edges = [edges_of(x[:, j], BINS) for j in range(k)]
    model.pair_edges = [edges_of(x[:, j], PAIR_BINS) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            total += step[bins[j]]

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        return pair_tree(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))

    gains = {(a, b): grid(a, b)[0] for a in range(k) for b in range(a)}
    for a, b in sorted(gains, key=gains.get, reverse=True)[:PAIRS]:
        model.pairs[a, b] = np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            step = RATE * grid(a, b)[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = feature_table(batch.column(2))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(table.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["doc_id", "held_out", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, features array<double>")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on at most ``sample`` labelled rows that are not held out, those with the smallest hashes of doc_id.

    A bound on the hash picks the labels first, a tenth more than are wanted, so features are worked out for their
    documents alone; the list that is broadcast is as short as the sample.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = stage(known.filter(~held_out()), "labels")
    share = 1.1 * (sample + 100) / max(1, total(known))
    if share < 1:
        known = known.filter(F.xxhash64("doc_id") < F.lit(int(share * (1 << 64)) - (1 << 63)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    rows = with_features(chosen).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found: pd.DataFrame = rows.select("features", "quality").toPandas()
    x = np.array(found["features"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    return fit(x, found["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, score and predicted.

    ``labels`` has doc_id and quality 0 or 1; null ones are ignored, of repeated ones the larger counts. A null
    text scores like the empty one; a null doc_id is scored and never trains. Other columns of ``docs`` are never
    looked at. An empty table gives none.
    """
    model = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(feature_table(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= GOOD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns; no text is shuffled."""
    model = trained(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(feature_table(batch.column(at))) >= GOOD))

    # Any name of a column will do, also one with a dot.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
