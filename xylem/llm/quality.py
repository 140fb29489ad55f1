"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees over one binned feature at a time are boosted in turn (cyclically), so each feature ends as one
lookup table; the strongest pairs get two-way tables in a second pass over what is left. A score is the
logistic of a sum of table entries, for all rows of a batch at once.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows of each class (a fixed bound, their
features only). Scoring covers every whole text.

Defined results: null and empty texts have the features of an empty text and get the score learned for such;
without any labels every score is 0.5; equal texts have equal scores; repeated rows each have a row; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.learn import labelled, remainder
from xylem.llm.shared import NOT_SPACE, Words, over_texts, text_steps

#: Most labelled rows of each class that the fit reads.
SAMPLE = 8000
#: Score from which a document counts as good.
ACCEPT = 0.3
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, SHRINK, LEAF = 32, 120, 8, 60, 0.1, 2.0, 15

CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [9, 10, 11, 12, 13, 32], "line": [10],
    "wide": range(128, 256), "stop": [44, 46, 59, 63], "bang": [33], "bar": [124], "mark": [35, 36, 37, 38, 42, 64, 94, 126],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125, 92, 47], "other": [34, 39, 43, 45, 58, 61, 95, 96],
}
_CLASS = np.zeros((256, len(CLASSES)))
for _k, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members), _k] = 1
_TAIL = np.zeros(256, bool)
_TAIL[np.flatnonzero(_CLASS[:, [list(CLASSES).index(x) for x in ("bang", "mark", "bar")]].any(axis=1))] = True
FEATURES = [*CLASSES, "chars", "words", "word_length", "long_words", "distinct_words", "top_word", "distinct_grams", "lines", "line_length", "distinct_lines", "tails", "entropy"]


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    rows = []
    for i, j, data, offsets in text_steps(texts):
        words = Words(data, offsets, NOT_SPACE)
        length = words.ends - words.starts
        tail = _TAIL[data[words.ends - 1]] if len(words.ends) else np.zeros(0, bool)
        breaks = np.flatnonzero(data == 10)
        grams = words.grams(3)
        for k in range(j - i):
            a, b = words.bounds[k], words.bounds[k + 1]
            own = data[offsets[k] : offsets[k + 1]]
            counts = np.bincount(own, minlength=256)
            size, n = len(own), b - a
            share = counts / max(1, size)
            cut = breaks[np.searchsorted(breaks, offsets[k]) : np.searchsorted(breaks, offsets[k + 1])]
            row = [*(share @ _CLASS), np.log1p(size - counts[128:192].sum()), np.log1p(n)]
            if n:
                here = length[a:b]
                _, often = np.unique(words.hashes[a:b], return_counts=True)
                three = grams[a : max(a, b - 2)]
                first = np.searchsorted(words.starts[a:b], np.concatenate([[offsets[k]], cut]))
                with np.errstate(over="ignore"):
                    heads = np.add.reduceat(words.hashes[a:b], np.minimum(first, n - 1))
                row += [here.mean(), (here > 9).mean(), len(often) / n, often.max() / n, len(np.unique(three)) / len(three) if len(three) else 1.0]
                row += [np.log1p(len(cut)), np.log1p(size / (len(cut) + 1)), len(np.unique(heads)) / len(heads), tail[a:b].mean()]
            else:
                row += [0.0, 0.0, 1.0, 0.0, 1.0, np.log1p(len(cut)), 0.0, 1.0, 0.0]
            some = share[share > 0]
            rows.append([*row, float(-(some * np.log(some)).sum())])
    return np.array(rows, float).reshape(len(texts), len(FEATURES))


@dataclass
class Additive:
    """Lookup tables: one for each feature, two-way ones for pairs."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.tables:
            codes = self.codes(x)
            for code, table in zip(codes, self.tables, strict=True):
                total += table[code]
            for a, b, table in self.pairs:
                total += table[codes[a], codes[b]]
        return 1 / (1 + np.exp(-total))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins."""
    cg, ch, cn = g.cumsum(), h.cumsum(), n.cumsum()
    gain = cg**2 / (ch + SHRINK) + (cg[-1] - cg) ** 2 / (ch[-1] - ch + SHRINK) - cg[-1] ** 2 / (ch[-1] + SHRINK)
    gain[(cn < LEAF) | (cn[-1] - cn < LEAF)] = -1
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree's value for each bin."""
    if depth and len(g) > 1:
        gain, at = best_cut(g, h, n)
        if gain > 0:
            return np.concatenate([shallow(g[:at], h[:at], n[:at], depth - 1), shallow(g[at:], h[at:], n[at:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + SHRINK))


def quarters(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-way table into four."""
    cg, ch, cn = (x.cumsum(0).cumsum(1) for x in (g, h, n))

    def corners(c):
        return c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs, ns = corners(cg), corners(ch), corners(cn)
    gain = sum(np.where(c >= LEAF, a**2 / (b + SHRINK), 0) for a, b, c in zip(gs, hs, ns, strict=True)) - g.sum() ** 2 / (h.sum() + SHRINK)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [a[i, j] / (b[i, j] + SHRINK) if c[i, j] >= LEAF else 0.0 for a, b, c in zip(gs, hs, ns, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Additive:
    rate = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Additive(float(np.log(rate / (1 - rate))))
    if len(y) < 2 * LEAF or rate in (1e-3, 1 - 1e-3):
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    codes = model.codes(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.base)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k, code in enumerate(codes):
            g, h = residual()
            step = RATE * shallow(*(np.bincount(code, v, sizes[k]) for v in (g, h)), np.bincount(code, minlength=sizes[k]))
            model.tables[k] += step
            total += step[code]

    def two_way(a, b):
        g, h = residual()
        at = codes[a] * sizes[b] + codes[b]
        return at, [np.bincount(at, v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for v in (g, h, np.ones(len(y)))]

    strongest = sorted(((quarters(*two_way(a, b)[1])[0], a, b) for a in range(len(codes)) for b in range(a)), reverse=True)[:PAIRS]
    tables = {(a, b): np.zeros((sizes[a], sizes[b])) for _, a, b in strongest}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in tables.items():
            at, sums = two_way(a, b)
            step = RATE * quarters(*sums)[1]
            table += step
            total += step.ravel()[at]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Additive:
    """Learns from rows whose crc32(doc_id) modulo 5 isn't 0."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0))), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows, counts = labelled(docs, labels, column, remainder(F.col("doc_id"), 5) != 0, SAMPLE)
    got = over_texts(rows, run, "x array<double>, label int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("label").to_pylist(), float)
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / drawn[1], counts.get(0, 0) / drawn[0]) if len(y) else np.zeros(0)
    order = np.lexsort(x.T) if len(y) else []
    return fit(x[order], y[order], weight[order] / weight.mean() if len(y) else weight)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    model = train(docs, labels)

    def run(batches):
        for batch in batches:
            score = model.score(features(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return over_texts(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, as they are."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= ACCEPT))

    return over_texts(docs, run, docs.schema)


def op6_quality(spark, sf_dir) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
