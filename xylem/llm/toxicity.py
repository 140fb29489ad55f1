"""Toxicity scores from a lexicon that tolerates misspellings, and from the words around each find.

The lexicon is a trie of terms learned from labelled documents (words, and word beginnings, that toxic ones
have and others lack) beside a short list of common insults. Each word is run through the Levenshtein
automaton of one edit (two for terms of nine letters or more, none for terms of four: those have too many
neighbours that are words themselves; a swap counts as two edits) intersected with the trie: states are sets of (trie node, edits),
made deterministic as words need them, so most words leave the automaton after two or three letters. Each find
is weighed by its context: within quotation marks, or after a word that reports speech, it counts as quoted.
A logistic model over the counts gives the score.

The lexicon and the model are learned from at most ``SAMPLE`` labelled rows of each class (a fixed bound).

Defined results: null and empty texts have no finds and get the score learned for such; without labels the
weights are those stated here; equal texts have equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.learn import labelled, remainder
from xylem.llm.shared import over_texts

#: Most labelled rows of each class that are read, learned terms of the model, and the score that counts as toxic.
SAMPLE, TERMS, TOXIC = 4000, 400, 0.3
#: Toxic documents that must have a learned term, and their least share of those that have it.
SUPPORT, SHARE = 4, 0.9
#: Characters of context on either side of a find.
CONTEXT = 60
#: Common insults known beforehand (fixed values).
INSULTS = ["idiot", "moron", "scum", "stupid", "loser", "pathetic", "worthless", "disgusting", "trash", "clown"]
#: Words that report or mention speech (fixed values).
REPORTS = ["said", "says", "called", "calls", "word", "term", "quote", "quoted", "wrote"]
QUOTES = "\"'«»“”„‘’"
_WORD = re.compile(r"[^\W\d_](?:[\w@$]*\w)?")
_REPORT = re.compile(r"\b(?:" + "|".join(REPORTS) + r")\W*$")
#: Finds in the open: exact, misspelled, by beginning; quoted ones; finds per 100 words; constant. Weights expected before any label is seen.
PRIOR = np.array([3.0, 1.0, 2.5, -0.5, 0.3, -3.0])


def edits(term: str) -> int:
    """Edits allowed in a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of terms and the automaton over it. Beginnings end in ``*`` and allow no edit."""

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.most: list[int] = [0]
        self.open: list[bool] = [False]
        for term in sorted(terms):
            node, allowed = 0, 0 if term.endswith("*") else edits(term)
            for c in term.removesuffix("*"):
                self.most[node] = max(self.most[node], allowed)
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({}), self.end.append(-1), self.most.append(0), self.open.append(False)
                node = self.next[node][c]
            self.most[node] = max(self.most[node], allowed)
            if term.endswith("*"):
                self.open[node] = True
            else:
                self.end[node] = allowed
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.state({(0, 0)})
        self.known: dict[str, int] = {}

    def state(self, raw: set[tuple[int, int]]) -> int:
        """Number of the set with what deletions add; -1 for the empty one."""
        reach, todo = {}, list(raw)
        while todo:
            node, used = todo.pop()
            if used > self.most[node] or reach.get(node, 9) <= used:
                continue
            reach[node] = used
            todo += [(n, used + 1) for n in self.next[node].values()]
        key = frozenset(reach.items())
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key), self.moves.append({})
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        out = set()
        for node, used in self.sets[state]:
            if c in self.next[node]:
                out.add((self.next[node][c], used))
            out.add((node, used + 1))
            out |= {(n, used + 1) for n in self.next[node].values()}
        return self.state(out)

    def look(self, word: str) -> int:
        """0: no find, 1: a term, 2: a misspelled term, 3: a beginning."""
        state, node = self.start, 0
        for c in word:
            node = self.next[node].get(c, -1) if node >= 0 else -1
            if node >= 0 and self.open[node]:
                return 3
            if state >= 0:
                moves = self.moves[state]
                if c not in moves:
                    moves[c] = self.step(state, c)
                state = moves[c]
            if state < 0 and node < 0:
                return 0
        if node >= 0 and self.end[node] >= 0:
            return 1
        return 2 if state >= 0 and any(0 < used <= self.end[n] for n, used in self.sets[state]) else 0

    def kind(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 1_000_000:  # a cache of fixed size
                self.known.clear()
            got = self.known[word] = self.look(word)
        return got

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = _WORD.findall(low)
        kind = self.kind
        found = {w: k for w in set(words) if (k := kind(w))}
        counts = [0, 0, 0, 0]
        if found:
            for m in _WORD.finditer(low):
                k = found.get(m[0])
                if k:
                    counts[3 if quoted(low, m.start(), m.end()) else k - 1] += 1
        return [np.log1p(counts[0]), np.log1p(counts[1]), np.log1p(counts[2]), np.log1p(counts[3]), min(5.0, 100 * sum(counts[:3]) / len(words)) if words else 0.0, 1.0]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks enclose the place within its context and line, or reported speech leads to it."""
    before = text[max(0, start - CONTEXT) : start].rpartition("\n")[2]
    after = text[end : end + CONTEXT].partition("\n")[0]
    opened = sum(before.count(q) for q in QUOTES if q not in "'’")
    closed = sum(after.count(q) for q in QUOTES if q not in "'’")
    return bool(opened % 2 and closed % 2) or bool(_REPORT.search(before))


def terms(rows: DataFrame) -> list[str]:
    """The ``TERMS`` commonest of the words and beginnings that mark toxic documents in the sample. Of rarer ones, more
    pass the test of support and share by chance."""

    def run(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 3}
                seen[label].update(words)
                seen[label].update({w[:k] + "*" for w in words for k in (5, 6) if len(w) > k})
        keys = sorted(set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[k][w] for w in keys], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])
        keys = sorted(w for w in seen[0] if w not in seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[0][w] for w in keys], pa.int64()), pa.array([0] * len(keys), pa.int64())], ["term", "clean", "toxic"])

    sums = over_texts(rows, run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    good = sums.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= SHARE * (F.col("toxic") + F.col("clean") + 0.2)))
    return [r.term for r in good.orderBy(F.desc("toxic"), "term").limit(TERMS).collect()]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR."""
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1.0 * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Learns from rows whose crc32(doc_id) modulo 4 isn't 2."""
    rows, counts = labelled(docs, labels, "toxic", remainder(F.col("doc_id"), 4) != 2, SAMPLE)
    words = sorted({*INSULTS, *terms(rows)})

    def run(batches):
        own = Lexicon(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    got = over_texts(rows, run, "x array<double>, label int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(PRIOR))
    y = np.array(got.column("label").to_pylist(), float)
    if not len(y):
        return words, PRIOR
    weight = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))
    order = np.lexsort((y, *x.T))
    return words, fit(x[order], y[order], weight[order] / weight.mean())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_finds of each row."""
    words, weights = train(docs, labels)

    def run(batches):
        own = Lexicon(words)
        for batch in batches:
            x = np.array([own.features(t) for t in batch.column(2).to_pylist()], float).reshape(-1, len(PRIOR))
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            finds = np.rint(np.expm1(x[:, :4]).sum(axis=1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), pa.array(finds)], ["doc_id", "held_out", "score", "predicted", "n_finds"])

    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return over_texts(rows, run, "doc_id long, held_out boolean, score double, predicted int, n_finds long")


def op10_toxicity(spark, sf_dir) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
