"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three code points of the
lower-case text, runs of anything but letters counting as one space). A document's own most frequent
n-grams are ranked likewise; its distance to a profile is the sum of how far each of its n-grams is out of
place there, or ``PLACES`` if it is absent. The nearest profile wins.

A profile is learned from at most ``SAMPLE`` labelled documents of its language (a fixed bound), however rare the
language is; every whole text is ranked.

Defined results: null text and text without a letter are ``und`` with score 0; without any profile every text
is ``und``; ties go to the language that sorts first; equal texts have equal results; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.learn import remainder
from xylem.llm.shared import over_texts

#: Most labelled documents of each language that its profile is learned from, and n-grams in a profile or ranking.
SAMPLE, PLACES = 4000, 400
#: Share of the greatest distance by which a language must be nearer to be e times as likely.
WARMTH = 0.03
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as numbers, and their counts."""
    letters = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(letters.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = c[:-2] << np.uint64(42) | two[1:]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PLACES most frequent keys, ties in the order of keys."""
    if len(keys) > PLACES:
        least = np.partition(counts, len(counts) - PLACES)[len(counts) - PLACES]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:PLACES]


class Profiles:
    def __init__(self, of: dict[str, list[int]]):
        self.names = sorted(of)
        self.keys, self.places = [], []
        for name in self.names:
            key = np.array(of[name], np.uint64)
            order = np.argsort(key)
            self.keys.append(key[order]), self.places.append(order)

    def distances(self, own: np.ndarray) -> np.ndarray:
        here = np.arange(len(own))
        out = []
        for keys, places in zip(self.keys, self.places, strict=True):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out.append(np.where(keys[at] == own, np.abs(places[at] - here), PLACES).sum())
        return np.array(out, float)

    def best(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        own = ranked(*grams(text))
        far = self.distances(own) / (PLACES * len(own))
        like = np.exp((far.min() - far) / WARMTH)
        k = int(far.argmin())
        return self.names[k], float(like[k] / like.sum())


def learn(docs: DataFrame) -> Profiles:
    """Profiles from text and non-null lang of documents whose crc32(doc_id) modulo 5 isn't 0."""

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(lang, []).append(grams(text))
                if len(held[lang]) >= 200:
                    held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    # the smallest hashes of each language: a share that leaves about twice as many first, so no task sorts a whole language
    sizes = F.broadcast(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))
    some = known.select("lang", "doc_id").join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * (2 * SAMPLE + 100) / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
    chosen = some.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "doc_id").distinct()
    rows = known.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "text")
    counts = over_texts(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= PLACES).orderBy("lang", "place").collect():
        top.setdefault(r.lang, []).append(r.gram)
    return Profiles(top)


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    profiles = learn(docs)

    def run(batches):
        for batch in batches:
            found = [profiles.best(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return over_texts(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language(spark, sf_dir) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
