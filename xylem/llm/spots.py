"""Document fingerprints: SpotSigs.

Each common word (an anchor) starts a signature: the anchor and the next ``CHAIN`` content words after it. The
start of a text is an anchor too, and a chain that the text ends is kept, so every text with a word has a
signature. Where more than ``STRETCH`` words stand without a common one, or the text has none at all (other
languages, code, tables), each of them past the first starts a signature too, so the whole text counts. A fingerprint is the sorted set of 32-bit signature hashes in hexadecimal; texts without any word
are fingerprinted by their bytes. Two fingerprints are compared by Jaccard, pruned by their lengths: what the
shorter one can reach at most bounds it from above. :func:`similar_spots` groups near duplicates by
signatures, partitioned by set length.

The edited text of a document borrows from the next document by descending doc_id. That order is found without
a global sort: quantiles of doc_id cut the ids into buckets, the first row of each bucket is also sent to the
bucket before it, and each bucket is sorted by itself. Texts are shuffled once.

Defined results: a null text is the empty text; ties of doc_id are ordered by the text's hash and then the
text; a null doc_id comes after all others; of a single row the next one is itself; equal texts have equal
fingerprints and a likeness of 1; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.jaccard import similar_sets
from xylem.llm.shared import ALNUM, Words, mix, over_texts, small_batches, text_steps

CHAIN = 2
#: Bytes of a partition of whole texts.
PART_BYTES = 64 << 20
#: Content words in a row from which on they are anchors themselves.
STRETCH = 8
#: Anchors: the commonest words of English, German, French and Spanish (fixed values).
ANCHORS = """a an and are as at be been but by for from had has have he her his if in into is it its no not of on or she that the their them then there they
this to was we were which will with would you der die das den dem des ein eine einen und oder ist sind war mit von zu zum zur im auf für nicht als auch sich es
le la les un une des du de et ou est sont dans par pour que qui sur au aux avec ne pas ce se el los las del y o que en por con para su sus no lo como una""".split()


def hashes_of(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    return np.unique(Words(np.frombuffer(b"".join(data), np.uint8), offsets, ALNUM).hashes)


def in_stretches(common: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words are anchors without being common: those past the first of a long stretch, or of a text, without common ones."""
    at = np.arange(len(common))
    owner = np.searchsorted(bounds, at, "right") - 1
    first = np.maximum(np.maximum.accumulate(np.where(common, at + 1, 0)), bounds[owner])
    last = np.minimum(np.minimum.accumulate(np.where(common, at, len(common))[::-1])[::-1], bounds[owner + 1])
    whole = (first == bounds[owner]) & (last == bounds[owner + 1])
    return ~common & (at - first >= CHAIN - 1) & ((last - first > STRETCH) | whole)


ANCHOR_HASHES = hashes_of(ANCHORS)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def spot_sets(texts: pa.Array):
    """The sorted distinct 64-bit signatures of each text."""
    for i, j, data, offsets in text_steps(texts):
        words = Words(data, offsets, ALNUM)
        anchor = np.isin(words.hashes, ANCHOR_HASHES)
        content = np.flatnonzero(~anchor)
        bounds = words.bounds
        anchor = anchor | in_stretches(anchor, bounds)
        heads = bounds[:-1][np.diff(bounds) > 0]
        at = np.concatenate([np.flatnonzero(anchor), heads])  # words that start a chain; a text's start is an anchor before its first word
        lead = np.concatenate([words.hashes[anchor], np.zeros(len(heads), np.uint64)])
        owner = np.searchsorted(bounds, at, "right") - 1
        first = np.searchsorted(content, np.concatenate([np.flatnonzero(anchor) + 1, heads]))
        signature = lead
        padded = np.concatenate([content, [len(words.hashes)] * (CHAIN + 1)])
        full = np.zeros(len(at), bool)
        with np.errstate(over="ignore"):
            for k in range(CHAIN):
                place = padded[first + k]
                within = place < bounds[owner + 1]
                word = np.where(within, words.hashes[np.minimum(place, max(0, len(words.hashes) - 1))] if len(words.hashes) else 0, np.uint64(k + 1))
                signature = (signature * _MUL) + word
                full |= within
        full[len(at) - len(heads) :] = True
        signature, owner = mix(signature)[full], owner[full]
        order = np.argsort(owner, kind="stable")
        signature, cut = signature[order], np.searchsorted(owner[order], np.arange(j - i + 1))
        for t in range(j - i):
            one = np.unique(signature[cut[t] : cut[t + 1]])
            if not len(one) and offsets[t + 1] > offsets[t]:
                raw = hashlib.sha256(data[offsets[t] : offsets[t + 1]].tobytes()).digest()
                one = np.frombuffer(raw[:8], np.uint64).copy()
            yield one


def prints(texts: list[str]) -> list[np.ndarray]:
    """Fingerprints as sorted 32-bit values."""
    return [np.unique(x >> np.uint64(32)).astype(">u4") for x in spot_sets(pa.array(texts, pa.large_string()))]


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two fingerprints; 0 at once if their lengths can't reach ``least``."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def similar_spots(docs: DataFrame) -> DataFrame:
    """doc_id, number of signatures and class of near duplicates (four fifths of signatures in common) of each row."""
    return similar_sets(docs, spot_sets).withColumnRenamed("n_shingles", "n_signatures")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in prints(texts)], pa.string())], ["doc_id", "fingerprint"])

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def parts_for(docs: DataFrame) -> int:
    """Partitions for a shuffle of whole texts: the session's number, or more if that makes them larger than ``PART_BYTES``."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES if size < 1 << 60 else 0)


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``key``: first the block of cuts, then the place in it."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    block = F.greatest(F.size(F.filter(longs([b[0] for b in blocks]), lambda c: c < key)) - 1, F.lit(0))
    return block * width + F.size(F.filter(F.get(F.array(*(longs(b) for b in blocks)), block), lambda c: c < key))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, guest, key, tie, doc_id, text), each partition sorted so that every row that isn't a guest is followed by its next one."""
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    rows = rows.withColumn("own", bucket_of(F.col("key"), sorted(set(cuts or []))))
    tops = {r.own: r.top for r in rows.groupBy("own").agg(F.max(F.struct("key", "tie")).alias("top")).collect()}  # a row for each bucket
    order = sorted(tops)
    target = [(b, tops[b].key, tops[b].tie, order[(k + 1) % len(order)]) for k, b in enumerate(order)]
    firsts = F.broadcast(docs.sparkSession.createDataFrame(target, "own int, top_key long, top_tie long, target int"))
    guest = F.when((F.col("key") == F.col("top_key")) & (F.col("tie") == F.col("top_tie")), F.col("target"))
    both = F.when(F.col("guest_of").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("bucket"), F.lit(1).alias("guest")))
    )
    sent = rows.join(firsts, "own", "left").withColumn("guest_of", guest).select(F.explode(both).alias("b"), "key", "tie", "doc_id", "text").select("b.*", "key", "tie", "doc_id", "text")
    return sent.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("tie"), F.desc("text"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of each row."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    parts = parts_for(docs)

    def run(batches):
        held = None  # the last row: its bucket, id, text and fingerprint
        for batch in batches:
            bucket, guest, ids, texts = (batch.column(k).to_pylist() for k in (0, 1, 4, 5))
            own = prints(texts)
            rows = [(b, g, i, t, p) for b, g, i, t, p in zip(bucket, guest, ids, texts, own, strict=True)]
            if held:
                rows.insert(0, held)
            out = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
            held = rows[-1] if rows else None
            edited = []
            for x, y in out:
                k = len(x[3]) // 3
                edited.append(x[3][: len(x[3]) - k] + y[3][:k])
            marks = prints(edited)
            hexed = lambda z: z.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in out], pa.int64()), pa.array([len(x[3]) for x, _ in out], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([hexed(x[4]) for x, _ in out], pa.string()), pa.array([hexed(m) for m in marks], pa.string()),
                    pa.array([likeness(x[4], m) for (x, _), m in zip(out, marks, strict=True)], pa.float64()), pa.array([likeness(x[4], y[4]) for x, y in out], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def spots_near_duplicates(spark, sf_dir) -> DataFrame:
    """Near duplicates by signatures of all documents: partitioned by set length, pruned, compared exactly."""
    return similar_spots(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_fingerprints(spark, sf_dir) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
