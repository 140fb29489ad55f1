"""What several corpus operators need: shared scratch tables, bounded filters, components and batch kernels.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``; a folder of our own is
used only where that setting is absent (tests, notebooks). Every scratch table is plain Parquet, so a lost
executor costs a re-read and never a lineage that can't be replayed.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Text bytes that one vectorised step handles at most (one longer text is a step of its own).
STEP_BYTES = 1 << 20

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where none is set and all executors are on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:  # with its scheme, so that Spark and Python mean one place
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found.rstrip("/"))
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("the executors need a folder that they share: set spark.checkpoint.dir")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="xylem-"))
    return _own_folder[0]


class Scratch:
    """Parquet tables of one operator call. ``drop`` deletes those that the result doesn't read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []
        atexit.register(self.drop)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.made)}"
        frame.write.parquet(path)
        self.made.append(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of finished steps: it does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def folder(self, name: str) -> str:
        """A folder for files other than tables; ``drop`` deletes it too."""
        self.made.append(path := f"{self.root}/{name}-{len(self.made)}")
        return path

    def drop(self, but: Iterable[DataFrame] = ()) -> None:
        keep = {f.split("file:")[-1].lstrip("/") for x in but for f in x.inputFiles()}
        jvm = self.spark.sparkContext._jvm
        if jvm is None or self.spark.sparkContext._jsc is None:
            return
        left = []
        for path in self.made:
            if any(path.split("file:")[-1].lstrip("/") in f for f in keep):
                left.append(path)
                continue
            try:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session has ended
                return
        self.made = left
        if but:
            self.tidy()


#: Bytes from which on an Arrow batch is sent, however few its rows are.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows and about ``BATCH_BYTES``, in this session from now on: whole texts can be
    long, a batch is held at once on both sides, and Spark reads the setting when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# ---------------------------------------------------------------- bounded filters

#: Longs in a bounded key filter: 2**17 of them are 8.4 million bits, 1 MB, whatever the input's size.
FILTER_LONGS = 1 << 17


def key_filter(keys: DataFrame, column: str, longs: int = FILTER_LONGS) -> np.ndarray:
    """A one-hash Bloom filter over 64-bit ``column`` of a fixed size.

    At most ``longs`` rows reach the driver for any input. A fuller filter only lets more rows pass, and
    each use is followed by an exact join.
    """
    key = F.xxhash64(F.col(column))
    bit = F.shiftrightunsigned(key, 17).bitwiseAND(F.lit(63)).cast("int")
    rows = (
        keys.select(F.pmod(F.shiftrightunsigned(key, 30), F.lit(longs)).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
        .groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect()
    )
    table = np.zeros(longs, np.int64)
    for r in rows:
        table[r.slot] = r.bits
    return table.view(np.uint64)


def may_contain(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` a :func:`key_filter` lets pass."""
    h = spark_xxhash64(keys)
    slot = (h >> np.uint64(30)) % np.uint64(len(table))
    bit = (h >> np.uint64(17)) & np.uint64(63)
    return (table[slot.astype(np.int64)] >> bit) & np.uint64(1) == 1


def spark_xxhash64(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """xxHash64 of 8-byte values, as the published algorithm defines it for an input of that length."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    x = np.ascontiguousarray(keys).view(np.uint64)
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8)
        h = h ^ (rot(x * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def without(rows: DataFrame, gone: DataFrame, key: str, same: Column | None = None) -> DataFrame:
    """``rows`` without those whose 64-bit ``key`` is in ``gone``, or of which ``same`` holds besides; a null key stays.

    Rows that a bounded filter over ``gone`` rules out stay where they are; only the others, about as many as
    there are to drop, are shuffled for the exact anti join.
    """
    table = key_filter(gone, key)
    at = rows.columns.index(key)

    def marked(batches):
        for batch in batches:
            ids = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.append_column("_maybe", pa.array(may_contain(table, ids) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)))

    kind = StructType([*rows.schema.fields, StructField("_maybe", BooleanType())])
    both = over_texts(rows, marked, kind)
    stay = both.where("not _maybe").drop("_maybe")
    if same is None:
        met = gone.select(key), key, "left_anti"
    else:
        met = gone.withColumnRenamed(key, "_gone"), (F.col(key) == F.col("_gone")) & same, "left_anti"
    return stay.unionByName(both.where("_maybe").drop("_maybe").join(*met).select(rows.columns))


# ---------------------------------------------------------------- connected components


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over undirected ``edges``; ids without an edge have no row.

    Alternating large-star and small-star steps: each writes edges that grow with nothing but the number of
    ids, the work is spread by id, and the number of rounds grows with the logarithm of the longest chain.
    """
    now = scratch.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u != v").distinct()
        now = scratch.keep(small, "small")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- batch kernels over UTF-8

_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words for shingles: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words for benchmark windows: ASCII letters, digits and all that isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, m, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of some texts: byte ``starts`` and ``ends``, 64-bit ``hashes``; those of text i are ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        low = LOWER[data]
        inside = table[low]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        cuts = offsets[(offsets < len(data))]
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(after):
            after[-1] = False
        ends = offsets[offsets > 0] - 1
        after[ends] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        power, inverse = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_KEYS[low] * power[: len(data)], out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only those that stay within a text mean anything."""
        h, out = self.hashes, np.zeros(max(0, len(self.hashes) - k + 1), np.uint64)
        if not len(out):  # fewer words than a gram has
            return out
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
        return mix(out)


def text_steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts; null texts are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array for each row."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def over_texts(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    small_batches(frame.sparkSession)
    return frame.mapInArrow(run, schema)
