"""N-gram Jaccard join: which documents share at least 80 % of their distinct five-word shingles.

Size-banded tiles with hashed bitmap signatures. Each document is a set of 64-bit shingle hashes. Documents
meet in a tile, keyed by a rare shingle of both and by a size band; a 1,024-bit parity bitmap of each bounds
their overlap from above; what survives is compared by an exact intersection of sorted arrays.

How the work stays linear under skew:

* equal sets collapse to the smallest id first, in a map-side-combined aggregation;
* a document is filed under its rarest shingles only: of n shingles, the first ``n - ceil(0.8 n) + 1`` in one
  global order. Two sets with a Jaccard of 0.8 always share one of those, whatever the order. The order puts
  the corpus' most frequent shingles (counted over all documents; a list of fixed length) last, so a passage
  that many documents share doesn't make them candidates. The list changes speed only, never the result;
* in each tile all members are first compared with one pivot, which is linear, and the links found are
  contracted. Only members of tiles that still hold several components are compared with each other, under
  the size band and the bitmap bound, so a big group of near copies doesn't expand into all its pairs.

Defined results: null or wordless text has an empty set and links with nothing; a document with fewer than
five words has one shingle, its whole word sequence; rows that share a doc_id are one document; a null doc_id
links with nothing and its component is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.shared import NOT_SPACE, Scratch, Words, components, key_filter, list_array, may_contain, mix, over_texts, text_steps, without

#: Words in a shingle, and the least Jaccard in hundredths.
SHINGLE, LEAST = 5, 80
#: Longs in a bitmap signature.
LONGS = 16
#: Length of the list of frequent shingles that are ordered last.
FREQUENT = 1 << 17
#: Shingles that one counting step holds, and the count from which a step reports one.
COUNT_STEP, COUNT_FROM = 1 << 22, 3

#: Gets texts, yields the sorted distinct hashes of each.
Sets = Callable[[pa.Array], Iterator[np.ndarray]]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, data, offsets in text_steps(texts):
        words = Words(data, offsets, NOT_SPACE)
        grams = words.grams(SHINGLE)
        for k in range(j - i):
            a, b = words.bounds[k], words.bounds[k + 1]
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for h in words.hashes[a:b]:
                        whole = whole * np.uint64(0xD6E8FEB86659FD93) + h
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def frequent(docs: DataFrame, sets: Sets) -> np.ndarray:
    """The most frequent shingles of the corpus, sorted. Each step over about four million shingles reports what
    it saw ``COUNT_FROM`` times; the sums are ranked and the first ``FREQUENT`` reach the driver."""

    def run(batches):
        held, size = np.empty(COUNT_STEP, np.uint64), 0

        def report():
            seen = held[:size]
            seen.sort()
            first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            counts = np.diff(first, append=size)
            often = first[counts >= COUNT_FROM]
            return pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(counts[counts >= COUNT_FROM])], ["token", "n"])

        for batch in batches:
            for one in sets(batch.column(0)):
                while len(one):
                    part, one = one[: COUNT_STEP - size], one[COUNT_STEP - size :]
                    held[size : size + len(part)] = part
                    size += len(part)
                    if size == COUNT_STEP:
                        yield report()
                        size = 0
        if size:
            yield report()

    rows = over_texts(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.sort(np.array([r.token for r in rows], np.int64).view(np.uint64))


def signature(one: np.ndarray) -> np.ndarray:
    """Parity bitmap of about four bits for each element: bits where two differ are at most the elements that only one
    of them has. Its length is a power of two, so that a longer one folds to a shorter one's length."""
    longs = LONGS
    while 64 * longs < 4 * len(one):
        longs *= 2
    counts = np.bincount((one >> np.uint64(7)).astype(np.int64) % (64 * longs), minlength=64 * longs)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray, longs: int = LONGS) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, longs), axis=0)


def described(docs: DataFrame, sets: Sets, often: np.ndarray) -> DataFrame:
    """doc_id, set size n, two set hashes, the rarest shingles and the bitmap of each document."""

    def run(batches):
        for batch in batches:
            n, first, second, rare, bits, wide = [], [], [], [], [], []
            for one in sets(batch.column(1)):
                n.append(len(one))
                with np.errstate(over="ignore"):
                    first.append(int(mix(one + np.uint64(1)).sum(dtype=np.uint64)))
                    second.append(int(np.bitwise_xor.reduce(mix(one ^ np.uint64(0xA5A5A5A5A5A5A5A5)), initial=np.uint64(0))))
                keep = len(one) - (LEAST * len(one) + 99) // 100 + 1 if len(one) else 0
                last = often[np.minimum(np.searchsorted(often, one), len(often) - 1)] == one if len(often) else np.zeros(len(one), bool)
                rare.append(np.concatenate([one[~last], one[last]])[:keep].view(np.int64))
                wide.append(signature(one))
                bits.append(folded(wide[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)), list_array(rare, pa.int64()), list_array(bits, pa.int64()), list_array(wide, pa.int64())],
                ["doc_id", "n", "h1", "h2", "rare", "bits", "wide"],
            )

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, n long, h1 long, h2 long, rare array<long>, bits array<long>, wide array<long>")


def can_link(x: str, y: str) -> F.Column:
    """Whether sizes and bitmaps allow a link: of n and m elements with d known to differ, (n + m - d) / 2 at most are common."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(LONGS)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * LEAST) & ((n + m - apart) * 100 >= (n + m + apart) * LEAST)


def wide_enough(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Candidate ``pairs`` (a, b) whose full-length bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            keep = []
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                longs = min(len(x), len(y))
                apart = int(np.bitwise_count((folded(x, longs) ^ folded(y, longs)).view(np.uint64)).sum())
                keep.append((n[k] + m[k] - apart) * 100 >= (n[k] + m[k] + apart) * LEAST)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, n, w: bits.select(F.col("id").alias(end), F.col("n").alias(n), F.col("wide").alias(w))
    full = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return full.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def exact_links(docs: DataFrame, sets: Sets, pairs: DataFrame) -> DataFrame:
    """Of candidate ``pairs`` (a, b) those with a Jaccard of ``LEAST`` hundredths, by intersecting sorted arrays."""
    table = key_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")

    def arrays(batches):
        for batch in batches:
            ids = batch.column(0).drop_null() if batch.column(0).null_count else batch.column(0)
            batch = batch if len(ids) == len(batch) else batch.filter(batch.column(0).is_valid())
            if len(ids):
                hit = may_contain(table, ids.to_numpy(zero_copy_only=False))
                batch = batch.filter(pa.array(hit))
                got = [x.tobytes() for x in sets(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "tokens"])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= LEAST * (len(x) + len(y) - common) and common > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    held = over_texts(docs.select("doc_id", "text"), arrays, "id long, tokens binary")
    # sorted joins even of few pairs: a broadcast one would put both Python steps in one task, with a worker for each
    sets_of = lambda end, tokens: held.withColumnsRenamed({"id": end, "tokens": tokens}).hint("merge")
    full = pairs.join(sets_of("a", "x"), "a").join(sets_of("b", "y"), "b")
    return full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def only_shared(reps: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, n, token) of the rare shingles that another document may have too, by a filter of fixed size: the others stay
    where they are."""
    table = key_filter(shared, "token")

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            tokens, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            hit = may_contain(table, tokens.to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(len(batch)), sizes)[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), tokens.filter(pa.array(hit))], ["id", "n", "token"])

    return over_texts(reps.select("id", "n", "rare"), run, "id long, n long, token long")


def similar_sets(docs: DataFrame, sets: Sets = shingle_sets) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text). See the module's text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    known = scratch.keep(described(docs, sets, frequent(docs, sets)).withColumn("uid", F.monotonically_increasing_id()), "sets")
    some = known.where("n > 0 and doc_id is not null")
    copies = scratch.keep(some.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "uid")).alias("rep")).select("h1", "h2", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.uid").alias("uid")), "copies")
    slim = scratch.keep(known.select("doc_id", "n", "h1", "h2"), "slim")
    reps = scratch.keep(some.join(copies.select("uid"), "uid", "left_semi").select(F.col("doc_id").alias("id"), "n", "rare", "bits", "wide"), "reps")
    scratch.drop(but=[copies, slim, reps])
    known = slim
    del some

    # a token's pivot and size are combined before they move; its rows meet them in a join, of which a hot token's side can be split
    shared = reps.select("id", "n", F.explode("rare").alias("token")).groupBy("token").agg(F.min("id").alias("pivot"), F.min_by("n", "id").alias("pivot_n"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = scratch.keep(shared, "shared")
    tiles = scratch.keep(only_shared(reps, shared).join(shared, "token").select("id", "n", "token", "members", "pivot", "pivot_n"), "tiles")
    bits = scratch.keep(reps.join(tiles.select("id").distinct(), "id", "left_semi").select("id", "n", "bits", "wide"), "bits")
    scratch.drop(but=[tiles, bits, copies, slim])
    del reps

    near = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * LEAST
    star = tiles.where((F.col("id") != F.col("pivot")) & near).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = scratch.keep(exact_links(docs, sets, scratch.keep(wide_enough(star, bits), "star")), "links")
    scratch.tidy()
    same = components(scratch, links)

    # pairs with the pivot are done; of the others a row is needed only if a row of another component has a near size
    rest = tiles.where("members > 2 and id != pivot").join(same, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = scratch.keep(rest.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / LEAST)) + 1e-9)), "rest")
    mixed = rest.select("token", F.explode(F.array("band", F.col("band") - 1, F.col("band") + 1)).alias("band"), "component").groupBy("token", "band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    rest = scratch.keep(rest.join(mixed, ["token", "band"], "left_semi"), "mixed")
    rest = rest.join(bits.select("id", "bits"), "id")
    left = rest.alias("x")
    right = rest.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).alias("y")
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    more = left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & order & (F.col("x.component") != F.col("y.component")) & can_link("x", "y"))
    more = scratch.keep(more.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "more")
    scratch.tidy()
    found = scratch.keep(exact_links(docs, sets, scratch.keep(wide_enough(more, bits), "close")), "found")
    if found.take(1):
        same = components(scratch, links.unionByName(found))

    named = copies.join(same.withColumnsRenamed({"id": "rep"}), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    # a row's class is that of its set; rows that share a doc_id share the smallest
    result = known.join(named, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    result = scratch.keep(result, "result")
    scratch.drop(but=[result])
    return result


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which no linked one has a smaller doc_id: one of each group stays.

    A row without a doc_id stays; of several rows with one doc_id all stay.
    """
    gone = similar_sets(docs).where("component_id != doc_id").select("doc_id").distinct()
    return without(docs, gone, "doc_id")


def op4_jaccard_join(spark, sf_dir) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
