"""Benchmark decontamination by winnowing.

Every benchmark window (eight words) that occurs in a document is found. Of each run of four consecutive
five-word grams the one with the smallest hash is kept, on both sides, so two texts with eight words in
common keep at least one gram of those eight in common. Kept grams are joined by hash and each hit is
extended word by word through its context; only equal words count, so hash collisions do no harm. An item of
fewer than eight words is one window: its gram is the whole item, and documents keep all grams of such
lengths (at most seven lengths, those that the benchmark has).

Documents are read once. A filter of fixed size over the benchmark's grams drops nearly all grams of the
documents where they are made; the join that follows is an ordinary distributed one, so the benchmark may
grow too. Equal items are collapsed before the join and spread again in the result.

Defined results: null texts and texts without words have no words and no windows; rows are told apart by
doc_id and text, and equal rows each get their row; an item without item_id marks words but isn't listed;
repeated item_ids count once; extra columns are ignored; empty tables give empty or all-clean results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.shared import ALNUM, LOWER, Scratch, Words, key_filter, list_array, may_contain, mix, over_texts, text_steps, without

#: Words in a window, in a gram, and grams of which one is kept: any WINDOW words keep one of their grams.
WINDOW, GRAM = 8, 5
RUN = WINDOW - GRAM + 1
#: Items of which a document must hold windows to count as contaminated.
ITEMS = 2
MARKS = ["gram", "at", "lead", "context"]
KINDS = "gram array<long>, at array<int>, lead array<int>, context array<string>"


def kept(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions of the last smallest of each ``run`` consecutive hashes; of all if there are fewer."""
    if len(hashes) < run:
        return np.arange(len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, run)
    return np.unique(np.arange(len(view)) + run - 1 - np.argmin(view[:, ::-1], axis=1))


def of_length(grams: np.ndarray, k: int) -> np.ndarray:
    """Grams of an item of k words (0: of longer items) are told from others."""
    return mix(grams ^ np.uint64(0x51ED270B7A3C9E15 * (k + 1) & (2**64 - 1)))


def marks(texts: pa.Array, lengths: list[int], table: np.ndarray | None):
    """For each text its number of words and the arrays of MARKS; ``lengths``: of short items; ``table``: a filter, or
    None for the benchmark's own texts, of which a short one has its whole gram only."""
    for i, j, data, offsets in text_steps(texts):
        words = Words(data, offsets, ALNUM)
        low = LOWER[data].tobytes()
        n = np.diff(words.bounds)
        last = np.repeat(words.bounds[1:], n)
        first = np.repeat(words.bounds[:-1], n)
        at, gram, size = [], [], []
        for k in [0, *lengths]:
            wide = k or GRAM
            g = of_length(words.grams(wide), k)
            pick = kept(g, 1 if k else RUN)
            pick = pick[pick + wide <= last[pick]]
            if table is None:
                pick = pick[(n[np.searchsorted(words.bounds, pick, "right") - 1] == k) if k else (last[pick] - first[pick] >= WINDOW)]
            elif len(pick):
                pick = pick[may_contain(table, g[pick])]
            at.append(pick), gram.append(g[pick]), size.append(np.full(len(pick), k))
        at, gram, size = np.concatenate(at), np.concatenate(gram), np.concatenate(size)
        owner = np.searchsorted(words.bounds, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        at, gram, size, owner = at[order], gram[order], size[order], owner[order]
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        for t in range(j - i):
            here = slice(cut[t], cut[t + 1])
            a, b = words.bounds[t], words.bounds[t + 1]
            lead, context = [], []
            for p, k in zip(at[here].tolist(), size[here].tolist(), strict=True):
                x, y = (p, p + k) if k else (max(a, p - RUN + 1), min(b, p + GRAM + RUN - 1))
                lead.append(p - x)
                context.append(" ".join(low[words.starts[w] : words.ends[w]].decode("utf-8", "replace") for w in range(x, y)))
            yield int(b - a), gram[here].view(np.int64), (at[here] - a).astype(np.int32), np.array(lead, np.int32), context


def marked(rows: DataFrame, names: list[str], lengths: list[int], table: np.ndarray | None) -> DataFrame:
    """``rows`` are names and text; the result has n_words and the arrays of MARKS in place of the text."""

    def run(batches):
        for batch in batches:
            found = list(marks(batch.column(len(names)), lengths, table))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(len(names))),
                    pa.array([x[0] for x in found], pa.int64()),
                    list_array([x[1] for x in found], pa.int64()),
                    list_array([x[2] for x in found], pa.int32()),
                    list_array([x[3] for x in found], pa.int32()),
                    pa.array([x[4] for x in found], pa.list_(pa.string())),
                ],
                [*names, "n_words", *MARKS],
            )

    head = ", ".join(f"{x} {k}" for x, k in rows.select(*names).dtypes)
    return over_texts(rows.select(*names, "text"), run, f"{head}, n_words long, {KINDS}")


def shared_windows(lead: int, context: str, item_lead: int, item_context: str) -> list[tuple[int, int]]:
    """Windows (start relative to the gram, words) that contain a gram common to both contexts."""
    x, y = context.split(" "), item_context.split(" ")
    if len(y) < WINDOW:
        return [(0, len(y))] if x == y else []
    if x[lead : lead + GRAM] != y[item_lead : item_lead + GRAM]:
        return []
    back = ahead = 0
    while back < min(lead, item_lead) and x[lead - back - 1] == y[item_lead - back - 1]:
        back += 1
    while lead + GRAM + ahead < len(x) and item_lead + GRAM + ahead < len(y) and x[lead + GRAM + ahead] == y[item_lead + GRAM + ahead]:
        ahead += 1
    return [(s, WINDOW) for s in range(-back, GRAM + ahead - WINDOW + 1)]


def windows(batches):
    """Joined rows to (doc_id, tkey, item, start, stop) of each window."""
    for batch in batches:
        cols = {x: batch.column(k).to_pylist() for k, x in enumerate(batch.schema.names)}
        out = []
        for doc, key, at, lead, context, item, item_lead, item_context in zip(*(cols[x] for x in ("doc_id", "tkey", "at", "lead", "context", "item", "item_lead", "item_context")), strict=True):
            out += [(doc, key, item, at + s, at + s + n) for s, n in shared_windows(lead, context, item_lead, item_context)]
        parts = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "tkey", "item", "start", "stop"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    items = benchmark.select("item_id", "text", F.xxhash64("text").alias("item"))
    own = scratch.keep(marked(items.groupBy("item").agg(F.first("text").alias("text")), ["item"], [*range(1, WINDOW)], None), "items")
    lengths = sorted(r.n_words for r in own.where(f"n_words between 1 and {WINDOW - 1}").select("n_words").distinct().collect())
    zipped = lambda x: x.withColumn("m", F.explode(F.arrays_zip(*MARKS)))
    wanted = zipped(own).select("item", F.col("m.gram").alias("gram"), F.col("m.lead").alias("item_lead"), F.col("m.context").alias("item_context")).distinct()
    seen = scratch.keep(marked(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text"), ["doc_id", "tkey"], lengths, key_filter(wanted, "gram")), "marked")
    near = zipped(seen).select("doc_id", "tkey", *(F.col(f"m.{x}").alias(x) for x in MARKS)).join(wanted, "gram")
    near = near.select("doc_id", "tkey", "at", "lead", "context", "item", "item_lead", "item_context")
    hits = scratch.keep(near.mapInArrow(windows, "doc_id long, tkey long, item long, start long, stop long").distinct(), "hits")

    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, s.end))).alias("n"), F.greatest(s.end, x.stop).alias("end"))
    words = hits.groupBy("doc_id", "tkey").agg(F.aggregate(spans, zero, step, lambda s: s.n).alias("n_hit"))
    named = hits.select("doc_id", "tkey", "item").distinct().join(items.select("item", F.col("item_id").cast("string").alias("item_id")).distinct(), "item")
    listed = named.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = words.join(listed, words.doc_id.eqNullSafe(listed.doc_id) & (words.tkey == listed.tkey), "left").select(words.doc_id.alias("d"), words.tkey.alias("t"), "n_hit", "ids")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    whole = seen.select("doc_id", "tkey", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left")
    whole = whole.select(
        "doc_id", "tkey", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size(ids) >= ITEMS).alias("contaminated"),
    )
    result = scratch.keep(whole, "result")
    scratch.drop(but=[result])
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with the columns of ``docs``."""
    pair = lambda key: F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), key)
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), pair(F.col("tkey")).alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t"))
    return without(docs.withColumn("_key", pair(F.xxhash64("text"))), bad, "_key", same).select(docs.columns)


def op2_decontamination(spark, sf_dir) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tkey")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(8, len(ws)) AS n, array_to_string(ws[i:i + 7], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) t(i) WHERE len(ws) > 0),
doc_windows AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM item_windows) l, unnest(range(1, len(ws) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
