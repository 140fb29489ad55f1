"""The registered queries: query text and the SQL that gives the same rows.

``TEXTS[name] = (query, SQL)``; collections named in a query are tables, or ``nations``: the tables nation,
customer and orders as one XML document for each nation. ``CALLS`` are queries that need more than one statement.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.session import Session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]


def nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a document for each nation with its customers and their orders, in the order of keys."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    joined = lambda c, key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(c).alias("x")))), lambda s: s["x"]), "")
    orders = read("orders").withColumn("o", F.format_string('<order key="%d" status="%s"/>', "o_orderkey", "o_orderstatus")).groupBy("o_custkey").agg(joined("o", "o_orderkey").alias("os"))
    people = read("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    person = F.concat(F.format_string('<customer key="%d" segment="%s"><name>%s</name>', "c_custkey", "c_mktsegment", "c_name"), F.coalesce("os", F.lit("")), F.lit("</customer>"))
    people = people.withColumn("c", person).groupBy("c_nationkey").agg(joined("c", "c_custkey").alias("cs"))
    nations = read("nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    xml = F.concat(F.format_string('<nation key="%d" name="%s" xml:lang="%s">', "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "en-GB").otherwise("fr")), F.coalesce("cs", F.lit("")), F.lit("<!--end--></nation>"))
    return nations.select(F.col("n_nationkey").cast("long").alias("doc_id"), xml.alias("xml")).repartition(spark.sparkContext.defaultParallelism, "doc_id")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): one document of all regions and nations, which refer to one another by id."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    regions = read("region").select(F.format_string('<region id="R%d" name="%s"/>', "r_regionkey", "r_name").alias("x"))
    nations = read("nation").select(F.format_string('<nation id="N%d" idref="R%d" name="%s"/>', "n_nationkey", "n_regionkey", "n_name").alias("x"))
    return regions.unionByName(nations).agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x")).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("<geo>"), "x", F.lit("</geo>")).alias("xml"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a small document for each region."""
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.format_string('<r k="%d">%s</r>', "r_regionkey", "r_name").alias("xml"))


DOCUMENTS = {"nations": nation_documents, "geo": geography, "regions": regions}
_held: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable):
    """What is loaded or indexed once for a folder, as a database would hold it; versions of it are made by updates."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _held:
        _held[key] = make()
    return _held[key]


def session(spark: SparkSession, sf_dir: str, text: str) -> Session:
    """A session with the collections that ``text`` names."""
    out = Session(spark)
    for name in TABLES:
        if f'"{name}"' in text:
            out.tables(sf_dir, name)
    for name, make in DOCUMENTS.items():
        if f'"{name}"' in text:
            store = once(spark, sf_dir, name, lambda name=name, make=make: Session(spark).load_xml(name, make(spark, sf_dir)))
            out.register(name, store)
    return out


def prepare(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    """What queries find loaded and indexed already, if this has run before them."""
    return {
        "load_nations": lambda: session(spark, sf_dir, '"nations"'),
        "index_by_customer": lambda: indexes(spark, sf_dir),
        "full_text_words": lambda: words(spark, sf_dir),
    }


def each(table: str, key: str, items: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """Queries of one expression for each row."""
    return {
        name: (f'for $x in collection("{table}")/row return <r k="{{$x/{key}}}" v="{{{text}}}"/>', f"SELECT {key} AS k, {sql} AS v FROM {table}")
        for name, (text, sql) in items.items()
    }


C, O, L, P, N, D = (f'collection("{t}")/row' for t in ("customer", "orders", "lineitem", "part", "nation", "documents"))  # noqa: E741
TREE = 'collection("nations")/nation'

TEXTS: dict[str, tuple[str, str]] = {
    # scans, FLWOR, predicates
    "count_where": (f"count(for $i in {L} where $i/l_extendedprice >= 40000 return $i)", "SELECT count(*) AS item FROM lineitem WHERE l_extendedprice >= 40000"),
    "flwor_at_large": (f'for $p at $i in (for $l in {L} order by $l/l_orderkey return $l) return <r i="{{$i}}" k="{{$p/l_orderkey}}"/>', "SELECT row_number() OVER (ORDER BY l_orderkey) AS i, l_orderkey AS k FROM lineitem"),
    "scan_document": ('document("region")/row', "SELECT * FROM region"),
    "join_left_theta_sum": (f'for $c in {C}[c_acctbal > 9000] let $l := for $o in {O} where $o/o_custkey >= $c/c_custkey return $o return <r k="{{$c/c_custkey}}" s="{{sum($l/o_custkey)}}" m="{{max($l/o_orderkey)}}"/>', "SELECT c_custkey AS k, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS s, max(o_orderkey) AS m FROM customer LEFT JOIN orders ON o_custkey >= c_custkey WHERE c_acctbal > 9000 GROUP BY c_custkey"),
    "instance_of_mixed": (f'for $p in {P}, $v in ($p/p_size, $p/p_name, $p/p_retailprice) where not($v instance of xs:double) return <r k="{{$p/p_partkey}}" v="{{if ($v instance of xs:integer) then concat("i", $v) else concat("s", $v)}}"/>', "SELECT p_partkey AS k, concat('i', p_size) AS v FROM part UNION ALL SELECT p_partkey, concat('s', p_name) FROM part"),
    "instance_of_occurrence": (f'for $p in {P} return <r k="{{$p/p_partkey}}" v="{{(1 to $p/p_size)[. mod 20 = 0] instance of xs:integer+}}" w="{{(1 to $p/p_size)[. mod 20 = 0] instance of xs:integer?}}"/>', "SELECT p_partkey AS k, p_size >= 20 AS v, p_size < 40 AS w FROM part"),
    "typeswitch_mixed": (f'for $c in {C} return <r k="{{$c/c_custkey}}" v="{{typeswitch (if ($c/c_acctbal > 0) then $c/c_custkey else $c/c_name) case $i as xs:integer return concat("i", $i + 1) case xs:string return "s" default return "o"}}"/>', "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN concat('i', c_custkey + 1) ELSE 's' END AS v FROM customer"),
    "treat_as_mixed": (f'sum(for $p in {P}, $v in ($p/p_name, $p/p_size) where $v instance of xs:integer return ($v treat as xs:integer))', "SELECT CAST(sum(p_size) AS BIGINT) AS item FROM part"),
    "sequence_mixed": (f'({N}/n_name, collection("region")/row/r_regionkey)', "SELECT n_name AS item FROM nation UNION ALL SELECT r_regionkey::VARCHAR FROM region"),
    "fn_id": ('for $r in id("R2", collection("geo")) return string($r/@name)', "SELECT r_name AS item FROM region WHERE r_regionkey = 2"),
    "fn_idref": ('for $n in idref("R1", collection("geo")) return string($n/@name)', "SELECT n_name AS item FROM nation WHERE n_regionkey = 1"),
    "fn_document_uri": ('for $d in collection("nations") return string(document-uri($d))', "SELECT concat('nations/', n_nationkey) AS item FROM nation"),
    "fn_static_base_uri": (f'declare base-uri "http://b/x"; for $n in {N} return <r k="{{$n/n_nationkey}}" v="{{string(static-base-uri())}}"/>', "SELECT n_nationkey AS k, 'http://b/x' AS v FROM nation"),
    "axis_descendant_attribute": ('count(collection("nations")/nation//@key)', "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS item"),
    "constructors": (f'for $n in {N} return <r t="{{string(text {{ $n/n_name }})}}" c="{{string(comment {{ $n/n_name }})}}" p="{{string(processing-instruction p {{ $n/n_name }})}}"/>', "SELECT n_name AS t, n_name AS c, n_name AS p FROM nation"),
    "scan_doc": ('doc("region")/row', "SELECT * FROM region"),
    "scan_collection_path": (f"{L}/l_quantity", "SELECT l_quantity AS item FROM lineitem"),
    "flwor_for": (f'for $p in {P} return <r k="{{$p/p_partkey}}" n="{{$p/p_name}}"/>', "SELECT p_partkey AS k, p_name AS n FROM part"),
    "flwor_at": (f'for $p at $i in (for $q in {P} order by $q/p_partkey return $q) return <r i="{{$i}}" k="{{$p/p_partkey}}"/>', "SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS k FROM part"),
    "flwor_let": (f'for $l in {L} let $v := $l/l_extendedprice * (1 - $l/l_discount) where $v > 50000 return <r k="{{$l/l_orderkey}}" v="{{$v}}"/>', "SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) AS v FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000"),
    "flwor_where": (f'for $o in {O} where $o/o_orderstatus = "F" and $o/o_totalprice > 100000 return $o/o_orderkey', "SELECT o_orderkey AS item FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"),
    "flwor_nested": (f'for $n in {N} for $c in {C} where $c/c_nationkey = $n/n_nationkey and $c/c_acctbal > 5000 return <r n="{{$n/n_name}}" c="{{$c/c_custkey}}"/>', "SELECT n_name AS n, c_custkey AS c FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 5000"),
    "path_filter_value": (f'{O}[o_orderpriority = "1-URGENT"]/o_orderkey', "SELECT o_orderkey AS item FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "pred_position": (f"(for $o in {O} order by $o/o_totalprice descending, $o/o_orderkey return $o/o_orderkey)[3]", "SELECT o_orderkey AS item FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 2"),
    "pred_range": (f"(for $o in {O} order by $o/o_totalprice descending, $o/o_orderkey return $o/o_orderkey)[position() >= 5 and position() <= 12]", "SELECT o_orderkey AS item FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8 OFFSET 4"),
    "pred_last": (f"(for $o in {O} order by $o/o_orderkey return $o/o_orderkey)[last()]", "SELECT max(o_orderkey) AS item FROM orders"),
    "pred_position_grouped": (f'for $c in {C} for $o in (for $x in {O} where $x/o_custkey = $c/c_custkey order by $x/o_totalprice descending, $x/o_orderkey return $x)[position() <= 2] return <r c="{{$c/c_custkey}}" o="{{$o/o_orderkey}}"/>', "SELECT c, o FROM (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders JOIN customer ON o_custkey = c_custkey) WHERE i <= 2"),
    "topk": (f'(for $o in {O} order by $o/o_totalprice descending, $o/o_orderkey return <o k="{{$o/o_orderkey}}" p="{{$o/o_totalprice}}"/>)[position() <= 10]', "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "subsequence_rel": (f"subsequence(for $p in {P} order by $p/p_partkey return $p/p_partkey, 11, 20)", "SELECT p_partkey AS item FROM part ORDER BY p_partkey LIMIT 20 OFFSET 10"),
    "reverse_rel": (f'for $x at $i in reverse(for $p in {P} order by $p/p_partkey return $p/p_partkey) return <r i="{{$i}}" k="{{$x}}"/>', "SELECT row_number() OVER (ORDER BY p_partkey DESC) AS i, p_partkey AS k FROM part"),
    "index_of_rel": (f'index-of(for $p in {P} order by $p/p_partkey return $p/p_brand, "Brand#12")', "SELECT i AS item FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_brand FROM part) WHERE p_brand = 'Brand#12'"),
    "remove_rel": (f"remove(for $p in {P} order by $p/p_partkey return $p/p_partkey, 2)", "SELECT p_partkey AS item FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) WHERE i <> 2"),
    "sequence_rel": (f"({N}/n_nationkey, collection(\"region\")/row/r_regionkey)", "SELECT CAST(n_nationkey AS BIGINT) AS item FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "range_flwor": ("for $x in 1 to 100 where $x mod 7 = 0 return $x * $x", "SELECT CAST(i * i AS BIGINT) AS item FROM range(1, 101) t(i) WHERE i % 7 = 0"),
    "if_then_else": (f'for $c in {C} return <r k="{{$c/c_custkey}}" v="{{if ($c/c_acctbal > 0) then "credit" else "debit"}}"/>', "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS v FROM customer"),
    "typeswitch": (f'for $c in {C} return <r k="{{$c/c_custkey}}" v="{{typeswitch ($c/c_acctbal) case xs:integer return "i" case xs:double return "d" default return "o"}}"/>', "SELECT c_custkey AS k, 'd' AS v FROM customer"),
    "quant_some": (f"for $c in {C} where some $o in {O} satisfies ($o/o_custkey = $c/c_custkey and $o/o_totalprice > 200000) return $c/c_custkey", "SELECT c_custkey AS item FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "quant_every": (f"for $c in {C} where every $o in {O}[o_custkey = $c/c_custkey] satisfies $o/o_totalprice > 20000 return $c/c_custkey", "SELECT c_custkey AS item FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 20000)"),
    "quant_value": (f'for $c in {C} return <r k="{{$c/c_custkey}}" v="{{some $o in {O}[o_custkey = $c/c_custkey] satisfies $o/o_totalprice > 300000}}"/>', "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS v FROM customer"),
    # joins
    "join_inner": (f'for $c in {C}, $o in {O} where $o/o_custkey = $c/c_custkey return <r c="{{$c/c_name}}" o="{{$o/o_orderkey}}"/>', "SELECT c_name AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey"),
    "join_three": (f'for $n in {N}, $c in {C}, $o in {O} where $c/c_nationkey = $n/n_nationkey and $o/o_custkey = $c/c_custkey and $o/o_totalprice > 400000 return <r n="{{$n/n_name}}" o="{{$o/o_orderkey}}"/>', "SELECT n_name AS n, o_orderkey AS o FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000"),
    "join_cross": ('for $r in collection("region")/row, $n in collection("nation")/row return <r r="{$r/r_name}" n="{$n/n_name}"/>', "SELECT r_name AS r, n_name AS n FROM region, nation"),
    "join_theta": (f'for $n in {N}, $s in collection("supplier")/row where $s/s_suppkey < $n/n_nationkey return <r n="{{$n/n_nationkey}}" s="{{$s/s_suppkey}}"/>', "SELECT n_nationkey AS n, s_suppkey AS s FROM nation JOIN supplier ON s_suppkey < n_nationkey"),
    "join_left_count": (f'for $c in {C} let $o := for $x in {O} where $x/o_custkey = $c/c_custkey return $x return <r k="{{$c/c_custkey}}" n="{{count($o)}}"/>', "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "join_left_theta_count": (f'for $c in {C}[c_acctbal > 5000] let $l := for $o in {O} where $o/o_totalprice < 20 * $c/c_acctbal return $o return <r k="{{$c/c_custkey}}" n="{{count($l)}}"/>', "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_totalprice < 20 * c_acctbal WHERE c_acctbal > 5000 GROUP BY c_custkey"),
    "join_semi": (f"for $c in {C} where exists({O}[o_custkey = $c/c_custkey]) return $c/c_custkey", "SELECT c_custkey AS item FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "join_anti": (f"for $c in {C} where empty({O}[o_custkey = $c/c_custkey]) return $c/c_custkey", "SELECT c_custkey AS item FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "general_eq_rel": (f"{O}[o_custkey = {C}[c_acctbal > 9000]/c_custkey]/o_orderkey", "SELECT o_orderkey AS item FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)"),
    "general_ne_rel": (f'for $n in {N} where $n/n_regionkey != {N}[n_nationkey < 2]/n_regionkey return $n/n_nationkey', "SELECT CAST(n_nationkey AS BIGINT) AS item FROM nation a WHERE EXISTS (SELECT 1 FROM nation b WHERE b.n_nationkey < 2 AND a.n_regionkey <> b.n_regionkey)"),
    "general_lt_rel": (f"for $p in {P} where $p/p_retailprice < {P}[p_size = 1]/p_retailprice return $p/p_partkey", "SELECT p_partkey AS item FROM part WHERE p_retailprice < (SELECT max(p_retailprice) FROM part WHERE p_size = 1)"),
    # aggregates
    "agg_count": (f"count({O})", "SELECT count(*) AS item FROM orders"),
    "agg_sum": (f"sum({L}/l_linenumber)", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS item FROM lineitem"),
    "agg_sum_zero": (f"sum({P}[p_size > 1000]/p_size, 7)", "SELECT CAST(coalesce(sum(p_size), 7) AS BIGINT) AS item FROM part WHERE p_size > 1000"),
    "agg_avg": (f"xs:double(avg({P}/p_size))", "SELECT round(avg(p_size), 10) AS item FROM part"),
    "agg_max_min": (f'<r hi="{{max({P}/p_retailprice)}}" lo="{{min({P}/p_retailprice)}}"/>', "SELECT max(p_retailprice) AS hi, min(p_retailprice) AS lo FROM part"),
    "distinct_values": (f"distinct-values({P}/p_brand)", "SELECT DISTINCT p_brand AS item FROM part"),
    "group_by_idiom": (f'for $k in distinct-values({L}/l_returnflag) let $g := {L}[l_returnflag = $k] return <g k="{{$k}}" n="{{count($g)}}" q="{{sum($g/l_linenumber)}}"/>', "SELECT l_returnflag AS k, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS q FROM lineitem GROUP BY l_returnflag"),
    "group_by_avg": (f'for $k in distinct-values({O}/o_orderpriority) let $g := {O}[o_orderpriority = $k] return <g k="{{$k}}" a="{{round-half-to-even(avg($g/o_totalprice), 4)}}" m="{{max($g/o_totalprice)}}"/>', "SELECT o_orderpriority AS k, round_even(avg(o_totalprice), 4) AS a, max(o_totalprice) AS m FROM orders GROUP BY o_orderpriority"),
    "bucket_counts": (f'<r low="{{count({C}[c_acctbal < 1000])}}" mid="{{count({C}[c_acctbal >= 1000 and c_acctbal < 5000])}}" high="{{count({C}[c_acctbal >= 5000])}}"/>', "SELECT count(*) FILTER (c_acctbal < 1000) AS low, count(*) FILTER (c_acctbal >= 1000 AND c_acctbal < 5000) AS mid, count(*) FILTER (c_acctbal >= 5000) AS high FROM customer"),
    "string_join_group": (f'for $r in collection("region")/row let $n := for $n in {N} where $n/n_regionkey = $r/r_regionkey order by $n/n_name return $n/n_name return <r k="{{$r/r_name}}" v="{{string-join($n, ",")}}"/>', "SELECT r_name AS k, string_agg(n_name, ',' ORDER BY n_name) AS v FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "order_by_multi": (f'for $o in {O} order by $o/o_orderpriority, $o/o_totalprice descending, $o/o_orderkey return <r p="{{$o/o_orderpriority}}" k="{{$o/o_orderkey}}"/>', "SELECT o_orderpriority AS p, o_orderkey AS k FROM orders"),
    "order_by_empty": (f'for $x at $i in (for $e in collection("events")/row order by $e/value[. > 50] empty greatest, $e/event_id return $e/event_id) return <r i="{{$i}}" k="{{$x}}"/>', "SELECT row_number() OVER (ORDER BY CASE WHEN value > 50 THEN value END NULLS LAST, event_id) AS i, event_id AS k FROM events"),
    # sets
    "union": (f"{O}/o_custkey union {C}/c_custkey", "SELECT o_custkey AS item FROM orders UNION SELECT c_custkey FROM customer"),
    "intersect": (f"{C}/c_custkey intersect {O}/o_custkey", "SELECT c_custkey AS item FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "except": (f"{C}/c_custkey except {O}/o_custkey", "SELECT c_custkey AS item FROM customer EXCEPT SELECT o_custkey FROM orders"),
    # constructors and modules
    "construct_element": (f'for $c in {C} return element person {{ attribute id {{ $c/c_custkey }}, element name {{ data($c/c_name) }}, $c/c_acctbal }}', "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer"),
    "udf_inline": (f'declare function local:net($p as xs:double, $d as xs:double) as xs:double {{ $p * (1 - $d) }}; for $l in {L} return <r k="{{$l/l_orderkey}}" v="{{local:net($l/l_extendedprice, $l/l_discount)}}"/>', "SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) AS v FROM lineitem"),
    "udf_recursive": (f'declare function local:f($x as xs:integer) as xs:integer {{ if ($x <= 1) then 1 else $x * local:f($x - 1) }}; for $p in {P} return <r k="{{$p/p_partkey}}" v="{{local:f($p/p_size mod 10)}}"/>', "SELECT p_partkey AS k, CAST(factorial((p_size % 10)::INTEGER) AS BIGINT) AS v FROM part"),
    "prolog_variable": (f"declare variable $least := 300000; {O}[o_totalprice > $least]/o_orderkey", "SELECT o_orderkey AS item FROM orders WHERE o_totalprice > 300000"),
    "ordered_unordered": (f'unordered {{ for $p in {P} where $p/p_size = 5 return $p/p_partkey }}', "SELECT p_partkey AS item FROM part WHERE p_size = 5"),
    "pragma": (f"(# se:no-light-constructors #) {{ count({P}) }}", "SELECT count(*) AS item FROM part"),
    "cell_flwor": (f'for $p in {P} return <r k="{{$p/p_partkey}}" v="{{string-join(for $w at $i in tokenize($p/p_name, " ") where string-length($w) > 4 return concat($i, ":", $w), "|")}}"/>', "SELECT p_partkey AS k, array_to_string(list_transform(list_filter(list_zip(range(1, len(string_split(p_name, ' ')) + 1), string_split(p_name, ' ')), lambda x: length(x[2]) > 4), lambda x: concat(x[1], ':', x[2])), '|') AS v FROM part"),
    "text_filter": (f'for $d in ftscan({D}, "the", "string-value") return $d/doc_id', "SELECT doc_id AS item FROM documents WHERE list_contains(regexp_split_to_array(lower(concat_ws(' ', doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR)), '[^\\p{L}\\p{N}]+'), 'the')"),
    # nodes
    "path_child": (f"for $k in {TREE}/customer/@key return xs:integer($k)", "SELECT c_custkey AS item FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "path_descendant": ('for $k in collection("nations")//order/@key return xs:integer($k)', "SELECT o_orderkey AS item FROM orders JOIN customer ON o_custkey = c_custkey"),
    "path_attr": ('for $s in collection("nations")//@status return string($s)', "SELECT o_orderstatus AS item FROM orders JOIN customer ON o_custkey = c_custkey"),
    "path_predicate": (f'for $k in {TREE}/customer[order/@status = "P"]/@key return xs:integer($k)', "SELECT DISTINCT o_custkey AS item FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'"),
    "path_predicate_position": (f"for $k in {TREE}/customer/order[1]/@key return xs:integer($k)", "SELECT min(o_orderkey) AS item FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey"),
    "path_predicate_last": (f"for $k in {TREE}/customer/order[last()]/@key return xs:integer($k)", "SELECT max(o_orderkey) AS item FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey"),
    "axis_parent": ('for $k in collection("nations")//order[@status = "F"]/../@key return xs:integer($k)', "SELECT DISTINCT o_custkey AS item FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"),
    "axis_ancestor": ('for $k in collection("nations")//order[@status = "P"]/ancestor::nation/@name return string($k)', "SELECT DISTINCT n_name AS item FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'"),
    "axis_ancestor_or_self": ('count(collection("nations")//customer/ancestor-or-self::*)', "SELECT count(*) + count(DISTINCT c_nationkey) AS item FROM customer"),
    "axis_descendant_or_self": (f"count({TREE}/customer/descendant-or-self::*)", "SELECT (SELECT 2 * count(*) FROM customer) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS item"),
    "axis_self": (f"count({TREE}/*/self::customer)", "SELECT count(*) AS item FROM customer"),
    "axis_following_sibling": (f'for $c in {TREE}/customer return <r k="{{xs:integer($c/@key)}}" n="{{count($c/following-sibling::customer)}}"/>', "SELECT c_custkey AS k, count(*) OVER (PARTITION BY c_nationkey) - row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer"),
    "axis_preceding_sibling": (f'for $c in {TREE}/customer return <r k="{{xs:integer($c/@key)}}" n="{{count($c/preceding-sibling::customer)}}"/>', "SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer"),
    "axis_following": (f'for $c in {TREE}/customer[@segment = "BUILDING"] return <r k="{{xs:integer($c/@key)}}" n="{{count($c/following::customer)}}"/>', "SELECT k, n FROM (SELECT c_custkey AS k, c_mktsegment, count(*) OVER (PARTITION BY c_nationkey) - row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE c_mktsegment = 'BUILDING'"),
    "axis_preceding": (f'for $c in {TREE}/customer[@segment = "BUILDING"] return <r k="{{xs:integer($c/@key)}}" n="{{count($c/preceding::customer)}}"/>', "SELECT k, n FROM (SELECT c_custkey AS k, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer) WHERE c_mktsegment = 'BUILDING'"),
    "node_test_kind": ('<r t="{count(collection("nations")//text())}" c="{count(collection("nations")//comment())}" e="{count(collection("nations")//element(order))}"/>', "SELECT (SELECT count(*) FROM customer) AS t, (SELECT count(*) FROM nation) AS c, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS e"),
    "node_union": (f'count({TREE}/customer[@segment = "BUILDING"] union {TREE}/customer[order/@status = "P"])', "SELECT count(*) AS item FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "node_intersect": (f'count({TREE}/customer[@segment = "BUILDING"] intersect {TREE}/customer[order/@status = "P"])', "SELECT count(*) AS item FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "node_except": (f'count({TREE}/customer[@segment = "BUILDING"] except {TREE}/customer[order/@status = "P"])', "SELECT count(*) AS item FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "node_order": (f"count(for $a in {TREE}, $b in {TREE} where $a is $b return 1)", "SELECT count(*) AS item FROM nation"),
    "node_before": (f"count(for $a in {TREE}, $b in {TREE} where $a << $b return 1)", "SELECT count(*) AS item FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey"),
    "node_names": ('for $c in collection("nations")/nation return <r n="{local-name($c)}" q="{name($c)}" u="{namespace-uri($c)}"/>', "SELECT 'nation' AS n, 'nation' AS q, '' AS u FROM nation"),
    "node_string_value": (f'for $c in {TREE}/customer return <r k="{{xs:integer($c/@key)}}" v="{{string($c/name)}}"/>', "SELECT c_custkey AS k, c_name AS v FROM customer"),
    "fn_root": (f"count(root({TREE}/customer))", "SELECT count(DISTINCT c_nationkey) AS item FROM customer"),
    "filter_entry_level": ('count(filter_entry_level(collection("nations")//*))', "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS item"),
    "is_ancestor": (f"count(for $a in {TREE}, $c in {TREE}/customer where is_ancestor($a, $c) return 1)", "SELECT count(*) AS item FROM customer"),
    "ddo": ('for $n in collection("nations")//order/ancestor::customer/@key return xs:integer($n)', "SELECT DISTINCT o_custkey AS item FROM orders JOIN customer ON o_custkey = c_custkey"),
    "pred_value": (f"{P}[p_size = 10 and p_retailprice > 1000]/p_name", "SELECT p_name AS item FROM part WHERE p_size = 10 AND p_retailprice > 1000"),
    "node_lang": (f'count({TREE}[lang("en")])', "SELECT count(*) AS item FROM nation WHERE n_nationkey % 2 = 0"),
    "node_count_children": (f'for $n in {TREE} return <r k="{{xs:integer($n/@key)}}" n="{{count($n/customer)}}" o="{{count($n//order)}}"/>', "SELECT CAST(n_nationkey AS BIGINT) AS k, count(DISTINCT c_custkey) AS n, count(o_orderkey) AS o FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey"),
}

TEXTS |= each("part", "p_partkey", {
    # strings
    "fn_compare": ('compare($x/p_name, "m")', "CAST(CASE WHEN p_name < 'm' THEN -1 WHEN p_name = 'm' THEN 0 ELSE 1 END AS BIGINT)"),
    "fn_codepoint_equal": ('codepoint-equal($x/p_brand, "Brand#12")', "p_brand = 'Brand#12'"),
    "fn_concat": ('concat($x/p_name, "-", $x/p_size)', "concat(p_name, '-', p_size)"),
    "fn_contains": ('contains($x/p_name, "bolt")', "contains(p_name, 'bolt')"),
    "fn_starts_with": ('starts-with($x/p_type, "ECO")', "starts_with(p_type, 'ECO')"),
    "fn_ends_with": ('ends-with($x/p_name, "t")', "ends_with(p_name, 't')"),
    "fn_lower_case": ("lower-case($x/p_type)", "lower(p_type)"),
    "fn_upper_case": ("upper-case($x/p_name)", "upper(p_name)"),
    "fn_normalize_space": ('normalize-space(concat("  ", $x/p_name, "   x "))', "trim(regexp_replace(concat('  ', p_name, '   x '), '[ \\t\\r\\n]+', ' ', 'g'))"),
    "fn_string_length": ("string-length($x/p_name)", "length(p_name)"),
    "fn_string_join": ('string-join(tokenize($x/p_name, " "), "+")', "array_to_string(string_split(p_name, ' '), '+')"),
    "fn_string_to_codepoints": ("sum(string-to-codepoints($x/p_name))", "CAST(list_sum(list_transform(string_split(p_name, ''), lambda c: ord(c))) AS BIGINT)"),
    "fn_codepoints_to_string": ("codepoints-to-string(reverse(string-to-codepoints($x/p_name)))", "reverse(p_name)"),
    "fn_substring": ("substring($x/p_name, 2, 3)", "substr(p_name, 2, 3)"),
    "fn_substring_negative": ("substring($x/p_name, 0, 3)", "substr(p_name, 1, 2)"),
    "fn_substring_before": ('substring-before($x/p_name, " ")', "CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, 1, strpos(p_name, ' ') - 1) ELSE '' END"),
    "fn_substring_after": ('substring-after($x/p_name, " ")', "CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END"),
    "fn_translate": ('translate($x/p_name, "abc", "AB")', "translate(p_name, 'abc', 'AB')"),
    "fn_matches": ('matches($x/p_name, "^[a-m]")', "regexp_matches(p_name, '^[a-m]')"),
    "fn_matches_flags": ('matches($x/p_type, "^eco", "i")', "regexp_matches(p_type, '(?i)^eco')"),
    "fn_replace": ('replace($x/p_name, "([aeiou])", "<$1>")', "regexp_replace(p_name, '([aeiou])', '<\\1>', 'g')"),
    "fn_tokenize": ('count(tokenize($x/p_name, "[aeiou]"))', "len(regexp_split_to_array(p_name, '[aeiou]'))"),
    "fn_normalize_unicode": ('normalize-unicode($x/p_name, "NFC")', "p_name"),
    "fn_default_collation": ("default-collation()", "'http://www.w3.org/2005/xpath-functions/collation/codepoint'"),
    # numbers
    "fn_abs": ("abs($x/p_retailprice - 1000)", "abs(p_retailprice - 1000)"),
    "fn_ceiling": ("ceiling($x/p_retailprice)", "ceil(p_retailprice)"),
    "fn_floor": ("floor($x/p_retailprice)", "floor(p_retailprice)"),
    "fn_round": ("round($x/p_size div 2.0 * -1)", "CAST(floor(p_size / 2.0 * -1 + 0.5) AS DECIMAL(38,12))"),
    "fn_round_half_even": ("round-half-to-even($x/p_retailprice, -1)", "round_even(p_retailprice, -1)"),
    "fn_number": ("number($x/p_size)", "CAST(p_size AS DOUBLE)"),
    "arith_num": ("($x/p_size + 3) * 2 - $x/p_partkey", "CAST((p_size + 3) * 2 - p_partkey AS BIGINT)"),
    "arith_div_decimal": ("xs:double($x/p_size div 4)", "p_size / 4"),
    "idiv_mod": ("(0 - $x/p_size) idiv 7 * 100 + (0 - $x/p_size) mod 7", "CAST(trunc(-p_size / 7) * 100 + (-p_size % 7) AS BIGINT)"),
    "unary_minus": ("-$x/p_size", "CAST(-p_size AS BIGINT)"),
    "value_cmp": ("$x/p_size gt 25", "p_size > 25"),
    "logic_and_or": ("$x/p_size > 10 and ($x/p_size < 20 or $x/p_retailprice > 1500)", "p_size > 10 AND (p_size < 20 OR p_retailprice > 1500)"),
    "general_eq": ("$x/p_size = (1, 5, 9)", "p_size IN (1, 5, 9)"),
    "general_ne": ("$x/p_size != (1, 1)", "p_size <> 1"),
    "general_lt": ("$x/p_size < (3, 17)", "p_size < 17"),
    "cast": ("xs:integer(string($x/p_size)) + xs:integer(\"1\")", "CAST(p_size + 1 AS BIGINT)"),
    "castable": ('substring($x/p_brand, 7) castable as xs:integer', "try_cast(substr(p_brand, 7) AS BIGINT) IS NOT NULL"),
    "cast_derived": ("xs:positiveInteger($x/p_size + 1)", "CAST(p_size + 1 AS BIGINT)"),
    "instance_of": ("$x/p_size instance of xs:integer", "true"),
    "treat_as": ("($x/p_size treat as xs:integer) + 1", "CAST(p_size + 1 AS BIGINT)"),
    "ebv": ("boolean($x/p_size mod 2)", "p_size % 2 <> 0"),
    "fn_not": ("not($x/p_size mod 2)", "p_size % 2 = 0"),
    "fn_true_false": ("if ($x/p_size > 9) then true() else false()", "p_size > 9"),
    # cell sequences
    "seq_count": ("count((1 to $x/p_size)[. mod 3 = 0])", "CAST(p_size // 3 AS BIGINT)"),
    "seq_sum": ("sum(1 to $x/p_size)", "CAST(p_size * (p_size + 1) / 2 AS BIGINT)"),
    "seq_avg": ("xs:double(avg((1, $x/p_size)))", "(1 + p_size) / 2"),
    "seq_max_min": ("max((3, $x/p_size)) - min((3, $x/p_size))", "CAST(greatest(3, p_size) - least(3, p_size) AS BIGINT)"),
    "fn_distinct_values": ("count(distinct-values(($x/p_size, 1, 1, 2)))", "CAST(CASE WHEN p_size IN (1, 2) THEN 2 ELSE 3 END AS BIGINT)"),
    "fn_index_of": ("sum(index-of((5, $x/p_size, 5), 5))", "CAST(CASE WHEN p_size = 5 THEN 6 ELSE 4 END AS BIGINT)"),
    "fn_insert_before": ('string-join(for $i in insert-before((1, 2), 2, $x/p_size) return string($i), ",")', "concat('1,', p_size, ',2')"),
    "fn_remove": ('string-join(for $i in remove((1, $x/p_size, 3), 2) return string($i), ",")', "'1,3'"),
    "fn_reverse": ('string-join(reverse(("a", $x/p_name)), ",")', "concat(p_name, ',a')"),
    "fn_subsequence": ("count(subsequence(1 to $x/p_size, 3, 4))", "CAST(greatest(0, least(4, p_size - 2)) AS BIGINT)"),
    "fn_item_at": ("item-at((7, $x/p_size, 9), 2)", "CAST(p_size AS BIGINT)"),
    "fn_empty_exists": ("empty((1 to $x/p_size)[. > 40]) and exists((1, 2))", "p_size <= 40"),
    "fn_cardinality": ("exactly-one($x/p_size) + zero-or-one($x/p_size) + count(one-or-more(($x/p_size, 1)))", "CAST(2 * p_size + 2 AS BIGINT)"),
    "fn_deep_equal": ("deep-equal((1, $x/p_size), (1, 5))", "p_size = 5"),
    "fn_unordered": ("count(unordered((1, 2, $x/p_size)))", "CAST(3 AS BIGINT)"),
    "cell_last": ("((1 to $x/p_size)[last()])", "CAST(p_size AS BIGINT)"),
    "cell_some": ("some $i in (1 to $x/p_size) satisfies $i * $i = 49", "p_size >= 7"),
    "cell_every": ("every $i in (1 to $x/p_size) satisfies $i < 30", "p_size < 30"),
    "range_down": ("count($x/p_size to 10)", "CAST(greatest(0, 11 - p_size) AS BIGINT)"),
    # names, URIs, digests
    "fn_qname": ('concat(local-name-from-QName(QName("http://u", concat("p:", $x/p_size cast as xs:string))), "|", prefix-from-QName(QName("http://u", "p:a")), "|", namespace-uri-from-QName(QName("http://u", "p:a")))', "concat(p_size, '|p|http://u')"),
    "fn_encode_for_uri": ('encode-for-uri(concat($x/p_name, "/~*"))', "concat(replace(p_name, ' ', '%20'), '%2F~%2A')"),
    "fn_iri_to_uri": ('iri-to-uri(concat("http://a/", $x/p_name, "?q=[1]"))', "concat('http://a/', replace(p_name, ' ', '%20'), '?q=[1]')"),
    "fn_escape_html_uri": ('escape-html-uri(concat($x/p_name, "&#233;"))', "concat(p_name, '%C3%A9')"),
    "fn_resolve_uri": ('resolve-uri($x/p_brand, "http://a/b/c")', "concat('http://a/b/', p_brand)"),
    "hash_md5": ("crypto:md5($x/p_name)", "upper(md5(p_name))"),
    "hash_sha1": ("crypto:sha1($x/p_name)", "upper(sha1(p_name))"),
    "hash_sha256": ("crypto:sha256($x/p_name)", "upper(sha256(p_name))"),
    "hash_digest": ('crypto:digest(" SHA256 ", $x/p_name)', "upper(sha256(p_name))"),
    "fn_resolve_qname": ('local-name-from-QName(resolve-QName(concat("xml:", $x/p_brand), $x))', "p_brand"),
    "fn_namespace_uris": ('concat(string(namespace-uri-for-prefix("xml", $x)), count(in-scope-prefixes($x)))', "'http://www.w3.org/XML/1998/namespace1'"),
    "fn_typed_value": ("typed-value($x/p_size) + string-length(string-value($x/p_name))", "CAST(p_size + length(p_name) AS BIGINT)"),
    "fn_trace": ('trace($x/p_size, "size")', "CAST(p_size AS BIGINT)"),
    "fn_node_name": ("concat(string(node-name($x)), \"/\", name($x), \"/\", local-name($x/p_size))", "'row/row/p_size'"),
    "fn_error": ('if ($x/p_size < 0) then error("E1", "negative") else $x/p_size', "CAST(p_size AS BIGINT)"),
    "se_checkpoint": ("count((se:checkpoint(), $x/p_size))", "CAST(1 AS BIGINT)"),
    "hash_sha224": ('crypto:sha224(substring("abc", 1, 3 + $x/p_size))', "'23097D223405D8228642A477BDA255B32AADBCE4BDA0B3F7E36C9DA7'"),
    "hash_sha384": ('crypto:sha384(substring("abc", 1, 3 + $x/p_size))', "'CB00753F45A35E8BB5A03D699AC65007272C32AB0EDED1631A8B605A43FF5BED8086072BA1E7CC2358BAECA134C825A7'"),
    "hash_sha512": ('crypto:sha512(substring("abc", 1, 3 + $x/p_size))', "'DDAF35A193617ABACC417349AE20413112E6FA4E89A97EA20A9EEEE64B55D39A2192992A274FC1A836BA3C23A3FEEBBD454D4423643CE80E2A9AC94FA54CA49F'"),
    "fn_data_string": ("concat(string($x/p_size), data($x/p_name))", "concat(p_size, p_name)"),
    "fn_nilled": ("nilled($x)", "false"),
    "fn_base_uri": ('string(base-uri($x))', "'part'"),
    "se_get_property": ('se:get-property("$user")', "'SYSTEM'"),
    "doc_available": ('doc-available("part") and not(col-available("none"))', "true"),
})

TEXTS |= each("orders", "o_orderkey", {
    "date_parts": ("year-from-dateTime($x/o_orderdate) * 10000 + month-from-dateTime($x/o_orderdate) * 100 + day-from-dateTime($x/o_orderdate)", "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)"),
    "date_parts_of_date": ("year-from-date(xs:date($x/o_orderdate)) * 100 + month-from-date(xs:date($x/o_orderdate)) + day-from-date(xs:date($x/o_orderdate))", "year(o_orderdate) * 100 + month(o_orderdate) + day(o_orderdate)"),
    "time_parts": ("hours-from-dateTime($x/o_orderdate) * 60 + minutes-from-dateTime($x/o_orderdate)", "hour(o_orderdate) * 60 + minute(o_orderdate)"),
    "seconds_part": ("xs:double(seconds-from-dateTime($x/o_orderdate + xs:dayTimeDuration('PT1.5S')))", "second(o_orderdate + INTERVAL 1.5 SECOND) + 0.5"),
    "arith_date": ('string(xs:date($x/o_orderdate) + xs:yearMonthDuration("P1M"))', "strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    "arith_date_diff": ('days-from-duration($x/o_orderdate - xs:dateTime("1990-01-01T00:00:00"))', "date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)"),
    "duration_parts": ('hours-from-duration(xs:dayTimeDuration("P3DT10H") ) + days-from-duration(xs:dayTimeDuration("P3DT10H")) + months-from-duration(xs:yearMonthDuration("P2Y5M")) + years-from-duration(xs:yearMonthDuration("P2Y5M")) + minutes-from-duration(xs:dayTimeDuration("PT7M"))', "CAST(27 AS BIGINT)"),
    "duration_arith": ('string((xs:dayTimeDuration("P1DT12H") + xs:dayTimeDuration("PT12H")) * 2)', "'P4D'"),
    "time_of_day": ('hours-from-time(xs:time("13:20:10")) * 3600 + minutes-from-time(xs:time("13:20:10")) * 60 + xs:integer(seconds-from-time(xs:time("13:20:10")))', "CAST(48010 AS BIGINT)"),
    "timezone_adjust": ('string(adjust-dateTime-to-timezone(xs:dateTime("2002-03-07T10:00:00-07:00"), xs:dayTimeDuration("-PT10H")))', "'2002-03-07T07:00:00-10:00'"),
    "timezone_from": ('string(timezone-from-dateTime(xs:dateTime("1999-05-31T13:20:00-05:00")))', "'-PT5H'"),
    "timezone_of_date_and_time": ('concat(string(timezone-from-date(xs:date("1999-05-31-05:00"))), string(timezone-from-time(xs:time("13:20:00Z"))), string(adjust-date-to-timezone(xs:date("2002-03-07-07:00"), xs:dayTimeDuration("-PT10H"))), string(adjust-time-to-timezone(xs:time("10:00:00-07:00"), xs:dayTimeDuration("-PT10H"))))', "'-PT5HPT0S2002-03-06-10:0007:00:00-10:00'"),
    "seconds_of_duration": ('xs:double(seconds-from-duration(xs:dayTimeDuration("PT1M12.5S")))', "CAST(12.5 AS DOUBLE)"),
    "current_values": ("current-date() eq xs:date(current-dateTime()) and string-length(string(current-time())) gt 7", "true"),
    "fn_date_time": ('string(dateTime(xs:date("1999-12-31"), xs:time("12:00:00")))', "'1999-12-31T12:00:00'"),
    "string_of_datetime": ("string($x/o_orderdate)", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
    "current_stable": ("current-dateTime() eq current-dateTime() and implicit-timezone() eq xs:dayTimeDuration('PT0S')", "true"),
    "compare_dates": ('$x/o_orderdate lt xs:dateTime("1996-01-01T00:00:00")', "o_orderdate < TIMESTAMP '1996-01-01'"),
})


def indexes(spark: SparkSession, sf_dir: str) -> Session:
    def make():
        s = session(spark, sf_dir, '"orders" "customer"')
        s.xquery('CREATE INDEX "by_customer" ON collection("orders")/row BY o_custkey AS xs:integer')
        return s

    return once(spark, sf_dir, "index by_customer", make)


def words(spark: SparkSession, sf_dir: str) -> Session:
    def make():
        s = session(spark, sf_dir, '"documents"')
        s.xquery('CREATE FULL-TEXT INDEX "words" ON collection("documents")/row/text TYPE "string-value"')
        return s

    return once(spark, sf_dir, "full-text words", make)


def indexed(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: indexes(spark, sf_dir).xquery(query)


def searched(query: str, index: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the index ``words``, or over one that ``index`` (the rest of a statement) makes."""

    def run(spark, sf_dir):
        if index is None:
            return words(spark, sf_dir).xquery(query)
        s = session(spark, sf_dir, '"documents"')
        s.xquery(f'CREATE FULL-TEXT INDEX "own" ON {index}')
        return s.xquery(query)

    return run


def ft_maintained(spark, sf_dir):
    s = session(spark, sf_dir, '"nations"')
    s.xquery('CREATE FULL-TEXT INDEX "t" ON collection("nations")/nation TYPE "delimited-value"')
    s.xquery('UPDATE insert <note>zebra crossing</note> into collection("nations")/nation/customer[@segment = "BUILDING"]')
    return s.xquery('for $d in ftindex-scan("t", "zebra") return $d/doc_id')


def index_maintained(spark, sf_dir):
    s = session(spark, sf_dir, '"nations"')
    s.xquery('CREATE INDEX "s" ON collection("nations")/nation/customer BY @segment AS xs:string USING "bstrie"')
    s.xquery('UPDATE delete collection("nations")/nation/customer[@segment = "BUILDING"]')
    return s.xquery('index-keys("s")')


def document_in_collection(spark, sf_dir):
    return session(spark, sf_dir, '"nations"').xquery('for $k in doc("7", "nations")/nation/customer/@key return xs:integer($k)')


def system_documents(spark, sf_dir):
    s = session(spark, sf_dir, '"region" "nation"')
    return s.xquery('for $c in doc("$collections")/row return <r name="{$c/name}" info="{$c/info}"/>')


def bulk_load(spark, sf_dir):
    s = session(spark, sf_dir, "")
    folder = s.fresh_folder("geo-xml")
    geography(spark, sf_dir).select("xml").coalesce(1).write.text(folder)
    s.xquery(f'LOAD "{folder}" "geo"')
    return s.xquery('for $n in doc("geo")/geo/nation/@name return string($n)')


def serialised_sxml(spark, sf_dir):
    from xylem.sources.nodes import serialised

    return serialised(session(spark, sf_dir, '"regions"').catalog.open("regions").nodes, "sxml")


def definitions(spark, sf_dir):
    s = session(spark, sf_dir, "")
    for statement in ('CREATE COLLECTION "a"', 'CREATE COLLECTION "b"', 'CREATE DOCUMENT "d" IN COLLECTION "a"', 'CREATE DOCUMENT "e" IN COLLECTION "a"', 'RENAME COLLECTION "a" INTO "c"', 'DROP DOCUMENT "e" IN COLLECTION "c"', 'DROP COLLECTION "b"'):
        s.xquery(statement)
    return s.xquery("RETRIEVE METADATA FOR COLLECTIONS").select("name").unionByName(s.xquery("RETRIEVE METADATA FOR DOCUMENTS").select(F.concat_ws("/", "info", "name").alias("name")))


def metadata_statistics(spark, sf_dir):
    s = session(spark, sf_dir, '"region" "nation" "part"')
    return s.xquery("RETRIEVE METADATA FOR COLLECTIONS WITH STATISTICS").select("name", "size")


def table_schema(spark, sf_dir):
    return session(spark, sf_dir, '"region"').xquery('RETRIEVE DESCRIPTIVE SCHEMA FOR COLLECTION "region"')


def permissions(spark, sf_dir):
    """What a user may read before and after roles are granted and revoked."""
    from xylem.functions.values import StaticError

    s = session(spark, sf_dir, '"region" "nation"')
    rows = []

    def attempt(step: str) -> None:
        s.security.login("u", "p")
        for name in ("region", "nation"):
            try:
                rows.append((step, name, s.xquery(f'count(collection("{name}")/row)').first()[0]))
            except StaticError as e:
                rows.append((step, name, -int(e.code[2:])))
        s.security.user = "SYSTEM"

    s.xquery('CREATE USER "u" WITH PASSWORD "p"')
    attempt("created")
    for statement in ('CREATE ROLE "reader"', 'GRANT QUERY ON COLLECTION "region" TO "reader"', 'GRANT reader TO "u"'):
        s.xquery(statement)
    attempt("granted")
    s.xquery('REVOKE reader FROM "u"')
    attempt("revoked")
    return spark.createDataFrame(rows, "step string, name string, n long")


def triggered_all(spark, sf_dir):
    """Triggers after an insertion, before a replacement, for a statement, and one that was dropped."""
    s = session(spark, sf_dir, '"nations"')
    s.xquery('CREATE TRIGGER "log" AFTER INSERT ON collection("nations")/nation FOR EACH STATEMENT DO { UPDATE insert <log/> preceding collection("nations")/nation/plain ; }')
    s.xquery('CREATE TRIGGER "none" AFTER INSERT ON collection("nations")/nation FOR EACH STATEMENT DO { UPDATE insert <never/> into collection("nations")/nation ; }')
    s.xquery('DROP TRIGGER "none"')
    s.xquery('CREATE TRIGGER "gone" BEFORE DELETE ON collection("nations")/nation FOR EACH STATEMENT DO { UPDATE rename collection("nations")/nation/plain on kept ; }')
    s.triggers["log"].action = lambda own, new, run=s.triggers["log"].action: None if own.depth > 1 else run(own, new)
    s.xquery('UPDATE insert <plain/> into collection("nations")/nation')
    s.xquery('UPDATE delete collection("nations")/nation/customer[@segment = "BUILDING"]')
    return s.xquery('<r log="{count(collection("nations")//log)}" kept="{count(collection("nations")//kept)}" never="{count(collection("nations")//never)}" left="{count(collection("nations")//customer)}"/>')


def sql_statements(spark, sf_dir):
    """sql:connect, prepare, execute, exec-update, commit, rollback and close through the language."""
    import sqlite3

    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("xylem_nation")
    s = Session(spark)
    one = lambda text: s.xquery(text).first()[0]
    s.connector.drivers["sqlite:"] = held = sqlite3.connect(":memory:")
    held.execute("CREATE TABLE t (a INTEGER)")
    db = one('sql:connect("sqlite:")')
    put = one(f'sql:exec-update("{db}", "INSERT INTO t VALUES (?), (?)", 1, 2)')
    one(f'sql:commit("{db}")')
    one(f'sql:exec-update("{db}", "INSERT INTO t VALUES (3)")')
    one(f'sql:rollback("{db}")')
    kept = held.execute("SELECT count(*) FROM t").fetchone()[0]
    views = one('sql:connect("spark:")')
    ready = one(f'sql:prepare("{views}", "SELECT n_name FROM xylem_nation WHERE n_regionkey = ?")')
    rows = s.xquery(f'for $t in sql:execute("{ready}", "", 2) return <r n="{{$t/n_name}}" put="{put}" kept="{kept}"/>')
    closed = one(f'sql:close("{db}")')
    return rows.withColumn("closed", F.lit(closed))


def exported(spark, sf_dir):
    """A session's collections, indexes and users, written to files and read into another session."""
    s = session(spark, sf_dir, '"nations"')
    s.xquery('CREATE INDEX "by_segment" ON collection("nations")/nation/customer BY @segment AS xs:string')
    s.xquery('CREATE USER "u" WITH PASSWORD "p"')
    s.export(folder := s.fresh_folder("export"))
    other = Session(spark).restore(folder)
    found = other.xquery('<r orders="{count(collection("nations")//order)}" indexed="{count(index-scan("by_segment", "BUILDING", "EQ"))}"/>')
    return found.withColumn("users", F.lit(len(other.security.users)).cast("long"))


def profile(spark, sf_dir):
    return session(spark, sf_dir, '"nation"').xquery(f"PROFILE {N}/n_name").where("part = 'rows'").select(F.col("text").alias("rows"))


def library_modules(spark, sf_dir):
    """A module that is loaded, replaced and dropped."""
    from xylem.functions.values import StaticError

    s = session(spark, sf_dir, '"nation"')
    s.load_module('module namespace m = "http://m"; declare function m:f($x) { $x };')
    s.load_module('module namespace m = "http://m"; declare function m:f($x) { $x * 3 };', replace=True)
    out = s.xquery(f'import module namespace m = "http://m"; for $n in {N} return m:f($n/n_nationkey)')
    s.xquery('DROP MODULE "http://m"')
    try:
        s.xquery('import module namespace m = "http://m"; m:f(1)')
    except StaticError:
        return out
    raise AssertionError("the module wasn't dropped")


def updated(statement: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        s = session(spark, sf_dir, '"nations"')
        s.xquery(statement)
        return s.xquery(query)

    return run


def triggered(spark, sf_dir):
    s = session(spark, sf_dir, '"nations"')
    s.xquery('CREATE TRIGGER "mark" BEFORE INSERT ON collection("nations")/nation FOR EACH NODE DO { <marked by="trigger"/> ; }')
    s.xquery('UPDATE insert <plain/> into collection("nations")/nation')
    return s.xquery('<r m="{count(collection("nations")//marked)}" p="{count(collection("nations")//plain)}"/>')


def sql_execute(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("xylem_nation")
    s = Session(spark)
    handle = s.connector.connect("spark:")
    return s.xquery(f'for $t in sql:execute("{handle}", "SELECT n_name, n_regionkey FROM xylem_nation WHERE n_nationkey < ?", 10) where $t/@n_regionkey > 1 return <r n="{{$t/@n_name}}"/>')


def external_scalar(spark, sf_dir):
    s = session(spark, sf_dir, '"part"')
    s.register_function("twice", lambda c: c * 2, "integer")
    return s.xquery(f'declare function twice($x as xs:integer) as xs:integer external; for $p in {P} return <r k="{{$p/p_partkey}}" v="{{twice($p/p_size)}}"/>')


def module_function(spark, sf_dir):
    s = session(spark, sf_dir, '"part"')
    s.load_module('module namespace m = "http://m"; declare function m:area($x as xs:integer) as xs:integer { $x * $x };')
    return s.xquery(f'import module namespace m = "http://m"; for $p in {P} return <r k="{{$p/p_partkey}}" v="{{m:area($p/p_size)}}"/>')


def serialised_rows(spark, sf_dir):
    s = session(spark, sf_dir, '"nation"')
    return s.xml(f'for $n in {N} return <n k="{{$n/n_nationkey}}"><name>{{data($n/n_name)}}</name></n>')


def descriptive_schema(spark, sf_dir):
    return session(spark, sf_dir, '"nations"').xquery('RETRIEVE DESCRIPTIVE SCHEMA FOR COLLECTION "nations"').select("path", "nodes")


def score_sql(words: list[str], boosts: list[int] | None = None) -> str:
    listed = ", ".join(f"('{w}', {b})" for w, b in zip(words, boosts or [1] * len(words), strict=True))
    body = "concat_ws(' ', text)"
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({body}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, t, b, len(list_filter(ws, lambda x: x = t)) AS n, len(ws) AS size FROM w, (VALUES {listed}) u(t, b)),
f AS (SELECT t, count(*) FILTER (n > 0) AS df FROM n GROUP BY t), total AS (SELECT count(*) FILTER (len(ws) > 0) AS docs FROM w)
SELECT doc_id AS d, round(sum(sqrt(n * b) / sqrt(size) * power(1 + ln(docs / (df + 1)), 2)), 6) AS s FROM n JOIN f USING (t), total
GROUP BY doc_id HAVING count(*) FILTER (n > 0) = {len(words)}"""


CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "index_scan_eq": (indexed('for $o in index-scan("by_customer", 5, "EQ") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey = 5"),
    "index_scan_ge": (indexed('for $o in index-scan("by_customer", 1000, "GE") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey >= 1000"),
    "index_scan_between": (indexed('for $o in index-scan-between("by_customer", 10, 20, "HINTL") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey >= 10 AND o_custkey < 20"),
    "index_scan_lt": (indexed('for $o in index-scan("by_customer", 7, "LT") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey < 7"),
    "index_scan_le": (indexed('for $o in index-scan("by_customer", 7, "LE") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey <= 7"),
    "index_scan_gt": (indexed('for $o in index-scan("by_customer", 1400, "GT") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey > 1400"),
    "index_scan_int": (indexed('for $o in index-scan-between("by_customer", 10, 20, "INT") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey > 10 AND o_custkey < 20"),
    "index_scan_seg": (indexed('for $o in index-scan-between("by_customer", 10, 20, "SEG") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey BETWEEN 10 AND 20"),
    "index_scan_hintr": (indexed('for $o in index-scan-between("by_customer", 10, 20, "HINTR") return $o/o_orderkey'), "SELECT o_orderkey AS item FROM orders WHERE o_custkey > 10 AND o_custkey <= 20"),
    "index_maintained": (index_maintained, "SELECT DISTINCT c_mktsegment AS item FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "index_keys": (indexed('index-keys("by_customer")'), "SELECT DISTINCT o_custkey AS item FROM orders"),
    "index_join": (indexed(f'for $c in {C}[c_acctbal > 9000] for $o in index-scan("by_customer", $c/c_custkey, "EQ") return <r c="{{$c/c_custkey}}" o="{{$o/o_orderkey}}"/>'), "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000"),
    "ft_and": (searched('for $d in ftindex-scan("words", "trash clown") return $d/doc_id'), "SELECT doc_id AS item FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['trash', 'clown'])"),
    "ft_or": (searched('for $d in ftindex-scan("words", "trash OR moron") return $d/doc_id'), "SELECT doc_id AS item FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['trash', 'moron'])"),
    "ft_phrase": (searched("""for $d in ftindex-scan("words", '"of the"') return $d/doc_id"""), "SELECT doc_id AS item FROM documents WHERE contains(concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' '), ' '), ' of the ')"),
    "ft_wildcard": (searched('for $d in ftindex-scan("words", "disgust*") return $d/doc_id'), "SELECT doc_id AS item FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'disgust'))) > 0"),
    "ft_score": (searched('for $d in ftindex-scan("words", "trash clown") return <r d="{$d/doc_id}" s="{round-half-to-even($d/score, 6)}"/>'), score_sql(["trash", "clown"])),
    "ft_boost": (searched('for $d in ftindex-scan("words", "trash:4 clown") return <r d="{$d/doc_id}" s="{round-half-to-even($d/score, 6)}"/>'), score_sql(["trash", "clown"], [4, 1])),
    "ft_window_scan": (searched('for $d in ftwindex-scan("words", "trash clown") return $d/doc_id'), "SELECT doc_id AS item FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['trash', 'clown'])"),
    "ft_nosort": (searched('for $d in ftindex-scan("words", "(trash OR moron) clown", "nosort") return $d/doc_id'), "SELECT doc_id AS item FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['trash', 'moron']) AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'clown')"),
    "ft_stem": (searched('for $d in ftindex-scan("own", "mornings letter") return $d/doc_id', 'collection("documents")/row/text TYPE "string-value" WITH OPTIONS "stemming=en"'), "SELECT doc_id AS item FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['morning', 'mornings']) AND list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['letter', 'letters', 'lettered', 'lettering'])"),
    "ft_tilde": (searched('for $d in ftindex-scan("own", "letters~ morning") return $d/doc_id', 'collection("documents")/row/text TYPE "string-value" WITH OPTIONS "stemming=en,stemtype=both"'), "SELECT doc_id AS item FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'morning') AND list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['letter', 'letters', 'lettered', 'lettering'])"),
    "ft_contains": (searched('for $d in ftindex-scan("own", "lang CONTAINS de") return $d/doc_id', 'collection("documents")/row TYPE "xml"'), "SELECT doc_id AS item FROM documents WHERE list_contains(regexp_split_to_array(lower(lang), '[^\\p{L}\\p{N}]+'), 'de')"),
    "ft_scan_contains": (lambda spark, sf_dir: session(spark, sf_dir, '"documents"').xquery(f"""for $d in ftscan({D}, "source CONTAINS forum", "xml") return $d/doc_id"""), "SELECT doc_id AS item FROM documents WHERE list_contains(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), 'forum')"),
    "ft_maintained": (ft_maintained, "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS item FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "ft_highlight_blocks": (searched(f'for $d in {D} where contains($d/text, "moron") return <r k="{{$d/doc_id}}" v="{{contains(fthighlight-blocks("moron", $d/text), "<hit>moron</hit>")}}"/>'), "SELECT doc_id AS k, regexp_matches(text, '\\bmoron\\b') AS v FROM documents WHERE contains(text, 'moron')"),
    "ft_dictionary": (searched('count(ftindex-dict("words"))'), "SELECT count(DISTINCT x) AS item FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS x FROM documents) WHERE x <> ''"),
    "ft_count_only": (searched('for $d in ftindex-scan("words", "the", "count_only") return $d/count'), "SELECT count(*) AS item FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the')"),
    "ft_highlight": (searched(f'for $d in {D} where contains($d/text, "moron") return <r k="{{$d/doc_id}}" v="{{string-length(fthighlight("moron", $d/text)) - string-length($d/text)}}"/>'), "SELECT doc_id AS k, 11 * len(regexp_extract_all(text, '(?i)\\bmoron\\b')) AS v FROM documents WHERE contains(text, 'moron')"),
    "upd_insert": (updated('UPDATE insert <note>x</note> into collection("nations")/nation/customer[@segment = "BUILDING"]', 'for $k in collection("nations")//customer[note]/@key return xs:integer($k)'), "SELECT c_custkey AS item FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "upd_insert_preceding": (updated('UPDATE insert <gap/> preceding collection("nations")/nation/customer', '<r n="{count(collection("nations")/nation/gap)}" f="{count(collection("nations")/nation/customer/preceding-sibling::gap)}"/>'), "SELECT count(*) AS n, count(*) AS f FROM customer"),
    "upd_insert_following": (updated('UPDATE insert <gap/> following collection("nations")/nation/customer', '<r n="{count(collection("nations")/nation/gap)}" f="{count(collection("nations")/nation/customer/following-sibling::gap)}"/>'), "SELECT count(*) AS n, count(*) AS f FROM customer"),
    "upd_delete": (updated('UPDATE delete collection("nations")//order[@status = "F"]', 'for $k in collection("nations")//order/@key return xs:integer($k)'), "SELECT o_orderkey AS item FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'"),
    "upd_delete_undeep": (updated('UPDATE delete_undeep collection("nations")/nation/customer', '<r c="{count(collection("nations")//customer)}" o="{count(collection("nations")/nation/order)}"/>'), "SELECT 0::BIGINT AS c, count(*) AS o FROM orders JOIN customer ON o_custkey = c_custkey"),
    "upd_replace": (updated('UPDATE replace $n in collection("nations")/nation/customer/name with <title>{$n/text()}</title>', '<r n="{count(collection("nations")//name)}" t="{count(collection("nations")//title)}"/>'), "SELECT 0::BIGINT AS n, count(*) AS t FROM customer"),
    "upd_rename": (updated('UPDATE rename collection("nations")//order on purchase', '<r o="{count(collection("nations")//order)}" p="{count(collection("nations")//purchase)}"/>'), "SELECT 0::BIGINT AS o, count(*) AS p FROM orders JOIN customer ON o_custkey = c_custkey"),
    "trigger_before_insert": (triggered, "SELECT count(*) AS m, 0::BIGINT AS p FROM nation"),
    "trigger_all": (triggered_all, "SELECT (SELECT count(*) FROM nation) AS log, (SELECT count(*) FROM nation) AS kept, 0::BIGINT AS never, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS left"),
    "doc_in_collection": (document_in_collection, "SELECT c_custkey AS item FROM customer WHERE c_nationkey = 7"),
    "system_documents": (system_documents, "SELECT * FROM (VALUES ('region', 'table'), ('nation', 'table')) t(name, info)"),
    "bulk_load": (bulk_load, "SELECT n_name AS item FROM nation"),
    "serialise_sxml": (serialised_sxml, "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, concat('(*TOP* (r (@ (k \"', r_regionkey, '\")) \"', r_name, '\"))') AS xml FROM region"),
    "definitions": (definitions, "SELECT * FROM (VALUES ('c'), ('c/d')) t(name)"),
    "metadata_statistics": (metadata_statistics, "SELECT 'region' AS name, count(*) AS size FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part"),
    "table_schema": (table_schema, "SELECT * FROM (VALUES ('/row/r_regionkey', 'int'), ('/row/r_name', 'string')) t(path, kind)"),
    "permissions": (permissions, "SELECT step, t.name, CASE WHEN step = 'granted' AND t.name = 'region' THEN (SELECT count(*) FROM region) ELSE -3065 END AS n FROM (VALUES ('created'), ('granted'), ('revoked')) s(step), (VALUES ('region'), ('nation')) t(name)"),
    "sql_statements": (sql_statements, "SELECT n_name AS n, '2' AS put, '2' AS kept, true AS closed FROM nation WHERE n_regionkey = 2"),
    "fn_test": (lambda spark, sf_dir: session(spark, sf_dir, '"nations" "region"').xquery('for $r in collection("region")/row return <r k="{$r/r_regionkey}" v="{test(collection("nations"))}"/>'), "SELECT r_regionkey AS k, true AS v FROM region"),
    "export_restore": (exported, "SELECT count(*) AS orders, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS indexed, 1::BIGINT AS users FROM orders JOIN customer ON o_custkey = c_custkey"),
    "profile": (profile, "SELECT count(*)::VARCHAR AS rows FROM nation"),
    "library_modules": (library_modules, "SELECT CAST(3 * n_nationkey AS BIGINT) AS item FROM nation"),
    "sql_execute": (sql_execute, "SELECT n_name AS n FROM nation WHERE n_nationkey < 10 AND n_regionkey > 1"),
    "udf_external": (external_scalar, "SELECT p_partkey AS k, CAST(2 * p_size AS BIGINT) AS v FROM part"),
    "module_function": (module_function, "SELECT p_partkey AS k, CAST(p_size * p_size AS BIGINT) AS v FROM part"),
    "serialise_xml": (serialised_rows, "SELECT concat('<n k=\"', n_nationkey, '\"><name>', n_name, '</name></n>') AS xml FROM nation"),
    "descriptive_schema": (descriptive_schema, """
        SELECT '/nation' || p AS path, count(*) AS nodes FROM nation, unnest(['', '/@key', '/@name', '/@xml:lang', '/comment()']) t(p) GROUP BY p
        UNION ALL SELECT '/nation/customer' || p, count(*) FROM customer, unnest(['', '/@key', '/@segment', '/name', '/name/text()']) t(p) GROUP BY p
        UNION ALL SELECT '/nation/customer/order' || p, count(*) FROM orders JOIN customer ON o_custkey = c_custkey, unnest(['', '/@key', '/@status']) t(p) GROUP BY p"""),
}


def text_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir, text).xquery(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: text_query(text) for name, (text, _) in TEXTS.items()} | {name: run for name, (run, _) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: re.sub(r"\s+", " ", sql).strip() for name, (_, sql) in TEXTS.items()} | {name: re.sub(r"\s+", " ", sql).strip() for name, (_, sql) in CALLS.items() if sql}
