"""Registered queries over exports, limits, stored counts and small functions, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import predictions as pr
from tessera.functions import scalars as sc
from tessera.operators import artifacts as ar
from tessera.operators import exports as ex
from tessera.operators import filters as fl
from tessera.operators import rowsets as rs
from tessera.operators import summaries as sm
from tessera.plans import tables_queries as tq
from tessera.plans.graph_queries import _COS, _degrees, _edges
from tessera.plans.standins import subjects, table, values
from tessera.plans.tables_queries import V, h
from tessera.sources import tables as src
from tessera.sources.shared import new_path

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(f"WITH {_COS} SELECT concat_ws(chr(9), 'similarity-edge-' || row_number() OVER (ORDER BY source, target), source, target, '', '', printf('%.6f', similarity), origin, '', '', '', mutual, '', '', '', '', '', '', '', '', '', '', '', '') AS value FROM edges")
def s10_edge_lines(s, d):
    edges = _edges(s, d).withColumnsRenamed({"origin": "edge_source", "mutual": "mutual_knn"})
    return src.tsv_lines(ex.edge_table(edges), ex.EDGE_COLUMNS, 6)


@query(f"WITH {_COS}, g AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) SELECT vec_id || chr(9) || coalesce(degree, 0) AS value FROM embeddings LEFT JOIN g ON node = vec_id")
def s10_node_lines(s, d):
    return src.tsv_lines(ex.degree_table(table(s, d, "embeddings"), "vec_id", _degrees(s, d)), ["row_id", "degree"])


@query(f"WITH {V} SELECT c_custkey AS subject_id, c_mktsegment AS series, count(endpoint_id) AS endpoints FROM customer LEFT JOIN v ON subject_id = c_custkey GROUP BY 1, 2")
def s13_snapshot(s, d):
    folder = new_path(s, "snapshot")
    src.export_snapshot(s, {"subjects": subjects(s, d), "values": values(s, d)}, folder)
    kept, _ = src.open_snapshot(s, folder)
    return kept["subjects"].join(kept["values"], "subject_id", "left").groupBy("subject_id", "series").agg(F.count("endpoint_id").alias("endpoints"))


@query("WITH n AS (SELECT (SELECT count(*) FROM part) AS p), x AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS r FROM customer) SELECT 'p' || p_partkey AS id, p_name AS structure FROM part UNION ALL SELECT 's' || (p + r), c_name FROM x, n")
def s19_registered(s, d):
    held = table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("structure"))
    new = table(s, d, "customer").select(F.lit(None).cast("string").alias("id"), F.col("c_name").alias("structure"))
    return src.register(held, src.with_ids(held, new))


@query("WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN t USING (l_orderkey) WHERE total - l_quantity >= 20 AND l_quantity >= 5 AND l_quantity <= 30 AND l_quantity <= total * 0.5")
def f15_fragment_sizes(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    met = line.join(line.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")), "l_orderkey")
    size = F.col("l_quantity")
    return met.where(fl.fragment_sizes(F.col("total") - size, size, F.col("total"), 20, 5, 30, 0.5)).drop("total")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice <= 1500")
def f16_limits(s, d):
    return table(s, d, "part").where(fl.within_limits({"p_size": (5, 30), "p_retailprice": (None, 1500.0)})).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT l_linenumber AS cut_count, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY 1, 2")
def f23_cuts(s, d):
    return table(s, d, "lineitem").where(fl.with_cuts(F.col("l_linenumber"), [1, 3])).groupBy(F.col("l_linenumber").alias("cut_count"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH c AS (SELECT l_returnflag, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT *, {h('n / sum(n) OVER (PARTITION BY l_returnflag)')} AS fraction FROM c")
def a16_label_frequencies(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return sm.label_frequencies(rows, "l_returnflag", "p_brand")


@query("WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY p_type) AS BIGINT) AS kind_total, CAST(row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS INTEGER) AS rank FROM c")
def a25_signature_summary(s, d):
    return sm.signature_summary(table(s, d, "part"), "p_type", "p_brand")


@query("WITH p AS (SELECT p_brand AS run_id, count(*) AS pair_count FROM part WHERE p_size > 10 GROUP BY 1), t AS (SELECT p_brand AS run_id, count(*) AS stats_count FROM part WHERE p_size > 40 GROUP BY 1), r AS (SELECT DISTINCT p_brand AS run_id FROM part) SELECT run_id, coalesce(pair_count, 0) AS pair_count, coalesce(stats_count, 0) AS stats_count FROM r LEFT JOIN p USING (run_id) LEFT JOIN t USING (run_id)")
def a28_stored_run_counts(s, d):
    part = table(s, d, "part").withColumnRenamed("p_brand", "run_id")
    return ar.store_run_counts(part.select("run_id").distinct(), part.where("p_size > 10"), part.where("p_size > 40"), new_path(s, "runs")).select("run_id", "pair_count", "stats_count")


@query("SELECT l_orderkey, " + ", ".join(f"min({c}) FILTER (l_linenumber = {p}) AS \"{p}_{n}\"" for p in (1, 2, 3) for n, c in (("label", "l_returnflag"), ("id", "l_partkey"), ("text", "l_linestatus"))) + " FROM lineitem GROUP BY 1")
def a32_terminal_columns(s, d):
    return src.wide_terms(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", [1, 2, 3], {"label": "l_returnflag", "id": "l_partkey", "text": "l_linestatus"})


_PREDICTED = tq.SQL["l7_reference_prediction"]


@query(f"SELECT p_partkey AS row_id, p_partkey AS ordinal FROM ({_PREDICTED}) WHERE potency_status = 'OUT_OF_DOMAIN'")
def l9_out_of_domain(s, d):
    return pr.with_status(tq._predicted(s, d), "p_partkey", "potency_status", "OUT_OF_DOMAIN")


@query(f"SELECT l_orderkey, l_linenumber, potency_value AS run1_value, potency_status AS run1_status FROM lineitem LEFT JOIN ({_PREDICTED}) ON p_partkey = l_partkey")
def l9_published_columns(s, d):
    run = tq._predicted(s, d).select(F.col("p_partkey").alias("l_partkey"), *[F.col(f"potency_{c}").alias(c) for c in ("value", "uncertainty", "applicability", "status")])
    return pr.published(table(s, d, "lineitem"), run, "l_partkey", "run1").select("l_orderkey", "l_linenumber", "run1_value", "run1_status")


@query("SELECT p_partkey FROM part WHERE substr(sha256(p_partkey || '|11'), 1, 8) >= '40000000'")
def t11_dropped_share(s, d):
    return table(s, d, "part").where(~rs.hash_share(F.col("p_partkey"), 11, 0.25)).select("p_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def t6_numbered(s, d):
    return rs.numbered(table(s, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@query("SELECT p_partkey, sha256(p_name || chr(0) || p_brand || chr(0)) AS nul, sha256(p_name || '|' || p_brand || '|') AS bar FROM part")
def x_terminated_digests(s, d):
    names = [F.col("p_name"), F.col("p_brand")]
    return table(s, d, "part").select("p_partkey", sc.terminated_digest(*names).alias("nul"), sc.terminated_digest(*names, end="|").alias("bar"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 3 ELSE 1 END AS own, CASE WHEN event_type = 'click' THEN 3 ELSE 2 END AS clicks, CASE WHEN event_type = 'click' THEN 2 ELSE 3 END AS entries FROM events")
def x_map_functions(s, d):
    one = F.create_map("event_type", F.lit(1))
    both = sc.put_if_absent(sc.merged_counts(one, F.create_map(F.lit("click"), F.lit(2))), F.lit("all"), F.lit(9))
    return table(s, d, "events").withColumn("m", both).select("event_id", F.col("m")[F.col("event_type")].alias("own"), F.col("m")["click"].alias("clicks"), F.size("m").alias("entries"))


@query("SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, '{\"k\":' || (props->>'k') || ',\"type\":\"' || event_type || '\"}' AS details FROM events")
def x_json_functions(s, d):
    k = F.from_json("props", "k int")["k"]
    return table(s, d, "events").select("event_id", k.alias("k"), sc.details_json(k=k, type=F.col("event_type")).alias("details"))
