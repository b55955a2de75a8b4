"""Registered queries over stored runs, lookups and decompositions, with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import artifacts as ar
from tessera.operators import clusters as cl
from tessera.operators import filters as fl
from tessera.operators import graphs as gr
from tessera.operators import pairs as pa
from tessera.operators import summaries as sm
from tessera.plans.graph_queries import _CLUSTERS, _COS, _DELTAS, _PAIRS, _STATS, _deltas, _edges, _led, _mean, _parents
from tessera.plans.standins import part_values, records, subjects, table, values
from tessera.plans.tables_queries import V, h

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT p_partkey, p_name FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)")
def f12_lookup(s, d):
    part = table(s, d, "part")
    return ar.lookup(part, "p_brand", part.where("p_size = 50")).select("p_partkey", "p_name")


@query(f"WITH {_PAIRS} SELECT transform_id, subject_a, subject_b, key FROM pairs WHERE subject_a = 7 OR subject_b = 7")
def f13_pairs_of_subject(s, d):
    return ar.pairs_of(pa.mine_pairs(records(s, d)), 7).select("transform_id", "subject_a", "subject_b", "key")


@query(f"WITH {_PAIRS}, p AS (SELECT transform_id, subject_a, subject_b, key FROM pairs WHERE transform_id = '1|Brand#1>>Brand#2') SELECT *, (SELECT count(*) FROM p) AS total FROM p ORDER BY transform_id, subject_a, subject_b, key LIMIT 40 OFFSET 10")
def t2_page_and_total(s, d):
    chosen = ar.pairs_of(pa.mine_pairs(records(s, d)), transform="1|Brand#1>>Brand#2").select("transform_id", "subject_a", "subject_b", "key")
    return ar.page_and_total(chosen, "pairs", 10, 40)


@query(f"WITH {_DELTAS}, st AS ({_STATS}) SELECT transform_id, cut_count, from_value, to_value, support FROM st JOIN (SELECT DISTINCT transform_id, cut_count, from_value, to_value FROM pairs) USING (transform_id)")
def j3_stats_with_fragments(s, d):
    return ar.with_fragments(pa.transform_stats(_deltas(s, d)), pa.mine_pairs(records(s, d))).select("transform_id", "cut_count", "from_value", "to_value", "support")


@query("WITH p AS (SELECT l_suppkey AS run_id, count(*) AS pair_count FROM lineitem WHERE l_quantity > 45 GROUP BY 1), t AS (SELECT l_suppkey AS run_id, count(*) AS stats_count FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) SELECT s_suppkey AS run_id, coalesce(pair_count, 0) AS pair_count, coalesce(stats_count, 0) AS stats_count FROM supplier LEFT JOIN p ON p.run_id = s_suppkey LEFT JOIN t ON t.run_id = s_suppkey")
def j4_run_counts(s, d):
    line = table(s, d, "lineitem").withColumnRenamed("l_suppkey", "run_id")
    return ar.run_counts(table(s, d, "supplier").select(F.col("s_suppkey").alias("run_id")), line.where("l_quantity > 45"), line.where("l_discount > 0.09"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j7_semi_join(s, d):
    return ar.lookup(subjects(s, d).withColumnRenamed("subject_id", "c_custkey"), "c_custkey", table(s, d, "orders").where("o_totalprice > 450000").withColumnRenamed("o_custkey", "c_custkey")).select("c_custkey")


@query(f"WITH {V}, q AS (SELECT o_custkey AS subject_id, o_orderpriority AS endpoint_id, min(o_orderkey) AS ordinal FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2) SELECT ordinal, subject_id, endpoint_id, mean FROM q JOIN v USING (subject_id, endpoint_id)")
def j9_requested_values(s, d):
    request = table(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("endpoint_id")).agg(F.min("o_orderkey").alias("ordinal"))
    return ar.requested(values(s, d), request).select("ordinal", "subject_id", "endpoint_id", "mean")


@query(f"WITH {V} SELECT endpoint_id, count(*) AS valid, {h('avg(mean)')} AS mean, {h('median(mean)')} AS median FROM v JOIN customer ON c_custkey = subject_id WHERE c_mktsegment = 'BUILDING' AND state = 'VALUE' GROUP BY 1")
def a6_selection_summary(s, d):
    chosen = subjects(s, d).where(fl.in_categories(F.col("series"), ["BUILDING"])).select("subject_id")
    return sm.numeric_summary(ar.lookup(values(s, d).where("state = 'VALUE'"), "subject_id", chosen), "mean", ["endpoint_id"]).select("endpoint_id", "valid", "mean", "median")


@query(f"WITH {_DELTAS}, e AS (SELECT subject_a AS node, subject_b AS other, transform_id, delta FROM d UNION ALL SELECT subject_b, subject_a, transform_id, delta FROM d) SELECT node AS centre, other, count(*) AS edges, count(DISTINCT transform_id) AS transforms, {h('avg(delta)')} AS mean_delta, {h('median(delta)')} AS median_delta, {h('min(delta)')} AS min_delta, {h('max(delta)')} AS max_delta FROM e GROUP BY 1, 2")
def a14_collapsed_neighbours(s, d):
    edges = _deltas(s, d).select(F.col("subject_a").alias("source"), F.col("subject_b").alias("target"), "transform_id", "delta")
    return gr.collapsed(edges, part_values(s, d).select(F.col("subject").alias("node")))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT leader, count(*) AS size, {h('min(similarity) FILTER (row_id <> leader)')} AS min_similarity, {_mean('CASE WHEN row_id <> leader THEN similarity END')} AS mean_similarity FROM cl GROUP BY 1")
def a15_cluster_summary(s, d):
    return cl.cluster_summary(_led(s, d), with_singletons=True)


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT leader, count(*) AS size FROM cl GROUP BY 1 HAVING count(*) > 1")
def f14_without_singletons(s, d):
    return cl.cluster_summary(_led(s, d)).select("leader", "size")


@query("SELECT p_brand, count(*) AS total, count(*) FILTER (p_size % 4 = 0) AS applied, count(*) FILTER (p_size % 4 = 1) AS no_match, count(*) FILTER (p_size % 4 = 2) AS non_unique, count(*) FILTER (p_size % 4 = 3) AS invalid FROM part GROUP BY 1")
def a16_status_counts(s, d):
    status = F.element_at(F.array(*map(F.lit, ("APPLIED", "NO_MATCH", "NON_UNIQUE", "INVALID"))), (F.col("p_size") % 4 + 1).cast("int"))
    return sm.status_counts(table(s, d, "part").withColumn("status", status), ["p_brand"], "status", ["APPLIED", "NO_MATCH", "NON_UNIQUE", "INVALID"])


@query(f"WITH RECURSIVE {_COS}, x AS (SELECT target AS child, source AS parent, similarity AS score FROM edges), k AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent DESC) AS r FROM x), b AS (SELECT child AS node, parent AS other FROM k WHERE r = 1 UNION SELECT parent, child FROM k WHERE r = 1), w AS (SELECT node, node AS c FROM b UNION SELECT other, c FROM w JOIN b USING (node)), m AS (SELECT node, min(c) AS component FROM w GROUP BY 1) SELECT component, count(*) AS size FROM m GROUP BY 1")
def a31_rows_per_lineage(s, d):
    forest = _parents(s, d)
    return gr.component_sizes(forest.select(F.col("child").alias("source"), F.col("parent").alias("target")))


@query("SELECT c_custkey AS subject_id FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'MACHINERY' OR c_acctbal > 9000")
def o3_universe(s, d):
    sets = [subjects(s, d).where(c).select("subject_id") for c in ("nation = 3", "series = 'MACHINERY'", "balance > 9000")]
    return sets[0].union(sets[1]).union(sets[2]).distinct()


@query("WITH a AS (SELECT p_name AS name, max(p_size) AS priority FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT p_name AS name, min(p_size) AS priority FROM part WHERE p_size >= 25 AND p_brand = 'Brand#3' GROUP BY 1) SELECT name, coalesce(b.priority, a.priority) AS priority FROM a FULL JOIN b USING (name)")
def o5_capabilities(s, d):
    part = table(s, d, "part").withColumnRenamed("p_name", "name")
    registry = part.where("p_size < 25").groupBy("name").agg(F.max("p_size").alias("priority"))
    session = part.where("p_size >= 25 and p_brand = 'Brand#3'").groupBy("name").agg(F.min("p_size").alias("priority"))
    return ar.merged_capabilities(registry, session)


@query(f"WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY n DESC, subject_id) AS rank FROM v) SELECT endpoint_id, subject_id, n, CAST(rank AS INTEGER) AS rank, last_measurement AS effective_date FROM r WHERE rank <= 80")
def t10_most_measured(s, d):
    return ar.most_measured(values(s, d), "endpoint_id", "n").select("endpoint_id", "subject_id", "n", "rank", "effective_date")


@query(f"WITH {_COS}, b AS (SELECT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges), g AS (SELECT node, count(*) AS degree FROM b GROUP BY 1), n AS (SELECT b.node AS centre, other, degree, {h('abs(CAST(y.label AS DOUBLE) - x.label)')} AS gap FROM b JOIN g ON g.node = other JOIN embeddings x ON x.vec_id = b.node JOIN embeddings y ON y.vec_id = other), r AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY gap, degree DESC, other) AS rank FROM n) SELECT centre, other, degree, gap, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def t12_nearest_in_value(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("value"))
    return ar.neighbours_in_value(_edges(s, d), v, 5, once=True)
