"""Registered queries over pairs, similarity graphs and traces, with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph_clusters as gc
from tessera.operators import graph_sums as gs
from tessera.operators import graphs as gr
from tessera.operators import pairs as pa
from tessera.operators import similarity as si
from tessera.plans.standins import part_values, records, subjects, table, trace_events
from tessera.plans.tables_queries import h
from tessera.streaming import traces as tr

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_PAIRS = """r AS (SELECT DISTINCT l_partkey AS s, l_orderkey AS k, p_brand AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
pairs AS (SELECT 1 AS cut_count, a.k AS key, a.s AS subject_a, a.v AS from_value, b.s AS subject_b, b.v AS to_value, '1|' || a.v || '>>' || b.v AS transform_id FROM r a JOIN r b ON a.k = b.k WHERE a.s <> b.s AND a.v <> b.v)"""
_DELTAS = _PAIRS + ",\nd AS (SELECT pairs.*, x.p_retailprice AS value_a, y.p_retailprice AS value_b, y.p_retailprice - x.p_retailprice AS delta FROM pairs JOIN part x ON x.p_partkey = subject_a JOIN part y ON y.p_partkey = subject_b)"
_STATS = f"""SELECT transform_id, count(*) AS support, {h('avg(delta)')} AS mean, {h('median(delta)')} AS median, {h('stddev_pop(delta)')} AS sd, {h('min(delta)')} AS min, {h('max(delta)')} AS max,
count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta < 0) AS down, count(*) FILTER (delta = 0) AS tie, {h('count(*) FILTER (delta > 0) / count(*)')} AS positive_fraction FROM d GROUP BY 1 HAVING count(*) >= 2"""


def _deltas(s, d):
    return pa.with_deltas(pa.mine_pairs(records(s, d)), part_values(s, d))


@query(f"WITH {_PAIRS} SELECT transform_id, count(*) AS pairs, count(DISTINCT key) AS keys FROM pairs GROUP BY 1")
def j1_mined_pairs(s, d):
    return pa.mine_pairs(records(s, d)).groupBy("transform_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("key").alias("keys"))


@query(f"WITH {_DELTAS} SELECT cut_count, key, subject_a, subject_b, {h('delta')} AS delta FROM d")
def j2_pair_deltas(s, d):
    return _deltas(s, d).select("cut_count", "key", "subject_a", "subject_b", pa.half_up(F.col("delta")).alias("delta"))


@query(f"WITH {_DELTAS} {_STATS}")
def a1_transform_stats(s, d):
    return pa.transform_stats(_deltas(s, d))


@query(f"WITH {_DELTAS} SELECT transform_id, count(*) AS support, {h('median(delta)')} AS median, {h('stddev_pop(delta)')} AS sd FROM d GROUP BY 1 HAVING count(*) >= 2")
def a2_transform_stats_ranked(s, d):
    return pa.transform_stats_ranked(_deltas(s, d))


@query(f"WITH {_DELTAS}, st AS ({_STATS}) SELECT transform_id, {h('down / support')} AS negative_fraction, {h('tie / support')} AS tie_fraction, up + down AS decided, greatest(up, down) AS majority, up + down >= 6 AS testable FROM st")
def a1_directions(s, d):
    return pa.directions(pa.transform_stats(_deltas(s, d))).select("transform_id", "negative_fraction", "tie_fraction", "decided", "majority", "testable")


@query(f"WITH {_DELTAS}, st AS ({_STATS}), n AS (SELECT *, row_number() OVER (PARTITION BY transform_id ORDER BY subject_a, subject_b, key) AS r FROM pairs) SELECT st.*, e AS example_sources FROM st JOIN (SELECT transform_id, list(subject_a ORDER BY r) AS e FROM n WHERE r <= 3 GROUP BY 1) USING (transform_id)")
def a13_transform_summary(s, d):
    return pa.transform_summary(_deltas(s, d)).withColumn("example_sources", F.col("examples.subject_a")).drop("examples")


_REC = f"""WITH {_DELTAS}, st AS (SELECT cut_count, from_value, to_value, transform_id, count(*) AS support, {h('avg(delta)')} AS mean FROM d GROUP BY ALL HAVING count(*) >= 2),
q AS (SELECT p_partkey AS query_id, 1 AS cut_count, p_name AS key, p_brand AS from_value FROM part),
t AS (SELECT * FROM q JOIN st USING (cut_count, from_value) WHERE from_value <> to_value), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key, to_value ORDER BY mean DESC, support DESC, transform_id) AS r FROM t),
k AS (SELECT query_id, transform_id, mean, support, CAST(row_number() OVER (PARTITION BY query_id ORDER BY mean DESC, support DESC, transform_id, key) AS INTEGER) AS rank FROM o WHERE r = 1)"""


def _recommended(s, d):
    stats = pa.transform_stats(_deltas(s, d), ["cut_count", "from_value", "to_value", "transform_id"])
    part = table(s, d, "part")
    fragments = part.select(F.col("p_partkey").alias("query_id"), F.lit(1).alias("cut_count"), F.col("p_name").alias("key"), F.col("p_brand").alias("from_value"))
    return pa.recommend(fragments, stats, "up", 10)


@query(f"{_REC} SELECT * FROM k WHERE rank <= 10")
def j10_recommendations(s, d):
    return _recommended(s, d).select("query_id", "transform_id", "mean", "support", "rank")


@query(f"{_REC}, z AS (SELECT transform_id, count(*) AS other_support, {h('avg(y.p_size - x.p_size)')} AS other_mean FROM pairs JOIN part x ON x.p_partkey = subject_a JOIN part y ON y.p_partkey = subject_b GROUP BY 1 HAVING count(*) >= 2) SELECT query_id, transform_id, rank, other_support, other_mean FROM k LEFT JOIN z USING (transform_id) WHERE rank <= 10")
def j11_evidence(s, d):
    other = pa.transform_stats(pa.with_deltas(pa.mine_pairs(records(s, d)), part_values(s, d, "p_size")))
    return pa.evidence(_recommended(s, d), other).select("query_id", "transform_id", "rank", "other_support", "other_mean")


@query(f"WITH {_DELTAS}, st AS ({_STATS}) SELECT transform_id, median FROM st ORDER BY abs(median) DESC NULLS LAST, transform_id LIMIT 100")
def t7_sorted_summary(s, d):
    return pa.transform_stats(_deltas(s, d)).orderBy(*pa.sorted_summary(None, "abs_median_delta_desc")).select("transform_id", "median").limit(100)


_COS = """e AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
once AS MATERIALIZED (SELECT a.id AS source, b.id AS target, floor(list_cosine_similarity(a.v, b.v) * 1e6 + 0.5) / 1e6 AS similarity FROM e a JOIN e b ON a.id < b.id),
sims AS (SELECT source, target, similarity FROM once UNION ALL SELECT target, source, similarity FROM once),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS INTEGER) AS rank FROM sims),
knn AS (SELECT * FROM ranked WHERE rank <= 5),
near AS (SELECT least(source, target) AS source, greatest(source, target) AS target, max(similarity) AS similarity, count(*) AS near FROM knn GROUP BY 1, 2),
edges AS (SELECT source, target, coalesce(n.similarity, t.similarity) AS similarity, coalesce(near, 0) = 2 AS mutual, CASE WHEN near > 0 AND t.similarity IS NOT NULL THEN 'hybrid' WHEN near > 0 THEN 'knn' ELSE 'threshold' END AS origin
  FROM near n FULL JOIN (SELECT source, target, similarity FROM sims WHERE source < target AND similarity >= 0.35) t USING (source, target))"""


_GRAPH = ("vec_id", "embedding", "hybrid", 5, 0.35)


def _edges(s, d):
    return si.graph(table(s, d, "embeddings"), *_GRAPH)


def _degrees(s, d):
    return gs.degrees(table(s, d, "embeddings"), *_GRAPH)


def _parents(s, d):
    return gs.parents(table(s, d, "embeddings"), *_GRAPH[:2], "vec_id", *_GRAPH[2:])


@query(f"WITH {_COS} SELECT source, target, similarity FROM sims WHERE source < target AND similarity >= 0.35")
def j5_similar_pairs(s, d):
    return si.over_threshold(table(s, d, "embeddings"), "vec_id", "embedding", 0.35)


@query(f"WITH {_COS} SELECT source, target, similarity, rank FROM knn")
def j6_nearest(s, d):
    return si.nearest(table(s, d, "embeddings"), "vec_id", "embedding", 5)


_EDGES = """WITH e AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
s AS MATERIALIZED (SELECT a.id AS source, b.id AS target, floor(list_cosine_similarity(a.v, b.v) * 1e6 + 0.5) / 1e6 AS similarity FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS rank FROM s),
m AS (SELECT least(source, target) AS source, greatest(source, target) AS target, similarity, rank <= 5 AS near, similarity >= 0.35 AS above FROM r WHERE rank <= 5 OR similarity >= 0.35)
SELECT source, target, max(similarity) AS similarity, count(*) FILTER (near) = 2 AS mutual, CASE WHEN bool_or(near) AND bool_or(above) THEN 'hybrid' WHEN bool_or(near) THEN 'knn' ELSE 'threshold' END AS origin FROM m GROUP BY source, target"""


@query(_EDGES)
def g1_similarity_graph(s, d):
    return _edges(s, d)


@query(f"WITH {_COS}, b AS (SELECT source AS node, target AS other FROM edges UNION ALL SELECT target, source FROM edges), g AS (SELECT node, count(*) AS degree FROM b GROUP BY 1) SELECT count(*) AS nodes, min(degree) AS min_degree, median(degree) AS median_degree, max(degree) AS max_degree FROM g")
def a11_degree_stats(s, d):
    return gr.stats_of_degrees(_degrees(s, d))


@query(f"WITH {_COS} SELECT count(similarity) AS edges, count(*) FILTER (mutual) AS mutual, min(similarity) AS min, {h('quantile_cont(similarity, 0.25)')} AS p25, {h('quantile_cont(similarity, 0.5)')} AS p50, {h('quantile_cont(similarity, 0.75)')} AS p75, max(similarity) AS max FROM edges")
def a12_similarity_stats(s, d):
    return gr.stats_of_counts(gs.counts(table(s, d, "embeddings"), *_GRAPH)).select("edges", "mutual", "min", "p25", "p50", "p75", "max")


@query(f"WITH {_COS}, b AS (SELECT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges), g AS (SELECT node, count(*) AS degree FROM b GROUP BY 1), k AS (SELECT b.node AS centre, other, degree, CAST(row_number() OVER (PARTITION BY b.node ORDER BY degree DESC, other) AS INTEGER) AS rank FROM b JOIN g ON g.node = other) SELECT * FROM k WHERE rank <= 10")
def g3_neighbourhood(s, d):
    centres = table(s, d, "embeddings").select(F.col("vec_id").alias("node"))
    return gr.neighbourhood(_edges(s, d), centres, 10, once=True)


@query(f"WITH RECURSIVE {_COS}, b AS (SELECT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges), w AS (SELECT 0::BIGINT AS node, 0 AS distance UNION SELECT other, distance + 1 FROM w JOIN b USING (node) WHERE distance < 3) SELECT node, min(distance) AS distance FROM w GROUP BY 1")
def g5_distances(s, d):
    return gr.distances(_edges(s, d), table(s, d, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("node")), 3).select("node", "distance")


@query(f"WITH RECURSIVE {_COS}, b AS (SELECT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges), w AS (SELECT 0::BIGINT AS node, 0 AS distance UNION SELECT other, distance + 1 FROM w JOIN b USING (node) WHERE distance < 3), m AS (SELECT node, min(distance) AS distance FROM w GROUP BY 1) SELECT distance, distance || CASE distance WHEN 1 THEN ' hop' ELSE ' hops' END AS label, count(*) AS rows FROM m WHERE distance > 0 GROUP BY 1")
def g5_shells(s, d):
    return gr.shells(_edges(s, d), table(s, d, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("node")), 3)



@query(f"WITH RECURSIVE {_COS}, mutual AS (SELECT source, target FROM edges WHERE mutual AND similarity >= 0.38), b AS (SELECT source AS node, target AS other FROM mutual UNION SELECT target, source FROM mutual), w AS (SELECT node, node AS c FROM b UNION SELECT other, c FROM w JOIN b USING (node)), m AS (SELECT node, min(c) AS component FROM w GROUP BY 1) SELECT component, count(*) AS size FROM m GROUP BY 1")
def g6_components(s, d):
    return gr.component_sizes(_edges(s, d).where("mutual and similarity >= 0.38").select("source", "target"))


def _mean(x: str) -> str:
    """The mean to six places of numbers of six places, in whole numbers."""
    return f"(floor(sum(CAST(round({x} * 1e6) AS BIGINT)) / count({x}) + 0.5) / 1e6)"


#: the rule one leader after the other: the row with most remaining neighbours takes them
_CLUSTERS = f"""{_COS}, ends AS MATERIALIZED (SELECT source AS a, target AS b, similarity FROM edges UNION ALL SELECT target, source, similarity FROM edges),
st AS (SELECT 0 AS turn, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS taken, (SELECT list(vec_id ORDER BY vec_id) FROM embeddings) AS remaining
UNION ALL SELECT turn + 1, x.a, list_prepend(x.a, x.bs), list_filter(remaining, lambda y: y <> x.a AND NOT list_contains(x.bs, y)) FROM st, LATERAL (
  SELECT l.a, coalesce(list(n.b) FILTER (n.b IS NOT NULL), CAST([] AS BIGINT[])) AS bs FROM (SELECT unnest(st.remaining) AS a) l JOIN embeddings v ON v.vec_id = l.a LEFT JOIN ends n ON n.a = l.a AND list_contains(st.remaining, n.b)
  GROUP BY l.a, v.label ORDER BY count(n.b) DESC, coalesce({_mean('n.similarity')}, 0), v.label DESC, l.a LIMIT 1) x WHERE len(remaining) > 0),
members AS (SELECT leader, unnest(taken) AS row_id FROM st WHERE leader IS NOT NULL),
cl AS (SELECT row_id, leader, CASE WHEN row_id = leader THEN 1.0 ELSE similarity END AS similarity FROM members LEFT JOIN ends ON a = leader AND b = row_id)"""


_LED = (*_GRAPH[:2], "label", *_GRAPH[2:])


def _led(s, d):
    return gc.leader_clusters(table(s, d, "embeddings"), *_LED)


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM cl")
def g7_leader_clusters(s, d):
    return _led(s, d)


@query(f"WITH RECURSIVE {_CLUSTERS}, t AS (SELECT p.leader, o.leader AS other_leader, e.b AS other, max(e.similarity) AS similarity FROM ends e JOIN cl p ON p.row_id = e.a JOIN cl o ON o.row_id = e.b WHERE p.leader <> o.leader GROUP BY 1, 2, 3), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY leader ORDER BY similarity DESC, other_leader, other) AS INTEGER) AS rank FROM t) SELECT * FROM r WHERE rank <= 5")
def g7_cross_neighbours(s, d):
    return gc.cross_neighbours(table(s, d, "embeddings"), *_LED).select("leader", "other_leader", "other", "similarity", "rank")


@query(f"WITH {_COS}, x AS (SELECT target AS child, source AS parent, similarity AS score FROM edges WHERE source < target), k AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent DESC) AS r FROM x) SELECT child, parent, score FROM k WHERE r = 1")
def j12_parents(s, d):
    return _parents(s, d)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j8_anti_join(s, d):
    rows = subjects(s, d).select(F.col("subject_id").alias("c_custkey"))
    return gr.isolated(rows, "c_custkey", table(s, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target")))


_EV = "t AS (SELECT user_id AS trace, event_id AS sequence, epoch_us(ts) // 1000 AS at_ms, ['STARTED', 'COMPLETED', 'FAILED'][event_id % 3 + 1] AS phase, event_type, CAST(event_id // 3 AS BIGINT) AS invocation FROM events)"


@query(f"WITH {_EV}, p AS (SELECT *, least(coalesce(at_ms - lag(at_ms) OVER (PARTITION BY trace ORDER BY at_ms, sequence), 0), 120000) AS pause FROM t) SELECT trace, sequence, CAST(sum(pause) OVER (PARTITION BY trace ORDER BY at_ms, sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shown_ms FROM p")
def w5_timeline(s, d):
    return tr.timeline(trace_events(s, d), "trace", "at_ms", "sequence", 120_000).select("trace", "sequence", "shown_ms")


@query(f"WITH {_EV} SELECT trace, sequence, CAST((row_number() OVER (PARTITION BY trace ORDER BY at_ms, sequence) - 1) // 25 AS INTEGER) AS batch FROM t")
def w4_batches(s, d):
    return tr.batches(trace_events(s, d), "trace", ["at_ms", "sequence"]).select("trace", "sequence", "batch")


@query(f"WITH {_EV}, p AS (SELECT *, lag(at_ms) OVER (PARTITION BY trace ORDER BY sequence) AS before FROM t) SELECT trace, count(*) FILTER (before IS NOT NULL AND at_ms <= before) AS breaks FROM p GROUP BY 1")
def w6_sequence_breaks(s, d):
    breaks = tr.sequence_breaks(trace_events(s, d), "trace", "sequence", "at_ms").groupBy("trace").agg(F.count(F.lit(1)).alias("n"))
    return trace_events(s, d).select("trace").distinct().join(breaks, "trace", "left").select("trace", F.coalesce("n", F.lit(0)).alias("breaks"))


@query(f"WITH {_EV} SELECT invocation, min(at_ms) FILTER (phase = 'STARTED') AS started_ms, min(at_ms) FILTER (phase <> 'STARTED') AS ended_ms, coalesce(arg_min(phase, at_ms) FILTER (phase <> 'STARTED'), 'ACTIVE') AS outcome FROM t GROUP BY 1")
def l2_invocations(s, d):
    return tr.invocations(trace_events(s, d), "invocation", "phase", "at_ms", "sequence")


@query(f"WITH {_EV}, n AS (SELECT *, 1.0::DOUBLE - (1704103200 - at_ms / 1000) / CAST(CASE phase WHEN 'STARTED' THEN 3500 WHEN 'COMPLETED' THEN 3000 ELSE 1800 END AS DOUBLE) AS a FROM t WHERE at_ms <= 1704067200000 + 36000000) SELECT trace, {h('max(a)')} AS attention FROM n WHERE a > 0 GROUP BY 1")
def l3_attention(s, d):
    events = trace_events(s, d).withColumn("scaled_ms", F.col("at_ms") / 1000)
    return tr.strongest(events, "trace", "phase", "scaled_ms", (1704067200000 + 36_000_000) // 1000).select("trace", pa.half_up(F.col("attention")).alias("attention"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def l1_windowed_counts(s, d):
    events = trace_events(s, d).withColumn("at", F.col("at").cast("timestamp_ntz"))
    return tr.windowed_counts(events, "at", ["event_type"])
