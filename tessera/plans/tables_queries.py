"""Registered queries over entities and measured endpoints, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import predictions as pr
from tessera.functions import scalars as sc
from tessera.operators import filters as fl
from tessera.operators import pivots as pv
from tessera.operators import rowsets as rs
from tessera.operators import summaries as sm
from tessera.plans.standins import subjects, table, values
from tessera.sources import tables as src


def h(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


V = """v AS (SELECT o_custkey AS subject_id, o_orderpriority AS endpoint_id, floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) + 0.5) AS mean, count(*) AS n,
  min(o_orderdate) AS first_measurement, max(o_orderdate) AS last_measurement, CASE WHEN count(*) > 1 THEN 'VALUE' ELSE 'NOT_MEASURED' END AS state FROM orders GROUP BY 1, 2)"""
QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query("SELECT c_custkey AS subject_id, c_acctbal AS balance FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000")
def f1_numeric_range(s, d):
    return subjects(s, d).where(fl.in_range(F.col("balance"), 1000.0, 5000.0)).select("subject_id", "balance")


@query("SELECT c_custkey AS subject_id, c_mktsegment AS series FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def f2_categories(s, d):
    return subjects(s, d).where(fl.in_categories(F.col("series"), ["BUILDING", "MACHINERY"])).select("subject_id", "series")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion the')")
def f3_text_contains(s, d):
    return table(s, d, "documents").where(fl.has_text(F.col("text"), "Tion The")).select("doc_id", "lang")


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https://(www|m)\.[a-z]+\.EXAMPLE\.(com|org)/')")
def f3_text_regex(s, d):
    return table(s, d, "pages").where(fl.matches(F.col("url"), r"^https://(www|m)\.[a-z]+\.EXAMPLE\.(com|org)/")).select("page_id", "url")


@query("SELECT c_custkey AS subject_id, o_totalprice IS NULL AS missing, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def f4_missing(s, d):
    met = subjects(s, d).join(table(s, d, "orders"), F.col("o_custkey") == F.col("subject_id"), "left")
    return met.groupBy("subject_id", F.col("o_totalprice").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS row_id, c_custkey AS ordinal FROM customer WHERE c_acctbal >= 5000 AND c_nationkey < 10")
def f5_column_row_set(s, d):
    base = rs.row_set(subjects(s, d).where("nation < 10"), "subject_id", F.col("subject_id"))
    chosen = subjects(s, d).where(fl.in_range(F.col("balance"), low=5000.0)).select(F.col("subject_id").alias("row_id"))
    return base.join(chosen, "row_id", "left_semi")


@query(f"WITH {V} SELECT subject_id, endpoint_id, n FROM v WHERE state = 'VALUE' AND mean >= 250000")
def f6_value_filter(s, d):
    return values(s, d).where(fl.compares(F.col("mean"), F.col("state"), "gte", 250000.0)).select("subject_id", "endpoint_id", "n")


@query(f"WITH {V} SELECT subject_id, endpoint_id, last_measurement FROM v WHERE last_measurement >= '1998-01-01' AND last_measurement < '2000-07-01'")
def f7_measured_between(s, d):
    return values(s, d).where(fl.measured_between(F.col("last_measurement"), "1998-01-01", "2000-06-30")).select("subject_id", "endpoint_id", "last_measurement")


@query(f"WITH {V} SELECT c_custkey AS subject_id, c_mktsegment AS series, {h('mean')} AS mean FROM customer JOIN v ON subject_id = c_custkey WHERE endpoint_id = '1-URGENT' AND state = 'VALUE' AND mean < 200000 AND last_measurement < '2000-01-01'")
def f8_endpoint_selection(s, d):
    chosen = values(s, d).where((F.col("endpoint_id") == "1-URGENT") & fl.compares(F.col("mean"), F.col("state"), "lt", 200000.0) & fl.measured_between(F.col("last_measurement"), high="1999-12-31"))
    return subjects(s, d).join(chosen, "subject_id").select("subject_id", "series", sc.half_up(F.col("mean")).alias("mean"))


@query(f"WITH {V} SELECT subject_id, min(first_measurement) AS first_measurement, max(last_measurement) AS last_measurement, count(*) AS endpoints FROM v GROUP BY 1 HAVING max(last_measurement) >= '2001-01-01'")
def f9_subject_dates(s, d):
    dates = sm.measurement_dates(values(s, d), "subject_id", "first_measurement", "last_measurement")
    return dates.where(fl.measured_between(F.col("last_measurement"), "2001-01-01"))


@query("SELECT p_partkey, CASE WHEN list_has_any(c, e) THEN 'vicinity' ELSE 'apart' END AS lie, len([x FOR x IN e IF NOT list_contains(c, x)]) = 0 AS editable FROM (SELECT p_partkey, [p_size % 5, p_size % 3] AS e, [1, 2, 3] AS c FROM part)")
def f17_region_modes(s, d):
    places = table(s, d, "part").select("p_partkey", F.array((F.col("p_size") % 5), (F.col("p_size") % 3)).alias("e"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("c"))
    return places.select("p_partkey", F.when(fl.region(F.col("c"), F.col("e"), "vicinity"), "vicinity").otherwise("apart").alias("lie"), fl.region(F.col("c"), F.col("e"), "editable").alias("editable"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), nullif(trim(source), '')) AS shown FROM documents")
def f18_first_filled(s, d):
    return table(s, d, "documents").select("doc_id", sc.first_filled(F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("lang")), F.col("source")).alias("shown"))


@query("SELECT unnest(['toxic', 'quality', 'lang']) AS column_id, unnest([count(*) - count(toxic), count(*) - count(quality), count(*) - count(lang)]) AS missing, unnest([count(toxic), count(quality), count(lang)]) AS filled FROM documents LEFT JOIN labels USING (doc_id)")
def f19_profile(s, d):
    return fl.profile(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), ["toxic", "quality", "lang"])


@query("SELECT n_name AS subject_set_id, n_name AS name FROM nation WHERE contains(lower(n_name), 'nation_1') ORDER BY lower(n_name) <> 'nation_1', n_name LIMIT 1")
def f21_subject_set(s, d):
    sets = table(s, d, "nation").select(F.col("n_name").alias("subject_set_id"), F.col("n_name").alias("name"))
    return fl.first_candidate(sets, ["{}", "series:{}"], "nation_1").select("subject_set_id", "name")


def _sets(s, d):
    o = table(s, d, "orders")
    rich = rs.row_set(o.where("o_totalprice > 400000"), "o_custkey", F.col("o_orderkey"))
    urgent = rs.row_set(o.where("o_orderpriority = '1-URGENT'"), "o_custkey", F.col("o_orderkey"))
    late = rs.row_set(o.where("o_orderdate >= '2001-01-01'"), "o_custkey", F.col("o_orderkey"))
    return rich, urgent, late


_SETS = """rich AS (SELECT o_custkey AS row_id, min(o_orderkey) AS ordinal FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
urgent AS (SELECT o_custkey AS row_id, min(o_orderkey) AS ordinal FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
late AS (SELECT o_custkey AS row_id, min(o_orderkey) AS ordinal FROM orders WHERE o_orderdate >= '2001-01-01' GROUP BY 1)"""


@query(f"WITH {_SETS}, u AS (SELECT 0 AS source, * FROM rich UNION ALL SELECT 1, * FROM urgent UNION ALL SELECT 2, * FROM late) SELECT row_id, arg_min(source, source) AS source, arg_min(ordinal, source) AS ordinal FROM u GROUP BY 1")
def o1_union(s, d):
    return rs.union(*_sets(s, d))


@query(f"WITH {_SETS} SELECT * FROM rich WHERE row_id IN (SELECT row_id FROM urgent) AND row_id IN (SELECT row_id FROM late)")
def o1_intersect(s, d):
    return rs.intersect(*_sets(s, d))


@query(f"WITH {_SETS} SELECT * FROM rich WHERE row_id NOT IN (SELECT row_id FROM urgent) AND row_id NOT IN (SELECT row_id FROM late)")
def o1_subtract(s, d):
    return rs.subtract(*_sets(s, d))


@query("SELECT c_custkey AS subject_id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 20")
def t1_page(s, d):
    return rs.page(subjects(s, d), [F.desc("balance"), F.asc("subject_id")], 20, 50).select("subject_id", "balance")


@query("SELECT series, subject_id, balance, CAST(p AS INTEGER) AS position FROM (SELECT c_mktsegment AS series, c_custkey AS subject_id, c_acctbal AS balance, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS p FROM customer) WHERE p > 5 AND p <= 15")
def w8_page_in_groups(s, d):
    return rs.page_in_groups(subjects(s, d), ["series"], [F.asc("balance"), F.asc("subject_id")], 5, 10).select("series", "subject_id", "balance", "position")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def o4_first_wins(s, d):
    return rs.first_wins(table(s, d, "part"), ["p_brand", "p_name"], [F.asc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "p_name")


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY substr(sha256(p_partkey || '|17'), 1, 16), p_partkey) AS r FROM part) WHERE r <= 4")
def t9_hash_sample(s, d):
    return rs.hash_sample(table(s, d, "part"), "p_partkey", 4, 17, ["p_brand"]).select("p_brand", "p_partkey")


@query(f"SELECT c_mktsegment AS series, count(*) AS valid, 0::BIGINT AS missing, {h('avg(c_acctbal)')} AS mean, {h('quantile_cont(c_acctbal, 0.5)')} AS median, {h('quantile_cont(c_acctbal, 0.25)')} AS q1, {h('quantile_cont(c_acctbal, 0.75)')} AS q3, min(c_acctbal) AS min, max(c_acctbal) AS max, count(*) FILTER (c_acctbal >= 5000) AS hits, {h('count(*) FILTER (c_acctbal >= 5000) / count(*)')} AS hit_rate FROM customer GROUP BY 1")
def a3_numeric_summary(s, d):
    return sm.numeric_summary(subjects(s, d), "balance", ["series"], threshold=5000.0)


@query(f"WITH c AS (SELECT o_orderstatus, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus) AS valid, count(*) OVER (PARTITION BY o_orderstatus) AS distinct_values, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, value) AS rank FROM c) SELECT o_orderstatus, CAST(rank AS INTEGER) AS rank, value, n, {h('n / valid')} AS fraction, distinct_values FROM r WHERE rank <= 3")
def a4_categories(s, d):
    return sm.categories(table(s, d, "orders"), "o_orderpriority", 3, ["o_orderstatus"])


_A5 = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS column_id, count(*) AS valid, 0::BIGINT AS missing, {h(f'avg({c})')} AS mean, {h(f'quantile_cont({c}, 0.5)')} AS median, {h(f'quantile_cont({c}, 0.25)')} AS q1, {h(f'quantile_cont({c}, 0.75)')} AS q3, min({c}) AS min, max({c}) AS max FROM lineitem GROUP BY 1"
    for c in ("l_quantity", "l_discount", "l_tax")
)


@query(_A5)
def a5_group_summary(s, d):
    return sm.several_numeric(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])


@query(f"WITH {V} SELECT c_nationkey AS nation, endpoint_id, count(*) AS valid, {h('avg(mean)')} AS mean, {h('median(mean)')} AS median FROM v JOIN customer ON c_custkey = subject_id WHERE state = 'VALUE' GROUP BY 1, 2")
def a7_groups_by_endpoint(s, d):
    met = values(s, d).where("state = 'VALUE'").join(subjects(s, d), "subject_id")
    return sm.numeric_summary(met, "mean", ["nation", "endpoint_id"]).select("nation", "endpoint_id", "valid", "mean", "median")


@query(f"WITH {V} SELECT endpoint_id, count(*) FILTER (state = 'VALUE') AS measured, count(*) FILTER (state <> 'VALUE') AS not_measured, {h('''avg(mean) FILTER (state = 'VALUE')''')} AS mean, {h('''median(mean) FILTER (state = 'VALUE')''')} AS median, {h('''stddev_pop(mean) FILTER (state = 'VALUE')''')} AS sd, min(mean) FILTER (state = 'VALUE') AS min, max(mean) FILTER (state = 'VALUE') AS max, {h('''avg(n) FILTER (state = 'VALUE')''')} AS mean_n FROM v GROUP BY 1")
def a8_endpoint_qc(s, d):
    return sm.qc(values(s, d), ["endpoint_id"], "state", "mean", "n")


@query("WITH g AS (SELECT c_mktsegment AS series, min(c_acctbal) AS low, max(c_acctbal) AS high, CAST(least(greatest(ceil(sqrt(count(*))), 5), 30) AS INTEGER) AS bins FROM customer GROUP BY 1) SELECT series, bins, CAST(least(floor((c_acctbal - low) / (high - low) * bins), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM customer JOIN g ON series = c_mktsegment GROUP BY 1, 2, 3")
def a9_histogram(s, d):
    return sm.histogram(subjects(s, d), "balance", ["series"])


@query(f"WITH {V} SELECT subject_id, min(first_measurement) AS first_measurement, max(last_measurement) AS last_measurement, count(*) AS endpoints FROM v GROUP BY 1")
def a10_measurement_dates(s, d):
    return sm.measurement_dates(values(s, d), "subject_id", "first_measurement", "last_measurement")


@query("SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY count(*) DESC, p_brand) <= 5 THEN p_brand ELSE '(other)' END AS bucket, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand) GROUP BY 1")
def a29_top_and_other(s, d):
    return sm.with_other(table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")), "p_brand", 5)


@query(f"SELECT p_partkey, {h('(p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w)')} AS scaled FROM part WINDOW w AS (PARTITION BY p_brand)")
def a30_scaled(s, d):
    return sm.scaled(table(s, d, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", sc.half_up(F.col("scaled")).alias("scaled"))


_FRAG = "f AS (SELECT l_suppkey AS path, p_type AS fragment, l_orderkey AS structure, p_retailprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _fragments(s, d):
    part = table(s, d, "part")
    return table(s, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("path"), F.col("p_type").alias("fragment"), F.col("p_brand").alias("brand"), F.col("l_orderkey").alias("structure"), F.col("p_retailprice").alias("price"))


@query(f"WITH {_FRAG}, c AS (SELECT path, fragment, count(*) AS n FROM f GROUP BY 1, 2) SELECT path, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_fragments, count(*) FILTER (n = 1) AS singletons FROM c GROUP BY 1")
def a17_fragment_summary(s, d):
    return pv.fragment_summary(_fragments(s, d), "path", "fragment")


@query(f"WITH {_FRAG}, o AS (SELECT DISTINCT fragment, structure, price FROM f) SELECT fragment, count(DISTINCT structure) AS support, count(price) AS measured, {h('avg(price)')} AS mean, {h('median(price)')} AS median FROM o GROUP BY 1")
def a18_fragment_histogram(s, d):
    return pv.fragment_histogram(_fragments(s, d), "fragment", "structure", "price")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT p_brand, count(*) AS size, list(p_partkey ORDER BY p_partkey) FILTER (r <= 5) AS first_rows FROM r GROUP BY 1")
def a19_one_dimension(s, d):
    return pv.one_dimension(table(s, d, "part"), "p_brand", "p_partkey")


@query("SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS ECONOMY, count(*) FILTER (p_type = 'STANDARD') AS STANDARD, count(*) FILTER (p_type = 'PROMO') AS PROMO FROM part GROUP BY 1")
def a20_two_dimensions(s, d):
    return pv.two_dimensions(table(s, d, "part"), "p_brand", "p_type", ["ECONOMY", "STANDARD", "PROMO"])


@query("SELECT p_brand || '||' || p_type || '||' || CAST(p_size // 10 AS VARCHAR) AS composite, count(*) AS size FROM part GROUP BY 1")
def a21_several_dimensions(s, d):
    return pv.several_dimensions(table(s, d, "part").withColumn("size_class", F.floor(F.col("p_size") / 10).cast("string")), ["p_brand", "p_type", "size_class"])


@query("WITH l AS (SELECT p_brand, 'p_type' AS position, p_type AS value FROM part UNION ALL SELECT p_brand, 'p_name', p_name FROM part), c AS (SELECT *, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, count(*) OVER w AS \"values\", row_number() OVER (PARTITION BY p_brand, position ORDER BY n DESC, value) AS rank FROM c WINDOW w AS (PARTITION BY p_brand, position)) SELECT p_brand, position, \"values\", CAST(rank AS INTEGER) AS rank, value, n FROM r WHERE \"values\" > 1 AND rank <= 3")
def a22_context_diversity(s, d):
    return pv.context_diversity(table(s, d, "part"), "p_brand", ["p_type", "p_name"])


@query("WITH c AS (SELECT p_name AS synthon, count(*) AS occurrences, list_sort(list(DISTINCT p_brand)) AS signatures FROM part GROUP BY 1), f AS (SELECT p_name AS synthon, p_type AS source, min(p_partkey) AS o FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY synthon ORDER BY o, source) AS r FROM f) SELECT synthon, occurrences, signatures, first_sources FROM c JOIN (SELECT synthon, list(source ORDER BY r) AS first_sources FROM r WHERE r <= 8 GROUP BY 1) USING (synthon)")
def a23_synthons(s, d):
    rows = table(s, d, "part").select(F.col("p_name").alias("synthon"), F.col("p_brand").alias("signature"), F.col("p_type").alias("source"), "p_partkey")
    return pv.synthons(rows, "synthon", "signature", "source", "p_partkey")


@query("SELECT p_brand, count(*) AS observations, count(DISTINCT p_name) AS synthons FROM part GROUP BY 1")
def a24_replacement_classes(s, d):
    return pv.replacement_classes(table(s, d, "part"), "p_brand", "p_name")


@query(f"WITH {_FRAG.replace('p_retailprice AS price', 'p_retailprice AS price, p_brand AS brand, p_size AS size')}, a AS (SELECT brand, fragment, count(DISTINCT structure) AS support, {h('avg(size / 50)')} AS mean_fraction, max(size) AS size, max(path % 4) AS exits FROM f GROUP BY 1, 2) SELECT *, {h('1000 * support + 100 * mean_fraction + 10 * size + exits')} AS score FROM a")
def a27_candidate_score(s, d):
    part = table(s, d, "part")
    rows = table(s, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("brand"), F.col("p_type").alias("fragment"), F.col("l_orderkey").alias("structure"), (F.col("p_size") / 50).alias("fraction"), F.col("p_size").alias("size"), (F.col("l_suppkey") % 4).alias("exits"))
    return pv.candidate_score(rows, ["brand", "fragment"], "structure", "fraction", "size", "exits")


_POOL = "SELECT {c} AS sig, {k} AS k, row_number() OVER (PARTITION BY {c} ORDER BY substr(sha256({k} || '|{seed}'), 1, 16), {k}) AS r FROM {t}"


@query(f"WITH a AS ({_POOL.format(c='c_nationkey', k='c_custkey', seed=5, t='customer')}), b AS ({_POOL.format(c='s_nationkey', k='s_suppkey', seed=6, t='supplier')}) SELECT a.sig AS signature, a.k AS left_key, b.k AS right_key FROM a JOIN b ON a.sig = b.sig WHERE a.r <= 3 AND b.r <= 3")
def j13_assembled_pools(s, d):
    left = table(s, d, "customer").select(F.col("c_nationkey").alias("signature"), F.col("c_custkey").alias("k"))
    right = table(s, d, "supplier").select(F.col("s_nationkey").alias("signature"), F.col("s_suppkey").alias("k"))
    return pv.assembled(left, right, "signature", "k", 3, 5)


@query(f"WITH {V} SELECT subject_id, max(mean) FILTER (endpoint_id = '1-URGENT' AND state = 'VALUE') AS \"1-URGENT\", max(mean) FILTER (endpoint_id = '5-LOW' AND state = 'VALUE') AS \"5-LOW\" FROM v GROUP BY 1")
def s4_wide(s, d):
    return src.wide(values(s, d), ["1-URGENT", "5-LOW"])


@query("SELECT c_custkey || chr(9) || c_name || chr(9) || printf('%.4f', c_acctbal) AS value FROM customer")
def s6_tsv_lines(s, d):
    return src.tsv_lines(table(s, d, "customer"), ["c_custkey", "c_name", "c_acctbal"])


@query(f"WITH {V}, p AS (SELECT c_custkey AS subject_id FROM customer WHERE c_acctbal >= 2000) SELECT p.subject_id, c_mktsegment AS series, max(mean) FILTER (endpoint_id = '1-URGENT' AND state = 'VALUE') AS \"1-URGENT\" FROM p JOIN customer ON c_custkey = p.subject_id LEFT JOIN v ON v.subject_id = p.subject_id GROUP BY 1, 2")
def s11_export_selection(s, d):
    chosen = subjects(s, d).where("balance >= 2000").select("subject_id")
    return src.export_selection(chosen, subjects(s, d).select("subject_id", "series"), values(s, d), ["1-URGENT"])


@query("SELECT c_custkey AS subject_id, CASE WHEN c_acctbal <= 0 THEN 0.0 WHEN c_acctbal <= 4000 THEN floor(c_acctbal * CAST(0.000125 AS DOUBLE) * 1e6 + 0.5) / 1e6 WHEN c_acctbal <= 9000 THEN floor((CAST(0.5 AS DOUBLE) + (c_acctbal - 4000) * CAST(0.0001 AS DOUBLE)) * 1e6 + 0.5) / 1e6 ELSE 1.0 END AS score FROM customer")
def x_piecewise_score(s, d):
    return subjects(s, d).select("subject_id", sc.half_up(sc.piecewise(F.col("balance"), [(0.0, 0.0), (4000.0, 0.5), (9000.0, 1.0)])).alias("score"))


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || CAST(p_size AS VARCHAR)) AS digest, translate(rtrim(to_base64(encode(p_name)), '='), '+/', '-_') AS packed, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS safe FROM part")
def x_text_functions(s, d):
    return table(s, d, "part").select("p_partkey", sc.digest(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("digest"), sc.base64_url(F.col("p_name").cast("binary")).alias("packed"), sc.safe_id(F.col("p_brand")).alias("safe"))


_HASH = "list_reduce([0::BIGINT] || [CAST(ascii(p_name[i]) AS BIGINT) FOR i IN range(1, length(p_name) + 1)], lambda h, c: (h * 31 + c) % 4294967296)"


@query(f"WITH x AS (SELECT p_partkey, {_HASH} AS u FROM part), y AS (SELECT p_partkey, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS hv FROM x), z AS (SELECT p_partkey, hv, floor((4.0 + ((hv % 500 + 500) % 500) / 100.0) * 1e6 + 0.5) / 1e6 AS v, floor((0.5 + (((CAST(floor(hv / 256.0) AS BIGINT)) % 50 + 50) % 50) / 100.0) * 1e6 + 0.5) / 1e6 AS a FROM y) SELECT p_partkey, CAST(v AS DOUBLE) AS potency_value, CAST(floor((1.0 - a) * 1e6 + 0.5) / 1e6 AS DOUBLE) AS potency_uncertainty, CAST(a AS DOUBLE) AS potency_applicability, CASE WHEN a < 0.6 THEN 'OUT_OF_DOMAIN' ELSE 'SUCCESS' END AS potency_status FROM z")
def l7_reference_prediction(s, d):
    return _predicted(s, d).select("p_partkey", *[f"potency_{c}" for c in ("value", "uncertainty", "applicability", "status")])


def _predicted(s, d):
    registry = pr.Registry()
    registry.register(pr.Capability("reference", "potency", pr.reference_predictor, 1))
    return registry.predict(table(s, d, "part"), "potency", "p_name")


@query("WITH " + SQL["l7_reference_prediction"].removeprefix("WITH ").replace("SELECT p_partkey, CAST(v AS DOUBLE)", ", q AS (SELECT p_partkey, CAST(v AS DOUBLE)", 1) + ") SELECT p_brand, count(*) AS total, count(*) FILTER (potency_status = 'SUCCESS') AS success, count(*) FILTER (potency_status = 'OUT_OF_DOMAIN') AS out_of_domain, 0::BIGINT AS failure FROM q JOIN part USING (p_partkey) GROUP BY 1")
def a26_prediction_summary(s, d):
    return pr.run_summary(_predicted(s, d), "potency_status", ["p_brand"])
