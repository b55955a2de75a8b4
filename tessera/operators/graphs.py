"""Row graphs as edge tables (source, target, ...): degrees, neighbourhoods, paths, shells, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite, half_up
from tessera.operators import ranks
from tessera.sources.shared import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other: every edge from either end."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("neighbours"))


def degree_stats(edges: DataFrame) -> DataFrame:
    return stats_of_degrees(degrees(edges))


def stats_of_degrees(degrees: DataFrame) -> DataFrame:
    return degrees.agg(F.count(F.lit(1)).alias("nodes"), F.min("degree").alias("min_degree"), half_up(F.median("degree")).alias("median_degree"), F.max("degree").alias("max_degree"))


def isolated(rows: DataFrame, row_id: str, edges: DataFrame) -> DataFrame:
    nodes = both_ways(edges).select(F.col("node").alias(row_id)).distinct()
    return rows.select(row_id).join(nodes, row_id, "left_anti")


def similarity_stats(edges: DataFrame) -> DataFrame:
    return stats_of_values(ranks.ranked_values(edges, [], finite(F.col("similarity")), {"both": F.count_if("mutual")}))


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """``similarity_stats`` of edges that are counted by similarity: similarity, n, mutual."""
    return stats_of_values(ranks.ranked_counts(counts.select(F.col("similarity").alias("x"), "n", F.col("mutual").alias("both")), []))


def stats_of_values(values: DataFrame) -> DataFrame:
    quartiles = [half_up(ranks.quantile(p)).alias(name) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return values.agg(ranks.count().alias("edges"), F.coalesce(F.sum("both"), F.lit(0)).alias("mutual"), half_up(F.min("x")).alias("min"), *quartiles, half_up(F.max("x")).alias("max"))


def neighbours(edges: DataFrame, nodes: DataFrame, once: bool = False) -> DataFrame:
    """centre, other for each different edge from either end, with the other columns of ``nodes`` (node once, ...) for both as
    centre_<column> and other_<column>; edges with an end that isn't there are left out. An edge moves once to either end, and
    is turned round only then. ``once`` says that no two edges have the same ends, as in a similarity graph; others are made
    different first."""
    columns = [c for c in nodes.columns if c != "node"]
    end = lambda n: nodes.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns])
    pairs = edges.where("source is not null and target is not null").select(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"))
    met = (pairs if once else pairs.distinct()).join(end("low"), "low").join(end("high"), "high")
    ways = [F.struct(F.col(a).alias("centre"), F.col(b).alias("other"), *[F.col(f"{n}_{c}").alias(f"{as_}_{c}") for n, as_ in ((a, "centre"), (b, "other")) for c in columns]) for a, b in (("low", "high"), ("high", "low"))]
    return met.select(F.inline(F.when(F.col("low") == F.col("high"), F.array(ways[0])).otherwise(F.array(*ways))))


def neighbourhood(edges: DataFrame, centres: DataFrame, limit: int | None = 50, once: bool = False) -> DataFrame:
    """centre, other, degree, rank: neighbours by degree (of the whole graph), then id. Without a limit all, unranked. ``once``
    as in ``neighbours``."""
    nodes = degrees(edges).select("node", "degree").join(centres.select("node").distinct().withColumn("wanted", F.lit(True)), "node", "left")
    ranked = neighbours(edges, nodes, once).where("centre_wanted").select("centre", "other", F.col("other_degree").alias("degree"))
    if limit is None:
        return ranked
    rank = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("degree"), "other"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= limit)


def collapsed(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """Per neighbour of a centre: edges, different transforms and the deltas' statistics. An edge moves once, to its pair
    of nodes; the pair is summed once, from sorted rows, and stands at both of its nodes."""
    pair = ["low", "high"]
    ends = edges.select(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"), "transform_id", "delta").repartition(*pair)
    own = Window.partitionBy(*pair)
    other = F.col("transform_id").isNotNull() & ~F.col("transform_id").eqNullSafe(F.lag("transform_id").over(own.orderBy("transform_id")))
    placed = ends.withColumn("other", other).withColumns({"place": F.row_number().over(own.orderBy(F.asc_nulls_last("delta"))), "n": F.count("delta").over(own)})
    middle = F.when((2 * F.col("place") >= F.col("n")) & (2 * F.col("place") <= F.col("n") + 2) & ((F.col("n") % 2 == 0) | (2 * F.col("place") == F.col("n") + 1)), F.col("delta"))
    summed = placed.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("edges"), F.count_if("other").alias("transforms"), half_up(F.avg("delta")).alias("mean_delta"),
        half_up(F.avg(middle)).alias("median_delta"), half_up(F.min("delta")).alias("min_delta"), half_up(F.max("delta")).alias("max_delta"),
    )
    ways = [F.struct(F.col(a).alias("centre"), F.col(b).alias("other")) for a, b in (pair, pair[::-1])]
    loop = F.col("low") == F.col("high")  # stands twice at its one node
    both = summed.withColumn("edges", F.when(loop, 2 * F.col("edges")).otherwise(F.col("edges"))).select("*", F.inline(F.when(loop, F.array(ways[0])).otherwise(F.array(*ways)))).drop(*pair)
    return both.join(centres.select(F.col("node").alias("centre")), "centre", "left_semi").select("centre", "other", "edges", "transforms", "mean_delta", "median_delta", "min_delta", "max_delta")


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi").select(edges.columns)


def distances(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """node, distance, parent: hops from the start nodes, at most ``most``. Each level joins its frontier with
    the edges and drops what was reached before; a node's parent is its smallest neighbour one level up. Edges are stored as
    they stand, and turned round as they are read; a level's grouping drops what repeats."""
    step = both_ways(cut(edges.select("source", "target").where("source <> target"), "edges"))
    found = cut(start.select("node", F.lit(0).alias("distance"), F.lit(None).cast("long").alias("parent")).distinct(), "reached")
    frontier = found
    for hop in range(1, most + 1):
        ahead = step.join(frontier.select("node"), "node").groupBy(F.col("other").alias("node")).agg(F.min("node").alias("parent"))
        frontier = cut(ahead.join(found, "node", "left_anti").select("node", F.lit(hop).alias("distance"), "parent"), "reached")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def shells(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """distance, label, rows: an exclusive group for each number of hops."""
    counts = distances(edges, start, most).where("distance > 0").groupBy("distance").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("label", F.concat(F.col("distance").cast("string"), F.when(F.col("distance") == 1, " hop").otherwise(" hops")))


def shortest_path(edges: DataFrame, source: int, target: int, most: int = 0) -> tuple[str, list[int]]:
    """(reason, path): ``connected`` with the rows from source to target, or why there is no path. ``most``
    bounds the hops; 0 is no bound. One row per hop comes to the driver."""
    ends = both_ways(edges).where(F.col("node").isin(source, target)).select("node").distinct()
    inside = {r["node"] for r in ends.collect()}
    missing = [n for n, x in (("source", source), ("target", target)) if x not in inside]
    if missing:
        return ("rows_not_in_graph" if len(missing) == 2 else f"{missing[0]}_not_in_graph"), []
    if source == target:
        return "same_row", [source]
    spark = edges.sparkSession
    step = cut(both_ways(edges).where("node <> other").distinct(), "edges")
    found = spark.createDataFrame([(source, None)], "node long, parent long")
    frontier, hop = found, 0
    while most == 0 or hop < most:
        hop += 1
        ahead = step.join(frontier.select("node"), "node").groupBy(F.col("other").alias("node")).agg(F.min("node").alias("parent"))
        frontier = cut(ahead.join(found, "node", "left_anti").select("node", "parent"), "reached")
        if frontier.isEmpty():
            return "no_path", []
        found = found.unionByName(frontier)
        if not frontier.where(F.col("node") == target).isEmpty():
            path = [target]
            while path[-1] != source:
                path.append(found.where(F.col("node") == path[-1]).first()["parent"])
            return "connected", path[::-1]
    return "max_depth_exceeded", []


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): least labels over edges, with a jump to the label's label."""
    own = cut(edges.select("source", "target"), "edges")  # they are read from either end, but made once
    step = cut(both_ways(own).where("node <> other").distinct(), "edges")
    label = cut(step.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        heard = step.join(label.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("heard"))
        nearer = label.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        roots = label.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = cut(nearer.join(roots, "component", "left").select("node", "was", F.coalesce("root", "component").alias("component")), "labels")
        label = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return label


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def parents(edges: DataFrame, order: DataFrame) -> DataFrame:
    """child, parent, score: for each row the best edge to an earlier one, by score, then the later parent,
    then its id. ``edges`` (source, target, score), ``order`` (node, place)."""
    place = lambda n: order.select(F.col("node").alias(n), F.col("place").alias(f"{n}_place"))
    directed = edges.select(F.col("source").alias("child"), F.col("target").alias("parent"), "score").unionByName(edges.select(F.col("target").alias("child"), F.col("source").alias("parent"), "score"))
    return best_parents(directed.join(place("child"), "child").join(place("parent"), "parent").where("parent_place < child_place"))


def best_parents(earlier: DataFrame) -> DataFrame:
    """The rows of ``earlier`` (child, parent, score, parent_place) that ``parents`` takes."""
    best = F.row_number().over(Window.partitionBy("child").orderBy(F.desc("score"), F.desc("parent_place"), "parent"))
    return earlier.withColumn("_r", best).where("_r = 1").select("child", "parent", "score")


def paths(edges: DataFrame, requests: DataFrame, most: int = 0) -> DataFrame:
    """source, target, reason, hops, path for every different request (source, target): a shortest path, or why there is
    none (same_row, source_not_in_graph, target_not_in_graph, rows_not_in_graph, no_path, max_depth_exceeded). ``most``
    bounds the hops; 0 is no bound.

    All requests walk at once, from both ends in turn, a whole level each time; a request whose frontiers have met walks
    no further. Parents are joined back level by level, so the driver sees no row of a path. Of several shortest paths:
    over the least meeting row, by least parents."""
    step = cut(both_ways(edges).where("node <> other").distinct(), "edges")
    inside = both_ways(edges).select("node").distinct()
    asked = cut(requests.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct(), "requests")
    found = asked.join(inside.select(F.col("node").alias("source"), F.lit(True).alias("s")), "source", "left").join(inside.select(F.col("node").alias("target"), F.lit(True).alias("t")), "target", "left")
    reason = F.when(F.col("s").isNull() & F.col("t").isNull(), "rows_not_in_graph").when(F.col("s").isNull(), "source_not_in_graph").when(F.col("t").isNull(), "target_not_in_graph").when(F.col("source") == F.col("target"), "same_row")
    known = cut(found.select("source", "target", reason.alias("reason")), "known")
    ids, walk = ["source", "target"], known.where("reason is null").select("source", "target")
    start = lambda end: cut(walk.select(*ids, F.col(end).alias("node"), F.lit(0).alias("hop"), F.lit(None).cast("long").alias("parent")), "reached")
    sides = [start("source"), start("target")]
    fronts, depth, active = list(sides), [0, 0], cut(walk, "active")
    out, ended = [], []
    while not active.isEmpty():
        if most and sum(depth) >= most:
            ended.append(active.withColumn("reason", F.lit("max_depth_exceeded")))
            break
        turn = 0 if depth[0] <= depth[1] else 1
        depth[turn] += 1
        ahead = fronts[turn].join(active, ids, "left_semi").join(step, "node").groupBy(*ids, F.col("other").alias("node")).agg(F.min("node").alias("parent"))
        fronts[turn] = cut(ahead.join(sides[turn], [*ids, "node"], "left_anti").select(*ids, "node", F.lit(depth[turn]).alias("hop"), "parent"), "reached")
        sides[turn] = sides[turn].unionByName(fronts[turn])
        other = sides[1 - turn].select(*ids, "node")
        met = fronts[turn].join(other, [*ids, "node"], "left_semi").groupBy(*ids).agg(F.min("node").alias("meet"))
        growing = fronts[turn].select(*ids, F.lit(True).alias("growing")).distinct()
        state = cut(active.join(met, ids, "left").join(growing, ids, "left"), "state")
        out.append(state.where("meet is not null").select(*ids, "meet", F.lit(depth[0]).alias("ahead"), F.lit(depth[1]).alias("back")))
        # a frontier that found nothing new has seen all it can reach
        ended.append(state.where("meet is null and growing is null").select(*ids, F.lit("no_path").alias("reason")))
        active = state.where("meet is null and growing").select(*ids)
    none = known.where("reason is not null").unionByName(reduce(DataFrame.unionByName, ended, known.limit(0)))
    lone = F.when(F.col("reason") == "same_row", F.array("source")).otherwise(F.array().cast("array<bigint>"))
    rows = none.select(*ids, "reason", F.when(F.col("reason") == "same_row", 0).alias("hops"), lone.alias("path"))
    if not out:
        return rows
    held = reduce(DataFrame.unionByName, out)
    walked = held.select(*ids, "ahead", "back", F.array("meet").alias("path"), F.col("meet").alias("first"), F.col("meet").alias("last"))
    for side, end, most_hops in ((0, "first", depth[0]), (1, "last", depth[1])):
        parents = sides[side].where("hop > 0").select(*ids, F.col("node").alias(end), "parent")
        for hop in range(most_hops):
            joined = walked.join(parents, [*ids, end], "left")
            longer = F.concat(F.array("parent"), "path") if side == 0 else F.concat("path", F.array("parent"))
            walked = joined.select(*ids, "ahead", "back", F.when(F.col("parent").isNull(), F.col("path")).otherwise(longer).alias("path"), *[(F.coalesce("parent", end) if e == end else F.col(e)).alias(e) for e in ("first", "last")])
            walked = cut(walked, "walked") if hop % 4 == 3 else walked  # a plan of bounded length
    return rows.unionByName(walked.select(*ids, F.lit("connected").alias("reason"), (F.size("path") - 1).alias("hops"), "path"))


def lanes(parents: DataFrame, order: DataFrame) -> DataFrame:
    """node, root, lane, first, leaves of the forest that ``parents`` (child, parent) makes of the rows of ``order`` (node,
    place): leaves stand on lanes 0, 1, ... in the order of a walk through roots and children by place, and a row stands
    in the middle between its first and its last leaf. Sums over subtrees and along paths double their reach each round,
    so a chain of n rows takes about log2(n) rounds."""
    rows = order.select("node", "place").join(parents.select(F.col("child").alias("node"), "parent"), "node", "left")
    up = cut(rows.select("node", "place", "parent", F.col("parent").alias("above")), "forest")
    inner = up.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    leaves = cut(up.join(inner, "node", "left").select("node", "above", F.when(F.col("inner"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n"), F.col("node").alias("root")), "leaves")
    while not leaves.where("above is not null").isEmpty():
        below = leaves.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.sum("n").alias("more"))
        jump = leaves.select(F.col("node").alias("above"), F.col("above").alias("further"), F.col("root").alias("top"))
        leaves = cut(leaves.join(below, "node", "left").join(jump, "above", "left").select("node", F.col("further").alias("above"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("top", "root").alias("root")), "leaves")
    sized = up.select("node", "place", "parent").join(leaves.select("node", "n", "root"), "node")
    # lanes that the siblings before a row take (of a root: the roots before it), summed along the path to the root
    siblings = Window.partitionBy("parent").orderBy("place", "node").rowsBetween(Window.unboundedPreceding, -1)
    children = sized.where("parent is not null").withColumn("shift", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
    roots = _summed_before(sized.where("parent is null"))
    path = cut(children.unionByName(roots).select("node", "root", "n", F.col("parent").alias("above"), "shift"), "shifts")
    while not path.where("above is not null").isEmpty():
        jump = path.select(F.col("node").alias("above"), F.col("above").alias("further"), F.col("shift").alias("more"))
        path = cut(path.join(jump, "above", "left").select("node", "root", "n", F.col("further").alias("above"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "shifts")
    return path.select("node", "root", (F.col("shift") + (F.col("n") - 1) / 2.0).alias("lane"), F.col("shift").alias("first"), F.col("n").alias("leaves"))


def _summed_before(roots: DataFrame) -> DataFrame:
    """Roots with ``shift``, the leaves of all roots before them; ranges of roots are summed side by side."""
    ranges = cut(roots.repartitionByRange("place", "node").withColumn("_range", F.spark_partition_id()), "roots")
    sizes = ranges.groupBy("_range").agg(F.sum("n").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy("place", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("shift", own).join(F.broadcast(before), "_range").withColumn("shift", F.col("shift") + F.col("_before")).drop("_range", "_before")
