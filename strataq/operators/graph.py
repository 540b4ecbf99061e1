"""Operators on property graphs held as two tables: nodes (id, kind, name, parent_id, ...) and edges (kind, from_id, to_id, weight, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataq.operators.scale import BROADCAST_BYTES, cut, measured, sized_join

#: The order in which kinds are listed, and the score of a match in a search.
KIND_ORDER = ["app", "zone", "module", "file", "type", "function", "endpoint", "service", "store"]
KIND_BONUS = {"module": 8, "file": 6, "type": 4}
#: Kinds that stand for the world outside a level.
WORLD_KINDS = ["store", "service", "endpoint"]


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes; null ends are none.

    The distinct ends, combined before any shuffle, are checked against the nodes, and what is missing among them, by key and
    salted where an end is hot, takes its edges away.
    """
    ids = nodes.select(F.col("id").alias("end")).filter(F.col("end").isNotNull()).distinct()
    whole = edges.filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    ends = whole.select(F.explode(F.array("from_id", "to_id")).alias("end")).distinct()
    gone = cut(ends.join(ids, "end", "left_anti").withColumn("__gone", F.lit(True)))
    for side in ("from_id", "to_id"):
        whole = sized_join(whole, gone.select(F.col("end").alias(side), "__gone"), side, "left").filter(F.col("__gone").isNull()).drop("__gone").select(*edges.columns)
    return whole


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (kind, from_id, to_id): weights summed, symbols as a sorted set, the confidence of the first (by ordinal)."""
    return edges.groupBy("kind", "from_id", "to_id").agg(
        F.sum("weight").alias("weight"), F.min_by("confidence", "ordinal").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("symbols", F.array().cast("array<string>")))))).alias("symbols"),
    )


def closure(path_rows: DataFrame) -> DataFrame:
    """node_id, ancestor_id, distance of ``hierarchy.paths``, the node itself included at distance 0."""
    return path_rows.select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id")).select("node_id", "ancestor_id", (F.col("depth") - F.col("at")).alias("distance"))


def children_of_level(path_rows: DataFrame, level: str) -> DataFrame:
    """node_id, child: under which child of ``level`` each node below it lies. No join: the child stands in the path."""
    at = F.array_position("path", level)
    return path_rows.filter((at > 0) & (at < F.size("path"))).select("node_id", F.element_at("path", (at + 1).cast("int")).alias("child"))


def level_rollup(path_rows: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """from_id, to_id, weight, kinds: the relations lifted to the children of a level, without those inside one child.

    Ends outside the level drop out. Kinds are a sorted, comma-joined set.
    """
    child = cut(children_of_level(path_rows, level))
    rel = edges.filter((F.col("kind") != "contains") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select("kind", "from_id", "to_id", "weight")
    a = sized_join(rel, child.select(F.col("node_id").alias("from_id"), F.col("child").alias("cf")), "from_id")
    b = sized_join(a, child.select(F.col("node_id").alias("to_id"), F.col("child").alias("ct")), "to_id")
    return b.filter(F.col("cf") != F.col("ct")).groupBy(F.col("cf").alias("from_id"), F.col("ct").alias("to_id")).agg(
        F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")
    )


def outside_flows(path_rows: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """child, direction (in, out), weight: relations of each child of a level with what lies outside the level."""
    child = cut(children_of_level(path_rows, level))
    rel = edges.filter((F.col("kind") != "contains") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select("from_id", "to_id", "weight")
    a = sized_join(rel, child.select(F.col("node_id").alias("from_id"), F.col("child").alias("cf")), "from_id", "left")
    b = sized_join(a, child.select(F.col("node_id").alias("to_id"), F.col("child").alias("ct")), "to_id", "left")
    out = b.filter(F.col("cf").isNotNull() & F.col("ct").isNull()).select(F.col("cf").alias("child"), F.lit("out").alias("direction"), "weight")
    inn = b.filter(F.col("ct").isNotNull() & F.col("cf").isNull()).select(F.col("ct").alias("child"), F.lit("in").alias("direction"), "weight")
    return out.unionByName(inn).groupBy("child", "direction").agg(F.sum("weight").alias("weight"))


def world_flows(path_rows: DataFrame, nodes: DataFrame, edges: DataFrame, level: str, limit: int = 8) -> DataFrame:
    """world_id, child, direction, weight, kinds, total, place: relations of a level's children with the world outside it.

    The far end counts as its nearest ancestor-or-self that is a store, service or endpoint; without one, or if that is the
    level or one of its children, there is none. ``total`` is the weight of all flows of a world node; those of the ``limit``
    heaviest, the first by id among equals, come out.
    """
    child = cut(children_of_level(path_rows, level))
    of_kind = nodes.filter(F.col("kind").isin(WORLD_KINDS)).select(F.col("id").alias("ancestor_id")).distinct()
    world = cut(closure(path_rows).join(of_kind, "ancestor_id").groupBy("node_id").agg(F.min_by("ancestor_id", "distance").alias("world_id")))
    rel = edges.filter((F.col("kind") != "contains") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select("kind", "from_id", "to_id", "weight")
    a = sized_join(rel, child.select(F.col("node_id").alias("from_id"), F.col("child").alias("cf")), "from_id", "left")
    b = sized_join(a, child.select(F.col("node_id").alias("to_id"), F.col("child").alias("ct")), "to_id", "left")
    crossing = b.filter(F.col("cf").isNull() != F.col("ct").isNull())
    out = F.col("cf").isNotNull()
    far = crossing.select(F.when(out, F.col("to_id")).otherwise(F.col("from_id")).alias("node_id"), F.coalesce("cf", "ct").alias("child"), F.when(out, "out").otherwise("in").alias("direction"), "kind", "weight")
    met = sized_join(far, world, "node_id").join(F.broadcast(child.select(F.col("child").alias("world_id")).distinct()) if measured(child)[1] <= BROADCAST_BYTES else child.select(F.col("child").alias("world_id")).distinct(), "world_id", "left_anti").filter(F.col("world_id") != level)
    flows = met.groupBy("world_id", "child", "direction").agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    totals = flows.groupBy("world_id").agg(F.sum("weight").alias("total")).orderBy(F.desc("total"), "world_id").limit(limit)
    placed = totals.withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), "world_id")))  # at most ``limit`` rows
    return flows.join(F.broadcast(placed), "world_id")


def nearest_of_kind(path_rows: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """node_id, nearest_id: the nearest ancestor-or-self of a kind. Nodes without one have no row."""
    of_kind = nodes.filter(F.col("kind") == kind).select(F.col("id").alias("ancestor_id")).distinct()
    return closure(path_rows).join(of_kind, "ancestor_id").groupBy("node_id").agg(F.min_by("ancestor_id", "distance").alias("nearest_id"))


def dominant(rows: DataFrame, group: str, value: str, weak: list[str]) -> DataFrame:
    """group, value, n: the commonest value of each group; weak values come last, then by count and name."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.struct((~F.col(value).isin(weak)).alias("strong"), F.col("n"))
    order = W.partitionBy(group).orderBy(F.desc(best), value)
    return counts.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def ranked_search(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Nodes by how well their name or path matches: equal 100, prefix 80, contained 60, in the path 30, plus a bonus by kind.

    Ordered by score, length of the name and id; a blank query matches nothing.
    """
    q = query.strip().lower()
    name, path = F.lower("name"), F.lower(F.coalesce("path", F.lit("")))
    base = F.when(name == q, 100).when(name.startswith(q), 80).when(name.contains(q), 60).when(path.contains(q), 30) if q else F.lit(None)
    bonus = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in KIND_BONUS.items()), F.lit(0))
    return nodes.select("id", "name", "kind", (base + bonus).cast("int").alias("score")).filter(F.col("score").isNotNull()).orderBy(F.desc("score"), F.length("name"), "id").limit(limit)


def neighbours(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node_id, direction, other_id, kind, weight, place, total: the heaviest links of each node and direction, with the uncapped total."""
    rel = edges.filter((F.col("kind") != "contains") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    both = rel.select(F.explode(F.array(
        F.struct(F.col("from_id").alias("node_id"), F.lit("out").alias("direction"), F.col("to_id").alias("other_id"), "kind", "weight"),
        F.struct(F.col("to_id").alias("node_id"), F.lit("in").alias("direction"), F.col("from_id").alias("other_id"), "kind", "weight"),
    )).alias("r")).select("r.*")
    totals = both.groupBy("node_id", "direction").agg(F.count(F.lit(1)).alias("total"))
    # the rank filter is pushed into the sort of each task before the shuffle (a group limit), so a hot node sends few rows
    order = W.partitionBy("node_id", "direction").orderBy(F.desc("weight"), "other_id", "kind")
    top = both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return top.join(totals, ["node_id", "direction"])


def reach(edges: DataFrame, starts: DataFrame, hops: int, kind: str = "references") -> DataFrame:
    """start_id, node_id, hops: what each start (id) reaches over edges of a kind in at most ``hops`` steps, by the fewest steps."""
    step = edges.filter((F.col("kind") == kind) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select(F.col("from_id").alias("node_id"), F.col("to_id").alias("next")).distinct()
    seen = cut(starts.select(F.col("id").alias("start_id"), F.col("id").alias("node_id"), F.lit(0).alias("hops")).distinct())
    edge_of = seen
    for n in range(1, hops + 1):
        new = edge_of.join(step, "node_id").select("start_id", F.col("next").alias("node_id"), F.lit(n).alias("hops")).distinct()
        edge_of = cut(new.join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti"))
        seen = seen.unionByName(edge_of)
    return seen.filter("hops > 0")


def rank(nodes: DataFrame, links: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float = 1e-7, one_task: int = BROADCAST_BYTES) -> DataFrame:
    """id, score: PageRank over ``links`` (src, dst; repeated links count twice), scores of sinks spread evenly.

    It stops after ``rounds`` rounds, or once a round moves all scores together by less than ``tolerance``. Links from a node to
    itself or to no node do not count. Links that measure at most ``one_task`` bytes are ranked in one task; beyond, each
    round is one join by key, one aggregation and a cut of the lineage, so the plan does not grow, and the two sums that the
    next round needs are the one row that comes to the driver.
    """
    ids = nodes.select("id").filter(F.col("id").isNotNull()).distinct()
    e = links.filter(F.col("src") != F.col("dst")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    degree = e.groupBy("src").agg(F.sum("m").alias("out"))
    e = cut(e.join(degree, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("share")))
    state = cut(ids.join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("sink")))
    n, size = measured(state)
    if n == 0:
        return state.select("id", F.lit(0.0).alias("score"))
    if size + measured(e)[1] <= one_task:
        return _rank_in_one_task(state, e, rounds, damping, tolerance)
    scores = state.withColumn("score", F.lit(1.0 / n))
    lost = scores.agg(F.sum(F.when(F.col("sink"), F.col("score")))).first()[0] or 0.0
    for _ in range(rounds):
        sent = scores.join(e, scores.id == e.src).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = (1 - damping) / n + damping * lost / n + damping * F.coalesce("got", F.lit(0.0))
        scores = cut(scores.join(sent.withColumnRenamed("dst", "id"), "id", "left").select("id", "sink", score.alias("score"), F.abs(score - F.col("score")).alias("moved")))
        lost, moved = scores.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("score"))), F.lit(0.0)), F.sum("moved")).first()
        if moved < tolerance:
            break
    return scores.select("id", "score")


def _rank_in_one_task(state: DataFrame, shares: DataFrame, rounds: int, damping: float, tolerance: float) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def run(batches):
        rows = pa.Table.from_batches(list(batches), pa.schema([("id", pa.string()), ("dst", pa.string()), ("share", pa.float64())])).sort_by([("id", "ascending"), ("dst", "ascending")])
        is_link = rows["dst"].is_valid().to_numpy(zero_copy_only=False)
        names = rows["id"].filter(pa.array(~is_link)).combine_chunks()
        at = lambda c: pa.compute.index_in(rows[c].filter(pa.array(is_link)), value_set=names).to_numpy()
        src, dst, share = at("id"), at("dst"), rows["share"].filter(pa.array(is_link)).to_numpy()
        n = len(names)
        sink = np.bincount(src, minlength=n) == 0
        score = np.full(n, 1.0 / n)
        for _ in range(rounds):
            new = (1 - damping) / n + damping * score[sink].sum() / n + damping * np.bincount(dst, score[src] * share, n)
            moved, score = np.abs(new - score).sum(), new
            if moved < tolerance:
                break
        yield pa.RecordBatch.from_arrays([names, pa.array(score)], ["id", "score"])

    rows = state.select("id", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("share")).unionByName(shares.select(F.col("src").alias("id"), "dst", "share"))
    return rows.coalesce(1).mapInArrow(run, "id string, score double")


def unused(candidates: DataFrame, uses: DataFrame, order: list[Column]) -> DataFrame:
    """Candidates (id, ...) whose id is in no row of ``uses`` (id), in a stable order."""
    return candidates.join(uses.filter(F.col("id").isNotNull()).distinct(), "id", "left_anti").orderBy(*order)


def longest_prefix(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """path, folder: the deepest of ``folders`` (folder) that a path lies in; null if none.

    The ancestors of each path become keys of an equi-join, so no pair of path and folder is compared.
    """
    part = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, F.lit(1), i), "/"))
    keyed = paths.select("path").distinct().select("path", F.explode(ancestors).alias("folder"))
    hit = keyed.join(folders.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return paths.select("path").distinct().join(hit, "path", "left")


def contained(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost span of each point: points (file, at, ...), spans (file, first, last, span).

    The lines of a file are halved again and again; a span goes to the few halves that make it up, at most two of each size, and
    each half keeps its innermost span alone. A point looks at the halves it lies in, one of each size up to the longest span, so
    points and spans of a file are never compared in pairs. The innermost is the shortest span that holds the point, the first by
    name among equals. Points in no span have none.
    """
    # at level k a half has 2^k lines; begin and end are those within the span, and an odd one belongs to no larger half within it
    begin, end = F.expr("-shiftright(-CAST(first AS BIGINT), level)"), F.expr("shiftright(CAST(last AS BIGINT) + 1, level)")
    length = F.col("last").cast("bigint") - F.col("first") + 1
    whole = spans.filter(F.col("file").isNotNull() & (F.col("first") <= F.col("last"))).withColumn("top", F.floor(F.log2(length)).cast("int") + 1)
    halves = whole.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).withColumn("half", F.explode(F.array_compact(F.array(
        F.when((begin < end) & (begin % 2 != 0), begin), F.when((begin < end) & (end % 2 != 0), end - 1),
    ))))
    key = F.struct(F.col("last") - F.col("first"), F.col("span"))
    inner = halves.groupBy("file", "level", "half").agg(F.min_by("span", key).alias("span"), F.min(key).alias("key"))
    top = whole.agg(F.max("top").alias("top"))
    places = points.filter(F.col("file").isNotNull() & F.col("at").isNotNull()).select("file", "at").distinct()
    # one row
    levels = places.crossJoin(F.broadcast(top)).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).withColumn("half", F.expr("shiftright(CAST(at AS BIGINT), level)"))
    best = levels.join(inner, ["file", "level", "half"]).groupBy("file", "at").agg(F.min_by("span", "key").alias("span"))
    return points.join(best, ["file", "at"], "left")
