"""Parent-child links of unknown depth to full hierarchies, by contraction of partition-local chains.

Each task follows the parent links that stay within its partition, so that a whole fragment of the forest shrinks to
its exit: the last local node and the parent outside. The exits form a smaller forest, the quotient, which is solved
the same way; then the answers of the quotient are carried back to the nodes of each fragment. Chains that
close within a partition are local circles, those that close in the quotient are global ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.scale import cut, sized_join

#: Rows that one task contracts; a locality group beyond this is split by hash.
PARTITION_ROWS = 200_000
#: A quotient of at most so many rows is solved by one task.
LAST_ROWS = 50_000
#: A quotient that keeps more than this share of its rows is solved by pointer doubling instead.
SHRINK = 0.7

#: A link's ``way`` names the nodes from the parent (excluded) to the node (included); null where no paths are asked for.
_WAY = "array<string>"
_FRAGMENT = f"node string, top string, steps int, exit string, weight int, way {_WAY}, exit_way {_WAY}"
_ARROW = pa.schema(
    [("node", pa.string()), ("top", pa.string()), ("steps", pa.int32()), ("exit", pa.string()), ("weight", pa.int32()),
     ("way", pa.list_(pa.string())), ("exit_way", pa.list_(pa.string()))]
)


def _fragments(with_path: bool, batch_rows: int = 20_000):
    """Contract the chains of one partition.

    For each node its ``top`` (null if the chain runs in a circle here) with the steps and the way from there; for the
    tops also the parent outside (null at a root) with the weight and way of that link.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[str, tuple] = {}
        for b in batches:
            for n, p, w, way in zip(*(c.to_pylist() for c in b.columns)):
                old = up.get(n)
                # of rows that disagree the smallest non-null parent counts, in whatever order they arrive
                if old is None or (p is not None and (old[0] is None or p < old[0])):
                    up[n] = (p, w, way)
        found: dict[str, tuple[str | None, int]] = {}
        for start in up:
            chain: list[str] = []
            on: set[str] = set()
            at = start
            while True:
                if at in found:
                    top, steps = found[at]
                    break
                if at in on:  # a circle: all of it, and all that leads into it, never ends
                    top, steps = None, -1
                    break
                parent = up[at][0]
                if parent is None or parent not in up:
                    top, steps = found[at] = (at, 0)
                    break
                on.add(at)
                chain.append(at)
                at = parent
            for n in reversed(chain):
                if top is not None:
                    steps += up[n][1]
                found[n] = (top, steps)
        rows: list[tuple] = []
        for n, (top, steps) in found.items():
            way = None
            if with_path and top is not None:
                links, at = [], n
                while at != top:
                    links.append(up[at][2])
                    at = up[at][0]
                way = [x for link in reversed(links) for x in link]
            parent, weight, outer = up[n] if n == top else (None, None, None)
            rows.append((n, top, steps, parent, weight, way, outer))
            if len(rows) == batch_rows:
                yield batch(rows)
                rows = []
        yield batch(rows)

    return solve


def _contract(links: DataFrame, rows: int, with_path: bool) -> DataFrame:
    """``links``: node, parent, weight, way, locality. Result: the columns of _FRAGMENT."""
    if rows <= LAST_ROWS:
        placed = links.coalesce(1)
    else:
        sizes = links.groupBy("locality").agg(F.count(F.lit(1)).alias("__n"))
        # fewer than rows / PARTITION_ROWS groups can be that big: broadcast while they are few, joined and salted beyond
        big = cut(sizes.filter(F.col("__n") > PARTITION_ROWS).select("locality", F.ceil(F.col("__n") / PARTITION_ROWS).cast("int").alias("__k")))
        parts = max(-(-rows // PARTITION_ROWS), int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed = sized_join(links, big, "locality", "left").repartition(
            parts, "locality", F.pmod(F.xxhash64("node"), F.coalesce("__k", F.lit(1)))
        )
    return placed.select("node", "parent", "weight", "way").mapInArrow(_fragments(with_path), _FRAGMENT)


def _double(links: DataFrame) -> DataFrame:
    """Pointer doubling over node, parent, weight, way: the exact way for forests that contraction does not shrink.

    After round k every node within 2**k links of its root knows it. Since the links along a chain leave no gap, a
    round that ends no chain leaves only chains that never end.
    """
    root = F.col("parent").isNull()
    nothing = F.when(F.lit(False), F.array(F.lit("")))
    state = cut(links.select(
        "node", F.coalesce("parent", "node").alias("up"), F.when(root, 0).otherwise(F.col("weight")).cast("int").alias("steps"), root.alias("ended"),
        F.when(root & F.col("way").isNotNull(), F.array().cast(_WAY)).otherwise(F.coalesce(F.col("way"), nothing)).alias("way"),
    ))
    going = state.filter(~F.col("ended")).count()
    while going:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("ended").alias("ended2"), F.col("way").alias("way2"))
        # many chains meet in one node, at last in a root: such a key is spread
        moved = sized_join(state.filter(~F.col("ended")), above, "up").select(
            "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).cast("int").alias("steps"), F.col("ended2").alias("ended"), F.concat("way2", "way").alias("way")
        )
        state = cut(state.filter("ended").unionByName(moved))
        left = state.filter(~F.col("ended")).count()
        if left == going:
            break
        going = left
    return state.select(
        "node", F.when(F.col("ended"), F.col("up")).alias("root"), F.when(F.col("ended"), F.col("steps")).otherwise(-1).alias("depth"), F.when(F.col("ended"), F.col("way")).alias("way")
    )


def _solve(links: DataFrame, rows: int, with_path: bool) -> DataFrame:
    """node, root, depth and way (from the root, excluded); root null and depth -1 where the chain never ends."""
    parts = _contract(links, rows, with_path)
    if rows <= LAST_ROWS:  # one task saw every node: a parent outside is no node, so each top is a root
        return parts.select("node", F.col("top").alias("root"), F.col("steps").alias("depth"), "way")
    parts = cut(parts)
    tops = parts.filter(F.col("node") == F.col("top")).select("node", F.col("exit").alias("parent"), "weight", "exit_way")
    inside = parts.select(F.col("node").alias("parent"), F.col("top").alias("to"), F.col("steps").alias("further"), F.col("way").alias("inner"))
    circle = F.col("further") == -1
    quotient = cut(
        tops.filter(F.col("parent").isNull()).select("node", "parent", "weight", F.col("exit_way").alias("way")).unionByName(
            # an exit to no node makes a root; one into a local circle never ends: its fragment becomes its own parent
            # a folder may be the parent of many fragments, so the join is salted where it is not broadcast
            sized_join(tops.filter(F.col("parent").isNotNull()), inside, "parent", "left").select(
                "node", F.when(circle, F.col("node")).otherwise(F.col("to")).alias("parent"), (F.col("weight") + F.coalesce("further", F.lit(0))).cast("int").alias("weight"),
                F.coalesce(F.concat("inner", "exit_way"), F.col("exit_way")).alias("way"),
            )
        )
    )
    fragments = quotient.count()
    if fragments <= LAST_ROWS or fragments <= SHRINK * rows:
        groups = max(1, fragments // PARTITION_ROWS)
        above = _solve(quotient.withColumn("locality", F.pmod(F.xxhash64(F.coalesce("parent", "node")), F.lit(groups)).cast("string")), fragments, with_path)
    else:
        above = _double(quotient)
    above = cut(above.select(F.col("node").alias("top"), "root", "depth", F.col("way").alias("outer")))
    ended = F.col("root").isNotNull()
    return sized_join(parts.filter(F.col("top").isNotNull()).select("node", "top", "steps", "way"), above, "top").select(
        "node", "root", F.when(ended, F.col("depth") + F.col("steps")).otherwise(-1).cast("int").alias("depth"), F.when(ended, F.concat("outer", "way")).alias("way")
    ).unionByName(
        parts.filter(F.col("top").isNull()).select("node", F.lit(None).cast("string").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast(_WAY).alias("way"))
    )


def _links(nodes: DataFrame, key: str, parent: str, locality: Column | None, with_path: bool) -> DataFrame:
    node = F.col(key).cast("string")
    return nodes.filter(F.col(key).isNotNull()).select(
        node.alias("node"), F.col(parent).cast("string").alias("parent"), F.lit(1).alias("weight"), (F.array(node) if with_path else F.lit(None).cast(_WAY)).alias("way"),
        F.coalesce((locality if locality is not None else F.pmod(F.xxhash64(node), F.lit(4096))).cast("string"), F.lit("")).alias("locality"),
    )


def forest(nodes: DataFrame, key: str = "id", parent: str = "parent_id", locality: Column | None = None) -> DataFrame:
    """node_id, root_id and depth of every node; root_id is null and depth -1 where the chain of parents never ends.

    A root is a node without a parent or whose parent is no node (compared exactly); it has depth 0. Rows with a
    null key are no nodes. Repeated rows count once; where rows of one key disagree the smallest non-null
    parent counts. ``locality`` places nodes that are probably linked in one partition (default: by hash); it must be a
    function of the key, and changes the cost, never the result. An empty table gives an empty result.
    """
    links = _links(nodes, key, parent, locality, False)
    return _solve(links, links.count(), False).select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def paths(nodes: DataFrame, key: str = "id", parent: str = "parent_id", locality: Column | None = None) -> DataFrame:
    """As ``forest``, with ``path``: the ids from the root to the node, both included; null where it never ends."""
    links = _links(nodes, key, parent, locality, True)
    return _solve(links, links.count(), True).select(
        F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.when(F.col("root").isNotNull(), F.concat(F.array("root"), "way")).alias("path")
    )


def descendants(path_rows: DataFrame) -> DataFrame:
    """The closure of ``paths``: ancestor_id, node_id, distance, one row per node and proper ancestor."""
    return path_rows.select("node_id", "depth", F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("at", "ancestor_id")).select(
        "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance")
    )


def descendant_counts(path_rows: DataFrame) -> DataFrame:
    """ancestor_id with its number of proper descendants; counts are combined before they are shuffled."""
    return descendants(path_rows).groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("n_descendants"))
