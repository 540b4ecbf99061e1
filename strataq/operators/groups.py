"""Groups of files: a cut through the folder tree that keeps small folders whole, and what each group is made of."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataq.operators.graph import longest_prefix

#: Files from which a folder may be opened, and groups at most by opening.
SPLIT_ABOVE, MAX_GROUPS = 12, 12


def open_folders(folders: list[tuple[str, str | None, str, int, int]], split_above: int = SPLIT_ABOVE, max_groups: int = MAX_GROUPS) -> list[str]:
    """The ids of the cut of one tree of folders (id, parent_id, path, own files, files below).

    Starting from the roots the biggest folder with more than ``split_above`` files is replaced by its children, and keeps its
    place if it has files of its own. A folder whose opening makes more than ``max_groups`` groups stays shut, and the next
    biggest is tried. The roots themselves are never cut short.
    """
    children: dict[str | None, list] = defaultdict(list)
    ids = {f[0] for f in folders}
    for f in folders:
        children[f[1] if f[1] in ids else None].append(f)
    cut = {f[0] for f in children[None]}
    waiting = [(-f[4], f[2], f) for f in children[None]]
    heapq.heapify(waiting)
    while waiting:
        _, _, f = heapq.heappop(waiting)
        inside = children.get(f[0], [])
        if f[4] <= split_above or not inside:
            continue
        if len(cut) + len(inside) - (0 if f[3] else 1) > max_groups:
            continue
        if not f[3]:
            cut.discard(f[0])
        for k in inside:
            cut.add(k[0])
            heapq.heappush(waiting, (-k[4], k[2], k))
    return sorted(cut)


def folder_cut(folders: DataFrame, split_above: int = SPLIT_ABOVE, max_groups: int = MAX_GROUPS) -> DataFrame:
    """scope_id, id, path of the folders that the cut of each scope's tree keeps.

    ``folders`` has scope_id, id, parent_id, path, own and below. Choosing the next folder depends on all before, so a tree is
    cut in one task; only its top matters: folders with few files below are brought along solely where their parent may be
    opened, and trees of different scopes are cut side by side.
    """
    big = folders.filter(F.col("below") > split_above).select("scope_id", F.col("id").alias("parent_id"))
    known = folders.select("scope_id", F.col("id").alias("parent_id"), F.lit(True).alias("__known"))
    top = folders.join(known, ["scope_id", "parent_id"], "left").filter(F.col("__known").isNull()).drop("__known")
    needed = folders.join(big, ["scope_id", "parent_id"], "left_semi").unionByName(top.select(*folders.columns)).dropDuplicates(["scope_id", "id"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cut = set(open_folders([(r.id, None if pd.isna(r.parent_id) else r.parent_id, r.path or "", int(r.own), int(r.below)) for r in rows.itertuples()], split_above, max_groups))
        return rows[rows["id"].isin(cut)][["scope_id", "id", "path"]]

    return needed.select("scope_id", "id", "parent_id", "path", "own", "below").groupBy("scope_id").applyInPandas(run, "scope_id string, id string, path string")


def folder_counts(files: DataFrame) -> DataFrame:
    """scope_id, folder, own, below: files (scope_id, path) in each folder and in all below it; the top is the empty folder."""
    part = F.split("path", "/")
    depth = F.size(part) - 1
    above = F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(F.array_join(F.slice(part, F.lit(1), i), "/").alias("folder"), (i == depth).alias("own")))
    keyed = files.filter(F.col("path").isNotNull()).select("scope_id", F.explode(above).alias("f"))
    return keyed.groupBy("scope_id", "f.folder").agg(F.count_if(F.col("f.own")).alias("own"), F.count(F.lit(1)).alias("below"))


def assign(files: DataFrame, cut: DataFrame) -> DataFrame:
    """id, path, group of files (id, path): the deepest folder (path) of the cut that holds each; null where none does."""
    where = longest_prefix(files.select("path"), cut.select(F.col("path").alias("folder"))).withColumnRenamed("folder", "group")
    return files.select("id", "path").join(where, "path", "left").select("id", "path", "group")


def shape(files: DataFrame, members: int = 10) -> DataFrame:
    """group, n_files, zone, other_zones, names: what a group is made of, of files (group, zone, name): the commonest zone, test
    and config last, the others in order of their files, and the first names by order, as many as ``members``."""
    zones = files.groupBy("group", "zone").agg(F.count(F.lit(1)).alias("n"))
    weak = F.coalesce(F.col("zone").isin("test", "config"), F.lit(True))
    ranked = zones.groupBy("group").agg(F.sum("n").alias("n_files"), F.array_sort(F.collect_list(F.struct(weak.alias("weak"), (-F.col("n")).alias("less"), "zone"))).alias("z"))
    named = files.select("group", "name").filter(F.col("name").isNotNull()).distinct().withColumn("__at", F.row_number().over(W.partitionBy("group").orderBy("name"))).filter(F.col("__at") <= members)
    names = named.groupBy("group").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return ranked.join(names, "group", "left").select(
        "group", "n_files", F.get("z", F.lit(0))["zone"].alias("zone"), F.transform(F.slice("z", 2, F.greatest(F.size("z") - 1, F.lit(0))), lambda x: x["zone"]).alias("other_zones"), "names"
    )


def links(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """from_group, to_group, weight: edges (from_id, to_id, weight) between files of different groups (id, group)."""
    known = assigned.filter(F.col("group").isNotNull()).select("id", "group")
    # a pair of files is summed before it is joined, so an end with many edges is one row per partner
    pairs = edges.filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"))
    a = pairs.join(known.withColumnRenamed("id", "from_id").withColumnRenamed("group", "from_group"), "from_id")
    b = a.join(known.withColumnRenamed("id", "to_id").withColumnRenamed("group", "to_group"), "to_id")
    return b.filter("from_group <> to_group").groupBy("from_group", "to_group").agg(F.sum("weight").alias("weight"))


def collapse(folders: DataFrame) -> DataFrame:
    """folder, shown: folders (scope_id, folder, own, below) without those that merely lead to one other.

    A folder is passed through if it has no files and the one child that holds all its files; the top stays.
    """
    parent = F.regexp_replace("folder", "(^|/)[^/]+$", "")
    kids = folders.filter(F.col("folder") != "").groupBy("scope_id", parent.alias("folder")).agg(F.count(F.lit(1)).alias("n_kids"))
    return folders.join(kids, ["scope_id", "folder"], "left").select("scope_id", "folder", "own", "below", ((F.col("folder") == "") | ~((F.col("own") == 0) & (F.col("n_kids") == 1))).alias("shown"))
