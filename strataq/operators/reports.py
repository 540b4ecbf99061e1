"""Facts in words: one-row tables of counts as sentences, changes as lines, and a report in Markdown. The same facts give the same words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataq.functions.classes import count_of, listed, thousands


def auth_headline(stats: DataFrame) -> DataFrame:
    """tone, headline, caveats of each row of counts (routes, open, unreadable, public, unread_files, likely_only).

    No routes and no unread file: no row. A clean answer that rests on likely checks alone says so.
    """
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("routes", "open", "unreadable", "public", "unread_files", "likely_only")}
    total, one = c["routes"].cast("string"), c["routes"] == 1
    files = count_of(c["unread_files"], "file")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    base = (
        F.when(c["routes"] == 0, say("no routes were found, but ", files, " could not be read, so this is not the same as saying there are none"))
        .when(c["open"] > 0, F.when(one, "the one route has no auth check that can be seen").otherwise(say(c["open"], " of ", total, " routes have no auth check that can be seen")))
        .when(c["unreadable"] > 0, say("nothing is left unexplained, but ", c["unreadable"], " of the ", total, " routes lean on a file that could not be read"))
        .when(c["public"] > 0, say("every one of the ", total, " routes is checked, or open on purpose"))
        .otherwise(F.when(one, "the one route has an auth check").otherwise(say("every one of the ", total, " routes has an auth check")))
    )
    clean = (c["routes"] > 0) & (c["open"] == 0) & (c["unreadable"] == 0) & (c["likely_only"] > 0)
    checked = c["routes"] - c["public"]
    hedge = F.when(clean, F.when(c["likely_only"] == checked, F.when(checked == 1, " - matched, not proven").otherwise(" - all matched, none proven")).otherwise(say(", though ", c["likely_only"], " of those were matched rather than proven"))).otherwise("")
    named_public = (c["open"] == 0) & (c["unreadable"] == 0)
    caveats = F.array_compact(F.array(
        F.when((c["open"] > 0) & (c["unreadable"] > 0), say(c["unreadable"], " more lean on a file that could not be read")),
        F.when((c["routes"] > 0) & (c["public"] > 0) & ~named_public, say(c["public"], " more are pages or the door people sign in through, open on purpose")),
        F.when((c["routes"] > 0) & (c["unread_files"] > 0), say(files, " could not be read; what they declare is missing from every number here")),
        F.when(clean, F.when(c["likely_only"] == checked, "every check was matched by a pattern rather than proven").otherwise(say(c["likely_only"], " of the checks were matched by a pattern rather than proven"))),
    ))
    tone = F.when((c["open"] > 0) | (c["unreadable"] > 0) | (c["routes"] == 0), "warn").otherwise("ok")
    return stats.filter((c["routes"] > 0) | (c["unread_files"] > 0)).select(tone.alias("tone"), F.concat(base, hedge).alias("headline"), caveats.alias("caveats"))


def change_report(changes: DataFrame, doors: DataFrame, shown: int = 8) -> DataFrame:
    """place, line: what changed (kind, change, as ``history.diff`` gives) and which doors (change, name, writes), in words.

    A change of doors names the first ``shown`` and says how many there are in all.
    """
    counted = changes.groupBy("change", "kind").agg(F.count(F.lit(1)).alias("n"))
    of_kind = counted.groupBy("change").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k")).select(
        F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2).alias("place"),
        F.concat(F.col("change"), F.lit(": "), listed(F.transform("k", lambda x: F.concat_ws(" ", thousands(x["n"]), x["kind"])))).alias("line"),
    )
    order = W.partitionBy("change").orderBy(F.desc("writes"), "name")
    first = doors.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= shown).groupBy("change").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("d"))
    totals = doors.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    of_doors = first.join(totals, "change").select(
        F.when(F.col("change") == "new", 3).when(F.col("change") == "lost-check", 4).otherwise(5).alias("place"),
        F.concat(count_of(F.col("n"), "door"), F.lit(" "), F.col("change"), F.lit(": "), listed(F.transform("d", lambda x: x["name"]))).alias("line"),
    )
    return of_kind.unionByName(of_doors).orderBy("place", "line")


def markdown(sections: DataFrame) -> DataFrame:
    """line_no, text: a report of ``sections`` (section, place, title, line): a heading per section in order, its lines as items.

    Lines are numbered from 1 in one pass over sections; a section without lines has its heading alone.
    """
    heads = sections.groupBy("section").agg(F.min("title").alias("title"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    items = F.transform(F.filter("l", lambda x: x["line"].isNotNull()), lambda x: F.concat(F.lit("- "), F.regexp_replace(x["line"], r"[\r\n]+", " ")))
    text = F.concat(F.array(F.concat(F.lit("## "), F.coalesce("title", F.lit(""))), F.lit("")), items, F.array(F.lit("")))
    lines = heads.select("section", F.posexplode(text).alias("at", "text"))
    before = lines.groupBy("section").agg(F.count(F.lit(1)).alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(W.orderBy("section").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a section
    return lines.join(F.broadcast(before.select("section", "skip")), "section").select((F.col("skip") + F.col("at") + 1).cast("int").alias("line_no"), "text").orderBy("line_no")
