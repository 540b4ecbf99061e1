"""Orphan references against a check of each reference by itself."""

from datetime import datetime as D
from datetime import timedelta

from strataq.operators import references as R

T0 = D(2025, 1, 1)


def test_orphans(spark):
    day = lambda n: None if n is None else T0 + timedelta(days=n)
    nodes = [("a", 0, None), ("a", 0, None), ("b", 10, None), ("c", 0, 20), ("d", None, None), ("", 0, None), (None, 0, None)]
    edges = [(f"e{i}", f, t, at) for i, (f, t, at) in enumerate([
        ("a", "b", 5), ("a", "b", 10), ("c", "c", 19), ("c", "a", 20), ("x", None, 3), ("d", "A", None), (None, "", 1), ("a ", "b", None), ("c", "x", 40)])]
    edges += edges[:4] + [(None, "x", "a", 2)]
    n = spark.createDataFrame([(i, day(a), day(b), "clash") for i, a, b in nodes], "id string, recorded_at timestamp, removed_at timestamp, since string")
    e = spark.createDataFrame([(i, f, t, day(a), 1) for i, f, t, a in edges], "id string, from_id string, to_id string, recorded_at timestamp, at int")
    life = {i: (a, b) for i, a, b in nodes if i is not None}

    def why(t, at):
        if t not in life:
            return "missing"
        a, b = life[t]
        if at is not None and a is not None and a > at:
            return "later"
        if at is not None and b is not None and b <= at:
            return "removed"

    want = {(k, f, w) for k, a, b, at in edges for f, t in (("from_id", a), ("to_id", b)) if t is not None and (w := why(t, at))}
    refs = R.references(e, "edges", "id", ["from_id", "to_id"], "recorded_at")
    got = R.orphans(refs, R.parents(n)).collect()
    assert len(got) == len(want) and {(x.ref_key, x.ref_field, x.reason) for x in got} == want
    report = R.orphan_report(refs, R.parents(n)).collect()
    assert sum(x.orphans for x in report) == len(want)
    assert R.orphans(refs.limit(0), R.parents(n)).count() == 0
    assert R.orphans(refs, R.parents(n.limit(0))).count() == refs.distinct().count()


def test_salted_join(spark):
    from pyspark.sql import functions as F

    from strataq.operators.scale import salted_join

    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("no", 3)], "k string, v int")
    assert sorted(map(tuple, salted_join(left, right, "k").select("k", "id", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "v").collect()))
    assert salted_join(left, right, "k", "left").count() == 3000
