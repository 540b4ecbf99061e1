"""Forests against a walk up the parents, node by node."""

import random

import pytest

from strataq.operators import hierarchy


def walk(rows):
    up = {}
    for n, p in rows:
        if n is not None and (n not in up or (p is not None and (up[n] is None or p < up[n]))):
            up[n] = p
    out = {}
    for n in up:
        path, at = [n], n
        while up[at] is not None and up[at] in up:
            at = up[at]
            if at in path:
                path = None
                break
            path.append(at)
        out[n] = (None, -1, None) if path is None else (at, len(path) - 1, path[::-1])
    return out


def rows(kind):
    rnd = random.Random(4)
    if kind == "random":
        r = [(f"n{i}", f"n{rnd.randrange(i)}" if i and rnd.random() > 0.05 else None) for i in range(400)]
    elif kind == "deep":
        r = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)]
    elif kind == "star":
        r = [(f"n{i}", "n0" if i else None) for i in range(400)]
    elif kind == "circles":
        r = [(f"n{i}", f"n{(i * 7 + 3) % 200}") for i in range(200)] + [("a", "a"), ("b", "a"), ("r", None), ("s", "r")]
    else:
        r = [("x", "gone"), ("y", "x"), ("y", "x"), ("z", ""), (None, "x"), ("", None), ("é" * 5000, "y"), ("t", "y"), ("t", "x"), ("t", None)]
    rnd.shuffle(r)
    return r + r[:5]


SMALL = (150, 60, 0.95)


@pytest.mark.parametrize("kind,last,part,shrink", [
    ("dirty", 50_000, 200_000, 0.7), ("random", *SMALL), ("deep", *SMALL), ("star", *SMALL), ("circles", *SMALL), ("dirty", 2, 3, 0.95), ("circles", 150, 60, 0.0)])
def test_paths(spark, monkeypatch, kind, last, part, shrink):
    monkeypatch.setattr(hierarchy, "LAST_ROWS", last)
    monkeypatch.setattr(hierarchy, "PARTITION_ROWS", part)
    monkeypatch.setattr(hierarchy, "SHRINK", shrink)
    r = rows(kind)
    # extra columns named as those used inside must not disturb
    df = spark.createDataFrame([(a, b, "t", 1) for a, b in r], "id string, parent_id string, top string, weight int")
    got = {x.node_id: (x.root_id, x.depth, x.path) for x in hierarchy.paths(df).collect()}
    assert got == walk(r)
    assert sum(1 for _ in hierarchy.forest(df).collect()) == len(got)


def test_closure_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    p = hierarchy.paths(df)
    assert {tuple(x) for x in hierarchy.descendants(p).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {tuple(x) for x in hierarchy.descendant_counts(p).collect()} == {("a", 2), ("b", 1)}
    assert hierarchy.paths(df.limit(0)).collect() == []
