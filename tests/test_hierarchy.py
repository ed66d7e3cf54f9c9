import random

from claimloom.operators import hierarchy as Y
from claimloom.operators import resolve as E
from claimloom.operators.links import build_links

from .factory import claim, claims


def closed(edges):
    parents = {}
    for c, p in edges:
        if None not in (c, p) and c != p:
            parents.setdefault(c, set()).add(p)
    out = set()
    for c in parents:
        todo, seen = list(parents[c]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents.get(x, ())
        out |= {(c, x) for x in seen if x != c}
    return out


def test_equal_to_the_closure(spark):
    rng = random.Random(3)
    deep = [(f"d{i:04}", f"d{i - 1:04}") for i in range(1, 1001)]  # a thousand deep
    bush = [(f"b{i:03}", f"b{rng.randrange(i):03}") for i in range(1, 200)] + [(f"b{i:03}", f"b{rng.randrange(i):03}") for i in rng.sample(range(1, 200), 40)]  # several parents
    edges = deep + bush + [("b007", "d0500"), ("b007", "b007"), (None, "b001"), ("b003", None), ("alone", "top"), bush[0]]
    frame = spark.createDataFrame(edges, "id string, parent string")
    want = closed(edges)
    below = [f"d{i:04}" for i in range(0, 1001, 97)] + [f"b{i:03}" for i in range(200)] + ["alone", "elsewhere", None]
    up = [f"d{i:04}" for i in range(0, 1001, 50)] + [f"b{i:03}" for i in range(0, 200, 3)] + ["top", "elsewhere"]
    got = [tuple(r) for r in Y.above(frame, spark.createDataFrame([(x,) for x in below], "o string"), spark.createDataFrame([(x,) for x in up], "up string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(o, u) for o, u in want if o in set(below) and u in set(up)}
    assert Y.labels(frame)[0].count() == len({x for e in edges for x in e if x} )


def test_loops_and_no_edges(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "id string, parent string")
    some = spark.createDataFrame([("a",), ("d",)], "o string")
    assert Y.labels(loop) is None
    assert {tuple(r) for r in Y.above(loop, some, some.toDF("up")).collect()} == {("d", "a")}
    assert Y.above(loop.limit(0), some, some.toDF("up")).count() == 0


def test_links_by_labels_equal_those_by_ancestors(spark):
    edges = [(f"LOCAL:x{i}", f"LOCAL:x{i - 1}") for i in range(1, 40)] + [("LOCAL:x9", "LOCAL:b"), ("LOCAL:y", "LOCAL:x20")]
    frame = spark.createDataFrame(edges, "id string, parent string")
    rows = [claim(f"c{i}", f"p{i}", object_concept=f"LOCAL:x{i}") for i in range(0, 40, 7)] + [claim("cy", "py", object_concept="LOCAL:y"), claim("cb", "pb", object_concept="LOCAL:b"), claim("cn", "pn", "no_effect", object_concept="LOCAL:x35")]
    c = claims(spark, *rows)
    listed = E.ancestors_of(frame).selectExpr("id AS concept", "ancestors")
    key = lambda df: sorted((r.key, r.n_studies, r.grade, tuple(r.support_ids), r.status) for r in df.collect())
    assert key(build_links(c, hierarchy=frame)) == key(build_links(c, ancestors=listed)) and any(len(r[3]) > 2 for r in key(build_links(c, hierarchy=frame)))


def test_shallow_hierarchies_are_walked(spark):
    from claimloom.sources import scratch

    edges = [(i, i // 5) for i in range(1, 2000)] + [(i, i // 7) for i in range(0, 2000, 5)]
    frame, ids = spark.createDataFrame(edges, "id long, parent long"), spark.range(0, 2000, 3)
    since = scratch.mark()
    got = [tuple(r) for r in Y.above(frame, ids.toDF("o"), spark.range(0, 2000, 2).toDF("up")).collect()]
    assert scratch.mark() - since <= 8  # the edges and a table for each step; labels write over twenty
    assert len(got) == len(set(got)) and set(got) == {(o, u) for o, u in closed(edges) if o % 3 == 0 and u % 2 == 0}
    few = ids.toDF("o"), spark.range(0, 2000, 2).toDF("up")
    assert Y._walked(frame, *few, 2, 64) is None and Y._walked(frame, *few, 24, 1) is None  # too deep or too wide: left to labels
