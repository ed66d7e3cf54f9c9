"""Who is above whom in a hierarchy, by labels instead of a table of all ancestors.

Each node of a forest (one parent each) is labelled with the places at which a walk round the tree enters and leaves it; a node is
below another if it is entered within the other's interval. Further parents are jumps: a node below the beginning of a jump stands at
the jump's end as well. Labels take two numbers a node however deep the hierarchy, and places meet intervals in an
equi-join on binary blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import materialize, numbered


def contained(points: DataFrame, intervals: DataFrame, bits: int) -> DataFrame:
    """The columns of points (at, ...) and intervals (lo, hi, ...) side by side wherever lo <= at <= hi; each such pair once. Places are under
    2^``bits``. An interval is cut into at most 2 ``bits`` blocks of 2^k places that begin at multiples of 2^k, a place lies in one block of each size."""
    k = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("k")
    cut = intervals.select("*", k).withColumn("l", F.expr("shiftright(lo + shiftleft(1L, k) - 1, k)")).withColumn("r", F.expr("shiftright(hi + 1, k)"))
    ends = F.filter(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)), lambda b: b.isNotNull())
    cut = cut.where("l < r").withColumn("block", F.explode(ends)).drop("l", "r", "lo", "hi")
    return points.select("*", k).withColumn("block", F.expr("shiftright(at, k)")).join(cut, ["k", "block"]).drop("k", "block")


def _ranked(succ: DataFrame) -> DataFrame:
    """(x, left): how many elements follow x in a list (x, nxt), by doubling."""
    here = materialize(succ.select("x", "nxt", F.col("nxt").isNotNull().cast("long").alias("left")), "list")
    while not here.where("nxt is not null").isEmpty():
        far = here.select(F.col("x").alias("nxt"), F.col("nxt").alias("far"), F.col("left").alias("more"))
        here = materialize(here.join(far, "nxt", "left").select("x", F.col("far").alias("nxt"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "list")
    return here.select("x", "left")


def labels(edges: DataFrame) -> tuple[DataFrame, DataFrame, int] | None:
    """(id, lo, hi) of all nodes of parent edges (id, parent), the jumps (lo, hi, to: from the nodes within lo..hi to the place to), and the bits of
    a place; None if parents go round in a loop. The tree parent of a node is its smallest."""
    e = materialize(edges.where("id is not null and parent is not null and id <> parent").select("id", "parent").distinct(), "edges")
    ids = numbered(e.select("id").union(e.select("parent")).distinct(), "id").select("id", (F.col("n") + 1).alias("n"))  # 0 is above all roots
    ids = materialize(ids, "ids")
    number = lambda c: ids.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    e = materialize(e.join(number("id"), "id").join(number("parent"), "parent").select("id", "parent", F.col("n_id").alias("c"), F.col("n_parent").alias("p")), "edges")
    tree = e.groupBy("c").agg(F.min_by("p", "parent").alias("p"))
    n = ids.count()
    up = materialize(tree, "up")
    for _ in range(n.bit_length() + 1):  # every chain of parents ends after so many doublings, or never
        further = up.join(up.toDF("p", "far"), "p", "left")
        up = materialize(further.where("far is not null").select("c", F.col("far").alias("p")), "up")
        if up.isEmpty():
            break
    else:
        return None
    kids = materialize(ids.select(F.col("n").alias("c")).join(tree, "c", "left").select("c", F.coalesce("p", F.lit(0)).alias("p")), "kids")
    line = materialize(numbered(kids, "p", "c", name="k"), "line")
    after = line.select((F.col("k") - 1).alias("k"), F.col("p").alias("p2"), F.col("c").alias("next"))
    line = line.join(after, "k", "left").select("c", "p", F.when(F.col("p") == F.col("p2"), F.col("next")).alias("next"))
    first = kids.groupBy("p").agg(F.min("c").alias("first")).withColumnRenamed("p", "c")
    line = line.join(first, "c", "left")
    enter = line.select((2 * F.col("c")).alias("x"), F.coalesce(2 * F.col("first"), 2 * F.col("c") + 1).alias("nxt"))
    leave = line.select((2 * F.col("c") + 1).alias("x"), F.coalesce(2 * F.col("next"), F.when(F.col("p") > 0, 2 * F.col("p") + 1)).alias("nxt"))
    place = _ranked(enter.union(leave)).select(F.expr("x div 2").alias("n"), F.expr("x % 2").alias("leaves"), (F.lit(2 * n - 1) - F.col("left")).alias("at"))
    spans = place.groupBy("n").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    spans = materialize(spans.join(ids, "n"), "labels")
    jump = e.join(tree.withColumnRenamed("p", "own"), "c").where("p <> own")
    span = lambda c: spans.select(F.col("n").alias(c), "lo", "hi")
    jumps = jump.join(span("c"), "c").join(spans.select(F.col("n").alias("p"), F.col("lo").alias("to")), "p").select("lo", "hi", "to")
    return spans.select("id", "lo", "hi"), materialize(jumps, "jumps"), (2 * n).bit_length()


STEPS, WIDTH = 24, 64  # a hierarchy that is walked has at most so many steps, and pairs for each edge


def _walked(edges: DataFrame, below: DataFrame, wanted: DataFrame, steps: int, width: int) -> DataFrame | None:
    """``above`` of a shallow hierarchy: the nodes at one, two, ... steps, a join each. None if some are more than ``steps`` away (so in any loop)
    or the pairs are more than ``width`` times the edges; nothing is left out then, as labels do the whole."""
    e = materialize(edges.where("id is not null and parent is not null and id <> parent").select(F.col("id").alias("at"), "parent").distinct(), "edges")
    left, found = width * e.count(), []
    front = below.select("o", F.col("o").alias("at")).distinct()
    for _ in range(steps + 1):
        front = materialize(front.join(e, "at").select("o", F.col("parent").alias("at")).distinct(), "steps")
        n = front.count()
        if not n:
            pairs = front
            for f in found:
                pairs = pairs.union(f)
            return pairs.where("o <> at").join(wanted.select(F.col("up").alias("at")).distinct(), "at", "left_semi").select("o", F.col("at").alias("up")).distinct()
        left -= n
        if left < 0:
            return None
        found.append(front)
    return None


def above(edges: DataFrame, below: DataFrame, wanted: DataFrame, steps: int = STEPS, width: int = WIDTH) -> DataFrame:
    """(o, up): the nodes of ``wanted`` (up) that parent edges (id, parent) lead to from those of ``below`` (o), themselves left out.
    A shallow hierarchy is walked step by step, which takes fewer and smaller joins than labels do; one with a loop is closed instead."""
    near = _walked(edges, below, wanted, steps, width)
    if near is not None:
        return near
    made = labels(edges)
    if made is None:
        from claimloom.operators.resolve import ancestors_of

        closed = ancestors_of(edges).select(F.col("id").alias("o"), F.explode("ancestors").alias("up"))
        return closed.join(below.select("o").distinct(), "o", "left_semi").join(wanted.select("up").distinct(), "up", "left_semi").where("up <> o").select("o", "up")
    spans, jumps, bits = made
    places = materialize(below.select("o").distinct().join(spans.select(F.col("id").alias("o"), F.col("lo").alias("at")), "o"), "places")
    front = places
    while not jumps.isEmpty():  # the jumps that begin above a place lead to further places
        further = contained(front, jumps, bits).select("o", F.col("to").alias("at")).distinct()
        front = materialize(further.join(places, ["o", "at"], "left_anti"), "places")
        if front.isEmpty():
            break
        places = materialize(places.union(front), "places")
    goal = wanted.select("up").distinct().join(spans.withColumnRenamed("id", "up"), "up")
    return contained(places, goal, bits).where("up <> o").select("o", "up").distinct()
