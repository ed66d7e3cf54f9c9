"""Paths through the evidence graph: enumeration, logic screen, ranking, and where to search next.

A path is an array of edge keys. Enumeration joins the edges once for each step up to the longest length, so its plan is
fixed and bounded; scoring explodes paths and joins the edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.functions.text import key_part, let
from claimloom.sources.scratch import materialize


def ledger_paths(links: DataFrame, exposure: str, outcomes: DataFrame, max_len: int = S.Settings.max_path_len) -> DataFrame:
    """(links, least): simple paths from the exposure to the first outcome reached, over edges with support and a
    relation that is not null, of at most ``max_len`` edges; least: the smallest completeness on the way. outcomes: id.
    Ties of least are ordered by the path itself where an order is asked for (``orderBy(desc least, links)``)."""
    usable = links.where((F.size("support_ids") > 0) & ~F.col("relation").isin(*S.NULL_RELATIONS))
    goal = outcomes.select(F.col("id").alias("nxt")).distinct().withColumn("goal", F.lit(True))
    return _listed(usable.select(F.col("subject").alias("node"), F.col("object").alias("nxt"), "key", "completeness").join(goal, "nxt", "left").na.fill(False, ["goal"]), exposure, max_len)


def _listed(step: DataFrame, exposure: str, max_len: int) -> DataFrame:
    """(links, least) of all simple paths over edges (node, nxt, key, completeness, goal)."""
    spark = step.sparkSession
    front = spark.createDataFrame([(exposure, [], [exposure], float("inf"))], "node string, links array<string>, seen array<string>, least double")
    found = []
    for _ in range(max_len):
        grown = front.join(step, "node").where(~F.array_contains("seen", F.col("nxt")))
        grown = grown.select(F.col("nxt").alias("node"), F.concat("links", F.array("key")).alias("links"), F.concat("seen", F.array("nxt")).alias("seen"), F.least("least", "completeness").alias("least"), "goal")
        found.append(grown.where("goal").select("links", "least"))
        front = grown.where("not goal").drop("goal")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _distances(edges: DataFrame, most: int) -> DataFrame:
    """(node, far): the fewest edges from a node to a goal, up to ``most``; edges: node, nxt, goal."""
    found = edges.where("goal").select("node").distinct().withColumn("far", F.lit(1))
    for far in range(2, most + 1):
        more = edges.where("not goal").join(found.select(F.col("node").alias("nxt")), "nxt").select("node").distinct().withColumn("far", F.lit(far))
        found = materialize(found.unionByName(more.join(found.select("node"), "node", "left_anti")), "far")
    return found


def first_paths(edges: DataFrame, exposure: str, most: int, max_len: int, width: int | None = None, told: list | None = None) -> DataFrame:
    """(links, least): the first ``most`` simple paths in the order of their keys, without listing all. edges: node, nxt, key,
    completeness, goal (whether nxt is an outcome).

    Partial paths grow by an edge at a time; only those from which an outcome is near enough go on, and of those that end in one
    node only the first ``width``. One that is left out comes after ``width`` others at its node, and can be missed only if the rest
    of its path meets so many of them that fewer than ``most`` remain. That can't be if no node is on more than
    (width - most) / (edges left) of them; otherwise the width is raised and the search begins again, so the result is exact. told gets each width."""
    far, width = _distances(edges, max_len), width or max(64, 4 * most)
    spark = edges.sparkSession
    while True:
        if told is not None:
            told.append(width)
        front = spark.createDataFrame([(exposure, [], [exposure], float("inf"))], "node string, links array<string>, seen array<string>, least double")
        found, sure = [], True
        for k in range(1, max_len + 1):
            grown = front.join(edges, "node").where(~F.array_contains("seen", F.col("nxt")))
            grown = grown.select(F.col("nxt").alias("node"), F.concat("links", F.array("key")).alias("links"), F.concat("seen", F.array("nxt")).alias("seen"), F.least("least", "completeness").alias("least"), "goal")
            found.append(grown.where("goal").orderBy("links").limit(most).select("links", "least"))
            if k == max_len:
                break
            near = grown.where("not goal").join(far.where(F.col("far") <= max_len - k).select("node"), "node")
            place = F.row_number().over(Window.partitionBy("node").orderBy("links"))
            kept = materialize(near.withColumn("place", place).where(F.col("place") <= width + 1).drop("goal"), "front")
            cut = kept.where(F.col("place") > width).select("node")
            crowd = kept.where(F.col("place") <= width).join(cut, "node").select("node", F.explode("seen").alias("via")).where(F.col("via") != F.col("node")).where(F.col("via") != exposure)
            sure = sure and crowd.groupBy("node", "via").agg(F.count("*").alias("n")).where(F.col("n") * (max_len - k) > width - most).isEmpty()
            front = kept.where(F.col("place") <= width).drop("place")
        if sure:
            out = found[0]
            for f in found[1:]:
                out = out.unionByName(f)
            return materialize(out.orderBy("links").limit(most), "first")
        width *= 4


FEW_EDGES = 500


def best_paths(links: DataFrame, exposure: str, outcomes: DataFrame, most: int, max_len: int = S.Settings.max_path_len, width: int | None = None, few: int = FEW_EDGES) -> DataFrame:
    """(links, least): the first ``most`` of ``ledger_paths`` in the order of least (falling), links, without listing the others.

    Edges below a threshold are left out. Walks are counted by their least completeness, one aggregation a step, and tell
    where to begin; the threshold falls until ``most`` simple paths are found, and is then the greatest one for which there are as many.
    Completeness has three places, so there are 1,001 thresholds at most. A graph of at most ``few`` edges is listed whole."""
    backed = F.size("support_ids") > 0 if "support_ids" in links.columns else F.col("n_support") > 0
    usable = links.where(backed & ~F.col("relation").isin(*S.NULL_RELATIONS)).where((F.col("object") != exposure) & (F.col("subject") != F.col("object")))
    goal = outcomes.select(F.col("id").alias("nxt")).distinct().withColumn("goal", F.lit(True))
    steps = usable.select(F.col("subject").alias("node"), F.col("object").alias("nxt"), "key", F.coalesce("completeness", F.lit(0.0)).alias("completeness"))
    steps = steps.join(goal, "nxt", "left").na.fill(False, ["goal"]).join(goal.select(F.col("nxt").alias("node"), F.lit(1).alias("end")), "node", "left").where((F.col("end").isNull()) | (F.col("node") == exposure))
    steps = materialize(steps.select("node", "nxt", "key", "completeness", "goal"), "steps")
    if steps.count() <= few:
        return _listed(steps, exposure, max_len).orderBy(F.desc("least"), "links").limit(most)
    level = F.floor(F.col("completeness") * 1000 + 1e-6).cast("int")
    by_node = steps.groupBy("node", "nxt", "goal", level.alias("level")).agg(F.count("*").cast("double").alias("n"))
    walks, ends = by_node.where(F.col("node") == exposure), []
    for k in range(max_len):
        if k:
            walks = materialize(walks.where("not goal").groupBy(F.col("nxt").alias("node"), F.col("level").alias("low")).agg(F.sum("n").alias("w")), "walks").join(by_node, "node")
            walks = walks.select("nxt", "goal", F.least("low", "level").alias("level"), (F.col("w") * F.col("n")).alias("n"))
        ends.append(walks.where("goal").select("level", "n"))
    counted = ends[0]
    for e in ends[1:]:
        counted = counted.unionByName(e)
    levels = sorted(((r.level, r.n) for r in counted.groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True)  # 1,001 at most
    above = lambda v: steps.where(level >= v)
    full, some, total, found = -1, None, 0.0, {}

    def at(i: int) -> int:
        if i not in found:
            found[i] = first_paths(above(levels[i][0]), exposure, most, max_len, width)
        return found[i].count()

    want = float(most)
    for i, (_, n) in enumerate(levels):  # first levels at which there are enough walks, then four times as many ...
        total += n
        if total >= want or i == len(levels) - 1:
            if at(i) >= most or i == len(levels) - 1:
                some = i
                break
            full, want = i, want * 4
    if some is None:
        return steps.select(F.array("key").alias("links"), "completeness").toDF("links", "least").limit(0)
    while some - full > 1:
        mid = (some + full) // 2
        some, full = (mid, full) if at(mid) >= most else (some, mid)
    if full < 0:
        return first_paths(above(levels[some][0]), exposure, most, max_len, width)
    sure = found[full]  # fewer than asked for, and all there are
    n = sure.count()
    rest = first_paths(above(levels[some][0]), exposure, most + n, max_len, width).join(sure.select("links"), "links", "left_anti")
    return sure.unionByName(rest.orderBy("links").limit(most - n))


def _along(triples: Column) -> Column:
    """Subjects and objects of steps in their order, neighbours that are equal once."""
    ends = F.flatten(F.transform(triples, lambda t: F.array(t["s"], t["o"])))
    return F.aggregate(ends, F.array().cast("array<string>"), lambda acc, n: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == n), acc).otherwise(F.concat(acc, F.array(n))))


def nodes(links: Column) -> Column:
    """The nodes along a path, neighbours that are equal once."""
    return _along(F.transform(links, lambda k: F.struct(key_part(k, "subject").alias("s"), key_part(k, "object").alias("o"))))


def pathway_sign(expected: Column, change: Column) -> Column:
    """The net direction that the bare exposure must have: turned round where the question is about a decrease."""
    turned = F.when(expected == "up", "down").when(expected == "down", "up")
    return F.when((change == "down") & turned.isNotNull(), turned).otherwise(expected)


def logic_flags(links: Column, contexts: Column, categories: Column, expected: Column) -> Column:
    """Flags in fixed order. contexts: array of each known step's contexts; categories: map of node to category. Parts of keys, nodes and
    categories are worked out once for each path."""
    triples = F.transform(links, lambda k: let(F.split(k, r"\|"), lambda p: F.struct(*(F.element_at(p, i + 1).alias(n) for i, n in enumerate("sro")))))
    adjacent = lambda xs, f: F.exists(F.zip_with(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), f), lambda b: b)
    once = F.struct(triples.alias("triples"), F.transform(contexts, lambda c: F.array_remove(c, "unspecified")).alias("known"), categories.alias("categories"), expected.alias("expected"))

    def signed(x: Column) -> Column:
        return F.struct(x["triples"].alias("triples"), x["known"].alias("known"), x["categories"].alias("categories"), x["expected"].alias("expected"), F.transform(x["triples"], lambda t: S.mapped(S.SIGN, t["r"])).alias("sign"), _along(x["triples"]).alias("nodes"))

    def flags(x: Column) -> Column:
        triples, cat = x["triples"], lambda n: F.element_at(x["categories"], n)
        unknown = F.exists(x["sign"], lambda v: v.isNull())
        product = F.aggregate(x["sign"], F.lit(1), lambda acc, v: acc * F.coalesce(v, F.lit(1)))
        wrong = x["expected"].isin("up", "down") & (product != F.when(x["expected"] == "up", 1).otherwise(-1))
        apart = adjacent(triples, lambda a, b: a["o"] != b["s"])
        loop = F.size(x["nodes"]) != F.size(F.array_distinct(x["nodes"]))
        backwards = F.exists(triples, lambda t: F.coalesce(cat(t["s"]).isin("phenotype", "disease") & cat(t["o"]).isin("gene_or_protein", "chemical"), F.lit(False)))
        cross = adjacent(x["known"], lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))
        named = [(apart, "disconnected"), (loop, "cycle"), (unknown, "sign_unknown"), (~unknown & wrong, "sign_mismatch"), (backwards, "reverse_order"), (cross, "cross_context")]
        return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in named]), lambda v: v.isNotNull())

    return let(let(once, signed), flags)


def logic_factor(flags: Column) -> Column:
    return F.round(F.aggregate(flags, F.lit(1.0), lambda acc, f: acc * S.mapped(S.LOGIC_PENALTY, f, 1.0)), 3)


def evaluate(hyps: DataFrame, links: DataFrame, categories: DataFrame, expected: str, settings: S.Settings = S.Settings()) -> DataFrame:
    """Hypotheses with factor, flags, score, status, reason and open, ranked (column rank, from 1): all supported ones
    and others up to ``max_hypotheses``. categories: id, category. Steps missing from links are passed over.

    The number of pathways is bounded by the settings; the join to the edges is on their few keys."""
    step = F.concat("subject_label", F.lit(" → "), "object_label")
    cats = categories.select("id", "category")
    parts = hyps.select("id", F.posexplode("links").alias("pos", "key")).join(links.select("key", "status", F.col("reason").alias("why"), "completeness", "exhausted", "contexts", step.alias("step"), "subject", "object"), "key", "left")
    ends = parts.select("id", F.explode(F.array(*(key_part(F.col("key"), p) for p in ("subject", "object")))).alias("node")).distinct()
    by_node = ends.join(cats.withColumnRenamed("id", "node"), "node").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("node", "category"))).alias("cats"))
    first = lambda cond, order: F.min_by(F.struct("step", "why"), F.when(cond, order))
    gap = (F.col("status") == "insufficient") & F.col("exhausted")
    seen = F.col("status").isNotNull()
    rolled = parts.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(seen, F.struct("pos", "contexts")))), lambda x: x["contexts"]).alias("ctx"),
        F.coalesce(F.min("completeness"), F.lit(0.0)).alias("least"), F.max(F.col("status") == "contradicted").alias("any_bad"),
        first(F.col("status") == "contradicted", F.struct(F.col("pos"))).alias("bad"), F.max(gap).alias("any_gap"), first(gap, F.struct(F.col("pos"))).alias("gap"),
        F.min(F.coalesce(F.col("status") == "supported", F.lit(False))).alias("all_good"), first(seen, F.struct("completeness", "pos")).alias("weakest"),
    )
    df = hyps.select("id", "name", "origin", "links", "rationale").join(rolled, "id", "left").join(by_node, "id", "left")
    flags = logic_flags(F.col("links"), F.coalesce("ctx", F.array().cast("array<array<string>>")), F.coalesce("cats", F.create_map().cast("map<string,string>")), F.lit(expected))
    df = df.withColumn("logic_flags", flags).withColumn("logic_factor", logic_factor(F.col("logic_flags")))
    df = df.withColumn("score", F.round(F.col("logic_factor") * F.coalesce("least", F.lit(0.0)), 3))
    bad, no_gap = F.coalesce("any_bad", F.lit(False)), ~F.coalesce("any_gap", F.lit(False))
    status = F.when(bad, "contradicted").when(F.coalesce("all_good", F.lit(False)), "supported").otherwise("insufficient")
    told = lambda x: F.concat(F.col(x)["step"], F.lit(": "), F.col(x)["why"])
    df = df.withColumn("status", status)
    df = df.withColumn("reason", F.when(F.col("status") == "contradicted", told("bad")).when(F.col("status") == "supported", "every step has independent support").otherwise(F.when(no_gap, told("weakest")).otherwise(told("gap"))))
    df = df.withColumn("open", (F.col("status") == "insufficient") & no_gap)
    return ranked(df.select("id", "name", "origin", "links", "rationale", "status", "reason", "open", "score", "logic_factor", "logic_flags"), settings.max_hypotheses)


def ranked(hyps: DataFrame, most: int) -> DataFrame:
    """Supported pathways first, each part by score (falling) and id (as text); others only up to ``most`` in all."""
    good = F.col("status") == "supported"
    order = [F.when(good, 0).otherwise(1), F.desc("score"), "id"]
    hyps = materialize(hyps, "hypotheses")  # read twice below
    n_good = hyps.where(good).count()
    few = hyps.orderBy(*order).limit(max(most, n_good))  # the best of each task, merged: no task sorts all paths
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(good | (F.col("rank") <= most))


def edge_priorities(hyps: DataFrame, links: DataFrame, round_: int, settings: S.Settings = S.Settings()) -> DataFrame:
    """(key, priority, bonus, owners, beside_leader) of edges worth a search: on an open pathway, not supported and not
    exhausted. Pathways weigh by a softmax of their scores; the bonus falls with earlier searches."""
    live = hyps.where("open").withColumn("w", F.exp(F.col("score") / settings.softmax_temperature))
    owned = live.withColumn("total", F.sum("w").over(Window.partitionBy())).withColumn("leader", F.max(F.struct("score", "id")).over(Window.partitionBy())["id"])
    keys = owned.select("id", "leader", (F.col("w") / F.col("total")).alias("w"), F.explode(F.array_distinct("links")).alias("key"))
    open_links = links.where(~F.col("exhausted") & (F.col("status") != "supported")).select("key", "completeness", "times_targeted")
    bonus = settings.ucb_beta * F.sqrt(F.lit(math.log(round_ + 2)) / (1 + F.first("times_targeted")))
    return keys.join(open_links, "key").groupBy("key").agg(F.sum(F.col("w") * (1 - F.col("completeness"))).alias("priority"), bonus.alias("bonus"), F.max(F.col("id") != F.col("leader")).alias("beside_leader"))


def allocate(hyps: DataFrame, links: DataFrame, round_: int, settings: S.Settings = S.Settings()) -> DataFrame:
    """(slot, key): the round's search targets, exploiting by priority and exploring beside the leader."""
    slots, explore = settings.targets_per_round, min(settings.exploration_slots, settings.targets_per_round)
    edges = edge_priorities(hyps, links, round_, settings)
    by_value = Window.orderBy(F.desc(F.col("priority") + F.col("bonus")), "key")
    df = edges.withColumn("value_rank", F.row_number().over(by_value)).withColumn("taken", F.col("value_rank") <= slots - explore)
    by_bonus = Window.orderBy(F.when(~F.col("taken") & F.col("beside_leader"), 0).otherwise(1), F.desc("bonus"), F.desc("priority"), "key")
    df = df.withColumn("explored", (F.row_number().over(by_bonus) <= explore) & ~F.col("taken") & F.col("beside_leader"))
    fill = Window.orderBy(F.when(F.col("taken"), 0).when(F.col("explored"), 1).otherwise(2), "value_rank")
    return df.withColumn("slot", F.row_number().over(fill)).where(F.col("slot") <= slots).select("slot", "key")


def decide(hyps: list, targets: list, completed_rounds: int, settings: S.Settings = S.Settings(), tokens_used: int = 0) -> tuple[str, str]:
    """(decision, gate) from ranked rows; the budget only overrides going on."""
    if not targets:
        return "done", "NO_TARGETS"
    if completed_rounds >= settings.max_rounds:
        return "done", "MAX_ROUNDS"
    if hyps and hyps[0]["status"] == "supported" and hyps[0]["score"] >= max((h["logic_factor"] for h in hyps[1:] if h["open"]), default=0):
        return "done", "CONVERGED"
    if settings.token_budget and tokens_used >= settings.token_budget:
        return "done", "BUDGET"
    return "search_more", "TARGETED"


def novel_intermediates(links: DataFrame, used: DataFrame) -> DataFrame:
    """(id): ends of supported edges that touch a used node (used: id) and are not used themselves."""
    good = links.where("status = 'supported'")
    both = good.select(F.col("subject").alias("a"), F.col("object").alias("id")).union(good.select(F.col("object"), F.col("subject")))
    near = both.join(used.select("id").distinct(), "id", "left_semi").select(F.col("a").alias("id")).distinct()
    return near.join(used.select("id"), "id", "left_anti")


def used_nodes(hyps: DataFrame, exposure: str, outcomes: DataFrame) -> DataFrame:
    spark = hyps.sparkSession
    own = hyps.select(F.explode(nodes(F.col("links"))).alias("id"))
    return own.union(outcomes.select("id")).union(spark.createDataFrame([(exposure,)], "id string")).distinct()


def outcome_set(named: list[str], concepts: DataFrame) -> DataFrame:
    """(id): the named outcomes and the concepts below them."""
    spark = concepts.sparkSession
    below = concepts.where(F.arrays_overlap("ancestors", F.array(*map(F.lit, named)).cast("array<string>"))).select("id")
    return below.union(spark.createDataFrame([(n,) for n in named], "id string")).distinct()


def is_duplicate(keys: list[str], others: list[list[str]], diverse: bool) -> bool:
    """Equal paths always; with ``diverse`` also if half of the intermediate nodes are shared. A handful of rows, in
    order of insertion, so on the driver."""

    def middle(ks: list[str]) -> set[str]:
        walk: list[str] = []
        for k in ks:
            s, _, o = k.split("|")
            walk += [n for n in (s, o) if walk[-1:] != [n]]
        return set(walk[1:-1])

    mine = middle(keys)
    return any(o == keys or (diverse and mine and middle(o) and 2 * len(mine & middle(o)) >= len(mine | middle(o))) for o in others)


def insert(hyps: list[dict], keys: list[str], origin: str, name: str, rationale: str, diverse: bool) -> bool:
    """Append a pathway with the next number, unless it is empty or a duplicate."""
    if not keys or is_duplicate(keys, [h["links"] for h in hyps], diverse):
        return False
    n = max((int(h["id"][1:]) for h in hyps), default=0) + 1
    hyps.append({"id": f"H{n}", "name": name, "origin": origin, "links": keys, "rationale": rationale})
    return True


def labelled(hyps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, pathway, steps): the labels along a path, and its steps as text."""
    parts = hyps.select("id", F.posexplode("links").alias("pos", "key")).join(links.select("key", "subject_label", "relation", "object_label"), "key")
    rows = F.sort_array(F.collect_list(F.struct("pos", "subject_label", "relation", "object_label")))
    return parts.groupBy("id").agg(rows.alias("x")).select(
        "id", F.concat_ws(" → ", F.concat(F.array(F.col("x")[0]["subject_label"]), F.transform("x", lambda r: r["object_label"]))).alias("pathway"),
        F.concat_ws(" ; ", F.transform("x", lambda r: F.concat(r["subject_label"], F.lit(" -"), r["relation"], F.lit("-> "), r["object_label"]))).alias("steps"),
    )
