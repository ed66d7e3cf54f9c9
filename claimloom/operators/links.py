"""Edges of the evidence graph: what supports, corroborates and opposes each, with status, grade and completeness.

Claims meet edges in equi-joins on (subject, object) or on a partner's id, then aggregate by edge with map-side combine;
the rules that look at the support of an edge join its aggregates back instead of gathering claims in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.functions.grading import stance, system_rank
from claimloom.functions.text import key_part, let, link_key
from claimloom.operators.components import components
from claimloom.operators.hierarchy import above as up_the_hierarchy
from claimloom.sources.scratch import bucketed, drop, materialize

REVIEW = "secondary source (review)"
OTHER_CONTEXT = "different context (triaged as context-dependent)"
WEAKER_NULL = "null result weaker than the support"


def _stance(r: str) -> str:
    return "null" if r in S.NULL_RELATIONS else S.DIRECTION.get(r) or ("physical" if r in S.PHYSICAL else "effect")


def _opposes(edge: str, claim: str) -> bool:
    if edge in S.DIRECTION:
        return _stance(claim) in {"null", "up", "down"} - {S.DIRECTION[edge]}
    if edge in S.NULL_RELATIONS:
        return _stance(claim) in ("up", "down")
    if edge in S.ASSOCIATIVE:
        return claim in S.NULL_RELATIONS
    return edge in S.CAUSAL and _stance(claim) == "null"


def _agrees(edge: str, claim: str) -> bool:
    return claim == edge if edge in S.ASSOCIATIVE else edge in S.DIRECTION and _stance(claim) == S.DIRECTION[edge]


def _pairs(rule) -> list[str]:
    """The pairs of relations (edge's, claim's) for which a rule holds: a small fixed set, looked up as one key, so that
    the join above it stays within compiled code."""
    return [f"{e}|{c}" for e in S.RELATIONS[:-1] for c in S.RELATIONS[:-1] if rule(e, c)]


def contradicts(link_relation: Column, relation: Column) -> Column:
    return F.concat_ws("|", link_relation, relation).isin(*_pairs(_opposes))


def corroborates(link_relation: Column, relation: Column) -> Column:
    return F.concat_ws("|", link_relation, relation).isin(*_pairs(_agrees))


def context_of(prefix: str = "") -> Column:
    """struct(system group, cell type, tissue) of a claim."""
    c = lambda n: F.coalesce(F.col(prefix + n), F.lit(""))
    cell = F.when(c("context_concept") != "", c("context_concept")).otherwise(raw_context(c("context_cell_type")))
    return F.struct(F.coalesce(S.mapped(S.SYSTEM_GROUP, F.col(prefix + "system")), F.lit("unclear")).alias("group"), cell.alias("cell"), F.lower(c("context_tissue")).alias("tissue"))


def raw_context(cell_type: Column) -> Column:
    c = F.coalesce(cell_type, F.lit(""))
    return F.lower(F.btrim(F.when(c == "", F.lit("unspecified")).otherwise(c)))


def discounted_pairs(conflicts: DataFrame) -> DataFrame:
    """(lo, hi): pairs of claims within a conflict that was not judged a true one."""
    ids = conflicts.where("verdict <> 'true_conflict'").select(F.array_sort("claim_ids").alias("ids"))
    one = ids.select("ids", F.posexplode("ids").alias("i", "lo"))
    return one.select("lo", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("hi")).where("lo < hi").distinct()


def partners(verdicts: DataFrame) -> DataFrame:
    """(id, partner) in both directions of pairs judged the same finding."""
    same = verdicts.where("same_finding").select("lo", "hi")
    return same.union(same.select("hi", "lo")).toDF("id", "partner").where("id <> partner").distinct()


def _with_aside(opposing: DataFrame, support: DataFrame, discounted: DataFrame, *dealt: str) -> DataFrame:
    """Adds aside: whether a discounted pair joins a claim to a support of the edge that has another context and is at least as close to humans.

    For each edge and value of ``conflict`` it is enough to know the closest support of the values paired with it, and the closest one of any other
    context: two rows, however many claims there are. dealt: columns by which the rows of an edge lie together, so that they are not shuffled."""
    both = discounted.select("lo", "hi").union(discounted.select("hi", "lo")).toDF("conflict", "x").where("conflict is not null and x is not null").distinct()
    if dealt:
        both = materialize(both, "both")
    near = support.groupBy(*dealt, "e", F.col("conflict").alias("x"), "context").agg(F.max("rank").alias("rank")).join(both, "x")
    near = near.groupBy(*dealt, "e", "conflict", "context").agg(F.max("rank").alias("rank"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy(*dealt, "e", "conflict").orderBy(F.desc("rank"), "context"))).where("n <= 2")
    pick = lambda n, x: F.max(F.when(F.col("n") == n, F.col(x)))
    near = near.groupBy(*dealt, "e", "conflict").agg(pick(1, "context").alias("c1"), pick(1, "rank").alias("r1"), pick(2, "rank").alias("r2")).drop(*dealt)
    near = materialize(near, "near")
    other = F.when(F.col("context") == F.col("c1"), F.col("r2")).otherwise(F.col("r1"))
    return opposing.join(near, ["e", "conflict"], "left").withColumn("aside", F.coalesce(F.col("rank") <= other, F.lit(False)))


def _grade_of(tier: Column) -> Column:
    return S.grade_of(F.coalesce(tier, F.lit(0)))


Side = Callable[[str], Column]


def _with_state(edge: DataFrame, prior: DataFrame | None, labels: DataFrame | None) -> DataFrame:
    """Adds an edge's earlier state and its labels."""
    state, out = ("times_targeted", "zero_yield_count", "exhausted"), edge
    if prior is not None:
        out = out.join(prior.select("key", *state, *(x for x in ("subject_label", "object_label") if x in prior.columns)), "key", "left")
    for n, kind in zip(state, ("int", "int", "boolean"), strict=True):
        out = out.withColumn(n, F.coalesce((F.col(n) if prior is not None else F.lit(None)).cast(kind), F.lit(0).cast(kind)))
    for side, end in (("subject", "s"), ("object", "o")):
        old = F.col(f"{side}_label") if prior is not None and f"{side}_label" in prior.columns else F.lit(None)
        if labels is not None:
            out = out.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"__{end}")), end, "left")
            out = out.withColumn(f"{side}_label", F.coalesce(F.col(f"__{end}"), old, F.col(end))).drop(f"__{end}")
        else:
            out = out.withColumn(f"{side}_label", F.coalesce(old, F.col(end)))
    return out


def _partners_of(c: DataFrame, same: Callable[[Side, Side], Column], n: int) -> tuple[DataFrame, str]:
    """(s, o, r, id, pmid, review): under the ends and relation of each claim, the claims of its paper that are the same finding and corroborate it;
    and the table they are read from, in which papers lie together."""
    spark = c.sparkSession
    t = bucketed(c.select("pmid", "id", "s", "o", "r", "review", "control").where("pmid is not null"), n, "pmid", name="papers")
    a, b = spark.table(t).alias("a"), spark.table(t).alias("b")
    of = lambda x: lambda name: F.col(f"{x}.{name}")
    one, two = of("a"), of("b")
    alike = F.coalesce((one("id") != two("id")) & corroborates(one("r"), two("r")) & (same(one, two) | same(two, one)), F.lit(False))  # no further key of the join
    return a.join(b, (one("pmid") == two("pmid")) & alike).select(one("s"), one("o"), one("r"), two("id"), two("pmid"), two("review")), t


def _gathered(c: DataFrame, edge: DataFrame, above: DataFrame | None, discounted: DataFrame | None, same: Callable[[Side, Side], Column] | None) -> DataFrame:
    """The edges with counts and lists. Each claim is written once, and once more for each finding that it corroborates, to the bucket of its subject
    and of its object's family: the objects that the hierarchy connects. All edges that it meets, those to ancestors too, have their claims in that
    bucket, so votes are made and counted where claims lie, and no list is shuffled. A row of an edge holds its ids and so may hold its papers."""
    spark = c.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if above is not None:
        family = materialize(components(above.select(F.col("o").alias("a"), F.col("up").alias("b"))).toDF("o", "family"), "families")
        ups = materialize(above.groupBy("o").agg(F.collect_set("up").alias("ups")), "ups")
    placed = lambda df: df.withColumn("g", F.col("o")) if above is None else df.join(family, "o", "left").withColumn("g", F.coalesce("family", "o")).drop("family")
    names = ("id", "pmid", "tier", "review", "control", "context", "rank", "conflict")
    form = lambda df, kind: placed(df).select("s", "g", "o", "r", F.lit(kind).alias("kind"), *[F.col(x) if x in df.columns else F.lit(None).cast(c.schema[x].dataType).alias(x) for x in names])
    put = lambda df, kind, to=None: bucketed(form(df, kind), n, "s", "g", name="gathered", to=to)
    t = put(edge.select("s", "o", F.col("lr").alias("r")).where("s is not null and o is not null").distinct(), "edge")  # edges without a claim have a row too
    if same is not None:
        partner, papers = _partners_of(c, same, max(16, n // 2))
        put(partner, "partner", t)
        drop(spark, papers)
    put(c.where("s is not null and o is not null"), "claim", t)
    pair = spark.table(t)
    spot = lambda o, exact: F.struct(o.alias("o"), F.lit(exact).alias("exact"))
    spots = F.array(spot(F.col("o"), True))
    if above is not None:  # a finding on a subtype
        pair = pair.join(ups, "o", "left")
        spots = F.when((F.col("kind") != "edge") & F.col("r").isin(*S.DIRECTION) & F.col("ups").isNotNull(), F.concat(spots, F.transform("ups", lambda u: spot(u, False)))).otherwise(spots)
    pair = pair.withColumn("spot", F.explode(spots)).select("s", "g", "spot.o", "spot.exact", "r", "kind", *names)
    is_ = lambda x: F.coalesce(x, F.lit(False))
    # what a claim of each relation is to an edge is settled once for each edge, not for each claim
    meet = edge.select("e", "s", "o", "lr", "best", F.explode(F.array_union(F.array(*map(F.lit, S.RELATIONS[:-1])), F.array("lr"))).alias("r"))
    equal, agrees, opposes = F.col("r") == F.col("lr"), corroborates(F.col("lr"), F.col("r")), contradicts(F.col("lr"), F.col("r"))
    meet = meet.select("e", "s", "o", "r", "best", equal.alias("equal"), (agrees & ~equal).alias("agrees"), opposes.alias("opposes"), ((stance("r") == "null")).alias("null"))
    meet = materialize(meet.where("equal or agrees or opposes"), "meet")
    mine, equal = F.col("kind") == "claim", F.col("equal")
    met = pair.join(meet, ["s", "o", "r"]).withColumns({
        "sup": mine & equal, "cor": F.when(F.col("kind") == "partner", equal).otherwise(mine & F.col("agrees")),
        "against": mine & F.col("exact") & F.col("opposes"), "review": is_(F.col("review")),
    }).where("sup or cor or against or (equal and kind = 'edge')")
    if discounted is not None:
        met = _with_aside(met, met.where("kind = 'claim' and equal"), discounted, "s", "g")
    else:
        met = met.withColumn("aside", F.lit(False))
    weak_null = F.col("null") & ~(F.col("control") & (F.col("tier") >= F.coalesce("best", F.lit(0))))
    why = F.when(F.col("review"), REVIEW).when(F.col("aside"), OTHER_CONTEXT).when(weak_null, WEAKER_NULL)
    met = met.withColumn("why", F.when(F.col("against"), why))
    votes = met.select(
        "s", "g", "e", "id", "pmid", "tier", F.col("context.cell").alias("cell"), "sup", "cor", ((F.col("sup") | F.col("cor")) & ~F.col("review")).alias("pro"), (F.col("against") & F.col("why").isNull()).alias("con"),
        F.greatest(F.when((F.col("sup") | F.col("cor")) & F.col("review"), REVIEW), "why").alias("why"),
    )
    some = lambda flag, x: F.collect_set(F.when(F.col(flag), F.col(x)))
    bare = lambda flag: is_(F.bool_or(F.col(flag) & F.col("pmid").isNull()))
    whys = let(F.sort_array(F.collect_set(F.when(F.col("why").isNotNull(), F.struct("id", "why")))), lambda x: F.filter(x, lambda y, i: (i == F.size(x) - 1) | (F.get(x, i + 1)["id"] != y["id"])))  # an id's greatest
    rest = votes.groupBy("s", "g", "e").agg(
        (F.size(some("pro", "pmid")) + bare("pro").cast("int")).alias("n"),
        (F.size(F.array_except(some("con", "pmid"), some("sup", "pmid"))) + (bare("con") & ~bare("sup")).cast("int")).alias("k"),  # a paper without an id is one
        F.max(F.when(F.col("con"), F.col("tier"))).alias("contra_best"), F.bool_or("sup").alias("any_support"), F.sort_array(some("sup", "id")).alias("support_ids"),
        F.sort_array(F.array_except(some("cor", "id"), some("sup", "id"))).alias("corroborating_ids"), F.sort_array(some("con", "id")).alias("contradicting_ids"),
        F.sort_array(F.collect_set(F.when(F.col("sup") & F.col("pro"), F.col("cell")))).alias("contexts"), F.map_from_entries(whys).alias("uncounted"),
    ).drop("s", "g")
    out = rest.join(edge, "e").drop("e")
    return out.unionByName(edge.where("s is null or o is null").drop("e"), allowMissingColumns=True)


def build_links(
    claims: DataFrame, prior: DataFrame | None = None, verdicts: DataFrame | None = None, discounted: DataFrame | None = None, ancestors: DataFrame | None = None,
    labels: DataFrame | None = None, extra: DataFrame | None = None, settings: S.Settings = S.Settings(), with_ids: bool = True, hierarchy: DataFrame | None = None,
    same: Callable[[Side, Side], Column] | None = None,
) -> DataFrame:
    """One row of ``schemas.LINK`` for each key that a claim, ``prior`` (LINK_STATE columns) or ``extra`` (key) names.

    claims: schemas.CLAIM columns; verdicts: lo, hi, same_finding; discounted: lo, hi; ancestors: concept, ancestors;
    labels: id, label; hierarchy: parent edges id, parent, in place of ancestors. Ties between claims never matter: ids are sets, grades maxima, papers distinct counts.
    Where claims have a column ``conflict``, lo and hi of discounted name its values: all claims of one with all of the other, no pair listed.

    same: in place of verdicts, a rule for two claims (lo, hi) of one paper, each given as a function of a column's name (id, s, o, r, control), that
    says whether they are judged the same finding. Ids are unique then.

    with_ids false: n_support, n_opposing and n_uncounted in place of the lists of ids, contexts and reasons, so that the
    size of a row does not grow with the claims of an edge.

    Edges are a table of their own, numbered (e) and small beside the claims: a claim meets its edges on the way into the first grouping, and
    travels under the number. Lists of ids without listed verdicts come from a table in which all claims of a subject and a family of objects lie
    in one bucket (``_gathered``)."""
    c = claims.where(~F.coalesce(F.col("relation_norm"), F.lit("")).isin("", "unresolved")).select(
        "id", "pmid", F.col("subject_concept").alias("s"), F.col("object_concept").alias("o"), F.col("relation_norm").alias("r"),
        S.tier(F.col("grade")).alias("tier"), (F.col("study_type") == "review").alias("review"), F.coalesce("comparator_present", F.lit(False)).alias("control"),
        context_of().alias("context"), system_rank(F.col("system")).alias("rank"), F.col("conflict" if "conflict" in claims.columns else "id").alias("conflict"),
    )
    keys = c.select("s", "r", "o")
    for more in (prior, extra):
        if more is not None:
            keys = keys.union(more.select(*(key_part(F.col("key"), p) for p in ("subject", "relation", "object"))))
    keys = keys.distinct()
    pair, above = c.withColumn("exact", F.lit(True)), None
    if ancestors is not None or hierarchy is not None:  # a finding on a subtype supports the edge to its ancestor, where that is a node of an edge
        keys = materialize(keys, "keys")
        nodes = keys.select(F.col("s").alias("up")).union(keys.select("o")).distinct()
        above = up_the_hierarchy(hierarchy, c.select("o"), nodes) if hierarchy is not None else ancestors.select(F.col("concept").alias("o"), F.explode("ancestors").alias("up")).where("up <> o").distinct().join(nodes, "up", "left_semi")
        above = materialize(above, "above")
        rolled = c.where(F.col("r").isin(*S.DIRECTION)).join(above, "o").withColumn("o", F.col("up")).drop("up").withColumn("exact", F.lit(False))
        pair = pair.unionByName(rolled)
    tiers = pair.where("not review").groupBy("s", "r", "o").agg(F.max("tier").alias("best"))
    edge = keys.join(tiers, ["s", "r", "o"], "left").select(
        link_key(F.col("s"), F.col("r"), F.col("o")).alias("key"), "s", "o", F.col("r").alias("lr"),
        F.when(F.col("r").isin(*S.ASSOCIATIVE) & F.col("best").isNotNull(), F.least("best", F.lit(1))).otherwise(F.col("best")).alias("best"),
    )
    edge = materialize(_with_state(edge, prior, labels).withColumn("e", F.monotonically_increasing_id()), "edges")
    if with_ids and verdicts is None:
        return with_status(_gathered(c, edge, above, discounted, same), settings)
    if same is not None:
        raise ValueError("same takes the place of verdicts, and needs with_ids")
    role = F.when(F.col("r") == F.col("lr"), "support").when(corroborates(F.col("lr"), F.col("r")), "corro")
    against = F.col("exact") & contradicts(F.col("lr"), F.col("r"))
    met = pair.join(edge.select("e", "s", "o", "lr", "best"), ["s", "o"]).withColumn("role", role).withColumn("against", against).where("role is not null or against").drop("s", "o", "exact")
    several = verdicts is not None or discounted is not None
    if several:
        met = materialize(met, "edge-claims")  # read several times below
    support = met.where("role = 'support'")
    corro = met.where("role = 'corro'").select("e", "id", "pmid", "review")
    if verdicts is not None:  # findings judged the same as a supporting one
        other = c.select(F.col("id").alias("partner"), F.col("pmid").alias("ppmid"), F.col("review").alias("preview"), F.col("r").alias("pr"))
        by_partner = support.select("e", "lr", "id").join(partners(verdicts), "id").join(other, "partner").where(corroborates(F.col("lr"), F.col("pr")))
        by_partner = by_partner.select("e", F.col("partner").alias("id"), F.col("ppmid").alias("pmid"), F.col("preview").alias("review"))
        corro = corro.union(by_partner).distinct().join(support.select("e", "id"), ["e", "id"], "left_anti")
    opposing = met.where("against")
    if discounted is not None:  # set aside: a discounted pair with a support of other context, no closer to humans
        opposing = _with_aside(opposing, support, discounted)
    else:
        opposing = opposing.withColumn("aside", F.lit(False))
    weak_null = (stance("r") == "null") & ~(F.col("control") & (F.col("tier") >= F.coalesce("best", F.lit(0))))
    why = F.when(F.col("review"), REVIEW).when(F.col("aside"), OTHER_CONTEXT).when(weak_null, WEAKER_NULL)
    votes = (  # a claim's part in an edge: whether it counts for or against it, or why not
        support.select("e", "id", "pmid", F.lit("support").alias("role"), F.when(F.col("review"), REVIEW).alias("why"), "tier", F.col("context.cell").alias("cell"))
        .unionByName(corro.select("e", "id", "pmid", F.lit("corro").alias("role"), F.when(F.col("review"), REVIEW).alias("why"), F.lit(0).alias("tier"), F.lit(None).cast("string").alias("cell")))
        .unionByName(opposing.select("e", "id", "pmid", F.lit("contra").alias("role"), why.alias("why"), "tier", F.lit(None).cast("string").alias("cell")))
    )
    if several:
        votes = materialize(votes, "votes")
    counts = F.col("why").isNull()
    pro, con = counts & F.col("role").isin("support", "corro"), counts & (F.col("role") == "contra")
    # papers are counted from one row for each edge and paper, so that no edge gathers its papers
    by_paper = votes.groupBy("e", "pmid").agg(F.bool_or(pro).alias("pro"), F.bool_or(con).alias("con"), F.bool_or(F.col("role") == "support").alias("sup"), F.max(F.when(con, F.col("tier"))).alias("ctier"))
    counted = by_paper.groupBy("e").agg(F.count_if("pro").alias("n"), F.count_if(F.col("con") & ~F.col("sup")).alias("k"), F.max("ctier").alias("contra_best"), F.bool_or("sup").alias("any_support"))
    if with_ids:
        of = lambda role, value="id", also=F.lit(True): F.sort_array(F.collect_set(F.when((F.col("role") == role) & also, F.col(value))))
        whys = let(F.sort_array(F.collect_set(F.when(~counts, F.struct("id", "why")))), lambda x: F.filter(x, lambda y, i: (i == F.size(x) - 1) | (F.get(x, i + 1)["id"] != y["id"])))  # an id's greatest
        rest = votes.groupBy("e").agg(of("support").alias("support_ids"), of("corro").alias("corroborating_ids"), of("contra", "id", counts).alias("contradicting_ids"), of("support", "cell", counts).alias("contexts"), F.map_from_entries(whys).alias("uncounted"))
    else:
        rest = votes.groupBy("e", "id").agg(*[F.bool_or(x).alias(n) for n, x in (("s", F.col("role") == "support"), ("c", con), ("u", ~counts))]).groupBy("e").agg(*[F.count_if(x).alias(n) for n, x in (("n_support", "s"), ("n_opposing", "c"), ("n_uncounted", "u"))])
    out = edge.join(counted, "e", "left").join(rest, "e", "left").drop("e")
    return with_status(out, settings, with_ids)


def with_status(df: DataFrame, settings: S.Settings = S.Settings(), with_ids: bool = True) -> DataFrame:
    """Shares, status, reason and completeness from the counts n and k, the best tiers, and the state of each edge."""
    none = F.array().cast("array<string>")
    some = lambda n: F.coalesce(F.col(n), none)
    df = df.withColumns({"n": F.coalesce("n", F.lit(0)).cast("int"), "k": F.coalesce("k", F.lit(0)).cast("int"), "grade": _grade_of(F.col("best")), "contra_grade": _grade_of(F.col("contra_best"))})
    n, k, m, threshold = F.col("n"), F.col("k"), settings.min_studies_per_link, settings.contradiction_threshold
    df = df.withColumn("share", F.when(n + k > 0, k / (n + k)).otherwise(F.lit(0.0)))
    share, best, searches = F.col("share"), F.coalesce("best", F.lit(0)), F.col("zero_yield_count")
    times = F.when(searches == 1, "").otherwise("es")
    rules = [  # the first that holds decides
        ((k > 0) & (share >= threshold) & (F.coalesce("contra_best", F.lit(0)) >= 2), "contradicted", F.format_string("%d opposing vs %d supporting papers", k, n)),
        ((n > 0) & (n >= m) & (share < threshold) & (best >= 2), "supported", F.format_string("%d papers, best grade %s", n, F.col("grade"))),
        ((n > 0) & (n >= m) & (share < threshold), "insufficient", F.format_string("only weak evidence (%d papers)", n)),
        ((n == 0) & F.coalesce("any_support", F.lit(False)), "insufficient", F.lit("only secondary sources (reviews)")),
        ((n == 0) & F.col("exhausted"), "insufficient", F.format_string("no study found in %d targeted searches", searches)),
        ((n == 0) & (searches > 0), "insufficient", F.format_string("not found in %d targeted search%s", searches, times)),
        (n == 0, "insufficient", F.lit("not found yet")),
        (share >= threshold, "insufficient", F.lit("weak evidence on both sides")),
        (F.lit(True), "insufficient", F.concat(F.format_string(f"%d of {m} required papers", n), F.when(F.col("exhausted"), "; targeted searches found no more").otherwise(""))),
    ]
    verdict = F.coalesce(*[F.when(h, F.struct(F.lit(s).alias("status"), r.alias("reason"))) for h, s, r in rules])
    complete = F.when(n > 0, F.least(F.lit(1.0), n / m) * S.mapped(S.QUALITY, F.col("grade")) * (1 - share)).otherwise(F.lit(0.0))
    lists = [some(c).alias(c) for c in ("support_ids", "corroborating_ids", "contradicting_ids")] + [F.coalesce("uncounted", F.create_map().cast("map<string,string>")).alias("uncounted")] if with_ids else [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_support", "n_opposing", "n_uncounted")]
    return df.withColumn("v", verdict).select(
        "key", F.col("s").alias("subject"), F.col("lr").alias("relation"), F.col("o").alias("object"), "subject_label", "object_label", *lists,
        n.alias("n_studies"), k.alias("n_contra_studies"), "grade", "contra_grade", F.round(share, 3).alias("contradiction_share"), F.round(complete, 3).alias("completeness"),
        F.col("v.status").alias("status"), F.col("v.reason").alias("reason"), *([some("contexts").alias("contexts")] if with_ids else []), "times_targeted", "zero_yield_count", "exhausted",
    )


def exhausted_searches(prior: DataFrame, targets: DataFrame, papers: DataFrame, claims: DataFrame, round_: int, search_failed: bool, exhaust_after: int = 2) -> DataFrame:
    """LINK_STATE after a round's searches. targets: key, ok, clean (queries that ran, and ran with no term ignored). A
    search counts as without yield if it ran cleanly, every included hit was read for the step, and no claim of this
    round has the step's ends."""
    unread = papers.where("screen_status = 'included'").select(F.explode(F.array_except("retrieved_for", "read_for")).alias("key")).distinct().withColumn("unread", F.lit(True))
    found = claims.where(F.col("round") == round_).select(F.col("subject_concept").alias("s"), F.col("object_concept").alias("o")).distinct().withColumn("found", F.lit(True))
    t = targets.withColumn("s", key_part(F.col("key"), "subject")).withColumn("o", key_part(F.col("key"), "object"))
    empty = t.join(unread, "key", "left").join(found, ["s", "o"], "left").where(F.lit(not search_failed) & (F.col("ok") >= 2) & (F.col("clean") >= 1) & F.col("unread").isNull() & F.col("found").isNull())
    df = prior.join(empty.select("key").distinct().withColumn("__empty", F.lit(1)), "key", "left").withColumn("zero_yield_count", (F.col("zero_yield_count") + F.coalesce("__empty", F.lit(0))).cast("int"))
    return df.withColumn("exhausted", F.when(F.col("__empty") == 1, F.col("zero_yield_count") >= exhaust_after).otherwise(F.col("exhausted"))).drop("__empty")
