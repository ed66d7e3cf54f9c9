"""Measures of a run: histograms, shares, usage, timings, signals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import lookup_key
from claimloom.sources.scratch import materialize


def histogram(df: DataFrame, value: str | Column, name: str = "value") -> DataFrame:
    """(value, n), most frequent first, ties by value."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(v.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def share(a: Column, b: Column) -> Column:
    """a / b to three places; null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 3)


def masked_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "N")


def bucketed(n: Column, most: int = 3) -> Column:
    return F.when(n < most, n.cast("string")).otherwise(f"{most}+")


def decade(year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit("")) != "", F.concat(F.substring(year, 1, 3), F.lit("0s")))


def estimated_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """USD at prices for a million tokens, four places; null for a model without prices."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 4)


def approximate_tokens(prompt_chars: Column, items: Column) -> tuple[Column, Column]:
    """(tokens in, tokens out) where no counter is at hand: four characters a token, sixty tokens an answer."""
    return F.floor(prompt_chars / 4), 60 * items


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage for each task and in total (task null): sums, cost, and whether every task has a price. calls: task, model,
    items, failed, tokens_in, tokens_out, tokens_reasoning, seconds; prices: model, price_in, price_out (a fixed, small
    table)."""
    per = calls.groupBy("task", "model").agg(
        F.count("*").alias("calls"), F.sum("items").alias("items"), F.count_if("failed").alias("failures"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("tokens_reasoning").alias("tokens_reasoning"), F.sum("seconds").alias("seconds"),
    )
    priced = per.join(prices, "model", "left").withColumn("cost", estimated_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return priced.rollup("task").agg(
        *[F.sum(c).alias(c) for c in ("calls", "items", "failures", "tokens_in", "tokens_out", "tokens_reasoning")], F.round(F.sum("seconds"), 1).alias("seconds"),
        F.round(F.sum("cost"), 4).alias("cost"), F.bool_and(F.col("cost").isNotNull()).alias("cost_complete"),
    )


def duplicate_labels(concepts: DataFrame) -> DataFrame:
    """(key, ids): labels that name more than one concept."""
    return concepts.groupBy(lookup_key(F.col("label")).alias("key")).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def fragmentation(claims: DataFrame) -> DataFrame:
    """(concepts, claims, fragmentation): distinct concepts over the ends of all claims."""
    ends = claims.select(F.explode(F.array("subject_concept", "object_concept")).alias("id"))
    return ends.agg(F.count_distinct("id").alias("concepts"), (F.count("*") / 2).cast("long").alias("claims")).withColumn("fragmentation", share(F.col("concepts"), 2 * F.col("claims")))


def leader_changes(history: DataFrame, *partition: str) -> DataFrame:
    """(rounds, changes, last_changed): how often the leader (round, leader) differs from the round before."""
    w = Window.partitionBy(*partition).orderBy("round")
    df = history.withColumn("prev", F.lag("leader").over(w)).withColumn("changed", F.col("prev").isNotNull() & (F.col("prev") != F.col("leader")))
    return df.groupBy(*partition).agg(F.count("*").alias("rounds"), F.count_if("changed").alias("changes"), F.max_by("changed", "round").alias("last_changed"))


def step_seconds(updates: DataFrame, run: str = "run") -> DataFrame:
    """(run, node, seconds): the time since the update before, shared by the nodes of an update. updates: run, at (seconds),
    nodes array, with the start of the run as an update without nodes."""
    w = Window.partitionBy(run).orderBy("at")
    df = updates.withColumn("delta", F.col("at") - F.coalesce(F.lag("at").over(w), F.col("at")))
    return df.select(run, F.explode("nodes").alias("node"), (F.col("delta") / F.size("nodes")).alias("s")).groupBy(run, "node").agg(F.round(F.sum("s"), 1).alias("seconds"))


def last_messages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", most: int = 6, chars: int = 1500) -> DataFrame:
    """The last messages of each conversation, cut to ``chars``."""
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    return messages.withColumn("n", rank).where(F.col("n") <= most).drop("n").withColumn("text", F.substring("text", 1, chars))


def within_budget(rows: DataFrame, partition: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Adds used_before (sum of sizes before the row) and fits (whether the budget was not used up before it).

    A hot partition is no task of its own: rows are sorted in ranges of (partition, order), summed within each range, and
    each range adds what its first partition's rows in the ranges before it sum up to (one row a range)."""
    spark, keys = rows.sparkSession, [*partition, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "budget")
    sums = ranged.groupBy("__part", *partition).agg(F.sum(size).alias("__sum"))
    ends = sums.groupBy("__part").agg(F.count("*").alias("n"), F.max_by(F.struct(*partition, "__sum"), F.struct(*partition)).alias("last"), F.min(F.struct(*partition)).alias("first")).orderBy("__part").collect()
    starts, carried, before = [], None, 0
    for e in ends:  # what the range's first partition has used in earlier ranges
        first, last = tuple(e.first), tuple(e.last)[:-1]
        before = before if carried == first else 0
        starts.append((e["__part"], before))
        before = (before if e.n == 1 else 0) + (e.last["__sum"] or 0)
        carried = last
    start = spark.createDataFrame(starts, "__part int, __start bigint")
    w = Window.partitionBy("__part", *partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    least = ranged.groupBy("__part").agg(F.min(F.struct(*partition)).alias("__first"))
    used = F.coalesce(F.sum(size).over(w), F.lit(0)) + F.when(F.struct(*partition).eqNullSafe(F.col("__first")), F.col("__start")).otherwise(F.lit(0))
    out = ranged.join(F.broadcast(start.join(least, "__part")), "__part").withColumn("used_before", used)
    return out.select(*rows.columns, "used_before", (F.col("used_before") < budget).alias("fits"))


def problem_lines(log: DataFrame, most: int = 30, tail: int = 40) -> tuple[DataFrame, DataFrame]:
    """The first lines that tell of trouble, and the last lines; log: n, line."""
    return log.where(F.col("line").rlike("(?i)fail|WARN|error")).orderBy("n").limit(most), log.orderBy(F.desc("n")).limit(tail)


# Wording of provider errors that no retry mends.
FATAL = (
    r"(?i)insufficient_quota|credit_balance|credit balance|billing|invalid_api_key|incorrect api key|authentication|permission_error|model_not_found|"
    r"not_found_error|does not exist|unsupported_value|unsupported_parameter|unrecognized request argument"
)


def is_fatal(status: Column, message: Column) -> Column:
    """Errors that no retry mends: missing rights, unknown model, no credit."""
    return F.coalesce(status.isin(401, 403, 404), F.lit(False)) | F.coalesce(message.rlike(FATAL), F.lit(False))


def masked_setting(c: Column) -> Column:
    return F.when(F.length(F.coalesce(c, F.lit(""))) > 0, "set").otherwise("")


# Name of a signal, the measure it reads, and when it fires.
SIGNALS = (
    ("claim drop rate", "drop_rate > 0.30"), ("unverified relation wording", "relation_unverified / claims_kept > 0.30"), ("uncredited method fields", "method_fields_uncredited / claims_kept > 0.40"),
    ("unresolved concepts", "local_share > 0.50"), ("fragmented graph", "fragmentation > 0.7 and claims_kept >= 20"), ("no alias merges", "alias_merges = 0 and claims_kept >= 30"),
    ("reading backlog", "never_extracted / included > 0.30"), ("mostly abstracts", "full_text_share < 0.20"), ("query syntax problems", "queries_ignored / queries > 0.25"),
    ("zero-hit queries", "queries_zero_hits / queries > 0.40"), ("low inclusion", "inclusion_rate < 0.15"), ("pending relations", "pending_relations > 0"),
    ("unresolved relations", "unresolved_relations / claims_kept > 0.20"), ("no pathway supported", "pathways_supported = 0"), ("many unfound steps", "steps_unfound / steps > 0.50"),
    ("leader not settled", "leader_last_changed"), ("verification failed", "not verified"), ("LLM failures", "llm_failures > 0"), ("run did not finish", "status <> 'completed'"),
    ("token budget reached", "stop_reason = 'token budget reached'"), ("semantic layer degraded", "semantic_status in ('PARTIAL', 'UNAVAILABLE')"),
    ("pair verdicts lost", "pairs_asked > 0 and pairs_judged / pairs_asked < 0.5"), ("one label, several concepts", "duplicate_labels > 0"),
)


def signals(measures: DataFrame) -> DataFrame:
    """(signal): those that fire, in the fixed order, on the one row of measures; a rule whose measure is null or missing
    is skipped."""
    have = set(measures.columns)
    words = lambda e: {w for w in re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", e)) if w not in ("and", "not", "in")}
    safe = lambda e: re.sub(r"(\w+) / (\w+)", r"try_divide(\1, \2)", e)
    fired = [F.when(F.expr(f"coalesce(({safe(rule)}), false)"), F.struct(F.lit(n).alias("n"), F.lit(name).alias("signal"))) for n, (name, rule) in enumerate(SIGNALS) if words(rule) <= have]
    return measures.select(F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("x")).select("x.n", "x.signal").orderBy("n").select("signal")


def summary(papers: DataFrame, claims: DataFrame, dropped: DataFrame, links: DataFrame, hyps: DataFrame, log: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row with the counts and shares that the signals read; each table is aggregated once, and the one-row results
    are put side by side."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("__k", F.lit(1))
    read = papers.join(extracted.select("pmid").distinct().withColumn("read", F.lit(True)), "pmid", "left").withColumn("read", F.coalesce("read", F.lit(False)))
    inc, unscreened = F.col("screen_status") == "included", F.col("screen_status") == "unscreened"
    caps = F.col("grade_detail.caps") if "grade_detail" in claims.columns else F.array().cast("array<string>")
    parts = [
        one(read, F.count("*").alias("retrieved"), F.count_if(~unscreened).alias("screened"), F.count_if(inc).alias("included"), F.count_if("retracted").alias("retracted_excluded"), F.count_if(inc & ~F.col("read")).alias("never_extracted"), F.count_if("read").alias("extracted"), F.count_if(F.col("read") & (F.col("text_access") == "full_text")).alias("full_text")),
        one(claims, F.count("*").alias("claims_kept"), F.count_if(F.coalesce("relation_norm", F.lit("")) == "").alias("pending_relations"), F.count_if(F.col("relation_norm") == "unresolved").alias("unresolved_relations"), F.coalesce(F.sum(F.size("method_checks")), F.lit(0)).alias("method_fields_uncredited"), F.count_if(F.array_contains(caps, "relation_unverified")).alias("relation_unverified")),
        one(dropped, F.count("*").alias("claims_dropped")),
        fragmentation(claims).select("fragmentation").withColumn("__k", F.lit(1)),
        one(links, F.count("*").alias("steps"), F.count_if(masked_digits(F.col("reason")) == "no study found in N targeted searches").alias("steps_unfound"), F.count_if("exhausted").alias("searched_out")),
        one(hyps, F.count("*").alias("pathways"), F.count_if(F.col("status") == "supported").alias("pathways_supported")),
        one(log, F.count("*").alias("queries"), F.count_if(~F.col("ok")).alias("queries_failed"), F.count_if(F.col("ok") & (F.col("hits") == 0)).alias("queries_zero_hits"), F.count_if(F.size("ignored_terms") > 0).alias("queries_ignored"), F.round(F.avg(F.when(F.col("ok"), F.col("hits"))), 1).alias("mean_hits_per_query")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "__k")
    c = F.col
    return out.drop("__k").withColumns({
        "drop_rate": share(c("claims_dropped"), c("claims_kept") + c("claims_dropped")), "inclusion_rate": share(c("included"), c("screened")), "full_text_share": share(c("full_text"), c("extracted")),
        "claims_per_paper": share(c("claims_kept"), c("extracted")),
    })


def run_warnings(m: dict, drop_reasons: list[tuple[str, int]] = ()) -> list[str]:
    """Sentences for a report from a row of measures (as a dict) and the drop reasons (reason, n) in order."""
    w = []
    if m.get("concepts") and m.get("local", 0) / m["concepts"] > 0.5:
        w.append(f"Entity resolution DEGRADED: {m['local']}/{m['concepts']} concepts unresolved (LOCAL).")
    if m.get("embedder", "sentence") != "sentence":
        w.append(f"Candidate pairs came from the '{m['embedder']}' encoder, not sentence embeddings.")
    if m.get("semantic_status") in ("PARTIAL", "UNAVAILABLE"):
        w.append(f"Semantic adjudication {m['semantic_status']}: absent conflicts do not mean concordance.")
    fixed = (("conflict_status", "LLM_FAILED", "Conflict triage failed: opposing findings were all counted as contradictions."), ("gate", "BUDGET", "Search stopped early because the token budget was reached; open pathways were not searched further."), ("gate", "MAX_ROUNDS", "Search stopped at the round limit while some pathways were still open."), ("seed_status", "FAILED", "Pathway seeding failed; only ledger-derived pathways were considered."))
    w += [text for key, value, text in fixed if m.get(key) == value]
    if m.get("claims_dropped"):
        w.append(f"{m['claims_dropped']} extracted claims failed their quote checks and were dropped: {', '.join(f'{n} {r}' for r, n in sorted(drop_reasons))}.")
    counted = (("claims_reset", "{} claims had method details (perturbation, rescue, controls) without supporting text; those details were not credited."), ("pending_relations", "{} claim relations could not be resolved and were excluded from support."), ("never_extracted", "{} included papers were never extracted (per-round budget)."))
    return w + [text.format(m[k]) for k, text in counted if m.get(k)]

