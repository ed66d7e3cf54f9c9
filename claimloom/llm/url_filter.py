"""URL filtering by explicit rules and by association rules mined with FP-growth; DataFrame functions only.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what follows up to
``?``, ``#`` or the end; both are empty for null and where no ``://`` is. An explicit rule (host, path, verdict) fits
its host and all subdomains if the path starts with the rule's; the longest rule (host and path together) decides.

Method, for urls that no explicit rule fits. The urls that an explicit rule decides are transactions of tokens, with
their verdict as one more item: pieces of host, path, query and fragment, without the tokens that the explicit rules
themselves name (they would only restate them) and without plain numbers. Spark's FP-growth mines combinations that imply
a verdict with a support of at least ``LEAST_SUPPORT`` of these urls (and ``LEAST_COUNT`` of them), a confidence of
at least ``LEAST_CONFIDENCE`` and a lift of at least ``LEAST_LIFT``. Two reductions before the mining leave its rules
as they are: tokens below that support go (they are in no rule), and tokens that stand in the very same decided urls
become one item (so long fixed patterns are one item, not 2^n combinations); all tokens of a url count, however many. A rule that holds all tokens of a shorter one for the same
verdict is dropped. Rules are matched by an inverted index: a rule stands under its rarest item, a url looks up its
own, and the whole combination is then checked. Of the mined rules that match, the one of greatest confidence decides, then of greatest
support, then allow before block; a url that none matches is allowed.

Defined results: null and unparsable urls have no rule and the verdict allow, unless mined tokens match; equal rows are
judged once each; without decided urls nothing is mined; an empty table gives an empty result; extra columns are not
read. The number of frequent combinations still doubles with each frequent token that a url holds independently of the
others; FP-growth counts them all.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import materialize

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LEAST_SUPPORT, LEAST_COUNT, LEAST_CONFIDENCE, LEAST_LIFT = 0.001, 5, 0.9, 1.2
LABEL = "#"  # begins the items of the verdicts; no token holds it


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.regexp_replace(url, r"(?s)^.*?://", ""))
    raw = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest explicit rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    found = [F.when(f, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for f, (h, p, v) in zip(fits, ordered, strict=True)]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column, rules=RULES) -> Column:
    """Distinct lower-case tokens of a url, without numbers and the tokens of the rules."""
    named = sorted({t for h, p, _ in rules for t in [*h.split("."), *p.split("/")] if t})
    parts = F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (t != "") & ~t.rlike(r"^\p{N}+$") & ~t.isin("http", "https", *named))))


def frequent_items(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item, n): the tokens that at least ``least`` of the rows (row, tokens, label) with one label hold; item is
    the first of the tokens that the same rows hold, n their number."""
    each = labelled.select("label", F.xxhash64("row").cast("decimal(38,0)").alias("h"), F.explode("tokens").alias("token"))
    by_label = each.groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    stats = by_label.groupBy("token").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("h").alias("h")).where(F.col("most") >= least)
    stats = materialize(stats.select("token", "n", "h"), "tokens")
    return materialize(stats.join(stats.groupBy("n", "h").agg(F.min("token").alias("item")), ["n", "h"]).select("token", "item", "n"), "items")


def mine(transactions: DataFrame, items: DataFrame, least_support: float, least_confidence: float = LEAST_CONFIDENCE, least_lift: float = LEAST_LIFT) -> DataFrame:
    """(needed, key, label, confidence, support) of the rules that imply a label; transactions: items, a label among
    them. key: the item of the rule that fewest transactions have."""
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(transactions)
    label = F.col("consequent")[0]
    implied = model.associationRules.where(label.startswith(LABEL) & (F.col("lift") >= least_lift)).select(F.array_sort("antecedent").alias("needed"), label.alias("label"), "confidence", "support")
    implied = materialize(implied.withColumn("rule", F.monotonically_increasing_id()), "rules")
    parts = implied.select("rule", "label", F.explode("needed").alias("item"), F.size("needed").alias("n"))
    # a rule whose items all stand in another, longer rule makes that one needless
    short, long = parts.select(F.col("rule").alias("short"), "label", "item", F.col("n").alias("size")), parts.select("rule", "label", "item", "n")
    within = short.join(long, ["label", "item"]).where("size < n").groupBy("short", "rule").agg(F.count("*").alias("shared"), F.first("size").alias("size")).where("shared = size")
    kept = implied.join(within.select("rule").distinct(), "rule", "left_anti")
    single = items.where("token = item").select("item", "n")
    rarest = kept.select("rule", F.explode("needed").alias("item")).join(single, "item").groupBy("rule").agg(F.min(F.struct("n", "item")).alias("k"))
    return kept.join(rarest, "rule").select("needed", F.col("k.item").alias("key"), F.substring("label", 1 + len(LABEL), 99).alias("label"), "confidence", "support")


def _mined_verdicts(judged: DataFrame, least_support: float, least_count: int, least_confidence: float, least_lift: float) -> DataFrame | None:
    """(row, mined) of the rows without an explicit rule that a mined rule matches; None if nothing can be mined."""
    labelled = judged.where("e is not null").select("row", "tokens", F.concat(F.lit(LABEL), "e.verdict").alias("label"))
    n = labelled.count()
    least = max(least_count, math.ceil(least_support * n - 1e-9))
    if n < least:
        return None
    items = frequent_items(labelled, least)
    held = lambda df: df.select("row", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    transactions = labelled.join(held(labelled), "row", "left").select(F.concat(F.coalesce("items", F.expr("cast(array() as array<string>)")), F.array("label")).alias("items"))
    mined = materialize(mine(transactions, items, (least - 0.5) / n, least_confidence, least_lift), "mined")
    found = held(judged.where("e is null")).select("row", "items", F.explode("items").alias("key")).join(mined, "key").where(F.size(F.array_except("needed", "items")) == 0)
    return found.groupBy("row").agg(F.max_by("label", F.struct("confidence", "support", F.col("label") == "allow")).alias("mined"))


def judge_urls(pages: DataFrame, rules=RULES, least_support: float = LEAST_SUPPORT, least_count: int = LEAST_COUNT, least_confidence: float = LEAST_CONFIDENCE, least_lift: float = LEAST_LIFT) -> DataFrame:
    """page_id, host, path, rule, verdict, by_method (true where no explicit rule fits), matched (whether a mined rule
    then decides)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url"), rules).alias("tokens"))
    parsed = parsed.withColumn("e", explicit(F.col("host"), F.col("path"), rules))
    judged = materialize(parsed.withColumn("row", F.monotonically_increasing_id()), "urls")
    hit = _mined_verdicts(judged, least_support, least_count, least_confidence, least_lift)
    out = judged.withColumn("mined", F.lit(None).cast("string")) if hit is None else judged.join(hit, "row", "left")
    verdict = F.coalesce("e.verdict", "mined", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("e.rule").alias("rule"), verdict.alias("verdict"), F.col("e").isNull().alias("by_method"), F.col("mined").isNotNull().alias("matched"))
