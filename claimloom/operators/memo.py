"""Keyed state of a run: upserts, "not seen yet", reading order, numbering, and verdicts joined back.

What is done once is kept in tables and met again by anti-joins, so a round touches only what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.functions.text import lookup_key
from claimloom.sources.scratch import numbered


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the new ones winning; ``new`` holds a key once."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row for each key: the one with the greatest sequence, by an aggregation with map-side combine."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(sequence)).alias("r"))
    return best.select("r.*")


def first_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def unseen(rows: DataFrame, memo: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys the memo does not hold."""
    return rows.join(memo.select(*keys).distinct(), list(keys), "left_anti")


def unordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")


def retrieved_for(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """Papers whose retrieved_for gains the steps of their hits (pmid, target)."""
    steps = hits.where("target <> ''").groupBy("pmid").agg(F.array_sort(F.collect_set("target")).alias("__steps"))
    none = F.array().cast("array<string>")
    return papers.join(steps, "pmid", "left").withColumn("retrieved_for", F.array_sort(F.array_union(F.coalesce("retrieved_for", none), F.coalesce("__steps", none)))).drop("__steps").select(*papers.columns)


def search_log(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row a query: ok, hits, ignored terms. results: query_id, ok, pmids, ignored_terms."""
    return queries.join(results, "query_id", "left").select("query_id", "query", "target", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok"), F.size("pmids")).alias("hits"), F.coalesce("ignored_terms", F.array().cast("array<string>")).alias("ignored_terms"))


def target_searches(log: DataFrame) -> DataFrame:
    """(key, ok, clean): queries of each target that ran, and that ran with no term ignored."""
    return log.where("target <> ''").groupBy(F.col("target").alias("key")).agg(F.count_if("ok").cast("int").alias("ok"), F.count_if(F.col("ok") & (F.size("ignored_terms") == 0)).cast("int").alias("clean"))


def search_status(log: DataFrame, n_new: int, fetched: bool = True) -> DataFrame:
    ran = F.count_if("ok")
    return log.agg(F.when((ran == 0) | F.lit(not fetched), "SEARCH_FAILED").when(F.lit(n_new > 0), "NEW_RESULTS").otherwise("ZERO_NEW_RESULTS").alias("status"))


def reading_order(papers: DataFrame, extracted: DataFrame, most: int = S.Settings.max_extract) -> DataFrame:
    """(place, pmid, pending): included papers with steps they were not read for, then unread ones; each by relevance
    (falling) and pmid; at most ``most``. extracted: pmid."""
    done = extracted.select("pmid").distinct().withColumn("done", F.lit(True))
    none = F.array().cast("array<string>")
    pool = papers.where("screen_status = 'included'").join(done, "pmid", "left").withColumn("pending", F.array_except(F.coalesce("retrieved_for", none), F.coalesce("read_for", none)))
    todo = pool.where((F.size("pending") > 0) | F.col("done").isNull()).withColumn("late", F.size("pending") == 0)
    chosen = todo.orderBy("late", F.desc("relevance_score"), "pmid").limit(most)
    order = Window.orderBy("late", F.desc("relevance_score"), "pmid")  # over at most ``most`` rows
    return chosen.select(F.row_number().over(order).alias("place"), "pmid", "pending")


def signature(span: str = "span", subject: str = "subject", relation: str = "relation", obj: str = "object") -> Column:
    return F.struct(*(lookup_key(F.col(c)).alias(f"k{i}") for i, c in enumerate((span, subject, relation, obj))))


def fresh_claims(extracted: DataFrame, known: DataFrame) -> DataFrame:
    """Extracted rows (pmid, n, ...) whose quote, ends and relation are new for their paper, counted once, and numbered
    on: id = C<pmid>_<n>. known: kept and dropped claims together; both advance the numbers."""
    rows = extracted.withColumn("__sig", signature())
    seen = known.select("pmid", signature().alias("__sig")).distinct()
    first = rows.join(seen, ["pmid", "__sig"], "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy("pmid", "__sig").orderBy("n"))).where("__n = 1")
    have = known.groupBy("pmid").agg(F.count("*").alias("__have"))
    numbered = first.join(have, "pmid", "left").withColumn("__k", F.coalesce("__have", F.lit(0)) + F.row_number().over(Window.partitionBy("pmid").orderBy("n")) - 1)
    return numbered.withColumn("id", F.concat(F.lit("C"), "pmid", F.lit("_"), F.col("__k").cast("string"))).drop("__sig", "__n", "__have", "__k")


def split_entities(claims: DataFrame) -> DataFrame:
    """One row for each subject and object of a claim that names several, tissues joined, n telling the order."""
    from claimloom.functions.text import entity_parts

    c = claims.withColumn("__s", entity_parts(F.col("subject"))).withColumn("__o", entity_parts(F.col("object")))
    c = c.select("*", F.posexplode("__s.parts").alias("__i", "__subject")).select("*", F.posexplode("__o.parts").alias("__j", "__object"))
    tissue = F.concat_ws(", ", F.filter(F.array("context_tissue", "__s.tissue", "__o.tissue"), lambda t: F.coalesce(t, F.lit("")) != ""))
    new = {"subject": F.col("__subject"), "object": F.col("__object"), "context_tissue": tissue}
    n = F.struct(*([F.col("n").alias("claim")] if "n" in claims.columns else []), "__i", "__j").alias("n")
    return c.select(*[new.get(x, F.col(x)).alias(x) for x in claims.columns if x != "n"], n)


def merged_tissues(*parts: Column) -> Column:
    """Comma lists joined, each tissue once, in order."""
    joined = F.concat_ws(", ", *[F.when(p != "", p) for p in parts])
    return F.when(joined == "", "").otherwise(F.concat_ws(", ", F.array_distinct(F.split(joined, ", "))))


def typed_relations(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """relation_norm, relation_source and relation_confidence: the lexicon first, then verdicts (claim_id,
    canonical_relation, confidence); what neither knows stays "" and is asked again. Loss phrases turn a direction
    round once, when the relation is set."""
    from claimloom.functions.grading import loss_flipped
    from claimloom.functions.text import lexical_relation, split_change

    v = verdicts.select(F.col("claim_id").alias("id"), F.col("canonical_relation").alias("__v"), F.col("confidence").alias("__c"))
    df = claims.join(v, "id", "left").withColumn("__lex", lexical_relation(F.col("relation_raw")))
    pending = F.coalesce("relation_norm", F.lit("")) == ""
    found = F.when(F.col("__lex") != "", F.col("__lex")).otherwise(F.coalesce("__v", F.lit("")))
    lost = lambda c: split_change(F.col(c))["change"] == "down"
    new = {
        "relation_norm": F.when(pending, loss_flipped(found, lost("subject"), lost("object"))).otherwise(F.col("relation_norm")),
        "relation_source": F.when(pending, F.when((F.col("__lex") == "") & F.col("__v").isNotNull(), "llm").otherwise("lexical")).otherwise(F.col("relation_source")),
        "relation_confidence": F.when(pending & (F.col("__lex") == ""), F.coalesce("__c", F.col("relation_confidence"))).otherwise(F.col("relation_confidence")),
    }
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in claims.columns])


def pair_batches(pairs: DataFrame, judged: DataFrame, size: int = 30) -> DataFrame:
    """(batch, pair, lo, hi): unjudged pairs in order, numbered from 1 within batches of ``size``."""
    todo = unseen(pairs.select("lo", "hi").distinct(), judged, "lo", "hi")
    return numbered(todo.select("lo", "hi"), "lo", "hi").select(F.expr(f"n div {size}").cast("int").alias("batch"), (F.col("n") % size + 1).cast("int").alias("pair"), "lo", "hi")


def positional_verdicts(asked: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, failed): answers (batch, pair, same_finding, same_context) met with what was asked by number; numbers
    out of range fall away; pairs without an answer failed. Of several answers to one number the last counts, by
    ``at`` if there is such a column."""
    a = answers if "at" in answers.columns else answers.withColumn("at", F.lit(0))
    last = a.groupBy("batch", "pair").agg(F.max_by(F.struct("same_finding", "same_context"), "at").alias("v"))
    met = asked.join(last, ["batch", "pair"], "left")
    return met.where("v is not null").select("lo", "hi", "v.*"), met.where("v is null").select("lo", "hi")


def semantic_status(n_pairs: int, n_new: int, n_failed: int) -> str:
    return "NO_CANDIDATES" if not n_pairs else "COMPLETE" if not n_failed else "UNAVAILABLE" if n_failed == n_new else "PARTIAL"


def kept_queries(planned: DataFrame, targets: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Planned queries for asked targets, and one query built for each target."""
    return planned.join(targets.select(F.col("key").alias("target")), "target", "left_semi").unionByName(synonyms, allowMissingColumns=True)


def synonym_queries(targets: DataFrame, surfaces: DataFrame, most: int = 4) -> DataFrame:
    """(query, intent, target): for each target (key, subject, object, subject_label, object_label) the shortest names of
    both ends; surfaces: id, name. Ties of length go by name."""

    def names(end: str) -> DataFrame:
        own = targets.select("key", F.col(f"{end}_label").alias("name"))
        all_ = own.union(targets.select("key", F.col(end).alias("id")).join(surfaces, "id").select("key", "name")).distinct()
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.length("name"), "name"))
        few = all_.withColumn("r", rank).where(F.col("r") <= most).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("x"))
        return few.select("key", F.concat(F.lit("("), F.concat_ws(" OR ", F.transform("x", lambda y: F.concat(F.lit("("), y["name"], F.lit(")")))), F.lit(")")).alias(end))

    return names("subject").join(names("object"), "key").select(F.concat("subject", F.lit(" AND "), "object").alias("query"), F.lit("gap_alternative_terms").alias("intent"), F.col("key").alias("target"))
