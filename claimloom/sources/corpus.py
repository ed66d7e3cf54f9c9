"""Reading literature: search, records, full text, scenarios and question lists.

Any object with ``search(queries)``, ``fetch(ids)`` and ``fulltext(papers)`` over DataFrames is a source; ``CorpusTable``
is one over a table of papers, ``scenario`` reads one from JSON.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.functions.grading import is_retracted, study_type_of_publication
from claimloom.functions.text import let
from claimloom.sources.scratch import materialize

# Sections in order of priority, and words of their titles.
SECTIONS = (("RESULTS", r"result|finding"), ("FIGURE LEGENDS", None), ("METHODS", r"method|material|experimental|procedure"), ("DISCUSSION", r"discussion|conclusion"), ("OTHER", None))
ASIDE = ("fig", "table-wrap", "ref-list")
LONGER_BY = 500
ANCHOR = 16  # characters of a phrase under which it stands in the index, at most
CLAIM_FIELDS = "claim_type string, subject string, relation string, object string, system string, context_cell_type string, context_model string, context_tissue string, context_dose string, context_timepoint string, perturbation_class string, subject_attribute string, object_attribute string, span string, methods_span string, comparator_present boolean, rescue_arm boolean, orthogonal_validation boolean, readout_is_inferred boolean"
SCENARIO = (
    "description string, question string, parsed struct<population_model:string,exposure:string,comparator:string,outcome:string,mechanism_hypothesis:string,outcome_readouts:array<string>,target_system:string,exposure_change:string,expected_direction:string>,"
    "round1_queries array<struct<query:string,intent:string>>, entities map<string,array<string>>, alias_groups array<array<string>>, relation_map map<string,string>,"
    "seed_pathways array<struct<name:string,rationale:string,links:array<struct<source:string,relation:string,target:string>>>>, expansion_pathways array<struct<name:string,rationale:string,links:array<struct<source:string,relation:string,target:string>>>>,"
    f"papers array<struct<pmid:string,title:string,abstract:string,keywords:array<string>,study_type:string,full_text:string,publication_types:array<string>,year:string,relevant:boolean,relevance:int,claims:array<struct<{CLAIM_FIELDS.replace(' ', ':').replace(',:', ',')}>>>>"
)


class Unavailable(Exception):
    """A source or a judge did not answer: the round goes on without it. Other errors are errors."""


def is_unavailable(e: Exception) -> bool:
    """Whether an error, also one that comes from a task, is ``Unavailable``."""
    return isinstance(e, Unavailable) or f"{Unavailable.__module__}.{Unavailable.__name__}" in str(e)


def read_scenario(spark: SparkSession, path: str) -> DataFrame:
    """One row of a scenario document; maps are read as maps, whatever their keys."""
    return spark.read.schema(SCENARIO).option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(line): questions of a text file, stripped, without blank lines and # comments."""
    line = F.btrim("value", F.lit(" \t\r"))
    return spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cached table; an empty one where there is none or it can't be read as such."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).collect()
        return df
    except Exception as e:  # noqa: BLE001 - a cache may be missing or torn; nothing else is read here
        print(f"cache {path} not used: {type(e).__name__}")
        return spark.createDataFrame([], schema)


def with_publication(papers: DataFrame) -> DataFrame:
    """Adds what publication types tell: the study type and whether the paper is retracted."""
    return papers.withColumn("pubtype_study_type", study_type_of_publication(F.col("publication_types"))).withColumn("retracted", is_retracted(F.col("publication_types")))


def _tags(names: tuple[str, ...]) -> str:
    return r"(?is)</?(?:" + "|".join(names) + r")(?=[\s/>])[^>]*>"


def scanned(markup: Column, *names: str) -> Column:
    """An array of (depth, n, tag, text): the markup cut at the opening and closing tags of these elements. depth: how many
    of them are open after the tag; n: how many outermost ones have begun. A stack as running sums over the tags."""
    pattern = _tags(names)
    zero = F.lit(0)
    begin = F.struct(zero.alias("depth"), zero.alias("n"), F.expr("cast(array() as array<struct<depth:int,n:int,tag:string,text:string>>)").alias("out"))

    def event(tag: Column, text: Column) -> Column:
        return F.struct(tag.alias("tag"), text.alias("text"), F.when(tag.startswith("</"), -1).when((tag == "") | tag.endswith("/>"), 0).otherwise(1).alias("by"))

    def step(acc: Column, e: Column) -> Column:
        at = F.struct(F.greatest(acc.depth + e.by, zero).alias("depth"), (acc.n + ((e.by == 1) & (acc.depth == 0)).cast("int")).alias("n"))
        return let(at, lambda p: F.struct(p.depth.alias("depth"), p.n.alias("n"), F.concat(acc.out, F.array(F.struct(p.depth.alias("depth"), p.n.alias("n"), e.tag.alias("tag"), e.text.alias("text")))).alias("out")))

    def cut(m: Column) -> Column:
        tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(m, F.lit(pattern), F.lit(0)))  # the text before the first tag has none
        return F.aggregate(F.zip_with(tags, F.split(m, pattern, -1), event), begin, step, lambda acc: acc.out)

    return let(markup, cut)


def outside(markup: Column, *names: str) -> Column:
    """The markup without these elements and all that they hold."""
    bare = F.array_join(F.transform(F.filter(scanned(markup, *names), lambda p: p.depth == 0), lambda p: p.text), "")
    return F.when(markup.rlike(_tags(names)), bare).otherwise(markup)  # most have none


def without_comments(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?s)<!--.*?-->", "")


def decoded(text: Column) -> Column:
    """Character references of XML as characters."""
    def number(x: Column) -> Column:
        ref = F.regexp_extract(x, r"^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(ref.startswith("x"), F.conv(F.substring(ref, 2, 9), 16, 16)).otherwise(F.conv(ref, 10, 16))
        return F.when(ref == "", F.concat(F.lit("&#"), x)).otherwise(F.concat(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), x.substr(F.length(ref) + 2, F.length(x))))

    def numbers(t: Column) -> Column:
        refs = let(F.split(t, "&#", -1), lambda parts: F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), number)), ""))
        return F.when(F.contains(t, F.lit("&#")), refs).otherwise(t)

    text = let(text, numbers)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_text(markup: Column) -> Column:
    """All text of markup, white space at its ends removed."""
    return F.regexp_replace(decoded(F.regexp_replace(without_comments(markup), r"<[^>]*>", "")), r"(?U)^\s+|\s+$", "")


def flat_text(xml: Column, trim: bool = True) -> Column:
    """Text of markup without figures, tables and reference lists, white space collapsed; with trim, none is kept at the
    ends of an element's text."""
    return _flat(outside(without_comments(xml), *ASIDE), trim)


def _flat(bare: Column, trim: bool) -> Column:
    if trim:
        bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)(<[^/!>](?:[^>]*[^/>])?>)\s+", "$1"), r"(?U)\s+(?=</)", "")
    return F.btrim(F.regexp_replace(decoded(F.regexp_replace(bare, r"<[^>]*>", "")), r"(?U) \s+|[^\S ]\s*", " "))  # single blanks stay as they are


def section_name(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in SECTIONS if p], F.lit("OTHER"))


def _pieces(markup: str, tags: re.Pattern) -> list[tuple[int, int, str, str]]:
    """As ``scanned``, of one text."""
    out, depth, n, at, tag = [], 0, 0, 0, ""
    for t in tags.finditer(markup):
        out.append((depth, n, tag, markup[at : t.start()]))
        tag, at = t.group(), t.end()
        if tag.startswith("</"):
            depth = max(depth - 1, 0)
        elif not tag.endswith("/>"):
            n, depth = n + (depth == 0), depth + 1
    return [*out, (depth, n, tag, markup[at:])]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, caption, pos, x, own) of rows (key, body): the outermost sections and captions. x: a caption's markup, a section's without
    figures, tables and lists; own: a section's outside sections, figures, tables and lists in it."""
    sec, caption, aside, untitled = (re.compile(_tags(n), re.A) for n in (("sec",), ("caption",), ASIDE, (*ASIDE, "caption")))
    bare = lambda m, tags: "".join(text for depth, _, _, text in _pieces(m, tags) if not depth)
    for batch in batches:
        rows = []
        for i, body in enumerate(batch.column(1).to_pylist()):
            for is_caption, tags in ((False, sec), (True, caption)):
                held = (p for p in _pieces(body or "", tags) if p[0])
                for n, group in itertools.groupby(held, lambda p: p[1]):
                    pieces = list(group)
                    x = "".join(tag + text for _, _, tag, text in pieces)
                    own = None if is_caption else bare("".join(text for depth, _, _, text in pieces if depth == 1), untitled)
                    rows.append((i, is_caption, n - 1, x if is_caption else bare(re.sub(r"(?s)<!--.*?-->", "", x), aside), own))
        at, *others = zip(*rows, strict=True) if rows else ((),) * 5
        arrays = [pa.array(c, t) for c, t in zip(others, (pa.bool_(), pa.int32(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=[batch.schema.names[0], "caption", "pos", "x", "own"])


def sections_of(bodies: DataFrame, key: str = "pmid", trim: bool = True) -> DataFrame:
    """(key, name, pos, text): the top-level sections of a body (key, body: XML as text) with all that they hold, sections inside
    them included, and all captions. A section counts as top-level if no other section holds it; its name follows from its own title, not from
    those of sections, figures or tables inside it. trim: see ``flat_text``. Each body is cut where it is, in one walk over its tags; nothing is shuffled."""
    bare = bodies.select(key, without_comments(F.col("body")).alias("body"))
    both = bare.mapInArrow(_cut, f"`{key}` {bare.schema[key].dataType.simpleString()}, caption boolean, pos int, x string, own string")
    title = plain_text(F.regexp_extract("own", r"(?is)<title(?=[\s>])[^>]*>(.*?)</title\s*>", 1))
    name = F.when(F.col("caption"), "FIGURE LEGENDS").otherwise(let(title, section_name))
    return both.select(key, name.alias("name"), "pos", F.when(F.col("caption"), plain_text(F.col("x"))).otherwise(_flat(F.col("x"), trim)).alias("text"))


def sectioned_text(abstracts: DataFrame, sections: DataFrame, limit: int = S.Settings.fulltext_chars, key: str = "pmid") -> DataFrame:
    """(key, text): the abstract, then sections by priority within ``limit`` characters; labels are not counted, the
    abstract is. abstracts: key, abstract; sections: key, name, pos, text."""
    rank = F.array_position(F.array(*[F.lit(n) for n, _ in SECTIONS]), F.col("name"))
    # empty texts are left out of the list, as a filter of the rows would work out their texts twice
    some = F.filter(F.collect_list(F.struct(rank.alias("rank"), "name", "pos", "text")), lambda s: s.text != "")
    df = abstracts.select(key, F.coalesce("abstract", F.lit("")).alias("abstract")).join(sections.groupBy(key).agg(F.sort_array(some).alias("all")), key, "left")

    def chunks(all_: Column) -> Column:
        names = F.array_distinct(F.transform(all_, lambda s: s["name"]))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.array_join(F.transform(F.filter(all_, lambda s: s["name"] == n), lambda s: s.text), " ").alias("chunk")))

    def step(acc: Column, c: Column) -> Column:
        part = F.concat(c["name"], F.lit(": "), c.chunk.substr(F.lit(1), (F.lit(limit) - acc.before).cast("int")))
        return F.struct((acc.before + F.length(c.chunk)).alias("before"), F.when(acc.before < limit, F.concat(acc.parts, F.array(part))).otherwise(acc.parts).alias("parts"))

    begin = F.struct(F.length("abstract").cast("long").alias("before"), F.array(F.concat(F.lit("ABSTRACT: "), "abstract")).alias("parts"))
    return df.select(key, F.when(F.col("all").isNull(), F.concat(F.lit("ABSTRACT: "), "abstract")).otherwise(F.array_join(F.aggregate(let(F.col("all"), chunks), begin, step, lambda acc: acc.parts), "\n\n")).alias("text"))


def adopt_fulltext(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Papers whose source becomes a full text (pmid, text) longer than the abstract by over 500 characters; all others
    keep what they have."""
    df = papers.join(texts.select("pmid", F.col("text").alias("__text")), "pmid", "left")
    take = (F.col("text_access") != "full_text") & (F.length("__text") > F.length(F.coalesce("abstract", F.lit(""))) + LONGER_BY)
    new = {"source_text": F.when(take, F.col("__text")).otherwise(F.col("source_text")), "text_access": F.when(take, "full_text").otherwise(F.col("text_access"))}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in papers.columns])


def parse_records(records: DataFrame) -> DataFrame:
    """Papers from article markup (xml): labelled abstract parts joined, publication types, year with a fallback to the
    first four digits of a free date."""
    tag = lambda c, t: F.regexp_extract(c, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)
    every = lambda c, t: F.regexp_extract_all(c, F.lit(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>"), F.lit(0))
    part = lambda x: F.concat(let(F.regexp_extract(x, r'(?is)^<AbstractText\b[^>]*\bLabel="([^"]*)"', 1), lambda lab: F.when(lab == "", "").otherwise(F.concat(F.upper(lab), F.lit(": ")))), flat_text(x))
    x = F.col("xml")
    year = flat_text(F.regexp_extract(x, r"(?is)<PubDate>(?:(?!</PubDate>).)*?<Year>(.*?)</Year>", 1))
    out = records.select(
        flat_text(tag(x, "PMID")).alias("pmid"), flat_text(tag(x, "ArticleTitle")).alias("title"), F.concat_ws(" ", F.transform(every(x, "AbstractText"), part)).alias("abstract"),
        flat_text(F.regexp_extract(x, r"(?is)<Journal>(?:(?!</Journal>).)*?<Title>(.*?)</Title>", 1)).alias("journal"),
        F.when(year != "", year).otherwise(F.regexp_extract(tag(x, "MedlineDate"), r"\d{4}", 0)).alias("year"),
        F.filter(F.transform(every(x, "PublicationType"), lambda t: flat_text(t)), lambda p: p != "").alias("publication_types"),
    )
    return with_publication(out.withColumn("source_text", F.col("abstract")).withColumn("text_access", F.lit("abstract_only")))


@dataclass
class CorpusTable:
    """A source over a table of papers: pmid, title, abstract, keywords, publication_types, year, full_text, and place (the
    order in which hits come)."""

    papers: DataFrame
    name: str = "table"

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, ok, pmids, ignored_terms): the first ``retmax`` papers with a keyword phrase in the lower-cased
        query. queries: query_id, query, retmax.

        Phrases stand in an index under their beginning: its first 2^n characters, for the greatest such length up to ``ANCHOR``. A query
        looks up the pieces of these lengths at each of its places, and the phrases found are then compared whole. Equal phrases and equal
        queries are looked up once, and a phrase keeps its first papers only, as many as any query may have: a query's first papers are
        among the first ones of its phrases."""
        most = max(queries.agg(F.max("retmax")).first()[0] or 0, 0)
        lengths = [0, *(1 << n for n in range(ANCHOR.bit_length()))]
        size = F.coalesce(*[F.when(F.length("phrase") >= n, F.lit(n)) for n in reversed(lengths)])
        listed = self.papers.select("pmid", "place", F.explode("keywords").alias("phrase")).where("phrase is not null")
        listed = listed.groupBy("phrase", "place", "pmid").agg(F.lit(1).alias("one"))
        first = materialize(listed.withColumn("n", F.row_number().over(Window.partitionBy("phrase").orderBy("place", "pmid"))).where(F.col("n") <= most).select("phrase", "place", "pmid"), "phrases")
        index = first.select("phrase").distinct().withColumn("size", size).withColumn("start", F.expr("substring(phrase, 1, size)"))
        low = queries.select("query_id", "retmax", F.lower("query").alias("low")).where("low is not null")
        place = F.explode(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1))))
        asked = low.select("low").distinct().select("low", place.alias("at")).select("low", "at", F.explode(F.array(*map(F.lit, lengths))).alias("size"))
        asked = asked.select("low", "size", F.expr("substring(low, at, size)").alias("start")).where("length(start) = size").distinct()
        named = materialize(asked.join(index, ["size", "start"]).where(F.contains("low", F.col("phrase"))).select("low", "phrase").distinct(), "named")
        hit = named.join(first, "phrase").groupBy("low", "place", "pmid").agg(F.lit(1).alias("one"))
        best = hit.withColumn("n", F.row_number().over(Window.partitionBy("low").orderBy("place", "pmid"))).where(F.col("n") <= most)
        lists = materialize(best.groupBy("low").agg(F.sort_array(F.collect_list(F.struct("place", "pmid"))).alias("best")), "lists")
        # the papers of a query; those of several queries with one number together
        one = low.join(lists, "low").groupBy("query_id").agg(F.max("retmax").alias("retmax"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))).alias("best"))
        got = one.select("query_id", F.transform(F.slice("best", F.lit(1), F.greatest("retmax", F.lit(0))), lambda x: x["pmid"]).alias("pmids"))
        none = F.array().cast("array<string>")
        return queries.join(got, "query_id", "left").select("query_id", F.lit(True).alias("ok"), F.coalesce("pmids", none).alias("pmids"), none.alias("ignored_terms"))

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Papers of the ids (pmid) as ``schemas.PAPER``."""
        p = with_publication(self.papers.join(ids.select("pmid").distinct(), "pmid", "left_semi").withColumn("publication_types", F.coalesce("publication_types", F.array(F.lit("Journal Article")))))
        fixed = {"source_text": F.col("abstract"), "text_access": F.lit("abstract_only"), "screen_status": F.lit("unscreened"), "relevance_score": F.lit(0), "relevance_reason": F.lit(""), "journal": F.lit(self.name), "study_type": F.lit(None)}
        empty = {"retrieved_for": "array<string>", "read_for": "array<string>"}
        cols = [(fixed[f.name] if f.name in fixed else F.expr(f"cast(array() as {empty[f.name]})") if f.name in empty else F.col(f.name)).cast(f.dataType).alias(f.name) for f in S.PAPER.fields]
        return p.select(*cols)

    def fulltext(self, papers: DataFrame) -> DataFrame:
        """Papers with their full text as the source, where the table has one."""
        t = self.papers.where("full_text is not null").select("pmid", F.col("full_text").alias("__t"))
        df = papers.join(t, "pmid", "left")
        new = {"source_text": F.coalesce("__t", "source_text"), "text_access": F.when(F.col("__t").isNotNull(), "full_text").otherwise(F.col("text_access"))}
        return df.select(*[new.get(c, F.col(c)).alias(c) for c in papers.columns])


def scenario_papers(scenario: DataFrame) -> DataFrame:
    return scenario.select(F.posexplode("papers").alias("place", "p")).select("place", "p.*")
