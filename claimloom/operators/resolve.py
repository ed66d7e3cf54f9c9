"""Entities: from surface forms to concepts, and concepts merged by their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import clean, entity_of, local_id, lookup_key, maybe_alias, singular, species, trigrams
from claimloom.operators.pairs import complete_linkage
from claimloom.sources.scratch import materialize

# Ontologies in order of preference, and what their prefixes name.
ONTOLOGIES = ("chebi", "pr", "go", "cl", "hp", "mp", "efo", "mondo", "uberon", "ncit")
PREFIX_CATEGORY = {
    "CL": "cell_type", "GO": "process", "CHEBI": "chemical", "HP": "phenotype", "MP": "phenotype", "MONDO": "disease", "DOID": "disease", "EFO": "phenotype",
    "PR": "gene_or_protein", "HGNC": "gene_or_protein", "NCBIGENE": "gene_or_protein", "UBERON": "anatomy", "NCIT": "other",
}
SPECIES_ORDER = ("agnostic", "human", "mouse", "rat")
CONCEPT = ("id", "label", "category", "source", "confidence", "ancestors", "parents")
_NONE = "cast(array() as array<string>)"


def keyed(surfaces: DataFrame, column: str = "surface") -> DataFrame:
    """(surface, name, key) of distinct surface forms."""
    return surfaces.select(F.col(column).alias("surface")).distinct().withColumn("name", singular(F.col("surface"))).withColumn("key", lookup_key(F.col("name")))


def ancestors_of(edges: DataFrame) -> DataFrame:
    """(id, ancestors): all that parent edges (id, parent) lead to. Paths double in length each round, so a hierarchy of
    depth d takes log2(d) joins; it ends when no path is new, as it must, loops or not."""
    paths = materialize(edges.where("id <> parent").select("id", "parent").distinct(), "paths")
    n = paths.count()
    while True:
        paths = materialize(paths.union(paths.join(paths.toDF("parent", "up"), "parent").select("id", "up")).where("id <> parent").distinct(), "paths")
        n, before = paths.count(), n
        if n == before:
            break
    return paths.groupBy("id").agg(F.array_sort(F.collect_set("parent")).alias("ancestors"))


def ontology_matches(keys: DataFrame, terms: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """(key, concept columns): the best term whose label or a synonym has exactly the key. terms: obo_id, label, synonym
    array, ontology_name; hierarchy: id, parents, ancestors. Other species and alleles (unless asked for) fall away;
    species-agnostic terms come first, then human, mouse, rat; then the ontologies in order; then the id."""
    forms = terms.where("obo_id is not null").select("*", F.explode(F.concat(F.array("label"), F.coalesce("synonym", F.expr(_NONE)))).alias("form"))
    forms = forms.select("obo_id", "label", "ontology_name", lookup_key(F.col("form")).alias("key")).distinct()
    hit = keys.select("key", "name").join(forms, "key").withColumn("species", species(F.col("label")))
    hit = hit.where((F.col("species") != "other") & (F.lower("name").contains("allele") | ~F.col("label").rlike(r"(?i)\ballele\b")))
    rank = F.array_position(F.array(*map(F.lit, SPECIES_ORDER)), F.col("species"))
    onto = F.array_position(F.array(*map(F.lit, ONTOLOGIES)), F.coalesce("ontology_name", F.lit("")))
    best = hit.groupBy("key").agg(F.min_by(F.struct("obo_id", "label"), F.struct(rank.alias("a"), F.when(onto == 0, 100).otherwise(onto).alias("b"), F.col("obo_id").alias("c"))).alias("t"))
    prefixes = F.create_map(*[F.lit(x) for kv in PREFIX_CATEGORY.items() for x in kv])
    out = best.select("key", F.col("t.obo_id").alias("id"), F.col("t.label").alias("label"), F.coalesce(F.element_at(prefixes, F.upper(F.split("t.obo_id", ":")[0])), F.lit("unknown")).alias("category"), F.lit("ols").alias("source"), F.lit(0.9).alias("confidence"))
    if hierarchy is None:
        return out.withColumn("ancestors", F.expr(_NONE)).withColumn("parents", F.expr(_NONE))
    return out.join(hierarchy.select("id", "ancestors", "parents"), "id", "left").select("key", *[F.coalesce(c, F.expr(_NONE)).alias(c) if c in ("ancestors", "parents") else F.col(c) for c in CONCEPT])


def resolve(surfaces: DataFrame, cache: DataFrame, terms: DataFrame | None = None, verdicts: DataFrame | None = None, hierarchy: DataFrame | None = None, column: str = "surface") -> DataFrame:
    """(surface, key, concept columns): identifiers first after the cache, then exact ontology terms, then judged labels
    (verdicts: surface, normalized_label, category, confidence), which are looked up in cache and ontology themselves
    before they become local, and last a local id. cache: key and concept columns."""
    asked = materialize(keyed(surfaces, column), "asked")  # tables between the steps, as each is read by several that follow
    cached = lambda keys: keys.join(cache.select("key", *CONCEPT), "key")
    known = cached(asked.select("key").distinct())
    todo = materialize(asked.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min("name").alias("name")), "todo")
    ident = todo.where(F.col("name").rlike(r"^[A-Za-z][A-Za-z0-9_.-]*:\S+$")).select("key", F.col("name").alias("id"), F.col("name").alias("label"), F.lit("identifier").alias("category"), F.lit("identifier").alias("source"), F.lit(1.0).alias("confidence"), F.expr(_NONE).alias("ancestors"), F.expr(_NONE).alias("parents"))
    found = known.unionByName(ident)
    left = todo.join(ident.select("key"), "key", "left_anti")
    if terms is not None:
        exact = materialize(ontology_matches(left, terms, hierarchy), "exact")
        found, left = found.unionByName(exact), left.join(exact.select("key"), "key", "left_anti")
    if verdicts is not None:
        v = verdicts.select(lookup_key(singular(F.col("surface"))).alias("key"), singular(F.col("normalized_label")).alias("name"), "category", "confidence").withColumn("lkey", lookup_key(F.col("name")))
        v = materialize(left.select("key").join(v.dropDuplicates(["key"]), "key"), "judged")
        again = v.select(F.col("lkey").alias("key"), "name").distinct()
        by_label = cached(again.select("key").distinct())
        if terms is not None:
            by_label = by_label.unionByName(ontology_matches(again.join(by_label.select("key"), "key", "left_anti"), terms, hierarchy))
        by_label = by_label.toDF("lkey", *[f"k_{c}" for c in CONCEPT])
        judged = v.join(by_label, "lkey", "left")
        new = {"id": local_id(F.col("name")), "label": clean(F.col("name")), "category": F.when(F.col("category") != "", F.col("category")).otherwise("unknown"), "source": F.lit("llm"), "confidence": F.col("confidence").cast("double"), "ancestors": F.expr(_NONE), "parents": F.expr(_NONE)}
        judged = judged.select("key", *[F.when(F.col("k_id").isNotNull(), F.col(f"k_{c}")).otherwise(new[c]).alias(c) for c in CONCEPT])
        found, left = found.unionByName(judged), left.join(judged.select("key"), "key", "left_anti")
    local = left.select("key", local_id(F.col("name")).alias("id"), F.when(clean(F.col("name")) == "", "unknown").otherwise(clean(F.col("name"))).alias("label"), F.lit("unknown").alias("category"), F.lit("local").alias("source"), F.lit(0.0).alias("confidence"), F.expr(_NONE).alias("ancestors"), F.expr(_NONE).alias("parents"))
    return asked.select("surface", "key").join(found.unionByName(local).dropDuplicates(["key"]), "key")


def saved_cache(cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """The cache with new entries of lasting sources; new ones win."""
    new = resolved.where(F.col("source").isin("ols", "llm", "identifier")).select("key", *CONCEPT).dropDuplicates(["key"])
    return cache.select("key", *CONCEPT).join(new.select("key"), "key", "left_anti").unionByName(new)


def canonical(alias: DataFrame, most: int = 64) -> DataFrame:
    """(child, root): pointer chains (child, parent) followed to their ends, by doubling; chains of up to 2^``most``
    pointers. An error tells of a loop, whose pointers have no end."""
    hop = materialize(alias.select("child", F.col("parent").alias("root")).where("child <> root").dropDuplicates(["child"]), "hops")
    for _ in range(most):
        nxt = hop.select(F.col("child").alias("root"), F.col("root").alias("far"))
        further = hop.join(nxt, "root", "left").select("child", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        further = materialize(further.where("child <> root"), "hops")
        if not further.where("moved").limit(1).count():
            return further.drop("moved")
        hop = further.drop("moved")
    raise ValueError("aliases point at each other in a loop")


def canonicalized(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """The column with ids replaced by their roots."""
    r = roots.select(F.col("child").alias(column), F.col("root").alias("__root"))
    return df.join(r, column, "left").withColumn(column, F.coalesce("__root", column)).select(*df.columns)


SIMILAR = 0.2  # Jaccard similarity of trigrams from which labels may be aliases


def _met(keyed: DataFrame) -> DataFrame:
    """(lo, hi): ids that share a value; keyed: value, id."""
    return keyed.select("value", F.col("id").alias("lo")).join(keyed.select("value", F.col("id").alias("hi")), "value").where("lo < hi").select("lo", "hi")


def trigram_pairs(keys: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(lo, hi): ids whose keys' trigrams may have a Jaccard similarity of ``least``; none that has is lost. keys: id, k.

    Trigrams are put in order, rare ones first. Two sets of n and m that share at least c = least (n + m) / (1 + least) of them share
    one among the first n - ceil(least n) + 1 of the one and the first m - ceil(least m) + 1 of the other, so only
    these are met, and the most frequent ones of a key are not among them. A pair is dropped at a meeting if its sizes differ too much, or if what follows
    the shared trigram in both orders is too short for c."""
    grams = materialize(keys.select("id", F.explode(trigrams(F.col("k"))).alias("g")), "trigrams")
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    sets = grams.join(often, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("s")).withColumn("size", F.size("s"))
    prefix = sets.select("id", "size", F.posexplode(F.slice("s", F.lit(1), F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1)).alias("pos", "x"))
    prefix = materialize(prefix.select(F.col("x.g").alias("g"), "id", "size", (F.col("size") - F.col("pos")).alias("rest")), "prefixes")
    a, b = (prefix.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "rest"))) for s in ("lo", "hi"))
    needed = F.ceil(least / (1 + least) * (F.col("size_lo") + F.col("size_hi")) - 1e-9)
    met = a.join(b, "g").where("id_lo < id_hi").where((F.least("size_lo", "size_hi") >= least * F.greatest("size_lo", "size_hi") - 1e-9))
    # a shared trigram that is not their first has others before it, so the bound by what follows holds for the first one only
    first = met.groupBy(F.col("id_lo").alias("lo"), F.col("id_hi").alias("hi")).agg(F.max(F.least("rest_lo", "rest_hi")).alias("rest"), F.first(needed).alias("needed"))
    return first.where("rest >= needed").select("lo", "hi")


def alias_candidates(concepts: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """(lo, hi): unjudged pairs of concepts (id, label, category) of fitting category with lexically similar labels.

    Pairs that share a word or their first four characters are similar by that alone; similar trigrams are found by
    ``trigram_pairs``. Nothing is lost against comparing all pairs."""
    k = materialize(concepts.select("id", "category", lookup_key(F.col("label")).alias("k")), "keys")
    words = F.transform(F.filter(F.split("k", " "), lambda t: F.length(t) > 2), lambda t: F.concat(F.lit("w:"), t))
    blocks = F.array_distinct(F.concat(words, F.array(F.concat(F.lit("p:"), F.substring("k", 1, 4)))))
    pairs = _met(k.select("id", F.explode(blocks).alias("value"))).unionByName(trigram_pairs(k)).distinct()
    if judged is not None:
        pairs = pairs.join(judged.select("lo", "hi"), ["lo", "hi"], "left_anti")
    side = lambda n: k.select(F.col("id").alias(n), F.col("category").alias(f"c_{n}"), F.col("k").alias(f"k_{n}"))
    both = pairs.join(side("lo"), "lo").join(side("hi"), "hi")
    fits = (F.col("c_lo") == F.col("c_hi")) | (F.col("c_lo") == "unknown") | (F.col("c_hi") == "unknown")
    return both.where(fits & maybe_alias(F.col("k_lo"), F.col("k_hi"))).select("lo", "hi")


def alias_verdicts(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(lo, hi, same_entity): answers (label_a, label_b, same_entity) met with asked pairs (lo, hi, label_lo, label_hi) by
    their labels in either order."""
    a = answers.select(F.least("label_a", "label_b").alias("x"), F.greatest("label_a", "label_b").alias("y"), "same_entity")
    q = asked.select("lo", "hi", F.least("label_lo", "label_hi").alias("x"), F.greatest("label_lo", "label_hi").alias("y"))
    return q.join(a, ["x", "y"]).groupBy("lo", "hi").agg(F.bool_or("same_entity").alias("same_entity"))


def alias_groups(concepts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(child, parent): members of groups all of whose pairs were judged the same, pointed at the best: not local, then
    more confident, then the shorter label, then the smaller id. concepts: id, label, confidence."""
    fam = complete_linkage(concepts, verdicts.where("same_entity").select("lo", "hi")).join(concepts.select("id", "label", "confidence"), "id")
    order = F.struct((~F.col("id").startswith("LOCAL:")).cast("int").alias("a"), "confidence", (-F.length("label")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc(order), "id"))
    best = fam.withColumn("r", rank).where("r = 1").select("family", F.col("id").alias("parent"))
    return fam.join(best, "family").where("id <> parent").select(F.col("id").alias("child"), "parent")


def with_concepts(claims: DataFrame, resolved: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Claims with concepts, labels, categories and parents at both ends, attributes filled where none, tissues merged,
    and the cell type's concept. resolved: output of ``resolve`` over all entities and cell types."""
    from claimloom.operators.memo import merged_tissues

    r = resolved.select("surface", F.col("id").alias("cid"), "label", "category", "parents").dropDuplicates(["surface"])
    if roots is not None:
        own = r.select(F.col("cid").alias("__i"), F.col("label").alias("__l"), F.col("category").alias("__c"), F.col("parents").alias("__p")).dropDuplicates(["__i"])
        r = canonicalized(r, "cid", roots).join(own, F.col("cid") == F.col("__i"), "left").select("surface", "cid", F.coalesce("__l", "label").alias("label"), F.coalesce("__c", "category").alias("category"), F.coalesce("__p", "parents").alias("parents"))
    df, new = claims, {}
    for side in ("subject", "object"):
        df = df.withColumn(f"__{side}", entity_of(F.col(side)))
        mine = r.select(F.col("surface").alias(f"__{side}_s"), *[F.col(c).alias(f"__{side}_{c}") for c in ("cid", "label", "category", "parents")])
        df = df.withColumn(f"__{side}_s", F.col(f"__{side}.entity")).join(mine, f"__{side}_s", "left")
        new |= {f"{side}_concept": F.col(f"__{side}_cid"), f"{side}_label": F.col(f"__{side}_label"), f"{side}_category": F.col(f"__{side}_category"), f"{side}_parents": F.col(f"__{side}_parents")}
        new[f"{side}_attribute"] = F.when(F.coalesce(f"{side}_attribute", F.lit("none")) == "none", F.col(f"__{side}.attribute")).otherwise(F.col(f"{side}_attribute"))
    new["context_tissue"] = merged_tissues(F.coalesce("context_tissue", F.lit("")), F.col("__subject.tissue"), F.col("__object.tissue"))
    df = df.join(r.select(F.col("surface").alias("context_cell_type"), F.col("cid").alias("__cell")), "context_cell_type", "left")
    new["context_concept"] = F.when(F.coalesce("context_cell_type", F.lit("")) == "", "").otherwise(F.coalesce("__cell", F.lit("")))
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in claims.columns])
