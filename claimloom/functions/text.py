"""Names of entities and relations, as column expressions of built-in functions.

``let`` binds an intermediate value once, so that composed expressions stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.schemas import RELATIONS

# Fixed values.
GENERIC = ("cell", "cells", "tissue", "tissues", "gene", "protein", "level", "levels")
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "Δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "κ": "kappa", "λ": "lambda", "μ": "mu", "µ": "mu", "σ": "sigma", "τ": "tau", "ω": "omega",
}
PROCESS = r"differentiation|induction|generation|development|conversion|polarization"
ATTRIBUTE_PATTERNS = (
    (r"\b(?:m?rna |gene |protein )?expression\b|\btranscription\b", "expression"),
    (rf"\b(?:{PROCESS})\b", "differentiation"),
    (
        r"\b(?:levels?|concentrations?|abundance|amounts?|content|secretion|production|release|"
        r"frequency|frequencies|numbers?|proportions?|percentages?|expansion|accumulation)\b",
        "amount",
    ),
    (r"\bsignal+ing\b", "activity"),
    (r"\bphosphorylation\b", "modification"),
)
TISSUES = (
    (r"colonic|colon", "colon"), (r"small[- ]intestinal|intestinal|gut|ileal|jejunal", "intestine"), (r"peyer['’]?s[- ]patch(?:es)?", "Peyer's patch"),
    (r"lamina propria", "lamina propria"), (r"splenic|spleen", "spleen"), (r"bone[- ]marrow|bm", "bone marrow"),
    (r"(?:mesenteric |pancreatic |draining )?lymph[- ]nodes?|mln", "lymph node"), (r"thymic|thymus", "thymus"), (r"peripheral[- ]blood|circulating", "blood"),
    (r"tumou?r[- ]infiltrating|intratumou?ral", "tumor"), (r"mucosal", "mucosa"), (r"hepatic|liver", "liver"), (r"pulmonary|lung", "lung"),
    (r"cutaneous|skin", "skin"), (r"synovial", "synovium"), (r"(?:visceral )?adipose", "adipose tissue"),
)
MODIFIERS = r"de novo|extrathymic|in vitro|in vivo|[\w\-+]+-(?:induced|derived|treated|exposed)"
CHANGE_DOWN = r"loss|deficiency|depletion|decline|knockout|deletion|knockdown"
NOT_AN_ENTITY = ("bone", "weight", "hearing", "muscle", "hair", "fat", "vision", "memory", "tissue", "cell", "cells", "body", "blood", "appetite", "neuron", "neuronal", "synapse", "skin", "lung")
PLACEHOLDERS = ("", "not specified", "unspecified", "unknown", "none", "n/a", "na", "not reported", "not applicable", "it", "they", "this", "these", "that", "those")
NO_SINGULAR = ("diabetes", "herpes", "series", "species", "lupus", "status", "mumps", "measles", "sepsis")
RELATION_LEXICON = {
    "upregulates": "increases", "up-regulates": "increases", "induces": "increases", "increases": "increases", "increased": "increases",
    "elevates": "increases", "elevated": "increases", "enhances": "increases", "enhanced": "increases", "promotes": "increases",
    "promoted": "increases", "stimulates": "increases",
    "downregulates": "decreases", "down-regulates": "decreases", "suppresses": "decreases", "suppressed": "decreases", "inhibits": "decreases",
    "inhibited": "decreases", "reduces": "decreases", "reduced": "decreases", "attenuates": "decreases", "impairs": "decreases",
    "impaired": "decreases", "decreases": "decreases", "decreased": "decreases",
    "no effect": "no_effect", "no effect on": "no_effect", "does not affect": "no_effect", "unchanged": "no_effect",
    "not associated": "not_associated", "not associated with": "not_associated",
    "modulates": "modulates", "affects": "modulates", "regulates": "modulates",
    "required for": "required_for", "is required for": "required_for", "necessary for": "required_for", "sufficient for": "sufficient_for",
    "associated with": "associated_with", "correlated with": "associated_with", "correlates with": "associated_with",
    "predicts": "predicts", "predictive of": "predicts", "binds": "binds", "interacts with": "binds",
    "modifies": "modifies", "phosphorylates": "modifies", "lactylates": "modifies",
}
ABBREVIATION_TAIL = r"\s*\((?=[^()]*[A-Z])[^()\s]{2,12}\)?$"
STEM_STOP = ("cell", "cells", "human", "mouse", "protein", "gene", "level", "levels", "expression", "activity", "function", "signaling", "tumor", "tumour")

_TISSUE = "|".join(f"(?:{p})" for p, _ in TISSUES)
_SEPARATOR = r"(?:\s*,\s*|\s+and\s+|\s+)"
_I = "(?iU)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _generic(s: Column) -> Column:
    return F.lower(s).isin(*GENERIC)


def clean(s: Column) -> Column:
    """Dashes and white space unified, outer punctuation dropped, a trailing abbreviation in parentheses taken off."""

    def outer(t: Column) -> Column:
        return let(F.regexp_replace(t, ABBREVIATION_TAIL, ""), lambda r: F.when(t.rlike(ABBREVIATION_TAIL) & (F.length(r) >= 2) & ~_generic(r), r).otherwise(t))

    def parentheses(t: Column) -> Column:
        uneven = F.length(F.regexp_replace(t, r"[^(]", "")) != F.length(F.regexp_replace(t, r"[^)]", ""))
        return F.when(uneven | t.rlike(r"^\([^()]*\)$"), F.btrim(t, F.lit(" .,;:()[]{}"))).otherwise(t)

    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), "[–—]", "-"), r"(?U)\s+", " "), F.lit(" .,;:[]{}"))
    return F.when(plain.rlike("[()]"), let(let(plain, outer), parentheses)).otherwise(plain)  # most names have none


def ascii_name(s: Column) -> Column:
    """Greek letters spelled out and charges unified."""
    full = F.regexp_replace(F.replace(s, F.lit("⁺"), F.lit("+")), r"(?U)\(\s*\+\s*\)", "+")
    for letter, name in GREEK.items():
        full = F.replace(full, F.lit(letter), F.lit(name))
    return F.when(s.rlike(r"[^\x00-\x7F]|\("), full).otherwise(s)  # plain names need no walk through the letters


def lookup_key(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(ascii_name(clean(s))), "[^a-z0-9+]+", " "))


def local_id(label: Column) -> Column:
    """LOCAL: and a slug of at most 120 characters."""
    slug = F.substring(F.btrim(F.regexp_replace(F.lower(ascii_name(clean(label))), "[^a-z0-9+]+", "_"), F.lit("_")), 1, 120)
    return F.concat(F.lit("LOCAL:"), let(slug, lambda x: F.when(x == "", "unknown").otherwise(x)))


def singular(name: Column) -> Column:
    """The last word made singular where it looks like a common plural."""

    def word(w: Column) -> Column:
        low, rest = F.lower(w), w.substr(F.lit(2), F.length(w))
        usual = ~low.isin(*NO_SINGULAR) & (F.length(w) >= 5) & w.rlike(r"^\p{L}") & rest.rlike(r"\p{Ll}") & ~rest.rlike(r"[\p{Lu}\p{Lt}]")
        return (
            F.when(usual & w.endswith("ies"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y")))
            .when(usual & w.endswith("s") & ~w.rlike("(?:ss|us|is)$"), F.regexp_replace(w, "s$", "")).otherwise(w)
        )

    return let(F.split(clean(name), " "), lambda ws: F.concat_ws(" ", F.slice(ws, F.lit(1), F.size(ws) - 1), let(F.element_at(ws, -1), word)))


def split_change(surface: Column) -> Column:
    """struct(entity, change): loss, deficiency and the like taken off, with change "down"; phenotypes stay whole."""

    def tried(s: Column, pattern: str) -> Column:
        return let(F.regexp_extract(s, pattern, 1), lambda e: F.when((F.length(e) >= 2) & ~_generic(e) & ~F.lower(F.element_at(F.split(e, r"(?U)\s+"), -1)).isin(*NOT_AN_ENTITY), e))

    after = rf"{_I}^(?:(?:age|aging|ageing)[- ](?:related|associated)\s+)?(.+?)\s+(?:{CHANGE_DOWN})$"
    before = rf"{_I}^(?:{CHANGE_DOWN})\s+of\s+(?:the\s+)?(.+)$"
    return let(clean(surface), lambda s: let(F.coalesce(tried(s, after), tried(s, before)), lambda e: F.struct(F.coalesce(e, s).alias("entity"), F.when(e.isNotNull(), "down").otherwise("").alias("change"))))


def split_attribute(surface: Column) -> Column:
    """struct(entity, attribute)."""

    def tried(s: Column, pattern: str, attribute: str) -> Column:
        p = _I + pattern
        rest = clean(F.regexp_replace(F.regexp_replace(s, p, " "), rf"(?U)^\s*of\s+|\s+of\s*$", " "))
        return let(rest, lambda r: F.when(s.rlike(p) & (F.length(r) >= 2) & ~_generic(r), F.struct(r.alias("entity"), F.lit(attribute).alias("attribute"))))

    of = rf"{_I}^(?:[\w\-]+\s+)?(?:{PROCESS})\s+of\s+(?:the\s+)?(.+)$"

    def parts(s: Column) -> Column:
        first = F.when(s.rlike(of), F.struct(clean(F.regexp_extract(s, of, 1)).alias("entity"), F.lit("differentiation").alias("attribute")))
        return F.coalesce(first, *[tried(s, p, a) for p, a in ATTRIBUTE_PATTERNS], F.struct(s.alias("entity"), F.lit("none").alias("attribute")))

    return let(clean(surface), parts)


def split_location(surface: Column) -> Column:
    """struct(entity, tissue): leading tissues, and a trailing "in (the) tissue", taken off."""
    lead = rf"{_I}^(?:(?:{_TISSUE}){_SEPARATOR}(?=[\s\S]{{2}}))*"
    tail = rf"{_I}\s+in\s+(?:the\s+)?({_TISSUE})$"

    def named(t: Column) -> Column:
        return F.coalesce(*[F.when(t.rlike(rf"{_I}^(?:{p})$"), F.lit(n)) for p, n in TISSUES])

    def parts(s: Column) -> Column:
        def with_lead(head: Column) -> Column:
            body = s.substr(F.length(head) + 1, F.length(s))
            found = F.regexp_extract_all(head, F.lit(rf"{_I}({_TISSUE}){_SEPARATOR}"), F.lit(1))
            last = let(F.regexp_extract(body, tail, 1), lambda t: F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>")))
            rest = clean(F.regexp_replace(body, tail, ""))
            tissues = F.concat_ws(", ", F.array_distinct(F.transform(F.concat(found, last), named)))
            return let(F.struct(rest.alias("entity"), tissues.alias("tissue")), lambda x: F.when((x["tissue"] == "") | _generic(x["entity"]), F.struct(s.alias("entity"), F.lit("").alias("tissue"))).otherwise(x))

        return let(F.regexp_extract(s, lead, 0), with_lead)

    return let(clean(surface), parts)


def entity_of(surface: Column) -> Column:
    """struct(entity, attribute, tissue) of a surface form."""

    def placed(a: Column) -> Column:
        bare = let(clean(F.regexp_replace(a["entity"], rf"{_I}^(?:{MODIFIERS})\s+", "")), lambda r: F.when(r == "", a["entity"]).otherwise(r))
        return let(split_location(bare), lambda x: F.struct(x["entity"].alias("entity"), a["attribute"].alias("attribute"), x["tissue"].alias("tissue")))

    return let(split_attribute(split_change(surface)["entity"]), placed)


def entity_parts(surface: Column) -> Column:
    """struct(parts, tissue): short lists of names cut at commas, and, or and slashes; genotypes and long names stay."""
    whole = F.struct(F.array(clean(surface)).alias("parts"), F.lit("").alias("tissue"))

    def cut(x: Column) -> Column:
        parts = F.filter(F.transform(F.split(x["entity"], r"(?U)\s*,\s*(?:and\s+|or\s+)?|\s+and\s+|\s*/\s*"), lambda p: F.btrim(p)), lambda p: p != "")
        short = lambda ps: (F.size(ps) >= 2) & F.forall(ps, lambda p: (F.size(F.split(p, r"(?U)\s+")) <= 3) & (F.length(p) >= 2))
        return let(parts, lambda ps: F.when(short(ps), F.struct(ps.alias("parts"), x["tissue"].alias("tissue"))).otherwise(whole))

    return F.when(surface.rlike(r"[-−–]/[-−–]|\+/[-−–+]"), whole).otherwise(let(split_location(surface), cut))


def lexical_relation(surface: Column) -> Column:
    """A canonical relation from the lexicon or its own name; "" where the wording is open. Hyphens become blanks
    first, so the lexicon's two hyphenated entries are never met."""
    known = {r.replace("_", " "): r for r in RELATIONS if r != "unresolved"} | RELATION_LEXICON
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    s = F.btrim(F.regexp_replace(F.replace(F.lower(F.coalesce(surface, F.lit(""))), F.lit("-"), F.lit(" ")), r"(?U)[\s_]+", " "))
    return F.coalesce(F.element_at(table, s), F.lit(""))


def species(label: Column) -> Column:
    """agnostic, human, mouse, rat or other, from a trailing parenthesis."""
    tag = F.lower(F.regexp_extract(label, r"(?U)\(([^()]+)\)\s*$", 1))
    return let(tag, lambda t: (
        F.when(t == "", "agnostic").when(t.isin("human", "homo sapiens"), "human").when(t.isin("mouse", "mus musculus"), "mouse")
        .when(t.isin("rat", "rattus norvegicus"), "rat").when(t.rlike("^[a-z .]+$"), "other").otherwise("agnostic")
    ))


def block_keys(concept: Column, parents: Column, label: Column) -> Column:
    """The concept, its direct parents, and five-letter stems of the label's longer words."""
    words = F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9+]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*STEM_STOP))
    return F.array_distinct(F.concat(F.array(concept), F.coalesce(parents, F.array().cast("array<string>")), F.transform(words, lambda w: F.concat(F.lit("stem:"), F.substring(w, 1, 5)))))


def claim_text(subject: Column, relation: Column, obj: Column, cell_type: Column, model: Column) -> Column:
    some = lambda c, d: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit(d))
    return F.concat(subject, F.lit(" "), relation, F.lit(" "), obj, F.lit("; context "), some(cell_type, "unspecified"), F.lit(" "), some(model, ""))


def link_key(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat_ws("|", subject, relation, obj)


def key_part(key: Column, part: str) -> Column:
    """subject, relation or object of a key."""
    return F.element_at(F.split(key, r"\|"), ("subject", "relation", "object").index(part) + 1)


def trigrams(key: Column) -> Column:
    s = F.replace(key, F.lit(" "), F.lit(""))
    return let(s, lambda x: F.when(F.length(x) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: x.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>")))


def maybe_alias(a: Column, b: Column) -> Column:
    """Whether two lookup keys share a word of over two letters, their first four characters, or trigrams with a
    Jaccard similarity of 0.2 or more."""
    words = lambda k: F.filter(F.split(k, " "), lambda t: F.length(t) > 2)
    grams = let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), lambda s: (F.size(s["x"]) > 0) & (F.size(s["y"]) > 0) & (F.size(F.array_intersect(s["x"], s["y"])) >= 0.2 * F.size(F.array_union(s["x"], s["y"]))))
    return F.arrays_overlap(words(a), words(b)) | (F.substring(a, 1, 4) == F.substring(b, 1, 4)) | grams
