"""Tables of the evidence graph derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import schemas as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each line item: subject a supplier, object a part, relation from quantity, flag and numbers."""
    li = table(spark, sf_dir, "lineitem")
    s, o = F.col("l_suppkey") % 100, F.col("l_partkey") % 200
    relation = (
        F.when((F.col("l_quantity") <= 8) & (F.col("l_returnflag") == "A"), "no_effect").when(F.col("l_quantity") <= 8, "decreases")
        .when((F.col("l_returnflag") == "R") & (o % 3 == 0), "decreases").when((s + o) % 11 == 0, "associated_with").otherwise("increases")
    )
    tier = F.when(F.col("l_discount") < 0.03, 1).when(F.col("l_discount") < 0.08, 2).otherwise(3)
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    pp, sp, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    values = {
        "id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")), "pmid": F.concat(F.lit("P"), F.col("l_orderkey")),
        "subject_concept": name("S", s), "object_concept": name("P", o), "subject_label": name("S", s), "object_label": name("P", o), "relation_norm": relation,
        "comparator_present": F.col("l_linestatus") == "O", "study_type": F.when(ln == 7, "review").otherwise(pick(S.STUDY_TYPES[:-1], pp)), "grade": S.grade_of(tier),
        "claim_type": pick(S.CLAIM_TYPES, ln), "perturbation_class": pick(S.PERTURBATIONS, sp), "system": pick(S.SYSTEMS, pp + sp), "rescue_arm": F.col("l_quantity") % 7 == 0,
        "orthogonal_validation": F.col("l_quantity") % 5 == 0, "readout_is_inferred": F.col("l_quantity") % 3 == 0, "text_access": F.when(F.col("l_tax") < 0.04, "abstract_only").otherwise("full_text"),
        "context_cell_type": pick((" CD8 T", "b cell", ""), pp + ln), "context_tissue": pick(("Colon", ""), sp), "context_concept": F.lit(""), "method_checks": F.expr("cast(array() as array<string>)"), "round": F.lit(1),
        "subject_category": F.lit("chemical"), "object_category": F.lit("phenotype"),
    }
    return li.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CLAIM.fields])


def _pick(values, key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({key}) % {len(values)} AS INTEGER) + 1)"


CLAIMS_SQL = f"""claims AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, 'P' || l_orderkey AS pmid,
    'S' || (l_suppkey % 100) AS s, 'P' || (l_partkey % 200) AS o,
    CASE WHEN l_quantity <= 8 AND l_returnflag = 'A' THEN 'no_effect' WHEN l_quantity <= 8 THEN 'decreases'
         WHEN l_returnflag = 'R' AND (l_partkey % 200) % 3 = 0 THEN 'decreases' WHEN (l_suppkey % 100 + l_partkey % 200) % 11 = 0 THEN 'associated_with' ELSE 'increases' END AS r,
    l_linestatus = 'O' AS control, CASE WHEN l_linenumber = 7 THEN 'review' ELSE {_pick(S.STUDY_TYPES[:-1], 'l_partkey')} END AS study,
    CASE WHEN l_discount < 0.03 THEN 1 WHEN l_discount < 0.08 THEN 2 ELSE 3 END AS tier,
    {_pick(S.CLAIM_TYPES, 'l_linenumber')} AS claim_type, {_pick(S.PERTURBATIONS, 'l_suppkey')} AS perturbation, {_pick(S.SYSTEMS, 'l_partkey + l_suppkey')} AS system,
    {_pick(('cd8 t', 'b cell', 'unspecified'), 'l_partkey + l_linenumber')} AS cell, {_pick(('Colon', ''), 'l_suppkey')} AS tissue, CAST(round(l_extendedprice * 100) AS BIGINT) % 6 AS l_tail,
    l_quantity % 7 = 0 AS rescue, l_quantity % 5 = 0 AS orthogonal, l_quantity % 3 = 0 AS inferred, CASE WHEN l_tax < 0.04 THEN 'abstract_only' ELSE 'full_text' END AS access
  FROM lineitem)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small graph of edges between nations, for paths: three out of each."""
    n = F.col("n_nationkey").cast("long")
    nation = table(spark, sf_dir, "nation").select(n.alias("n"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    to, complete = F.pmod(F.col("n") * (3 + 2 * F.col("k")) + 1 + F.col("k"), F.lit(25)), (F.pmod(F.col("n") * 13 + F.col("k") * 7, F.lit(10))) / 10
    relation = F.when((F.col("n") + F.col("k")) % 2 == 0, "increases").otherwise("decreases")
    df = nation.withColumn("o", to).where("n <> o").select(F.concat(F.lit("N"), "n").alias("subject"), relation.alias("relation"), F.concat(F.lit("N"), "o").alias("object"), complete.alias("completeness"), F.col("k"))
    df = df.groupBy("subject", "relation", "object").agg(F.max("completeness").alias("completeness"))
    return df.select(
        F.concat_ws("|", "subject", "relation", "object").alias("key"), "subject", "relation", "object", "completeness", F.array(F.lit("c")).alias("support_ids"),
        F.when(F.col("completeness") >= 0.7, "supported").when(F.col("completeness") < 0.1, "contradicted").otherwise("insufficient").alias("status"), F.lit("why").alias("reason"),
        (F.col("completeness") == 0.2).alias("exhausted"), F.expr("cast(array() as array<string>)").alias("contexts"), F.col("subject").alias("subject_label"), F.col("object").alias("object_label"),
        F.lit(0).alias("times_targeted"),
    )


LINKS_SQL = """raw AS (SELECT CAST(n_nationkey AS BIGINT) AS n, k FROM nation, (VALUES (0), (1), (2)) t(k)),
edges0 AS (SELECT n, k, (n * (3 + 2 * k) + 1 + k) % 25 AS o, ((n * 13 + k * 7) % 10) / 10.0 AS c, CASE WHEN (n + k) % 2 = 0 THEN 'increases' ELSE 'decreases' END AS r FROM raw),
links AS (SELECT 'N' || n AS s, r, 'N' || o AS o, CAST(max(c) AS DOUBLE) AS c, 'N' || n || '|' || r || '|' || 'N' || o AS key FROM edges0 WHERE n <> o GROUP BY n, r, o)"""


def graph_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same claims over one set of nodes, so that objects can be subjects of others."""
    node = lambda c: F.concat(F.lit("N"), F.substring(c, 2, 9))
    c = claims(spark, sf_dir)
    return c.withColumns({k: node(k) for k in ("subject_concept", "object_concept", "subject_label", "object_label")})


GRAPH_SQL = CLAIMS_SQL.replace("'S' || (l_suppkey % 100) AS s, 'P' || (l_partkey % 200) AS o", "'N' || (l_suppkey % 100) AS s, 'N' || (l_partkey % 200) AS o")
