"""Mixing sources to target weights: tokens per source, repetition rates, then floor(rate) copies plus a Bernoulli one.

The Bernoulli draw is a hash of the document and of one of SEEDS seeds, of which each source takes the one whose draws come nearest
to its target. So a document's extra copy has the stated probability over ids, but the copies of a source's documents are not
quite independent. The table of sources, one row each, is sorted in one task.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; an empty source gets target 0;
a null doc_id takes part like any other; repeated rows draw the same number and so share their fate; an empty table
gives an empty mix. Further columns of the input are kept and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrail.llm.common import WORD_RE, materialize, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEEDS = 8


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def draw(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on the document and the seed (0 to SEEDS - 1) alone: 32 bits of one SHA-256."""
    digest = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), 256)
    return F.conv(F.substring(digest, seed * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def copies_of(rate: Column, number: Column) -> Column:
    """floor(rate) plus one more with the fraction's probability."""
    return (F.floor(rate) + F.when(number < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, rate); one row per source, so the windows stay small.

    Sources in code-point order, null last, weigh weights in turn. A source stops at max_repeat times its size and the
    excess goes to the others by weight: with sources sorted by cap / weight, all before the first one that its own
    water level does not cap are at their caps, and the level there serves the rest.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "rn")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rn") - 1) % len(weights) + 1)
    caps = (
        sizes.withColumn("rn", F.row_number().over(ordered))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * max_repeat)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    levels = (
        caps.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("water", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rn"))).over(everything))
    )
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("water"), F.col("cap")))
    return levels.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0).alias("rate"),
    )


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """(source, source_size, target, rate, seed): what mix() needs, one row per source.

    Of SEEDS seeds each source takes the one whose draws bring its taken words nearest to its target (ties: the lowest).
    """
    slim = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_of(text_col)).alias("size")), "mix-sizes"
    )
    targets = materialize(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat), "mix-targets")
    rated = slim.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    taken = [F.sum(F.col("d.size") * copies_of(F.col("t.rate"), draw(F.col("d.doc_id"), F.lit(k)))).cast("double") for k in range(SEEDS)]
    near = rated.groupBy("t.source", "t.source_size", "t.target", "t.rate").agg(*[s.alias(f"taken{k}") for k, s in enumerate(taken)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]))
    return materialize(near.select("source", "source_size", "target", "rate", best["k"].alias("seed")), "mix-plan")


def mix(docs: DataFrame, plan: DataFrame, id_col="doc_id", source_col="source") -> DataFrame:
    """(row, source_size, target, copies): each document's whole row with the copies that the mix emits of it."""
    p = plan.select(F.struct("*").alias("_plan"))
    d = docs.select(F.struct("*").alias("row"))
    joined = d.join(p, F.col(f"row.{source_col}").eqNullSafe(F.col("_plan.source")))
    return joined.select(
        "row",
        F.col("_plan.source_size").alias("source_size"),
        F.col("_plan.target").alias("target"),
        copies_of(F.col("_plan.rate"), draw(F.col(f"row.{id_col}"), F.col("_plan.seed"))).alias("copies"),
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each document's row as often as the mix takes it."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from caretrail.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", "text"), mix_plan(docs)).select(
        F.col("row.doc_id").alias("doc_id"),
        size_of(text_of("row.text")).alias("size"),
        "source_size",
        "target",
        (size_of(text_of("row.text")) * F.col("copies")).alias("taken"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM d GROUP BY source),
c AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rn - 1) % 3 + 1)::INT] AS weight, source_size::DOUBLE * 3 AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM c WINDOW b AS (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (
  SELECT level AS water FROM l WHERE level <= ratio ORDER BY ratio, rn LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT water FROM w), cap)) AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
k AS (SELECT unnest(range(8))::INT AS k),
e AS (
  SELECT d.*, source_size, target, k,
    size * (floor(rate) + CASE WHEN (('0x' || substr(digest, k * 8 + 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN k),
p AS (
  SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken)::DOUBLE - any_value(target)), k) AS n FROM e GROUP BY source, k) WHERE n = 1)
SELECT e.doc_id, e.size, e.source_size, e.target, e.taken FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.k = p.k
"""
