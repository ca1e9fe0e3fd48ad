"""Roll-ups and statistics of findings: one aggregation with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.functions.text import reason_code

AXES = {"instrument": "_form", "reason": "reason", "group": "_dag", "check": "type"}


def by_axes(findings: DataFrame) -> DataFrame:
    """kind, axis, n: findings by instrument, by reason code, by group and by kind of check, in one pass."""
    value = lambda kind, c: reason_code(F.col(c)) if kind == "reason" else F.coalesce(F.col(c), F.lit(""))
    axes = [F.struct(F.lit(k).alias("kind"), value(k, c).alias("axis")) for k, c in AXES.items()]
    return findings.select(F.explode(F.array(*axes)).alias("a")).groupBy("a.kind", "a.axis").agg(F.count("*").alias("n"))


def statistics(contexts: DataFrame, findings: DataFrame, rules: int) -> DataFrame:
    """records, contexts, rules, findings: one row."""
    seen = contexts.agg(F.countDistinct("_record").alias("records"), F.count("*").alias("contexts"))
    return seen.crossJoin(findings.agg(F.count("*").alias("findings"))).withColumn("rules", F.lit(rules))  # one row each


def groups(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Groups of candidates: how many records share a key, who stands for them, and whether they collide."""
    counted = candidates.groupBy(*key).agg(F.countDistinct("_record").alias("records"), F.min("_record").alias("representative"))
    return counted.withColumn("collides", F.col("records") > 1)


def states(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("state").agg(F.count("*").alias("n"))


def counters(rows: DataFrame, by: list[str], sample: str, blocking: Column, most: int = 3) -> DataFrame:
    """by, n, samples, blocks: how many rows, the first `most` different samples in order, and whether any row blocks the claim of a clean scan.

    Samples are limited in each task before the shuffle (a ranked limit by group), so that a group of any size sends a few of each.
    """
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(blocking).alias("blocks"))
    return _sampled(counted, rows.where(F.col(sample).isNotNull()).select(*by, F.col(sample).alias("_sample")), by, most)


def merged(counters: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """Counters of several runs or parts as one: counts are added, samples stay the first in order, and what blocks one blocks all."""
    counted = counters.groupBy(*by).agg(F.sum("n").alias("n"), F.max("blocks").alias("blocks"))
    return _sampled(counted, counters.select(*by, F.explode("samples").alias("_sample")), by, most)


def _sampled(counted: DataFrame, samples: DataFrame, by: list[str], most: int) -> DataFrame:
    ranked = samples.distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_sample"))).where(F.col("_rank") <= most)
    few = ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_sample")).alias("samples"))  # no more than `most`
    same = [counted[c].eqNullSafe(few[c]) for c in by]
    return counted.join(few, same, "left").select(*[counted[c] for c in by], "n", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "blocks")
