"""Uniqueness that is kept up while records change, and retraction of findings that no longer hold.

The values that uniqueness rules judge are stored by a hash of their key (`bucket`) and one of their record (`slice`), as Parquet partitions;
beside them the findings, dealt alike, and the keys of each record by a hash of the record. A round of changes reads the partitions of the keys that
the changed records had or have, and writes those of the changed records, and of keys that have come to be shared or no longer are. A key that very many records hold
lies in all slices of its bucket; while it stays shared, a change of one record writes one slice.

A round may be run again, whatever it had written when it stopped: the keys of records are written last, and all else follows from them and
from the records as they are now.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.operators import rules as R
from fieldwarden.operators.contexts import Events
from fieldwarden.session import with_checkpoint_dir

KEY = ["rule", "field", "key"]
IDENTITY = ["rule", "field", "_record", "_event", "_instance", "_form"]
CANDIDATES = f"{R.PLACE}, rule int, field string, value string, key array<string>, bucket int, slice int"
FINDINGS = f"{R.PLACE}, rule int, type string, field string, reason string, value string, key array<string>, epoch long, bucket int, slice int"
PLACES = "_record string, rule int, field string, key array<string>, bucket int, slice int"


def retract(published: DataFrame, current: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is to be added to published rows and what to be taken away, so that they become the current ones: an anti join each way.
    Nulls are equal."""
    same = lambda a, b: a.alias("a").join(b.select(*on).distinct().alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on], "left_anti")
    return same(current, published), same(published, current)


def stale(staged: DataFrame, groups: DataFrame, group: list[str], staged_epoch: str = "stage_epoch", epoch: str = "candidate_epoch") -> tuple[DataFrame, DataFrame]:
    """Staged rows that can still be published, and those of an epoch that their group has left, or of no group: one anti join."""
    now = groups.select(*group, F.col(epoch).alias(staged_epoch))
    on = [*group, staged_epoch]
    return staged.join(now, on, "left_semi"), staged.join(now, on, "left_anti")


def phases(groups: DataFrame) -> DataFrame:
    """phase, n, blocking: how many groups are in each phase; those that could not be decided block the claim of a clean scan."""
    return groups.groupBy("phase").agg(F.count("*").alias("n"), (F.max(F.col("phase") == "collision")).alias("blocking"))


@dataclass(frozen=True)
class Round:
    added: DataFrame
    retracted: DataFrame
    buckets: int  # of keys that were read


class UniqueState:
    """Candidates, findings and keys by record, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, home: str, buckets: int = 256, slices: int = 16):
        self.spark, self.home, self.buckets, self.slices = with_checkpoint_dir(spark), home, buckets, slices

    def _read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(f"{self.home}/{name}")
        return (found if buckets is None else found.where(F.col("bucket").isin(buckets))).where("rule is not null")

    def _replace(self, name: str, rows: DataFrame, written: DataFrame) -> None:
        """Writes partitions whole. written: bucket, slice of each; one without rows gets a row of nulls, so that it is written too."""
        rows = rows.unionByName(written, allowMissingColumns=True).repartition("bucket", "slice")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slice").parquet(f"{self.home}/{name}")

    def _hashed(self, columns: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")

    def holders(self, ordinal: int, rule: R.Rule, name: str, values: Mapping[str, str], record: str | None = None, event: str | None = None, group: str | None = None) -> DataFrame:
        """record, dag of the other records that hold a value: one partition of keys is read, with rule and field as pushed filters."""
        said = lambda f: (values.get(f) or "").strip(R.BLANK)
        key = [said(name), *map(said, rule.unique_with)]
        key += {"event": [f"event {event}"], "dag": [f"group {group or ''}"]}.get(rule.scope, [])
        made = F.array(*map(F.lit, key))
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(ordinal), F.lit(name), made), F.lit(self.buckets)).cast("int")).first()[0]
        rows = self._read("candidates", CANDIDATES, [bucket]).where((F.col("rule") == ordinal) & (F.col("field") == name) & (F.col("key") == made) & F.lit(key[0] != ""))
        others = rows if record is None else rows.where(F.col("_record") != record)
        return others.select(F.col("_record").alias("record"), F.col("_dag").alias("dag")).distinct()

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).drop("bucket", "slice", "key")

    def apply(self, changed: DataFrame, contexts: DataFrame, rules: list[R.Rule], dictionary: R.Dictionary, epoch: int, events: Events | None = None) -> Round:
        """A round. changed: _record of the records that are new, edited or gone; contexts: those of them that exist, as they are now.

        Findings are the same as those of a scan of all records. A context of a record that is not among the changed ones is ignored.
        """
        changed = changed.select("_record").where("_record is not null").distinct().checkpoint()
        ours = contexts.join(changed, "_record", "left_semi")
        made = R.candidates(ours, rules, dictionary, events).where("type = 'unique'").dropDuplicates(IDENTITY)
        dealt = made.withColumn("bucket", self._hashed(KEY, self.buckets)).withColumn("slice", self._hashed(["_record"], self.slices))
        fresh = dealt.select(*R.META, "rule", "type", "field", "reason", "value", "key", "bucket", "slice").checkpoint()

        homes = changed.withColumn("bucket", self._hashed(["_record"], self.buckets))
        of_records = self._list(homes)
        known = self._read("places", PLACES, of_records).checkpoint()
        before = known.join(changed, "_record", "left_semi")
        dealt_keys = lambda frame: frame.select(*KEY, "bucket").distinct()
        left = before.select("_record", *KEY).withColumn("bucket", self._hashed(KEY, self.buckets))
        touched = dealt_keys(left.unionByName(fresh.select("_record", *KEY, "bucket"))).distinct().checkpoint()
        buckets = self._list(touched)

        stored = self._read("candidates", CANDIDATES, buckets)
        others = stored.join(changed, "_record", "left_anti")
        published = self._read("findings", FINDINGS, buckets)
        keys = touched.select(*KEY)
        was = published.join(keys, KEY, "left_semi").select(*KEY).distinct().withColumn("was", F.lit(True))
        ends = others.join(keys, KEY, "left_semi").select(*KEY, "_record").unionByName(fresh.select(*KEY, "_record")).groupBy(*KEY).agg(F.min("_record").alias("a"), F.max("_record").alias("b"))
        now = ends.where("a <> b").select(*KEY).withColumn("now", F.lit(True))
        state = keys.join(was, KEY, "left").join(now, KEY, "left").select(*KEY, F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now")).checkpoint()

        risen, fallen = state.where("now and not was").select(*KEY), state.where("was and not now").select(*KEY)
        shared = fresh.join(state.where("now").select(*KEY), KEY, "left_semi")
        joined = others.join(risen, KEY, "left_semi").withColumns({"type": F.lit("unique"), "reason": F.lit("duplicate-value")})
        new = shared.unionByName(joined.select(*shared.columns)).withColumn("epoch", F.lit(epoch).cast("long")).checkpoint()
        gone = published.join(changed, "_record", "left_semi").unionByName(published.join(changed, "_record", "left_anti").join(fallen, KEY, "left_semi")).checkpoint()

        written = gone.select("bucket", "slice").unionByName(new.select("bucket", "slice")).distinct().checkpoint()
        kept = published.join(written, ["bucket", "slice"], "left_semi").join(changed, "_record", "left_anti").join(fallen, KEY, "left_anti")
        findings = kept.unionByName(new.select(*kept.columns)).checkpoint()
        mine = left.select("_record", "bucket").unionByName(fresh.select("_record", "bucket")).withColumn("slice", self._hashed(["_record"], self.slices)).select("bucket", "slice").distinct().checkpoint()
        values = others.join(mine, ["bucket", "slice"], "left_semi").unionByName(fresh.select(*others.columns)).checkpoint()
        places = known.join(changed, "_record", "left_anti").select("_record", *KEY).unionByName(fresh.select("_record", *KEY).distinct())
        places = places.withColumns({"bucket": self._hashed(["_record"], self.buckets), "slice": F.lit(0)}).checkpoint()

        self._replace("candidates", values, mine)
        self._replace("findings", findings, written)
        self._replace("places", places, homes.select("bucket").distinct().withColumn("slice", F.lit(0)))
        added, retracted = retract(gone, new, IDENTITY)
        return Round(added.select(*R.META, "rule", "type", "field", "reason", "value"), retracted.select(*R.META, "rule", "type", "field", "reason", "value"), len(buckets))

    @staticmethod
    def _list(frame: DataFrame) -> list[int]:
        return [r.bucket for r in frame.select("bucket").distinct().collect()]  # no more than there are buckets


def keep_up(state: UniqueState, rounds: list[tuple[DataFrame, DataFrame]], rules: list[R.Rule], dictionary: R.Dictionary, events: Events | None = None, seen: Callable[[Round], None] = lambda r: None) -> DataFrame:
    """Rounds one after another, each (changed, contexts); the findings that hold after the last."""
    for number, (changed, contexts) in enumerate(rounds, 1):
        seen(state.apply(changed, contexts, rules, dictionary, number, events))
    return state.findings()
