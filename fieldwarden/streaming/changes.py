"""Scans of data that changes: the window of a change log, what it did to a manifest, and what a finished run may claim."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from fieldwarden.operators.contexts import Events, with_states
from fieldwarden.operators.rules import PLACE, Dictionary, Rule, candidates, read_set, row_local
from fieldwarden.session import with_checkpoint_dir

#: Rounds of catching up after which a run says that its records don't settle, and attempts to read a record before it counts as gone.
ROUNDS, ATTEMPTS = 4, 3
MANIFEST = "record string, scanned_version long, state string, tries int"


def fence(log: DataFrame, offset: str = "log_id") -> DataFrame:
    """The log's first and last offset: what a run opened at, and whether its start is still there."""
    return log.agg(F.min(offset).alias("first"), F.max(offset).alias("last"))


def retained(first: int | None, opened: int | None) -> bool:
    """Whether the log still reaches back to where the run opened; if not, nothing can be proved."""
    return first is not None and opened is not None and first <= opened


def window(log: DataFrame, opened: int, target: int, record: str = "record", offset: str = "log_id") -> DataFrame:
    """record, version: the last offset in (opened, target] of each record that has an id."""
    inside = log.where((F.col(offset) > opened) & (F.col(offset) <= target) & F.col(record).isNotNull() & (F.col(record).cast("string") != ""))
    return inside.groupBy(F.col(record).alias("record")).agg(F.max(offset).alias("version"))


def classify(manifest: DataFrame, changed: DataFrame, present: DataFrame) -> DataFrame:
    """record, change of every changed record: NEW is not on the manifest, GONE no longer exists, EDITED was scanned at an
    older version, SETTLED otherwise. manifest: record, scanned_version; present: record."""
    here = present.select("record").distinct().withColumn("_here", F.lit(True))
    known = manifest.select("record", "scanned_version").withColumn("_known", F.lit(True))
    joined = changed.join(known, "record", "left").join(here, "record", "left")
    edited = F.col("scanned_version").isNull() | (F.col("version") > F.col("scanned_version"))
    change = F.when(F.col("_known").isNull() & F.col("_here").isNull(), "SETTLED").when(F.col("_known").isNull(), "NEW").when(F.col("_here").isNull(), "GONE").when(edited, "EDITED")
    return joined.select("record", "version", change.otherwise("SETTLED").alias("change"))


def settle(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest (record, scanned_version, state, tries) after a look at its changes: NEW records are added and EDITED ones asked for
    again, as 'pending'; GONE ones become 'tombstone'; the rest stays."""
    joined = manifest.join(changes.select("record", "change"), "record", "full")
    again = F.col("change").isin("NEW", "EDITED")
    state = F.when(again, "pending").when(F.col("change") == "GONE", "tombstone").otherwise(F.col("state"))
    kept = joined.where(F.col("state").isNotNull() | again)
    return kept.select("record", "scanned_version", state.alias("state"), F.when(again, 0).otherwise(F.col("tries")).cast("int").alias("tries"))


def after_read(manifest: DataFrame, read: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """The manifest once pending records were read. read: record, version at which it was read. A record that was asked for and not found
    stays pending, and is a tombstone at the last attempt."""
    joined = manifest.join(read.select("record", "version", F.lit(True).alias("_read")), "record", "left")
    asked, here = F.col("state") == "pending", F.coalesce("_read", F.lit(False))
    tries = F.when(asked & ~here, F.col("tries") + 1).otherwise(F.col("tries"))
    state = F.when(asked & here, "done").when(asked & (tries >= attempts), "tombstone").otherwise(F.col("state"))
    version = F.when(asked & here, F.col("version")).otherwise(F.col("scanned_version"))
    return joined.select("record", version.cast("long").alias("scanned_version"), state.alias("state"), tries.cast("int").alias("tries"))


@dataclass(frozen=True)
class CaughtUp:
    manifest: DataFrame
    fenced: bool  # all changes from the opening to the fence are covered
    settled: bool
    rounds: int


def catch_up(manifest: DataFrame, log: DataFrame, present: Callable[[], DataFrame], rescan: Callable[[DataFrame], DataFrame], opened: int, rounds: int = ROUNDS) -> CaughtUp:
    """Rescans what changed while a run was under way, until nothing is left or the rounds are used up.

    The window is fixed: from the offset at which the run opened to the log's last one now. present() gives the records that exist, and
    rescan(records) the records read and their versions; it writes their findings. The manifest of each round is cut by a checkpoint.
    """
    with_checkpoint_dir(manifest.sparkSession)
    ends = fence(log).first()
    if not retained(ends["first"], opened):
        return CaughtUp(manifest, False, False, 0)
    changed = window(log, opened, ends["last"]).checkpoint()
    for number in range(rounds + 1):
        manifest = settle(manifest, classify(manifest.where("state <> 'tombstone'"), changed, present())).checkpoint()
        pending = manifest.where("state = 'pending'").select("record")
        if pending.isEmpty():
            return CaughtUp(manifest, True, True, number)
        manifest = after_read(manifest, rescan(pending)).checkpoint()
    return CaughtUp(manifest, False, False, rounds)


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """record, stable: whether its version (record, version) is the same before and after it was read."""
    return before.alias("b").join(after.alias("a"), "record", "left").select("record", F.col("b.version").eqNullSafe(F.col("a.version")).alias("stable"))


def exists(ids: DataFrame, records: DataFrame) -> DataFrame:
    """The ids, each with whether a record has it."""
    here = records.select("record").distinct().withColumn("_here", F.lit(True))
    return ids.join(here, "record", "left").select("record", F.coalesce("_here", F.lit(False)).alias("exists"))


def groups_of(ids: DataFrame, records: DataFrame) -> DataFrame:
    """The ids, each with its record's group (record, dag) as `dag`: null if it has none or a blank one, if there is no such record, or if its rows don't agree."""
    told = F.coalesce(F.col("dag"), F.lit(""))
    known = records.groupBy("record").agg(F.when(F.min(told) == F.max(told), F.nullif(F.min(told), F.lit(""))).alias("dag"))
    return ids.select("record").join(known, "record", "left")


def admitted(ids: DataFrame, records: DataFrame, group: str | None) -> DataFrame:
    """The ids, each with whether it is in a run of a group as `in_scope`. A record whose group can't be told is out; a run of no group takes all."""
    if group is None:
        return ids.select("record", F.lit(True).alias("in_scope"))
    return groups_of(ids, records).select("record", F.coalesce(F.col("dag") == group, F.lit(False)).alias("in_scope"))


def in_scope(rows: DataFrame, group: str | None) -> DataFrame:
    """Rows of a group; with a group given, rows of none are out."""
    return rows if group is None else rows.where(F.col("_dag").eqNullSafe(F.lit(group)))


def page(rows: DataFrame, after: str | None, size: int, key: str = "record") -> DataFrame:
    """The next rows by key: a filter and a limited sort, never an offset."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(max(1, min(size, 5000)))


#: Phases of a run, in the only order they may take.
PHASES = ("planning", "scanning", "catch-up", "unique-finalize", "rollup-finalize", "terminal")


def may_follow(phase: str, following: str) -> bool:
    if phase not in PHASES or phase == "terminal":
        return False
    return following in ("cancelling", "terminal") or following in PHASES and PHASES.index(following) == PHASES.index(phase) + 1


@dataclass(frozen=True)
class Run:
    """What is known of a run at its end."""

    failed: bool = False
    cancelled: bool = False
    expired: bool = False
    blocked: int = 0  # gaps: unreadable or unsettled records, rule problems
    fenced: bool = True  # changes since the start are proved to be covered
    manifest_complete: bool = True
    truncated: bool = False
    examined: int = 0
    findings: int = 0


def outcome(run: Run) -> str:
    """The one word for a run, the strongest reason against a claim first; clean is only a complete run that found nothing."""
    tests = (("failed", run.failed), ("cancelled", run.cancelled), ("expired", run.expired), ("blocked", run.blocked > 0), ("manifest-incomplete", not run.manifest_complete))
    found = next((name for name, holds in tests if holds), None)
    if found or run.examined == 0:
        return found or "incomplete"
    if not run.fenced:
        return "manifest-complete"
    if run.truncated:
        return "truncated"
    return "clean" if run.findings == 0 else "complete"


def outcome_of(run: Mapping[str, Column]) -> Column:
    """`outcome` for many runs at once: columns by the names of Run's fields; those that are not given have its defaults."""
    of = lambda name: run.get(name, F.lit(getattr(Run(), name)))
    tests = (("failed", of("failed")), ("cancelled", of("cancelled")), ("expired", of("expired")), ("blocked", of("blocked") > 0), ("manifest-incomplete", ~of("manifest_complete")))
    tests += (("incomplete", of("examined") == 0), ("manifest-complete", ~of("fenced")), ("truncated", of("truncated")), ("clean", of("findings") == 0))
    return F.coalesce(*[F.when(test, name) for name, test in tests], F.lit("complete"))


ITEMS = f"{PLACE}, rule int, type string, field string, reason string, value string"


def _first_of_each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of a key once two records hold it: those that waited, and all that come after. The state is the rows of one record at most."""
    record, waiting, shared = state.get if state.exists else (None, "[]", False)
    for part in parts:
        rows = part[list(WAITING)]
        if not shared:
            names = set(rows["_record"]) | ({record} if record is not None else set())
            waits = json.loads(waiting)
            if len(names) < 2:
                record, waiting = next(iter(names)), json.dumps(waits + json.loads(rows.to_json(orient="values")))
                continue
            shared, waiting = True, "[]"
            rows = pd.concat([pd.DataFrame(waits, columns=WAITING).astype(rows.dtypes.to_dict()), rows]) if waits else rows
        yield rows
    state.update((record, waiting, shared))


WAITING = ("_record", "_event", "_instance", "_form", "_dag", "rule", "type", "field", "reason", "value")


def unique_stream(stream: DataFrame, rules: list[Rule], dictionary: Dictionary, events: Events | None = None) -> DataFrame:
    """Findings of uniqueness over a stream of contexts, each of which comes once: as soon as a second record has a key, the findings of all its rows
    so far are given, and afterwards that of each row that comes. State is kept by (rule, field, key): the rows of the first record, until there is a second."""
    items = candidates(stream, rules, dictionary, events)
    problems = items.where("type = 'problem'").select(*WAITING)
    keyed = items.where("type = 'unique'").withColumn("key", F.to_json("key")).select(*WAITING, "key")
    found = keyed.groupBy("rule", "field", "key").applyInPandasWithState(_first_of_each, ITEMS, "record string, waiting string, shared boolean", "append", "NoTimeout")
    return found.unionByName(problems)


def watch(stream: DataFrame, rules: list[Rule], dictionary: Dictionary, sink: Callable[[DataFrame, int], None], checkpoint: str, events: Events | None = None) -> StreamingQuery:
    """All rules over a stream of contexts; the items (findings, and problems as type 'problem') that a batch gives go to the sink, which may get a batch
    again after a failure and then replaces it. With events, rules are judged where their fields live. All batches together give what a scan of all contexts gives."""
    if events is not None and events.forms:
        stream = with_states(stream, {f: dictionary.forms[f] for f in read_set(rules) if dictionary.forms.get(f)}, events.forms, set(events.repeating))
    live = [r for r in rules if not r.dropped]
    parts = [row_local(stream, rules, dictionary, events)] if any(r.type != "unique" or r.error for r in live) else []
    parts += [unique_stream(stream, rules, dictionary, events)] if any(r.type == "unique" and not r.error for r in live) else []
    if not parts:
        raise ValueError("no rule to watch for")
    items = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return items.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
