"""Contexts from records: base rows, and repeat instances laid over the base row of their event."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_long(cells: DataFrame, fields: list[str], checkboxes: set[str] = frozenset()) -> DataFrame:
    """Wide rows of a long table (record, event_id, repeat_key, instance, field, value, code, dag), with the given fields only.

    repeat_key is null for a base row, '' for an instance of a repeating event, a form's name for an instance of that form.
    """
    wanted = cells.where(F.col("field").isin(fields) | F.col("field").isNull())
    filled = F.nullif("value", F.lit(""))

    def of(name: str) -> Column:
        mine = F.col("field") == name
        if name in checkboxes:
            entries = F.collect_set(F.when(mine & F.col("code").isNotNull(), F.struct("code", "value")))
            return F.map_from_entries(entries).alias(name)
        return F.max(F.when(mine, filled)).alias(name)

    keys = ["record", "event_id", "repeat_key", "instance"]
    return wanted.groupBy(*keys).agg(F.max("dag").alias("dag"), *[of(f) for f in fields])


def contexts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each base row and each repeat instance: an instance's blanks are filled from its event's base row.

    The records' groups come first: a record's group is the first one that any of its rows has, by event, form and instance.
    """
    clean = lambda c: F.nullif(F.col(c), F.lit("")) if dict(rows.dtypes)[c] == "string" else F.col(c)
    rows = rows.select("record", "event_id", "repeat_key", F.coalesce("instance", F.lit(1)).alias("instance"), "dag", *[clean(f).alias(f) for f in fields])
    groups = rows.where("dag is not null and dag <> ''").groupBy("record").agg(F.min_by("dag", F.struct("event_id", F.coalesce("repeat_key", F.lit("")), "instance", "dag")).alias("_group"))
    base, repeat = rows.where("repeat_key is null"), rows.where("repeat_key is not null").alias("r")
    under = base.select("record", "event_id", *[F.col(f).alias(f"_base_{f}") for f in fields])
    over = repeat.join(under, ["record", "event_id"], "left").select("record", "event_id", "repeat_key", "instance", *[F.coalesce(F.col(f"r.{f}"), F.col(f"_base_{f}")).alias(f) for f in fields])
    both = base.select("record", "event_id", "repeat_key", "instance", *fields).unionByName(over).join(groups, "record", "left")
    place = [F.col("record").cast("string").alias("_record"), F.col("event_id").cast("string").alias("_event"), F.col("instance").cast("int").alias("_instance")]
    return both.select(*place, F.col("repeat_key").alias("_form"), F.col("_group").alias("_dag"), *fields)


@dataclass(frozen=True)
class Events:
    """What a project's metadata say of its events: the forms of each (an event without an entry has all of them), and what repeats."""

    forms: Mapping[str, set[str]] = field(default_factory=dict)
    repeating: frozenset[tuple[str, str]] | set[tuple[str, str]] = frozenset()  # (event, form)
    repeating_events: frozenset[str] | set[str] = frozenset()


def hosted(form: str, events: Events) -> Column:
    """Whether a form's fields live in a context: the instances of a repeating event or form, else the base row, where the event has the form."""
    without = [e for e, forms in events.forms.items() if form not in forms]
    own = [e for e, f in events.repeating if f == form]
    lives = F.when(F.col("_event").isin(list(events.repeating_events)), F.col("_form").eqNullSafe(F.lit(""))).when(F.col("_event").isin(own), F.col("_form").eqNullSafe(F.lit(form)))
    return lives.otherwise(F.col("_form").isNull()) & ~F.col("_event").isin(without)


def host_rows(found: DataFrame, form: str, event_forms: Mapping[str, set[str]], repeating: set[tuple[str, str]], repeating_events: set[str] = frozenset()) -> DataFrame:
    """The contexts in which a form's fields live."""
    return found.where(F.col("_event").isin(list(event_forms)) & hosted(form, Events(event_forms, repeating, repeating_events)))


def with_states(found: DataFrame, forms: Mapping[str, str], event_forms: Mapping[str, set[str]], repeating: set[tuple[str, str]]) -> DataFrame:
    """Adds _states: fields that are not collected in a context's event, or that repeat on another form. Known from metadata alone."""
    entries = []
    for name, form in forms.items():
        has = [e for e, own in event_forms.items() if form in own]
        many = [e for e, f in repeating if f == form]
        state = F.when(~F.col("_event").isin(has), "missing") if has else F.lit("missing")
        if has:
            state = state.when(F.col("_event").isin(many) & (F.coalesce("_form", F.lit("")) != form), "ambiguous") if many else state
        entries.append(F.struct(F.lit(name).alias("key"), state.alias("value")))
    if not entries:
        return found.withColumn("_states", F.create_map().cast("map<string,string>"))
    states = F.map_from_entries(F.filter(F.array(*entries), lambda x: x["value"].isNotNull()))
    return found.withColumn("_states", states)
