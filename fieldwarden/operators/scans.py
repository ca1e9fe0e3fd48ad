"""A whole scan: from rows in wide form to findings, rule problems, statistics and the one word for what the run may claim."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.operators import access
from fieldwarden.operators import contexts as C
from fieldwarden.operators import rules as R
from fieldwarden.session import with_checkpoint_dir
from fieldwarden.streaming import changes


@dataclass(frozen=True)
class Scan:
    findings: DataFrame
    problems: DataFrame  # rule, field, why
    records: int
    contexts: int
    outcome: str


def after_save(rows: DataFrame, rules: list[R.Rule], dictionary: R.Dictionary, events: C.Events | None, record: str, form: str, rights: access.Rights = True) -> Scan:
    """What a save of one record's form asks to judge again: the rules on that form and those on others whose conditions read it. Uniqueness
    is judged among all records and not of one; `access.is_used` answers for that."""
    asked = set(access.dependents(rules, dictionary, form))
    here = access.on_form(rules, dictionary, form)
    due = [r if k in asked else h for k, (r, h) in enumerate(zip(rules, here, strict=True), 1)]
    return run_scan(rows, [access.dropped(r) if r.type == "unique" else r for r in due], dictionary, events, record=record, rights=rights)


def run_scan(rows: DataFrame, rules: list[R.Rule], dictionary: R.Dictionary, events: C.Events | None = None, group: str | None = None, record: str | None = None, rights: access.Rights = True, form: str | None = None) -> Scan:
    """Scans rows (record, event_id, repeat_key, instance, dag and fields), of one group or one record if given, by the rules that the
    reader's rights and the group allow; a rule that they don't is a problem. With a form, only the fields on it are judged.

    Only the fields that rules name are read. The items of all rules are written once to the checkpoint folder, so that findings, problems
    and counts are of one pass. A rule problem keeps a run from being clean.
    """
    spark = with_checkpoint_dir(rows.sparkSession)
    rules, barred = access.readable(rules, dictionary, rights)
    rules, wide = access.confined(rules, group)
    rules = rules if form is None else access.on_form(rules, dictionary, form)
    fields = [f for f in R.read_set(rules) if f in rows.columns]
    rows = rows if record is None else rows.where(F.col("record") == record)
    found = changes.in_scope(C.contexts(rows, fields), group)
    if events is not None and events.forms:
        found = C.with_states(found, {f: dictionary.forms[f] for f in R.read_set(rules) if dictionary.forms.get(f)}, events.forms, set(events.repeating))
    items = R.row_local(found, rules, dictionary, events).unionByName(R.unique(found, rules, dictionary, events)).checkpoint()
    findings = items.where("type <> 'problem'")
    problems = items.where("type = 'problem'").select("rule", "field", F.col("reason").alias("why")).distinct().unionByName(spark.createDataFrame(barred + wide, "rule int, field string, why string"))
    seen = found.agg(F.countDistinct("_record").alias("records"), F.count("*").alias("contexts")).first()
    run = changes.Run(examined=seen.records, findings=findings.count(), blocked=problems.count())
    return Scan(findings, problems, seen.records, seen.contexts, changes.outcome(run))
