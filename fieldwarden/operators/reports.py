"""Reports of findings: identity, labels, wording, value policy, and rows for a file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fieldwarden.functions import text
from fieldwarden.operators.rules import META

# Wording by kind of check and reason, for data managers.
WORDING = {
    "required/required-blank": "This field must not be left blank.",
    "unique/duplicate-value": "This value is already recorded on another record.",
    "choices/hidden-choice": "The saved answer is no longer one of the available choices for this field.",
    "constraint/assert": "The value does not satisfy this rule's condition.",
    "single/format": "The value does not match the format this field requires.",
    "single/check-character": "The format is right but the check character does not match, so one character is mistyped.",
    "pooled/no-id": "No recognisable ID could be found in this field.",
    "pooled/junk": "This field contains text that is not a recognisable ID.",
    "pooled/duplicate": "The same ID appears more than once in this field.",
    "pooled/count": "This field does not hold the expected number of IDs.",
    "single/*": "This value failed the ID check configured for the field.",
    "pooled/*": "One or more IDs in this field are not valid.",
    "*/*": 'Rule {rule} reported "{reason}" for this value. No wording is configured for this kind of finding.',
}


def wording(kind: Column, reason: Column, rule: Column, messages: Mapping[int, str] | None = None) -> Column:
    """A rule's own message, else the wording of kind and code, of the kind, or of any finding."""
    code = text.reason_code(reason)
    table = F.create_map(*[F.lit(x) for pair in WORDING.items() for x in pair])
    general = F.replace(F.replace(F.lit(WORDING["*/*"]), F.lit("{rule}"), rule.cast("string")), F.lit("{reason}"), reason)
    found = F.coalesce(table[F.concat(kind, F.lit("/"), code)], table[F.concat(kind, F.lit("/*"))], general)
    if messages:
        found = F.coalesce(F.create_map(*[F.lit(x) for pair in messages.items() for x in pair])[rule], found)
    return found


def identified(findings: DataFrame, key: bytes, project: int) -> DataFrame:
    """Adds `finding`, a keyed hash of where a finding is, its rule and its reason's code. The value is no part of it, so an edit keeps the identity."""
    parts = [*(F.col(c).cast("string") for c in ("_record", "_event", "_instance", "_form", "field", "rule")), text.reason_code(F.col("reason"))]
    where = F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts])
    return findings.withColumn("finding", text.purpose_hash(key, "finding", project, where))


def report(
    findings: DataFrame, mode: str = "locations", identifiers: frozenset[str] | set[str] = frozenset(), event_labels: Mapping[str, str] | None = None,
    field_labels: Mapping[str, str] | None = None, rule_labels: Mapping[int, str] | None = None, messages: Mapping[int, str] | None = None,
) -> DataFrame:
    """The report's columns. Labels are the dictionary's, as maps in the plan; an id without a label stands for itself."""

    def label(column: Column, names: Mapping | None) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[column], column.cast("string")) if names else column.cast("string")

    out = [
        text.issue(F.col("type")).alias("issue"), F.col("_record").alias("record"), F.col("_dag").alias("dag"), label(F.col("_event"), event_labels).alias("event"), F.col("_form").alias("instrument"),
        F.col("_instance").alias("instance"), "field", label(F.col("field"), field_labels).alias("field_label"), text.shown_value(F.col("value"), mode, F.col("field").isin(list(identifiers))).alias("value"),
        F.col("type").alias("check"), text.reason_code(F.col("reason")).alias("reason"), "rule", label(F.col("rule"), rule_labels).alias("rule_label"),
        F.when(F.col("reason").startswith("assert:"), F.concat(F.lit("Must hold: "), F.substr("reason", F.lit(8)))).alias("problem"), wording(F.col("type"), F.col("reason"), F.col("rule"), messages).alias("wording"),
    ]
    return findings.select(*out)


def log_rows(findings: DataFrame, mode: str, key: bytes | None, project: int) -> DataFrame:
    """Audit rows: the value as a keyed hash, with mode 'none' as nothing, with 'raw' as it is; with mode 'none' the record is hashed too. Without a key what would be hashed is left out."""
    record = text.identifier_hash(key, project, F.col("_record")) if mode == "none" else F.col("_record")
    value = {"raw": F.col("value"), "none": F.lit(None).cast("string")}.get(mode, text.identifier_hash(key, project, F.col("value")))
    rows = findings.select(F.lit("invalid-id-saved").alias("message"), record.alias("record"), *META[1:4], "field", "type", "reason", value.alias("value"))
    return rows.limit(0) if mode == "off" else rows


def active(findings: DataFrame, form: str | None = None, reason: str | None = None, group: str | None = None, kind: str | None = None) -> DataFrame:
    """Findings by report filter. Form, group and kind are compared as they are stored, so that a scan gets them as filters; a reason by its code, which is computed."""
    for column, wanted in (("_form", form), ("_dag", group), ("type", kind)):
        findings = findings if wanted is None else findings.where(F.col(column) == wanted)
    return findings if reason is None else findings.where(text.reason_code(F.col("reason")) == reason)


#: The order in which findings are read page by page; no two findings of one scan agree in all of it.
READ_ORDER = ("_record", "_event", "_instance", "_form", "rule", "field", "reason", "value")


def page(findings: DataFrame, after: Row | None, size: int) -> DataFrame:
    """The next `size` findings (5,000 at most) behind one that was read, in READ_ORDER with nulls first: a filter and a limited sort, never an offset."""
    if after is not None:
        behind, tied = F.lit(False), F.lit(True)
        for c in READ_ORDER:
            last = F.lit(after[c])
            behind |= tied & (F.col(c).isNotNull() if after[c] is None else F.coalesce(F.col(c) > last, F.lit(False)))
            tied &= F.col(c).eqNullSafe(last)
        findings = findings.where(behind)
    return findings.orderBy(*READ_ORDER).limit(max(1, min(size, 5000)))


# What a person reads above each column of a report; the file's header has the keys, which programs rely on.
LABELS = {
    "issue": "Kind of issue", "record": "Record", "dag": "Group", "event": "Event", "instrument": "Form", "instance": "Instance", "field": "Field", "field_label": "Field's label", "value": "Saved value",
    "check": "Check", "reason": "Reason", "rule": "Rule number", "rule_label": "Rule", "problem": "Condition", "wording": "What to do",
}


def legend(columns: list[str]) -> str:
    """The comment line of a report file: `key=label` of each column; a column without a label stands for itself."""
    return "# columns: " + ", ".join(f"{c}={LABELS.get(c, c)}" for c in columns)


def expire_values(findings: DataFrame, before: Column) -> DataFrame:
    """Findings found before a time lose their value, never their row."""
    return findings.withColumn("value", F.when(F.col("found_at") < before, None).otherwise(F.col("value")))
