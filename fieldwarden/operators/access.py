"""Which rules and fields a reader, a form or a group may see. Rules are dropped before a scan, never findings after it.

Rights map a form to its level: '0' bars it, as does a form without an entry. True stands for every form; None, rights that could not be
read, clears none.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions import conditions
from fieldwarden.operators import contexts as C
from fieldwarden.operators import rules as R

Rights = Mapping[str, str] | bool | None
SEVERITIES = ("off", "confirm", "hard")
MOST_VALUES, MOST_BYTES = 8, 1024


def may_read(rights: Rights, form: str) -> bool:
    return rights is True or isinstance(rights, Mapping) and str(rights.get(form, "0")) != "0"


def condition_fields(rule: R.Rule) -> set[str]:
    """The fields that a rule's conditions read; a condition that can't be parsed reads none."""
    out: set[str] = set()
    for text in R.texts(rule):
        try:
            out |= {x.field for x in conditions.references(conditions.parse(text))}
        except conditions.ConditionError:
            pass  # the rule gets a problem row of its own
    return out


def on_form(rules: list[R.Rule], dictionary: R.Dictionary, form: str) -> list[R.Rule]:
    """The rules with a field on a form, with those fields only; rules that can't be configured stay, at their ordinals."""
    keep = lambda r: r if r.error else replace(r, fields=tuple(f for f in r.fields if dictionary.forms.get(f) == form))
    return [k if k.fields or k.error else dropped(k) for k in map(keep, rules)]


def dropped(rule: R.Rule) -> R.Rule:
    """A rule that is applied nowhere and holds its place, so that the ordinals of the others stay."""
    return replace(rule, type="required", fields=("",), when="", asserts="", branches=(), error="", dropped=True)


def readable(rules: list[R.Rule], dictionary: R.Dictionary, rights: Rights) -> tuple[list[R.Rule], list[tuple[int, str, str]]]:
    """The rules as a reader may run them, and problems (rule, field, why).

    A barred form that a condition reads drops the whole rule, as its verdict would tell of it. A barred form of some of the rule's own
    fields drops these fields only.
    """
    out, problems = [], []
    for k, r in enumerate(rules, 1):
        forms = lambda names: {dictionary.forms[f] for f in names if dictionary.forms.get(f)}
        if r.error:
            out.append(r)
            continue
        read = condition_fields(r) | set(r.unique_with) | {w for b in r.branches for w in b.get("unique_with", ())}
        barred = sorted(f for f in forms(read - set(r.fields)) if not may_read(rights, f))
        kept = () if barred else tuple(f for f in r.fields if not dictionary.forms.get(f) or may_read(rights, dictionary.forms[f]))
        if len(kept) == len(r.fields):
            out.append(r)
            continue
        if rights is None:
            why = "the reader's rights could not be read, so the rule was not evaluated"
        elif barred:
            why = f"a condition reads {', '.join(barred)}, which the reader may not see, so the rule was not evaluated"
        else:
            hosts = ", ".join(sorted(forms(set(r.fields) - set(kept))))
            why = f"the reader may not see {hosts}, so the rule was not evaluated there"
        problems += [(k, f, why) for f in r.fields if f not in kept]
        out.append(replace(r, fields=kept) if kept else dropped(r))
    return out, problems


def confined(rules: list[R.Rule], group: str | None) -> tuple[list[R.Rule], list[tuple[int, str, str]]]:
    """Without rules that a scan of one group can't judge: uniqueness across the project. They become problems."""
    whole = lambda r: group is not None and not r.error and r.type == "unique" and "project" in {r.scope, *(b.get("scope", r.scope) for b in r.branches)}
    why = "a duplicate in another group can't be seen from a scan of one group, so the rule was not evaluated"
    return [dropped(r) if whole(r) else r for r in rules], [(k, f, why) for k, r in enumerate(rules, 1) if whole(r) for f in r.fields]


def dependents(rules: list[R.Rule], dictionary: R.Dictionary, form: str) -> list[int]:
    """Ordinals of the rules that live on other forms and whose conditions read this one: what a change of the form asks to check again."""
    here = {f for f, own in dictionary.forms.items() if own == form}
    return [k for k, r in enumerate(rules, 1) if not r.error and not here & set(r.fields) and here & condition_fields(r)]


def disclosable(names: list[str], dictionary: R.Dictionary, rights: Rights, form: str | None = None, data_entry: bool = True) -> list[str]:
    """Fields whose saved values may be sent to a page of a form: known fields of other forms that the reader may see; none to a survey."""
    where = dictionary.forms
    return [f for f in names if data_entry and where.get(f) and where[f] != form and may_read(rights, where[f])]


def severity(rule: R.Rule, dictionary: R.Dictionary, form: str | None = None) -> str:
    """off, confirm or hard. A rule that reads a field of another form never blocks, as what it read may have changed since."""
    own = {dictionary.forms.get(f) for f in rule.fields} if form is None else {form}
    elsewhere = any(dictionary.forms.get(f) not in own for f in condition_fields(rule))
    return "off" if rule.error or elsewhere or rule.block not in SEVERITIES else rule.block


def with_severity(findings: DataFrame, rules: list[R.Rule], dictionary: R.Dictionary) -> DataFrame:
    """Adds `severity`: whether a finding would hold back a save."""
    levels = [F.lit(x) for k, r in enumerate(rules, 1) for x in (k, severity(r, dictionary))]
    level = F.coalesce(F.create_map(*levels)[F.col("rule")], F.lit("off")) if levels else F.lit("off")
    return findings.withColumn("severity", level)


def collision(contexts: DataFrame, rule: R.Rule, name: str, values: Mapping[str, str], record: str | None, event: str | None = None, group: str | None = None) -> DataFrame:
    """record, dag of at most one other record that holds the same value and the same values beside it. A blank value never collides.

    Values are compared in their trimmed form, so that all rows are read; `incremental.UniqueState.holders` reads the stored keys of one value only.
    """
    trim = lambda f: F.btrim(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")), F.lit(R.BLANK))
    said = lambda f: (values.get(f) or "").strip(R.BLANK)
    test = F.lit(said(name) != "")
    for f in (name, *rule.unique_with):
        test &= trim(f) == said(f)
    if record is not None:
        test &= F.col("_record") != record
    if rule.scope == "event":
        test &= F.col("_event").eqNullSafe(F.lit(event))
    if rule.scope == "dag":
        test &= F.coalesce("_dag", F.lit("")) == (group or "")
    return contexts.where(test).select(F.col("_record").alias("record"), F.col("_dag").alias("dag")).limit(1)


@dataclass(frozen=True)
class Answer:
    used: bool = False
    record: str | None = None
    error: str = ""


def branch_of(contexts: DataFrame, rule: R.Rule, dictionary: R.Dictionary, record: str | None, event: str | None = None, form: str | None = None, instance: int = 1) -> R.Rule | None:
    """The rule as its one active branch has it, by the saved values of the record's context (none for a new record); without an active branch, as the one without a
    condition has it. None if several are active, none is, or a condition can't be read."""
    if not rule.branches:
        return rule
    try:
        trees = [conditions.parse(b["when"]) if b.get("when") else None for b in rule.branches]
    except conditions.ConditionError:
        return None
    asked = [t for t in trees if t is not None]
    columns = {x.field: F.col(f"`{x.field}`") for t in asked for x in conditions.references(t) if x.field in contexts.columns}
    tests = lambda known: [conditions.to_column(t, known, dictionary.checkboxes).alias(f"_{k}") for k, t in enumerate(asked)]
    row = None
    if record is not None and asked:
        here = F.col("_form").eqNullSafe(F.lit(form)) & (F.col("_instance") == instance)
        own = contexts.where((F.col("_record") == record) & (F.lit(event is None) | F.col("_event").eqNullSafe(F.lit(event))) & (here | F.col("_form").isNull()))
        row = own.orderBy(here.desc()).limit(1).select(*tests(columns)).first()
    if row is None:
        row = contexts.sparkSession.range(1).select(F.lit(0), *tests({})).first()[1:]
    holds = iter(row)
    active = [b for b, t in zip(rule.branches, trees, strict=True) if t is not None and next(holds)]
    chosen = active or [b for b, t in zip(rule.branches, trees, strict=True) if t is None]
    return replace(rule, branches=(), when="", **{k: v for k, v in chosen[0].items() if k != "when"}) if len(active) < 2 and chosen else None


def is_used(
    contexts: DataFrame, rules: list[R.Rule], dictionary: R.Dictionary, name: str, values: Mapping[str, str], record: str | None = None, event: str | None = None,
    group: str | None = None, signed_in: bool = True, survey: bool = False, form: str | None = None, instance: int = 1,
) -> Answer:
    """Whether another record holds a value that must be unique. Of a rule with branches, the one that is active on the saved values says how; if none can be
    told, nothing is answered.

    Only someone signed in, outside of surveys, learns which record, and of a group only that of the own group. Others need a rule that
    opens itself to surveys and holds no identifying field.
    """
    rule = next((r for r in rules if r.type == "unique" and not r.error and name in r.fields), None)
    if rule is None:
        return Answer(error="not a field that must be unique")
    if len(values) > MOST_VALUES or any(len(v.encode()) > MOST_BYTES for v in values.values()):
        return Answer(error="too many or too long values")
    rule = branch_of(contexts, rule, dictionary, record, event, form, instance)
    if rule is None:
        return Answer(error="no single branch of the rule applies")
    if not signed_in and (not rule.surveys or {name, *rule.unique_with} & dictionary.identifiers):
        return Answer(error="not enabled on surveys")
    saved = [f for f in rule.unique_with if f not in values]
    if saved and record is not None:  # fields that the page does not have
        row = contexts.where((F.col("_record") == record) & (F.lit(event is None) | F.col("_event").eqNullSafe(F.lit(event)))).select(*[F.col(f"`{f}`").cast("string").alias(f) for f in saved]).first()
        values = dict(values) | {f: row[f] or "" for f in saved if row}
    hit = collision(contexts, rule, name, values, record, event, group).first()
    if hit is None:
        return Answer()
    named = signed_in and not survey and (group is None or hit.dag == group)
    return Answer(True, hit.record if named else None)


def single(rows: DataFrame, fields: list[str], record: str, event: str, form: str | None = None, instance: int = 1) -> DataFrame:
    """One context of a record, as a row: the instance of a repeating form or event laid over its event's base row, or the base row where
    there is no such instance yet. No other event is looked at."""
    kinds = dict(rows.dtypes)  # literals of the columns' types, so that a scan gets them as filters
    own = rows.where((F.col("record") == F.lit(record).try_cast(kinds["record"])) & (F.col("event_id") == F.lit(event).try_cast(kinds["event_id"])))
    mine: Column = F.col("_form").eqNullSafe(F.lit(form)) & (F.col("_instance") == instance)
    found = C.contexts(own, fields).where(mine | F.col("_form").isNull())
    return found.orderBy(mine.desc()).limit(1)
