"""What a page of one form gets of the rules: conditions with everything that is not on the page filled in, from one read of the record's context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions import conditions
from fieldwarden.operators import access
from fieldwarden.operators import rules as R


@dataclass(frozen=True)
class Page:
    """rules: those with a field on the form; folded: the tree of each distinct condition; notes: rule, field-free remarks on how far a page may trust it."""

    rules: list[R.Rule]
    folded: dict[str, conditions.Folded]
    notes: list[tuple[int, str]]


def comparisons(tree: conditions.Node) -> Iterator[conditions.Compare]:
    if isinstance(tree, conditions.Compare):
        yield tree
    for item in [tree.item] if isinstance(tree, conditions.Not) else tree.items if isinstance(tree, conditions.Group) else ():
        yield from comparisons(item)


def fold_rules(
    contexts: DataFrame, rules: list[R.Rule], dictionary: R.Dictionary, form: str, record: str | None, event: str | None = None, instance: int = 1, rights: access.Rights = True, data_entry: bool = True,
) -> Page:
    """Folds each distinct condition of the form's rules once. All saved values and all comparisons of fields that are not on the form come from one
    read of one context: the instance of the form, else its event's base row. A new record has no values, which read as blanks; a record without such a context,
    and a checkbox or field that the contexts don't have, can't be read, so that what depends on it is blocked.

    A value leaves for the page only as a literal of a form that the reader may see; else a comparison leaves as true or false.
    """
    here = access.on_form(rules, dictionary, form)
    live = {f for f, own in dictionary.forms.items() if own == form}
    trees: dict[str, conditions.Node] = {}
    for text in dict.fromkeys(t for r in here if not r.dropped and not r.error for t in R.texts(r)):
        try:
            trees[text] = conditions.parse(text)
        except conditions.ConditionError:
            pass  # the rule gets a problem row of its own
    away = list(dict.fromkeys(x for t in trees.values() for x in conditions.references(t) if x.field not in live))
    asked = list(dict.fromkeys(c for t in trees.values() for c in comparisons(t) if any(x in away for x in conditions.references(c))))
    columns = {x.field: F.col(f"`{x.field}`") for t in trees.values() for x in conditions.references(t) if x.field in contexts.columns}

    def wanted(known: dict[str, Column]) -> list[Column]:
        values = [conditions.value_of(x, known, dictionary.checkboxes) if record is None or x.field in known else F.lit(None).cast("string") for x in away]
        return [F.array(*values).alias("values"), F.array(*[conditions.to_column(c, known, dictionary.checkboxes) for c in asked]).alias("truths")]

    row = None
    if away and record is None:
        row = contexts.sparkSession.range(1).select(*wanted({})).first()
    elif away:
        own = F.col("_form").eqNullSafe(F.lit(form)) & (F.col("_instance") == instance)
        at = contexts.where((F.col("_record") == record) & (F.lit(event is None) | F.col("_event").eqNullSafe(F.lit(event))) & (own | F.col("_form").isNull()))
        row = at.orderBy(own.desc()).limit(1).select(*wanted(columns)).first()
    known = dict(zip(away, row["values"] if row else [None] * len(away), strict=True))
    truths = dict(zip(asked, row["truths"] if row else [False] * len(asked), strict=True))
    shown = set(access.disclosable([x.field for x in away], dictionary, rights, form, data_entry))
    folded = {t: conditions.fold(tree, live, known, shown, truths.__getitem__) for t, tree in trees.items()}
    notes = []
    for k, r in enumerate(here, 1):
        own = [folded[t] for t in R.texts(r) if t in folded] if not r.dropped and not r.error else []
        if any(x.blocked for x in own):
            notes.append((k, "a value that the condition reads could not be read, so the rule is judged after saving"))
        elif any(x.frozen for x in own):
            notes.append((k, "the condition compares a field of this page with one that may not be shown; it is judged anew after saving"))
        elif any(x.snapshot for x in own):
            notes.append((k, "the condition reads values as they were when the page was made"))
    return Page(here, folded, notes)
