"""The condition dialect of rules: [field] and [field(code)] references, quoted strings, numbers, comparisons, and/or/not.

A condition becomes a small tree and the tree a boolean column that is never null, which Catalyst then optimizes with the
rest of the plan. A missing value reads '', a missing checkbox code '0', and a checkbox without a code ''.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwarden.functions.comparison import SHORT, Named, compare, compare_sql, quoted

#: Bounds of a condition: characters, references and depth.
MOST_CHARACTERS, MOST_REFERENCES, MOST_DEPTH = 500, 20, 10


class ConditionError(ValueError):
    """A condition that can't be read or doesn't fit the dictionary."""


@dataclass(frozen=True)
class Ref:
    field: str
    code: str | None = None


@dataclass(frozen=True)
class Literal:
    value: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: Ref | Literal
    right: Ref | Literal


@dataclass(frozen=True)
class Not:
    item: Node


@dataclass(frozen=True)
class Group:
    """All of the items, or any of them."""

    every: bool
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Constant:
    value: bool


Node = Compare | Not | Group | Constant

TOKEN = re.compile(r"\s*(?:\[(?P<field>[a-z_][a-z0-9_]*)(?:\((?P<code>[^()\[\]]*)\))?\]|(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>-?[0-9]+(?:\.[0-9]+)?)(?![\w.])|(?P<op><>|!=|>=|<=|[=<>])|(?P<mark>[()])|(?P<word>[a-z_]\w*))", re.IGNORECASE)


def parse(text: str) -> Node:
    """The tree of a condition; ConditionError says why there is none."""
    if len(text) > MOST_CHARACTERS:
        raise ConditionError(f"the condition has more than {MOST_CHARACTERS} characters")
    if re.search(r"[^\x20-\x7E\t\r\n]", text):
        raise ConditionError("the condition has characters outside printable ASCII")
    tokens, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"unexpected text at {text[at:].strip()[:20]!r}")
        tokens.append(m)
        at = m.end()
    for m, following in zip(tokens, [*tokens[1:], None][: len(tokens)], strict=True):
        if m["word"] and m["word"].lower() not in ("and", "or", "not"):
            if following is not None and following["mark"] == "(":
                raise ConditionError(f"functions are not available: {m['word']}()")
            raise ConditionError(f"unexpected word {m['word']!r}: text needs quotes and a field brackets")
        if m["field"] and following is not None and following["field"]:
            raise ConditionError("references to another event are not available: [event][field]")
    tokens.append(None)
    place = 0

    def peek() -> str:
        m = tokens[place]
        return "" if m is None else (m["word"] or "").lower() or m["mark"] or m["op"] or "operand"

    def take() -> re.Match:
        nonlocal place
        place += 1
        if tokens[place - 1] is None:
            raise ConditionError("the condition ends too early")
        return tokens[place - 1]

    def operand() -> Ref | Literal:
        m = take()
        if m["field"]:
            return Ref(m["field"].lower(), None if m["code"] is None else m["code"].strip())
        if m["text"] is not None:
            return Literal(m["text"][1:-1])
        if m["number"]:
            return Literal(m["number"])
        raise ConditionError(f"a field, a text or a number is wanted at {m[0].strip()!r}")

    def series(word: str, item: Callable, every: bool, depth: int) -> Node:
        items = [item(depth)]
        while peek() == word:
            take()
            items.append(item(depth))
        return items[0] if len(items) == 1 else Group(every, tuple(items))

    def either(depth: int) -> Node:
        if depth > MOST_DEPTH:
            raise ConditionError(f"the condition is nested deeper than {MOST_DEPTH}")
        return series("or", both, False, depth)

    def both(depth: int) -> Node:
        return series("and", negated, True, depth)

    def negated(depth: int) -> Node:
        if depth > MOST_DEPTH:
            raise ConditionError(f"the condition is nested deeper than {MOST_DEPTH}")
        if peek() == "not":
            take()
            return Not(negated(depth + 1))
        if peek() == "(":
            take()
            inner = either(depth + 1)
            if peek() != ")":
                raise ConditionError("a closing parenthesis is missing")
            take()
            return inner
        left = operand()
        if peek() not in ("=", "<>", "!=", ">", "<", ">=", "<="):
            raise ConditionError("a comparison is wanted after a value")
        op = take()["op"]
        return Compare("<>" if op == "!=" else op, left, operand())

    if peek() == "":
        raise ConditionError("the condition is empty")
    tree = either(0)
    if tokens[place] is not None:
        raise ConditionError(f"unexpected text at {tokens[place][0].strip()!r}")
    if len([1 for m in tokens if m is not None and m["field"]]) > MOST_REFERENCES:
        raise ConditionError(f"the condition has more than {MOST_REFERENCES} references")
    return tree


def references(tree: Node) -> list[Ref]:
    """The references of a tree, each once, in order of first appearance: what a plan has to read."""
    if isinstance(tree, Compare):
        found = [x for x in (tree.left, tree.right) if isinstance(x, Ref)]
    elif isinstance(tree, Not):
        found = references(tree.item)
    elif isinstance(tree, Group):
        found = [r for x in tree.items for r in references(x)]
    else:
        found = []
    return list(dict.fromkeys(found))


def check_references(tree: Node, types: Mapping[str, str], codes: Mapping[str, list[str]]) -> list[str]:
    """What is wrong with a tree's references by the dictionary's field types and choice codes."""
    wrong = []
    for r in references(tree):
        kind = types.get(r.field)
        if kind is None:
            wrong.append(f"field [{r.field}] does not exist")
        elif kind in ("file", "descriptive"):
            wrong.append(f"field [{r.field}] is a {kind} field and has no value to compare")
        elif kind == "checkbox" and r.code is None:
            wrong.append(f"checkbox [{r.field}] needs a choice code: [{r.field}(code)]")
        elif kind == "checkbox" and r.code not in codes.get(r.field, []):
            wrong.append(f"checkbox [{r.field}] has no choice {r.code}")
        elif kind != "checkbox" and r.code is not None:
            wrong.append(f"field [{r.field}] is no checkbox and takes no choice code")
    return wrong


def value_of(ref: Ref | Literal, columns: Mapping[str, Column], checkboxes: frozenset[str] | set[str] = frozenset()) -> Column:
    if isinstance(ref, Literal):
        return F.lit(ref.value)
    if ref.field not in columns:
        return F.lit("0" if ref.code is not None else "")
    if ref.field in checkboxes:
        return F.lit("") if ref.code is None else F.when(F.coalesce(columns[ref.field][ref.code], F.lit("")) == "1", "1").otherwise("0")
    return F.lit("0") if ref.code is not None else F.coalesce(columns[ref.field].cast("string"), F.lit(""))


def value_sql(ref: Ref, columns: set[str], checkboxes: frozenset[str] | set[str] = frozenset()) -> str:
    """`value_of` as SQL over columns of the fields' names."""
    if ref.field not in columns:
        return "'0'" if ref.code is not None else "''"
    if ref.field in checkboxes:
        return "''" if ref.code is None else f"CASE WHEN `{ref.field}`[{quoted(ref.code)}] = '1' THEN '1' ELSE '0' END"
    return "'0'" if ref.code is not None else f"coalesce(CAST(`{ref.field}` AS string), '')"


def full_keys(tree: Node) -> set[Ref]:
    """The references that are compared with another one, or with a number that no double tells apart."""
    if isinstance(tree, Compare):
        two = [tree.left, tree.right]
        return {x for x in two if isinstance(x, Ref)} if not any(isinstance(x, Literal) and len(x.value.strip()) <= SHORT for x in two) else set()
    items = [tree.item] if isinstance(tree, Not) else tree.items if isinstance(tree, Group) else ()
    return set().union(*(full_keys(x) for x in items))


def to_column(tree: Node, columns: Mapping[str, Column], checkboxes: frozenset[str] | set[str] = frozenset()) -> Column:
    """The tree as a boolean column over the columns of the fields."""
    if isinstance(tree, Constant):
        return F.lit(tree.value)
    if isinstance(tree, Not):
        return ~to_column(tree.item, columns, checkboxes)
    if isinstance(tree, Group):
        parts = [to_column(x, columns, checkboxes) for x in tree.items]
        return reduce(lambda a, b: a & b if tree.every else a | b, parts)
    return compare(tree.op, *[x.value if isinstance(x, Literal) else value_of(x, columns, checkboxes) for x in (tree.left, tree.right)])


def to_sql(tree: Node, forms: Mapping[Ref, Named]) -> str:
    """The tree as SQL over the forms of its references."""
    if isinstance(tree, Constant):
        return str(tree.value).lower()
    if isinstance(tree, Not):
        return f"(NOT {to_sql(tree.item, forms)})"
    if isinstance(tree, Group):
        return "(" + (" AND " if tree.every else " OR ").join(to_sql(x, forms) for x in tree.items) + ")"
    return compare_sql(tree.op, *[x.value if isinstance(x, Literal) else forms[x] for x in (tree.left, tree.right)])


@dataclass(frozen=True)
class Folded:
    """A tree with what is off the page filled in, and what that means for how it may be used."""

    tree: Node
    snapshot: bool = False  # holds values that were read when the page was made
    frozen: bool = False  # a comparison could not be kept live
    blocked: bool = False  # a value could not be read


def fold(tree: Node, live: set[str], known: Mapping[Ref, str | None], disclosable: set[str], truth: Callable[[Compare], bool]) -> Folded:
    """Partial evaluation: comparisons of live fields stay; others become literals if their value may be shown, else constants.

    known: values of the fields that are not live, None for one that can't be read; truth: what a comparison is on the saved values.
    """
    if isinstance(tree, Constant):
        return Folded(tree)
    if isinstance(tree, Not):
        x = fold(tree.item, live, known, disclosable, truth)
        return Folded(Not(x.tree), x.snapshot, x.frozen, x.blocked)
    if isinstance(tree, Group):
        parts = [fold(x, live, known, disclosable, truth) for x in tree.items]
        return Folded(Group(tree.every, tuple(p.tree for p in parts)), *(any(getattr(p, n) for p in parts) for n in ("snapshot", "frozen", "blocked")))
    away = [r for r in references(tree) if r.field not in live]
    if not away:
        return Folded(tree)
    if any(known.get(r) is None for r in away):
        return Folded(Constant(False), frozen=True, blocked=True)
    if len(away) == len(references(tree)):
        return Folded(Constant(truth(tree)), snapshot=True)
    if any(r.field not in disclosable for r in away):
        return Folded(Constant(truth(tree)), frozen=True)
    shown = lambda x: Literal(known[x]) if x in away else x
    return Folded(Compare(tree.op, shown(tree.left), shown(tree.right)), snapshot=True)
