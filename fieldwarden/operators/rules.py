"""Rules over contexts: all row-local rules are one projection, all uniqueness keys one aggregation and one join over candidates that are written once.

A context is a row with `_record`, `_event`, `_instance`, `_form`, `_dag` and a column for each field (a string, or a map from
code to '0'/'1' for a checkbox). `_states`, a map from field to 'missing', 'ambiguous' or 'unreadable', is optional.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions import conditions, identifiers, patterns
from fieldwarden.functions.comparison import SPACES, Named, quoted, with_forms
from fieldwarden.operators import pooled
from fieldwarden.operators.contexts import Events, hosted
from fieldwarden.session import with_checkpoint_dir

MODES = {"single": "check", "pooled": "check", "constraint": "constraint", "required": "required", "unique": "unique", "choices": "choices"}
META = ("_record", "_event", "_instance", "_form", "_dag")
PLACE = ", ".join(f"{c} {'int' if c == '_instance' else 'string'}" for c in META)
#: White space of blank values, for all modes but constraints.
BLANK = " \t\n\r\0\x0b"


@dataclass(frozen=True)
class Rule:
    type: str
    fields: tuple[str, ...]
    when: str = ""
    asserts: str = ""
    algorithm: str = identifiers.DEFAULT
    source: str = "normalized_id"
    strip: str = identifiers.STRIP
    pattern: str = ""
    lengths: tuple[int, ...] = ()
    least: int = 8
    most: int = 14
    keep: str = ""
    expected: int | None = None
    unique_with: tuple[str, ...] = ()
    scope: str = "project"
    surveys: bool = False
    show: tuple[str, ...] | None = None
    hide: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    branches: tuple[Mapping, ...] = ()
    block: str = "off"
    message: str = ""
    note: str = ""
    uid: str = ""
    error: str = ""
    dropped: bool = False  # holds its ordinal, is applied nowhere

    @property
    def mode(self) -> str:
        return MODES.get(self.type, "check")

    def hidden(self) -> list[str]:
        """The codes that the rule hides, in the order of all codes."""
        return [c for c in self.codes if c not in self.show] if self.show is not None else [c for c in self.codes if c in self.hide] if self.codes else list(self.hide)


@dataclass(frozen=True)
class Dictionary:
    """A project's fields: the type, form and choice codes of each, and which are identifiers."""

    types: Mapping[str, str]
    forms: Mapping[str, str] = field(default_factory=dict)
    codes: Mapping[str, list[str]] = field(default_factory=dict)
    identifiers: frozenset[str] = frozenset()

    @property
    def checkboxes(self) -> set[str]:
        return {f for f, t in self.types.items() if t == "checkbox"}


def parse_codes(text: str) -> list[str]:
    """'1, Yes | 2, No' -> ['1', '2']."""
    return [p.split(",")[0].strip() for p in text.split("|") if p.strip()]


def texts(rule: Rule) -> list[str]:
    """All conditions of a rule."""
    return [t for t in (rule.when, rule.asserts, *(t for b in rule.branches for t in (b.get("when", ""), b.get("asserts", "")))) if t]


def read_set(rules: list[Rule]) -> list[str]:
    """Every field that the rules need, so that a plan reads no other."""
    out: list[str] = []
    for r in (r for r in rules if not r.dropped):
        out += [*r.fields, *r.unique_with]
        for text in texts(r):
            try:
                out += [x.field for x in conditions.references(conditions.parse(text))]
            except conditions.ConditionError:
                pass  # the rule gets a problem row of its own
        out += [w for b in r.branches for w in b.get("unique_with", ())]
    return list(dict.fromkeys(out))


def duplicate_claims(rules: list[Rule]) -> set[tuple[str, str]]:
    """(mode, field) that more than one live rule claims: none of them is applied there."""
    seen: set[tuple[str, str]] = set()
    twice: set[tuple[str, str]] = set()
    for r in rules:
        for f in r.fields if not r.error and not r.dropped else ():
            (twice if (r.mode, f) in seen else seen).add((r.mode, f))
    return twice


def resolve_branches(rules: list[Rule]) -> list[Rule]:
    """Rules of one mode that share a field become one rule of that field with a branch for each; conflicts are errors."""
    claims: dict[tuple[str, str], list[Rule]] = {}
    for r in rules:
        for f in r.fields if not r.error and not r.dropped and not r.branches else ():
            claims.setdefault((r.mode, f), []).append(r)
    shared = {k: v for k, v in claims.items() if len(v) > 1}
    kept = [replace(r, fields=tuple(f for f in r.fields if r.error or r.branches or (r.mode, f) not in shared)) for r in rules]
    out = [r for r in kept if r.fields or r.error]
    defaults = Rule("single", ())
    for (_, name), own in shared.items():
        whens = [r.when for r in own]
        error = ""
        if whens.count("") > 1:
            error = "two rules without a condition claim this field"
        elif len(set(whens)) < len(whens):
            error = "two rules with the same condition claim this field"
        elif len({r.type for r in own}) > 1:
            error = "rules of different types claim this field"
        parts = tuple({f.name: getattr(r, f.name) for f in fields(Rule) if f.name not in ("type", "fields", "branches") and (f.name == "when" or getattr(r, f.name) != getattr(defaults, f.name))} for r in sorted(own, key=lambda r: r.when == ""))
        out.append(Rule(own[0].type, (name,), branches=parts, error=error))
    return out


NULL = "CAST(NULL AS string)"
ITEM = "struct<rule:int,type:string,field:string,reason:string,value:string,key:array<string>>"
#: BLANK as SQL.
BLANKS = r"' \t\n\r\u0000\u000b'"


class _Compiler:
    """Writes rules as SQL over a frame's columns: for each rule and field an item, a struct with a null reason where nothing is wrong.

    What several rules read is found once, in columns below them: the forms of compared values, the hosts of forms, and the checks of identifiers.
    """

    def __init__(self, frame: DataFrame, dictionary: Dictionary, events: Events | None = None):
        self.forms, self.events, self.boxes = dictionary.forms, events, dictionary.checkboxes
        self.columns = {c for c in frame.columns if c not in (*META, "_states")}
        self.has_states = "_states" in frame.columns
        self.named: dict[conditions.Ref, Named] = {}
        self.below: dict[str, Column] = {}
        self.frame, self.several = frame, False

    def prepare(self, rules: list[Rule]) -> None:
        """Adds the forms of all values that conditions compare."""
        refs: dict[conditions.Ref, bool] = {}
        for text in (t for r in rules for t in texts(r)):
            try:
                tree = conditions.parse(text)
            except conditions.ConditionError:
                continue  # the rule gets a problem row of its own
            full = conditions.full_keys(tree)
            for x in conditions.references(tree):
                refs[x] = refs.get(x, False) or x in full
        self.frame = with_forms(self.frame, [(conditions.value_sql(x, self.columns, self.boxes), full) for x, full in refs.items()])
        self.named = {x: Named(k) for k, x in enumerate(refs)}

    def is_several(self, rule: Rule, name: str) -> bool:
        return rule.type == "choices" and name in self.boxes

    def condition(self, text: str) -> str:
        return conditions.to_sql(conditions.parse(text), self.named)

    def unresolved(self, *texts: str) -> str | None:
        """Why a condition can't be judged in this context: a text, null if it can; None if that is known now."""
        refs = dict.fromkeys(r.field for t in texts if t for r in conditions.references(conditions.parse(t)))
        if not self.has_states or not refs:
            return None
        why = {"missing": "is not collected in this event", "ambiguous": "has several values here", "unreadable": "could not be read"}
        tests = [f"CASE _states[{quoted(f)}] " + " ".join(f"WHEN {quoted(state)} THEN {quoted(f'[{f}] {said}')}" for state, said in why.items()) + " END" for f in refs]
        return f"coalesce({', '.join(tests)}, {NULL})"

    def value(self, name: str) -> str:
        return f"CAST(`{name}` AS string)" if name in self.columns and name not in self.boxes else NULL

    def column(self, name: str, made: Column) -> str:
        """The name of a column below the rules."""
        self.below[name] = made
        return name

    def item(self, ordinal: int, kind: str, name: str, reason: str, value: str = NULL, key: str = "CAST(NULL AS array<string>)") -> str:
        made = self.struct(ordinal, kind, name, reason, value, key)
        return f"array({made})" if self.several else made

    def struct(self, ordinal: int, kind: str, name: str, reason: str, value: str, key: str = "CAST(NULL AS array<string>)") -> str:
        return f"named_struct('rule', {ordinal}, 'type', {quoted(kind)}, 'field', {quoted(name)}, 'reason', {reason}, 'value', {value}, 'key', {key})"

    def problem(self, ordinal: int, name: str, why: str) -> str:
        return self.item(ordinal, "problem", name, why)

    def placed(self, ordinal: int, rule: Rule, name: str) -> str:
        """The item of a rule in the contexts where its field lives, or an array of items if `several`; in others it is null."""
        self.several = self.is_several(rule, name)
        if rule.error or self.events is None:
            return self.rule(ordinal, rule, name)
        if not (form := self.forms.get(name)):
            return self.problem(ordinal, name, quoted(f"field [{name}] is on no form"))
        host = self.column(f"_host{sorted(set(self.forms.values())).index(form)}", hosted(form, self.events))
        return f"CASE WHEN {host} THEN {self.rule(ordinal, rule, name)} END"

    def key(self, rule: Rule, name: str) -> str:
        """What must not be the same in two records: the value, those it is unique with, and the scope."""
        trim = lambda f: f"trim(BOTH {BLANKS} FROM coalesce({self.value(f)}, ''))"
        scope = {"event": ["concat('event ', _event)"], "dag": ["concat('group ', coalesce(_dag, ''))"]}.get(rule.scope, [])
        return f"array({', '.join([trim(name), *map(trim, rule.unique_with), *scope])})"

    def rule(self, ordinal: int, rule: Rule, name: str) -> str:
        if rule.error:
            return self.problem(ordinal, name, quoted(rule.error))
        if rule.branches:
            return self.branches(ordinal, rule, name)
        try:
            gate, blocked = self.condition(rule.when) if rule.when else "true", self.unresolved(rule.when)
        except conditions.ConditionError as e:
            return self.problem(ordinal, name, quoted(f"the condition cannot be evaluated: {e}"))
        found = self.judge(ordinal, rule, name)
        tests = [f"WHEN {blocked} IS NOT NULL THEN {self.problem(ordinal, name, blocked)}"] if blocked else []
        return f"CASE {' '.join(tests)} WHEN {gate} THEN {found} END" if tests or rule.when else found

    def branches(self, ordinal: int, rule: Rule, name: str) -> str:
        plain = replace(rule, branches=())
        own = [(b.get("when", ""), replace(plain, **{k: v for k, v in b.items() if k != "when"})) for b in rule.branches]
        try:
            tests = [self.condition(w) for w, _ in own if w]
        except conditions.ConditionError as e:
            return self.problem(ordinal, name, quoted(f"a branch condition cannot be evaluated: {e}"))
        rest = next((f" ELSE {self.rule(ordinal, r, name)}" for w, r in own if not w), "")
        blocked = self.unresolved(*[w for w, _ in own])
        whens = [f"WHEN {blocked} IS NOT NULL THEN {self.problem(ordinal, name, blocked)}"] if blocked else []
        if len(tests) > 1:
            active = " + ".join(f"CAST({t} AS int)" for t in tests)
            whens.append(f"WHEN {active} > 1 THEN {self.problem(ordinal, name, quoted('more than one branch condition is true'))}")
        whens += [f"WHEN {test} THEN {self.rule(ordinal, r, name)}" for test, (_, r) in zip(tests, [x for x in own if x[0]], strict=True)]
        return f"CASE {' '.join(whens)}{rest} END" if whens else rest.removeprefix(" ELSE ")

    def judge(self, ordinal: int, rule: Rule, name: str) -> str:
        value, box = self.value(name), name in self.boxes
        blank = f"trim(BOTH {BLANKS} FROM coalesce({value}, ''))"
        when = lambda test, reason, *key: f"CASE WHEN {test} THEN {self.item(ordinal, rule.type, name, quoted(reason), value, *key)} END"
        never = self.item(ordinal, rule.type, name, NULL)
        if rule.type == "required":
            return never if box else when(f"{blank} = ''", "required-blank")
        if rule.type == "unique":  # a candidate, which the aggregation judges
            return never if box else when(f"{blank} <> ''", "duplicate-value", self.key(rule, name))
        if rule.type == "constraint":
            try:
                holds, blocked = self.condition(rule.asserts), self.unresolved(rule.asserts)
            except conditions.ConditionError as e:
                return self.problem(ordinal, name, quoted(f"the assertion cannot be evaluated: {e}"))
            filled = "false" if box else f"trim(BOTH {SPACES} FROM coalesce({value}, '')) <> ''"
            wrong = when(f"NOT {holds} AND {filled}", f"assert:{rule.asserts}")
            return f"CASE WHEN {blocked} IS NOT NULL THEN {self.problem(ordinal, name, blocked)} ELSE {wrong} END" if blocked else wrong
        if rule.type == "choices":
            hidden = ", ".join(map(quoted, rule.hidden()))
            if not hidden:
                return never
            if box:  # an item for each hidden code that is ticked
                ticked = f"filter(array({hidden}), c -> coalesce(`{name}`[c], '0') = '1')"
                return f"transform({ticked}, c -> {self.struct(ordinal, rule.type, name, quoted('hidden-choice'), 'c')})"
            return when(f"{value} <> '' AND trim(BOTH {BLANKS} FROM {value}) IN ({hidden})", "hidden-choice")
        if rule.algorithm not in identifiers.ALGORITHMS:
            return self.problem(ordinal, name, quoted(f"unknown algorithm {rule.algorithm}"))
        here = f"{len(self.below)}"
        some = f"{value} <> ''"
        text = F.col(f"`{name}`").cast("string") if name in self.columns and not box else F.lit(None).cast("string")
        if rule.type == "pooled":
            pool = pooled.Pool(rule.algorithm, rule.source, rule.strip, rule.pattern or None, rule.lengths, rule.least, rule.most, rule.keep, rule.expected)
            if why := pool.problem():
                return self.problem(ordinal, name, quoted(why))
            reason = self.column(f"_pool{here}", pooled.reasons(pooled.segments(text, pool), pool))
            long = quoted("the value is too long to be searched for IDs")
            return f"CASE WHEN {some} AND {reason} IS NULL THEN {self.problem(ordinal, name, long)} WHEN {some} THEN {self.item(ordinal, rule.type, name, f"nullif({reason}, '')", value)} END"
        wrong = F.when(~patterns.matches(text, rule.pattern), "format").when(~identifiers.validate_id(rule.algorithm, text, rule.source, rule.strip), "check-character")
        reason = self.column(f"_id{here}", F.when(text != "", wrong))
        return f"CASE WHEN {reason} IS NOT NULL THEN {self.item(ordinal, rule.type, name, reason, value)} END"


def _items(contexts: DataFrame, rules: list[Rule], dictionary: Dictionary, events: Events | None, unique: bool) -> DataFrame:
    """The items of all uniqueness rules, or of all others, from one projection over the columns that several of them read."""
    twice = duplicate_claims(rules)
    made = _Compiler(contexts, dictionary, events)
    made.prepare([r for r in rules if (r.type == "unique") == unique])
    single, several = [], []
    for k, r in enumerate(rules, 1):
        for f in dict.fromkeys(r.fields or ("",)):
            if not r.dropped and (r.type == "unique" and not r.error) == unique and (r.mode, f) not in twice:
                (several if made.is_several(r, f) else single).append(made.placed(k, r, f))
    if not single and not several:
        return contexts.sparkSession.createDataFrame([], f"{PLACE}, rule int, type string, field string, reason string, value string, key array<string>")
    frame = made.frame.withColumns(made.below) if made.below else made.frame
    own = [f"array({', '.join(single)})"] * bool(single) + [f"coalesce({x}, CAST(array() AS array<{ITEM}>))" for x in several]
    items = own[0] if len(own) == 1 else f"concat({', '.join(own)})"
    # the outer kind: for the other one the optimizer tests the array's size below, and would make it twice
    listed = frame.select(*META, F.expr(items).alias("items")).select(*META, F.explode_outer("items").alias("f"))
    return listed.where("f.reason is not null").select(*META, "f.*")


def row_local(contexts: DataFrame, rules: list[Rule], dictionary: Dictionary, events: Events | None = None) -> DataFrame:
    """Findings, and problems as type 'problem', of all rules but uniqueness, in one pass over the contexts."""
    return _items(contexts, rules, dictionary, events, False).drop("key")


def candidates(contexts: DataFrame, rules: list[Rule], dictionary: Dictionary, events: Events | None = None) -> DataFrame:
    """The values that uniqueness rules judge, with what must not be the same in two records as `key`, and problems as type 'problem'."""
    return _items(contexts, rules, dictionary, events, True)


def duplicates(items: DataFrame) -> DataFrame:
    """Findings of the candidates whose key two or more records share, and the problems among the items. The items are read three times: write them before.

    A key's least and greatest record are aggregated with partial sums; where they differ, its rows are joined back. A value that a
    third of all rows hold is thus no single task's work.
    """
    names = ["rule", "field", "key"]
    shared = items.where("type = 'unique'").groupBy(*names).agg(F.min("_record").alias("_a"), F.max("_record").alias("_b")).where("_a <> _b").select(*names)
    found = items.where("type = 'unique'").join(shared, names, "left_semi").dropDuplicates(["rule", "field", "_record", "_event", "_instance", "_form"])
    columns = [*META, "rule", "type", "field", "reason", "value"]
    return found.select(*columns).unionByName(items.where("type = 'problem'").select(*columns))


def unique(contexts: DataFrame, rules: list[Rule], dictionary: Dictionary, events: Events | None = None) -> DataFrame:
    """Findings of values that two or more records share, for all uniqueness rules and fields at once, and problems as type 'problem'. The candidates
    are written once, to the folder of checkpoints."""
    items = candidates(contexts, rules, dictionary, events)
    if any(r.type == "unique" and not r.dropped for r in rules):
        with_checkpoint_dir(contexts.sparkSession)
        items = items.checkpoint()
    return duplicates(items)


def scan(contexts: DataFrame, rules: list[Rule], dictionary: Dictionary, events: Events | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, and rule problems without repeats, of all rules. With events, each rule is judged in the contexts where its field lives."""
    items = row_local(contexts, rules, dictionary, events).unionByName(unique(contexts, rules, dictionary, events))
    problems = items.where("type = 'problem'").select("rule", "field", F.col("reason").alias("why")).distinct()
    return items.where("type <> 'problem'"), problems
