"""Rules as designers write them: tags in a data dictionary's annotations, and rows of a settings table."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, replace

from fieldwarden.functions import conditions, identifiers, patterns
from fieldwarden.operators.rules import Dictionary, Rule, parse_codes, resolve_branches

TAGS = {"@UVALIDATE": "single", "@UVASSERT": "constraint", "@UVREQUIRED": "required", "@UVUNIQUE": "unique", "@UVCHOICES": "choices"}
TAG = re.compile("(" + "|".join(TAGS) + r")(?=[=\s]|\Z)(=)?", re.IGNORECASE)
#: What each kind of tag may say in its JSON form, and the rule's name for it.
KEYS = {
    "single": {"type": "type", "algorithm": "algorithm", "source": "source", "pattern": "pattern", "strip": "strip", "keepChars": "keep", "idLengths": "lengths", "idMinLen": "least", "idMaxLen": "most", "expectedIds": "expected", "blockSave": "block", "when": "when", "suggestFix": "", "note": "note"},
    "constraint": {"assert": "asserts", "when": "when", "message": "message", "blockSave": "block"},
    "required": {"when": "when", "message": "message", "blockSave": "block"},
    "unique": {"with": "unique_with", "scope": "scope", "when": "when", "message": "message", "blockSave": "block", "surveys": "surveys"},
    "choices": {"when": "when", "show": "show", "hide": "hide", "message": "message", "blockSave": "block"},
}
#: Field types that a rule of each mode can be on.
ALLOWED = {
    "single": {"text", "notes"}, "pooled": {"text", "notes"}, "constraint": {"text", "notes", "dropdown", "radio", "yesno", "truefalse", "calc", "sql", "slider"},
    "required": {"text", "notes", "dropdown", "radio", "yesno", "truefalse", "sql", "slider", "calc"}, "unique": {"text", "notes", "dropdown", "radio", "sql", "calc"},
    "choices": {"dropdown", "radio", "checkbox", "yesno", "truefalse"},
}
SCOPES = ("project", "dag", "event")


def tags(annotation: str) -> list[tuple[str, str]]:
    """(kind, value) of each tag; a value is braces that balance, a quoted text, or a word, and is not searched for tags."""
    out, at = [], 0
    while m := TAG.search(annotation, at):
        at = m.end()
        if m.start() and not annotation[m.start() - 1].isspace():
            continue
        value = ""
        if m[2]:
            rest = annotation[at:]
            if rest.startswith("{"):
                try:
                    _, used = json.JSONDecoder().raw_decode(rest)
                except ValueError:
                    used = rest.rfind("}") + 1 or len(rest)
            elif rest[:1] in ("'", '"'):
                used = (rest.find(rest[0], 1) + 1) or len(rest)
            else:
                used = len(re.match(r"\S*", rest)[0])
            value, at = rest[:used], at + used
        out.append((TAGS[m[1].upper()], value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def tag_rule(kind: str, value: str, field: str) -> Rule:
    """The rule of a tag on a field; what is wrong with it is the rule's error."""
    value = value.strip()
    bad = lambda why: Rule(kind, (field,), error=why)
    if value.startswith("{"):
        try:
            given = json.loads(value)
        except ValueError as e:
            return bad(f"the JSON does not parse: {e}")
        if unknown := sorted(set(given) - set(KEYS[kind])):
            return bad(f"unknown option(s): {', '.join(unknown)}")
    elif kind == "single":
        given = {"algorithm": value} if value else {}
    elif kind == "constraint":
        given = {"assert": value}
    elif kind == "required":
        given = {"when": value} if value else {}
    elif kind == "unique":
        given = {"scope": value} if value else {}
    else:
        return bad("a show or a hide list is needed, in JSON")
    return checked(kind, field, given)


def checked(kind: str, field: str, given: dict) -> Rule:
    bad = lambda why: Rule(kind, (field,), error=why)
    lists = {"lengths", "unique_with", "show", "hide"}
    made: dict = {}
    for name, v in given.items():
        target = KEYS[kind][name]
        if target in lists:
            if not isinstance(v, list):
                return bad(f'"{name}" must be a list')
            made[target] = tuple(int(x) for x in v) if target == "lengths" else tuple(str(x).strip().lower() if target == "unique_with" else str(x).strip() for x in v)
        elif target in ("least", "most", "expected"):
            if not str(v).isdigit() or int(v) < 1:
                return bad(f'"{name}" must be a positive whole number')
            made[target] = int(v)
        elif target == "surveys":
            if not isinstance(v, bool):
                return bad('"surveys" must be true or false')
            made[target] = v
        elif target:
            if not isinstance(v, str):
                return bad(f'"{name}" must be a text')
            made[target] = v
    rule = replace(Rule(kind, (field,)), **{k: v for k, v in made.items() if k != "type"})
    if kind == "single" and made.get("type") in ("single", "pooled"):
        rule = replace(rule, type=made["type"])
    elif made.get("type"):
        return bad(f'unknown type "{made["type"]}"')
    if kind == "single":
        rule = replace(rule, algorithm=identifiers.canonical(rule.algorithm))
        if rule.algorithm not in identifiers.ALGORITHMS:
            return bad(f'unknown check algorithm "{rule.algorithm}"')
        if rule.algorithm == "none" and not rule.pattern:
            return bad("without a check algorithm a pattern is needed")
        if rule.pattern and (why := patterns.lint(rule.pattern) or [w for w in [patterns.risk(rule.pattern)] if w]):
            return bad(f"the pattern cannot be used: {'; '.join(why)}")
        if rule.type == "pooled" and rule.expected and rule.algorithm == "none" and len(set(rule.lengths)) != 1 and rule.least != rule.most:
            return bad("a count needs IDs of one length if only a pattern tells them")
    for name in ("when", "asserts"):
        if text := getattr(rule, name):
            try:
                conditions.parse(text)
            except conditions.ConditionError as e:
                return bad(f"{name}: {e}")
    if kind == "constraint" and not rule.asserts:
        return bad("a condition is needed")
    if kind == "unique" and (rule.scope.lower() not in SCOPES or len(rule.unique_with) > 5):
        return bad("the scope is project, dag or event, with five fields at most")
    if kind == "choices" and ((rule.show is None) == (not rule.hide) or len((rule.show or ()) + rule.hide) > 200):
        return bad("exactly one of show and hide is needed, with 200 codes at most")
    return replace(rule, scope=rule.scope.lower())


def fits(rule: Rule, dictionary: Dictionary) -> Rule:
    """The rule with its field's codes, or with the error that the dictionary shows."""
    if rule.error:
        return rule
    for f in rule.fields:
        kind = dictionary.types.get(f)
        if kind is None:
            return replace(rule, error=f"field [{f}] does not exist")
        if kind not in ALLOWED[rule.type]:
            return replace(rule, error=f"a {rule.type} rule cannot be on a {kind} field")
    for text in (rule.when, rule.asserts):
        if text and (wrong := conditions.check_references(conditions.parse(text), dictionary.types, dictionary.codes)):
            return replace(rule, error="; ".join(wrong))
    if missing := [w for w in rule.unique_with if w not in dictionary.types or w in rule.fields]:
        return replace(rule, error=f"no such field to be unique with: {', '.join(missing)}")
    if rule.surveys and (shown := [f for f in (*rule.fields, *rule.unique_with) if f in dictionary.identifiers]):
        return replace(rule, error=f"an identifier is not looked up on surveys: {shown[0]}")
    return replace(rule, codes=tuple(dictionary.codes.get(rule.fields[0], ()))) if rule.type == "choices" else rule


def dictionary_of(rows: list[dict]) -> Dictionary:
    """A dictionary from rows with field_name, form_name, field_type, select_choices_or_calculations and identifier."""
    codes = {r["field_name"]: parse_codes(r.get("select_choices_or_calculations") or "") for r in rows if r["field_type"] in ("dropdown", "radio", "checkbox")}
    codes |= {r["field_name"]: ["1", "0"] for r in rows if r["field_type"] in ("yesno", "truefalse")}
    return Dictionary({r["field_name"]: r["field_type"] for r in rows}, {r["field_name"]: r.get("form_name", "") for r in rows}, codes, frozenset(r["field_name"] for r in rows if r.get("identifier") == "y"))


def annotation_rules(rows: list[dict]) -> list[Rule]:
    """The rules of a dictionary's annotations; fields whose tags say the same share one rule."""
    shared: dict[str, Rule] = {}
    for row in rows:
        for kind, value in tags(row.get("field_annotation") or ""):
            rule = tag_rule(kind, value, row["field_name"])
            key = json.dumps(asdict(replace(rule, fields=())), sort_keys=True)
            shared[key] = replace(shared[key], fields=(*shared[key].fields, row["field_name"])) if key in shared and not rule.error else rule
            if rule.error:
                shared[f"{key}{row['field_name']}"] = shared.pop(key)
    return list(shared.values())


def settings_rules(settings: dict[str, list]) -> list[Rule]:
    """Rules from parallel lists of settings, one entry of each list a rule: type, fields, and the names of the JSON form."""
    names, size = list(settings), max((len(v) for v in settings.values()), default=0)
    out = []
    for k in range(size):
        row = {n: settings[n][k] for n in names if k < len(settings[n]) and settings[n][k] not in (None, "", [])}
        kind, fields = row.pop("type", "single"), row.pop("fields", [])
        fields = tuple(f.strip().lower() for f in (fields.split(",") if isinstance(fields, str) else fields) if f.strip())
        base = "single" if kind == "pooled" else kind
        if base not in KEYS or not fields:
            out.append(Rule(kind if base in KEYS else "single", fields, error="unknown type of rule" if base not in KEYS else "a rule needs a field"))
            continue
        unknown = sorted(set(row) - set(KEYS[base]))
        rule = Rule(base, fields, error=f"unknown option(s): {', '.join(unknown)}") if unknown else checked(base, fields[0], row | ({"type": "pooled"} if kind == "pooled" else {}))
        out.append(replace(rule, fields=fields))
    return out


def rule_list(settings: dict[str, list], rows: list[dict]) -> list[Rule]:
    """All rules of a project: settings first, then annotations, fitted to the dictionary, with shared fields as branches."""
    dictionary = dictionary_of(rows)
    return resolve_branches([fits(r, dictionary) for r in [*settings_rules(settings), *annotation_rules(rows)]])


def revision(rule: Rule) -> str:
    """A hash of what a rule does: its fields, wording and notes are no part of it."""
    kept = {k: v for k, v in asdict(rule).items() if k not in ("fields", "note", "message", "uid", "dropped")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()


def identities(rules: list[Rule]) -> list[str]:
    """A name for each rule that lasts while it does the same: its uid, or its revision and how often that came before."""
    seen: dict[str, int] = {}
    out = []
    for r in rules:
        base = f"uid:{r.uid}" if r.uid else f"rule:{hashlib.sha256(','.join(sorted(r.fields)).encode()).hexdigest()[:8]}:{revision(r)[:32]}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if r.uid else f"{base}:{seen[base]}")
    return out


def fingerprint(rules: list[Rule], dictionary: Dictionary, policy: dict) -> str:
    """A hash of everything that decides what a scan finds."""
    parts = [[revision(r), list(r.fields)] for r in rules], dict(dictionary.types), {k: list(v) for k, v in dictionary.codes.items()}, policy
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
