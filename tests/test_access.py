"""Rights, groups, dependents, live lookups, policy and the rounds of catching up."""

import pytest

from fieldwarden.operators import access, policy, scans
from fieldwarden.operators import rules as R
from fieldwarden.streaming import changes

DICTIONARY = R.Dictionary({"a": "text", "b": "text", "c": "text"}, {"a": "one", "b": "two", "c": "one"}, identifiers=frozenset({"c"}))
ROWS = "record string, event_id long, repeat_key string, instance int, dag string, a string, b string, c string"


def test_rights():
    rules = [R.Rule("required", ("a", "b")), R.Rule("constraint", ("a",), asserts="[b]='1'"), R.Rule("required", ("c",)), R.Rule("required", ("b",), error="broken")]
    kept, problems = access.readable(rules, DICTIONARY, {"one": "1", "two": "0"})
    assert [(r.fields, r.dropped) for r in kept] == [(("a",), False), (("",), True), (("c",), False), (("b",), False)]
    assert [(k, f) for k, f, _ in problems] == [(1, "b"), (2, "a")]
    assert access.readable(rules, DICTIONARY, True) == (rules, [])
    assert all(r.dropped or r.error for r in access.readable(rules, DICTIONARY, None)[0])
    assert [r.fields for r in access.on_form(rules, DICTIONARY, "one")] == [("a",), ("a",), ("c",), ("b",)]  # a rule with an error stays as it is
    assert access.dependents(rules, DICTIONARY, "two") == [2] and access.dependents(rules, DICTIONARY, "one") == []
    assert access.disclosable(["a", "b", "nope"], DICTIONARY, {"one": "1", "two": "2"}, "one") == ["b"]
    assert access.disclosable(["b"], DICTIONARY, None) == [] == access.disclosable(["b"], DICTIONARY, True, data_entry=False)


def test_severity():
    of = lambda **k: access.severity(R.Rule("constraint", ("a",), **k), DICTIONARY)
    assert [of(block="hard", asserts="[a]='1'"), of(block="hard", asserts="[b]='1'"), of(block="odd"), of(block="hard", error="x"), of(block="confirm")] == ["hard", "off", "off", "off", "confirm"]


def test_scan_by_rights_and_group(spark):
    rows = spark.createDataFrame([("r1", 1, None, 1, "north", None, "x", "7"), ("r2", 1, None, 1, "south", "1", None, "7"), ("r3", 1, None, 1, "north", "2", None, "7")], ROWS)
    rules = [R.Rule("required", ("a", "b")), R.Rule("unique", ("c",)), R.Rule("unique", ("c",), scope="dag", error="")]
    scan = scans.run_scan(rows, rules[:2], DICTIONARY, group="north", rights={"one": "1"})
    assert [(r.rule, r._record, r.field) for r in scan.findings.collect()] == [(1, "r1", "a")]
    assert sorted((r.rule, r.field) for r in scan.problems.collect()) == [(1, "b"), (2, "c")] and scan.outcome == "blocked"
    within = scans.run_scan(rows, [R.Rule("unique", ("c",), scope="dag")], DICTIONARY, group="north")
    assert sorted(r._record for r in within.findings.collect()) == ["r1", "r3"] and within.problems.isEmpty()


def test_live_lookup(spark):
    fields = "_record string, _event string, _instance int, _form string, _dag string, a string, b string, c string"
    rows = spark.createDataFrame([("r1", "1", 1, None, "north", " 7 ", "x", "9"), ("r2", "1", 1, None, "south", "8", "", "9")], fields)
    rule = R.Rule("unique", ("a",), unique_with=("b",), surveys=True)
    of = lambda v, rules=(rule,), field="a", **k: access.is_used(rows, list(rules), DICTIONARY, field, v, **k)
    assert of({"a": "7", "b": "x"}) == access.Answer(True, "r1") and of({"a": "7", "b": "y"}) == access.Answer()
    assert of({"a": " ", "b": "x"}) == access.Answer() and of({"a": "7", "b": "x"}, record="r1") == access.Answer()
    assert of({"a": "7"}, record="r2") == access.Answer()  # b as saved: blank
    assert of({"a": "7", "b": "x"}, group="south") == access.Answer(True) == of({"a": "7", "b": "x"}, signed_in=False)
    assert of({"c": "9"}, [R.Rule("unique", ("c",), surveys=True)], "c", signed_in=False).error and of({"b": "x"}, field="b").error
    assert of({str(k): "" for k in range(9)}).error and of({"a": "x" * 1025}).error


def test_policy():
    p = policy.resolve({"value_days": "10", "findings": 0}, {"value_days": 99, "run_days": " 7 ", "value_mode": "raw", "size": -1})
    assert p == policy.Policy("raw", 10, 7) and policy.resolve({}, {"value_mode": "all"}).value_mode == "locations"
    assert policy.tightened(p, policy.Policy("locations", 10, 7)) and policy.tightened(p, policy.Policy("raw", 9, 7)) and not policy.tightened(p, p)
    assert policy.tightened(p, policy.Policy("raw", 10, 7, hash_records=True)) and policy.least("raw", "identifier-redacted") == "identifier-redacted"
    assert p.spent(1_000_000, 0) and p.spent(0, 512 << 20) and not p.spent(5, 5)
    assert policy.claim({}).may_scan is False and policy.claim({"records": True}).most == "manifest-complete"
    assert policy.claim(dict.fromkeys(policy.CAPABILITIES, True)) == policy.Claim(True, "complete-through-fence", True, ())


@pytest.mark.parametrize(
    ("given", "end", "clean", "coverage"),
    [
        ({"examined": 1}, "", True, "complete-through-fence"), ({"examined": 1, "findings": 2}, "", False, "complete-through-fence"), ({"examined": 1, "fenced": False}, "_MANIFEST_ONLY", False, "manifest-complete"),
        ({"examined": 1, "truncated": True}, "_TRUNCATED", False, "complete-through-fence"), ({"examined": 1, "blocked": 1, "truncated": True}, "_INCOMPLETE_TRUNCATED", False, "partial"), ({"failed": True}, "_FAILED", False, "partial"), ({}, "_INCOMPLETE", False, "partial"),
    ],
)
def test_verdicts(given, end, clean, coverage):
    run = changes.Run(**given)
    assert policy.suffix(run) == end and policy.verdict(run)["clean"] == clean and policy.verdict(run)["coverage"] == coverage


def test_unready():
    assert policy.unready({"pending": 1}, True, True) and policy.unready({}, False, True) and policy.unready({}, True, False)
    assert policy.unready({"tombstone": 5, "done": 2}, True, True) is None is policy.unready({"pending": 3}, False, False, ended=True)


def rounds(spark, reads, attempts=None):
    """Catches up with a log that adds n and edits e, while g is gone; reads(round, records) gives what is read."""
    manifest = spark.createDataFrame([("e", 1, "done", 0), ("g", 2, "done", 0), ("s", 3, "done", 0)], changes.MANIFEST)
    log = spark.createDataFrame([(1, "e"), (2, "g"), (3, "s"), (5, "e"), (6, "g"), (7, "n"), (8, None), (9, "")], "log_id long, record string")
    present, asked = spark.createDataFrame([("e",), ("n",), ("s",)], "record string"), []

    def rescan(records):
        asked.append(sorted(r.record for r in records.collect()))
        return spark.createDataFrame(reads(len(asked), asked[-1]), "record string, version long")

    out = changes.catch_up(manifest, log, lambda: present, rescan, 3)
    return out, {r.record: (r.scanned_version, r.state) for r in out.manifest.collect()}, asked


def test_catch_up(spark):
    now = {"e": 5, "n": 7}
    out, rows, asked = rounds(spark, lambda n, records: [(r, now[r]) for r in records])
    assert (out.fenced, out.settled, out.rounds, asked) == (True, True, 1, [["e", "n"]])
    assert rows == {"e": (5, "done"), "g": (2, "tombstone"), "s": (3, "done"), "n": (7, "done")}


def test_catch_up_of_a_record_that_is_not_found(spark):
    out, rows, asked = rounds(spark, lambda n, records: [(r, 5) for r in records if r == "e"])
    assert rows["e"] == (5, "done") and asked[:3] == [["e", "n"], ["n"], ["n"]] and not out.settled  # the list has it, the reads never


def test_catch_up_that_never_settles(spark):
    out, rows, asked = rounds(spark, lambda n, records: [(r, 4) for r in records])
    assert (out.fenced, out.settled, len(asked)) == (False, False, changes.ROUNDS + 1)


def test_catch_up_without_the_log(spark):
    manifest = spark.createDataFrame([("e", 1, "done", 0)], changes.MANIFEST)
    out = changes.catch_up(manifest, spark.createDataFrame([(9, "e")], "log_id long, record string"), lambda: manifest, lambda r: r, 3)
    assert not out.fenced and not out.settled


def test_live_lookups_by_the_active_branch(spark):
    place = "_record string, _event string, _instance int, _form string, _dag string, code string, kind string"
    rows = [("1", "1", 1, None, "g", "x", "a"), ("2", "1", 1, None, "h", "x", "b"), ("3", "1", 1, None, "h", "y", "c"), ("4", "1", 1, None, "g", "x", "both"), ("1", "1", 1, "f", "g", "x", "b")]
    contexts = spark.createDataFrame(rows, place)
    dictionary = R.Dictionary({"code": "text", "kind": "text"})
    branches = ({"when": "[kind]='a' or [kind]='both'"}, {"when": "[kind]='b' or [kind]='both'", "scope": "dag"}, {"unique_with": ("kind",)})
    rule = R.Rule("unique", ("code",), branches=branches)
    ask = lambda record, own=rule, **k: access.is_used(contexts, [own], dictionary, "code", {"code": "x"}, record, "1", **{"group": None, **k})
    assert ask("1").used  # the first branch: any record
    assert not ask("2", group="k").used and ask("2", group="g").used  # the second: in the group
    assert ask("1", form="f").used is False and ask("1", form="f", group="h").used  # an instance's own values
    assert not ask("3").used  # the branch without a condition: with kind c, which no other record has
    assert ask("4") == access.Answer(error="no single branch of the rule applies")
    assert access.branch_of(contexts, rule, dictionary, None).unique_with == ("kind",)  # a new record has no values
    closed = R.Rule("unique", ("code",), branches=branches[:2])
    assert ask("3", closed).error and access.branch_of(contexts, R.Rule("unique", ("code",), branches=({"when": "[kind"},)), dictionary, "1") is None
