"""Parts of the validation engine held against plain Python: conditions, hashes, outcomes, authoring, contexts, writers, streams."""

import csv
import dataclasses
import functools
import glob
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from fieldwarden.functions import conditions, identifiers, patterns, text
from fieldwarden.operators import contexts as C
from fieldwarden.operators import reports, rollups, scans
from fieldwarden.operators import rules as R
from fieldwarden.sources import authoring, tables
from fieldwarden.streaming import changes

KEY = b"a key of tests"


@pytest.mark.parametrize("blank", ["", " ", "\t\n"])
def test_blank_conditions(blank):
    with pytest.raises(conditions.ConditionError, match="empty"):
        conditions.parse(blank)


def test_depth(spark):
    assert conditions.parse("(" * 10 + "[a]='1'" + ")" * 10)
    with pytest.raises(conditions.ConditionError, match="deeper"):
        conditions.parse("(" * 11 + "[a]='1'" + ")" * 11)


def test_fold():
    tree = conditions.parse("[here]='1' and [there]>'5' and not [box(2)]='1'")
    known = {conditions.Ref("there"): "7", conditions.Ref("box", "2"): "0"}
    out = conditions.fold(tree, {"here"}, known, {"there"}, lambda c: c.left == conditions.Ref("there"))
    assert out.snapshot and not out.blocked and out.tree.items[0] == tree.items[0] and out.tree.items[1] == conditions.Constant(True)
    gone = conditions.fold(conditions.parse("[here]=[there]"), {"here"}, {}, set(), lambda c: True)
    assert gone.blocked and gone.frozen and gone.tree == conditions.Constant(False)


def test_hmac_and_identity_as_pythons(spark):
    values = ["", "7", "é 😀", "x" * 200]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.h for r in frame.select("v", text.purpose_hash(KEY, "record", 7, F.col("v")).alias("h")).collect()}
    assert got == {v: hmac.new(KEY, b"v1\0record\x007\0" + v.encode(), hashlib.sha256).hexdigest() for v in values}
    long = b"k" * 100
    assert frame.select(text.hmac_sha256(long, F.col("v")).alias("h")).first().h == hmac.new(long, b"", hashlib.sha256).hexdigest()
    finding = spark.createDataFrame([("r1", "1", 2, "line", None, 3, "single", "ident", "format", "v")], tables.FINDINGS)
    told = "\0".join(["r1", "1", "2", "line", "ident", "3", "format"])  # place, rule and code of the reason
    assert reports.identified(finding, KEY, 7).first().finding == hmac.new(KEY, f"v1\0finding\x007\0{told}".encode(), hashlib.sha256).hexdigest()


def test_groups_of_ids(spark):
    records = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", None), ("c", ""), ("d", "2"), (None, "1")], "record string, dag string")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("e",), (None,)], "record string")
    dags = sorted(changes.groups_of(ids, records).collect(), key=str)
    assert [tuple(r) for r in dags] == sorted([("a", "1"), ("a", "1"), ("b", None), ("c", None), ("d", "2"), ("e", None), (None, None)], key=lambda r: f"Row(record={r[0]!r}")
    kept = lambda group: sorted(r.record for r in changes.admitted(ids, records, group).where("in_scope and record is not null").collect())
    assert kept("1") == ["a", "a"] and kept("2") == ["d"] and kept("") == [] and kept(None) == ["a", "a", "b", "c", "d", "e"]
    assert changes.admitted(ids, records.limit(0), "1").where("in_scope").count() == 0


def test_findings_are_read_page_by_page(spark):
    draw = random.Random(3)
    rows = list({(draw.choice("abc"), draw.choice(["1", None]), draw.randint(1, 2), draw.choice([None, "f"]), None, draw.randint(1, 3), "single", draw.choice("xy"), "format", draw.choice([None, "v"])) for _ in range(120)})
    findings, got, after = spark.createDataFrame(rows, tables.FINDINGS).repartition(3), [], None
    while found := reports.page(findings, after, 17).collect():
        got += [tuple(r) for r in found]
        after = found[-1]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert got == sorted(rows, key=lambda r: [(x is not None, x or 0) if isinstance(x, int) else (x is not None, x or "") for x in (*r[:4], r[5], r[7], r[8], r[9])])


def test_a_records_group_is_that_of_its_first_row(spark):
    rows = [("r", 2, None, 1, "a", "1"), ("r", 1, "f", 2, "b", "1"), ("r", 1, "f", 1, "c", "1"), ("r", 1, None, 1, "", "1"), ("s", 1, None, 1, None, "1")]
    found = C.contexts(spark.createDataFrame(rows, "record string, event_id long, repeat_key string, instance int, dag string, v string"), ["v"])
    assert {(r._record, r._dag) for r in found.collect()} == {("r", "c"), ("s", None)}


def test_legend_and_audit_log(spark, tmp_path):
    report = spark.createDataFrame([("1", "=x")], "record string, value string").coalesce(1)
    tables.write_csv(report, f"{tmp_path}/csv", reports.legend([*report.columns, "own"]))
    lines = "".join(open(f, newline="").read() for f in glob.glob(f"{tmp_path}/csv/*.txt")).split("\r\n")
    assert lines[0] == "# columns: record=Record, value=Saved value, own=own" and lines[1] == '"record","value"' and lines[2].startswith('"1",')
    for word in ("started", "ended"):
        tables.append_audit(spark.createDataFrame([(7, "r1", word, "ann", None)], tables.AUDIT.rsplit(",", 1)[0]), f"{tmp_path}/audit")
    log = spark.read.schema(tables.AUDIT).parquet(f"{tmp_path}/audit").orderBy("created_at").collect()
    assert [(r.project, r.event) for r in log] == [(7, "started"), (7, "ended")] and all(r.created_at for r in log)


def test_outcomes_of_many_runs(spark):
    draw = random.Random(1)
    runs = [changes.Run(*(draw.random() < 0.2 for _ in range(3)), draw.choice([0, 0, 2]), draw.random() < 0.8, draw.random() < 0.8, draw.random() < 0.2, draw.choice([0, 5, 5]), draw.choice([0, 1])) for _ in range(300)]
    frame = spark.createDataFrame([(k, *dataclasses.astuple(r)) for k, r in enumerate(runs)], "k int, failed boolean, cancelled boolean, expired boolean, blocked int, fenced boolean, manifest_complete boolean, truncated boolean, examined int, findings int")
    got = {r.k: r.word for r in frame.select("k", changes.outcome_of({c: F.col(c) for c in frame.columns[1:]}).alias("word")).collect()}
    assert got == {k: changes.outcome(r) for k, r in enumerate(runs)} and len(set(got.values())) > 7


def test_counters_of_parts_are_those_of_the_whole(spark, rows_of):
    rows = spark.range(500).selectExpr("if(id % 7 = 0, null, cast(id % 3 as string)) as g", "cast(id * 37 % 101 as string) as s", "id % 50 = 0 as b")
    whole = rollups.counters(rows, ["g"], "s", F.col("b"))
    parts = [rollups.counters(rows.where(F.xxhash64("s") % 3 == k), ["g"], "s", F.col("b")) for k in (-2, -1, 0, 1, 2)]
    assert rows_of(rollups.merged(functools.reduce(lambda a, b: a.unionByName(b), parts), ["g"])) == rows_of(whole)
    told = {r.g: (r.n, r.samples, r.blocks) for r in whole.collect()}
    data = rows.collect()
    for g in (None, "0", "1", "2"):
        own = [r for r in data if r.g == g]
        assert told[g] == (len(own), sorted({r.s for r in own})[:3], any(r.b for r in own))


def test_outcomes_and_phases():
    of = lambda **k: changes.outcome(changes.Run(**k))
    assert [of(), of(examined=3), of(examined=3, findings=1), of(examined=3, blocked=1), of(examined=3, fenced=False), of(examined=3, truncated=True)] == ["incomplete", "clean", "complete", "blocked", "manifest-complete", "truncated"]
    assert of(failed=True, cancelled=True, examined=3) == "failed" and of(manifest_complete=False, examined=3) == "manifest-incomplete"
    assert changes.may_follow("planning", "scanning") and not changes.may_follow("scanning", "planning") and not changes.may_follow("terminal", "planning") and changes.may_follow("scanning", "cancelling")


ROWS = [
    {"field_name": "sid", "form_name": "base", "field_type": "text", "identifier": "y", "field_annotation": "@UVALIDATE=luhn @UVUNIQUE"},
    {"field_name": "sid2", "form_name": "base", "field_type": "text", "field_annotation": "@UVALIDATE=luhn"},
    {"field_name": "age", "form_name": "base", "field_type": "text", "field_annotation": "@UVASSERT=\"[age]>='18'\" @UVREQUIRED"},
    {"field_name": "box", "form_name": "base", "field_type": "checkbox", "select_choices_or_calculations": "1, One | 2, Two", "field_annotation": '@UVCHOICES={"hide": ["2"], "when": "[age]<\'18\'"}'},
    {"field_name": "bad", "form_name": "base", "field_type": "text", "field_annotation": "@UVASSERT='[nope]=1' @UVALIDATE={\"colour\": 1}"},
]


def test_authoring():
    rules = authoring.rule_list({}, ROWS)
    by = {(r.type, r.fields): r for r in rules}
    assert by["single", ("sid", "sid2")].algorithm == "luhn" and by["unique", ("sid",)].scope == "project" and by["required", ("age",)].when == ""
    assert by["constraint", ("age",)].asserts == "[age]>='18'" and by["choices", ("box",)].hidden() == ["2"]
    assert sorted(r.error for r in rules if r.error) == ["field [nope] does not exist", "unknown option(s): colour"]
    settings = {"type": ["pooled", "nope"], "fields": ["sid", "age"], "algorithm": ["luhn", ""], "idLengths": [[9], None]}
    first, second = authoring.settings_rules(settings)
    assert (first.type, first.lengths, first.fields) == ("pooled", (9,), ("sid",)) and second.error == "unknown type of rule"
    assert authoring.revision(first) == authoring.revision(R.replace(first, note="x")) != authoring.revision(R.replace(first, lengths=(8,)))
    assert len(set(authoring.identities([first, first]))) == 2


def test_branches_of_shared_fields():
    rules = R.resolve_branches([R.Rule("required", ("a", "b"), when="[x]='1'"), R.Rule("required", ("a",))])
    assert [r.fields for r in rules] == [("b",), ("a",)] and [b["when"] for b in rules[1].branches] == ["[x]='1'", ""]
    assert R.resolve_branches([R.Rule("required", ("a",)), R.Rule("required", ("a",))])[0].error


RISKY = ["(a+)+", "(a|aa)*", "(.*)*", "a*a*b", "(x+x+)+y"]
SAFE = ["^[A-Z]{3}[0-9]{6}$", "abc", "[0-9]+-[A-Z]+", "(AB|CD)[0-9]{4}", "^.*X$"]


def test_pattern_gate():
    assert all(patterns.risk(p) for p in RISKY) and not any(patterns.risk(p) for p in SAFE)
    assert patterns.lint(r"\Aabc\Z") and not patterns.lint("[A-Z]+")


CELLS = [
    ("r1", 1, None, 1, "sid", "17", None, "north"), ("r1", 1, None, 1, "age", "9", None, "north"), ("r1", 1, None, 1, "box", "1", "2", "north"),
    ("r1", 1, "line", 1, "item", "a", None, "north"), ("r1", 1, "line", 2, "item", "", None, "north"), ("r2", 1, None, 1, "sid", " 17 ", None, None), ("r2", 1, None, 1, "age", "30", None, None),
]


def project():
    types = {"sid": "text", "age": "text", "box": "checkbox", "item": "text"}
    return R.Dictionary(types, {"sid": "base", "age": "base", "box": "base", "item": "line"}, {"box": ["1", "2"]}), C.Events({"1": {"base", "line"}}, {("1", "line")})


def test_scan_of_cells_with_repeats(spark):
    dictionary, events = project()
    rows = C.from_long(spark.createDataFrame(CELLS, tables.CELLS), list(dictionary.types), dictionary.checkboxes)
    rules = [R.Rule("constraint", ("age",), asserts="[age]>='18'"), R.Rule("unique", ("sid",)), R.Rule("required", ("item",)), R.Rule("choices", ("box",), hide=("2",), codes=("1", "2")), R.Rule("required", ("age",), when="[item]='a'")]
    scan = scans.run_scan(rows, rules, dictionary, events)
    found = sorted((r.rule, r._record, r._instance, r._form, r._dag, r.value) for r in scan.findings.collect())
    assert found == [(1, "r1", 1, None, "north", "9"), (2, "r1", 1, None, "north", "17"), (2, "r2", 1, None, None, " 17 "), (3, "r1", 2, "line", "north", None), (4, "r1", 1, None, "north", "2")]
    assert [tuple(p) for p in scan.problems.collect()] == [(5, "age", "[item] has several values here")]
    assert (scan.records, scan.contexts, scan.outcome) == (2, 4, "blocked")
    one = scans.run_scan(rows, rules[:1], dictionary, events, record="r2")
    assert (one.outcome, one.records) == ("clean", 1)
    assert scans.run_scan(rows, rules[:1], dictionary, events, group="north").records == 1
    assert scans.run_scan(rows.limit(0), rules[:1], dictionary, events).outcome == "incomplete"


def test_a_repeating_event(spark):
    events = C.Events({"1": {"base"}}, set(), {"1"})
    rows = spark.createDataFrame([("r", 1, None, 1, None, "5"), ("r", 1, "", 1, None, "6"), ("r", 1, "", 2, None, None)], "record string, event_id long, repeat_key string, instance int, dag string, age string")
    found = R.row_local(C.contexts(rows, ["age"]), [R.Rule("constraint", ("age",), asserts="[age]>'9'")], R.Dictionary({"age": "text"}, {"age": "base"}), events)
    assert sorted((r._instance, r.value) for r in found.collect()) == [(1, "6"), (2, "5")]


def test_many_rules_are_one_scan_without_failed_code(spark):
    n = 60
    rows = spark.range(50).select(F.col("id").cast("string").alias("_record"), F.lit("1").alias("_event"), F.lit(1).alias("_instance"), F.lit(None).cast("string").alias("_form"), F.lit(None).cast("string").alias("_dag"), *[(F.col("id") * k).cast("string").alias(f"p{k}") for k in range(1, n + 1)])
    found = R.row_local(rows, [R.Rule("constraint", (f"p{k}",), asserts=f"[p{k}] < 1000") for k in range(1, n + 1)], R.Dictionary({f"p{k}": "text" for k in range(1, n + 1)}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
    assert found.count() == sum(i * k >= 1000 for i in range(50) for k in range(1, n + 1))


def test_writers(spark, tmp_path):
    findings = spark.createDataFrame([("r1", "1", 1, None, None, 1, "single", "a", "format", "=1+1"), ("r2", "1", 1, None, None, 1, "single", "a", "format", 'say "x", y')], tables.FINDINGS)
    for _ in range(2):
        tables.write_findings(findings, f"{tmp_path}/findings", "run1")
    tables.write_findings(findings.limit(1), f"{tmp_path}/findings", "run2")
    assert {r.run: r["count"] for r in spark.read.parquet(f"{tmp_path}/findings").groupBy("run").count().collect()} == {"run1": 2, "run2": 1}
    tables.write_csv(reports.report(findings, "raw").select("record", "value"), f"{tmp_path}/csv")
    lines = [row for f in glob.glob(f"{tmp_path}/csv/*.txt") for row in csv.reader(open(f, newline=""))]
    assert sorted(x for x in lines if x != ["record", "value"]) == [["r1", "'=1+1"], ["r2", 'say "x", y']]


def test_log_rows_and_expiry(spark):
    findings = spark.createDataFrame([("r1", "1", 1, None, None, 1, "single", "a", "format", "secret")], tables.FINDINGS)
    of = lambda mode: reports.log_rows(findings, mode, KEY, 7).collect()
    assert of("off") == [] and of("raw")[0].value == "secret" and of("none")[0].value is None
    assert of("hashed")[0].value == hmac.new(KEY + b"|7", b"secret", hashlib.sha256).hexdigest()
    assert of("none")[0].record == hmac.new(KEY + b"|7", b"r1", hashlib.sha256).hexdigest()
    assert reports.log_rows(findings, "none", None, 7).first().record is None and reports.log_rows(findings, "hashed", None, 7).first().value is None
    aged = findings.select("*", F.explode(F.array(F.lit(1), F.lit(9))).alias("found_at"))
    assert {r.found_at: r.value for r in reports.expire_values(aged, F.lit(5)).collect()} == {1: None, 9: "secret"}


def test_watch(spark, tmp_path):
    dictionary, _ = project()
    rows = C.contexts(C.from_long(spark.createDataFrame(CELLS, tables.CELLS), ["sid", "age"]), ["sid", "age"])
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    changes.watch(stream, [R.Rule("constraint", ("age",), asserts="[age]>='18'")], dictionary, lambda f, n: seen.extend(f.collect()), f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [(r._record, r._form, r.value) for r in seen] == [("r1", None, "9")]


def test_schemes(spark):
    own, none = identifiers.scheme("default"), identifiers.scheme(None)
    assert own.active and not none.active and identifiers.scheme(own) is own
    with pytest.raises(ValueError, match="unknown"):
        identifiers.scheme("nope")
    row = spark.createDataFrame([("0ABC/0000",)], "v string").select(own.append(F.col("v")).alias("a"), none.append(F.col("v")).alias("n"), own.validate(own.append(F.col("v"))).alias("ok"), own.validate(F.lit("0ABC0001X")).alias("bad")).first()
    assert tuple(row) == ("0ABC/0000-H", "0ABC/0000", True, False)
