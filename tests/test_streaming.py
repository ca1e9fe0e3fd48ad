"""Streams of contexts against scans of all of them."""

import random

import pytest

from fieldwarden.operators import contexts as C
from fieldwarden.operators import rules as R
from fieldwarden.operators import scans
from fieldwarden.streaming import changes

EVENTS = C.Events({"1": {"base", "line"}, "2": {"base"}}, {("1", "line")})
DICTIONARY = R.Dictionary({"a": "text", "b": "text", "code": "text"}, {"a": "base", "b": "line", "code": "base"})
RULES = [R.Rule("constraint", ("a",), asserts="[a]>'3'"), R.Rule("required", ("b",)), R.Rule("unique", ("code",)), R.Rule("constraint", ("a",), asserts="[b]<>'1'"), R.Rule("unique", ("b",), when="[code]='x'")]
WIDE = "record string, event_id string, repeat_key string, instance int, dag string, a string, b string, code string"


def wide_rows(draw, n):
    rows = []
    for k in range(n):
        for event in ("1", "2"):
            rows.append((f"r{k}", event, None, 1, None, str(draw.randint(1, 6)), None, draw.choice(["x", "y", f"own{k}{event}", None])))
        rows += [(f"r{k}", "1", "line", i, None, None, draw.choice(["1", "2", None, " 2"]), None) for i in range(1, draw.randint(1, 4))]
    return rows


@pytest.mark.parametrize("batches", [1, 4])
def test_all_batches_give_what_a_scan_gives(spark, tmp_path, rows_of, batches):
    wide = spark.createDataFrame(wide_rows(random.Random(batches), 20), WIDE)
    rules = [r for r in RULES if r.asserts != "[b]<>'1'"]
    whole = scans.run_scan(wide, rules, DICTIONARY, EVENTS)
    found = C.contexts(wide, R.read_set(rules))
    found.repartition(batches).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write = lambda frame, number: frame.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
    changes.watch(stream, rules, DICTIONARY, write, f"{tmp_path}/state", EVENTS).awaitTermination()
    items = spark.read.parquet(f"{tmp_path}/out")
    columns = ["_record", "_event", "_instance", "_form", "_dag", "rule", "type", "field", "reason", "value"]
    assert rows_of(items.where("type <> 'problem'").select(columns)) == rows_of(whole.findings.select(columns))
    told = items.where("type = 'problem'").selectExpr("rule", "field", "reason as why").distinct()
    assert rows_of(told) == rows_of(whole.problems)
    assert items.where("type = 'unique'").count() > 3


def test_one_bad_base_value_is_one_finding(spark, tmp_path):
    rows = [("r", "1", None, 1, None, "1", None, "x")] + [("r", "1", "line", i, None, None, "2", None) for i in (1, 2)]
    found = C.contexts(spark.createDataFrame(rows, WIDE), ["a", "b"])
    found.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(found.schema).parquet(f"{tmp_path}/in")
    got = []
    changes.watch(stream, RULES[:1], DICTIONARY, lambda frame, n: got.extend(frame.collect()), f"{tmp_path}/state", EVENTS).awaitTermination()
    assert [(r._record, r._form, r.value) for r in got] == [("r", None, "1")]
    with pytest.raises(ValueError, match="no rule"):
        changes.watch(stream, [], DICTIONARY, print, f"{tmp_path}/other")


@pytest.mark.parametrize("rules,rights", [([], True), (RULES, {"base": "0", "line": "0"}), (RULES, None), (RULES, {"line": "1"})])
def test_scans_with_nothing_to_judge(spark, rules, rights):
    wide = spark.createDataFrame(wide_rows(random.Random(1), 3), WIDE)
    done = scans.run_scan(wide, rules, DICTIONARY, EVENTS, rights=rights)
    assert done.records == 3 and done.contexts > 3
    if rights != {"line": "1"}:
        assert done.findings.isEmpty()
    assert done.outcome == ("clean" if not rules else "blocked") and (done.problems.count() > 0) == bool(rules)


def test_scan_of_a_form_and_after_a_save(spark):
    wide = spark.createDataFrame(wide_rows(random.Random(2), 12), WIDE)
    rules = [R.Rule("constraint", ("a",), asserts="[a]>'3'"), R.Rule("required", ("b",), when="[code]='x'"), R.Rule("unique", ("code",)), R.Rule("required", ("b", "code"))]
    kinds = lambda s: {(r.rule, r.field) for r in s.findings.select("rule", "field").distinct().collect()}
    whole = scans.run_scan(wide, rules, DICTIONARY, EVENTS)
    assert kinds(scans.run_scan(wide, rules, DICTIONARY, EVENTS, form="base")) == {x for x in kinds(whole) if x[1] != "b"}
    one = scans.after_save(wide, rules, DICTIONARY, EVENTS, "r3", "base")
    assert one.records == 1 and {r._record for r in one.findings.collect()} <= {"r3"}
    assert kinds(one) <= {(1, "a"), (2, "b"), (4, "code")}
    expected = whole.findings.where("_record = 'r3' and (rule in (1, 2) or rule = 4 and field = 'code')").count()
    assert one.findings.count() == expected
