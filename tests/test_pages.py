"""Folding of the conditions of a page: what stays live, what becomes a literal, true or false, and what is blocked."""

import pytest

from fieldwarden.functions.conditions import Compare, Constant, Literal, Ref, parse
from fieldwarden.operators import pages
from fieldwarden.operators import rules as R

PLACE = "_record string, _event string, _instance int, _form string, _dag string, a string, b string, secret string"
DICTIONARY = R.Dictionary({"a": "text", "b": "text", "secret": "text", "gone": "text"}, {"a": "page", "b": "other", "secret": "closed", "gone": "other"})
RIGHTS = {"page": "1", "other": "1", "closed": "0"}


@pytest.fixture(scope="module")
def contexts(spark):
    return spark.createDataFrame([("1", "1", 1, None, None, "x", "7", "s"), ("1", "1", 2, "page", None, "y", "9", "t"), ("2", "1", 1, None, None, None, None, None)], PLACE)


def folded(contexts, text, record="1", **k):
    page = pages.fold_rules(contexts, [R.Rule("required", ("a",), when=text), R.Rule("required", ("b",), when="[a]='z'")], DICTIONARY, "page", record, "1", rights=RIGHTS, **k)
    return page.folded[text], page.notes


def test_live_comparisons_stay(contexts):
    out, notes = folded(contexts, "[a]='x'")
    assert out.tree == parse("[a]='x'") and not notes and not (out.snapshot or out.frozen or out.blocked)


def test_values_of_other_forms_are_settled(contexts):
    out, notes = folded(contexts, "[b]>'8' or [a]='x'")
    assert out.tree.items == (Constant(False), parse("[a]='x'")) and out.snapshot and "as they were" in notes[0][1]
    assert folded(contexts, "[b]>'8'", instance=2)[0].tree == Constant(True)  # the instance's own value
    assert folded(contexts, "[b]>'8'", instance=3)[0].tree == Constant(False)  # no such instance yet: the base row
    assert folded(contexts, "[a]=[b]")[0].tree == Compare("=", Ref("a"), Literal("7"))


def test_values_that_may_not_be_shown(contexts):
    out, notes = folded(contexts, "[a]<>[secret]")
    assert out.tree == Constant(True) and out.frozen and "may not be shown" in notes[0][1]
    assert folded(contexts, "[a]=[b]", data_entry=False)[0].frozen  # a survey's page gets no value
    assert folded(contexts, "[secret]='s'")[0].tree == Constant(True)


def test_new_records_and_what_cannot_be_read(contexts):
    assert folded(contexts, "[b]='' and [a]='x'", None)[0].tree.items[0] == Constant(True)
    for text, record in (("[gone]='1'", "1"), ("[b]='7'", "missing")):
        out, notes = folded(contexts, text, record)
        assert out.tree == Constant(False) and out.blocked and "after saving" in notes[0][1]
    assert folded(contexts, "[b]=''", "2")[0].tree == Constant(True)


def test_each_condition_once_and_other_forms_left_out(contexts):
    rules = [R.Rule("required", ("a",), when="[b]='7'"), R.Rule("constraint", ("a",), when="[b]='7'", asserts="[a]>[b]"), R.Rule("required", ("b",), when="[secret]='s'"), R.Rule("required", ("a",), when="[b")]
    page = pages.fold_rules(contexts, rules, DICTIONARY, "page", "1", "1", rights=RIGHTS)
    assert list(page.folded) == ["[b]='7'", "[a]>[b]"] and [k for k, _ in page.notes] == [1, 2] and page.rules[2].dropped
    assert pages.fold_rules(contexts, [], DICTIONARY, "page", "1").folded == {}
