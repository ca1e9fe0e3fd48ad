import random
import re

import pytest

from fieldwarden.llm import pii
from fieldwarden.llm import pii as P
from fieldwarden.llm import queries

KEY = b"test key"
names = pii.Pseudonyms(KEY)


def luhn_ok(v):
    d = re.sub(r"\D", "", v)
    return pii.luhn_digit(d[:-1]) == d[-1]


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection_without_fixed_points(n):
    p = pii.Permutation(KEY, "t", n)
    image = [p.shift(x) for x in range(n)]
    assert sorted(image) == list(range(n))
    assert all(x != y for x, y in enumerate(image))
    assert [p.shift(y, -1) for y in image] == list(range(n))


@pytest.mark.parametrize(
    ("kind", "value"),
    [
        ("card", "4111111111111111"), ("card", "4111 1111 1111 1111"), ("card", "3782-822463-10005"), ("email", "jo.doe7+x@mail.example.com"),
        ("ip", "192.168.0.17"), ("date", "1984-02-29"), ("date", "3.11.1999"), ("date", "11/30/2001"), ("date", "30/11/2001"), ("ssn", "219-09-9999"),
        ("phone", "+1 (938) 555-1226"), ("phone", "(415) 555-2671"), ("phone", "+49 30 901820"), ("iban", "DE89370400440532013000"), ("iban", "GB29 NWBK 6016 1331 9268 19"),
    ],
)
def test_each_format(kind, value):
    text = f"Before {value} after, and again: {value}."
    new, spans = names.replace(text)
    assert [s[0] for s in spans] == [kind, kind] and [text[a:b] for _, a, b in spans] == [value, value]
    assert value not in new and new.startswith("Before ") and " after, and again: " in new
    a, b = re.fullmatch(r"Before (.*) after, and again: (.*)\.", new).groups()
    assert a == b
    if kind not in ("ip", "date"):
        assert re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", a))) == re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", value)))
    again, found = names.replace(new)
    assert [s[0] for s in found] == [kind, kind]  # the pseudonym is valid in its format
    assert pii.reveal(new, KEY) == text
    if kind == "card":
        assert luhn_ok(a)


@pytest.mark.parametrize(
    "text",
    ["", "plain", "4111111111111112", "999.1.1.1", "2023-02-30", "666-12-1234", "version 3.", "x4111111111111111", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "1.2.3.4.5", "DE89370400440532013001"],
)
def test_left_alone(text):
    assert names.replace(text) == (text, [])


def test_dates_round_trip():
    random.seed(2)
    for _ in range(300):
        y, m, d = random.randint(1900, 2099), random.randint(1, 12), random.randint(1, 28)
        for v in (f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{d:02d}/{m:02d}/{y}", f"{m:02d}/{d:02d}/{y}"):
            assert pii.reveal(names.replace(v)[0], KEY) == v


def test_neighbours_are_found_apart():
    text = "4111111111111111 +1 (938) 555-1226 10.0.0.1 4012888888881881"
    assert [s[0] for s in names.replace(text)[1]] == ["card", "phone", "ip", "card"]


def test_other_key_other_pseudonym():
    assert names.replace("4111111111111111")[0] != pii.Pseudonyms(b"other").replace("4111111111111111")[0]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "call +1 (938) 555-1226", 1), (1, "call +1 (938) 555-1226", 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, spans int")
    rows = pii.found(docs, KEY).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in rows) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    assert {r.text for r in rows if r.doc_id == 2} == {None}
    kept = pii.apply(docs, KEY)
    assert kept.columns == docs.columns and sorted(r.spans for r in kept.collect()) == [1, 1, 2, 3]
    assert pii.found(docs.limit(0), KEY).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("BE68 5390 0754 7034 2 May", [("iban", "BE68 5390 0754 7034")]), ("BE68 5390 0754 7034 BIC", [("iban", "BE68 5390 0754 7034")]),
        ("AT61 1904 3002 3457 3201 BIC GIBA", [("iban", "AT61 1904 3002 3457 3201")]), ("ID42 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
        ("+1 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]), ("+49 30 901820 2024 1234 12", [("phone", "+49 30 901820 2024")]),
        ("at 2024-03-05T10:00:00Z", [("date", "2024-03-05")]), ("on 2024/03/05, noon", [("date", "2024/03/05")]), ("2024-03-05Txt 2024/03/05/7", []),
    ],
)
def test_values_beside_what_looks_like_more(text, want):
    new, spans = names.replace(text)
    assert [(k, text[a:b]) for k, a, b in spans] == want
    assert all(v not in new for _, v in want) and len(new) == len(text)
    assert pii.reveal(new, KEY) == text


def test_large_ids_long_texts_and_clashing_columns(spark):
    big = 9007199254740993
    card = "4111 1111 1111 1111"
    docs = [(None, "none", "s"), (big, f"{'word ' * 200_000}{card}", "s"), (big + 2, card, "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in P.found(frame, b"key").collect()}
    assert set(got) == {None, big, big + 2} and got[big].text.endswith(got[big + 2].text) and got[big + 2].text != card
    assert [(s.kind, s.start, s.end) for s in got[big].spans] == [("card", 1_000_000, 1_000_019)]
    names = ["_id", "a.b", "spans"]
    kept = P.apply(spark.createDataFrame([("d1", card, *names)], "doc_id string, text string, _id string, `a.b` string, spans string"), b"key")
    assert kept.columns == ["doc_id", "text", *names] and tuple(kept.first())[2:] == tuple(names) and kept.first().text == got[big + 2].text


def test_names_in_other_letters():
    names = P.Pseudonyms(b"key")
    for mail in ("ü@example.org", "Žofie@example.org", "иван.петров@example.org", "李@example.org"):
        new = names.replace(mail)[0]
        assert new != mail and new.endswith("@example.org") and len(new) == len(mail) and P.reveal(new, b"key") == mail


# Plain forms of values that stand alone between spaces and marks, and how a reader would check them.
PLAIN = {
    "email": (r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", lambda v: True),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"),
    "card": (r"(?:[0-9]{4} ){3}[0-9]{4}|[0-9]{16}", lambda v: sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(re.sub(r"\D", "", v))) % 10 == 0),
    "ip": (r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", lambda v: all(x == str(int(x)) and int(x) < 256 for x in v.split("."))),
}


def test_all_documents(spark):
    """The query's rows for a whole table: every plainly written value has gone, the same value has one pseudonym everywhere and no two share one, all
    else stands as it was, and whoever holds the key gets every text back."""
    sf = "/root/testdata/sf0.01"
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = P.found(spark.read.parquet(f"{sf}/documents.parquet"), queries.PII_KEY).collect()
    asked = {r.doc_id: r.text for r in queries.op6_pii_pseudonyms(spark, sf).select("doc_id", "text").collect()}
    assert sorted(given) == sorted(r.doc_id for r in rows) and asked == {r.doc_id: r.text for r in rows}
    to, back, seen = {}, {}, 0
    for r in rows:
        old, shift, at, inside = given[r.doc_id], 0, 0, set()
        for s in r.spans:
            assert old[at : s.start] == r.text[at + shift : s.start + shift]
            at, rest = s.end, old[s.end :]
            following = next((x for x in r.spans if x.start >= s.end), None)
            tail = rest if following is None else old[s.end : following.start]
            end = len(r.text) - len(tail) if following is None else r.text.index(tail, s.start + shift) if tail else s.end + shift
            new = r.text[s.start + shift : end]
            shift = end - s.end
            key = (s.kind, old[s.start : s.end])
            assert to.setdefault(key, new) == new and back.setdefault((s.kind, new), key[1]) == key[1] and new != key[1]
            inside.add((s.kind, key[1]))
        assert (old or "")[at:] == (r.text or "")[at + shift :]
        for kind, (pattern, valid) in PLAIN.items():
            for m in re.finditer(rf"(?<![^\s(,;:])(?:{pattern})(?=[\s,;)]|\Z)", old or "", re.ASCII):
                if valid(m[0]):
                    seen += 1
                    assert any(m[0] in v for _, v in inside), (r.doc_id, kind, m[0])
        assert old is None or P.reveal(r.text, queries.PII_KEY) == old
    assert seen > 50 and len(to) > 50
