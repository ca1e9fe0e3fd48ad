import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from fieldwarden.llm import conversations as C
from fieldwarden.llm import queries
from fieldwarden.session import table
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "[^\x20\x09-\x0d]"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        marks = re.findall(SPACE, text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def apply(rows, found, audit):
    """Cost and roles of an audit, None where it can't be done. What R and I become is tried in all ways."""
    ways = [(0, [])]
    turns = iter(zip(rows, found))
    for letter in audit:
        row, fault = next(turns) if letter != "I" else (None, "")
        extra = (fault == "truncated") * (letter != "D")
        new = []
        for cost, kept in ways:
            if letter == "D":
                new.append((cost + 3, kept))
            elif letter == "I":
                new += [(cost + 2, [*kept, (r, "")]) for r in ("user", "assistant")]
            elif fault not in ("blank", "duplicate"):
                new += [(cost + extra, [*kept, (row[2], row[3])])] if letter == "K" else [(cost + 2 + extra, [*kept, (r, row[3])]) for r in ("user", "assistant")]
        ways = [w for w in new if re.match("^(s?(ua)*u?)$", "".join(r[:1] or "?" for r, _ in w[1]))]
    ways = [w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in w[1]))]
    return min(ways) if ways else None


def summary(rows, audit, cost, kept):
    found = faults(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{n: found.count(n) for n in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def forward(rows):
    """The cheapest repair by a plain pass over turns and states with whole audits; the reference for longer conversations."""
    found = faults(rows)
    leads = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def spread(best):
        for _ in range(3):
            for q, (cost, audit, kept) in list(best.items()):
                for r in ("user", "assistant"):
                    if (to := leads.get((q, r[0]))) is not None:
                        best[to] = min(best.get(to, (1e9,)), (cost + 2, audit + "I", (*kept, (r, ""))))
        return best

    best = spread({0: (0, "", ())})
    for (_, _, role, text), fault in zip(rows, found):
        new = {}
        for q, (cost, audit, kept) in best.items():
            tries = [(q, cost + 3, "D", kept)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                tries += [(leads.get((q, role[:1])), cost + more, "K", (*kept, (role, text)))] + [(leads.get((q, r[0])), cost + 2 + more, "R", (*kept, (r, text))) for r in ("user", "assistant")]
            for to, c, letter, k in tries:
                if to is not None:
                    new[to] = min(new.get(to, (1e9,)), (c, audit + letter, k))
        best = spread(new)
    cost, audit, kept = min(best[q] for q in (0, 3) if q in best)
    return summary(rows, audit, cost, kept)


def exhaustive(rows):
    """Every audit with up to as many insertions as can pay."""
    found, tried = faults(rows), []
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            if (done := apply(rows, found, audit)) is not None:
                tried.append((done[0], audit, done[1]))
    cost, audit, kept = min(tried)
    return summary(rows, audit, cost, kept)


def result(frame):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


def some_rows(seed, conversations, most):
    draw = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "Why?", "so it is!", "a b ", "…", None]
    return [(c, draw.choice([t, t, t, t + draw.randrange(3), None]), draw.choice(["user", "assistant", "system", "user", "tool", "", None]), draw.choice(texts) if draw.random() < 0.6 else f"{draw.random()}.") for c in range(conversations) for t in range(draw.randint(1, most))]


def ordered(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    return {c: sorted(own, key=key) for c, own in by.items()}


def test_short_conversations_by_all_audits(spark):
    rows = some_rows(3, 60, 3)
    found = result(C.audit(spark.createDataFrame(rows, SCHEMA)))
    plain = ordered([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert len(found) == 60
    for c, own in plain.items():
        assert found[c] == exhaustive(own) == forward(own), own


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_long_conversations_over_partitions(spark, parts, monkeypatch):
    monkeypatch.setattr(C, "parts_of", lambda frame: parts)
    monkeypatch.setattr(C, "FAN", 3)
    rows = some_rows(parts, 40, 9) + [(99, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 70}{'.' * (t % 3)}") for t in range(700)]
    rows += [(98, 5, "user", "again and again")] * 300 + [(None, None, None, None), (None, 3, "user", "Of no id.")]
    found = result(C.audit(C.damage(spark.createDataFrame(rows, SCHEMA).repartition(5))))
    plain = ordered(damaged(rows))
    assert set(found) == {r[0] for r in rows}
    for c in found:
        assert found[c] == forward(plain.get(c, [])), c


def test_dropped_conversations_stay(spark):
    gone = [c for c in range(2000) if zlib.crc32(f"{c}:7".encode()) % 20 == 0][:5]
    found = result(C.audit(C.damage(spark.createDataFrame([(c, 7, "user", "Hm.") for c in gone], SCHEMA))))
    assert found == {c: {**dict.fromkeys(C.COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} for c in gone}


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found, plain = result(queries.op11_conversation_repair(spark, SF)), ordered(damaged(rows))
    assert set(found) == {r[0] for r in rows}
    assert all(found[c] == forward(plain.get(c, [])) for c in found)
    assert sum(f["cost"] > 0 for f in found.values()) > 5


@pytest.mark.parametrize("parts", [1, 7])
def test_repaired_turns(spark, parts, monkeypatch):
    monkeypatch.setattr(C, "parts_of", lambda frame: parts)
    rows = some_rows(8, 30, 8)
    frame = spark.createDataFrame(rows, SCHEMA)
    turns, told = C.repair(frame).orderBy("conv_id", "place").collect(), result(C.audit(frame))
    by = {c: [t for t in turns if t.conv_id == c] for c in told}
    for c, own in by.items():
        assert [t.place for t in own] == list(range(len(own)))
        assert "".join(t.edit for t in own) == told[c]["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == told[c]["repaired_sha256"]
        assert all((t.turn is None and t.text == "") for t in own if t.edit == "I")


def test_other_columns_and_empty_tables(spark):
    wide = spark.createDataFrame([("x", 1, "user", "Hi.", "p", 1, "q")], "conv_id string, turn int, role string, text string, key string, pos int, `a.b` string")
    assert [(r.conv_id, r.audit, r.cost) for r in C.audit(wide).collect()] == [("x", "KI", 2)]
    assert C.audit(wide.limit(0)).count() == 0 and C.repair(wide.limit(0)).count() == 0


def test_products_are_associative():
    draw = np.random.default_rng(4)
    for _ in range(50):
        a, b, c = ((C.KINDS[0][k], C.KINDS[1][k]) for k in draw.integers(0, 12, (3, 20)))
        left, right = C.times(C.times(a, b), c), C.times(a, C.times(b, c))
        assert (left[0] == right[0]).all() and (left[1] == right[1]).all()
