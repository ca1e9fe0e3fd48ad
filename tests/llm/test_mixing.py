import math
import random
import re
from fractions import Fraction

import duckdb
import pytest

from fieldwarden.llm import mixing as M
from fieldwarden.llm import queries


def brute_targets(sizes):
    """Reshares the excess by weight, round by round. sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(1 + k % 3) for k, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (held | share).items()}
        held |= {s: Fraction(3 * sizes[s]) for s in over}


def check(rows, docs):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, total, taken = brute_targets(sizes), sum(sizes.values()), {}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    block = max(1, math.ceil(total / M.BLOCKS))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * block, (s, taken[s], want[s])


def test_targets_sizes_and_takes(spark):
    random.seed(9)
    sources = ["b", "a", "Z", "é", None, "tiny", "huge"]
    docs = [(k, " ".join(["w"] * random.randint(0, 60)), random.choice(sources[:5])) for k in range(400)]
    docs += [(1000, "just three words here", "tiny"), (1001, None, "a"), (1002, "", "tiny")] + [(2000 + k, "x y\tz\n" * 40, "huge") for k in range(200)] + [(5, "twice a", "a")] * 3
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, source string, target double")
    got = M.mix(frame).collect()
    check(got, docs)
    again = M.mix(frame.repartition(3)).collect()
    key = lambda r: (r.doc_id, str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    for r in got:
        assert sum(r.quotas) <= r.target + 1 and len(r.quotas) == M.SHARDS
        assert sum(r.by_shard) == r.taken and min(r.by_shard) >= 0


@pytest.mark.parametrize("docs", [[], [(1, None, "a")], [(1, "one", None)], [(1, "one two", "a"), (2, "", "b")]])
def test_few_rows(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = M.mix(frame).collect()
    assert len(rows) == len(docs)
    if sum(r.size for r in rows):
        check(rows, docs)


def test_large_blocks_choose_whole_blocks(spark):
    docs = [(k, "w " * 10, "s" + str(k % 3)) for k in range(300)]
    got = M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), blocks=60).collect()
    assert sum(sum(r.quotas) for r in {r.source: r for r in got}.values()) == 60
    shards = [sum(r.quotas[k] for r in {r.source: r for r in got}.values()) for k in range(M.SHARDS)]
    assert max(shards) - min(shards) <= 1
    assert sum(r.taken for r in got) == 3000
    for name in ("s0", "s1", "s2"):  # a shard takes its quota of whole blocks of each source
        own = [r for r in got if r.source == name]
        block = math.ceil(3000 / 60)
        assert [sum(r.by_shard[k] for r in own) for k in range(M.SHARDS)] == [q * block for q in own[0].quotas]


def brute_quotas(targets, house):
    """Sainte-Laguë seat by seat."""
    order, won = sorted(targets), dict.fromkeys(targets, 0)
    for _ in range(house):
        best = max(order, key=lambda s: targets[s] / (2 * won[s] + 1))
        won[best] += 1
    return won


def test_quotas_as_seat_by_seat(spark):
    random.seed(3)
    sizes = {f"s{k:03d}": int(random.paretovariate(0.7) * 40) for k in range(150)}
    docs = [(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())]
    rows = M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), blocks=700).collect()
    total = sum(sizes.values())
    seats = math.ceil(total / math.ceil(total / 700))
    for shard in range(M.SHARDS):
        want = brute_quotas({r.source: r.target for r in rows}, seats * (shard + 1) // M.SHARDS)
        assert {r.source: sum(r.quotas[: shard + 1]) for r in rows} == want


def test_many_sources(spark):
    rows = M.mix(spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 7 as int)) as text", "concat('s', id % 3000) as source")).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    assert len(rows) == 6000 and all(math.isclose(r.target, want[r.source], abs_tol=1e-6) for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(sum(sizes.values()), rel=0.01)


def test_clashing_columns_and_ids_of_text(spark):
    names = ["_id", "_null", "_text", "a.b", "row", "key", "taken", "share", "size"]
    schema = "doc_id string, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = [(f"d{k}", "w " * (k % 5), f"s{k % 3}", *[f"{n}{k}" for n in names]) for k in range(60)] + [(None, "no id", "s1", *names)] * 2
    got = M.copies(spark.createDataFrame(docs, schema))
    assert got.columns == ["doc_id", "text", "source", *names]
    assert {tuple(r) for r in got.collect()} <= set(docs) and got.where("text = ''").count() == 12


def test_a_very_long_text_and_rows_without_ids(spark):
    docs = [(1, "word " * 300_000, "a"), (2, "x", "b")] + [(None, f"text {k}", "a") for k in range(50)]
    rows = M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    check(rows, docs)
    assert max(r.size for r in rows) == 300_000


def test_no_python_in_the_plan(spark):
    plan = queries.op2_source_mix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, source, size, source_size, target, taken, by_shard FROM ({M.SQL})").fetchall())
    assert sorted(map(tuple, queries.op2_source_mix(spark, sf).collect())) == want
