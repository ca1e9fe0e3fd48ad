"""Conversation structure repair: cheapest edits by a scan of min-plus matrices.

A repaired conversation has the role initials `(s?(ua)+)?`, which four states read: 0 the start, 1 behind s, 2 behind u, 3 behind a; it may
end in 0 or 3. Each turn is a 4x4 matrix whose entry (i, j) is the cheapest way from state i over this turn to state j: keep it (0), give
it the role user or assistant (2) or delete it (3, the only way for a blank or repeated turn), one more for a truncated turn that stays,
and behind it any number of inserted turns without text (2 each), the closure of the insertions. Entries are (cost, audit) with the
edits' initials as audit, added entry by entry and compared cost first, then audit; equal costs never have an audit that begins the other,
so that the product is associative. From a state only one of u and a may follow: the audit alone tells the repair.

Turns are dealt by ranges of (conversation, turn, role, digest of the text, row), so that a long conversation, or a turn that is repeated
very often, lies in many partitions. In a partition, conversations that lie inside it are reduced together, level by level as a tree,
and finished. Of the two at its borders the turns go on: what is repeated across partitions is found by an aggregation, the turns of
each partition become one matrix, and matrices are multiplied up a tree of groups of `FAN`. Then the turns of each such conversation
stream in order past its audit. A task keeps a conversation's turns only as far as they lie in its partition. What is kept of all of a conversation
is the 16 audits of a matrix (a character an edit); only the order of a digest of its whole text makes one task stream it.

Input: conv_id (any type that Spark orders), turn, role, text; other columns are ignored. Nulls of role and text are one space; a null turn
comes first; turns of one number are ordered by role and the text's digest. Conversations of null conv_id are one. An initial other than s, u or a can't
be kept, nor can an empty role. An empty table gives no rows. No turns, or none kept: an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from fieldwarden.session import parts_of, with_checkpoint_dir

#: Where an initial leads from each state; user and assistant are also what is inserted.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR, NOTHING = 1 << 40, "~"  # no way, and an audit behind all others
FAN = 16
#: White space of blank and truncated turns.
BLANK = " \t\n\x0b\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def times(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The products of n matrices with n others; each is (costs, audits) of shape (n, 4, 4)."""
    total = a[0][:, :, :, None] + b[0][:, None, :, :]
    cost = np.minimum(total.min(axis=2), FAR)
    audit = np.full(cost.shape, NOTHING, object)
    for k in range(4):
        m, i, j = np.nonzero((total[:, :, k, :] == cost) & (cost < FAR))
        audit[m, i, j] = np.minimum(audit[m, i, j], a[1][m, i, k] + b[1][m, k, j])
    return cost, audit


def _unit() -> tuple[np.ndarray, np.ndarray]:
    cost, audit = np.full((1, 4, 4), FAR, np.int64), np.full((1, 4, 4), NOTHING, object)
    for i in range(4):
        cost[0, i, i], audit[0, i, i] = 0, ""
    return cost, audit


def _insertions() -> tuple[np.ndarray, np.ndarray]:
    """Any number of insertions, the closure of one: powers are added until nothing gets cheaper."""
    one, out = tuple(x.copy() for x in _unit()), _unit()
    for name in NAMES:
        for i, j in STEPS[name].items():
            one[0][0, i, j], one[1][0, i, j] = INSERT, "I"
    while True:
        after = times(out, one)
        if (after[0] == out[0]).all():
            return out
        out = after


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The matrices of turns by 3 * initial (s, u, a, other) + fault (none, truncated, to be deleted), insertions behind them included."""
    costs, audits = [], []
    for initial in "sua?":
        for fault in range(3):
            cost, audit = np.full((1, 4, 4), FAR, np.int64), np.full((1, 4, 4), NOTHING, object)
            ways = [({i: i for i in range(4)}, DELETE, "D")]
            if fault < 2:
                ways += [(STEPS[n], REROLE + TRUNCATED * fault, "R") for n in NAMES] + [(STEPS.get(initial, {}), KEEP + TRUNCATED * fault, "K")]
            for steps, price, letter in ways:
                for i, j in steps.items():
                    if price < cost[0, i, j]:
                        cost[0, i, j], audit[0, i, j] = price, letter
            done = times((cost, audit), INSERTIONS)
            costs.append(done[0])
            audits.append(done[1])
    return np.concatenate(costs), np.concatenate(audits)


INSERTIONS = _insertions()
KINDS = _kinds()


def reduced(matrices: tuple[np.ndarray, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product of each owner's matrices, which lie one after another: neighbours are multiplied level by level, all owners at once."""
    cost, audit = matrices
    while True:
        n = np.arange(len(owner))
        opens = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
        if opens.all():
            return cost, audit
        even = (n - np.maximum.accumulate(np.where(opens, n, 0))) % 2 == 0
        left = np.flatnonzero(even[:-1] & ~opens[1:])
        cost, audit = cost.copy(), audit.copy()
        cost[left], audit[left] = times((cost[left], audit[left]), (cost[left + 1], audit[left + 1]))
        kept = np.delete(n, left + 1)
        cost, audit, owner = cost[kept], audit[kept], owner[kept]


def best(cost: np.ndarray, audit: np.ndarray) -> list[tuple[int, str]]:
    """Cost and audit of whole conversations from the products of their turns."""
    first = tuple(np.repeat(x, len(cost), axis=0) for x in INSERTIONS)
    cost, audit = times(first, (cost, audit))
    return [min((int(c[0, j]), a[0, j]) for j in (0, 3)) for c, a in zip(cost, audit, strict=True)]


class Applied:
    """Follows an audit along a conversation's turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self) -> str:
        name = next(n for n in NAMES if self.state in STEPS[n])
        self.state = STEPS[name][self.state]
        return NAMES[name]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands up to and with this turn in the repaired conversation."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._next(), text
        elif edit == "K":
            self.state = STEPS[role[0]][self.state]
            yield edit, role, text


class Digest:
    """Hashes repaired turns as `role:text`, joined by newlines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, turns: Iterable[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True


def _seen(rows: DataFrame) -> DataFrame:
    """What the scan needs of each turn; `gone` marks one that only tells that its conversation exists."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    letter = F.instr(F.lit("sua"), F.substring(role, 1, 1))
    last = F.right(F.rtrim(text, F.lit(BLANK)), F.lit(1))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("key"),
        F.when((role == "") | (letter == 0), 3).otherwise(letter - 1).cast("int").alias("letter"), (last == "").alias("blank"), (~last.isin(*".!?")).alias("open"), gone.alias("gone"),
    )


def _illegal(letters: np.ndarray) -> np.ndarray:
    """Whether each turn and the one before it are none of su, ua, au."""
    a, b = letters[:-1], letters[1:]
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


#: An element of the scan: the product of a run of turns and what is counted of it. All of it can be joined to the next run's.
ELEMENT = "turns long, blank long, duplicate long, truncated long, illegal long, first int, last int, low long, high long, distinct long, costs array<long>, audits array<string>"


def _elements(letters: np.ndarray, blank: np.ndarray, repeated: np.ndarray, opened: np.ndarray, turns: list[int | None], owner: np.ndarray) -> list[dict]:
    """One element for each owner, from turns that lie in order."""
    if not len(owner):
        return []
    repeated = repeated & ~blank
    cut = opened & ~blank & ~repeated
    kind = 3 * letters + np.where(blank | repeated, 2, cut)
    costs, audits = reduced((KINDS[0][kind], KINDS[1][kind]), owner)
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    ends = np.append(starts[1:], len(owner))
    bad = np.append(_illegal(letters) & (owner[1:] == owner[:-1]), False)
    sums = [np.add.reduceat(x.astype(np.int64), starts).tolist() for x in (blank, repeated, cut, bad)]
    out = []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        own = {t for t in turns[a:b] if t is not None}
        named = dict(zip(("blank", "duplicate", "truncated", "illegal"), (x[k] for x in sums), strict=True))
        ranged = {"first": int(letters[a]), "last": int(letters[b - 1]), "low": min(own, default=None), "high": max(own, default=None), "distinct": len(own)}
        out.append({"turns": b - a, **named, **ranged, "costs": costs[k].ravel().tolist(), "audits": audits[k].ravel().tolist()})
    return out


def _joined(parts: list[dict]) -> dict:
    """One element of several that follow one another."""
    parts = [p for p in parts if p["turns"]] or parts[:1]
    if len(parts) == 1:
        return parts[0]
    matrices = tuple(np.array([p[name] for p in parts], kind).reshape(-1, 4, 4) for name, kind in (("costs", np.int64), ("audits", object)))
    cost, audit = reduced(matrices, np.zeros(len(parts), np.int64))
    out = {name: sum(p[name] for p in parts) for name in ("turns", "blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += int(_illegal(np.array([[p["first"], p["last"]] for p in parts]).ravel())[1::2].sum())
    out["distinct"] -= sum(a["high"] is not None and a["high"] == b["low"] for a, b in zip(parts[:-1], parts[1:], strict=True))
    lows, highs = ([p[x] for p in parts if p[x] is not None] for x in ("low", "high"))
    return out | {"first": parts[0]["first"], "last": parts[-1]["last"], "low": min(lows, default=None), "high": max(highs, default=None), "costs": cost.ravel().tolist(), "audits": audit.ravel().tolist()}


EMPTY = {"turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None, "low": None, "high": None, "distinct": 0, "costs": _unit()[0].ravel().tolist(), "audits": _unit()[1].ravel().tolist()}


def _finished(elements: list[dict]) -> list[dict]:
    """The counts, cost and audit of whole conversations."""
    if not elements:
        return []
    matrices = tuple(np.array([e[name] for e in elements], kind).reshape(-1, 4, 4) for name, kind in (("costs", np.int64), ("audits", object)))
    found = best(*matrices)
    gaps = [0 if e["low"] is None else e["high"] - e["low"] + 1 - e["distinct"] for e in elements]
    return [{"gaps": g, **{n: e[n] for n in ("blank", "duplicate", "truncated", "illegal")}, "cost": c, "audit": a} for e, g, (c, a) in zip(elements, gaps, found, strict=True)]


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)])


def _scan(rows: DataFrame, out: str, give: Callable[..., Iterator[dict]]) -> DataFrame:
    """Finds the edits of all conversations. give(conversation's id, finding, turns) yields rows of schema `out`; turns is an iterator of (turn, role, text)."""
    spark = with_checkpoint_dir(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    seen = _seen(rows).withColumn("row", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "key", "row"]
    parts = parts_of(rows)
    seen = seen.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    turn = f"conv {kind}, pos long, turn long, role string, text string, key string, letter int, blank boolean, open boolean, gone boolean"
    first_schema, answers = _arrow(f"done array<struct<{out}>>, {turn}"), _arrow(f"done array<struct<{out}>>")
    turn_names = [n for n in first_schema.names if n != "done"]
    out_schema = _arrow(out)

    def inside(table: pa.Table) -> pa.Table:
        """The answers for conversations that are whole in this table."""
        here = table.filter(pa.compute.invert(table["gone"]))
        convs, roles, keys = (here[x].to_pylist() for x in ("conv", "role", "key"))
        letters, blank, opened = (here[x].to_numpy() for x in ("letter", "blank", "open"))
        turns = here["turn"].to_pylist()
        owner = np.cumsum(np.array([k > 0 and c != convs[k - 1] for k, c in enumerate(convs)], np.int64)) if convs else np.empty(0, np.int64)
        known, repeated = set(), np.zeros(len(convs), bool)
        for k, (c, what) in enumerate(zip(convs, zip(roles, keys, strict=True), strict=True)):
            if k and c != convs[k - 1]:
                known = set()
            repeated[k] = what in known
            known.add(what)
        found = _finished(_elements(letters, blank, repeated, opened, turns, owner))
        texts, done, starts = here["text"].to_pylist(), [], np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)]), len(owner)).tolist()
        for k, f in enumerate(found):
            a, b = starts[k], starts[k + 1]
            done.extend(give(convs[a], f, zip(turns[a:b], roles[a:b], texts[a:b], strict=True)))
        none = _finished([EMPTY])[0]
        every, some, last = table["conv"].to_pylist(), {convs[a] for a in starts[:-1]}, object()
        for c in every:
            if c != last and c not in some:
                done.extend(give(c, none, iter(())))
            last = c
        return pa.Table.from_pylist([{"done": done}], first_schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held, opening = TaskContext.get().partitionId() << 36, 0, [], True

        def border(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            for t in tables:
                places = pa.array(range(base + n, base + n + t.num_rows), pa.int64())
                n += t.num_rows
                columns = {**{x: t[x] for x in t.column_names}, "pos": places, "done": pa.nulls(t.num_rows, first_schema.field("done").type)}
                yield from pa.table([columns[x] for x in first_schema.names], schema=first_schema).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            convs = table["conv"].to_pylist()
            last = held[-1]["conv"][-1].as_py() if held else convs[0] if convs else None
            cuts = [k for k, c in enumerate(convs) if c != (convs[k - 1] if k else last)]
            if not cuts:
                held += [table] if convs else []
                continue
            before = [*held, table.slice(0, cuts[0])]
            if opening:
                yield from border(before)
                whole = table.slice(cuts[0], cuts[-1] - cuts[0])
            else:
                whole = pa.concat_tables([*before, table.slice(cuts[0], cuts[-1] - cuts[0])])
            opening, held = False, [table.slice(cuts[-1])]
            if whole.num_rows:
                yield from inside(whole).to_batches()
        yield from border(held)

    dealt = seen.mapInArrow(first, f"done array<struct<{out}>>, {turn}").checkpoint()
    inner = dealt.where("done is not null").select(F.inline("done"))
    edge = dealt.where("done is null").select(*turn_names)
    found = _edges(edge, kind, parts)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        rows = every()
        head = next(rows, None)

        while head is not None:
            following: list[dict] = []

            def turns() -> Iterator[tuple]:
                for r in rows:
                    if r["pos"] < 0:
                        following.append(r)  # noqa: B023
                        return
                    yield r["turn"], r["role"], r["text"]

            own = turns()
            made: list[dict] = []
            for x in give(head["conv"], head["found"], own):
                made.append(x)
                if len(made) >= 4096:
                    yield pa.RecordBatch.from_pylist(made, out_schema)
                    made = []
            for _ in own:  # what give() did not ask for
                pass
            if made:
                yield pa.RecordBatch.from_pylist(made, out_schema)
            head = following[0] if following else None

    tell = f"found struct<{', '.join(f'{c}: bigint' for c in COUNTS)}, audit: string>"
    heads = found.select("conv", F.lit(-1).cast("long").alias("pos"), F.struct(*COUNTS, "audit").alias("found"))
    told = edge.where("not gone").select("conv", "pos", F.lit(None).cast(tell.removeprefix("found ")).alias("found"), "turn", "role", "text")
    ordered = heads.unionByName(told, allowMissingColumns=True).repartition(parts, "conv").sortWithinPartitions("conv", "pos")
    return inner.unionByName(ordered.mapInArrow(stream, out))


def _edges(edge: DataFrame, kind: str, parts: int) -> DataFrame:
    """conv, counts, cost and audit of the conversations that lie at borders of partitions."""
    tail = ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
    schema, element, ended = f"conv {kind}, part long, {ELEMENT}", _arrow(f"conv {kind}, part long, {ELEMENT}"), _arrow(f"conv {kind}, {tail}")
    light = edge.drop("text")
    often = light.where("not gone and not blank").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min("pos").alias("at"), F.count("*").alias("n")).where("n > 1")
    same: Column = light.conv.eqNullSafe(often.c) & (light.role == often.r) & (light.key == often.k)
    light = light.join(often, same, "left").select("conv", "pos", "turn", "letter", "blank", "open", "gone", F.coalesce(F.col("pos") > F.col("at"), F.lit(False)).alias("repeated"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        here = table.filter(pa.compute.invert(table["gone"]))
        letters, blank, repeated, opened = (here[x].to_numpy() for x in ("letter", "blank", "repeated", "open"))
        made = _elements(letters, blank, repeated, opened, here["turn"].to_pylist(), np.zeros(here.num_rows, np.int64)) or [EMPTY]
        return pa.Table.from_pylist([{"conv": table["conv"][0].as_py(), "part": table["part"][0].as_py(), **made[0]}], element)

    def several(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "part": rows[0]["part"], **_joined(rows)}], element)

    def last(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], **_finished([_joined(rows)])[0]}], ended)

    elements = light.withColumn("part", F.shiftright("pos", 36)).groupBy("conv", "part").applyInArrow(one, schema)
    span = FAN
    while span < parts:
        elements = elements.groupBy("conv", F.floor(F.col("part") / span).alias("_run")).applyInArrow(several, schema)
        span *= FAN
    return elements.groupBy("conv").applyInArrow(last, f"conv {kind}, {tail}")


def audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def give(conv, found: dict, turns: Iterator[tuple]) -> Iterator[dict]:
        along, digest = Applied(found["audit"]), Digest()
        for _, role, text in turns:
            digest.add(along.turn(role, text))
        digest.add(along.inserted())
        yield {"conv_id": conv, **found, "repaired_sha256": digest.sha.hexdigest()}

    return _scan(rows, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string".replace(" bigint", " long"), give)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), turn (null for an inserted one), role, text and edit (K, R or I)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def give(conv, found: dict, turns: Iterator[tuple]) -> Iterator[dict]:
        along, place = Applied(found["audit"]), 0
        for turn, role, text in turns:
            for edit, new, said in along.turn(role, text):
                yield {"conv_id": conv, "place": place, "turn": None if edit == "I" else turn, "role": new, "text": said, "edit": edit}
                place += 1
        for edit, new, said in along.inserted():
            yield {"conv_id": conv, "place": place, "turn": None, "role": new, "text": said, "edit": edit}
            place += 1

    return _scan(rows, f"conv_id {kind}, place long, turn long, role string, text string, edit string", give)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of `conv_id:turn` modulo 20, nulls as one space: 0 drops a row (it stays, marked `gone`), 1 empties its text,
    2 takes its marks .!? away, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    draw, text = F.crc32(name) % 20, F.coalesce("text", space)
    made = rows.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (draw == 0).alias("gone"), F.when(draw == 3, 2).otherwise(1).alias("times"),
    )
    return made.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("time", "times")
