"""Registered queries of the validation engine and the SQL that checks them.

The tables stand in for records: an order is a record with its line items as repeat instances, a nation is a group, an event
number is the offset of a change log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwarden.functions import comparison, identifiers, text
from fieldwarden.operators import access, contexts, incremental, pooled, reports, rollups, scans
from fieldwarden.operators import rules as R
from fieldwarden.session import parts_of, table, with_checkpoint_dir
from fieldwarden.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _rows(frame: DataFrame, record: Column, event: Column | str = "1", dag: Column | None = None, **fields: Column) -> DataFrame:
    """Contexts of a flat table: each row the base row of a record."""
    place = [record.cast("string").alias("_record"), (F.lit(event) if isinstance(event, str) else event).cast("string").alias("_event"), F.lit(1).alias("_instance")]
    group = (F.lit(None) if dag is None else dag).cast("string").alias("_dag")
    return frame.select(*place, F.lit(None).cast("string").alias("_form"), group, *[c.cast("string").alias(n) for n, c in fields.items()])


def _dictionary(frame: DataFrame, **types: str) -> R.Dictionary:
    return R.Dictionary({c: "text" for c in frame.columns if c not in R.META} | types)


def _short(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("_record").alias("record"), "rule", "type", "field", "reason", "value")


# --- check characters: every algorithm over identifiers of eight characters --------------------------------------------

_D = "substr(p, {i}, 1)::INTEGER"
_A = "(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(p, {i}, 1)) - 1)"


def _chain(step: str, start: str, order=range(1, 9)) -> str:
    """The eight steps of a recurrence, one in the other. step has {a} for what came before, {i} the position, {k} the turn."""
    out = start
    for k, i in enumerate(order):
        out = step.replace("{a}", f"({out})").replace("{i}", str(i)).replace("{k}", str(k))
    return out


def _sum(weights) -> str:
    return "(" + " + ".join(f"{w} * {_D.format(i=i)}" for i, w in enumerate(weights, 1)) + ")"


def _hybrid_sql(m: int, digit: str) -> str:
    last = _chain(f"((({{a}} + {m - 1}) % {m} + 1) * 2 % {m + 1} + {digit} % {m}) % {m}", str(m // 2))
    return f"((1 - (({last} + {m - 1}) % {m} + 1) * 2 % {m + 1}) % {m} + {m}) % {m}"


_VERHOEFF_POWERS = [list(range(10))]
for _ in range(7):
    _VERHOEFF_POWERS.append([identifiers.VERHOEFF[x] for x in _VERHOEFF_POWERS[-1]])
_PRODUCT = "".join(str(identifiers.dihedral(a, b)) for a in range(10) for b in range(10))
_POWER = "".join(str(x) for row in _VERHOEFF_POWERS for x in row)
_ALNUM = identifiers.ALNUM
_DOUBLED = " + ".join(f"(CASE WHEN {_D.format(i=i)} > 4 THEN 2 * {_D.format(i=i)} - 9 ELSE 2 * {_D.format(i=i)} END)" if i % 2 == 0 else _D.format(i=i) for i in range(1, 9))
CHECK_SQL = {
    "iso7064_mod11_2": f"substr('0123456789X', ((1 - {_sum([2 ** (9 - i) for i in range(1, 9)])}) % 11 + 11) % 11 + 1, 1)",
    "iso7064_mod37_2": "substr('" + _ALNUM + "*', ((1 - (" + " + ".join(f"{2 ** (9 - i)} * {_A.format(i=i)}" for i in range(1, 9)) + ")) % 37 + 37) % 37 + 1, 1)",
    "iso7064_mod97_10": "lpad((98 - p::BIGINT * 100 % 97)::VARCHAR, 2, '0')",
    "iso7064_mod11_10": f"({_hybrid_sql(10, _D)})::VARCHAR",
    "iso7064_mod37_36": f"substr('{_ALNUM}', {_hybrid_sql(36, _A)} + 1, 1)",
    "iso7064_letters1": f"substr('{identifiers.LETTERS}', {_hybrid_sql(26, _A)} + 1, 1)",
    "iso7064_letters2": f"substr('ABCDEF', ({_hybrid_sql(36, _A)}) // 6 + 1, 1) || substr('ABCDEF', ({_hybrid_sql(36, _A)}) % 6 + 1, 1)",
    "damm": _chain(f"substr('{''.join(identifiers.DAMM)}', {{a}} * 10 + {_D} + 1, 1)::INTEGER", "0") + "::VARCHAR",
    "verhoeff": "substr('0432156789', " + _chain(f"substr('{_PRODUCT}', {{a}} * 10 + substr('{_POWER}', ({{k}} + 1) % 8 * 10 + {_D} + 1, 1)::INTEGER + 1, 1)::INTEGER", "0", range(8, 0, -1)) + " + 1, 1)",
    "luhn": f"((10 - ({_DOUBLED}) % 10) % 10)::VARCHAR",
    "gs1_mod10": f"((10 - {_sum([1, 3] * 4)} % 10) % 10)::VARCHAR",
    "aba_mod10": f"((10 - {_sum([3, 7, 1, 3, 7, 1, 3, 7])} % 10) % 10)::VARCHAR",
    "mrz_mod10": f"({_sum([7, 3, 1, 7, 3, 1, 7, 3])} % 10)::VARCHAR",
    "weighted_mod11": f"substr('0123456789X', (11 - {_sum(range(9, 1, -1))} % 11) % 11 + 1, 1)",
    "none": "''",
}
_LETTERED = ("iso7064_mod37_2", "iso7064_mod37_36", "iso7064_letters1", "iso7064_letters2")


def _payload(algorithm: str) -> Column:
    key = F.col("o_orderkey").cast("string")
    return F.concat(F.substr(F.upper("o_orderpriority"), F.lit(3), F.lit(2)), F.lpad(key, 6, "0")) if algorithm in _LETTERED else F.lpad(key, 8, "0")


def _payload_sql(algorithm: str) -> str:
    return "substr(upper(o_orderpriority), 3, 2) || lpad(o_orderkey::VARCHAR, 6, '0')" if algorithm in _LETTERED else "lpad(o_orderkey::VARCHAR, 8, '0')"


def _append(algorithm: str) -> None:
    @query(f"{algorithm}_append", f"SELECT o_orderkey, p || {CHECK_SQL[algorithm]} AS id FROM (SELECT o_orderkey, {_payload_sql(algorithm)} AS p FROM orders)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "orders").select("o_orderkey", identifiers.append_check(algorithm, _payload(algorithm), strip="").alias("id"))

    @query(f"{algorithm}_validate", f"SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 OR {algorithm == 'none'} AS valid FROM orders")
    def check(spark: SparkSession, sf_dir: str) -> DataFrame:
        # every fifth identifier has the next check character in place of its last one, every seventh a letter in its middle that no number stands for
        whole, letters = identifiers.append_check(algorithm, _payload(algorithm), strip=""), identifiers.ALGORITHMS[algorithm][1]
        next_one = F.translate(F.right(whole, F.lit(1)), letters, letters[1:] + letters[:1]) if letters else F.right(whole, F.lit(1))
        wrong = F.concat(F.left(whole, F.length(whole) - 1), next_one)
        broken = F.when(F.col("o_orderkey") % 5 == 0, wrong).when(F.col("o_orderkey") % 7 == 0, F.concat(F.left(whole, F.lit(4)), F.lit("?"), F.substr(whole, F.lit(5)))).otherwise(whole)
        return table(spark, sf_dir, "orders").select("o_orderkey", identifiers.validate_id(algorithm, broken).alias("valid"))


for _name in identifiers.ALGORITHMS:
    _append(_name)


def _luhn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a Luhn identifier; every seventh has the next digit in place of its check digit."""
    orders = table(spark, sf_dir, "orders")
    payload = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    check = identifiers.check_characters("luhn", payload)
    wrong = ((check.cast("int") + 1) % 10).cast("string")
    ident = F.concat(payload, F.when(F.col("o_orderkey") % 7 == 0, wrong).otherwise(check))
    return _rows(orders, F.col("o_orderkey"), ident=ident, status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))


_LUHN = CHECK_SQL["luhn"]


@query(
    "luhn_validate_findings",
    f"""SELECT o_orderkey::VARCHAR AS record, 1 AS rule, 'single' AS type, 'ident' AS field, 'check-character' AS reason,
        p || (({_LUHN}::INTEGER + 1) % 10)::VARCHAR AS value
        FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS p FROM orders) WHERE o_orderkey % 7 = 0""",
)
def luhn_validate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _luhn_orders(spark, sf_dir)
    return _short(R.scan(rows, [R.Rule("single", ("ident",), algorithm="luhn")], _dictionary(rows))[0])


@query(
    "suggested_check",
    f"SELECT o_orderkey::VARCHAR AS record, {_LUHN} AS ends_in FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS p FROM orders) WHERE o_orderkey % 7 = 0",
)
def suggested_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _luhn_orders(spark, sf_dir)
    return rows.where(~identifiers.validate_id("luhn", F.col("ident"))).select(F.col("_record").alias("record"), identifiers.suggestion("luhn", F.col("ident")).alias("ends_in"))


@query(
    "normalize_ids",
    """SELECT c_custkey, replace(replace(upper(c_name), '#', ''), '-', '') AS plain, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits,
       regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS last_run, regexp_replace(upper(c_name), '[^A-Z]', '', 'g') AS letters FROM customer""",
)
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", identifiers.normalize(F.replace(name, F.lit("-"), F.lit("–")), "#-").alias("plain"), identifiers.apply_source(name, "digits_only").alias("digits"),
        identifiers.apply_source(name, "sequence_only").alias("last_run"), identifiers.normalize(name, "", keep_only=identifiers.LETTERS).alias("letters"),
    )


@query(
    "single_format",
    """SELECT c_custkey::VARCHAR AS record, 1 AS rule, 'single' AS type, 'name' AS field, 'format' AS reason, v AS value
       FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN c_name || 'x' ELSE c_name END AS v FROM customer)
       WHERE NOT regexp_full_match(upper(trim(v)), 'CUSTOMER#[0-9]+')""",
)
def single_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 11 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    rows = _rows(table(spark, sf_dir, "customer"), F.col("c_custkey"), name=name)
    return _short(R.scan(rows, [R.Rule("single", ("name",), algorithm="none", pattern="^CUSTOMER#[0-9]+$")], _dictionary(rows))[0])


# --- pooled identifiers ---------------------------------------------------------------------------------------------

_POOL = pooled.Pool("luhn", strip="", lengths=(9,))


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order, the Luhn identifiers of its line items run together; every fifth ends in junk, every seventh repeats its first."""
    payload = F.lpad((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), 8, "0")
    ids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", identifiers.append_check("luhn", payload).alias("id"))
    grouped = ids.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "id"))).alias("s"))  # an order's lines
    joined = F.array_join(F.transform("s", lambda x: x["id"]), " ")
    value = F.concat(joined, F.when(F.col("l_orderkey") % 5 == 0, "ZZ").otherwise(""), F.when(F.col("l_orderkey") % 7 == 0, F.get("s", 0)["id"]).otherwise(""))
    return grouped.select(F.col("l_orderkey").alias("o"), value.alias("pool"), F.size("s").alias("lines"))


_EXACT = f"""WITH ids AS (SELECT o, n, p || {_LUHN} AS id FROM (SELECT l_orderkey AS o, l_linenumber AS n, lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 8, '0') AS p FROM lineitem))"""


#: An ID repeats in a pool where its first is repeated, and where an order has two items of one line number.
_POOL_REPEATS = "(l_orderkey % 7 = 0 OR count(*) > count(DISTINCT l_linenumber))"
_POOL_REASON = f"concat_ws(';', CASE WHEN l_orderkey % 5 = 0 THEN 'junk' END, CASE WHEN {_POOL_REPEATS} THEN 'duplicate' END)"


@query(
    "pooled_counts",
    f"""SELECT l_orderkey AS o, (count(*) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END)::INTEGER AS ids, {_POOL_REASON} AS reason
       FROM lineitem GROUP BY l_orderkey""",
)
def pooled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _pools(spark, sf_dir).withColumn("cut", pooled.segments(F.col("pool"), _POOL))
    return cut.select("o", F.size(F.filter("cut", lambda s: s["type"] == "id")).alias("ids"), pooled.reasons(F.col("cut"), _POOL).alias("reason"))


@query(
    "pooled_segments",
    _EXACT + """SELECT o, string_agg('id ' || id, '|' ORDER BY n, id) || CASE WHEN o % 5 = 0 THEN '|junk ZZ' ELSE '' END
       || CASE WHEN o % 7 = 0 THEN '|id ' || min_by(id, (n, id)) ELSE '' END AS cut FROM ids GROUP BY o""",
)
def pooled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pools: of each piece its type and text, in order."""
    cut = pooled.segments(F.col("pool"), _POOL)
    return _pools(spark, sf_dir).select("o", F.array_join(F.transform(cut, lambda s: F.concat(s["type"], F.lit(" "), s["text"])), "|").alias("cut"))


@query(
    "pooled_findings",
    f"""SELECT l_orderkey::VARCHAR AS record, 1 AS rule, 'pooled' AS type, 'pool' AS field, {_POOL_REASON} AS reason
       FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 5 = 0 OR {_POOL_REPEATS}""",
)
def pooled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(_pools(spark, sf_dir), F.col("o"), pool=F.col("pool"))
    return _short(R.scan(rows, [R.Rule("pooled", ("pool",), algorithm="luhn", strip="", lengths=(9,))], _dictionary(rows))[0]).drop("value")


# --- conditions -----------------------------------------------------------------------------------------------------


def _date_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as base rows and line items as instances of form `line`."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_orderkey").alias("record"), F.lit(1).alias("event_id"), F.lit(None).cast("string").alias("repeat_key"), F.lit(1).alias("instance"), F.lit(None).cast("string").alias("dag"), day("o_orderdate").alias("ordered"), F.lit(None).cast("string").alias("shipped"))
    line = lines.select(F.col("l_orderkey").alias("record"), F.lit(1).alias("event_id"), F.lit("line").alias("repeat_key"), F.col("l_linenumber").alias("instance"), F.lit(None).cast("string").alias("dag"), F.lit(None).cast("string").alias("ordered"), day("l_shipdate").alias("shipped"))
    return base.unionByName(line)


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as contexts, with their order's date: an instance over its record's base row."""
    return contexts.contexts(_date_rows(spark, sf_dir), ["ordered", "shipped"])


@query(
    "contexts_merge",
    """SELECT o_orderkey::VARCHAR AS record, '1' AS event, 1 AS instance, NULL AS form, strftime(o_orderdate, '%Y-%m-%d') AS ordered, NULL AS shipped FROM orders
       UNION ALL SELECT l_orderkey::VARCHAR, '1', l_linenumber, 'line', strftime(o_orderdate, '%Y-%m-%d'), strftime(l_shipdate, '%Y-%m-%d')
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def contexts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select(F.col("_record").alias("record"), F.col("_event").alias("event"), F.col("_instance").alias("instance"), F.col("_form").alias("form"), "ordered", "shipped")


@query(
    "constraint_dates",
    """SELECT l_orderkey::VARCHAR AS record, l_linenumber AS instance, 'assert:[shipped]>=[ordered]' AS reason, strftime(l_shipdate, '%Y-%m-%d') AS value
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE strftime(l_shipdate, '%Y-%m-%d') < strftime(o_orderdate, '%Y-%m-%d')""",
)
def constraint_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dates(spark, sf_dir)
    found = R.row_local(rows, [R.Rule("constraint", ("shipped",), asserts="[shipped]>=[ordered]")], _dictionary(rows))
    return found.select(F.col("_record").alias("record"), F.col("_instance").alias("instance"), "reason", "value")


@query(
    "host_contexts",
    "SELECT 'line' AS host, count(*) AS n FROM lineitem UNION ALL SELECT 'order', count(*) FROM orders",
)
def host_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, where = _dates(spark, sf_dir), ({"1": {"order", "line"}}, {("1", "line")})
    parts = [contexts.host_rows(rows, form, *where).select(F.lit(form).alias("host")) for form in ("line", "order")]
    return parts[0].unionByName(parts[1]).groupBy("host").agg(F.count("*").alias("n"))


@query(
    "rule_problems",
    """SELECT rule, 'ordered' AS field, why, count(*) AS n FROM orders,
       (VALUES (1, '[shipped] has several values here'), (2, '[absent] is not collected in this event'), (3, 'unknown algorithm nope')) AS p(rule, why)
       WHERE rule <> 1 OR strftime(o_orderdate, '%Y') >= '1995' GROUP BY rule, why""",
)
def rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = {"ordered": "order", "shipped": "line", "absent": "other"}
    rows = contexts.with_states(_dates(spark, sf_dir).where("_form is null"), forms, {"1": {"order", "line"}}, {("1", "line")})
    late = R.Rule("constraint", ("ordered",), asserts="[ordered]<=[shipped]", when="[ordered]>='1995-01-01'")
    rules = [late, R.Rule("required", ("ordered",), when="[absent]='1'"), R.Rule("single", ("ordered",), algorithm="nope")]
    return _unjudged(R.row_local(rows, rules, _dictionary(rows)))


def _unjudged(items: DataFrame) -> DataFrame:
    """Problems, each with the number of contexts that were left unjudged for it."""
    return items.where("type = 'problem'").groupBy("rule", "field", F.col("reason").alias("why")).agg(F.count("*").alias("n"))


_PROJECT = R.Dictionary({"ordered": "text", "shipped": "text"}, {"ordered": "order", "shipped": "line"})
_EVENTS = contexts.Events({"1": {"order", "line"}}, {("1", "line")})


@query(
    "scan_hosted",
    """SELECT o_orderkey::VARCHAR AS record, 1 AS instance, 1 AS rule, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1995-01-01'
       UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber, 2, strftime(l_shipdate, '%Y-%m-%d') FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') >= '1998-01-01'""",
)
def scan_hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base value is judged on the base row alone, however many instances repeat it; an instance's value on the instance, never on the base row, where it is blank."""
    rules = [R.Rule("constraint", ("ordered",), asserts="[ordered]>='1995-01-01'"), R.Rule("constraint", ("shipped",), asserts="[shipped]<'1998-01-01'")]
    rules.append(R.Rule("required", ("shipped",)))
    found = scans.run_scan(_date_rows(spark, sf_dir), rules, _PROJECT, _EVENTS).findings
    return found.select(F.col("_record").alias("record"), F.col("_instance").alias("instance"), "rule", "value")


_NUMBERS = """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '00' ELSE '' END || (p_retailprice * 100)::BIGINT::VARCHAR || '.50' AS a, CASE WHEN p_partkey % 6 = 0 THEN 'n/a' WHEN p_partkey % 10 = 0 THEN '' ELSE (p_size * 4000)::VARCHAR || '.5' END AS b FROM part)"""


@query(
    "constraint_numeric",
    _NUMBERS + """SELECT p_partkey::VARCHAR AS record, a AS value FROM n
       WHERE NOT CASE WHEN b = 'n/a' THEN false WHEN b = '' THEN true ELSE a::DECIMAL(30, 4) > b::DECIMAL(30, 4) END""",
)
def constraint_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    return R.row_local(rows, [R.Rule("constraint", ("a",), asserts="[a] > [b]")], _dictionary(rows)).select(F.col("_record").alias("record"), "value")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    a = F.concat(F.when(key % 4 == 0, "-").otherwise(""), F.when(key % 3 == 0, "00").otherwise(""), F.round(F.col("p_retailprice") * 100).cast("long").cast("string"), F.lit(".50"))
    b = F.when(key % 6 == 0, "n/a").when(key % 10 == 0, "").otherwise(F.concat((F.col("p_size") * 4000).cast("string"), F.lit(".5")))
    return _rows(table(spark, sf_dir, "part"), key, a=a, b=b)


@query(
    "comparison_table",
    _NUMBERS + """SELECT count(*) FILTER (WHERE b NOT IN ('n/a', '') AND a::DECIMAL(30, 4) < try_cast(b AS DECIMAL(30, 4)) OR b = '' AND a < b) AS less,
       count(*) FILTER (WHERE b NOT IN ('n/a', '') AND a::DECIMAL(30, 4) >= try_cast(b AS DECIMAL(30, 4)) OR b = '' AND a >= b) AS not_less, count(*) FILTER (WHERE a <> b AND NOT (b NOT IN ('n/a', '') AND a::DECIMAL(30, 4) = try_cast(b AS DECIMAL(30, 4)))) AS differ FROM n""",
)
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda op: F.count_if(comparison.compare(op, F.col("a"), F.col("b")))
    return _numbers(spark, sf_dir).agg(of("<").alias("less"), of(">=").alias("not_less"), of("<>").alias("differ"))


@query("decimal_order", _NUMBERS + "SELECT p_partkey::VARCHAR AS record, dense_rank() OVER (ORDER BY a::DECIMAL(30, 4)) AS place FROM n")
def decimal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dense ranks of distinct values by ranges: a place in its range, behind all of the ranges before
    rows = _numbers(spark, sf_dir).withColumn("key", comparison.decimal_key(F.col("a")))
    keys = rows.select("key").distinct().repartitionByRange(parts_of(rows), "key").withColumn("part", F.spark_partition_id())
    with_checkpoint_dir(spark)
    keys = keys.checkpoint()
    sizes = {r.part: r["count"] for r in keys.groupBy("part").count().collect()}  # a number for each range
    before = F.element_at(F.create_map(*[F.lit(x) for p in sizes for x in (p, sum(n for q, n in sizes.items() if q < p))]), F.col("part")) if sizes else F.lit(0)
    ranked = keys.select("key", (before + F.row_number().over(Window.partitionBy("part").orderBy("key"))).cast("long").alias("place"))
    return rows.join(ranked, "key").select(F.col("_record").alias("record"), "place")


@query(
    "required_when",
    """SELECT c_custkey::VARCHAR AS record, 1 AS rule, 'required' AS type, 'phone' AS field, 'required-blank' AS reason,
       CASE WHEN c_custkey % 3 = 0 THEN '  ' END AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 6 IN (0, 1, 3)""",
)
def required_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    phone = F.when(key % 3 == 0, "  ").when(key % 6 == 1, None).otherwise("555")
    rows = _rows(table(spark, sf_dir, "customer"), key, phone=phone, segment=F.col("c_mktsegment"))
    return _short(R.scan(rows, [R.Rule("required", ("phone",), when="[segment]='BUILDING'")], _dictionary(rows))[0])


@query(
    "choices_hidden",
    """SELECT o_orderkey::VARCHAR AS record, 'hidden-choice' AS reason, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT'""",
)
def choices_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(table(spark, sf_dir, "orders"), F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))
    rule = R.Rule("choices", ("status",), when="[priority]='1-URGENT'", show=("O",), codes=("F", "O", "P"))
    return _short(R.scan(rows, [rule], _dictionary(rows, status="radio"))[0]).select("record", "reason", "value")


@query(
    "choices_checkbox",
    """SELECT o_orderkey::VARCHAR AS record, code AS value FROM (SELECT o_orderkey, unnest(['a', 'b', 'c']) AS code FROM orders)
       WHERE code IN ('b', 'c') AND (code = 'b' AND o_orderkey % 2 = 0 OR code = 'c' AND o_orderkey % 3 = 0)""",
)
def choices_checkbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ticked = lambda n: F.when(key % n == 0, "1").otherwise("0")
    box = F.create_map(F.lit("a"), ticked(1), F.lit("b"), ticked(2), F.lit("c"), ticked(3))
    rows = _rows(table(spark, sf_dir, "orders"), key).join(table(spark, sf_dir, "orders").select(key.cast("string").alias("_record"), box.alias("box")), "_record")
    rule = R.Rule("choices", ("box",), hide=("b", "c"), codes=("a", "b", "c"))
    return R.scan(rows, [rule], _dictionary(rows, box="checkbox"))[0].select(F.col("_record").alias("record"), "value")


@query(
    "branch_select",
    """SELECT o_orderkey::VARCHAR AS record, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'problem' ELSE 'required' END AS type,
       CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'more than one branch condition is true' ELSE 'required-blank' END AS reason FROM orders
       WHERE (o_orderstatus = 'P' OR o_totalprice > 200000) AND (o_orderkey % 2 = 0 OR o_orderstatus = 'P' AND o_totalprice > 200000)""",
)
def branch_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = _rows(table(spark, sf_dir, "orders"), key, clerk=F.when(key % 2 == 0, "").otherwise("x"), status=F.col("o_orderstatus"), price=F.col("o_totalprice").cast("decimal(20,2)"))
    rules = R.resolve_branches([R.Rule("required", ("clerk",), when="[status]='P'"), R.Rule("required", ("clerk",), when="[price]>200000")])
    return R.row_local(rows, rules, _dictionary(rows)).select(F.col("_record").alias("record"), "type", "reason")


@query(
    "many_rules_one_pass",
    """SELECT rule, count(*) AS n FROM (SELECT o_totalprice, unnest(range(1, 41)) AS rule FROM orders) WHERE NOT (o_totalprice > rule * 4000) GROUP BY rule""",
)
def many_rules_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(table(spark, sf_dir, "orders"), F.col("o_orderkey"), **{f"p{k}": F.col("o_totalprice").cast("decimal(20,4)") for k in range(1, 41)})
    rules = [R.Rule("constraint", (f"p{k}",), asserts=f"[p{k}] > {k * 4000}") for k in range(1, 41)]
    return R.row_local(rows, rules, _dictionary(rows)).groupBy("rule").agg(F.count("*").alias("n"))


# --- uniqueness -----------------------------------------------------------------------------------------------------


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    code = F.concat(F.lit(" k"), (F.col("c_custkey") % 97).cast("string"), F.lit(" "))
    return _rows(c, F.col("c_custkey"), (F.col("c_custkey") % 3).cast("string"), F.col("c_nationkey"), code=code, segment=F.col("c_mktsegment"))


def _shared(keys: str) -> str:
    return f"""SELECT c_custkey::VARCHAR AS record, ' k' || (c_custkey % 97)::VARCHAR || ' ' AS value FROM customer
               JOIN (SELECT c_custkey % 97 AS k, {keys} FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) > 1) g ON c_custkey % 97 = k"""


def _unique(name: str, sql: str, **kinds) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _people(spark, sf_dir)
        return R.unique(rows, [R.Rule("unique", ("code",), **kinds)], _dictionary(rows)).select(F.col("_record").alias("record"), "value")


_unique("unique_project", _shared("1 AS x"))
_unique("unique_group", _shared("c_nationkey AS x") + " AND c_nationkey = x", scope="dag")
_unique("unique_event", _shared("c_custkey % 3 AS x") + " AND c_custkey % 3 = x", scope="event")
_unique("unique_composite", _shared("c_mktsegment AS x") + " AND c_mktsegment = x", unique_with=("segment",))


_ACTIVE = "c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY'"


@query(
    "unique_branches",
    f"""SELECT c_custkey::VARCHAR AS record, ' k' || (c_custkey % 97)::VARCHAR || ' ' AS value FROM customer
        WHERE ({_ACTIVE}) AND c_custkey % 97 IN (SELECT c_custkey % 97 FROM customer WHERE {_ACTIVE} GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1)""",
)
def unique_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in which no branch is active take no part."""
    rows = _people(spark, sf_dir)
    rules = R.resolve_branches([R.Rule("unique", ("code",), when="[segment]='BUILDING'"), R.Rule("unique", ("code",), when="[segment]='MACHINERY'", message="other")])
    return R.scan(rows, rules, _dictionary(rows))[0].select(F.col("_record").alias("record"), "value")


@query("unique_claims", "SELECT 3 AS rule, c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def unique_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that two rules of a mode claim is judged by neither; a rule of another field beside them is."""
    rows = _people(spark, sf_dir)
    rules = [R.Rule("unique", ("code",)), R.Rule("unique", ("code",), scope="event"), R.Rule("choices", ("segment",), hide=("BUILDING", "MACHINERY"))]
    return R.scan(rows, rules, _dictionary(rows))[0].groupBy("rule", "value").agg(F.count("*").alias("n"))


@query(
    "unique_problems",
    """SELECT rule, field, why, count(*) AS n FROM customer, (VALUES (1, 'code', 'unparsed'), (2, 'segment', '[absent] is not collected in this event')) AS p(rule, field, why)
       GROUP BY rule, field, why""",
)
def unique_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that cannot be read, or not in this event, make problem rows and no findings."""
    rows = contexts.with_states(_people(spark, sf_dir), {"absent": "other"}, {"9": {"other"}}, set())
    rules = [R.Rule("unique", ("code",), when="[segment"), R.Rule("unique", ("segment",), when="[absent]='1'")]
    problems = _unjudged(R.unique(rows, rules, _dictionary(rows)))
    return problems.select("rule", "field", "n", F.when(F.col("why").startswith("the condition cannot be evaluated"), "unparsed").otherwise(F.col("why")).alias("why"))


@query(
    "unique_groups",
    """SELECT 'k' || (c_custkey % 97)::VARCHAR AS code, count(DISTINCT c_custkey) AS records, min(c_custkey::VARCHAR) AS representative, count(DISTINCT c_custkey) > 1 AS collides
       FROM customer GROUP BY 1""",
)
def unique_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.groups(_people(spark, sf_dir).withColumn("code", F.trim("code")), ["code"])


# --- roll-ups, change log, reports ----------------------------------------------------------------------------------


def _some_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = _rows(c, F.col("c_custkey"), dag=F.col("c_nationkey"), name=F.col("c_name"), balance=F.col("c_acctbal").cast("decimal(20,2)"), note=F.when(F.col("c_custkey") % 4 == 0, "").otherwise("x"))
    rules = [R.Rule("constraint", ("balance",), asserts="[balance]>=0"), R.Rule("required", ("note",)), R.Rule("single", ("name",), algorithm="none", pattern="customer#[0-9]*[1-9]")]
    return R.row_local(rows, rules, _dictionary(rows))


_FOUND = """WITH f AS (SELECT c_custkey, c_nationkey::VARCHAR AS dag, 'constraint' AS type, 'assert' AS reason FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, c_nationkey::VARCHAR, 'required', 'required-blank' FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT c_custkey, c_nationkey::VARCHAR, 'single', 'format' FROM customer WHERE NOT regexp_full_match(upper(c_name), 'CUSTOMER#[0-9]*[1-9]', 'i'))"""


@query("single_format_case", "SELECT c_custkey::VARCHAR AS record FROM customer")
def single_format_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern in lower case never matches: it is held against the value in upper case."""
    rows = _rows(table(spark, sf_dir, "customer"), F.col("c_custkey"), name=F.col("c_name"))
    return R.row_local(rows, [R.Rule("single", ("name",), algorithm="none", pattern="customer#[0-9]+")], _dictionary(rows)).select(F.col("_record").alias("record"))


_ALL_FORMAT = _FOUND.replace("WHERE NOT regexp_full_match(upper(c_name), 'CUSTOMER#[0-9]*[1-9]', 'i')", "")


@query(
    "rollup_axes",
    _ALL_FORMAT + """SELECT 'instrument' AS kind, '' AS axis, count(*) AS n FROM f UNION ALL SELECT 'reason', reason, count(*) FROM f GROUP BY reason
       UNION ALL SELECT 'group', dag, count(*) FROM f GROUP BY dag UNION ALL SELECT 'check', type, count(*) FROM f GROUP BY type""",
)
def rollup_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_axes(_some_findings(spark, sf_dir))


@query("scan_statistics", _ALL_FORMAT + "SELECT (SELECT count(*) FROM customer) AS records, (SELECT count(*) FROM customer) AS contexts, count(*) AS findings, 3 AS rules FROM f")
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(table(spark, sf_dir, "customer"), F.col("c_custkey"))
    return rollups.statistics(rows, _some_findings(spark, sf_dir), 3)


@query(
    "finding_report",
    _ALL_FORMAT + """SELECT c_custkey::VARCHAR AS record, dag, type AS "check", reason, CASE type WHEN 'required' THEN 'Missing value' ELSE 'Wrong value' END AS issue,
       CASE type WHEN 'required' THEN 'This field must not be left blank.' WHEN 'single' THEN 'The value does not match the format this field requires.'
       ELSE 'The value does not satisfy this rule''s condition.' END AS wording, CASE type WHEN 'constraint' THEN 'Must hold: [balance]>=0' END AS problem,
       CASE type WHEN 'single' THEN '[identifier withheld]' WHEN 'constraint' THEN (SELECT c_acctbal FROM customer c WHERE c.c_custkey = f.c_custkey)::DECIMAL(20, 2)::VARCHAR END AS value FROM f""",
)
def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report(_some_findings(spark, sf_dir), "redacted", {"name"}).select("record", "dag", "check", "reason", "issue", "wording", "problem", "value")


@query("active_findings", _ALL_FORMAT + "SELECT c_custkey::VARCHAR AS record FROM f WHERE dag = '3' AND reason = 'assert'")
def active_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.active(_some_findings(spark, sf_dir), reason="assert", group="3").select(F.col("_record").alias("record"))


@query(
    "catchup_classify",
    """WITH changed AS (SELECT user_id AS record, max(event_id) AS version FROM events, (SELECT max(event_id) AS top FROM events)
         WHERE event_id > top // 2 AND event_id <= top AND user_id IS NOT NULL GROUP BY user_id),
       manifest AS (SELECT user_id AS record, max(event_id) AS scanned FROM events, (SELECT max(event_id) AS top FROM events) WHERE event_id <= top * 3 // 4 AND user_id % 5 <> 0 GROUP BY user_id)
       SELECT c.record, version, CASE WHEN m.record IS NULL AND c.record % 7 = 0 THEN 'SETTLED' WHEN m.record IS NULL THEN 'NEW' WHEN c.record % 7 = 0 THEN 'GONE'
         WHEN version > scanned THEN 'EDITED' ELSE 'SETTLED' END AS change
       FROM changed c LEFT JOIN manifest m ON c.record = m.record""",
)
def catchup_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("record"))
    top = changes.fence(log).first()["last"] or 0
    early = log.where((F.col("log_id") <= top * 3 // 4) & (F.col("record") % 5 != 0))
    manifest = early.groupBy("record").agg(F.max("log_id").alias("scanned_version"))
    return changes.classify(manifest, changes.window(log, top // 2, top), log.where("record % 7 <> 0"))


@query(
    "catchup_settled",
    """WITH top AS (SELECT max(event_id) AS top FROM events),
       manifest AS (SELECT user_id AS record, max(event_id) AS scanned FROM events, top WHERE event_id <= top * 3 // 4 AND user_id % 5 <> 0 GROUP BY user_id),
       latest AS (SELECT user_id AS record, max(event_id) AS version FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
       changed AS (SELECT user_id AS record, max(event_id) AS version FROM events, top WHERE event_id > top // 2 AND user_id IS NOT NULL GROUP BY user_id)
       SELECT record, CASE WHEN c.record IS NOT NULL AND record % 7 <> 0 AND (m.record IS NULL OR c.version > scanned) THEN l.version ELSE scanned END AS scanned_version,
         CASE WHEN c.record IS NOT NULL AND record % 7 = 0 THEN 'tombstone' ELSE 'done' END AS state
       FROM latest l LEFT JOIN manifest m USING (record) LEFT JOIN changed c USING (record) WHERE m.record IS NOT NULL OR (c.record IS NOT NULL AND record % 7 <> 0)""",
)
def catchup_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after catching up with the second half of the log: records of every seventh user are gone."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("record"))
    top = changes.fence(log).first()["last"] or 0
    early = log.where((F.col("log_id") <= top * 3 // 4) & (F.col("record") % 5 != 0))
    manifest = early.groupBy("record").agg(F.max("log_id").alias("scanned_version")).select("*", F.lit("done").alias("state"), F.lit(0).alias("tries"))
    here = log.where("record % 7 <> 0")
    rescan = lambda asked: here.join(asked, "record", "left_semi").groupBy("record").agg(F.max("log_id").alias("version"))
    return changes.catch_up(manifest, log, lambda: here, rescan, top // 2).manifest.select("record", "scanned_version", "state")


@query(
    "live_collision",
    """SELECT min(c_custkey) IS NOT NULL AS used, CASE WHEN count(*) > 0 THEN '3' END AS dag FROM customer WHERE c_nationkey = 3 AND 'k' || (c_custkey % 97)::VARCHAR = 'k5' AND c_custkey <> 5""",
)
def live_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another customer of nation 3 holds the code k5."""
    customer = table(spark, sf_dir, "customer")
    rows = _rows(customer, F.col("c_custkey"), dag=F.col("c_nationkey"), code=F.concat(F.lit("k"), F.col("c_custkey") % 97))
    hit = access.collision(rows, R.Rule("unique", ("code",), scope="dag"), "code", {"code": " k5"}, "5", group="3")
    return hit.agg((F.count("*") > 0).alias("used"), F.max("dag").alias("dag"))


@query(
    "rights_scan",
    """SELECT c_custkey::VARCHAR AS record, 1 AS rule, 'balance' AS field, 'confirm' AS severity FROM customer WHERE NOT c_acctbal >= 0""",
)
def rights_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the rules that a reader of form `money` may run: a rule whose condition reads form `person`, and a host on it, are dropped."""
    rows = _rows(table(spark, sf_dir, "customer"), F.col("c_custkey"), balance=F.col("c_acctbal"), segment=F.col("c_mktsegment"))
    dictionary = R.Dictionary({"balance": "text", "segment": "text"}, {"balance": "money", "segment": "person"})
    negative = R.Rule("constraint", ("balance", "segment"), asserts="[balance]>=0", block="confirm")
    rules, _ = access.readable([negative, R.Rule("required", ("balance",), when="[segment]='BUILDING'")], dictionary, {"money": "1", "person": "0"})
    found = access.with_severity(R.scan(rows, rules, dictionary)[0], rules, dictionary)
    return found.select(F.col("_record").alias("record"), "rule", "field", "severity")


@query(
    "single_context",
    """SELECT o_orderkey::VARCHAR AS record, 1 AS instance, strftime(o_orderdate, '%Y-%m-%d') AS ordered, strftime(l_shipdate, '%Y-%m-%d') AS shipped
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderkey = 3 ORDER BY l_shipdate LIMIT 1""",
)
def single_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest item of line 1 of order 3 with its order's date, or the order alone if it has no such line."""
    first = _date_rows(spark, sf_dir).where("record = 3").groupBy("record", "event_id", "repeat_key", "instance", "dag").agg(F.min("ordered").alias("ordered"), F.min("shipped").alias("shipped"))
    found = access.single(first, ["ordered", "shipped"], "3", "1", "line", 1)
    return found.select(F.col("_record").alias("record"), F.col("_instance").alias("instance"), "ordered", "shipped")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    return f"{with_checkpoint_dir(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


#: Customers whose code changes in the second round, who go in the third, and whose code is theirs alone in the fourth.
_ROUNDS = ("c_custkey % 10 = 3", "c_custkey % 15 = 4", "c_custkey % 20 = 7")
_CODE = f"CASE WHEN {_ROUNDS[2]} THEN 'own' || c_custkey::VARCHAR WHEN {_ROUNDS[0]} THEN 'm' || (c_custkey % 41)::VARCHAR ELSE 'k' || (c_custkey % 997)::VARCHAR END"


@query(
    "unique_catchup",
    f"""WITH now AS (SELECT c_custkey, {_CODE} AS code FROM customer WHERE NOT {_ROUNDS[1]})
        SELECT c_custkey::VARCHAR AS record, code AS value FROM now WHERE code IN (SELECT code FROM now GROUP BY code HAVING count(*) > 1)""",
)
def unique_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness kept up over four rounds of changes: what holds at the end is what a scan of all customers would find."""
    c = table(spark, sf_dir, "customer")
    number = F.col("c_custkey")

    def contexts_of(code: Column, test: str = "true") -> DataFrame:
        return _rows(c.where(test), number, code=code)

    first = F.concat(F.lit("k"), number % 997)
    second = F.when(F.expr(_ROUNDS[0]), F.concat(F.lit("m"), number % 41)).otherwise(first)
    own = contexts_of(F.concat(F.lit("own"), number), f"{_ROUNDS[2]} and not {_ROUNDS[1]}")
    rounds = [contexts_of(first), contexts_of(second, _ROUNDS[0]), contexts_of(first, _ROUNDS[1]), own]
    given = [(r, r.limit(0) if k == 2 else r) for k, r in enumerate(rounds)]
    state = incremental.UniqueState(spark, _folder(spark, "unique"), buckets=64, slices=4)
    found = incremental.keep_up(state, given, [R.Rule("unique", ("code",))], _dictionary(rounds[0]))
    return found.select(F.col("_record").alias("record"), "value")


@query(
    "stale_epochs",
    """WITH groups AS (SELECT user_id AS g, max(event_id) % 3 + 1 AS epoch FROM events WHERE user_id % 11 <> 0 GROUP BY user_id),
       staged AS (SELECT user_id AS g, event_id % 3 + 1 AS stage_epoch, event_id FROM events)
       SELECT event_id, coalesce(stage_epoch = epoch, false) AS kept FROM staged LEFT JOIN groups USING (g)""",
)
def stale_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged findings by group and epoch: those of the group's present epoch can be published, all others are swept, also those of groups that are gone."""
    events = table(spark, sf_dir, "events")
    epoch = (F.col("event_id") % 3 + 1).alias("stage_epoch")
    groups = events.where("user_id % 11 <> 0").groupBy(F.col("user_id").alias("g")).agg((F.max("event_id") % 3 + 1).alias("candidate_epoch"))
    kept, swept = incremental.stale(events.select(F.col("user_id").alias("g"), epoch, "event_id"), groups, ["g"])
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(swept.select("event_id", F.lit(False).alias("kept")))


@query(
    "retracted_findings",
    """WITH before AS (SELECT c_custkey, c_custkey % 4 AS rule FROM customer WHERE c_custkey % 4 < 3), now AS (SELECT c_custkey, c_custkey % 3 AS rule FROM customer WHERE c_acctbal > 0)
       SELECT c_custkey::VARCHAR AS record, rule, 'added' AS change FROM (SELECT * FROM now EXCEPT SELECT * FROM before)
       UNION ALL SELECT c_custkey::VARCHAR, rule, 'retracted' FROM (SELECT * FROM before EXCEPT SELECT * FROM now)""",
)
def retracted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later scan adds to published findings and takes away from them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record"), "c_custkey", "c_acctbal")
    before = c.where("c_custkey % 4 < 3").selectExpr("record", "c_custkey % 4 AS rule")
    added, gone = incremental.retract(before, c.where("c_acctbal > 0").selectExpr("record", "c_custkey % 3 AS rule"), ["record", "rule"])
    return added.withColumn("change", F.lit("added")).unionByName(gone.withColumn("change", F.lit("retracted")))


@query(
    "scan_barred",
    """SELECT f.n AS findings, 2::BIGINT AS problems, o.records, CASE WHEN f.n > 0 THEN 'no' ELSE 'blocked' END AS outcome
       FROM (SELECT count(*) FILTER (WHERE false) AS n FROM orders) f, (SELECT count(*) AS records FROM orders) o""",
)
def scan_barred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by a reader who may see no form: nothing is judged, each rule is a problem, and the records that were there count as seen."""
    rules = [R.Rule("required", ("ordered",)), R.Rule("constraint", ("shipped",), asserts="[shipped]>='1995'")]
    orders = _date_rows(spark, sf_dir).where("repeat_key is null")
    done = scans.run_scan(orders, rules, _PROJECT, _EVENTS, rights={"order": "0"})
    counts = done.findings.agg(F.count("*").alias("findings")).crossJoin(done.problems.agg(F.count("*").alias("problems")))  # one row each
    return counts.withColumns({"records": F.lit(done.records).cast("long"), "outcome": F.lit(done.outcome)})


@query(
    "watch_hosted",
    """WITH f AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS ordered FROM orders)
       SELECT k::VARCHAR AS record, 1 AS rule, ordered AS value FROM f WHERE ordered < '1993-01-01'
       UNION ALL SELECT k::VARCHAR, 2, ordered FROM f WHERE ordered IN (SELECT ordered FROM f GROUP BY ordered HAVING count(DISTINCT k) > 1)""",
)
def watch_hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that come as a stream of several batches, base rows and instances in any of them: each base value is judged once, on its base row, and
    uniqueness among the records of all batches."""
    home = _folder(spark, "watch")
    _dates(spark, sf_dir).repartition(6, "_record", "_form").write.parquet(f"{home}/contexts")
    stream = spark.readStream.schema(spark.read.parquet(f"{home}/contexts").schema).option("maxFilesPerTrigger", 3).parquet(f"{home}/contexts")
    rules = [R.Rule("constraint", ("ordered",), asserts="[ordered]>='1993-01-01'"), R.Rule("unique", ("ordered",))]
    write = lambda frame, number: frame.write.mode("overwrite").parquet(f"{home}/items/batch={number}")
    changes.watch(stream, rules, _PROJECT, write, f"{home}/state", _EVENTS).awaitTermination()
    return spark.read.parquet(f"{home}/items").where("type <> 'problem'").select(F.col("_record").alias("record"), "rule", "value")


@query(
    "finding_counters",
    _ALL_FORMAT + """SELECT dag, type AS "check", count(*) AS n, array_to_string(list_slice(list(DISTINCT c_custkey::VARCHAR ORDER BY c_custkey::VARCHAR), 1, 3), ',') AS samples, max(type = 'constraint') AS blocks
       FROM f GROUP BY dag, type""",
)
def finding_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by group and kind of check with three samples each, counted for two halves of the records apart and then made one."""
    found = _some_findings(spark, sf_dir)
    half = F.pmod(F.xxhash64("_record"), F.lit(2))
    parts = [rollups.counters(found.where(half == k), ["_dag", "type"], "_record", F.col("type") == "constraint") for k in (0, 1)]
    one = rollups.merged(parts[0].unionByName(parts[1]), ["_dag", "type"])
    return one.select(F.col("_dag").alias("dag"), F.col("type").alias("check"), "n", F.array_join("samples", ",").alias("samples"), "blocks")


@query(
    "live_branches",
    """WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, 'k' || (c_custkey % 97)::VARCHAR AS code FROM customer), asked AS (SELECT * FROM c WHERE c_custkey IN (7, 8, 9, 10, 11, 12))
       SELECT a.c_custkey::VARCHAR AS record, CASE WHEN a.c_mktsegment = 'BUILDING' THEN EXISTS (SELECT 1 FROM c WHERE c.code = a.code AND c.c_custkey <> a.c_custkey)
         WHEN a.c_mktsegment = 'MACHINERY' THEN EXISTS (SELECT 1 FROM c WHERE c.code = a.code AND c.c_custkey <> a.c_custkey AND c.c_nationkey = a.c_nationkey) ELSE false END AS used,
         a.c_mktsegment IN ('BUILDING', 'MACHINERY') AS answered FROM asked a""",
)
def live_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live lookups of six records: the branch that is active on the saved values says whether all records or those of the group count; with no active branch
    nothing is answered."""
    rows = _people(spark, sf_dir).withColumn("code", F.trim("code"))
    rules = R.resolve_branches([R.Rule("unique", ("code",), when="[segment]='BUILDING'"), R.Rule("unique", ("code",), when="[segment]='MACHINERY'", scope="dag"), R.Rule("unique", ("code",), when="[segment]='MACHINERY' and [code]=''")])
    out = []
    for r in rows.where(F.col("_record").isin([str(k) for k in range(7, 13)])).collect():  # the records that are asked for
        said = access.is_used(rows, rules, _dictionary(rows), "code", {"code": r.code}, r._record, r._event, r._dag)
        out.append((r._record, said.used, not said.error))
    return spark.createDataFrame(out, "record string, used boolean, answered boolean")


@query(
    "stored_holders",
    """SELECT c_custkey::VARCHAR AS record, c_nationkey::VARCHAR AS dag FROM customer WHERE c_custkey % 97 = 5 AND c_custkey <> 5""",
)
def stored_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that hold the code k5, from stored keys: one partition is read."""
    rows = _people(spark, sf_dir)
    state = incremental.UniqueState(spark, _folder(spark, "holders"), buckets=64, slices=1)
    rule = R.Rule("unique", ("code",))
    state.apply(rows.select("_record"), rows, [rule], _dictionary(rows), 1)
    return state.holders(1, rule, "code", {"code": " k5"}, "5")


@query("fence_bounds", "SELECT min(event_id) AS first, max(event_id) AS last FROM events")
def fence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.fence(table(spark, sf_dir, "events"), "event_id")


@query(
    "group_scope",
    """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS dag FROM customer UNION ALL SELECT c_custkey, 'x' FROM customer WHERE c_custkey % 11 = 0),
       g AS (SELECT k, CASE WHEN min(dag) = max(dag) AND min(dag) <> '' THEN min(dag) END AS dag FROM r GROUP BY k)
       SELECT (2 * c_custkey)::VARCHAR AS record, coalesce(dag = '3', false) AS in_scope FROM customer LEFT JOIN g ON k = 2 * c_custkey""",
)
def group_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids a run of group 3 takes: half of them are no records, some records have no group, and some have rows of two."""
    c = table(spark, sf_dir, "customer")
    record = F.col("c_custkey").cast("string").alias("record")
    records = c.select(record, F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("string")).alias("dag")).unionByName(c.where("c_custkey % 11 = 0").select(record, F.lit("x").alias("dag")))
    return changes.admitted(c.select((F.col("c_custkey") * 2).cast("string").alias("record")), records, "3")


@query("existence_probe", "SELECT c_custkey::VARCHAR AS record, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS exists FROM customer")
def existence_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record"))
    return changes.exists(ids, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("record")))


@query("keyset_page", "SELECT lpad(c_custkey::VARCHAR, 9, '0') AS record FROM customer WHERE lpad(c_custkey::VARCHAR, 9, '0') > '000000020' ORDER BY 1 LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.page(table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("record")), "000000020", 50)


@query(
    "csv_defuse",
    r"""SELECT doc_id, '"' || replace(CASE WHEN regexp_matches(v, '^\s*[=+\-@]') THEN '''' || v ELSE v END, '"', '""') || '"' AS cell
        FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' =' ELSE '' END || regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS v FROM documents)""",
)
def csv_defuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.when(F.col("doc_id") % 3 == 0, " =").otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.csv_cell(value).alias("cell"))


@query(
    "value_policy",
    """SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN length(text) > 120 THEN left(text, 120) || '… (truncated)' ELSE text END AS shown,
       CASE WHEN text IS NULL OR text = '' THEN NULL WHEN doc_id % 2 = 0 THEN '[identifier withheld]' WHEN length(text) > 120 THEN left(text, 120) || '… (truncated)' ELSE text END AS redacted, NULL AS hidden FROM documents""",
)
def value_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda mode: text.shown_value(F.col("text"), mode, F.col("doc_id") % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", of("raw").alias("shown"), of("redacted").alias("redacted"), of("locations").alias("hidden"))


@query(
    "reason_codes",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'assert' WHEN 1 THEN 'unspecified' WHEN 2 THEN repeat('r', 63) || '~' ELSE 'junk;count' END AS code, CASE o_orderkey % 4 WHEN 3 THEN 20 ELSE 0 END AS bits FROM orders""",
)
def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    reason = F.when(k == 0, "assert:[a]='1'").when(k == 1, "").when(k == 2, "r" * 70).otherwise("junk;count")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.reason_code(reason).alias("code"), text.reason_bits(reason).alias("bits"))


_KEY = b"key of the registered queries"


def _hmac(key: bytes, *parts: str) -> str:
    """DuckDB SQL of the keyed hash of texts, joined by NUL."""
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    message = " || '\\x00'::BLOB || ".join(f"encode({p})" for p in parts)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


@query("record_hash_hmac", f"SELECT c_custkey, {_hmac(_KEY, "'v1'", "'record'", "'7'", 'c_custkey::VARCHAR')} AS hash FROM customer")
def record_hash_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = text.purpose_hash(_KEY, "record", 7, F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", hashed.alias("hash"))


_PLACED = """, p AS (SELECT *, CASE type WHEN 'constraint' THEN 'balance' WHEN 'required' THEN 'note' ELSE 'name' END AS field,
  CASE type WHEN 'constraint' THEN '1' WHEN 'required' THEN '2' ELSE '3' END AS rule FROM f) """


@query(
    "finding_identity",
    _ALL_FORMAT + _PLACED + f"""SELECT {_hmac(_KEY, "'v1'", "'finding'", "'7'", 'c_custkey::VARCHAR', "'1'", "'1'", "''", 'field', 'rule', 'reason')} AS finding,
        c_custkey::VARCHAR AS record, type, CASE type WHEN 'constraint' THEN 'assert:[balance]>=0' ELSE reason END AS reason FROM p""",
)
def finding_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.identified(_some_findings(spark, sf_dir), _KEY, 7).select("finding", F.col("_record").alias("record"), "type", "reason")


@query(
    "log_hashes",
    f"""SELECT {_hmac(_KEY + b"|7", 'c_custkey::VARCHAR')} AS record, NULL AS value, 'none' AS mode FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey::VARCHAR, {_hmac(_KEY + b"|7", 'c_name')}, 'hashed' FROM customer""",
)
def log_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of blank notes with their records hashed, and of names (whose pattern in lower case none matches) with their values hashed."""
    found = _some_findings(spark, sf_dir)
    parts = [reports.log_rows(found.where(F.col("type") == kind), mode, _KEY, 7).select("record", "value", F.lit(mode).alias("mode")) for kind, mode in (("required", "none"), ("single", "hashed"))]
    return parts[0].unionByName(parts[1])


@query(
    "outcome_words",
    """SELECT c_nationkey AS run, CASE WHEN c_nationkey % 9 = 4 THEN 'cancelled' WHEN count(*) FILTER (WHERE c_custkey % 100 = 7) > 1 THEN 'blocked' WHEN c_nationkey % 5 = 1 THEN 'manifest-complete'
       WHEN count(*) FILTER (WHERE c_acctbal < -900) = 0 THEN 'clean' ELSE 'complete' END AS word FROM customer GROUP BY c_nationkey""",
)
def outcome_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word for a scan of each nation's customers, by what was found and what is known of the run."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.count("*").alias("examined"), F.count_if(F.col("c_acctbal") < -900).alias("findings"), F.count_if(F.col("c_custkey") % 100 == 7).alias("odd"))
    known = {"examined": F.col("examined"), "findings": F.col("findings"), "blocked": F.greatest(F.col("odd") - 1, F.lit(0)), "cancelled": F.col("run") % 9 == 4, "fenced": F.col("run") % 5 != 1}
    return c.select("run", changes.outcome_of(known).alias("word"))
