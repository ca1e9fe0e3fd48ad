"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

Everything is DataFrame expressions. Sizes are counted once. Each source's target is its share by weight of all words,
at most `epochs` times its own size; the excess goes to the others by weight until no target is above. The mix is cut
into about `blocks` equal blocks of words, dealt over `shards` output shards of equal size; the blocks go to the sources with the
highest quotients target / (2 s + 1). The first r shards hold what the quotients give to that many blocks, so that shard r's integer
quotas are what it adds to them. A divisor at which rounding misses the number of blocks by less than half a seat for each source is
known, so that only the few seats around it are ranked, about five for each source and shard.

A source's documents stand in seeded order (a hash of doc_id) on one line of words, cut into blocks. It plays whole
passes over the line, and for the rest every so-many-th block from a seeded offset, as exact integer steps. Its plays are
numbered in this order, and each shard takes as many of them as its quota says, after those of the shards before. What a
document gives to a shard is the overlap of its interval with the shard's blocks, in closed form. The order is found by ranges of the
hash: sums of ranges first, then inside each range, so that a source with a third of all rows is no single task's work.

The table of sources (one row each, after partial sums) is ranked in one task; everything that has a row for each document is not.

Null and empty texts have size 0 and give nothing. A null source is a source, the last in order. Repeated rows share a
place in the order in any order, which changes no set of rows. No documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.session import with_checkpoint_dir

BLOCKS, SHARDS, EPOCHS, SEED = 1_000_000, 8, 3, 20
WEIGHTS = (1, 2, 3)
#: Rows of a range of the hash order, on average, if all rows were of one source.
RANGE_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words, and place: 60 bits of a hash of doc_id (of the text if there is none) that give the seeded order."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), named)), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", "source", size.alias("size"), place.alias("place"))


def _weight(rank: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target and total of a table of one row per source."""
    named = Window.orderBy(F.col("source").isNull(), "source")
    # the sources that stop at their limit are those with the least limit for their weight
    tight = Window.orderBy("level", F.col("source").isNull(), "source")
    rows = sizes.withColumn("weight", _weight(F.row_number().over(named), weights)).withColumn("most", F.col("source_size") * F.lit(float(epochs)))
    rows = rows.withColumn("level", F.col("most") / F.col("weight")).withColumns({
        "turn": F.row_number().over(tight),
        "total": F.sum("source_size").over(Window.partitionBy()),
        "all_weight": F.sum("weight").over(Window.partitionBy()),
        "used": F.coalesce(F.sum("most").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "used_weight": F.coalesce(F.sum("weight").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    free = (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("used_weight"))  # words per weight if this source and those after it are free
    first = F.min(F.when(F.col("level") >= free, F.struct(F.col("turn"), free.alias("free")))).over(Window.partitionBy())
    rows = rows.withColumn("water", first["free"])
    return rows.withColumn("target", F.when(F.col("most") <= F.col("weight") * F.col("water"), F.col("most")).otherwise(F.col("weight") * F.col("water")))


def apportion(wanted: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """Adds block (words in a block) and quotas: the source's blocks in shards 1 to n, an array."""
    every = Window.partitionBy()
    block = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / F.lit(blocks)).cast("long"))
    rows = wanted.withColumn("block", block).withColumn("seats", F.ceil(F.col("total") / F.col("block")).cast("long"))
    rows = rows.withColumn("near_by", F.count("*").over(every)).select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard"))
    house = (F.col("seats") * F.col("shard") / F.lit(shards)).cast("long")  # blocks of the first shards
    # a divisor that gives all blocks lies where total / divisor is within half a seat a source of their number; so do each source's seats
    part, half = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0), F.col("near_by") / 2
    low = F.greatest(F.lit(0).cast("long"), F.floor(part * (house - half)) - 1)
    rows = rows.withColumns({"house": house, "low": low, "high": F.ceil(part * (house + half)) + 1})
    in_shard = Window.partitionBy("shard")
    rows = rows.withColumn("left", F.col("house") - F.sum("low").over(in_shard))
    seat = rows.select("source", "shard", "low", "left", F.explode(F.sequence("low", "high")).alias("s"), "target").where("target > 0")
    ranked = seat.withColumn("rank", F.row_number().over(in_shard.orderBy(F.desc(F.col("target") / (2 * F.col("s") + 1)), F.col("source").isNull(), "source", "s")))
    won = ranked.where(F.col("rank") <= F.col("left")).groupBy("source", "shard").count()
    joined = rows.alias("r").join(won.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source")) & (F.col("r.shard") == F.col("w.shard")), "left")
    up_to = F.col("low") + F.coalesce("count", F.lit(0))
    return joined.groupBy("r.source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "total", "block")],
        F.sort_array(F.collect_list(F.struct(F.col("r.shard"), up_to.alias("n")))).alias("steps"),
    ).withColumn("quotas", F.transform("steps", lambda x, i: x["n"] - F.coalesce(F.get(F.col("steps")["n"], i - 1), F.lit(0))))


def _chosen(position: Column) -> Column:
    """Words before a position on the source's line that lie in the chosen blocks of the last pass."""
    wide = lambda c: c.cast("decimal(19,0)")
    passed = lambda b: F.floor((wide(b) * wide(F.col("rest")) + wide(F.col("offset"))) / wide(F.col("length"))).cast("long")
    b = F.floor(position / F.col("block"))
    whole = passed(b)
    inside = (position - b * F.col("block")) * (passed(b + 1) - whole)
    return whole * F.col("block") + inside


def _given(plays: Column, start: Column, end: Column) -> Column:
    """Words of a document, an interval of its source's line, in the source's first plays."""
    line, block = F.col("length"), F.col("block")
    turn = F.pmod(plays, line) * block
    early = F.floor(plays / line).cast("long") * (end - start) + F.least(end, turn) - F.least(start, turn)
    late = (plays - F.col("passes") * line) * block
    rest = F.col("passes") * (end - start) + F.least(_chosen(end), late) - F.least(_chosen(start), late)
    return F.when(plays < F.col("passes") * line, early).otherwise(rest)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and by_shard (the words that each output shard takes) of every row, and its source's quotas."""
    with_checkpoint_dir(docs.sparkSession)
    rows = sized(docs, seed).checkpoint()
    bits = min(24, max(4, (rows.count() // RANGE_ROWS).bit_length()))
    rows = rows.withColumn("range", F.shiftright("place", 60 - bits))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")).checkpoint()
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    quotas = apportion(targets(sizes, weights, epochs), blocks, shards)
    length = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # never more than `epochs` passes: a last, short block may round the quota up beyond them
    plays = F.transform("steps", lambda x: F.least(x["n"], F.col("length") * epochs))
    plan = quotas.withColumn("length", length).withColumn("plays", plays).withColumn("won", F.element_at("plays", -1))
    plan = plan.withColumns({"passes": F.floor(F.col("won") / F.col("length")), "rest": F.pmod("won", "length")})
    plan = plan.withColumn("offset", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")))), 1, 12), 16, 10).cast("long"), F.col("length")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0).cast("long"))).select(F.col("source").alias("s"), F.col("range").alias("r"), "range_start")
    starts = starts.join(plan.drop("steps"), F.col("s").eqNullSafe(plan.source)).drop("source")
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("size").over(inside))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    joined = joined.withColumn("end", F.col("range_start") + F.col("end")).withColumn("start", F.col("end") - F.col("size"))
    up_to = joined.withColumn("up_to", F.transform("plays", lambda n: _given(n, F.col("start"), F.col("end")).cast("long")))
    by_shard = F.transform("up_to", lambda x, i: x - F.coalesce(F.get("up_to", i - 1), F.lit(0).cast("long")))
    return up_to.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), F.element_at("up_to", -1).alias("taken"), by_shard.alias("by_shard"), "quotas")


def copies(docs: DataFrame, seed: int = SEED, **kinds) -> DataFrame:
    """docs with each row as often as the mix takes its words; the part of a copy is rounded up or down by a seeded draw.

    Rows without words stay once. All columns are kept, whatever their names. kinds: the parameters of `mix`.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), "text", "source")
    taken = mix(keyed.select(F.col("key").alias("doc_id"), "text", "source"), seed=seed, **kinds)
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1.0)
    taken = taken.groupBy(F.col("doc_id").alias("key")).agg(F.avg(share).alias("share"))  # rows of one doc_id and text share alike
    number = F.when(F.col("key.none"), F.lit(0).cast("long")).otherwise(F.coalesce(F.col("key.id").try_cast("long"), F.xxhash64("key.id")))
    draw = F.pmod(F.xxhash64(F.lit(seed), "key.none", number, "key.text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    joined = keyed.select("row", "key").join(taken, "key").withColumn("times", F.floor(F.col("share") + draw).cast("int"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("turn")).select("row.*")


#: The same rows by another way: all seats ranked at once, and one running sum for each source.
SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
named AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight,
         (sum(source_size) OVER ())::BIGINT AS total FROM sizes),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS level,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source) AS turn FROM named),
free AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS free
  FROM levels),
water AS (SELECT *, (SELECT f.free FROM free f WHERE f.level >= f.free ORDER BY f.turn LIMIT 1) AS water FROM free),
wanted AS (
  SELECT source, source_size, total, CASE WHEN most <= weight * water THEN most ELSE weight * water END AS target,
         greatest(1, (total + {BLOCKS - 1}) // {BLOCKS}) AS block FROM water),
seats AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, source IS NULL, source, s) AS rank,
         (total + block - 1) // block AS house
  FROM (SELECT *, unnest(range(0, (target / block)::BIGINT + 100)) AS s FROM wanted WHERE target > 0)),
shard AS (SELECT unnest(range(1, {SHARDS + 1})) AS r),
won AS (
  SELECT w.source, r, count(rank) FILTER (WHERE rank <= s.house * r // {SHARDS}) AS n
  FROM wanted w CROSS JOIN shard LEFT JOIN seats s ON w.source IS NOT DISTINCT FROM s.source GROUP BY w.source, r),
plan AS (
  SELECT w.*, r, greatest(1, (source_size + block - 1) // block) AS length,
         least(n, 3 * greatest(1, (source_size + block - 1) // block)) AS plays, max(n) OVER (PARTITION BY w.source) AS most
  FROM wanted w JOIN won ON w.source IS NOT DISTINCT FROM won.source),
steps AS (
  SELECT *, least(most, 3 * length) // length AS passes, least(most, 3 * length) % length AS rest,
         ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 12))::BIGINT % length AS start
  FROM plan),
line AS (
  SELECT d.*, row_number() OVER () AS n, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM docs d),
ends AS (
  SELECT l.doc_id, l.source, l.size, p.source_size, p.target, p.passes, p.block, p.length, p.rest, p.start, p.r, p.plays,
         l.stop::BIGINT AS hi, (l.stop - l.size)::BIGINT AS lo, l.n
  FROM line l JOIN steps p ON l.source IS NOT DISTINCT FROM p.source),
counted AS (
  SELECT *, ((hi // block)::HUGEINT * rest + start) // length AS a1, ((hi // block + 1)::HUGEINT * rest + start) // length AS a2,
         ((lo // block)::HUGEINT * rest + start) // length AS b1, ((lo // block + 1)::HUGEINT * rest + start) // length AS b2 FROM ends),
given AS (
  SELECT *, CASE WHEN plays < passes * length
      THEN plays // length * size + least(hi, plays % length * block) - least(lo, plays % length * block)
      ELSE passes * size + least(a1 * block + hi % block * (a2 - a1), (plays - passes * length) * block)
           - least(b1 * block + lo % block * (b2 - b1), (plays - passes * length) * block) END::BIGINT AS up_to FROM counted),
parts AS (SELECT *, up_to - lag(up_to, 1, 0) OVER (PARTITION BY n ORDER BY r) AS part FROM given)
SELECT any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       max(up_to) AS taken, array_to_string(list(part ORDER BY r), ',') AS by_shard
FROM parts GROUP BY n
"""
