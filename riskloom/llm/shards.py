"""Jump consistent hashing: stable keys to shards without a ring table. DataFrame functions only.

The law is `key`: a row's key and the number of shards decide its shard, nothing else does. Going from n to n + 1
shards moves the rows whose walk visits shard n, about one in n + 1, and all of them into shard n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans.frames import written
from riskloom.plans.ranking import bucket_count

#: Multiplier of the 64-bit generator of Lamping and Veach (2014), a fixed value.
MULTIPLIER = 2862933555777941757

LAW = "key"
ROW_BYTES = 16
COPIES_AT_ONCE = 10_000
FIRST_STEPS = 64

_LOW_16, _LOW_32 = (1 << 16) - 1, (1 << 32) - 1


def key_number(key: str, kind: T.DataType) -> Column:
    """The 64-bit number of a key: an integer key itself, the hash of any other, 0 for a missing one."""
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    return F.coalesce(number, F.lit(0).cast("long"))


def _generate(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state (upper and lower 32 bits) of the generator, in pieces of 16 bits so that no long overflows."""
    m = [(MULTIPLIER >> (16 * i)) & _LOW_16 for i in range(4)]
    first = low * m[0] + 1
    second = low * m[1] + F.shiftright(first, 16)

    def shifted(x: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(_LOW_16), 16)

    upper = F.shiftright(second, 16) + shifted(high * m[1]) + high * m[0] + shifted(low * m[3]) + low * m[2]
    return upper.bitwiseAND(_LOW_32), shifted(second) + first.bitwiseAND(_LOW_16)


def jump(number: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a 64-bit number among `shards`, and among one more.

    The walk for one more shard visits the same places and at most shard `shards` after them, so one walk gives both.
    Its steps are about the logarithm of the number of shards; steps past the first 64 are only computed for rows
    that still walk.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    limit = shards + 1
    start = F.struct(
        F.shiftrightunsigned(number, 32).alias("high"), number.bitwiseAND(_LOW_32).alias("low"),
        F.lit(-1).cast("long").alias("before"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _generate(s["high"], s["low"])
        ahead = (s["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(high.alias("high"), low.alias("low"), s["at"].alias("before"), s["next"].alias("at"), ahead.cast("long").alias("next"))
        return F.when(s["next"] < limit, moved).otherwise(s)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(limit, FIRST_STEPS))), start, step)
    if limit > FIRST_STEPS:
        rest = F.sequence(F.lit(FIRST_STEPS + 1), F.lit(limit))
        # an array of one walk, so that it is computed once for the test and the steps after it
        walk = F.transform(F.array(walk), lambda s: F.when(s["next"] < limit, F.aggregate(rest, s, step)).otherwise(s))[0]
    done = F.transform(
        F.array(walk),
        lambda s: F.struct(
            F.when(s["at"] == shards, s["before"]).otherwise(s["at"]).cast("int").alias("shard"), s["at"].cast("int").alias("grown")
        ),
    )
    return done[0]


def place(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, grown_shard) per row, without a shuffle. Size: UTF-8 bytes plus 16, null text: 16."""
    told = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(told) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(told).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        jump(key_number(key, docs.schema[key].dataType), shards).alias("__jump"),
    )
    return rows.select(key, "size", "text_crc32", "law", F.col("__jump.shard").alias("shard"), F.col("__jump.grown").alias("grown_shard"))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`place` with `slot`: the row's number in its shard, gapless from 0, by key, size and checksum.

    Only these narrow rows are shuffled. Equal ones are counted before the shuffle; the distinct ones are cut into
    ranges of (shard, key, size, checksum) that hold several shards or a part of one, are numbered inside their range,
    and the totals of lower ranges are added: neither a large shard nor a key held by a third of all rows fills a
    task. Missing keys are the integer key 0 and come first in their shard; repeated rows have a slot each. An empty
    table has no rows; other columns are ignored, whatever their names.
    """
    order = ["shard", key, "size", "text_crc32"]
    placed = place(docs, shards, key, text)
    counted = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("__n"))
    counted = written(counted)
    ranges = counted.repartitionByRange(bucket_count(docs), *order).withColumn("__part", F.spark_partition_id())
    ranges = written(ranges)
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and one per shard: bounded by the partitions and the shards
    totals = ranges.groupBy("__part").agg(F.sum("__n").alias("__total"))
    lower = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("__part", F.coalesce(F.sum("__total").over(lower), F.lit(0)).alias("__below"))
    sizes = counted.groupBy("shard").agg(F.sum("__n").alias("__total"))
    lower = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("__total").over(lower), F.lit(0)).alias("__start"))
    numbered = ranges.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    numbered = numbered.join(F.broadcast(parts), "__part").join(F.broadcast(starts), "shard")
    numbered = numbered.withColumn("__slot", F.col("__below") + F.col("__inside") - F.col("__start"))
    # rows equal in all columns come back one by one, at most 10,000 of an array at once
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    held = numbered.withColumn("__piece", pieces)
    last = F.least(F.col("__piece") + COPIES_AT_ONCE, F.col("__n")) - 1
    each = held.withColumn("__copy", F.explode(F.sequence(F.col("__piece"), last)))
    return each.select(key, "size", "text_crc32", "law", "shard", (F.col("__slot") + F.col("__copy")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", files: int = 1) -> str:
    """Writes whole rows as Parquet, a folder per shard, each of about `files` files; returns the name of the shard column.

    Rows of a shard are dealt to its files by a hash of the whole row, so a hot key spreads over them as far as
    its rows differ; `maxRecordsPerFile` of the session bounds files further. The shard column is `shard`, with
    underscores in front where the table has one of that name.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    rows = docs.withColumn(name, jump(key_number(key, docs.schema[key].dataType), shards)["shard"])
    salt = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
    rows.repartition(shards * files, F.col(name), salt).write.partitionBy(name).parquet(path)
    return name


def moves(docs: DataFrame, shards: int, more: int, key: str = "doc_id") -> DataFrame:
    """The rows that leave their shard when `shards` grow to `more`, with `from_shard` and `to_shard`; nothing is shuffled."""
    if more < shards:
        raise ValueError("shards are only appended")
    number = key_number(key, docs.schema[key].dataType)
    told = docs.select(F.struct(*docs.columns).alias("row"), jump(number, shards)["shard"].alias("a"), jump(number, more)["shard"].alias("b"))
    return told.where("a <> b").select("row.*", F.col("a").alias("from_shard"), F.col("b").alias("to_shard"))
