"""Sharding by balanced label propagation: linked documents move together, shards stay even.

Documents with the same link key (the text's digest, or any other) are neighbours of each
other. All neighbours of a key in one shard are alike, so they are one row with their number:
a group has as many rows as shards at most, however many documents it holds, and no pair of
documents is ever made. A label is a shard.

1. Linked documents are dealt to the shards in turn, so the shards are even to one row.
2. In each round every group names the shards that should receive it: those that hold most of
   it, as many as its size needs. Its rows elsewhere ask to move there. Quotas between each two
   shards say how many may: as many as move the other way, and a share of the room that the
   target has left. Rows with most neighbours at their target go first, to the last row of a
   quota. So no round brings a shard over its capacity.
3. Documents without neighbours fill the shards up: counts differ by one row at most.

Places are numbered without a sort of a shard: a running sum has two levels, sums of buckets
first, then rows within a bucket. Texts are read once; what moves are digests and counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.running import BEFORE, FIRST, earlier
from loomwright.llm.shared import written

SHARDS, ROUNDS = 24, 12


def text_key(text: Column) -> Column:
    """Equal for equal texts; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _bucket(key: str, rows: int) -> Column:
    """Both levels of a running sum grow as the square root of the rows: buckets, and rows in one."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, 4 * math.isqrt(rows))))


def _wishes(cells: DataFrame, spare: DataFrame, cap: int, turn: int) -> DataFrame:
    """``hub, shard, to, n, near``: rows of a group that ask to move, and its rows at the target."""
    cells = cells.join(F.broadcast(spare), "shard")
    own = Window.partitionBy("hub")
    most = own.orderBy(F.desc("n"), F.col("spare") == 0, F.xxhash64("hub", "shard", F.lit(turn)))
    cells = cells.withColumns({"total": F.sum("n").over(own), "r": F.row_number().over(most)})
    # the least number of its largest shards that could hold all of it
    held = F.coalesce(F.sum(F.col("n") + F.col("spare")).over(most.rowsBetween(FIRST, BEFORE)), F.lit(0))
    cells = cells.withColumn("roomy", held < F.col("total"))
    # where these have no room, rows can still change places with others
    cells = cells.withColumn("tight", F.min("roomy").over(own)).withColumn("gets", F.when(F.col("tight"), F.col("r") <= F.ceil(F.col("total") / max(1, cap))).otherwise(F.col("roomy")))
    open_ = F.col("gets") & (F.col("tight") | (F.col("spare") > 0))
    targets = F.collect_list(F.when(open_, F.struct("r", "shard", "n"))).over(own)
    cells = cells.withColumn("targets", F.array_sort(targets)).where(~F.col("gets") & (F.size("targets") > 0))
    to = F.get("targets", F.pmod(F.col("r") + turn, F.size("targets")))
    return cells.select("hub", "shard", to["shard"].alias("to"), "n", to["n"].alias("near"))


def _quotas(wishes: DataFrame, spare: DataFrame) -> DataFrame:
    """``shard, to, quota`` for each two shards: what is exchanged, and a share of the target's room."""
    asked = wishes.groupBy("shard", "to").agg(F.sum("n").alias("asked"))
    back = asked.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("asked").alias("back"))
    pairs = asked.join(F.broadcast(back), ["shard", "to"], "left").withColumn("swap", F.least("asked", F.coalesce("back", F.lit(0))))
    pairs = pairs.withColumn("rest", F.col("asked") - F.col("swap")).withColumn("all_rest", F.sum("rest").over(Window.partitionBy("to")))
    pairs = pairs.join(F.broadcast(spare.withColumnRenamed("shard", "to")), "to")
    share = F.expr("if(all_rest <= spare, rest, cast(spare as decimal(18,0)) * cast(rest as decimal(18,0)) div all_rest)")
    return pairs.select("shard", "to", (F.col("swap") + share).alias("quota"))


def _settle(cells: DataFrame, n_shards: int, total: int, rounds: int) -> DataFrame:
    spark = cells.sparkSession
    room = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // n_shards) + (F.col("id") < total % n_shards).cast("long")).alias("cap"))
    for k in range(rounds):
        load = cells.groupBy("shard").agg(F.sum("n").alias("load"))
        # one row a shard
        spare = written(room.join(load, "shard", "left").select("shard", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("spare")), f"spare{k}")
        wishes = written(_wishes(cells, spare, total // n_shards, k), f"wishes{k}")
        level = F.lit(64) - F.length(F.bin("near"))
        many = wishes.count()
        if not many:
            break
        lined = earlier(wishes, ["shard", "to"], F.struct(level.alias("level"), _bucket("hub", many).alias("part")), ["hub"], "n")
        lined = lined.join(F.broadcast(_quotas(wishes, spare)), ["shard", "to"])
        moved = lined.withColumn("take", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before")))).where("take > 0")
        moved = written(moved.select("hub", "shard", "to", "take"), f"moved{k}")
        if moved.isEmpty():
            break
        changes = cells.unionByName(moved.select("hub", "shard", (-F.col("take")).alias("n"))).unionByName(moved.select("hub", F.col("to").alias("shard"), F.col("take").alias("n")))
        cells = written(changes.groupBy("hub", "shard").agg(F.sum("n").alias("n")).where("n > 0"), f"cells{k}")
    return cells


def balanced_shards(docs: DataFrame, key: Column, n_shards: int = SHARDS, keep: tuple[str, ...] = ("doc_id",), rounds: int = ROUNDS) -> DataFrame:
    """``keep`` of every row of ``docs`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    Rows with equal, non-null ``key`` are linked; a null key links nothing. The shards' counts
    differ by one row at most; few links are cut: a group is split if it is larger than a shard,
    or where quotas leave no other way. Repeated rows, null ids and ties each have a place of
    their own; no rows give no rows; fewer rows than shards leave the last shards empty. Columns
    not in ``keep`` are not read; one of it named ``shard`` or ``slot`` is an error.
    """
    if {"shard", "slot"} & set(keep):
        raise ValueError("columns are named like results")
    # a number of its own for each row, fixed by being written; its upper bits are the task's
    row = F.monotonically_increasing_id()
    rows = docs.select(F.struct(*keep).alias("kept"), key.alias("hub"), row.alias("row"))
    linked, alone = F.unhex(F.lit("01")), F.unhex(F.lit("00"))  # so that no key is like a row's number
    hub = F.coalesce(F.concat(linked, F.col("hub").cast("binary")), F.concat(alone, F.col("row").cast("string").cast("binary")))
    rows = written(rows.select("kept", "row", hub.alias("hub"), F.shiftright("row", 33).alias("part")), "rows")
    own = Window.partitionBy("hub")
    # a group has one row for each task that read some of it
    groups = rows.groupBy("hub", "part").agg(F.count("*").alias("n")).withColumns({
        "total": F.sum("n").over(own),
        "first": F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(FIRST, BEFORE)), F.lit(0)),
    })
    groups = written(groups, "groups")
    counts = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("total") > 1), F.count_if(F.col("total") == 1)).first()
    total, linked, single = counts
    # every row of a group in turn to the next shard
    lined = earlier(groups.where("total > 1 and first = 0").select("hub", "total"), [], _bucket("hub", linked), ["hub"], "total")
    turns = lined.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("total"), F.lit(n_shards)) - 1)))
    cells = turns.select("hub", F.pmod(F.col("before") + F.col("j"), F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"(total - j + {n_shards - 1}) div {n_shards}").alias("n"))
    cells = _settle(written(cells, "cells"), n_shards, total, rounds)
    # linked rows have a shard's first places
    placed = earlier(cells, ["shard"], _bucket("hub", linked), ["hub"], "n")
    within = own.orderBy("shard")
    placed = placed.select("hub", "shard", F.sum("n").over(within).alias("end"), "n", F.col("before").alias("slot"))
    where = placed.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("end", (F.col("end") - F.col("n")).alias("start"), "shard", "slot"))).alias("cells"))
    many = groups.where("total > 1").select("hub", "part", "first").join(where, "hub")
    # the others fill each shard up
    load = cells.groupBy("shard").agg(F.sum("n").alias("load"))
    full = (F.lit(total // n_shards) + (F.col("id") < total % n_shards).cast("long"))
    room = groups.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"), full.alias("cap")).join(load, "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"), (F.col("cap") - F.coalesce("load", F.lit(0))).alias("left"))
    room = room.withColumn("end", F.sum("left").over(Window.orderBy("shard")))
    room = room.agg(F.array_sort(F.collect_list(F.struct("end", (F.col("end") - F.col("left")).alias("start"), "shard", F.col("load").alias("slot")))).alias("room"))
    alone = earlier(groups.where("total = 1").select("hub", "part", "n"), [], _bucket("hub", single), ["hub"], "n").crossJoin(F.broadcast(room))
    alone = alone.withColumn("at", F.filter("room", lambda x: x["end"] > F.col("before"))[0])
    slot = F.col("at")["slot"] + F.col("before") - F.col("at")["start"]
    cell = F.struct(F.lit(1).cast("long").alias("end"), F.lit(0).cast("long").alias("start"), F.col("at")["shard"].alias("shard"), slot.alias("slot"))
    places = many.unionByName(alone.select("hub", "part", F.lit(0).cast("long").alias("first"), F.array(cell).alias("cells")))
    at = F.col("first") + F.row_number().over(Window.partitionBy("hub", "part").orderBy("row")) - 1
    out = rows.join(places, ["hub", "part"]).withColumn("at", at).withColumn("cell", F.filter("cells", lambda x: x["end"] > F.col("at"))[0])
    return out.select("kept.*", F.col("cell")["shard"].alias("shard"), (F.col("cell")["slot"] + F.col("at") - F.col("cell")["start"]).alias("slot"))
