"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of 65,536 positions. A row hashes to
a position and belongs to the next point clockwise; once that point's shard is
full the row goes on clockwise to the next shard with room. What each arc of the
ring overflows with follows from the row counts of the arcs alone, so the walk
around the ring runs over ``shards * vnodes`` counts, however many rows there
are, and the rows only need their rank within their arc.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions of the ring; together with ``shards * vnodes`` it bounds every broadcast below.
POSITIONS = 65_536
#: Rows of one arc are ranked in this many separate parts.
PARTS = 16

_WALK = """
aggregate(
  sequence(0, 2 * size(arcs) - 1),
  named_struct(
    'room', room,
    'waiting', cast(array() as array<struct<arc:int,first:bigint,n:bigint>>),
    'placed', cast(array() as array<struct<arc:int,first:bigint,n:bigint,shard:int,slot:bigint>>)),
  (ring, i) -> transform(
    array(aggregate(
      if(i < size(arcs) and arcs[i].n > 0,
         concat(array(named_struct('arc', i, 'first', 0L, 'n', arcs[i].n)), ring.waiting),
         ring.waiting),
      named_struct(
        'left', ring.room[arcs[i % size(arcs)].shard],
        'waiting', cast(array() as array<struct<arc:int,first:bigint,n:bigint>>),
        'placed', ring.placed),
      (at, p) -> named_struct(
        'left', at.left - least(at.left, p.n),
        'waiting', if(p.n > at.left,
          concat(at.waiting, array(named_struct('arc', p.arc, 'first', p.first + at.left, 'n', p.n - at.left))),
          at.waiting),
        'placed', if(at.left > 0,
          concat(at.placed, array(named_struct(
            'arc', p.arc, 'first', p.first, 'n', least(at.left, p.n), 'shard', arcs[i % size(arcs)].shard,
            'slot', room[arcs[i % size(arcs)].shard] - at.left))),
          at.placed)))),
    at -> named_struct(
      'room', transform(ring.room, (x, k) -> if(k = arcs[i % size(arcs)].shard, at.left, x)),
      'waiting', at.waiting,
      'placed', at.placed))[0]
).placed
"""


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """``arc, shard, after, position``: the points in clockwise order.

    The arc of a point holds the positions in ``(after, position]``; the first
    arc starts behind the last point (``after`` is then negative).
    """
    points = (
        spark.range(shards * vnodes)
        .select(F.expr(f"cast(id div {vnodes} as int)").alias("shard"), F.expr(f"id % {vnodes}").alias("v"))
        .withColumn("position", F.expr(f"cast(pmod(xxhash64('point', shard, v), {POSITIONS}) as int)"))
    )
    clockwise = Window.orderBy("position", "shard", "v")
    return points.select(
        (F.row_number().over(clockwise) - 1).alias("arc"),
        "shard",
        F.coalesce(F.lag("position").over(clockwise), F.max("position").over(Window.partitionBy()) - POSITIONS).alias("after"),
        "position",
    )


def ring_shards(df: DataFrame, key: str = "doc_id", shards: int = 40, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``df`` with ``home`` (the shard the ring names first), ``shard`` and ``slot``.

    No shard takes more than ``(1 + slack)`` times its equal share of the rows,
    rounded up; with ``slack = 0`` the shares are exact, so row counts differ by
    one at most. Slots count up from 0 without gaps in every shard. Pass the
    narrow columns that the placement should carry: all of them are shuffled.

    Rows with equal values in all columns are interchangeable: they are counted
    once with their number and spread out at the end, so a row repeated without
    limit is no hot key. Null keys hash like any other value; rows that share a
    key but differ elsewhere are ranked in separate parts. An empty table gives
    no rows. Columns of ``df`` named like the results are replaced.
    """
    spark = df.sparkSession
    df = df.drop("home", "shard", "slot")
    names = df.columns
    points = ring_points(spark, shards, vnodes)
    arc_of = points.filter("after < position").select(
        "arc", F.col("shard").alias("home"), F.expr(f"explode(transform(sequence(after + 1, position), p -> pmod(p, {POSITIONS})))").alias("_position")
    )
    rows = (
        df.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_position", F.expr(f"cast(pmod(xxhash64(`{key}`), {POSITIONS}) as int)"))
        .withColumn("_part", F.expr(f"cast(pmod(xxhash64({', '.join(f'`{n}`' for n in names)}), {PARTS}) as int)"))
        .join(F.broadcast(arc_of), "_position")  # POSITIONS rows
    )
    counts = rows.groupBy("arc", "_part").agg(F.sum("_copies").alias("n"))
    ahead = Window.partitionBy("arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select("arc", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))

    loads = points.join(counts.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").select(
        "arc", "shard", F.coalesce("n", F.lit(0)).alias("n")
    )
    ring = loads.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "n"))).alias("arcs"), F.sum("n").alias("total"))
    share = f"cast(ceil((1 + {slack}D) * total / {shards}) as bigint)" if slack else f"total div {shards} + if(s < total % {shards}, 1, 0)"
    ring = ring.withColumn("room", F.expr(f"transform(sequence(0, {shards - 1}), s -> {share})"))
    placed = ring.select(F.inline(F.expr(_WALK))).select(
        "arc", F.col("first").alias("_first"), F.col("n").alias("_n"), "shard", F.col("slot").alias("_slot")
    )

    order = Window.partitionBy("arc", "_part").orderBy(F.xxhash64(key), *names)
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        rows.withColumn("_rank", F.coalesce(F.sum("_copies").over(running), F.lit(0)))
        .join(F.broadcast(parts), ["arc", "_part"])  # shards * vnodes * PARTS rows
        .withColumn("_rank", F.expr("explode(sequence(_before + _rank, _before + _rank + _copies - 1))"))
    )
    # A point takes from an arc once a lap at most; the walk leaves few pieces of an arc.
    return ranked.join(
        F.broadcast(placed), (ranked["arc"] == placed["arc"]) & F.expr("_rank >= _first and _rank < _first + _n")
    ).select(*[F.col(f"`{n}`") for n in names], "home", "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """The contract's rows for ``documents``: exact row counts (law ``rows``)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return ring_shards(narrow, "doc_id", shards, vnodes).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home",
    )
