"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` equal arcs of the 64-bit hash space. Each shard owns ``virtual_nodes`` points,
each placed on a cell; a cell belongs to the first point at or after it, clockwise. A document hashes
to a cell. Documents are taken in ring order; those that find their shard full continue clockwise,
first come first served, to the next point whose shard has room.

Only counts per cell are gathered: the walk runs once over the points (shards x virtual nodes, however
many documents there are), in one ``aggregate`` over an array, and yields for each point the ranges of
its documents that go to each shard. A document then needs its rank within its cell, a sort of
1 / ``cells`` of all rows, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS, VIRTUAL_NODES, CELLS = 40, 64, 1 << 16


def ring(spark: SparkSession, shards: int, virtual_nodes: int, cells: int) -> DataFrame:
    """cell, point (number of the owning point in ring order), shard.

    Of points on one cell the one with the smallest (shard, node) owns it. Cells after the last
    point belong to the first.
    """
    hashed = F.xxhash64(F.lit("point"), "shard", "node")
    points = (
        spark.range(shards * virtual_nodes)
        .select((F.col("id") % shards).cast("int").alias("shard"),
                F.floor(F.col("id") / shards).cast("int").alias("node"))
        .select("shard", "node", F.pmod(hashed, F.lit(cells)).alias("at"))
        .groupBy("at").agg(F.min(F.struct("node", "shard")).alias("own"))
        .select("at", F.col("own.shard").alias("shard"))
    )
    # The number of points is a parameter, so one array of them is bounded.
    listed = points.agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("points"))
    arcs = listed.select(F.posexplode("points").alias("point", "own"), "points").select(
        "point", F.col("own.shard").alias("shard"), F.col("own.at").alias("last"),
        F.when(F.col("point") > 0, F.expr("points[point - 1].at + 1")).otherwise(0).alias("first"),
    )
    tail = listed.select(
        F.lit(0).alias("point"), F.expr("points[0].shard").alias("shard"),
        F.lit(cells - 1).cast("long").alias("last"),
        F.expr("points[size(points) - 1].at + 1").alias("first"),
    )
    owned = arcs.unionByName(tail).where("first <= last")
    return owned.select("point", "shard", F.explode(F.sequence("first", "last")).alias("cell"))


def _walk(points: DataFrame, shards: int, slack: float) -> DataFrame:
    """Where the documents of each point go: point, segments(from_rank, to_rank, shard, base).

    ``points`` has point, shard, n. ``base`` is the place of the segment's first document in its
    shard.
    """
    ranked = Window.partitionBy("shard").orderBy("point").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # One row per point: these windows and arrays are bounded by the ring's parameters.
    everything = Window.partitionBy(F.lit(0))
    of_shard = Window.partitionBy("shard")
    total = F.sum("n").over(everything)
    if slack:
        room = F.ceil(total * (1 + slack) / shards).cast("long")
    else:
        room = F.floor(total / shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    offered = (
        points.withColumn("seen", F.sum("n").over(ranked))
        .withColumn("room", room)
        .withColumn("home", F.greatest(
            F.lit(0), F.least(F.col("n"), F.col("room") - F.col("seen") + F.col("n"))))
        .withColumn("over", F.col("n") - F.col("home"))
        .withColumn("free", F.greatest(F.lit(0), F.col("room") - F.sum("n").over(of_shard)))
    )
    one = offered.agg(F.array_sort(F.collect_list(
        F.struct("point", "shard", "n", "home", "over", "free"))).alias("points"))
    # Shards without a point of their own (all their cells taken) have no room to offer.
    one = one.select("points", F.expr(
        f"transform(sequence(0, {shards - 1}), s -> coalesce("
        "get(filter(points, p -> p.shard = s), 0).free, 0L))").alias("free"))
    # Two laps: the queue that is left after the first meets every shard again in the second.
    walked = one.select("points", F.expr("""
        aggregate(
          concat(points, transform(points, p -> named_struct('point', p.point, 'shard', p.shard,
                 'n', p.n, 'home', p.home, 'over', 0L, 'free', 0L))),
          named_struct('free', free, 'waiting', 0L, 'served', 0L,
                       'takes', array_repeat(named_struct('from', 0L, 'to', 0L, 'shard', 0), 0)),
          (a, p) -> named_struct(
            'free', if(a.waiting + p.over > 0 AND a.free[p.shard] > 0,
                       transform(a.free, (x, i) -> if(i = p.shard,
                                 x - least(x, a.waiting + p.over), x)), a.free),
            'waiting', a.waiting + p.over - least(a.free[p.shard], a.waiting + p.over),
            'served', a.served + least(a.free[p.shard], a.waiting + p.over),
            'takes', if(least(a.free[p.shard], a.waiting + p.over) > 0,
                        concat(a.takes, array(named_struct('from', a.served,
                          'to', a.served + least(a.free[p.shard], a.waiting + p.over),
                          'shard', p.shard))), a.takes)))""").alias("walk"))
    queue = walked.select(F.explode("points").alias("p"), F.col("walk.takes").alias("takes"))
    in_line = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.select("p.*", "takes").withColumn(
        "ahead", F.coalesce(F.sum("over").over(in_line), F.lit(0)))
    moved = F.expr("""transform(
        filter(takes, t -> t.from < ahead + over AND t.to > ahead),
        t -> named_struct('from_rank', home + greatest(t.from - ahead, 0L),
                          'to_rank', home + least(t.to - ahead, over), 'shard', t.shard))""")
    stay = F.expr("filter(array(named_struct('from_rank', 0L, 'to_rank', home, 'shard', shard)), "
                  "t -> t.to_rank > 0)")
    segments = queue.select("point", F.explode(F.concat(stay, moved)).alias("s")).select(
        "point", "s.*")
    placed = Window.partitionBy("shard").orderBy("point", "from_rank").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        segments.withColumn("base", F.coalesce(
            F.sum(F.col("to_rank") - F.col("from_rank")).over(placed), F.lit(0)))
        .groupBy("point").agg(F.collect_list(
            F.struct("from_rank", "to_rank", "shard", "base")).alias("segments"))
    )


def shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS,
          virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS, slack: float = 0.0,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep`` columns, shard (0 based), slot (gapless from 0 within the shard).

    ``slack`` 0 fills every shard to the average, counts at most one apart; a slack of 0.1 lets
    shards hold 10 % more than the average and moves fewer documents when shards are added.

    Null keys hash like any value; rows with equal keys lie side by side on the ring, and repeated
    rows get different slots. An empty frame gives an empty frame. Other columns are not read. Texts
    play no part, so their length does not matter.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit("key"), F.col(key))
    rows = docs.select(key, *keep, hashed.alias("__hash")).withColumn(
        "__cell", F.pmod(F.shiftrightunsigned("__hash", 16), F.lit(cells)))
    cells_of = ring(spark, shards, virtual_nodes, cells).withColumnRenamed("cell", "__cell")
    counts = rows.groupBy("__cell").agg(F.count("*").alias("n"))
    per_cell = cells_of.join(counts, "__cell", "left").na.fill(0, ["n"])
    walk = _walk(per_cell.groupBy("point", "shard").agg(F.sum("n").alias("n")), shards, slack)
    before = Window.partitionBy("point").orderBy("__cell").rowsBetween(
        Window.unboundedPreceding, -1)
    plan = (
        per_cell.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where("n > 0").join(walk, "point")
        .select("__cell", "before", "segments")
    )
    in_cell = Window.partitionBy("__cell").orderBy("__hash", key, *keep)
    return (
        rows.withColumn("__rank", F.row_number().over(in_cell) - 1)
        .join(plan, "__cell")
        .withColumn("__rank", F.col("__rank") + F.col("before"))
        .withColumn("__to", F.expr(
            "filter(segments, s -> s.from_rank <= __rank AND __rank < s.to_rank)[0]"))
        .select(key, *keep, F.col("__to.shard").cast("int").alias("shard"),
                (F.col("__to.base") + F.col("__rank") - F.col("__to.from_rank")).alias("slot"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards, counts at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("binary")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = shard(sized, keep=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
