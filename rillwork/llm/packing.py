"""Filling containers of fixed capacity: best-fit over a length histogram.

The plan works on counts, not on documents: it gets the number of items of each length
(at most `capacity` numbers) and answers with rank ranges: "of the items of this length, ranks
a to b go into containers c, c+1, ... from token s on". Documents are ranked within their length
and take the planned slots by a join. A text longer than the capacity is cut into full containers
and a rest, which is packed like any other item; no other text is split.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import hint_small, use_checkpoints

#: Ranks of one stretch of the join between documents and slots.
STRETCH = 1024
PLAN = "target_id int, length long, rank_from long, rank_to long, first_container long, per_container long, start long"


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Returns (length, rank_from, rank_to, first_container, per_container, start).

    Containers in the same state are kept as ranges, so the work follows the number of
    lengths, not that of items."""
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                insort(sizes, room)
            free[room].append((first, n))

    slots, made = [], 0
    for length in sorted((k for k in counts if k > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"an item of length {length} is longer than {capacity}")
        left, rank = counts[length], 0
        while left:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                room = sizes[i]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], sizes[i]
                use = min(n, left)
                slots.append((length, rank, rank + use, first, 1, capacity - room))
                put(room, first + use, n - use)
                put(room - length, first, use)
                rank, left = rank + use, left - use
                continue
            per = capacity // length
            for items, n in ((per, left // per), (left % per, 1)):
                if items and n:
                    slots.append((length, rank, rank + items * n, made, items, 0))
                    put(capacity - items * length, made, n)
                    made, rank = made + n, rank + items * n
            left = 0
    return slots


def pieces(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, capacity, doc_id, piece, offset, length): one row per document and target, more only where it is longer than the container."""
    cap, n = F.col("capacity"), F.col("n_tokens")
    full = F.floor(n / cap)
    chosen = targets.limit(1_001).collect()
    if len(chosen) > 1_000:
        raise ValueError("more than 1,000 container sizes")
    if not chosen:
        return lengths.sparkSession.createDataFrame([], "target_id int, capacity long, doc_id long, piece long, offset long, length long")
    each = F.array(*(F.struct(F.lit(r.target_id).alias("target_id"), F.lit(r.capacity).cast("long").alias("capacity")) for r in chosen))
    both = lengths.select("doc_id", "n_tokens", F.inline(each))
    parts = F.when(n <= cap, F.array(F.struct(F.lit(0).cast("long").alias("piece"), n.alias("length")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.when(n % cap == 0, full - 1).otherwise(full)), lambda i: F.struct(i.alias("piece"), F.least(cap, n - i * cap).alias("length")))
    )
    return both.select("target_id", "capacity", "doc_id", F.explode(parts).alias("p")).select("target_id", "capacity", "doc_id", "p.piece", (F.col("p.piece") * F.col("capacity")).alias("offset"), "p.length")


def pack(lengths: DataFrame, targets: DataFrame, *, salts: int = 64) -> DataFrame:
    """Place every document of (doc_id, n_tokens) into the containers of each target (target_id, capacity).

    Columns: target_id, container_id (from 0), start (first token in the container), doc_id, piece
    (0 unless split), offset (first token of the piece in the text), length. Defined cases: a text without
    tokens takes no room and is put at the start of container 0; a null count is 0; repeated ids are
    items of their own; an empty table gives no containers; targets without a positive capacity are left out.

    Only the length histogram reaches the driver: at most the sum of the capacities in rows. Ranks are
    numbered within (length, salt) and shifted by the counts of the salts before, so that a third
    of all documents may have the same length."""
    spark = lengths.sparkSession
    use_checkpoints(spark)
    lengths = lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).checkpoint()
    targets = targets.select(F.col("target_id").cast("int").alias("target_id"), F.col("capacity").cast("long").alias("capacity")).where("capacity > 0 and target_id is not null").dropDuplicates(["target_id"])
    items = pieces(lengths, targets).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = items.groupBy("target_id", "capacity", "length", "salt").agg(F.count("*").alias("n"))
    histogram: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts.groupBy("target_id", "capacity", "length").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault((r.target_id, r.capacity), {})[r.length] = r.n
    slots = [(target, *slot) for (target, capacity), h in histogram.items() for slot in plan_slots(h, capacity)]
    # slots by the stretches of ranks that they touch, so that a document of a frequent length meets its own stretch's slots only
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    plan = hint_small(spark.createDataFrame(slots, PLAN).withColumn("stretch", F.explode(F.sequence(stretch("rank_from"), F.floor((F.col("rank_to") - 1) / STRETCH)))), 300_000)
    before = Window.partitionBy("target_id", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("target_id", "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("target_id", "length", "salt").orderBy("doc_id", "piece")
    ranked = items.withColumn("own", F.row_number().over(inside) - 1).join(shift, ["target_id", "length", "salt"]).withColumn("rank", F.col("own") + F.col("shift")).withColumn("stretch", stretch("rank"))
    slot = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    a, p = ranked.alias("a"), plan.alias("p")
    placed = a.join(p, (F.col("a.target_id") == F.col("p.target_id")) & (F.col("a.length") == F.col("p.length")) & (F.col("a.stretch") == F.col("p.stretch")) & slot, "left")
    step = F.col("rank") - F.col("rank_from")
    return placed.select(
        "a.target_id", F.coalesce(F.col("first_container") + F.floor(step / F.col("per_container")), F.lit(0)).alias("container_id"),
        F.coalesce(F.col("start") + step % F.col("per_container") * F.col("a.length"), F.lit(0)).alias("start"), "doc_id", "piece", "offset", F.col("a.length").alias("length"),
    )
