"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards take up to their capacity, and moving a byte from shard i to shard j has a cost
(by default none if i is j, else one). Successive shortest paths solve that on the shard graph, whose size is the number
of shards and not of rows. The flow out of an old shard cuts its line of blocks into intervals; a document goes where its
middle byte lies, and a bounded number of documents then level what whole documents miss. Only shards that lose or gain
something are written again.

A block is (old shard, bucket of the id's hash) of about ``BLOCK_BYTES``, so a hot shard has many blocks. Ranges of blocks
are shuffled once; places on the line come from sums per block, and sorts stay within a block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_BYTES = 8 << 20
ROW_BYTES = 16
#: Rows of a shard, on average, that are offered for levelling: a bound on what the driver sees, whatever the table.
OFFERED = 64


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most and hold ``total``."""
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def min_cost_flow(supply: dict[int, int], capacity: list[int], cost: Callable[[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, at the least cost. Capacities must hold all supplies.

    Successive shortest paths with node potentials (Dijkstra); ties are broken by shard number.
    """
    cost = cost or (lambda i, j: int(i != j))
    olds = sorted(supply)
    if sum(supply.values()) > sum(capacity):
        raise ValueError("the new shards can't hold all bytes")
    n, m = len(olds), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # [to, capacity, cost, index of the reverse edge]

    def link(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, old in enumerate(olds):
        link(source, i, supply[old], 0)
        for j in range(m):
            link(i, n + j, supply[old], cost(old, j))
    for j, room in enumerate(capacity):
        link(n + j, sink, room, 0)
    potential = [0] * (n + m + 2)
    left = sum(supply.values())
    while left:
        far = [math.inf] * (n + m + 2)
        far[source] = 0
        came: dict[int, tuple[int, int]] = {}
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (to := d + price + potential[a] - potential[b]) < far[b]:
                    far[b], came[b] = to, (a, k)
                    heapq.heappush(queue, (to, b))
        for v, d in enumerate(far):
            if d < math.inf:
                potential[v] += d
        push, v = left, sink
        while v != source:
            a, k = came[v]
            push, v = min(push, graph[a][k][1]), a
        v = sink
        while v != source:
            a, k = came[v]
            graph[a][k][1] -= push
            graph[v][graph[a][k][3]][1] += push
            v = a
        left -= push
    flow = {}
    for i, old in enumerate(olds):
        for b, _room, _, back in graph[i]:
            if n <= b < n + m and (moved := graph[b][back][1]):
                flow[old, b - n] = moved
    return flow


def levelled(sizes: list[int], capacity: list[int], offered: dict[int, list[tuple[int, tuple]]]) -> list[tuple[tuple, int, int, int]]:
    """Moves (row, size, from, to) of whole rows that bring shards nearer to their capacities.

    A shard over its capacity gives one of its offered rows (size, row) to the one that lacks most, as long as the larger
    of the two differences gets smaller; the row whose size is nearest to half the distance between them goes first.
    """
    over = [n - c for n, c in zip(sizes, capacity, strict=True)]
    offered = {j: sorted(rows) for j, rows in offered.items()}
    moves = []
    closed: set[int] = set()
    while True:
        open_shards = [j for j in offered if j not in closed and offered[j] and over[j] > 0]
        if not open_shards:
            return moves
        j = max(open_shards, key=lambda k: (over[k], -k))
        to = min(range(len(over)), key=lambda k: (over[k], k))
        apart = over[j] - over[to]
        best = min(range(len(offered[j])), key=lambda k: abs(2 * offered[j][k][0] - apart))
        size, row = offered[j][best]
        if max(abs(over[j] - size), abs(over[to] + size)) >= max(abs(over[j]), abs(over[to])):
            closed.add(j)
            continue
        del offered[j][best]
        over[j], over[to] = over[j] - size, over[to] + size
        moves.append((row, size, j, to))


def plan(docs: DataFrame, old: Column, shards: int, *, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", cost: Callable[[int, int], int] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(rows of ``docs`` as columns id, text, size, text_crc32, old_shard, shard, slot; the flow).

    A row's size is its text's UTF-8 bytes (null: none) and ``ROW_BYTES``. ``old`` gives old shard numbers. Capacities are
    even by default. As rows aren't cut, a shard can miss its capacity by the rows at its cuts; up to ``OFFERED`` rows a
    shard on average then change shards to level that, among shards that the flow writes again anyway. Within a shard,
    slots count from 0 without a gap, in the order of (old shard, bucket, id, checksum); repeated rows have slots of their
    own, and tied rows any order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("size"), F.crc32(common.text_or_empty(text_col).cast("binary")).alias("text_crc32"), old.cast("int").alias("old_shard"))
    supply = {r.old_shard: r.n for r in rows.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}
    total = sum(supply.values())
    capacity = capacities or even(total, shards)
    flow = min_cost_flow(supply, capacity, cost)

    cuts: list[tuple[int, int, int, int]] = []  # old shard, from, to, shard
    for i in sorted(supply):
        at = 0
        for _, j in sorted(((i, j) for a, j in flow if a == i), key=lambda e: (e[0] != e[1], e[1])):
            cuts.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    buckets = spark.createDataFrame([(i, max(1, -(-n // block_bytes))) for i, n in sorted(supply.items())], "old_shard int, buckets bigint")
    rows = rows.join(F.broadcast(buckets), "old_shard").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets"))).drop("buckets")
    blocks = rows.groupBy("old_shard", "bucket").agg(F.sum("size").alias("n")).select("old_shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("old_shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    path = common.shared_dir(spark)
    # One row per block of ``block_bytes``; Spark broadcasts it only where its size allows.
    blocks = common.staged(blocks, f"{path}/blocks")
    intervals = spark.createDataFrame(cuts, "of int, from_byte bigint, to_byte bigint, shard int")
    line = Window.partitionBy("old_shard", "bucket").orderBy("id", "text_crc32", "size")

    def assigned(columns: list[str]) -> DataFrame:
        own = rows.select("id", "size", "text_crc32", "old_shard", "bucket", *columns).repartitionByRange("old_shard", "bucket")
        own = own.withColumn("nth", F.row_number().over(line)).withColumn("at", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        own = own.join(blocks, ["old_shard", "bucket"])
        middle = F.col("before") + F.col("at") + F.floor(F.col("size") / 2)
        return own.join(F.broadcast(intervals), (F.col("old_shard") == F.col("of")) & (middle >= F.col("from_byte")) & (middle < F.col("to_byte"))).drop("of", "from_byte", "to_byte", "before", "at")

    # Where rows lie is written once without their texts, so both the levelling and the slots work on a few numbers a row.
    placed = common.staged(assigned([]), f"{path}/placed")
    sizes, count = [0] * len(capacity), 0
    for r in placed.groupBy("shard").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
        sizes[r.shard], count = r.n, count + r.rows
    changed = affected(flow)
    every = max(1, count // max(1, OFFERED * len(changed)))
    offered: dict[int, list[tuple[int, tuple]]] = {}
    asked = placed.where(F.col("shard").isin(sorted(changed)) & (F.pmod(F.xxhash64("id", "nth"), F.lit(every)) == 0)) if changed else placed.where("false")
    for r in asked.select("shard", "size", "old_shard", "bucket", "nth").collect():
        offered.setdefault(r.shard, []).append((r.size, (r.old_shard, r.bucket, r.nth)))
    inside = [j for j in range(len(capacity)) if j in changed]
    moves = levelled([sizes[j] for j in inside], [capacity[j] for j in inside], {inside.index(j): own for j, own in offered.items()})
    for row, n, a, b in moves:
        flow[row[0], inside[b]] = flow.get((row[0], inside[b]), 0) + n
        flow[row[0], inside[a]] = flow.get((row[0], inside[a]), 0) - n
    flow = {k: n for k, n in flow.items() if n > 0 or k[0] != k[1]}
    moved = spark.createDataFrame([(*row, inside[b]) for row, _, _, b in moves], "old_shard int, bucket bigint, nth int, to int")

    def settled(frame: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(moved), ["old_shard", "bucket", "nth"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")

    parts = settled(placed).groupBy("shard", "old_shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    slots = Window.partitionBy("shard").orderBy("old_shard", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = common.staged(parts.select("shard", "old_shard", "bucket", F.coalesce(F.sum("n").over(slots), F.lit(0)).alias("base")), f"{path}/parts")
    within = Window.partitionBy("shard", "old_shard", "bucket").orderBy("nth")
    out = settled(assigned(["text"])).withColumn("place", F.row_number().over(within)).join(parts, ["shard", "old_shard", "bucket"])
    return out.select("id", "text", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("place") - 1).alias("slot")), flow


def affected(flow: dict[tuple[int, int], int]) -> set[int]:
    """Shards that lose or gain bytes; the files of all others stay as they are."""
    return {k for move in flow for k in move if move[0] != move[1]}


def rewrite(assigned: DataFrame, flow: dict[tuple[int, int], int], path: str) -> DataFrame:
    """Writes the affected new shards below ``path``, one folder each, and returns all rows: those read from the new files,
    and the rows of the shards that keep their files."""
    changed = sorted(affected(flow))
    is_changed = F.col("shard").isin(changed) if changed else F.lit(False)
    assigned.where(is_changed).write.mode("overwrite").partitionBy("shard").parquet(path)
    new = assigned.sparkSession.read.schema(assigned.schema).parquet(path)
    if {k for move in flow for k in move} <= set(changed):
        return new
    return new.unionByName(assigned.where(~is_changed))
