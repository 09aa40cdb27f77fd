"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A document is the set of 64-bit hashes of its distinct word shingles, kept as one sorted array; documents with equal
arrays are one class from the start. Each class that may have a partner gets a bitmap of its hashes, made and stored once.

1. Screening. At a threshold t a partner shares at least the fraction t of a set. Of the smallest ``1 - t + SLACK`` of its
   hashes at least the fraction ``SLACK`` is then shared with another class, or the set has no partner. Hashes go to
   buckets as packed arrays; a hash that more than two classes have within a task is sent on only twice.
2. Marks. The hashes of the classes left are put in order of how many of these classes have them, and each class is marked
   by the first ``1 - t`` of its own, plus one: linked classes have a mark in common. Hashes of one class alone come first,
   so that most classes have no mark left that another one has. A passage that thousands of documents share comes last: it
   marks only classes of which it is nearly all.
3. Stars. Each mark's smallest class is compared with the others that have it. That joins nearly all copies, however
   many, without pairs inside a group. Marks whose classes are now all in one component are done.
4. Tiles. What is left is compared in tiles. The classes of a mark that at most ``RARE`` classes have are a tile. Other
   marks are put together where a class has several, so that two classes meet once; such a cluster is cut into bands of
   set size, a band into blocks of about ``TILE`` classes, and a tile has two blocks of one band or of neighbouring bands.
   In a tile the differing bits of two bitmaps bound the overlap from above, for pairs of fitting sizes from different
   components. What remains is intersected exactly; in the blocks of a cluster, pairs that earlier ones have joined aren't.

Work on a cluster's tiles grows with the square of the number of its classes that share nearly everything and still don't
fit into one component; it is bit counts only, spread over tiles of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .ppm import chunks

WORDS = 5
#: Similarity in percent.
PERCENT = 75
#: Part of a set, in percent, that screening sees beyond the part that a partner may lack.
SLACK = 8
#: A mark that more classes have goes to the blocks of a cluster instead of a tile of its own.
RARE = 32
#: Bits of a bitmap: eight for each hash, within these powers of two.
LEAST_BITS, MOST_BITS = 6, 12
#: Bytes of text that one set of numpy arrays is made of, and rows handled at once: they bound a worker's memory.
CHUNK, SLICE = 1 << 18, 512
#: Hashes in one bucket, classes in one block, and rows of tiles in one task's group: sizes of tasks, not limits.
BUCKET, TILE, GROUP = 1 << 20, 2048, 8192

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _powers, _inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles. Fewer words are one shingle; no words, none.

    Words are joined by one blank, so a shingle is a stretch of bytes, whose hash is a difference of running sums.
    """
    lines = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    out: list[np.ndarray] = []
    for _, own in chunks(lines, CHUNK):
        joined = b"".join(x + b" " for x in own)
        data = np.frombuffer(joined, np.uint8)
        power, inverse = _power_tables(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        counts = [x.count(b" ") + 1 for x in own]
        at = 0
        for x, n in zip(own, counts, strict=True):
            if not x:
                out.append(np.zeros(0, np.uint64))
            else:
                m = max(1, n - words + 1)
                a, b = starts[at : at + m], ends[at + min(n, words) - 1 : at + min(n, words) - 1 + m]
                out.append(np.unique(_mix((sums[b] - sums[a]) * inverse[a])))
            at += n
    return out


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most: what is made of a batch is larger than the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _digest(own: np.ndarray) -> int:
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _screened(n: int, percent: int) -> tuple[int, int]:
    """(hashes of a set that screening looks at, how many of them must be shared)."""
    spare = n - -(-n * percent // 100)
    look = min(n, spare + 1 + n * SLACK // 100)
    return look, look - spare


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """The smallest intersection of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def signature(own: np.ndarray) -> np.ndarray:
    """A bitmap, in 64-bit words, with one bit set for the low bits of each hash."""
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * len(own) - 1).bit_length()))
    marks = np.zeros(1 << bits, np.uint8)
    marks[(own & np.uint64((1 << bits) - 1)).astype(np.int64)] = 1
    return np.packbits(marks).view(np.uint64)


def folded(bitmaps: np.ndarray) -> np.ndarray:
    """Bitmaps (one a row) of half the size: those of the same hashes by one low bit less."""
    half = bitmaps.shape[-1] // 2
    return bitmaps[..., :half] | bitmaps[..., half:]


def may_link(first: np.ndarray, second: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two equally wide tables of bitmaps may be linked. Each differing bit stands for an element that only
    one of the two sets has, so the overlap is at most half of what both sizes leave beside the differing bits."""
    apart = np.bitwise_count(first ^ second).sum(axis=-1, dtype=np.int64)
    return (n + m - apart) // 2 >= least_overlap(n, m, percent)


def tile_pairs(tile: np.ndarray, side: np.ndarray, n: np.ndarray, root: np.ndarray, bitmaps: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within each tile that may be linked: of fitting sizes, of different components, and with
    bitmaps that leave room for the overlap. Rows of side 0 are compared with all, those of side 1 with side 2 only."""
    order = np.lexsort((n, tile))
    tile, side, n, root = tile[order], side[order], n[order], root[order]
    width = np.array([len(bitmaps[i]) for i in order], np.int64)
    # One table of bitmaps for each width, and one of the bitmaps of twice the width, folded.
    place, tables = np.zeros(len(order), np.int64), {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        place[rows] = np.arange(len(rows))
        tables[w] = np.stack([bitmaps[order[i]] for i in rows])
    halves = {w // 2: folded(t) for w, t in tables.items() if w > 1}
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for d in range(1, len(order)):
        i = np.flatnonzero((tile[d:] == tile[:-d]) & (100 * n[:-d] >= percent * n[d:]))
        if not len(i):  # sizes go up within a tile, so none further apart fits either
            break
        j = i + d
        keep = (root[i] != root[j]) & ((side[i] == 0) | (side[i] + side[j] == 3))
        i, j = i[keep], j[keep]
        for w in np.unique(width[i]).tolist():
            for twice in (False, True):
                own = (width[i] == w) & (width[j] == w * (2 if twice else 1))
                if own.any():
                    a, b = i[own], j[own]
                    fits = may_link(tables[w][place[a]], (halves if twice else tables)[w][place[b]], n[a], n[b], percent)
                    left.append(order[a[fits]])
                    right.append(order[b[fits]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """id, n (set size), class (digest of the set; 0 for an empty one), look, low (the smallest hashes, packed)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, SLICE):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            look = [_screened(len(s), percent)[0] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else 0 for s in sets], pa.int64()), pa.array(look, pa.int64()), pa.array([s[:k].tobytes() for s, k in zip(sets, look, strict=True)], pa.binary())],
                names=["id", "n", "class", "look", "low"],
            )

    return source.mapInArrow(run, f"id {kind}, n bigint, class bigint, look bigint, low binary")


def _shared_counts(low: DataFrame, buckets: int) -> DataFrame:
    """class, shared: how many of the hashes in ``low`` another class has too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 8 * SLICE):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not sets:
                continue
            h = np.concatenate(sets)
            owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(s) for s in sets])
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[once], owner[once]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            extra = nth >= 2
            # What is counted here already goes by the class, the rest by the hash.
            bucket = np.where(extra, buckets + (owner.view(np.uint64) % np.uint64(buckets)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            bucket, short, owner = bucket[order], h[order].astype(np.uint32), owner[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            to = [*at[1:].tolist(), len(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[at], pa.int64()), pa.array([short[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary())],
                names=["bucket", "hashes", "owners"],
            )

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column(0)[0].as_py()
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in group.column(2).to_pylist()])
        if bucket < buckets:
            # Within a bucket 32 more bits of the hash are enough: two hashes taken for one only let a class pass.
            h = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column(1).to_pylist()])
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[once], owner[once]
            same = h[1:] == h[:-1]
            owner = owner[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(h) else owner
        found, n = np.unique(owner, return_counts=True)
        return pa.table({"class": pa.array(found, pa.int64()), "shared": pa.array(n, pa.int64())})

    dealt = low.mapInArrow(deal, "bucket bigint, hashes binary, owners binary")
    return dealt.groupBy("bucket").applyInArrow(count, "class bigint, shared bigint").groupBy("class").agg(F.sum("shared").alias("shared"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b) of classes: bitmaps first, then the arrays of those that are left."""
    of = lambda c, what: sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col(what).alias(f"{what}_{c}"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 8 * SLICE):
            a, b, n, x, m, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for k in range(len(a)):
                one, other = np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64)
                while len(one) != len(other):
                    one, other = (folded(one), other) if len(one) > len(other) else (one, folded(other))
                if may_link(one, other, n[k], m[k], percent):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, SLICE):
            one, other = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            keep = [k for k, (x, y) in enumerate(zip(one, other, strict=True)) if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    kinds = "a bigint, b bigint"
    joined = lambda p, what: p.join(of("a", what), "a").join(of("b", what), "b").select("a", "b", "n_a", f"{what}_a", "n_b", f"{what}_b")
    left = joined(pairs.select("a", "b"), "bits").mapInArrow(bounded, kinds)
    return joined(left, "own").mapInArrow(exact, kinds)


def components(links: DataFrame, path: str) -> DataFrame:
    """class, root: of all classes with a link the smallest class that they reach, by large and small stars in turn.

    Every round writes its stars below ``path``; a round that changes nothing is the last.
    """
    stars = common.staged(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), f"{path}/links")
    state, turn = None, 0
    while True:
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
        small = small.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        stars = common.staged(small, f"{path}/stars{turn}")
        now = tuple(stars.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            break
        state, turn = now, turn + 1
    return stars.select(F.col("x").alias("class"), F.col("y").alias("root")).unionByName(stars.select(F.col("y").alias("class"), F.col("y").alias("root")).distinct())


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, class, n for every hash of rows (class, n, own)."""
    for batch in _sliced(batches, SLICE):
        own = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        if own:
            size = [len(s) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), *(pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), size), pa.int64()) for i in (0, 1))], names=["h", "class", "n"])


def _in_band(percent: int):
    return F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")


def marks(sets: DataFrame, percent: int, path: str) -> DataFrame:
    """h, c, class, n: the first hashes of each class, by how many classes have them (c, two at least)."""
    rows = sets.select("class", "n", "own").mapInArrow(_exploded, "h bigint, class bigint, n bigint")
    often = common.staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"{path}/often")
    shared = rows.join(often, "h").groupBy("class").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("own"))
    first = f"cast(n - (n * {percent} + 99) div 100 + 1 - (n - size(own)) as int)"  # hashes of one class alone come before
    first = shared.withColumn("first", F.expr(first)).where("first > 0").select("class", "n", F.explode(F.slice("own", F.lit(1), F.col("first"))).alias("x"))
    return first.select("x.h", "x.c", "class", "n")


def _blocks(hot: DataFrame, percent: int, path: str) -> DataFrame:
    """tile, side, class, n, root: the classes of common marks (class, pivot, n, root) in all tiles of their clusters."""
    clusters = components(hot.select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct(), f"{path}/clusters")
    band = F.floor(F.log(F.col("n")) / (float(np.log(100 / percent)) * (1 + 1e-9)))
    items = hot.select("class", "n", "root").distinct().join(clusters.withColumnRenamed("root", "cluster"), "class").withColumn("band", band)
    items = common.staged(items, f"{path}/items")
    parts = common.staged(items.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts")), f"{path}/parts")
    items = items.join(parts, ["cluster", "band"]).withColumn("i", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    numbers = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j")
    out = None
    for step in (0, 1, -1):  # the band itself, as the lower one of two, as the upper one
        others = parts.select("cluster", (F.col("band") - step).alias("band"), "parts")
        met = items.join(others, ["cluster", "band"]).select("cluster", "band", "class", "n", "root", "i", numbers)
        low, high = (F.least("i", "j"), F.greatest("i", "j")) if step == 0 else (F.col("i"), F.col("j")) if step == 1 else (F.col("j"), F.col("i"))
        side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2) if step == 0 else F.lit(1 if step == 1 else 2)
        tile = F.xxhash64("cluster", F.col("band") + min(step, 0), F.lit(abs(step)), low, high)
        met = met.select(tile.alias("tile"), side.cast("int").alias("side"), "class", "n", "root")
        out = met if out is None else out.unionByName(met)
    return out


def _dealt(rows: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of tiles with what the sets table has of their classes, and ``tiles``, the group that a tile goes to."""
    groups = max(1, -(-rows.count() // GROUP))
    return rows.join(sets.select("class", *columns), "class").withColumn("tiles", F.pmod(F.xxhash64("tile"), F.lit(groups)))


def _fitting(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    tile, side, own, n, root = (group.column(c).to_numpy() for c in ("tile", "side", "class", "n", "root"))
    return *tile_pairs(tile, side, n, root, [np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()], percent), own, root


def _candidates(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that may be linked, from the tiles of rows (tile, side, class, n, root)."""

    def run(group: pa.Table) -> pa.Table:
        i, j, own, _ = _fitting(group, percent)
        pairs = np.unique(np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j])]), axis=1)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return _dealt(rows, sets, ["bits"]).groupBy("tiles").applyInArrow(run, "a bigint, b bigint").distinct()


def joining(i: np.ndarray, j: np.ndarray, root: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the pairs (i, j) link two components that no pair before them has joined: the arrays of others aren't looked at."""
    to: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := to.get(x, x)) != x:
            to[x] = to.get(y, y)
            x = y
        return x

    out = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = find(int(root[a])), find(int(root[b]))
        if x != y and linked(sets[a], sets[b], percent):
            to[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _joining(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each tile as far as its pairs do: fewer than it has components."""

    def run(group: pa.Table) -> pa.Table:
        i, j, own, root = _fitting(group, percent)
        pick = joining(i, j, root, [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()], percent)
        return pa.table({"a": pa.array(own[i[pick]]), "b": pa.array(own[j[pick]])})

    return _dealt(rows, sets, ["bits", "own"]).groupBy("tiles").applyInArrow(run, "a bigint, b bigint")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, class of every row; class, component_id, first_class of every class that isn't empty).

    ``first_class`` is the smallest class that has the component's smallest id. Only what is returned stays on disk.
    """
    spark = docs.sparkSession
    path, kept = common.shared_dir(spark), common.shared_dir(spark)
    made = common.staged(sketches(docs, id_col, text_col, words, percent), f"{path}/sketches")
    ids = common.staged(made.select("id", "n", "class"), f"{kept}/ids")
    classes = common.staged(made.where("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("look").alias("look")), f"{kept}/classes")
    total = made.agg(F.coalesce(F.sum("look"), F.lit(0))).first()[0]
    shared = _shared_counts(made.where("n > 0").select("class", "low"), max(16, -(-total // BUCKET)))
    spare = F.expr(f"n - (n * {percent} + 99) div 100")
    passing = common.staged(classes.join(shared, "class").where(F.col("shared") >= F.col("look") - spare).select("class", "id", "n"), f"{path}/passing")
    common.free(spark, f"{path}/sketches")

    few = common.may_hold(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", passing.select("id"), passing.count())
    few = few.where(few.columns[-1]).select("id", "text")
    kind = few.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, SLICE):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(s) if len(s) else 0 for s in sets], pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "class", "bits", "own"],
            )

    sets = few.mapInArrow(whole, f"id {kind}, class bigint, bits binary, own binary").alias("s").join(passing.alias("p"), (F.col("s.class") == F.col("p.class")) & F.col("s.id").eqNullSafe(F.col("p.id")))
    sets = common.staged(sets.select("p.class", "p.n", "s.bits", "s.own").dropDuplicates(["class"]), f"{path}/sets")

    marked = common.staged(marks(sets, percent, path), f"{path}/marks")
    pivots = marked.groupBy("h").agg(F.min(F.struct("class", "n")).alias("p")).select("h", F.col("p.class").alias("pivot"), F.col("p.n").alias("m"))
    marked = common.staged(marked.join(pivots, "h"), f"{path}/pivots")
    stars = marked.where(F.col("class") != F.col("pivot")).where(_in_band(percent)).select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    stars = common.staged(stars, f"{path}/stars")
    links = common.staged(_verified(stars, sets, percent), f"{path}/first_links")

    roots = components(links, f"{path}/first")
    placed = common.staged(marked.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), f"{path}/placed")
    mixed = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    mixed = common.staged(placed.join(mixed, "h", "left_semi"), f"{path}/mixed")
    tiles = mixed.where(F.col("c") <= RARE).select(F.col("h").alias("tile"), F.lit(0).alias("side"), "class", "n", "root")
    asked = common.staged(_candidates(tiles, sets, percent).join(stars, ["a", "b"], "left_anti"), f"{path}/asked")
    blocks = common.staged(_blocks(mixed.where(F.col("c") > RARE), percent, path), f"{path}/blocks")
    links = links.unionByName(common.staged(_verified(asked, sets, percent), f"{path}/links")).unionByName(common.staged(_joining(blocks, sets, percent), f"{path}/joining"))

    roots = components(links, f"{path}/all")
    placed = classes.select("class", "id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    # Nulls are smallest in a struct, so whether an id is null goes first.
    smallest = common.staged(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "class")).alias("s")), f"{path}/smallest")
    out = placed.join(smallest, "root").select("class", F.col("s.id").alias("component_id"), F.col("s.class").alias("first_class"))
    out = common.staged(out, f"{kept}/components")
    common.free(spark, path, f"{kept}/classes")
    return ids, out


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id (the smallest id that links reach; its own included).

    A null text and one without words have no shingles and no links: their component is their own id. Very long texts are
    sets like others. Ties don't matter: a component has one smallest id. Repeated rows are linked with each other. A null
    id is never smallest; where a component has no other, it is null. An empty table gives no rows. Other columns are not
    looked at.
    """
    ids, found = _classes(docs, id_col, text_col, words, percent)
    out = ids.join(found, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of ``docs``: of its rows with the smallest id (a null id only where there
    is no other), one of the class with the smallest digest. Rows without words are no copies of another: all stay.

    Where several rows have that id and that class, any one of them is kept. Rows that share an id but no component are
    each judged by their own text. Only rows whose id may be in question are shuffled. An empty table stays empty.
    """
    spark = docs.sparkSession
    ids, found = _classes(docs, id_col, text_col, words, percent)
    path = common.shared_dir(spark)
    rows = ids.where("n > 0").groupBy("id", "class").agg(F.count(F.lit(1)).alias("copies")).join(found, "class")
    stays = (F.col("class") == F.col("first_class")) & F.col("id").eqNullSafe(F.col("component_id"))
    rows = common.staged(rows.select("id", "class", "copies", stays.alias("stays")), f"{path}/found")
    asked = rows.where("not stays or copies > 1").select("id").distinct()
    marked = common.may_hold(docs, id_col, asked, asked.count())
    mark, digest = marked.columns[-1], common.fresh(docs, "digest")
    name = F.col(f"`{id_col}`")
    sure = marked.where(~F.col(mark)).drop(mark)
    at = docs.columns.index(text_col)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, SLICE):
            sets = shingle_sets(batch.column(at).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())], names=[*batch.schema.names, digest])

    doubtful = marked.where(F.col(mark)).drop(mark)
    doubtful = doubtful.mapInArrow(digests, StructType([*doubtful.schema.fields, StructField(digest, LongType())]))
    stay = rows.where("stays").select(F.col("id").alias("stay_id"), F.col("class").alias("stay_class"))
    copies = doubtful.where(F.col(digest).isNotNull()).join(stay, name.eqNullSafe(F.col("stay_id")) & (F.col(digest) == F.col("stay_class")), "left_semi")
    copies = copies.dropDuplicates([id_col, digest])
    own = [F.col(f"`{c}`") for c in docs.columns]
    return sure.select(*own).unionByName(doubtful.where(F.col(digest).isNull()).select(*own)).unionByName(copies.select(*own))
