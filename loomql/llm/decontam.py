"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows.

A text is normalised by one byte translation: A-Z become lower case and every ASCII byte that is no letter or digit
becomes a blank, so that words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. All windows of all items are entered
into one automaton as blank-delimited byte strings; each document is scanned once, whatever the number of items. Word
positions that matched are mapped back to code points of the original text.

Documents aren't shuffled: the scan is a map stage, and a lost executor repeats only its own partitions. The benchmark's
size is checked before it is sent out: beyond ``MAX_BENCHMARK_BYTES`` its windows are dealt into blocks by their hash, and
texts are scanned once for each block, so that no task holds more than one block's automaton, however large the benchmark
or one of its items is. Hits of several blocks are put together by row. A worker builds an automaton once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Text of one automaton: a node for each byte of each window takes some 330 times as much memory.
MAX_BENCHMARK_BYTES = 1 << 20

#: A word in the text as it was, where A-Z are not yet lower case.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(item_words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Windows of ``size`` words; a shorter item that has words is one window."""
    for i in range(max(1, len(item_words) - size + 1) if item_words else 0):
        yield b" " + b" ".join(item_words[i : i + size]) + b" "


def automaton(items: Iterable[tuple], size: int = WINDOW):
    """Automaton of all windows; a window's value is (its words, its bytes, the items that have it). None without windows."""
    owners: dict[bytes, set] = {}
    for item_id, text in items:
        for w in windows(words(text), size):
            owners.setdefault(w, set()).add(item_id)
    return of_windows(owners)


def of_windows(owners: dict[bytes, Iterable]):
    """Automaton of windows with the items that have them."""
    import ahocorasick

    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(w.decode("latin-1"), (w.count(b" ") - 1, len(w), tuple(sorted(ids, key=str))))
    found.make_automaton()
    return found


def scan(found, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged hit ranges of word positions (end exclusive), and the items met."""
    own = words(text)
    if found is None or not own:
        return len(own), [], set()
    line = b" " + b" ".join(own) + b" "
    items: set = set()
    ends: list[tuple[int, int, int]] = []
    for end, (n, width, ids) in found.iter(line.decode("latin-1")):
        ends.append((end - width + 1, n, end))
        items.update(ids)
    if not ends:
        return len(own), [], items
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = np.searchsorted(blanks, [e[0] for e in ends])
    merged: list[tuple[int, int]] = []
    for a, n in sorted(zip(first.tolist(), (e[1] for e in ends), strict=True)):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], a + n))
        else:
            merged.append((a, a + n))
    return len(own), merged, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of word ranges in the text as it was."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_built: dict[str, object] = {}


def _once(key: str, owners: dict[bytes, Iterable]):
    """The automaton of a block; a worker that runs several tasks builds it once, and holds one at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = of_windows(owners)
    return _built[key]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, max_bytes: int) -> Iterator:
    """Broadcasts of (key, {window: items}), one for each block; a single one where the benchmark is small enough."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    kind = items.schema["i"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own = sorted(set(windows(words(batch.column(1)[at].as_py()), size)))
                for first in range(0, len(own), 4096):
                    some = own[first : first + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([batch.column(0)[at].as_py()] * len(some), batch.schema.field(0).type)], names=["w", "i"])

    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 if total <= max_bytes else -(-2 * total // max_bytes)
    made = items.mapInArrow(cut, f"w binary, i {kind}").groupBy("w").agg(F.collect_set("i").alias("i"))
    if blocks > 1:
        path = common.shared_dir(spark)
        made = common.staged(made.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks))), f"{path}/windows")
    for k in range(blocks):
        own = made if blocks == 1 else made.where(F.col("block") == k)
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, {bytes(r.w): list(r.i) for r in own.select("w", "i").toLocalIterator()}))
    if blocks > 1:
        common.free(spark, path)


_FOUND = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


def _scanned(source: DataFrame, sent, item_type: str) -> DataFrame:
    """row, id, n_words, found (ranges of words with their code points) and items of each row of (row, id, text)."""
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _once(*sent.value)
        kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))
        for batch in batches:
            n_words, ranges_of, met = [], [], []
            for text in batch.column(2).to_pylist():
                n, ranges, items = scan(found, text)
                n_words.append(n)
                ranges_of.append([{"first": a, "last": b, "start": x, "end": y} for (a, b), (x, y) in zip(ranges, original_spans(text or "", ranges), strict=True)])
                met.append(sorted(items, key=str))
            kind = pa.list_(pa.int64() if item_type == "bigint" else pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(ranges_of, kinds), pa.array([[x if item_type == "bigint" else str(x) for x in m] for m in met], kind)], names=["row", "id", "n_words", "found", "items"])

    return source.mapInArrow(run, f"row bigint, id {id_type}, n_words bigint, found {_FOUND}, items array<{item_type}>")


def _merged(found: Column) -> Column:
    """Ranges of several blocks as ranges that neither overlap nor touch, in order."""
    joined = lambda a, b: F.struct(a["first"].alias("first"), F.greatest(a["last"], b["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined(F.try_element_at(acc, F.lit(-1)), x)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.sort_array(found), F.array().cast(_FOUND), step)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_hit, spans (code points of the original), items, items_sha256.

    Null or empty texts have no words and no hits; very long texts are scanned whole; repeated rows give repeated rows;
    tied windows of several items count for each of them; an empty benchmark hits nothing; other columns, whatever their
    names, are not looked at. Items with a null text have no windows.
    """
    spark = docs.sparkSession
    item_type = "bigint" if benchmark.schema[item_col].dataType.simpleString() in ("bigint", "int") else "string"
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, size, max_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = _scanned(source, first, item_type)
    else:
        path = common.shared_dir(spark)
        source = common.staged(source, f"{path}/rows")  # so that a row keeps its number
        out = common.staged(_scanned(source, first, item_type), f"{path}/0")
        for k, sent in enumerate(chain([second], blocks)):
            more = common.staged(_scanned(source, sent, item_type).where("size(items) > 0").select("row", "found", "items"), f"{path}/{k + 1}")
            out = out.unionByName(more, allowMissingColumns=True)
        whole = out.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("found")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = common.staged(whole.withColumn("found", _merged(F.col("found"))), f"{path}/whole")
        common.free(spark, f"{path}/rows")
    n_hit = F.aggregate("found", F.lit(0).cast("bigint"), lambda acc, x: acc + x["last"] - x["first"])
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256)
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), F.array_sort("items").alias("items"), digest.alias("items_sha256"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they were. The scan runs beside the row: nothing is joined. With
    several blocks, each one's rows are staged before the next."""
    at = docs.columns.index(text_col)

    def clean(rows: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _once(*sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not scan(found, t)[1] for t in batch.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    out, before = docs, None
    blocks = _blocks(benchmark, item_col, item_text_col, size, max_bytes)
    sent = next(blocks)
    for after in blocks:
        path = common.shared_dir(docs.sparkSession)
        out = common.staged(clean(out, sent), path)
        if before:
            common.free(docs.sparkSession, before)
        before, sent = path, after
    return clean(out, sent)
