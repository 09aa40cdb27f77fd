"""Packing along a space-filling curve.

A document's token counts are hashed with signs into ``DIMENSIONS`` buckets, brought to length one and projected to three
numbers; their Hilbert key orders the corpus so that documents that share vocabulary are neighbours. The tokens are then
one line in that order, cut every ``length`` tokens: a document crosses into the next sequence where it must, and only
the corpus's last sequence is not full.

Tokens are made once and staged. Only (key, row, count) is range-sorted; running sums within a range and the sums of the
ranges give each document's place on the line, and each document is then cut by itself. Equal keys are ordered by row,
so a large group of copies spreads over ranges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .ppm import Table

LENGTH = 4096
END_ID = 2
DIMENSIONS = 64
CURVE_DIMENSIONS = 3
CURVE_BITS = 12
SEED = 20240601
#: Words that a worker remembers; the older half is forgotten beyond it.
REMEMBERED = 400_000
#: Rows that a worker has in lists at once.
SLICE = 512
#: White space and separators on which libraries differ; a text with one is encoded as a whole.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž]+)([.,;:!?]*)")

#: The settings of a vocabulary file whose plain words are merged here. Texts go to the library with others.
_ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ASSUMED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def is_assumed(file: dict) -> bool:
    """Whether ``Merges`` gives the library's ids of plain words: the settings are those above, every merge makes an id of
    its own from letters or from what earlier ones made, and no added token is without a "<"."""
    model = file["model"]
    if any(file.get(k) != v for k, v in _ASSUMED.items()) or any(model.get(k) != v for k, v in _ASSUMED_MODEL.items()) or len(model["vocab"]) > 1 << 16:
        return False
    letters, suffix = _byte_letters(), model["end_of_word_suffix"]
    known = {*letters, *(c + suffix for c in letters)}
    for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        if a not in known or b not in known or a + b in known:
            return False
        known.add(a + b)
    return known <= model["vocab"].keys() and all("<" in t["content"] for t in file["added_tokens"])


class Merges:
    """Byte-pair merges of many words at once, in numpy arrays, by a vocabulary file's ranks.

    Each round merges the best pair of every word that has one. A merge only makes pairs that rank after it, so all places
    of a word's best pair go together, from the left where they overlap.
    """

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = Table(np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64))

    def encode(self, words: list[str]) -> list[bytes]:
        data = [w.encode() for w in words]
        size = np.array([len(d) for d in data])
        code = np.frombuffer(b"".join(data), np.uint8)
        symbol, owner = self.inner[code], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[code[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.made)
        while len(symbol):
            inside = owner[1:] == owner[:-1]
            rank = np.full(len(symbol), none)
            at = np.flatnonzero(inside)
            found = self.ranks.find((symbol[at] << 16 | symbol[at + 1]).astype(np.uint64))
            rank[at] = np.where(found < 0, none, found)
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(symbol))))
            over = best == none
            if over.any():
                done.append((owner[over], symbol[over]))
                symbol, owner, rank, best = symbol[~over], owner[~over], rank[~over], best[~over]
                if not len(symbol):
                    break
            merge = rank == best
            follows = np.concatenate([[False], merge[1:] & merge[:-1]])
            if follows.any():  # a run of one pair: every second place
                index = np.arange(len(merge))
                begin = np.maximum.accumulate(np.where(merge & ~follows, index, -1))
                merge &= (index - begin) % 2 == 0
            symbol[merge] = self.made[rank[merge]]
            keep = ~np.concatenate([[False], merge[:-1]])
            symbol, owner = symbol[keep], owner[keep]
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        line = symbol[order].astype("<u2").tobytes()
        to = (2 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [line[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (chr(256 + n) for n in range(256 - len(own)))
    return [chr(b) if b in own else next(rest) for b in range(256)]


class Encoder:
    """Ids of texts by a tokenizers file, with remembered words.

    A vocabulary with the settings assumed drops white space and never joins across it, so a text's ids are those of its
    parts between white space, one after the other. Plain words are merged here, many at once; everything else, and whole
    texts where the file has other settings, is left to the library. Ids are little-endian, of two bytes each if all ids of
    the file fit, else of four.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4")
        file = json.loads(self.tokenizer.to_str())
        self.merges = Merges(file["model"]) if is_assumed(file) else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Makes all these parts known."""
        new, old = self.new, self.old
        split: list[tuple[str, str, str]] = []
        ask: set[str] = set()
        for p in parts:
            if (ids := old.get(p)) is not None:
                new[p] = ids
            elif m := _PLAIN.fullmatch(p):
                word, tail = m[1].lower(), m[2]
                if word == p:
                    ask.add(p)
                else:
                    split.append((p, word, tail))
                    for x in (word, tail):
                        if x and x not in new:
                            if (ids := old.get(x)) is not None:
                                new[x] = ids
                            else:
                                ask.add(x)
            else:
                new[p] = self.whole(p)
        if ask:
            words = list(ask)
            new.update(zip(words, self.merges.encode(words), strict=True))
        for p, word, tail in split:
            new[p] = new[word] + new[tail] if tail else new[word]

    def encode(self, texts: list[str], block: int = 512) -> list[bytes]:
        if self.merges is None:
            return [self.whole(t) for t in texts]
        out: list[bytes] = []
        for at in range(0, len(texts), block):
            if len(self.new) >= REMEMBERED // 2:
                self.new, self.old = {}, self.new
            own = texts[at : at + block]
            # The library lower-cases all but added tokens, which hold a "<" in the files assumed.
            parts = [None if _UNUSUAL.search(t) else t.lower().split() if t.isascii() and "<" not in t else t.split() for t in own]
            if missing := set().union(*(p for p in parts if p)).difference(self.new):
                self._learn(missing)
            known = self.new.__getitem__
            out += [self.whole(t) if p is None else b"".join(map(known, p)) for t, p in zip(own, parts, strict=True)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file: what it remembers serves later tasks too."""
    return Encoder(path)


def hilbert_keys(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (one row each), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@lru_cache(maxsize=1)
def _projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of an id's low 16 bits, and the projection of the buckets."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, DIMENSIONS, 1 << 16), draw.choice([-1.0, 1.0], 1 << 16), draw.standard_normal((DIMENSIONS, CURVE_DIMENSIONS))


def curve_points(id_lists: list[np.ndarray]) -> np.ndarray:
    bucket, sign, project = _projection()
    vectors = np.zeros((len(id_lists), DIMENSIONS))
    for i, ids in enumerate(id_lists):
        if len(ids):
            low = ids & 0xFFFF
            vectors[i] = np.bincount(bucket[low], sign[low], DIMENSIONS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    # A direction's projection is near normal with deviation one; three deviations cover the cube.
    return np.clip(((vectors @ project + 3) / 6 * (1 << CURVE_BITS)).astype(np.int64), 0, (1 << CURVE_BITS) - 1)


def cut(place: int, count: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document at a place on the line."""
    pieces, start = [], 0
    while start < count:
        sequence, offset = divmod(place + start, length)
        n = min(length - offset, count - start)
        pieces.append((start, n, sequence, offset))
        start += n
    return pieces


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, ids (binary, 32 bits each, little-endian).

    Every row of ``docs`` is a document, repeated ones too; a null or empty text is its end id alone. An empty table gives
    no piece. ``vocabulary`` is the path of a tokenizers file that executors can read, of any settings. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = common.shared_dir(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        size, end = own.kind.itemsize, np.array([end_id], own.kind).tobytes()
        row = TaskContext.get().partitionId() << 33
        for batch in _sliced(batches):
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            keys = hilbert_keys(curve_points([np.frombuffer(x, own.kind) for x in ids]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(ids)), pa.int64()), batch.column(0), pa.array([len(x) // size + 1 for x in ids], pa.int64()), pa.array(keys, pa.int64()), pa.array([x + end for x in ids], pa.binary())],
                names=["row", "id", "n", "key", "ids"],
            )
            row += len(ids)

    made = source.mapInArrow(tokenize, f"row bigint, id {kind}, n bigint, key bigint, ids binary")
    made.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/tokens")
    made = spark.read.schema(made.schema).parquet(f"{path}/tokens")

    sorted_rows = made.select("row", "n", "key").repartitionByRange("key", "row").withColumn("part", F.spark_partition_id())
    sorted_rows = common.staged(sorted_rows, f"{path}/order")
    sums = sorted(sorted_rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = [0]
    for r in sums:
        before.append(before[-1] + r.n)
    first = spark.createDataFrame([(r.part, b) for r, b in zip(sums, before, strict=False)], "part int, before bigint")
    within = Window.partitionBy("part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    places = sorted_rows.select("row", "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("at")).join(F.broadcast(first), "part").select("row", (F.col("at") + F.col("before")).alias("place"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows, blobs = [], []
            for i, (place, ids, count) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                whole = np.frombuffer(ids, f"<u{len(ids) // count}").astype("<u4").tobytes()
                for start, n, sequence, offset in cut(place, len(whole) // 4, length):
                    rows.append((i, start, n, len(whole) // 4, sequence, offset))
                    blobs.append(whole[4 * start : 4 * (start + n)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array(blobs, pa.binary())], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    out = made.join(places, "row").select("id", "place", "ids", "n").mapInArrow(pieces, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, tokens, ids: the packed sequences. One shorter than ``length`` is padded, unless a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"), F.sum("length").alias("tokens"))
    ids = F.array_join(F.transform("own", lambda x: F.hex(x["ids"])), "")
    full = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return whole.select("sequence_id", "tokens", F.unhex(F.when(full, ids).otherwise(F.concat(ids, F.expr(f"repeat('{np.array([pad_id], '<u4').tobytes().hex().upper()}', cast({length} - tokens as int))")))).alias("ids"))
