"""Language-model scoring by prediction by partial matching over bytes, beside an add-one word model.

Training counts every byte with the ``ORDER`` bytes before it, over all training texts; a text is preceded and ended by
byte 0xFF, which UTF-8 never holds. Counts are made per task with sorts in numpy and summed by one shuffle. Contexts
of every order up to ``ORDER`` form the trie, and every one that training has is kept, however rare.

A byte is coded in the longest known context. With n the context's count and d its distinct symbols, a seen symbol has
c / (n + d) and the escape d / (n + d). After an escape the next shorter context leaves out the symbols of the longer one
(symbol exclusion), and below the empty context all symbols not yet excluded are equally likely.

What a position costs depends on its code alone, its last ``ORDER`` bytes and itself. So the trie is never put together:
each distinct code of any text, those of held-out texts too, gets its log probability in a table. Codes are dealt out by
the last ``LOCAL`` bytes of their context: all longer contexts that end so lie in one place, and only the grams of orders
below ``LOCAL``, at most ``256 ** LOCAL`` of them, are sent to all. Codes with at least a ``2 ** -CODE_BITS`` share of all
positions (so at most ``2 ** CODE_BITS``) are sent out for scoring; the others are looked up by a shuffled join.

The word model needs the count of every word. Words with at least a ``2 ** -HOT_BITS`` share of the tokens (so at most
``2 ** HOT_BITS`` of them) are sent out; the others, none of them frequent enough to skew a partition, are looked up by a
shuffled join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
LOCAL = 2
CODE_BITS = 22
HOT_BITS = 19
EDGE = 0xFF
#: Bytes handled by one set of numpy arrays, and distinct entries held before they are handed on.
CHUNK = 2 << 20
HELD = 2 << 20
#: Codes whose log probabilities are made together, besides what the last of their groups has more.
SLICE = 1 << 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return data.lower().split()


def codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): for each byte and the end of each text, its last ``order`` bytes and itself as one integer."""
    pad = bytes([EDGE]) * order
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    line = np.frombuffer(b"".join(part for t in texts for part in (pad, t, b"\xff")), np.uint8)
    code = np.zeros(len(line) - order, np.uint64)
    for k in range(order + 1):
        code |= line[k : len(line) - order + k].astype(np.uint64) << np.uint64(8 * (order - k))
    begins = np.cumsum(sizes) - sizes
    if order and len(texts) > 1:  # windows that reach from one text into the next text's padding
        cut = (begins + order * np.arange(len(texts)))[1:, None] - np.arange(1, order + 1)[None, :]
        keep = np.ones(len(code), bool)
        keep[cut.ravel()] = False
        code = code[keep]
    return code, begins


def chunks(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts) with about ``size`` bytes in all; a longer text is alone."""
    own: list[bytes] = []
    first = total = 0
    for i, t in enumerate(texts):
        if own and total + len(t) > size:
            yield first, own
            own, first, total = [], i, 0
        own.append(t)
        total += len(t)
    if own:
        yield first, own


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of counts (by default of ones) of each."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Table:
    """A set of 64-bit keys with their positions, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.at = np.full(1 << bits, _EMPTY, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # of several that want one slot the last one gets it
            won = self.at[slot] == todo
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that aren't there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        todo = np.flatnonzero((there != keys) & (there != _EMPTY))
        slot = (slot[todo] + 1) & self.mask
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.at[slot[hit]]
            on = ~hit & (there != _EMPTY)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out


def _key(order: int, code: np.ndarray, width: int) -> np.ndarray:
    """The last ``width`` bytes of codes as keys of an order."""
    return (code & np.uint64((1 << (8 * width)) - 1)) | (np.uint64(order + 1) << np.uint64(56))


class Model:
    """The trie in arrays. ``grams``: for each order from 0, codes of (context, symbol) in order, and their counts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(grams) - 1
        keys, direct, count, contexts, escape, rest = [], [], [], [], [], []
        below = None
        for k, (code, c) in enumerate(grams):
            code, c = code.astype(np.uint64), c.astype(np.float64)
            context = code >> np.uint64(8)
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else np.zeros(0, np.int64)
            d = np.diff(np.append(at, len(code))).astype(np.float64)
            n = np.add.reduceat(c, at) if len(at) else np.zeros(0)
            keys.append(_key(k, code, k + 1))
            direct.append(np.log10(c / np.repeat(n + d, d.astype(np.int64))))
            count.append(np.log10(c))
            contexts.append(_key(k, context[at], k))
            escape.append(np.log10(d / (n + d)))
            if below is None:
                rest.append(np.zeros((2, len(at))))
            else:
                low_code, low_c, low_context, low_n, low_d = below
                shorter = np.searchsorted(low_code, code & np.uint64((1 << (8 * k)) - 1))
                parent = np.searchsorted(low_context, context[at] & np.uint64((1 << (8 * (k - 1))) - 1))
                taken = np.add.reduceat(low_c[shorter], at) if len(at) else np.zeros(0)
                rest.append(np.stack([low_n[parent] - taken, low_d[parent] - d]))
            below = (code, c, context[at], n, d)
            if k == 0:
                self.seen = len(code)
        self.direct, self.count = np.concatenate(direct), np.concatenate(count)
        self.escape, self.rest = np.concatenate(escape), np.concatenate(rest, axis=1)
        self.nodes, self.contexts = Table(np.concatenate(keys)), Table(np.concatenate(contexts))

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each position."""
        out = np.zeros(len(code))
        todo, escaped = np.arange(len(code)), np.zeros(len(code), bool)
        total, fresh = np.zeros(len(code)), np.zeros(len(code))  # of the context in turn, less what is excluded
        for k in range(self.order, -1, -1):
            here = code[todo]
            node = self.nodes.find(_key(k, here, k + 1))
            hit = node >= 0
            plain = hit & ~escaped
            out[todo[plain]] = self.direct[node[plain]]
            after = hit & escaped
            out[todo[after]] += self.count[node[after]] - np.log10(total[after] + fresh[after])
            todo, here, escaped, total, fresh = todo[~hit], here[~hit], escaped[~hit], total[~hit], fresh[~hit]
            context = self.contexts.find(_key(k, here >> np.uint64(8), k))
            kept = context >= 0
            first = kept & ~escaped
            out[todo[first]] += self.escape[context[first]]
            again = escaped & (fresh > 0)
            out[todo[again]] += np.log10(fresh[again] / (total[again] + fresh[again]))
            total[kept], fresh[kept] = self.rest[0][context[kept]], self.rest[1][context[kept]]
            escaped = escaped | kept
        out[todo] -= np.log10(256 - self.seen)
        return out

    def score(self, texts: list[bytes]) -> list[float]:
        """log10 probability of each text, its end included."""
        found: list[float] = []
        for _, own in chunks(texts):
            code, begins = codes(own, self.order)
            found += np.add.reduceat(self.logs(code), begins).tolist()
        return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task over (text, held out): rows (word, null, n, n) and (null, code, n, all).

    The empty word is a text's end. ``n`` counts training texts and ``all`` every text; words are those of training texts.
    """
    names = ["word", "code", "n", "all"]
    found: Counter = Counter()
    held, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)

    def of_words() -> pa.RecordBatch:
        n = pa.array(list(found.values()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.nulls(len(found), pa.int64()), n, n], names=names)

    def of_codes() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.binary()), pa.array(held.view(np.int64)), *(pa.array(c.copy()) for c in counts.T)], names=names)

    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
        out = batch.column(1).to_pylist()
        for learnt in (True, False):
            for _, own in chunks(t for t, o in zip(texts, out, strict=True) if o != learnt):
                if learnt:
                    for t in own:
                        found.update(tokens(t))
                    found[b""] += len(own)
                more, n = summed(codes(own)[0])
                held, counts = summed(np.concatenate([held, more]), np.concatenate([counts, np.stack([n * learnt, n], axis=1)]))
                if len(found) > HELD:
                    yield of_words()
                    found.clear()
                if len(held) > HELD:
                    yield of_codes()
                    held, counts = held[:0], counts[:0]
    if found:
        yield of_words()
    if len(held):
        yield of_codes()


def _mask(width: int) -> int:
    return (1 << (8 * width)) - 1


def code_logs(codes_of_all: DataFrame) -> DataFrame:
    """(code, all, log): the log10 probability of each code of (code, n, all), with n its count in training texts."""
    spark = codes_of_all.sparkSession
    low = codes_of_all.where("n > 0").groupBy(F.col("code").bitwiseAND(F.lit(_mask(LOCAL))).alias("g")).agg(F.sum("n").alias("n")).toArrow()
    grams, n = low.column(0).to_numpy().astype(np.uint64), low.column(1).to_numpy()
    sent = spark.sparkContext.broadcast([summed(grams & np.uint64(_mask(k + 1)), n) for k in range(LOCAL)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_slice(own: list[np.ndarray]) -> pa.RecordBatch:
            _, code, n, every = np.concatenate(own, axis=1)
            bits = code.astype(np.uint64)
            longer = [summed(bits[n > 0] & np.uint64(_mask(k + 1)), n[n > 0]) for k in range(LOCAL, ORDER + 1)]
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(every), pa.array(Model([*sent.value, *longer]).logs(bits))], names=["code", "all", "log"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size > SLICE and held[0][0, 0] != held[-1][0, -1]:  # all but the last group are whole
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0, -1]))
                yield of_slice([rows[:, :whole]])
                held, size = [rows[:, whole:]], rows.shape[1] - whole
        if size:
            yield of_slice(held)

    group = F.shiftright("code", 8).bitwiseAND(F.lit(_mask(LOCAL))).alias("group")
    dealt = codes_of_all.select(group, "code", "n", "all").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "code bigint, all bigint, log double")


def train(texts: DataFrame, path: str) -> tuple[DataFrame, DataFrame, int, int, int]:
    """(word counts (word, c), code logs (code, all, log), tokens N, distinct tokens V, positions) of a table (text, held out)."""
    counted = texts.mapInArrow(_count, "word binary, code bigint, n bigint, all bigint").groupBy("word", "code").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    counted = common.staged(counted, f"{path}/counts")
    words = counted.where("word is not null").select("word", F.col("n").alias("c"))
    tokens_seen, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    logs = common.staged(code_logs(counted.where("code is not null").select("code", "n", "all")), f"{path}/logs")
    positions = logs.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    return words, logs, int(tokens_seen), int(distinct), int(positions)


def known_logs(texts: list[bytes], table: Table, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, rest, ends): of each text the sum of the logs in the table, and all its other codes, those of text i in
    ``rest[ends[i]:ends[i + 1]]``."""
    sums, rest, sizes = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for _, own in chunks(texts):
        code, begins = codes(own)
        at = table.find(code)
        there = at >= 0
        sums.append(np.add.reduceat(np.where(there, logs[at] if len(logs) else 0.0, 0.0), begins))
        rest.append(code[~there].view(np.int64))
        sizes.append(np.add.reduceat((~there).astype(np.int64), begins))
    return np.concatenate(sums), np.concatenate(rest), np.cumsum(np.concatenate(sizes))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are learnt from unless crc32 of the id as text leaves 2 when divided by 7 (a null id counts as empty text, and
    so is learnt from). A null text is empty: one token, its end. Repeated rows are learnt from, and scored, each. With no
    training text every token has c = N = V = 0 and every byte is one of 256. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = common.shared_dir(spark)
    held = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7) == 2
    source = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    words, logs, seen, distinct, positions = train(source.select("text", "held_out"), path)
    hot = words.where(F.col("c") >= seen / 2.0**HOT_BITS).toArrow()
    hot = dict(zip(hot.column(0).to_pylist(), hot.column(1).to_pylist(), strict=True))
    below = float(np.log10(seen + distinct + 1))
    often = F.col("all") >= positions / 2.0**CODE_BITS
    common_codes = logs.where(often).select("code", "log").toArrow()
    sent = spark.sparkContext.broadcast(hot)
    sent_codes = spark.sparkContext.broadcast((Table(common_codes.column(0).to_numpy().astype(np.uint64)), common_codes.column(1).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        log_of = {w: (c, float(np.log10(c + 1))) for w, c in known.items()}
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            n_tokens, n_known, base = [], [], []
            offsets, rare, times = [0], [], []
            for t in texts:
                own = Counter(tokens(t))
                own[b""] = 1
                n = k = 0
                s = 0.0
                for w, m in own.items():
                    n += m
                    at = log_of.get(w)
                    if at is None:
                        rare.append(w)
                        times.append(m)
                    else:
                        k += m
                        s += m * at[1]
                n_tokens.append(n)
                n_known.append(k)
                base.append(s)
                offsets.append(len(rare))
            scores, far, far_to = known_logs(texts, *sent_codes.value)
            to = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(texts)), pa.int64()), batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.ListArray.from_arrays(to, pa.array(rare, pa.binary())), pa.ListArray.from_arrays(to, pa.array(times, pa.int64())), pa.ListArray.from_arrays(pa.array(far_to, pa.int32()), pa.array(far))],
                names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times", "codes"],
            )
            row += len(texts)

    kind = source.schema["id"].dataType.simpleString()
    scored = source.mapInArrow(run, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<binary>, times array<bigint>, codes array<bigint>")
    scored = common.staged(scored, f"{path}/scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("m"))
    looked = rare.join(words.where(F.col("c") < seen / 2.0**HOT_BITS), "word")
    looked = looked.select("row", F.col("m").alias("known"), (F.col("m") * F.log10(F.col("c") + 1)).alias("log"), F.lit(0.0).alias("code_log"))
    coded = scored.select("row", F.explode("codes").alias("code")).join(logs.where(~often), "code")
    coded = coded.select("row", F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("log"), F.col("log").alias("code_log"))
    extra = looked.unionByName(coded).groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("log").alias("more_base"), F.sum("code_log").alias("more_score"))
    out = scored.drop("rare", "times", "codes").join(extra, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(seen).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
