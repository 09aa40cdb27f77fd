"""Quality rules under weak supervision, in DataFrame operations only.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0). Rows are aggregated to counts per
vote pattern (at most ``3 ** len(RULES)`` patterns whatever the number of rows, so the table that reaches the driver is
bounded), expectation-maximisation on those counts estimates the share of good texts and each rule's accuracy on good and
on bad texts, and the posterior is then a sum of log odds over votes: one column expression.

Votes alone don't tell a rule that finds a kind of junk from one that is often wrong, where no other rule agrees or
objects. What does is a prior on accuracies, which gives way to the counts, and labels of some rows, where there are any:
all of them are counted by pattern, so they are bounded as the patterns are.

Counts are made inside the row. Windows of eight words are compared as 64-bit hashes within one text; nothing is
exploded or shuffled but the pattern counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Distinct words are counted in blocks of so many, so that their share doesn't fall with the length of a text.
BLOCK = 2000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows added to every count of votes in the estimates, so that no rule is ever certain.
SMOOTH = 0.5
#: What a rule is thought to vote before any count: on good texts, on its own kind of junk, on other junk.
ON_GOOD, ON_OWN, ON_OTHER = {-1: 0.002, 0: 0.098, 1: 0.9}, {-1: 0.9, 0: 0.05, 1: 0.05}, {-1: 0.1, 0: 0.1, 1: 0.8}
#: The weight of the last two beside the counts (the same for every number of rows), and how many rows labelled good would
#: weigh as much as the first.
PRIOR, GOOD_ROWS = 0.3, 100
FIRST_GOOD = 0.8


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows found twice or more, from the hashes of all windows in order."""

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        again = F.filter(
            F.transform(s, lambda x, i: F.struct((((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))).alias("twice"), x["i"].alias("i"))),
            lambda x: x["twice"],
        )
        return _let(
            F.sort_array(F.transform(again, lambda x: x["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.when(k < F.size(p) - 1, F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - at)).otherwise(F.lit(WINDOW)).cast("bigint")),
                F.lit(0).cast("bigint"),
                lambda acc, x: acc + x,
            ),
        )

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and one struct column ``q`` (or ``q1``... if taken) of counts. Null texts count as empty."""
    q = common.fresh(docs, "q")
    text = common.text_or_empty(text_col)
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    words = F.filter(F.split(text, common.BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumn(q, F.struct(words.alias("words"), F.transform(words, lambda w: F.xxhash64(w)).alias("wh"), lines.alias("lines")))
    w, wh, li = F.col(f"{q}.words"), F.col(f"{q}.wh"), F.col(f"{q}.lines")
    n = F.size(w)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(wh[i + k] for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.size(F.array_distinct(F.slice(wh, i + 1, BLOCK))).cast("bigint"))
    second = first.withColumn(
        q,
        F.struct(
            n.cast("bigint").alias("n_words"), F.aggregate(blocks, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("n_distinct"),
            F.size(li).cast("bigint").alias("n_lines"), (F.size(li) - F.size(F.array_distinct(li))).cast("bigint").alias("n_dup_lines"), hashes.alias("hashes"),
            F.char_length(text).cast("bigint").alias("n_chars"), without(common.BLANK).cast("bigint").alias("word_chars"),
            (F.char_length(text) - without(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), (F.char_length(text) - without(r"[!?]")).cast("bigint").alias("n_shouts"),
            (F.char_length(text) - without(r"\p{Lu}+")).cast("bigint").alias("n_upper"), (F.char_length(text) - without(r"\p{L}+")).cast("bigint").alias("n_letters"),
        ),
    )
    h = F.col(f"{q}.hashes")
    repeat = F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("bigint"))
    names = ("n_words", "n_distinct", "n_lines", "n_dup_lines", "n_chars", "word_chars", "n_symbols", "n_shouts", "n_upper", "n_letters")
    return second.withColumn(q, F.struct(*(F.col(f"{q}.{x}").alias(x) for x in names), repeat.alias("n_repeat_words")))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def _rules(q: str) -> dict[str, Column]:
    c = lambda x: F.col(f"{q}.{x}")
    n, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    return {
        "symbols": _vote(c("n_symbols") * 20 > chars, c("n_symbols") * 200 <= chars),
        "shouting": _vote(c("n_shouts") * 20 > chars, c("n_shouts") * 100 <= chars),
        "capitals": _vote(c("n_upper") * 10 > c("n_letters") * 4, c("n_upper") * 10 <= c("n_letters") * 2),
        "repeats": _vote(c("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT, c("n_repeat_words") * 100 <= n * 25),
        "lines": _vote((c("n_dup_lines") * 10 > c("n_lines") * 3) & (c("n_lines") >= 5), c("n_dup_lines") * 4 <= c("n_lines")),
        "variety": _vote(c("n_distinct") * 5 < n, c("n_distinct") * 5 >= n * 2),
        "letters": _vote(c("n_letters") * 10 < chars * 7, c("n_letters") * 100 >= chars * 85),
        "word_size": _vote((chars < n * 2) | (chars > n * 15), (chars >= n * 3) & (chars <= n * 10)),
    }


RULES = ("symbols", "shouting", "capitals", "repeats", "lines", "variety", "letters", "word_size")
VOTES = (-1, 0, 1)


def fit(patterns: list[tuple[tuple[int, ...], int | None, int]], rounds: int = 200) -> list[tuple[float, list[dict[int, float]]]]:
    """Classes as (share, per rule how often it casts each vote), the good one first, by EM on counts of (votes, label).

    Junk comes in kinds, and a rule that knows one kind has nothing to say on the others; one class for all junk would let
    the silence of the other rules outvote it. So there is one class per rule besides the good one. Rows labelled 1 are of
    the good class, rows labelled 0 of any other, and those without a label of any. No accuracy has a bound: on junk it is
    what the class's rows say, drawn by ``PRIOR`` to what is thought of the rule. How often a rule blames good rows is told
    by rows labelled good and what is thought of the rule, as rows without a label can't tell it; how its other votes divide
    is told by all. No rows: every class keeps its first share.
    """
    classes = len(RULES) + 1
    thought = [[ON_GOOD if c == 0 else ON_OWN if c == r + 1 else ON_OTHER for r in range(len(RULES))] for c in range(classes)]
    shares, rates = [FIRST_GOOD] + [(1 - FIRST_GOOD) / len(RULES)] * len(RULES), thought
    blamed, sure = [GOOD_ROWS * ON_GOOD[-1]] * len(RULES), float(GOOD_ROWS)
    for votes, label, n in patterns:
        if label == 1:
            blamed, sure = [b + n * (v < 0) for b, v in zip(blamed, votes, strict=True)], sure + n
    total = sum(n for *_, n in patterns)
    for _ in range(rounds if total else 0):
        before = shares
        weights: list[list[float]] = [[] for _ in range(classes)]
        for votes, label, n in patterns:
            own = posterior(votes, shares, rates, label)
            for c in range(classes):
                weights[c].append(own[c] * n)
        sums = [math.fsum(w) for w in weights]
        shares, rates = [(x + SMOOTH) / (total + classes * SMOOTH) for x in sums], []
        for c, weight in enumerate(weights):
            cast = [dict.fromkeys(VOTES, SMOOTH) for _ in RULES]
            for w, (votes, _, _) in zip(weight, patterns, strict=True):
                for r, v in enumerate(votes):
                    cast[r][v] += w
            if c == 0:
                own = [{-1: b / sure} | {v: (1 - b / sure) * x[v] / (x[0] + x[1]) for v in (0, 1)} for b, x in zip(blamed, cast, strict=True)]
            else:
                own = [{v: (x / (sums[c] + 3 * SMOOTH) + PRIOR * thought[c][r][v]) / (1 + PRIOR) for v, x in one.items()} for r, one in enumerate(cast)]
            rates.append(own)
        if max(abs(x - y) for x, y in zip(shares, before, strict=True)) < 1e-10:
            break
    return list(zip(shares, rates, strict=True))


def posterior(votes: tuple[int, ...], shares: list[float], rates: list[list[dict[int, float]]], label: int | None = None) -> list[float]:
    """How likely each class is for votes; a label leaves the good class alone (1) or all others (0)."""
    logs = [math.log(s) + math.fsum(math.log(r[v]) for v, r in zip(votes, rate, strict=True)) for s, rate in zip(shares, rates, strict=True)]
    open_to = range(len(logs)) if label is None else range(1) if label else range(1, len(logs))
    top = max(logs[c] for c in open_to)
    each = [math.exp(x - top) if c in open_to else 0.0 for c, x in enumerate(logs)]
    return [x / math.fsum(each) for x in each]


def counted_patterns(voted: DataFrame, votes: str, labels: DataFrame | None, id_col: str, label_col: str) -> list[tuple[tuple[int, ...], int | None, int]]:
    """(votes, label, rows) of all rows. Ids without a label, with a null one, or with both labels count as unlabelled.

    All rows are counted where they are read; only ids and votes of non-null ids meet the labels.
    """
    count = F.count(F.lit(1)).alias("n")
    found = {(tuple(r[0]), None): r[1] for r in voted.groupBy(votes).agg(count).collect()}
    if labels is not None:
        known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).where("id is not null and label is not null")
        known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
        rows = voted.select(F.col(f"`{id_col}`").alias("id"), F.col(votes).alias("votes")).where("id is not null")
        for pattern, label, n in rows.join(known, "id").groupBy("votes", "label").agg(count).collect():
            found[tuple(pattern), label] = n
            found[tuple(pattern), None] -= n
    return sorted(((v, label, n) for (v, label), n in found.items() if n), key=lambda x: (x[0], -1 if x[1] is None else x[1]))


def score(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), a struct ``q`` of counts, ``votes``, ``base_failed``, ``posterior``, ``kept``.

    The five names may get a number where ``docs`` has them already; they are always the last five columns. Every row is
    returned, repeated rows too. Null and empty texts have counts of zero and fail the base rule; an empty table gives an
    empty result. Very long texts are counted whole; a posterior of exactly one half keeps. Counts are staged once in the
    shared folder, so that texts are read a single time. ``labels`` (id_col, label_col: 1 good, 0 bad) may name some of the
    rows; they help the estimates only, and no row's verdict is its own label. ``keep`` must hold id_col then.
    """
    counted = with_counts(docs, text_col)
    q = counted.columns[-1]
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    votes_name = common.fresh(counted, "votes")
    rules = _rules(q)
    voted = counted.select(*columns, F.col(q), F.array(*(rules[r] for r in RULES)).alias(votes_name))
    voted = common.staged(voted, f"{common.shared_dir(docs.sparkSession)}/quality")
    likelihoods = []
    for share, rate in fit(counted_patterns(voted, votes_name, labels, id_col, label_col)):
        log = F.lit(math.log(share))
        for k, r in enumerate(rate):
            vote = F.col(votes_name)[k]
            log = log + F.when(vote > 0, math.log(r[1])).when(vote < 0, math.log(r[-1])).otherwise(math.log(r[0]))
        likelihoods.append(log)
    against = sum((F.exp(x - likelihoods[0]) for x in likelihoods[1:]), F.lit(0.0))
    failed = (F.col(f"{q}.n_words") < MIN_WORDS) | (F.col(f"{q}.n_repeat_words") * 100 > F.col(f"{q}.n_words") * MAX_REPEAT_PERCENT)
    base, probability, kept = (common.fresh(voted, x) for x in ("base_failed", "posterior", "kept"))
    return voted.withColumn(base, failed).withColumn(probability, F.lit(1.0) / (F.lit(1.0) + against)).withColumn(kept, ~F.col(base) & (F.col(probability) >= 0.5))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the method keeps, with their own columns."""
    scored = score(docs, labels, id_col=id_col, text_col=text_col)
    return scored.where(F.col(scored.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
