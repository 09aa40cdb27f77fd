"""Secret scans by grammar inference.

For each known credential format a probabilistic automaton is learnt from labelled examples: they are entered into a
prefix tree whose states are merged, breadth first, where counts of symbols, classes and ends don't differ by more than a
Hoeffding bound allows, and merged states are folded so that the automaton stays deterministic. Transitions go by character
class, and each keeps how often its characters occur, so a fixed prefix stays apart from random letters. One more automaton
is learnt from ordinary words. Runs of credential characters are scored by all automata, and so are their parts between
delimiters; a part is a secret of the likeliest format if that is likelier than the ordinary one and the part is as likely,
per character, as examples of the format that were held out of learning. Of parts that overlap the one counts that is
likeliest beside characters drawn evenly; what is left around it is looked at again.

Three plain patterns (``assign``, ``access``, ``hex``) are always reported; learnt spans are added where they overlap none.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ppm import chunks

#: Labelled examples per format: this bounds what is learnt from, whatever the corpus.
EXAMPLES = 240
HELD_OUT = 60
SEED = 20240602
ALPHA = 0.01
FLOOR = 1e-4
SHORTEST = 16
BASE_KINDS = ("assign", "access", "hex")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True
#: A credential may begin after one of these and end before one.
_CERTAIN_END = re.compile(rb"[+/=.]")
#: Log probability of a character drawn evenly from printable ASCII, below that of a random letter in any format.
EVEN = -math.log(95)
_DELIMITER = np.zeros(256, bool)
_DELIMITER[[*b"+/_=.-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT


def labelled(count: int = EXAMPLES, seed: int = SEED) -> dict[str, list[str]]:
    """Made-up credentials of public formats, and ordinary runs under ``plain``."""
    draw = random.Random(seed)
    some = lambda letters, n: "".join(draw.choices(letters, k=n))
    syllables = ["an", "er", "tion", "the", "on", "re", "ing", "ou", "ed", "ha", "ver", "gen", "que", "los", "st", "le", "wh", "ch", "ung", "ment"]
    word = lambda n: "".join(draw.choices(syllables, k=n))

    def plain() -> str:
        kind = draw.randrange(10)
        if kind == 6:
            return some(_DIGIT, draw.randint(12, 28))
        if kind == 7:
            return some(draw.choice([_DIGIT + "ABCDEF", _DIGIT + "abcdef"]), draw.choice([16, 20, 32, 40, 64]))
        if kind == 8:
            return "-".join(some(_DIGIT + "abcdef", n) for n in (8, 4, 4, 4, 12))
        if kind == 9:
            return "-".join(some(_DIGIT, draw.randint(2, 5)) for _ in range(draw.randint(4, 6)))
        if kind < 3:
            return (lambda w: w.capitalize() if draw.random() < 0.3 else w)(word(draw.randint(6, 12)))
        if kind == 3:
            return "_".join(word(draw.randint(1, 3)) for _ in range(draw.randint(3, 6)))
        if kind == 4:
            return "/".join(word(draw.randint(1, 3)) for _ in range(draw.randint(3, 6))) + draw.choice([".html", ".py", "/", ".txt"])
        return draw.choice(["--", "==", "..", "__"]) * draw.randint(8, 20)

    make = {
        "github": lambda: "gh" + draw.choice("pousr") + "_" + some(_ALNUM, 36),
        "github_pat": lambda: f"github_pat_{some(_ALNUM, 22)}_{some(_ALNUM, 59)}",
        "gitlab": lambda: "glpat-" + some(_ALNUM, 20),
        "npm": lambda: "npm_" + some(_ALNUM, 36),
        "slack": lambda: f"xox{draw.choice('bp')}-{some(_DIGIT, draw.randint(10, 13))}-{some(_DIGIT, draw.randint(10, 13))}-{some(_ALNUM, 24)}",
        "stripe": lambda: f"{draw.choice('sr')}k_{draw.choice(['live', 'test'])}_{some(_ALNUM, draw.choice([24, 32]))}",
        "google": lambda: "AIza" + some(_ALNUM + "_-", 35),
        "session": lambda: "ASIA" + some(_UPPER + _DIGIT, 16),
        "jwt": lambda: f"eyJ{some(_ALNUM, draw.randint(17, 33))}.eyJ{some(_ALNUM + '_-', draw.randint(30, 80))}.{some(_ALNUM + '_-', 43)}",
        "plain": plain,
    }
    return {kind: [f() for _ in range(count)] for kind, f in make.items()}


def char_class(c: str) -> str:
    return "U" if c in _UPPER else "L" if c in _LOWER else "D" if c in _DIGIT else c


class _State:
    __slots__ = ("arrived", "chars", "ended", "to")

    def __init__(self):
        self.arrived, self.ended = 0, 0
        self.to: dict[str, _State] = {}
        self.chars: dict[str, Counter] = {}


def prefix_tree(examples: list[str]) -> _State:
    root = _State()
    for text in examples:
        at = root
        at.arrived += 1
        for c in text:
            k = char_class(c)
            at.chars.setdefault(k, Counter())[c] += 1
            at = at.to.setdefault(k, _State())
            at.arrived += 1
        at.ended += 1
    return root


def _differ(a: float, n: int, b: float, m: int) -> bool:
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(a: _State, b: _State) -> bool:
    """Whether two states' futures could come from one distribution, as far as their counts can tell."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        n, m = a.arrived, b.arrived
        if not n or not m:
            continue
        if _differ(a.ended, n, b.ended, m):
            return False
        for k in a.to.keys() | b.to.keys():
            p, q = a.chars.get(k, Counter()), b.chars.get(k, Counter())
            if _differ(p.total(), n, q.total(), m) or any(_differ(p[c], n, q[c], m) for c in p.keys() | q.keys()):
                return False
            if k in a.to and k in b.to:
                todo.append((a.to[k], b.to[k]))
    return True


def _fold(into: _State, other: _State) -> None:
    """Adds a tree to an automaton's state and all that follows."""
    todo = [(into, other)]
    while todo:
        into, other = todo.pop()
        into.arrived += other.arrived
        into.ended += other.ended
        for k, child in other.to.items():
            into.chars.setdefault(k, Counter()).update(other.chars[k])
            if k in into.to:
                todo.append((into.to[k], child))
            else:
                into.to[k] = child


def infer(examples: list[str]) -> _State:
    """The automaton: states are looked at breadth first, and each is merged with the last compatible one already kept.

    A rarely reached state is compatible with nearly all others, as its counts tell little. The last one kept lies about as
    deep and so has the likest past; merged with the first ones, rare tails would lead back to the start, which would then
    take any character.
    """
    root = prefix_tree(examples)
    kept = [root]
    rest = deque((root, k) for k in sorted(root.to))
    done = {id(root)}
    while rest:
        parent, k = rest.popleft()
        state = parent.to[k]
        if id(state) in done:
            continue
        for other in reversed(kept):
            if compatible(other, state):
                parent.to[k] = other
                _fold(other, state)
                # Folding may have given a kept state new children.
                rest.extend((s, x) for s in kept for x in sorted(s.to) if id(s.to[x]) not in done)
                break
        else:
            kept.append(state)
            done.add(id(state))
            rest.extend((state, x) for x in sorted(state.to))
    return root


class Automata:
    """Automata of all formats in dense tables: the next state and the log probability for each byte."""

    def __init__(self, roots: dict[str, _State]):
        self.kinds = list(roots)
        states: list[_State] = []
        number: dict[int, int] = {}
        self.ranges: list[int] = []  # the first state of each automaton
        for root in roots.values():
            todo = [root]
            self.ranges.append(len(states))
            while todo:
                s = todo.pop()
                if id(s) not in number:
                    number[id(s)] = len(states)
                    states.append(s)
                    todo.extend(s.to.values())
        self.start = np.array([number[id(r)] for r in roots.values()])
        self.next = np.tile(np.arange(len(states))[:, None], (1, 256))  # an impossible character costs and stays
        self.log = np.full((len(states), 256), math.log(FLOOR))
        self.end = np.zeros(len(states))
        for i, s in enumerate(states):
            out = s.ended + sum(c.total() for c in s.chars.values())
            self.end[i] = math.log(max(s.ended / out if out else 1.0, FLOOR))
            for k, to in s.to.items():
                for c in {"U": _UPPER, "L": _LOWER, "D": _DIGIT}.get(k, k):
                    seen, size = s.chars[k], {"U": 26, "L": 26, "D": 10}.get(k, 1)
                    p = s.chars[k].total() / out * (seen[c] + 0.02) / (seen.total() + 0.02 * size)
                    self.log[i, ord(c)], self.next[i, ord(c)] = math.log(max(p, FLOOR)), number[id(to)]
        self.limit = np.zeros(len(self.kinds))

    def score(self, runs: list[bytes]) -> np.ndarray:
        """Log likelihood of each run (rows) under each automaton (columns), without cutting any run."""
        out = np.zeros((len(runs), len(self.kinds)))
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for at in range(0, len(order), 4096):
            own = order[at : at + 4096]
            sizes = np.array([len(runs[i]) for i in own])
            flat, begin = np.frombuffer(b"".join(runs[i] for i in own), np.uint8), np.cumsum(sizes) - sizes
            state, total = np.tile(self.start, (len(own), 1)), np.zeros((len(own), len(self.kinds)))
            for t in range(int(sizes[-1]) if len(own) else 0):
                first = int(np.searchsorted(sizes, t, "right"))  # in order of size: those from here have a character left
                c = flat[begin[first:] + t][:, None]
                total[first:] += self.log[state[first:], c]
                state[first:] = self.next[state[first:], c]
            out[own] = total + self.end[state]
        return out

    def judge(self, runs: list[bytes]) -> list[str | None]:
        """The format of each run, or None."""
        return [kind for kind, _ in self.weigh(runs)]

    def weigh(self, runs: list[bytes]) -> list[tuple[str | None, float]]:
        """The format of each run, or None, and how much likelier it is than characters drawn evenly (log)."""
        if not runs:
            return []
        scores = self.score(runs)
        plain = self.kinds.index("plain")
        each = scores / np.array([len(r) + 1 for r in runs])[:, None]
        fit = (each >= self.limit) & (scores > scores[:, [plain]])
        fit[:, plain] = False
        best = np.where(fit, scores, -np.inf).argmax(axis=1)
        return [(self.kinds[b] if fit[i, b] else None, float(scores[i, b] - EVEN * len(runs[i]))) for i, b in enumerate(best)]

    def parts(self, runs: list[bytes]) -> list[tuple[int, int, int]]:
        """(run, start, end): for each start in a run and each format the likeliest end beside even characters, if it is above the limit.

        Going back from the ends of runs, the best that can follow is known for every state; so all starts and ends of a
        run are compared in time that is linear in its length.
        """
        kind_of = np.repeat(np.arange(len(self.kinds)), np.diff([*self.ranges, len(self.end)]))
        limit = self.limit[kind_of]
        gain, stop = self.log - EVEN, np.where(self.end > math.log(FLOOR), self.end, -np.inf)
        slack = EVEN - limit  # what one character more adds to the distance from the limit, besides its gain
        formats = [k for k, kind in enumerate(self.kinds) if kind != "plain"]
        found: set[tuple[int, int, int]] = set()
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for at in range(0, len(order), 4096):
            own = order[at : at + 4096]
            sizes = np.array([len(runs[i]) for i in own])
            flat, begin = np.frombuffer(b"".join(runs[i] for i in own), np.uint8), np.cumsum(sizes) - sizes
            run = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(flat)) - begin[run]
            cut_here = _DELIMITER[flat]
            opens = (place == 0) | (np.concatenate([[False], cut_here[:-1]]) & ~cut_here)
            starts = np.flatnonzero(opens & (place + SHORTEST <= sizes[run]))
            starts = starts[np.argsort(place[starts], kind="stable")]
            state, total = np.tile(self.start[formats], (len(starts), 1)), np.zeros((len(starts), len(formats)))
            for t in range(SHORTEST):
                c = flat[starts + t][:, None]
                total += gain[state, c]
                state = self.next[state, c]
            total_slack = SHORTEST * slack[self.start[formats]]
            after = place[starts] + SHORTEST
            best, ends = np.full((len(own), len(stop)), -np.inf), np.zeros((len(own), len(stop)), np.int64)
            for t in range(int(sizes[-1]) if len(own) else 0, SHORTEST - 1, -1):
                longer = int(np.searchsorted(sizes, t, "right"))
                first = int(np.searchsorted(sizes, t, "left"))
                if longer < len(own):
                    c = flat[begin[longer:] + t]
                    to = self.next[:, c].T
                    best[longer:] = gain[:, c].T + np.take_along_axis(best[longer:], to, 1)
                    ends[longer:] = np.take_along_axis(ends[longer:], to, 1)
                    may_end = np.concatenate([np.ones(longer - first, bool), _DELIMITER[c]])
                else:
                    may_end = np.ones(longer - first, bool)
                better = may_end[:, None] & (stop > best[first:])
                best[first:] = np.where(better, stop, best[first:])
                ends[first:] = np.where(better, t, ends[first:])
                above = best + (ends - t) * slack - limit
                asked = slice(int(np.searchsorted(after, t, "left")), int(np.searchsorted(after, t, "right")))
                rows = run[starts[asked]][:, None]
                for i, j in np.argwhere(total[asked] + total_slack + above[rows, state[asked]] >= -1e-6).tolist():
                    r = int(rows[i, 0])
                    found.add((own[r], t - SHORTEST, int(ends[r, state[asked][i, j]])))
        return sorted(found)

    def find(self, runs: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """The secrets (format, start, end) in each run, none overlapping another."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in runs]
        todo = [(i, 0, r) for i, r in enumerate(runs)]
        while todo:
            tried = self.parts([r for _, _, r in todo])
            tried += sorted({(k, 0, len(r)) for k, (_, _, r) in enumerate(todo)} - set(tried))
            # "-" and "_" may be part of a credential: an end before one gives way to the next certain end, if that fits too.
            wider = [(k, a, m.start() if (m := _CERTAIN_END.search(todo[k][2], b)) else len(todo[k][2])) for k, a, b in tried]
            fits = self.weigh([todo[k][2][a:b] for k, a, b in wider])
            tried = sorted({w if kind else t for t, w, (kind, _) in zip(tried, wider, fits, strict=True)})
            weighed = self.weigh([todo[k][2][a:b] for k, a, b in tried])
            by_run: dict[int, list[tuple[float, int, int, str]]] = {}
            for (k, a, b), (kind, more) in zip(tried, weighed, strict=True):
                if kind:
                    by_run.setdefault(k, []).append((-more, a, b, kind))
            rest = []
            for k, own in by_run.items():
                i, offset, r = todo[k]
                taken: list[tuple[int, int]] = []
                for _, a, b, kind in sorted(own):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        out[i].append((kind, offset + a, offset + b))
                at = 0
                for x, y in [*sorted(taken), (len(r), len(r))]:
                    if x - at >= SHORTEST:
                        rest.append((i, offset + at, r[at:x]))
                    at = y
            todo = rest
        return out


@lru_cache(maxsize=1)
def learnt() -> Automata:
    examples = labelled()
    found = Automata({kind: infer(own[HELD_OUT:]) for kind, own in examples.items()})
    for i, (kind, own) in enumerate(examples.items()):
        if kind != "plain":
            held = [x.encode() for x in own[:HELD_OUT]]
            found.limit[i] = (found.score(held)[:, i] / np.array([len(x) + 1 for x in held])).min() - 0.1
    return found


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal true runs of at least so many."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    a, b = edges[::2], edges[1::2]
    keep = b - a >= least
    return a[keep], b[keep]


def scan(texts: list[str], automata: Automata) -> list[list[tuple[str, int, int]]]:
    """All spans (kind, start, end in code points) of each text, by start and then by kind as listed."""
    kinds = [*BASE_KINDS, *(k for k in automata.kinds if k != "plain")]
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for first, own in chunks(data):
        sizes = np.array([len(d) + 1 for d in own])
        begin = np.cumsum(sizes) - sizes
        line = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)
        places: list[tuple[int, str, int, int]] = []
        for a, b in zip(*(x.tolist() for x in _runs(_HEX[line], 24)), strict=True):
            places.append((int(np.searchsorted(begin, a, "right")) - 1, "hex", a, b))
        starts, ends = _runs(_RUN[line], SHORTEST)
        raw = line.tobytes()
        tried = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            while b > a and raw[b - 1] in b".-=/+":  # punctuation after a run is no part of it
                b -= 1
            if b - a >= SHORTEST:
                tried.append((a, b))
        more = [(a + x, a + y, kind) for (a, b), own_spans in zip(tried, automata.find([raw[a:b] for a, b in tried]), strict=True) for kind, x, y in own_spans]
        places += [(int(np.searchsorted(begin, a, "right")) - 1, kind, a, b) for a, b, kind in more]
        by_text: dict[int, list[tuple[str, int, int]]] = {}
        for i, kind, a, b in places:
            by_text.setdefault(i, []).append((kind, a - int(begin[i]), b - int(begin[i])))
        for i, d in enumerate(own):
            low = d.lower()
            spans = [(k, len(d[:a].decode("utf-8", "surrogatepass")), len(d[:b].decode("utf-8", "surrogatepass"))) for k, a, b in by_text.get(i, ())]
            text = texts[first + i]
            if any(w in low for w in _ASSIGN_WORDS):
                spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
            if b"AKIA" in d:
                spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
            if spans:
                base = [s for s in spans if s[0] in BASE_KINDS]
                added = [s for s in spans if s[0] not in BASE_KINDS and all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
                found[first + i] = sorted(base + added, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return found


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; very long ones are scanned whole; of formats that tie the first listed counts, and
    the plain patterns go before all; repeated rows give repeated rows; an empty table gives none; other columns are not
    looked at. Texts are scanned where they are read: nothing is shuffled.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(learnt())
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan([t or "" for t in batch.column(1).to_pylist()], sent.value)
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in BASE_KINDS]
            digests = [hashlib.sha256(written(own).encode()).hexdigest() for own in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(written, found), pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def cut(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text replaced by a mark; ``size_col``, if there, counts anew where
    a text has changed. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(learnt())
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = scan([t or "" for t in texts], sent.value)
            columns = list(batch.columns)
            clean = [cut(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            if count_at is not None:
                counts = columns[count_at].to_pylist()
                columns[count_at] = pa.array([len(t) if s else c for t, s, c in zip(clean, found, counts, strict=True)], batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
