"""Personal data by a character-level bidirectional LSTM with a CRF over its tags, in numpy.

The network is trained here from labelled spans in made-up lines. In use, characters near a digit or an at sign (no kind of
span is without one) are covered by overlapping windows; each window is decoded by Viterbi. Windows are then reconciled
over the whole text: a character's tag comes from the window in whose middle it lies most, and spans are read from the
joined tags, so one that crosses a window's edge is found once and whole.

Four plain patterns (``email``, ``ip``, ``card``, ``phone``) are always reported; spans of the network, which knows ``ssn``
too, are added where they overlap none of those.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: All kinds that the network tags: the patterns have none for the last.
TAGGED = (*KINDS, "ssn")
#: Labelled lines to train on, passes over them, and the network's width: these bound training, whatever the corpus.
LINES, ROUNDS, HIDDEN = 1200, 16, 16
SEED = 20240603
WINDOW, STRIDE, MARGIN = 96, 48, 24

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARK_RUN = re.compile("[0-9@]+")

#: Tags: 0 is outside; 2k + 1 begins and 2k + 2 continues a span of kind k.
TAGS = 2 * len(TAGGED) + 1
#: What the network is fed: each ASCII character is itself, others are hashed to the last ``OTHERS`` inputs.
OTHERS = 32
INPUTS = 128 + OTHERS
#: An input's weights are its own and those of its class, so that a character that no training line has is not unknown:
#: 0 other, 1 letters but upper-case ASCII, 2 upper case, 3 digit, 4 blank, 5 line feed, then these.
_MARKS = "@.-+()_%:,/"
CLASSES = 6 + len(_MARKS)
_CLASS = np.zeros(INPUTS, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 32]], _CLASS[[10, 13]], _CLASS[128:] = 1, 2, 3, 4, 5, 1
_CLASS[[ord(c) for c in _MARKS]] = np.arange(6, CLASSES)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns, by start and then by kind as listed. Failing matches are dropped, not tried again."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *m.span()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(own := _digits(m[0])) <= 19 and luhn(own):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def labelled(count: int = LINES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up lines with the spans of personal data in them; other numbers are there to be left alone."""
    draw = random.Random(seed)
    syllables = ["an", "er", "tion", "the", "on", "re", "ing", "ou", "ed", "ha", "ver", "gen", "que", "los", "st", "le", "wh", "ch", "ung", "é", "ñ", "ö"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 4)))
    number = lambda n: "".join(draw.choices("0123456789", k=n))
    host = lambda: draw.choice(["localhost", "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(4, 9)))]) if draw.random() < 0.15 else ".".join(["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=draw.randint(2, 9))) for _ in range(draw.randint(1, 2))] + [draw.choice(["com", "org", "net", "de"])])

    def card() -> str:
        own = number(draw.choice([14, 15, 15, 15]))
        own += next(c for c in "0123456789" if luhn(own + c))
        return draw.choice(["", " ", "-"]).join(own[i : i + 4] for i in range(0, len(own), 4))

    make = {
        "email": lambda: f"{draw.choice([word(), word() + '.' + word(), word() + number(2)])}@{host()}".replace("é", "e").replace("ñ", "n").replace("ö", "o"),
        "ip": lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: draw.choice([f"+{draw.randint(1, 99)} {number(3)} {number(7)}", f"+{draw.randint(1, 99)}-{number(3)}-{number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{draw.randint(1, 9)} ({number(3)}) {number(3)} {number(4)}", f"0{number(2)} {number(7)}"]),
        "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
    }
    other = [lambda: number(draw.randint(1, 6)), lambda: f"{draw.randint(1, 99)}.{number(2)}", lambda: f"20{number(2)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"v{draw.randint(0, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 9)}", lambda: f"{draw.randint(1, 100)}%", lambda: "".join(draw.choices("0123456789abcdef", k=32)), lambda: "@" + word(), lambda: number(24), lambda: number(16)]
    out = []
    for _ in range(count):
        line, spans = "", []
        while len(line) < WINDOW - 44:
            pick = draw.random()
            if pick < 0.16:
                kind = draw.choice(TAGGED)
                own = make[kind]()
                spans.append((kind, len(line), len(line) + len(own)))
            else:
                own = draw.choice(other)() if pick < 0.28 else word().capitalize() if pick < 0.4 else word()
            line += own + draw.choice([" ", " ", " ", " ", ", ", ". ", "\n"])
        out.append((line[:WINDOW], [s for s in spans if s[2] <= WINDOW]))
    return out


def encode(texts: list[str], width: int = WINDOW) -> np.ndarray:
    """The network's inputs for the characters of texts, rows filled up with line feeds."""
    out = np.full((len(texts), width), 10, np.int64)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, : len(c)] = np.where(c < 128, c, 128 + c % OTHERS)
    return out


def tags_of(spans: list[tuple[str, int, int]], width: int = WINDOW) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for kind, a, b in spans:
        k = 2 * TAGGED.index(kind)
        out[a:b], out[a] = k + 2, k + 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Two LSTMs (one from each end) over characters, a linear layer to tag scores, and CRF transitions."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        own = {}
        for side in "fb":
            own[f"c{side}"] = draw.normal(0, 0.3, (CLASSES, 4 * hidden))
            own[f"x{side}"] = np.zeros((INPUTS, 4 * hidden))
            own[f"h{side}"] = draw.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            own[f"o{side}"] = draw.normal(0, 0.3, (hidden, TAGS))
        own["bias"], own["moves"], own["start"] = np.zeros(TAGS), draw.normal(0, 0.1, (TAGS, TAGS)), np.zeros(TAGS)
        self.own = {k: v.astype(np.float32) for k, v in own.items()}
        for side in "fb":
            self.own[f"c{side}"][:, hidden : 2 * hidden] += 1  # cells remember at first

    def _side(self, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (time, row, unit) of one LSTM over inputs (row, time), and what its gradient needs."""
        n, steps, u = len(x), x.shape[1], self.hidden
        h, c = np.zeros((n, u), np.float32), np.zeros((n, u), np.float32)
        out, kept = np.empty((steps, n, u), np.float32), []
        into, again = self.own[f"x{side}"] + self.own[f"c{side}"][_CLASS], self.own[f"h{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = into[x[:, t]] + h @ again
            gates = _sigmoid(z[:, : 3 * u])
            i, f, o, g = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :], np.tanh(z[:, 3 * u :])
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            kept.append((t, i, f, o, g, before, tc, h_before))
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (row, time, tag)."""
        scores = self.own["bias"] + self._side("f", x)[0] @ self.own["of"] + self._side("b", x)[0] @ self.own["ob"]
        return scores.transpose(1, 0, 2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (row, time) by Viterbi."""
        scores = self.emissions(x)
        n, steps, _ = scores.shape
        best, back = self.own["start"] + scores[:, 0], np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            total = best[:, :, None] + self.own["moves"]
            back[t] = total.argmax(1)
            best = total.max(1) + scores[:, t]
        out = np.empty((n, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradient by forward-backward and back-propagation."""
        own, n, steps = self.own, *x.shape
        hf, kept_f = self._side("f", x)
        hb, kept_b = self._side("b", x)
        scores = own["bias"] + hf @ own["of"] + hb @ own["ob"]  # time, row, tag
        moves = own["moves"]

        def log_sum(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis))

        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = own["start"] + scores[0]
        for t in range(1, steps):
            ahead[t] = log_sum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = log_sum(moves + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        total = log_sum(ahead[-1], 1)
        rows, gold = np.arange(n), tags.T
        grad = {k: np.zeros_like(v) for k, v in own.items()}
        right = own["start"][gold[0]] + scores[np.arange(steps)[:, None], rows, gold].sum(0)
        for t in range(1, steps):
            right = right + moves[gold[t - 1], gold[t]]
            pair = np.exp(ahead[t - 1][:, :, None] + moves + (scores[t] + behind[t])[:, None, :] - total[:, None, None])
            grad["moves"] += pair.sum(0) / n
            np.add.at(grad["moves"], (gold[t - 1], gold[t]), -1 / n)
        d = np.exp(ahead + behind - total[:, None])
        d[np.arange(steps)[:, None], rows, gold] -= 1
        d /= n
        grad["start"], grad["bias"] = d[0].sum(0), d.sum((0, 1))
        u = self.hidden
        for side, h, kept in (("f", hf, kept_f), ("b", hb, kept_b)):
            grad[f"o{side}"] = np.einsum("tnu,tnk->uk", h, d)
            dh_all = d @ own[f"o{side}"].T
            dh, dc = np.zeros((n, u), np.float32), np.zeros((n, u), np.float32)
            for t, i, f, o, g, before, tc, h_before in reversed(kept):
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(grad[f"x{side}"], x[:, t], dz)
                grad[f"h{side}"] += h_before.T @ dz
                dh, dc = dz @ own[f"h{side}"].T, dc * f
            np.add.at(grad[f"c{side}"], _CLASS, grad[f"x{side}"])
        return float((total - right).mean()), grad

    def fit(self, lines: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS, batch: int = 32, rate: float = 0.02, seed: int = SEED) -> list[float]:
        """Adam over shuffled lines; the mean loss of each round."""
        x, y = encode([t for t, _ in lines]), np.stack([tags_of(s) for _, s in lines])
        first, second = ({k: np.zeros_like(v) for k, v in self.own.items()} for _ in range(2))
        draw, step, losses = np.random.default_rng(seed), 0, []
        for r in range(rounds):
            order, sums = draw.permutation(len(x)), []
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                loss, grad = self.gradient(x[pick], y[pick])
                sums.append(loss)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                now = rate * (0.5 * (1 + np.cos(np.pi * r / rounds)))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / max(size, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.own[k] = (self.own[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses


@lru_cache(maxsize=1)
def trained() -> Tagger:
    tagger = Tagger()
    tagger.fit(labelled())
    return tagger


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows over all characters within ``MARGIN`` of a digit or an at sign."""
    starts: list[int] = []
    covered = 0  # every character before is in a window, or far from any mark
    for m in _MARK_RUN.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        a = max(a, covered)
        if a >= b:
            continue
        if starts and a <= starts[-1] + WINDOW:  # goes on from the last window
            at = starts[-1] + STRIDE
        else:
            at = a
        while True:
            starts.append(at)
            covered = at + WINDOW
            if covered >= b:
                break
            at += STRIDE
    return starts


def spans_of(tags: np.ndarray, start: int) -> list[tuple[str, int, int]]:
    """Spans of one line of tags; a continuation without a beginning begins one."""
    found: list[tuple[str, int, int]] = []
    kind, a = 0, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        own = (t + 1) // 2
        if kind and (own != kind or t % 2):
            found.append((TAGGED[kind - 1], start + a, start + i))
            kind = 0
        if own and not kind:
            kind, a = own, i
    return found


def reconcile(starts: list[int], tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a whole text from the tags of its windows, in order of start: in an overlap, each window has the half
    nearer to its own middle."""
    found: list[tuple[str, int, int]] = []
    i = 0
    while i < len(starts):
        j = i
        while j + 1 < len(starts) and starts[j + 1] < starts[j] + WINDOW:
            j += 1
        line = np.zeros(starts[j] + WINDOW - starts[i], np.int64)
        for k in range(i, j + 1):
            a = 0 if k == i else (starts[k - 1] + WINDOW - starts[k]) // 2
            line[starts[k] - starts[i] + a : starts[k] - starts[i] + WINDOW] = tags[k][a:]
        found += spans_of(line, starts[i])
        i = j + 1
    return found


def _sound(kind: str, own: str) -> bool:
    """What the kind can't be without: a span of the network that lacks it is no finding."""
    n = len(_digits(own))
    parts = own.split(".")
    address = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return {"email": "@" in own[1:-1], "ip": address, "card": 12 <= n <= 19 and luhn(_digits(own)), "phone": 7 <= n <= 15, "ssn": n == 9 and [len(p) for p in own.split("-")] == [3, 2, 4]}[kind]


def scan(texts: list[str], tagger: Tagger, rows: int = 4096) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text. Windows of many texts are decoded together."""
    base = [base_spans(t) for t in texts]
    starts = [windows(t) for t in texts]
    pieces = [t[a : a + WINDOW] for t, own in zip(texts, starts, strict=True) for a in own]
    tags = [tagger.decode(encode(pieces[at : at + rows])) for at in range(0, len(pieces), rows)]
    tags = np.concatenate(tags) if tags else np.zeros((0, WINDOW), np.int64)
    out, at = [], 0
    for text, own, plain in zip(texts, starts, base, strict=True):
        added = []
        if own:
            for kind, a, b in reconcile(own, tags[at : at + len(own)]):
                b = min(b, len(text))
                while a < b and text[b - 1] in " ,.\n":
                    b -= 1
                while a < b and text[a] in " ,.\n":
                    a += 1
                if a < b and _sound(kind, text[a:b]) and all(b <= p[1] or a >= p[2] for p in plain):
                    added.append((kind, a, b))
            at += len(own)
        out.append((plain, sorted(plain + added, key=lambda s: (s[1], TAGGED.index(s[0]), s[2]))))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans.

    Null and empty texts have no spans; very long ones are covered by as many windows as they need; of spans that tie or
    overlap the plain patterns' stay; repeated rows give repeated rows; an empty table gives none; other columns are not
    looked at. Texts are scanned where they are read: nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan([t or "" for t in batch.column(1).to_pylist()], sent.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([written(s) for _, s in found], pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string").withColumnRenamed("id", id_col)
