"""Operator 5, personal data: fixed patterns, and a linear-chain CRF over word shapes.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
A linear-chain conditional random field labels the words of a text by their
shape (kinds of characters, length, number of digits), by a few cue words
(titles, streets, what stands before secrets and numbers), and by those of the
words beside them. Its labels are the four kinds and what no pattern finds:
secrets, identity numbers, names behind a title, street addresses, and numbers
written otherwise. It is trained on the driver from a small labelled table
(``labelled_lines``, ``LINES`` rows made by a rule) and decoded by Viterbi in
numpy batches. Its spans are added where they overlap no span of the base; base
spans always stay.

Decoding skips nothing: a word at which the outside label wins whatever its
neighbours' labels are (checked with the trained weights) separates the chain,
so the stretches between such words are decoded apart and give the same path.
The patterns take time in proportion to the text, also in long runs of digits.

Defined results: null text is empty and has no span. Every input row gives one
output row, repeated rows included; other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, texts

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret", "id", "name", "address"]
# The base patterns; e-mail and IP addresses are searched by parts of them, in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern: from each @ back over the local part, forward over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the IP pattern whose parts are at most 255: within maximal runs of digits and dots, four parts at a time."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, k = m.group().split("."), 0
        ends = (np.cumsum([len(p) + 1 for p in parts]) - 1 + m.start()).tolist()
        while k + 3 < len(parts):
            four = parts[k : k + 4]
            if not all(four):
                k += 1
                continue
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in four):
                yield ends[k] - len(parts[k]), ends[k + 3]
            k += 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping for each kind."""
    out = [(0, a, b) for a, b in emails(text)]
    if "." in text:
        out += [(1, a, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# -- word shapes --------------------------------------------------------------

#: Kinds of characters; a word's shape has a bit for each.
LOWER, UPPER, DIGIT, AT, DOT, PLUS, DASH, OPEN, OTHER = (1 << k for k in range(9))
CLASS = np.full(128, OTHER, dtype=np.int64)
CLASS[ord("a") : ord("z") + 1] = LOWER
CLASS[ord("A") : ord("Z") + 1] = UPPER
CLASS[ord("0") : ord("9") + 1] = DIGIT
for _c, _v in (("@", AT), (".", DOT), ("+", PLUS), ("-", DASH), ("(", OPEN), (")", OPEN), (",", DOT), (";", DOT), (":", DOT)):
    CLASS[ord(_c)] = _v
#: Digits in steps, length in steps.
DIGIT_STEPS, LENGTH_STEPS = np.array([1, 2, 4, 5, 8, 13, 16, 20]), np.array([2, 4, 8, 16, 32])
# Cue words by group: titles, streets, secrets, identity numbers, phones.
CUE = re.compile(
    r"\b(?:(mr|mrs|ms|miss|dr|prof|herr|frau|mme|sra|señora)|(street|avenue|road|lane|drive|boulevard|straße|strasse|calle|rue)"
    r"|(password|passwd|pwd|token|secret|apikey|api_key|key|pin)|(ssn|passport|license|licence|identity|id)|(call|phone|tel|telephone|mobile|cell|fax|dial))\b",
    re.IGNORECASE,
)
N_CUES = 5
#: Features of a word: 9 kinds, 9 digit steps, 6 length steps, the first character's kind, its cue group.
N_OWN = 9 + 9 + 6 + 9 + N_CUES
#: Flags whose presence in the next and the previous word are features, too: digits, plus or bracket, capital, cue groups.
N_FLAGS = 3 + N_CUES
N_FEATURES = N_OWN + 2 * N_FLAGS + 1


def shapes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shape) of the words between white space, in code points."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    white = (code == 32) | ((code >= 9) & (code <= 13))
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.int64)
    kind = CLASS[np.minimum(code, 127)]
    kind[code > 127] = LOWER
    # White space that reduceat would add has no class of its own.
    kind[white] = 0
    bits = np.bitwise_or.reduceat(kind, starts)
    digits = np.add.reduceat((kind == DIGIT).astype(np.int64), starts)
    first = np.round(np.log2(kind[starts])).astype(np.int64)
    shape = bits | np.searchsorted(DIGIT_STEPS, digits, side="right") << 9
    shape |= np.searchsorted(LENGTH_STEPS, ends - starts, side="left") << 13 | first << 16
    for m in CUE.finditer(text):
        k = int(np.searchsorted(starts, m.start(), side="right")) - 1
        if m.start() - starts[k] <= 2:  # the cue begins the word, but for a quotation mark
            shape[k] |= m.lastindex << 20
    return starts, ends, shape


def own_features(shape: np.ndarray) -> np.ndarray:
    """0/1 features of shapes."""
    out = np.zeros((len(shape), N_OWN + 1))
    for k in range(9):
        out[:, k] = shape >> k & 1
    rows = np.arange(len(shape))
    out[rows, 9 + (shape >> 9 & 15)] = 1
    out[rows, 18 + (shape >> 13 & 7)] = 1
    out[rows, 24 + (shape >> 16 & 15)] = 1
    cue = shape >> 20 & 7
    out[rows, np.where(cue > 0, 32 + cue, N_OWN)] = 1
    return out[:, :N_OWN]


def flags(shape: np.ndarray) -> list[np.ndarray]:
    """The flags that neighbours see."""
    some = [shape & DIGIT > 0, shape & (PLUS | OPEN) > 0, shape >> 16 & 15 == 1]
    return some + [shape >> 20 & 7 == k for k in range(1, N_CUES + 1)]


def features(shape: np.ndarray) -> np.ndarray:
    """Features of each word of one text: its own, the flags of the next and the previous word, and 1."""
    beside = [x for flag in flags(shape) for x in (np.append(flag[1:], False), np.append([False], flag[:-1]))]
    return np.column_stack([own_features(shape), *beside, np.ones(len(shape))]).astype(float) if len(shape) else np.empty((0, N_FEATURES))


# -- the chain ------------------------------------------------------------------


class Chain:
    """A linear-chain conditional random field: label 0 is outside, k is kind k - 1."""

    def __init__(self, n_features: int = N_FEATURES, n_labels: int = len(KINDS) + 1) -> None:
        self.emit = np.zeros((n_features, n_labels))
        self.move = np.zeros((n_labels, n_labels))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 90, rate: float = 0.25, keep: tuple[float, float] = (3e-4, 3e-2)) -> "Chain":
        """Maximises the regularised log-likelihood of (features, labels) by Adam; all lines of the table at once.

        ``keep``: how strongly emissions and moves are held at 0. Small moves let most words separate the chain.
        """
        rows = [r for r in rows if len(r[1])]
        longest = max(len(y) for _, y in rows)
        x, y = np.zeros((len(rows), longest, len(self.emit))), np.zeros((len(rows), longest), dtype=np.int64)
        there = np.zeros((len(rows), longest), dtype=bool)
        for k, (f, labels) in enumerate(rows):
            x[k, : len(labels)], y[k, : len(labels)], there[k, : len(labels)] = f, labels, True
        params = [self.emit, self.move]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, rounds + 1):
            grads = [h * p - g / len(rows) for h, p, g in zip(keep, params, self.gradient(x, y, there))]
            for k, p in enumerate(params):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def gradient(self, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts, by forward and backward sums over padded lines."""
        score, (n, longest) = x @ self.emit, y.shape
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = lse(forward[:, t - 1, :, None] + self.move, 1) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = lse(self.move + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        total = lse(forward[:, -1], 1)
        single = -np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        at = np.nonzero(there)
        single[at[0], at[1], y[there]] += 1
        joint = forward[:, :-1, :, None] + self.move + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
        pair = -(np.exp(joint) * there[:, 1:, None, None]).sum((0, 1))
        np.add.at(pair, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
        return np.einsum("ntf,ntk->fk", x, single), pair

    def separates(self, score: np.ndarray) -> np.ndarray:
        """Words at which label 0 beats every other, whatever stands on both sides."""
        # Loss of moving through 0 instead of label j between any labels a and b, at most.
        loss = (self.move[:, 1:, None] + self.move[None, 1:, :] - self.move[:, :1, None] - self.move[None, :1, :]).max(axis=(0, 2))
        edge = np.maximum(self.move[:, 1:] - self.move[:, :1], 0).max(0) + np.maximum(self.move[1:, :] - self.move[:1, :], 0).max(1)
        return (score[:, :1] - score[:, 1:] > np.maximum(loss, edge)).all(1)

    def decode(self, score: np.ndarray) -> np.ndarray:
        """The best labels of one chain."""
        n, k = score.shape
        back = np.zeros((n, k), dtype=np.int64)
        best = score[0]
        for t in range(1, n):
            step = best[:, None] + self.move
            back[t] = step.argmax(0)
            best = step.max(0) + score[t]
        out = np.empty(n, dtype=np.int64)
        out[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def labels(self, score: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Labels of all words of a batch; ``starts`` marks the first word of each text."""
        out = np.zeros(len(score), dtype=np.int64)
        open_ = ~self.separates(score)
        # Stretches of open words within one text, each with the separating word (label 0) on either side.
        edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            inner = a + 1 + np.flatnonzero(starts[a + 1 : b])
            for s, e in zip([a, *inner], [*inner, b]):
                left, right = s > 0 and not starts[s], e < len(score) and not starts[e]
                piece = score[s:e].copy()
                if left:
                    piece[0] += self.move[0]
                if right:
                    piece[-1] += self.move[:, 0]
                out[s:e] = self.decode(piece)
        return out


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# -- the labelled table -----------------------------------------------------------

#: Words of a name with its title, at most.
NAME_WORDS = 5

#: Rows of the labelled table.
LINES = 640
# What the rule puts together; {kind} is a span of that kind, {n} a plain number, {w} a word, {again} one over and over.
WITH_SPANS = [
    "please write to {email} before {w}", "contact {email} or {phone} today", "the host {ip} did not answer", "logs from {ip} and {ip} are kept",
    "paid with card {card} last week", "card number {card} was declined", "call me at {phone} in the evening", "her phone {local} is out of order",
    "tel {local} or fax {local}", "dial {local} for {w}", "password={secret} was leaked", "password: {secret} is old", 'token = "{secret}" {w} {w}',
    "the key {secret} is in {w}", "{w} {w} {secret} {w} {w}", "{w} {w}. {secret} {w}", "ssn {id} was found", "his identity number {id} is {w}", "passport {passport} of {w}",
    "we met {name} in {w}", "ask {name} about the {w}", "letter to {name}, {address}", "lives at {address} in {w}", "the house {address} was sold",
]
WITHOUT = [
    "in {n} there were {n} {w} and {n} {w}", "the total was {money} for {n} items in May {n}", "version {dotted} of the license was published", "chapter {n}, page {n}, line {n}.",
    "order {long} has {n} parts and costs {n} euros", "{Cap} {w} {w}, {w} {w}. {Cap} {w}", "{w} {w} {w} {w}, {w} {w}", "{Cap} {Cap} {w} und {w}. {Cap}", "LA!! SE!! {W}!! {w} *** and ###",
    "a | b | {w} | d", "room ({n}) on floor {n} - see plan (b).", "born {date} and {date} in {Cap}", "x + y = z and {n} + {n} = {n}", "at {time} the train {n} leaves from {n}-{n}",
    "see https://{w}.org/{w}/{n} for {w}", "file {w}_{n}.txt and {W}-{n} are {w}", "ids {longer} {long} are numbers of records", "the street was long and the key was {w}", "call the {w} and dial {w}",
    "Dr {w} and the token of {w}", "{W} and {W}{n} or {w}{n}, {w}-{w}", "the road to {Cap} is {n} km long", "{Cap}. {Cap} {Cap}. {Cap}", "{W}!! {W}!! {W}!! {W}!! {W}!!", "{Cap} {Cap} {Cap} {Cap} {Cap}", "{W}!! {W},!! {W}.", "{Cap} {dotted} of {w}", "{Cap} {n} {w}, {Cap} {dotted}", "{Cap} {w}. {Cap}. {Cap} {Cap} {w}", "{Cap}.\n{Cap}, {Cap} {Cap}. {Cap} {w}", "{w}@ {n}.{n} +{n} {w}", "{again} {w}", "{w}. {again} {again}", "{Cap} {again}", "no password is {w} and the id of {w} is {n}",
]
FIRST_NAMES, STREETS = ["Anna", "Peter", "Maria", "John", "Zoë", "Ahmed", "Lucía", "Jean"], ["Street", "Road", "Lane", "Avenue", "Drive", "Boulevard"]


def filled(kind: str, rng: random.Random) -> str:
    """A value of a kind, made up."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits = lambda n: rng.choice("123456789") + pick("0123456789", n - 1)
    word = lambda: pick("etaoinshrdlu", rng.randint(2, 9)) + rng.choice(["", "", "", "é", "ing"])
    if kind == "email":
        return f"{word()}{rng.choice(['.', '_', ''])}{digits(2)}@{word()}.{rng.choice(['org', 'com', 'example.net'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        sep = rng.choice(["", " ", "-"])
        return sep.join(digits(4) for _ in range(4))
    if kind == "phone":
        return rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+{digits(11)}"])
    if kind == "local":
        return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"0{digits(3)} {digits(7)}"])
    if kind == "secret":
        chars = rng.choice(["0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZ234567", "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"])
        return pick(chars, rng.choice([16, 18, 20, 24, 32, 40])) + rng.choice("0123456789") + rng.choice("abcdef" if chars[0] == "0" else chars)
    if kind == "id":
        return rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", digits(9)])
    if kind == "passport":
        return pick("CFGHJKLMNPRTVWXYZ", 2) + digits(7)
    if kind == "name":
        return f"{rng.choice(['Mr.', 'Mrs.', 'Dr.', 'Ms', 'Prof.', 'Herr', 'Frau', 'Mme'])} {rng.choice(FIRST_NAMES + [word().capitalize()])} {word().capitalize()}"
    if kind == "address":
        return f"{rng.randint(1, 400)} {word().capitalize()} {rng.choice(STREETS)}"
    if kind in ("n", "long", "longer"):
        return digits({"n": rng.randint(1, 4), "long": rng.randint(5, 7), "longer": 16}[kind])
    if kind == "money":
        return f"{digits(1)},{digits(3)}.{digits(2)}"
    if kind == "dotted":
        return f"{digits(1)}.{digits(1)}.{digits(1)}"
    if kind == "date":
        return rng.choice([f"{digits(4)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}/0{digits(1)}/{digits(4)}"])
    if kind == "time":
        return f"1{digits(1)}:{digits(2)}"
    if kind == "again":  # one capitalised word over and over
        return " ".join([word().capitalize()] * rng.randint(3, 14))
    return {"w": word(), "W": word().upper(), "Cap": word().capitalize()}[kind]


#: What a placeholder of the lines is labelled as, where its name is not the kind.
LABELS = {"local": "phone", "passport": "id"}


def labelled_lines(n: int = LINES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]): the labelled table, the same for the same ``n``."""
    rng, out = random.Random(11), []
    for k in range(n):
        some = WITH_SPANS if k % 2 else WITHOUT
        line = some[k // 2 % len(some)]
        text, spans, at = "", [], 0
        if rng.random() < 0.5:  # words before and behind, as in running text
            line = "{Cap} {w} {w} " + line + " {w} {w} {w}."
        for m in re.finditer(r"\{(\w+)\}", line):
            text += line[at : m.start()]
            value, kind = filled(m[1], rng), LABELS.get(m[1], m[1])
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(value)))
            text, at = text + value, m.end()
        out.append((text + line[at:], spans))
    return out


def labelled_table(lines: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the labelled lines."""
    rows = []
    for text, spans in labelled_lines() if lines is None else lines:
        starts, ends, shape = shapes(text)
        y = np.zeros(len(starts), dtype=np.int64)
        for kind, a, b in spans:
            y[(starts < b) & (ends > a)] = KINDS.index(kind) + 1
        rows.append((features(shape), y))
    return rows


def train(lines: list | None = None) -> Chain:
    return Chain().fit(labelled_table(lines))


# -- spans --------------------------------------------------------------------------


def add_spans(text: str, base: list, label: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """The base spans and the chain's that overlap none of them, without the punctuation around."""
    out, at = list(base), np.flatnonzero(label)
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(label[at]) != 0)) + 1
    taken = sorted((a, b) for _, a, b in base)
    for run in np.split(at, cuts) if len(at) else []:
        a, b, k = int(starts[run[0]]), int(ends[run[-1]]), int(label[run[0]]) - 1
        while b > a and text[b - 1] in ".,;:!?\"'|*#%&$":
            b -= 1
        while a < b and text[a] in "\"'|*#%&$<":
            a += 1
        if KINDS[k] == "secret" and re.match(r"\w+[=:].", text[a:b]):  # what the secret is for stays
            a += re.search("[=:]", text[a:b]).end()
        # A number of a card's shape is a card's only if its check digit holds, and a phone's only if it has enough digits.
        good = KINDS[k] != "card" or any(kind == 2 for kind, _, _ in base_spans(text[a:b]))
        # A name is its title and a few different words; a passage of capitalised words is none.
        good &= KINDS[k] != "name" or 2 <= len(run) == len(set(text[a:b].split())) <= NAME_WORDS
        good &= KINDS[k] != "address" or any(c.isalpha() for c in text[a:b])
        good &= KINDS[k] != "phone" or 8 <= sum(c.isdigit() for c in text[a:b]) <= 15
        if good and a < b and not any(s < b and e > a for s, e in taken):
            out.append((k, a, b))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_all(values: list[str], chain: Chain) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of each text; shapes and scores are computed for all of them together."""
    offset = np.concatenate([[0], np.cumsum([len(v) + 1 for v in values])]).astype(np.int64)
    starts, ends, shape = shapes("\n".join([*values, ""]))
    first = np.searchsorted(starts, offset)
    begins = np.zeros(len(starts) + 1, dtype=bool)
    begins[first] = True
    begins = begins[:-1]
    kinds, which = np.unique(shape, return_inverse=True)
    score = (own_features(kinds) @ chain.emit[:N_OWN] + chain.emit[-1])[which]
    for k, flag in enumerate(flags(shape)):
        # Weights of the neighbours: the next word's flag, then the previous one's; texts do not see each other.
        at = np.flatnonzero(flag[1:] & ~begins[1:])
        score[at] += chain.emit[N_OWN + 2 * k]
        at = np.flatnonzero(flag[:-1] & ~begins[1:]) + 1
        score[at] += chain.emit[N_OWN + 2 * k + 1]
    label = chain.labels(score, begins)
    for i, value in enumerate(values):
        base = base_spans(value)
        a, b = first[i], first[i + 1]
        if label[a:b].any():
            yield base, add_spans(value, base, label[a:b], starts[a:b] - offset[i], ends[a:b] - offset[i])
        else:
            yield base, base


def groups(values: list[str], limit: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters, so that arrays stay small; a longer text is a run of its own."""
    held, size = [], 0
    for v in values:
        if held and size + len(v) > limit:
            yield held
            held, size = [], 0
        held.append(v)
        size += len(v)
    if held:
        yield held


def scan(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Spans of every whole text: base_spans and spans as text, and the counts of the base by kind."""
    chain = chain or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for part in groups(batch.column(1).to_pylist()) for x in find_all(part, chain)]
            base = [written(b) for b, _ in found]
            counts = [[sum(k == i for k, _, _ in b) for b, _ in found] for i in range(len(BASE_KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(base, pa.string()),
                    pa.array([written(s) for _, s in found], pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_spans", "spans"],
            )

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return rows.mapInArrow(releasing(run), f"doc_id long, {kinds}, base_spans string, spans string")


def mask(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by the kind in brackets; all columns and rows stay."""
    chain, at = chain or train(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            values = batch.column(at).to_pylist()
            found = (x for part in groups([v or "" for v in values]) for x in find_all(part, chain))
            for value, (_, spans) in zip(values, found):
                if not spans:
                    out.append(value)
                    continue
                pieces, done = [], 0
                for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if b > done:
                        pieces += [value[done : max(a, done)], f"[{KINDS[k]}]" if a >= done else ""]
                        done = b
                out.append("".join([*pieces, value[done:]]))
            columns = [pa.array(out, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(releasing(run), docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans"
    )
