"""Personal data: base patterns, and candidate spans judged by gradient-boosted trees.

The base patterns always hold. Beyond them, generators of high recall propose spans that may
overlap: every run of whole groups in a chain of numbers, written-out addresses, keys and assigned secrets, IPv6, bank and
social numbers. A boosted ensemble of symmetric trees scores each from its format and its
context; a threshold per kind, calibrated on examples kept from training, selects. Accepted
spans that touch no base span and no better candidate are added.

The trees learn from examples made here from a seed, by format grammars for both classes;
no document is needed, so the model is the same for every corpus.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import map_text, unused

#: Kinds in the order of equal starts; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "id")

# Base patterns: each matches what the contract's does, but never tries a place twice.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base patterns' valid matches, by start and then kind."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            floor = m.end()
            at = text.find("@", m.end())
        else:
            floor = max(floor, at)
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Generators: (kind, pattern), on texts with a digit.
_CHAIN = re.compile(r"(?<![\w.,])[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_LEFT_GROUP = re.compile(r"([0-9]+)([\x20().\-/]{0,2})$")
_RIGHT_GROUP = re.compile(r"([\x20().\-/]{0,2})([0-9]+)")
#: Kinds whose candidates are runs of a chain's groups: only a whole number is right.
_RUNS = ("card", "phone", "id")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+=*")
_HEXES = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_MARK = re.compile(r"[=:]")
_VALUE = re.compile(r"\s{0,3}[\"']?([^\s\"',;]{6,})")
_AT = re.compile(r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)")
_AFTER = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}){1,4}")
#: Words before an assigned secret.
_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key", "auth", "credential")
_LONGEST_NAME = max(map(len, _NAMES))
#: Context words, by the feature they make.
_CONTEXT = (
    ("phone", "tel", "call", "mobile", "fax", "dial"),
    ("card", "visa", "credit", "debit", "payment"),
    ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential"),
    ("mail", "contact", "write", "reach"),
    ("ip", "host", "server", "address", "addr"),
    ("ssn", "social", "passport", "iban", "account", "acct", "licence", "license"),
    ("version", "v", "page", "pages", "chapter", "section", "isbn", "issn", "volume", "figure"),
    ("order", "invoice", "item", "sku", "part", "ticket", "number", "no", "ref", "id"),
    ("date", "year", "born", "on", "since", "until", "time"),
    ("commit", "sha", "md5", "hash", "build", "revision", "uuid"),
    ("price", "usd", "eur", "total", "cost", "km", "kg"),
)


def candidates(text: str) -> list[Span]:
    """Proposed spans, overlapping as they may."""
    out: set[Span] = set()
    for m in _AT.finditer(text) if " at " in text or "at)" in text or "at]" in text or "at}" in text else ():
        if tail := _AFTER.match(text, m.end()):
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.add((start, tail.end(), "email"))
    if "=" in text or ":" in text:
        for m in _MARK.finditer(text):
            end = m.start()
            while end > 0 and text[end - 1] in " \"'":
                end -= 1
            name = text[max(0, end - _LONGEST_NAME) : end].lower()
            if name.endswith(_NAMES) and (v := _VALUE.match(text, m.end())):
                out.add((v.start(1), v.end(1), "secret"))
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
            for k, (start, _) in enumerate(groups):
                while start > m.start() and text[start - 1] in "+(":
                    start -= 1
                n = 0
                for a, b in groups[k : k + 19]:  # at most 19 groups, of a digit or more
                    n += b - a
                    if n > 19:
                        break
                    if 7 <= n <= 15:
                        out.add((start, b, "phone"))
                    if n >= 12:
                        out.add((start, b, "card"))
                    if 8 <= n <= 12:
                        out.add((start, b, "id"))
        out |= {(m.start(), m.end(), "secret") for m in _KEY.finditer(text)}
        if ":" in text:
            out |= {(m.start(), m.end(), "ip") for m in _HEXES.finditer(text)}
        out |= {(m.start(), m.end(), "id") for m in _IBAN.finditer(text)}
    return sorted(out)


_WORD = re.compile(r"[A-Za-z]+")
FEATURE_NAMES = (
    *(f"kind_{k}" for k in KINDS), "length", "digits", "digit_share", "upper_share", "lower_share", "hex_share", "entropy",
    "spaces", "hyphens", "dots", "slashes", "parens", "plus", "at_mark", "dot_word", "luhn", "changes", "groups", "longest_group",
    "first_group", "last_group", "groups_334", "groups_324", "groups_4444", "iban_check", "date_like", "prefix_key", "colons",
    "left_letter", "right_letter", "left_mark", "right_percent", "year_first", "left_run", "left_tight", "right_run", "right_tight", *(f"near_{c[0]}" for c in _CONTEXT),
)


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, span: Span) -> list[float]:
    """The features of a candidate: its format and the words around it."""
    a, b, kind = span
    s, n = text[a:b], b - a
    digits = _digits(s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    left = [w.lower() for w in _WORD.findall(text[max(0, a - 32) : a])][-4:]
    right = [w.lower() for w in _WORD.findall(text[b : b + 16])][:1]
    near = set(left) | set(right)
    before, after = text[a - 1 : a], text[b : b + 1]
    beside = [0, 0.0, 0, 0.0]  # digits of the groups that the chain goes on with, and whether without a blank
    if kind in _RUNS:
        if m := _LEFT_GROUP.search(text, max(0, a - 24), a):
            beside[:2] = len(m[1]), float(" " not in m[2])
        if m := _RIGHT_GROUP.match(text, b, b + 24):
            beside[2:] = len(m[2]), float(" " not in m[1])
    date = bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][0-3]?[0-9][-/.](?:19|20)?[0-9]{2}", s))
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, sum(c == "u" for c in classes) / n, sum(c == "l" for c in classes) / n,
        sum(c in "0123456789abcdefABCDEF" for c in s) / n, entropy, s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("(") + s.count(")"),
        s.count("+"), float("at" in s and kind == "email"), float("dot" in s and kind == "email"), float(len(digits) >= 12 and luhn(digits)),
        sum(x != y for x, y in zip(classes, classes[1:], strict=False)) / n, len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(groups in ([3, 3, 4], [1, 3, 3, 4])), float(groups == [3, 2, 4]), float(groups == [4, 4, 4, 4]), float(kind == "id" and _iban(s)), float(date),
        float(s.startswith(("AKIA", "ASIA", "ghp_", "sk-", "sk_", "xox", "eyJ"))), s.count(":"), float(before.isalnum()), float(after.isalnum()),
        float(before in ("=", ":", '"', "'")), float(after in ("%", "°", "€", "$")), float(bool(groups) and groups[0] == 4 and s[:2] in ("19", "20")), *beside, *(float(bool(near & set(c))) for c in _CONTEXT),
    ]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``n`` candidates found in sentences made from format grammars."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick("abcdefghijklmnopqrstuvwxyz", r.randint(2, 9))
    alnum, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    key = lambda k, chars=alnum: pick(chars, k - 2) + r.choice("0123456789") + r.choice("ab")

    def card() -> str:
        body = r.choice("3456") + d(r.choice((13, 14)))
        whole = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = r.choice(("", " ", "-", ".", "/"))
        return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def iban() -> str:
        country, body = r.choice(("DE", "FR", "GB", "ES")), d(18)
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{98 - rest:02d}{body}"

    good = {
        "phone": (lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)}/{d(4)}/{d(6)}", lambda: f"+{d(r.choice((1, 2)))} ({d(3)}) {d(3)}-{d(4)}"),
        "card": (card,),
        "id": (lambda: f"{d(3)}-{d(2)}-{d(4)}", iban),
        "secret": (lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + "4", lambda: f"password={key(r.randint(8, 24), hexes)}", lambda: f'token = "{key(40, hexes)}"', lambda: f"secret: {key(r.randint(10, 40))}", lambda: f"api_key={key(32)}", lambda: "ghp_" + key(36), lambda: "sk-" + key(40)),
        "email": (lambda: f"{word()}.{word()} (at) {word()} (dot) com", lambda: f"{word()}{d(2)} at {word()} dot org", lambda: f"{word()}[at]{word()}[dot]net", lambda: f"{word()} [at] {word()}.{r.choice(('com', 'org', 'net', 'de'))}"),
        "ip": (lambda: ":".join(pick(hexes, 4) for _ in range(8)), lambda: ":".join(pick(hexes, 2) for _ in range(6)), lambda: f"fe80:{pick(hexes, 4)}::{pick(hexes, 4)}"),
    }
    bad = (
        lambda: f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/19{d(2)}", lambda: f"19{d(2)} - 20{d(2)}",
        lambda: f"version {d(1)}.{d(2)}.{d(3)}.{d(4)}", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"order {d(r.randint(7, 12))}", lambda: d(r.randint(7, 18)),
        lambda: f"pages {d(3)}-{d(4)}", lambda: f"total {d(3)} {d(3)} {d(3)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"commit {key(40, hexes)}", lambda: f"md5 {key(32, hexes)}",
        lambda: f"{word()}-{word()}-{word()}-{word()}{d(1)}", lambda: f"http/{word()}/{word()}/{word()}{d(2)}/{word()}", lambda: f"{word()} at {word()}.{word()}", lambda: f"we met at {word()}.{word()}",
        lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"sku {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"uuid {key(8, hexes)}-{key(4, hexes)}-{key(4, hexes)}-{key(12, hexes)}", lambda: f"{word()}_{word()}_{word()}_{d(4)}",
        lambda: f"token: {word()}", lambda: f"the password: {word()}{word()}", lambda: f"{d(1)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"km {d(4)} {d(4)}",
        lambda: " ".join(d(r.randint(1, 6)) for _ in range(r.randint(3, 12))), lambda: r.choice((" ", "/", "-")).join(d(r.randint(2, 4)) for _ in range(r.randint(4, 9))),
    )
    plain = (lambda: f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: d(r.randint(1, 8)), lambda: f"{r.randint(1, 255)}.{d(2)}.{d(2)}.{r.randint(1, 255)}")
    xs, ys = [], []
    while len(ys) < n:
        lead, tail = [word() for _ in range(r.randint(2, 5))], [word() for _ in range(3)]
        parts: list[tuple[str, str]] = []  # (kind or none, text)
        if r.random() < 0.5:
            kind = r.choice(list(good))
            parts.append((kind, r.choice(good[kind])()))
            if r.random() < 0.4:
                lead.append(r.choice({
                    "phone": _CONTEXT[0], "card": _CONTEXT[1], "secret": _CONTEXT[2], "email": _CONTEXT[3], "ip": _CONTEXT[4],
                    "id": _CONTEXT[5],
                }[kind]))
            if kind in _RUNS and r.random() < 0.6:  # numbers side by side
                other = r.choice((kind, kind, "card", "phone", ""))
                parts.insert(r.randint(0, 1), (other, r.choice(good[other] if other else plain)()))
        else:
            parts.append(("", r.choice(bad)()))
        text, places = " ".join(lead), []
        for kind, part in parts:
            places.append((len(text) + 1, len(text) + 1 + len(part), kind))
            text += " " + part
        text = " ".join([text, *tail]) + "."
        for a, b, kind in candidates(text):
            right = any(k == kind and s <= a and b <= e and (b - a == e - s if k in _RUNS else b - a >= 0.4 * (e - s)) for s, e, k in places)
            xs.append(describe(text, (a, b, kind)))
            ys.append(float(right))
    return np.array(xs), np.array(ys)


@dataclass
class Boosted:
    """Symmetric trees for the log-odds, their calibration, and a threshold per kind."""

    features: np.ndarray  # (trees, depth)
    cuts: np.ndarray
    leaves: np.ndarray  # (trees, 2 ** depth)
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple = (0.5,) * len(KINDS)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Uncalibrated log-odds."""
        bits = x[:, self.features] > self.cuts
        leaf = bits @ (1 << np.arange(self.features.shape[1]))
        return self.bias + self.leaves[np.arange(len(self.leaves)), leaf].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 160, depth: int = 4, rate: float = 0.2, l2: float = 2.0, bins: int = 32) -> Boosted:
    """Gradient boosting of the logistic loss with Newton leaves."""
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(g, x[:, f], "left") for f, g in enumerate(grid)], 1)  # above cut k: bin > k
    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    m = np.full(len(y), bias)
    fs, cs, ls = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-m))
        g, h = y - q, q * (1 - q)
        leaf, tree_f, tree_c = np.zeros(len(y), int), [], []
        for level in range(depth):
            k, best = 1 << level, (-1.0, 0, 0)
            for f, cut in enumerate(grid):
                if not len(cut):
                    continue
                width = len(cut) + 1
                slot = leaf * width + binned[:, f]
                gs = np.bincount(slot, g, k * width).reshape(k, width).cumsum(1)
                hs = np.bincount(slot, h, k * width).reshape(k, width).cumsum(1)
                gain = (gs**2 / (hs + l2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + l2))[:, :-1].sum(0)
                if gain.max() > best[0] + 1e-12:
                    best = (float(gain.max()), f, int(gain.argmax()))
            _, f, c = best
            tree_f.append(f)
            tree_c.append(grid[f][c])
            leaf |= (binned[:, f] > c).astype(int) << level
        gs, hs = np.bincount(leaf, g, 1 << depth), np.bincount(leaf, h, 1 << depth)
        value = rate * gs / (hs + l2)
        m += value[leaf]
        fs.append(tree_f)
        cs.append(tree_c)
        ls.append(value)
    return Boosted(np.array(fs), np.array(cs), np.array(ls), bias)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float = 0.98) -> Boosted:
    """Fits slope and shift on rows kept from training, then each kind's least threshold of that precision."""
    m, a, b = model.margin(x), 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = q * (1 - q) + 1e-9
        g = np.array([((y - q) * m).sum(), (y - q).sum()])
        hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    p, limits = model.probability(x), []
    for k in range(len(KINDS)):
        of = x[:, k] == 1
        order = np.argsort(-p[of], kind="stable")
        right = np.cumsum(y[of][order]) / np.arange(1, of.sum() + 1)
        good = np.flatnonzero(right >= precision)
        limits.append(max(0.5, float(p[of][order][good[-1]])) if len(good) else 1.1)
    model.thresholds = tuple(limits)
    return model


@lru_cache(2)
def trained(n: int = 30_000, seed: int = 20_240) -> Boosted:
    """The model: two thirds of the made examples train it, one third calibrates."""
    x, y = examples(n, seed)
    cut = 2 * len(y) // 3
    return calibrate(boost(x[:cut], y[:cut]), x[cut:], y[cut:])


class _Taken:
    """Disjoint stretches of a text, by start; adding one that touches another joins them."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        """Whether a to b overlaps a stretch."""
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        """Adds a stretch that overlaps none."""
        k = bisect_right(self.ends, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def find(text: str, model: Boosted) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text, each by start and then kind.

    Of accepted candidates that overlap, the likelier one is taken; at ties the longer, then the one that starts first, then by kind's name.
    """
    base = base_spans(text)
    held = _Taken(base)
    proposed = [s for s in candidates(text) if not held.meets(s[0], s[1])]
    if not proposed:
        return base, base
    x = np.array([describe(text, s) for s in proposed])
    p = model.probability(x)
    limit = np.array([model.thresholds[KINDS.index(s[2])] for s in proposed])
    taken: list[Span] = []
    held = _Taken([])
    for k in sorted(np.flatnonzero(p >= limit).tolist(), key=lambda k: (-p[k], proposed[k][0] - proposed[k][1], proposed[k])):
        s = proposed[k]
        if not held.meets(s[0], s[1]):
            held.add(s[0], s[1])
            taken.append(s)
    return base, sorted(base + taken, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][1])
        out += [text[at:a], f"[{kind.upper()}]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs``.

    Places are code points. Null and empty texts have no spans; whole texts are read, however long;
    repeated rows and null ids each give a row; of overlapping added spans the likelier one is kept (see
    :func:`find`); an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    model = trained()

    def rows(texts: list[str]) -> list[pa.Array]:
        found = [find(t, model) for t in texts]
        counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:4]]
        return [*counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]), pa.array([joined(s) for _, s in found])]

    fields = [
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]), T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
    return map_text(docs, text, rows, fields, [id_col])


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with all spans of each text replaced, and ``length``, if there, set anew.

    Null texts stay null and keep their length; empty texts stay empty; whole texts are read, however long; repeated rows each
    stay; an empty table gives an empty result; all other columns stay, whatever their names.
    """
    model = trained()
    name = unused("redacted", *docs.columns)

    def rows(texts: list[str]) -> list[pa.Array]:
        return [pa.array([redact(t, find(t, model)[1]) for t in texts], pa.string())]

    done = map_text(docs, text, rows, [T.StructField(name, T.StringType())])
    known = F.col(text).isNotNull()
    columns = {text: F.when(known, F.col(name))}
    if length in docs.columns:
        columns[length] = F.when(known, F.length(name).cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return done.withColumns(columns).select(*[F.col(f"`{c}`") for c in docs.columns])
