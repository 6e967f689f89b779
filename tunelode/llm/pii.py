"""Personal data in whole texts: exact patterns, and a character BiLSTM-CRF that adds spans they miss.

The tagger reads windows of WINDOW characters at every half WINDOW of the text.  What lacks its kind's form is left
out, and every form holds a digit or an '@', so only the windows with one of those and their neighbours are decoded.
Each window is decoded by itself.  A span that touches a window's edge is read again in a window twice as long around
it, until it ends inside a window or with the text, so spans of any length are seen whole.  The spans of all windows
then compete in one weighted interval schedule over the document, where a cut span loses to the whole one.  What
overlaps a pattern's span is left out.

The tagger is trained where the query starts, on labelled windows drawn from seeded templates (TRAIN_WINDOWS of them,
a fixed bound): the four kinds in many written forms among invented words, with look-alikes as negatives.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .tagger import PAD, Tagger, char_ids
from .words import give_back

KINDS = ("email", "ip", "card", "phone")
WINDOW, TRAIN_WINDOWS = 96, 1800
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"

Span = tuple[int, int, int]  # start, end, kind's number

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of payment card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, in time linear in the text: an '@' with a local part left of it and a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind."""
    out = _emails(text) if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# Training windows


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, letters: str = "etaoinshrdlucmfwygpbvkéäöüñ") -> str:
    w = "".join(rng.choice(list(letters), rng.integers(1, 11)))
    return w.capitalize() if rng.random() < 0.12 else w


def _email(rng: np.random.Generator) -> str:
    name = _word(rng, "etaoinshrdlucm") + str(rng.choice(["", ".", "_", "-", "+"])) + (_digits(rng, rng.integers(1, 4)) if rng.random() < 0.4 else _word(rng, "etaoinshr"))
    host = ".".join(_word(rng, "etaoinshrdlucm").lower() + (_digits(rng, 1) if rng.random() < 0.2 else "") for _ in range(rng.integers(1, 3)))
    at = "@" if rng.random() < 0.8 else str(rng.choice([" @ ", "@ ", " @"]))
    return name + at + host + "." + str(rng.choice(["com", "org", "net", "de", "fr", "example"]))


def _ip(rng: np.random.Generator) -> str:
    return str(rng.choice([".", ".", ".", " . "])).join(map(str, rng.integers(0, 256, 4)))


def _card(rng: np.random.Generator) -> str:
    d = _digits(rng, 16 if rng.random() < 0.8 else rng.integers(14, 20))
    sep = str(rng.choice(["", "", " ", "-", ".", "  "]))
    return sep.join(d[i : i + 4] for i in range(0, len(d), 4))


def _phone(rng: np.random.Generator) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    s = str(rng.choice([" ", "-", "."]))
    form = str(rng.choice([f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"({a}){s}{b}{s}{c}"]))
    return (str(rng.choice([f"+{_digits(rng, 1)} ", f"+{_digits(rng, 2)} ", "+1-", "1-", ""])) + form) if rng.random() < 0.9 else f"+{_digits(rng, 11)}"


def _plain_number(rng: np.random.Generator) -> str:
    hexa = "".join(rng.choice(list("0123456789abcdef"), 40))
    return str(rng.choice([
        _digits(rng, rng.integers(1, 9)), f"{_digits(rng, 1)}.{_digits(rng, 1)}", f"{_digits(rng, 2)}.{_digits(rng, 1)}.{_digits(rng, 2)}",
        f'token = "{hexa}"', f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}", f"{_digits(rng, 3)},{_digits(rng, 3)}.{_digits(rng, 2)}",
        "AKIA" + "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ234567"), 16)), "@" + _word(rng), f"v{_digits(rng, 1)}.{_digits(rng, 1)}",
    ]))


def training_windows(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character ids and their tags: 0 outside, 2k + 1 at a span of kind k's start, 2k + 2 inside it."""
    rng = np.random.default_rng(seed)
    make = (_email, _ip, _card, _phone)
    x, y = np.full((n, WINDOW), PAD), np.zeros((n, WINDOW), dtype=np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < WINDOW + 20:
            r = rng.random()
            kind = int(rng.integers(0, 4)) if r < 0.12 else -1
            part = make[kind](rng) if kind >= 0 else _plain_number(rng) if r < 0.2 else _word(rng)
            tags += [0] * len(part) if kind < 0 else [2 * kind + 1] + [2 * kind + 2] * (len(part) - 1)
            tail = str(rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", " | ", "### "]))
            text, tags = text + part + tail, tags + [0] * len(tail)
        cut = int(rng.integers(0, 20))
        x[row], y[row] = char_ids(text[cut : cut + WINDOW]), tags[cut : cut + WINDOW]
    return x, y


@functools.cache
def trained(n: int = TRAIN_WINDOWS) -> Tagger:
    """The tagger fitted on n windows; the same on every run."""
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.fit(*training_windows(n))
    return tagger


# Decoding


def windows(text: str) -> list[int]:
    """Starts of the windows, one at every half WINDOW, that hold a trigger or lie next to one that does."""
    half = WINDOW // 2
    last = max(0, -(-len(text) // half) - 2)
    near: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // half  # windows k - 1 and k hold it
        near.update(range(max(0, k - 2), min(last, k + 1) + 1))
    return [k * half for k in sorted(near)]


def wider(start: int, end: int, n: int, length: int) -> int:
    """Start of the window of that length around a span of at most half of it, on a grid of a quarter of it."""
    step = length // 4
    return max(0, min(((start + end - length) // 2 + step // 2) // step * step, n - length))


def schedule(spans: list[tuple[int, int, int, float]]) -> list[Span]:
    """The non-overlapping spans of the largest total weight; ties go to the earlier end."""
    spans = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = np.array([s[1] for s in spans])
    best, take = [0.0], []
    for i, (start, _, _, w) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], start, side="right"))
        take.append((best[j] + w > best[i], j))
        best.append(max(best[i], best[j] + w))
    out, i = [], len(spans)
    while i:
        used, j = take[i - 1]
        if used:
            out.append(spans[i - 1][:3])
        i = j if used else i - 1
    return out[::-1]


def _has_form(s: str, kind: int) -> bool:
    digits = len(_DIGITS.findall(s))
    if kind == 0:
        return "@" in s and "." in s.rpartition("@")[2].strip(". ") and s.rpartition("@")[0].strip() != ""
    if kind == 1:
        parts = [p.strip() for p in s.split(".")]
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) < 256 for p in parts if len(p) < 4) and max(map(len, parts)) < 4
    return (14 <= digits <= 19 if kind == 2 else 10 <= digits <= 15) and s[-1].isdigit()


def _decoded(texts: list[str], jobs: list[tuple[int, int]], length: int, tagger: Tagger) -> Iterator[tuple[int, int, int, int, float, bool]]:
    """Each span in windows (text, start): text, start, end, kind, weight, and whether a window's edge may cut it."""
    x = np.full((len(jobs), length), PAD)
    for r, (i, at) in enumerate(jobs):
        ids = char_ids(texts[i][at : at + length])
        x[r, : len(ids)] = ids
    tags, em = tagger.decode(x)
    for r in np.flatnonzero(tags.any(1)):
        (i, at), row = jobs[r], tags[r]
        n, p = len(texts[i]), 0
        while p < length:
            if not row[p]:
                p += 1
                continue
            kind, e = (int(row[p]) - 1) // 2, p + 1
            while e < length and row[e] == 2 * kind + 2:
                e += 1
            cut = (p == 0 and at > 0) or (e == length and at + e < n)
            weight = float((em[r, np.arange(p, e), row[p:e]] - em[r, p:e, 0]).sum())
            if at + p < n:
                yield i, at + p, min(at + e, n), kind, weight, cut
            p = e


def find_all(texts: list[str], tagger: Tagger, batch: int = 128) -> list[list[tuple[int, int, int, bool]]]:
    """Every text's spans (start, end, kind, base) by start and kind."""
    base = [base_spans(t) for t in texts]
    jobs, length = [(i, at) for i, t in enumerate(texts) for at in windows(t)], WINDOW
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    while jobs:
        again, rows = set(), max(1, batch * WINDOW // length)
        for lo in range(0, len(jobs), rows):
            for i, s, t, kind, weight, cut in _decoded(texts, jobs[lo : lo + rows], length, tagger):
                if cut:
                    again.add((i, wider(s, t, len(texts[i]), 2 * length)))
                while s < t and texts[i][s] in " \n":
                    s += 1
                while s < t and texts[i][t - 1] in " .,\n-":
                    t -= 1
                if s < t and _has_form(texts[i][s:t], kind):
                    found.setdefault(i, []).append((s, t, kind, max(weight, 1e-3) * (0.1 if cut else 1)))
        jobs, length = sorted(again), 2 * length
    out = []
    for i, spans in enumerate(base):
        more = [s for s in schedule(found[i]) if all(s[1] <= b[0] or b[1] <= s[0] for b in spans)] if i in found else []
        both = [(*s, True) for s in spans] + [(*s, False) for s in more]
        out.append(sorted(both, key=lambda s: (s[0], s[2], s[1])))
    return out


def _finder(tagger: Tagger) -> Callable:
    @pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        found = find_all([t if isinstance(t, str) else "" for t in texts], tagger)
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in row] for row in found])

    return run.asNondeterministic()  # once a row, even where several columns come from it


def find(docs: DataFrame, text_col: str = "text", name: str = "pii", train_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """docs with an array column `name` of spans: kind, start, end (code points, end exclusive), base.

    base marks the fixed patterns' spans, which always stay; the tagger's never overlap them.  Null and empty texts
    have none; repeated rows have the same ones; an empty table gives no rows; other columns pass through, and a
    column that has the added name is an error.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    return docs.withColumn(name, _finder(trained(train_windows))(F.col(text_col)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in brackets; what overlaps an earlier span goes with it."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", train_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """docs with every span of text_col replaced by its kind, such as [EMAIL]; a null text stays null."""
    tagger = trained(train_windows)

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = find_all([t if isinstance(t, str) else "" for t in texts], tagger)
            yield pd.Series([redacted(t, s) if isinstance(t, str) else None for t, s in zip(texts, found, strict=True)], dtype=object)
        give_back()

    return docs.withColumn(text_col, run.asNondeterministic()(F.col(text_col)))
