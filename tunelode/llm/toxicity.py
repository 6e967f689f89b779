"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. Lexicon: word forms and 4- to 6-letter word starts that occur in more toxic than clean labelled documents, by
   log-odds; counted on Spark over every labelled training row, equal texts once.
2. Features of a text: densities of lexicon words, how many stand within three words of a second-person pronoun,
   capitals, punctuation, and words written with digits or signs for letters (also looked up as plain letters).
3. Trees are boosted on about TRAIN_ROWS rows at most, chosen by a hash of the text, and calibrated by isotonic
   regression on the margins of folds that the trees haven't seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .words import encoded

TRAIN_ROWS, CANDIDATES, LEXICON = 20_000, 100_000, 8_192
MIN_TOXIC, MIN_LOG_ODDS, STRONG, FOLDS = 3, 1.5, 3.0, 3
#: Ids of training texts that are sent to every executor at once, at most.
BROADCAST_IDS = 500_000
NEAR = 3

#: Second-person pronouns of the languages at hand.
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Signs written for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = (
    "weight", "strong", "strong_count", "strong_forms", "weak", "second", "near_second", "capitals", "exclaims", "questions",
    "signs", "obfuscated", "obfuscated_strong", "length", "heaviest",
)


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a plain word: itself and its starts of 4 to 6 letters."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]


def _core(word: str) -> str:
    """A word without the signs around it, lower-cased."""
    if word.isalpha():
        return word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum() and word[a] not in "@$":
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


class Featurizer:
    """FEATURES of texts, each distinct word being looked at once."""

    KEPT = 200_000

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.table = np.zeros((4096, 9), dtype=np.float32)

    def _weight(self, word: str) -> float:
        return max((self.lexicon.get(k, 0.0) for k in keys_of(word)), default=0.0)

    def _row(self, raw: bytes) -> tuple[float, ...]:
        word = raw.decode()
        core = _core(word)
        weight = self._weight(core)
        mixed = len(core) > 3 and any(map(str.isalpha, core)) and not core.isalpha() and any(c in "013457@$!" for c in core)
        hidden = mixed and weight < STRONG and (w := self._weight(core.translate(SIGNS))) >= STRONG
        weight = w if hidden else weight
        capital = len(core) > 1 and word.upper() == word and word.lower() != word
        signs = sum(not c.isalnum() for c in word)
        return (weight, weight >= STRONG, 0 < weight < STRONG, core in SECOND, capital, "!" in word, "?" in word, signs, mixed + 2 * hidden)

    def one(self, text: str | None) -> np.ndarray:
        words = encoded(text).split()
        out = np.zeros(len(FEATURES), dtype=np.float32)
        n = len(words)
        if not n:
            return out
        try:
            ids = list(map(self.ids.__getitem__, words))
        except KeyError:
            if len(self.ids) > self.KEPT:
                self._reset()
            new = set(words).difference(self.ids)
            size = len(self.ids)
            if size + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.table) + len(new), 9), dtype=np.float32)])
            self.table[size : size + len(new)] = [self._row(w) for w in new]
            self.ids.update(zip(new, range(size, size + len(new)), strict=True))
            ids = list(map(self.ids.__getitem__, words))
        ids = np.array(ids)
        t = self.table[ids]
        total = t[:, :8].sum(0, dtype=np.float64)
        hits = np.flatnonzero(t[:, 1])
        near = 0
        if len(hits) and total[3]:
            at = np.r_[0, np.cumsum(t[:, 3])]
            near = (at[np.minimum(hits + NEAR + 1, n)] - at[np.maximum(hits - NEAR, 0)] > 0).sum()
        out[:] = (
            total[0] / n, total[1] / n, np.log1p(total[1]), np.log1p(len(np.unique(ids[hits]))), total[2] / n, total[3] / n, near / n,
            total[4] / n, total[5] / n, total[6] / n, total[7] / n, (t[:, 8] > 0).sum() / n, (t[:, 8] > 2).sum() / n, np.log1p(n), t[:, 0].max(),
        )
        return out

    def many(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.one(t) for t in texts], dtype=np.float32).reshape(-1, len(FEATURES))


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, threshold, leaf value
    start: float = -4.0
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.0]))  # calibration: margin, rate

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range((len(value) + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return 0.999 * np.interp(m, *self.steps) + 0.001 / (1 + np.exp(-m))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, damp: float = 1.0) -> Model:
    """Trees of logistic loss with second-order leaf values over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(start=float(np.log(base / (1 - base))))
    margin, inner = np.full(len(x), model.start), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, cut = np.full(width, 1e-6), np.zeros((width, 2), np.int64)
            for f in range(x.shape[1]):
                cell = (at - first) * bins + binned[:, f]
                gs, hs = (np.bincount(cell, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h))
                part = lambda a, b: a**2 / (b + damp)
                gain = part(gs, hs) + part(gs[:, -1:] - gs, hs[:, -1:] - hs) - part(gs[:, -1:], hs[:, -1:])
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best = np.where(better, gain[np.arange(width), top], best)
                    cut[better] = np.stack([np.full(width, f), top], axis=1)[better]
            for k in range(width):
                if best[k] > 1e-6:
                    feature[first + k], threshold[first + k] = cut[k, 0], edges[cut[k, 0]][cut[k, 1]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + damp)
        model.trees.append((feature, threshold, value))
        margin += value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising rates of y by margin: pool adjacent violators; knots to interpolate between."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _counts(rows: DataFrame, only: dict[str, int] | None) -> DataFrame:
    """(key, n): in how many of the texts a lexicon key stands; of `only` these keys, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = {_core(w.decode()) for w in set(encoded(text).split())}
                keys = {k for w in words if w for k in keys_of(w)}
                n.update(keys if only is None else keys & only.keys())
                if len(n) > 500_000:
                    yield pa.RecordBatch.from_pydict({"key": list(n), "n": list(n.values())})
                    n.clear()
        if n:
            yield pa.RecordBatch.from_pydict({"key": list(n), "n": list(n.values())})

    return rows.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def weights(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, less_toxic: int = 0, less_clean: int = 0) -> dict[str, float]:
    """Log-odds of the keys that tell toxic texts; less_* take a text's own part out of every count."""
    t, c, out = n_toxic - less_toxic + 1, n_clean - less_clean + 1, {}
    for k, n in toxic.items():
        if n - less_toxic >= MIN_TOXIC:
            w = float(np.log((n - less_toxic + 0.5) / t / ((max(clean.get(k, 0) - less_clean, 0) + 0.5) / c)))
            if w >= MIN_LOG_ODDS:
                out[k] = w
    return {k: out[k] for k in sorted(out, key=lambda k: (-out[k] * toxic[k], k))[:LEXICON]}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str) -> DataFrame:
    """(text, toxic) of each distinct text with a label 0 or 1, the larger one where copies differ.

    Only ids and hashes are shuffled.  The chosen ids are broadcast up to BROADCAST_IDS of them, else joined by shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = labels.where(F.col(toxic_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(toxic_col).cast("int").alias("toxic"))
    hashed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("h"))
    chosen = keep(hashed.join(marks, "_id").groupBy("h").agg(F.min("_id").alias("_id"), F.max("toxic").alias("toxic")).select("_id", "toxic"), "chosen")
    small = chosen.count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(F.broadcast(chosen) if small else chosen, "_id")
    return keep(rows.select("text", "toxic"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """A model from the documents that labels covers with 0 or 1; null texts are empty, copies count once.

    Features of training rows leave the row itself out of the lexicon's counts, and margins are calibrated on folds
    that the trees haven't seen.  Without rows of both classes the score is the rate of label 1, or 0 for no rows.
    """
    rows = training_rows(docs, labels, id_col, text_col, toxic_col)
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(steps=(np.array([0.0]), np.array([1.0 * (n1 > 0)])))
    some = _counts(rows.where("toxic = 1").select("text"), None).where(F.col("n") >= MIN_TOXIC).orderBy(F.desc("n"), "key").limit(CANDIDATES)
    toxic = {r.key: r.n for r in some.collect()}
    clean = {r.key: r.n for r in _counts(rows.where("toxic = 0").select("text"), dict.fromkeys(toxic, 0)).collect()}
    without = [weights(toxic, clean, n1, n0, less_clean=1), weights(toxic, clean, n1, n0, less_toxic=1)]
    draw = F.xxhash64("text", F.lit(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = [Featurizer(w) for w in without]
        for batch in batches:
            x = [make[y].one(t) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, type=pa.list_(pa.float32()))], names=["toxic", "h", "x"])

    drawn = rows.where(F.pmod(draw, F.lit(1_000_000)) < 1_000_000 * min(1.0, TRAIN_ROWS / (n1 + n0)))
    found = drawn.select("text", "toxic", draw.alias("h")).mapInArrow(run, "toxic int, h long, x array<float>").collect()
    found.sort(key=lambda r: (r.toxic, r.h))
    x, y = np.array([r.x for r in found], dtype=np.float32).reshape(-1, len(FEATURES)), np.array([r.toxic for r in found], dtype=np.float64)
    model, fold = boost(x, y), np.arange(len(y)) % FOLDS
    model.lexicon = weights(toxic, clean, n1, n0)
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            unseen[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    model.steps = isotonic(unseen, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, score) of every row, and the columns in also.

    Null and empty texts are scored as texts without words; repeated rows get equal scores; an empty table gives no
    rows; other columns are left out.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"), *also)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees, bounded by LEXICON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(shared.value.lexicon)
        for batch in batches:
            s = shared.value.score(make.many(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s, type=pa.float64())], names=[*batch.schema.names[1:], "score"])

    return rows.mapInArrow(run, rows.drop("_text").withColumn("score", F.lit(0.0)).schema)
