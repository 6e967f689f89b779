"""Rule bitmask ledger: each rule is evaluated once, policies and ablations are bit arithmetic afterwards.

`ledger` adds one struct column to its input: the measurements and `failed`, a bigint whose bit i is set when
rule i of RULES fails.  A policy is a name, a version and a mask of the rules it enforces; applying or comparing
policies reads the stored bits and never the text again.

Defined cases: a null or empty text has all measurements 0 and fails `few_words`; repeated rows and ties are
rows like any other; an empty table gives an empty ledger; columns of any other name pass through untouched,
and a column that already has the ledger's name is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .words import SPACES, encoded

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words")
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    pairs = w[:-1] * len(ids) + w[1:]
    if len(ids) > 2_000_000:  # three ids no longer fit in 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(ids) + w[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    data = encoded(text)
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACES))
    lines = [x for x in data.split(b"\n") if x.strip()]
    caps = sum(map(bytes.isupper, words))
    return (
        len(words),
        (len(text) if text else 0) - spaces,
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        caps,
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, a SQL condition on the measurements, is true."""

    name: str
    fails: str


#: The order gives the bits: append new rules, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("capitals", "100 * n_caps_words > 70 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a row is kept when none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[x] for x in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words", "capitals"))
LENIENT = Policy("lenient", 1, (*BASE.rules, "symbols"))


def _measured() -> object:
    schema = ", ".join(f"{m} long" for m in MEASURES)

    @pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")

    return run.asNondeterministic()  # once a row, even where several columns come from it


def ledger(docs: DataFrame, text_col: str = "text", name: str = "ledger") -> DataFrame:
    """docs with a struct column `name`: MEASURES and `failed`."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    raw = docs.withColumn(name, _measured()(F.col(text_col)))
    bits = " + ".join(
        f"CASE WHEN {_on(r.fails, name)} THEN {1 << i}L ELSE 0L END" for i, r in enumerate(RULES)
    )
    fields = [F.col(f"{name}.{m}").alias(m) for m in MEASURES]
    return raw.withColumn(name, F.struct(*fields, F.expr(bits).alias("failed")))


def _on(condition: str, name: str) -> str:
    for m in MEASURES:
        condition = condition.replace(m, f"`{name}`.{m}")
    return condition


def kept(policy: Policy, name: str = "ledger") -> Column:
    """True where the row passes every rule of the policy."""
    return F.col(f"{name}.failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(measured: DataFrame, policies: tuple[Policy, ...] = (STANDARD, LENIENT), name: str = "ledger") -> DataFrame:
    """(policy, version, rule, failed_rows, only_by_rule, kept_without): what each rule costs.

    only_by_rule counts rows that this rule alone rejects; kept_without what the policy keeps when the rule is
    left out.  One aggregation over the distinct bit patterns (at most 2^rules) serves all policies.
    """
    patterns = measured.groupBy(F.col(f"{name}.failed").alias("bits")).agg(F.count("*").alias("n"))
    spec = F.array(*[
        F.struct(
            F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
            F.lit(p.mask).cast("long").alias("mask"), F.lit(BIT[r]).cast("long").alias("bit"),
        )
        for p in policies
        for r in p.rules
    ])
    each = patterns.select("bits", "n", F.explode(spec).alias("s")).select("bits", "n", "s.*")
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed_rows"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_by_rule"),
        F.sum(F.when((hit == 0) | (hit == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def passing(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs, of any name.

    A null or empty text has no words; repeated rows are judged alike; an empty table gives no rows.
    """
    name, taken = "ledger", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return ledger(docs, text_col, name).where(kept(policy, name)).drop(name)
