"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: each source's share of the mix by weight, capped at `limit` times its size, the excess reshared.
2. Equal blocks of `block` words go to the sources by highest quotients target / (2 s + 1), s being the blocks a
   source has: an integer quota for each source.  A source whose target is under four blocks has its block halved until
   it is not; sources with blocks of one length share theirs among themselves.  A source's last block ends at its target.
3. A source's documents are dealt by a hash to shards of about `shard_rows` rows and `shard_bytes` of text, whichever
   are more; its quota is cut along the shards' cumulated sizes and rounded there, so the shards' integer quotas add
   up to it.
4. Within a shard the documents stand in a seeded order as one stream of words; whole passes come first, then the
   quota's rest is drawn by a seeded permutation of stretches of the source's block, the last of them in part.

The driver holds one row a source (at most MAX_SOURCES, else an error).  A shard is one task's group; rows of one id
and one text fall into one shard.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import keep
from .words import WORD

MAX_SOURCES = 200_000
_RANGES = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """share * sum(sizes) dealt by weight; who would pass limit * size stops there and the rest is dealt again."""
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= limit * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        stopped = set(full)
        open_ = [i for i in open_ if i not in stopped]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); ties go to the earlier entry.

    The divisor total / seats puts every entry within one seat of its final count or so; the rest is settled
    quotient by quotient.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [int(v * seats / total + 0.5) for v in votes]
    if (n := sum(got)) < seats:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, got, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(seats - n):
            _, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    else:
        heap = [(votes[i] / (2 * s - 1), -i) for i, s in enumerate(got) if s]
        heapq.heapify(heap)
        for _ in range(n - seats):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def block_length(target: float, block: int) -> int:
    """`block`, halved while a target has less than four of it."""
    while block > 1 and 4 * block > target:
        block //= 2
    return block


def apportioned(goal: list[float], lengths: list[int]) -> list[int]:
    """Blocks of each source; those with blocks of one length are apportioned together, the last block begun counts."""
    out = [0] * len(goal)
    for length in set(lengths):
        same = [i for i, x in enumerate(lengths) if x == length]
        votes = [goal[i] for i in same]
        for i, n in zip(same, sainte_lague(votes, math.ceil(sum(votes) / length - 1e-9)), strict=True):
            out[i] = n
    return out


def words_of(blocks: int, length: int, target: float) -> int:
    """Words of a source's blocks, the last one being cut where the target lies within it."""
    words = round(target)
    return words if (blocks - 1) * length < words < blocks * length else blocks * length


def draw(sizes: np.ndarray, quota: int, block: int, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """(whole passes, words taken from the start of each stretch of `block` words) for a quota of words over a stream of
    documents of these sizes; at most two passes in all."""
    total = int(sizes.sum())
    taken = np.zeros(-(-total // block), dtype=np.int64)
    if not total or quota >= 2 * total:
        return 2 * bool(total), taken
    passes, rest = divmod(quota, total)
    whole = total // block
    order = np.r_[rng.permutation(whole), np.arange(whole, len(taken))]  # a short last stretch comes last
    taken[order[: rest // block]] = block
    if rest % block:
        taken[order[rest // block]] = rest % block
    return passes, taken


def cut_at(upto: Column, blocks: Column, size: Column) -> Column:
    """round(upto * blocks / size) of whole numbers; the product is a decimal, since it may pass 2^63."""
    wide = [x.cast("decimal(20,0)") for x in (upto, blocks, size)]
    return F.floor((wide[0] * wide[1] * 2 + wide[2]) / (wide[2] * 2)).cast("long")


def _selector(seed: int, ranges: bool, finish: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_order", "ascending"), ("_tie", "ascending"), ("_size", "ascending")])
        sizes = rows.column("_size").to_numpy()
        first = rows.slice(0, 1).to_pylist()[0]
        rng, block = np.random.default_rng([seed, first["_rank"], first["_shard"]]), first["_block"]
        passes, taken = draw(sizes, first["_quota"], block, rng)
        before = np.r_[0, np.cumsum(taken)]
        ends = np.cumsum(sizes)
        starts = ends - sizes

        def taken_before(x: np.ndarray) -> np.ndarray:
            b = np.minimum(x // block, len(taken))
            return before[b] + np.minimum(np.r_[taken, 0][b], x - b * block)

        cols = {"taken": pa.array(passes * sizes + taken_before(ends) - taken_before(starts), type=pa.int64())}
        if ranges:
            lo = np.flatnonzero(taken) * block
            hi = lo + taken[lo // block]
            apart = np.flatnonzero(lo[1:] != hi[:-1])
            lo, hi = np.r_[lo[:1], lo[1:][apart]], np.r_[hi[:-1][apart], hi[-1:]]
            spans = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                a, b = np.searchsorted(hi, s, side="right"), np.searchsorted(lo, e, side="left")
                spans.append([{"from": max(int(x), s) - s, "to": min(int(y), e) - s} for x, y in zip(lo[a:b], hi[a:b], strict=True)])
            cols |= {"passes": pa.array([passes] * len(sizes), type=pa.int32()), "ranges": pa.array(spans, type=_RANGES)}
        for name, col in cols.items():
            rows = rows.append_column(name, col)
        return finish(rows)

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block: int = 32,
    shard_rows: int = 256, shard_bytes: int = 4 << 20, seed: int = 17, ranges: bool = False, keep_text: bool = True,
) -> DataFrame:
    """docs with the words that the mix takes of each: size, source_size, target and taken are added.

    ranges adds passes (how often the whole text comes) and ranges, the word ranges [from, to) that come once more.
    Sources stand by code point, null last, and weigh `weights` in turn.  A null or empty text has size 0 and
    nothing taken; a null id is dealt like an id; repeated rows each have their own words; an empty table gives no
    rows; other columns, of any name but an added one's, which is an error, pass through.  Without keep_text
    the texts are measured once and left behind, so that only ids and sizes are shuffled.
    """
    added = ["size", "source_size", "target", "taken"] + ["passes", "ranges"] * ranges
    if clash := {*added} & {*docs.columns}:
        raise ValueError(f"columns exist: {sorted(clash)}")
    names = [c for c in docs.columns if keep_text or c != text_col] + added
    rows, kind, select = _dealt(docs, id_col, text_col, source_col, weights, share, limit, block, shard_rows, shard_bytes, seed, ranges, keep_text)
    return rows.groupBy("_rank", "_shard").applyInArrow(select(lambda t, to: t.select(to.names).cast(to)), kind).toDF(*names)


def _dealt(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, limit: float, block: int,
    shard_rows: int, shard_bytes: int, seed: int, ranges: bool, keep_text: bool,
) -> tuple[DataFrame, T.StructType, Callable]:
    """Rows with their shard and its quota, docs' columns being c0, c1, ...; the schema of those and the added columns; and
    what makes a shard's function of a last step, which gets the shard's rows and that schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column is named like one made here
    docs, id_col, text_col, source_col = docs.toDF(*at.values()), at[id_col], at[text_col], at[source_col]
    sized = docs.withColumns({"_size": word_count(text_col), "_tie": F.coalesce(F.xxhash64(text_col), F.lit(0)), "_bytes": F.coalesce(F.octet_length(text_col), F.lit(0))})
    if not keep_text:
        sized = keep(sized.drop(text_col), "sizes")
    per = sized.groupBy(F.col(source_col).alias("s")).agg(F.sum("_size").alias("n"), F.count("*").alias("rows"), F.sum("_bytes").alias("bytes"))
    found = per.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.s is None, r.s or ""))
    sizes = [int(r.n) for r in found]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share, limit)
    lengths = [block_length(x, block) for x in goal]
    quotas = apportioned(goal, lengths)
    plan = spark.createDataFrame(
        [(r.s, i, sizes[i], goal[i], lengths[i], quotas[i], words_of(quotas[i], lengths[i], goal[i]), max(-(-r.rows // shard_rows), -(-r.bytes // shard_bytes))) for i, r in enumerate(found)],
        "_s string, _rank int, source_size long, target double, _block long, _all long, _words long, _shards long",
    )
    h = F.xxhash64(F.col(id_col), F.col("_tie"), F.lit(seed))
    dealt = sized.join(F.broadcast(plan), F.col(source_col).cast("string").eqNullSafe(F.col("_s"))).withColumns({
        "_shard": F.pmod(h, F.col("_shards")), "_order": F.xxhash64(h, F.lit(1)),
    })
    order = Window.partitionBy("_rank").orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n").over(order)
    cut = lambda x: F.least(cut_at(x, F.col("_all"), F.col("source_size")) * F.col("_block"), F.col("_words"))
    shard_quota = keep(
        dealt.groupBy("_rank", "_shard", "_block", "_all", "_words", "source_size").agg(F.sum("_size").alias("n"))
        .withColumn("_hi", upto).where("source_size > 0")
        .select(F.col("_rank").alias("_r"), F.col("_shard").alias("_c"), (cut(F.col("_hi")) - cut(F.col("_hi") - F.col("n"))).alias("_quota")),
        "quotas",
    )
    rows = dealt.join(shard_quota, (F.col("_rank") == F.col("_r")) & (F.col("_shard") == F.col("_c")), "left")
    rows = rows.withColumn("_quota", F.coalesce("_quota", F.lit(0))).withColumn("size", F.col("_size")).drop("_s", "_r", "_c")
    out = T.StructType([f for f in docs.schema.fields if keep_text or f.name != text_col] + [T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("taken", T.LongType())])
    if ranges:
        span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
        out = T.StructType([*out.fields, T.StructField("passes", T.IntegerType()), T.StructField("ranges", T.ArrayType(span))])
    kind = to_arrow_schema(out)
    return rows, out, lambda finish: _selector(seed, ranges, lambda t: finish(t, kind))


def _slicer(text: str, columns: list[str]) -> Callable[[pa.Table, pa.Schema], pa.Table]:
    """From a shard's rows with passes and ranges to the whole and cut rows that the mix holds."""
    word = re.compile(WORD)

    def part(t: str, spans: list[dict]) -> str:
        at = [m.span() for m in word.finditer(t)]
        return "\n".join(t[at[s["from"]][0] : at[s["to"] - 1][1]] for s in spans)

    def run(rows: pa.Table, kind: pa.Schema) -> pa.Table:
        texts, taken, passes, ranges = (rows.column(c).to_pylist() for c in (text, "taken", "passes", "ranges"))
        pick = [k for k, n in enumerate(passes) if taken[k] for _ in range(n)]
        some = [k for k, r in enumerate(ranges) if taken[k] and r]
        new = [texts[k] for k in pick] + [part(texts[k], ranges[k]) for k in some]
        out = rows.select(columns).take(pick + some)
        out = out.set_column(columns.index(text), text, pa.array(new, type=pa.string()))
        return out.cast(pa.schema([kind.field(c) for c in columns]))

    return run


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block: int = 32,
    shard_rows: int = 256, shard_bytes: int = 4 << 20, seed: int = 17,
) -> DataFrame:
    """The mixed corpus: docs as often as the mix takes them whole, and rows cut to the words it takes once more.

    Columns are those of docs, of any name; a document from which nothing is taken has no row.  Words are drawn and
    cut in one step, so that a task needs one Python worker.
    """
    rows, kind, select = _dealt(docs, id_col, text_col, source_col, weights, share, limit, block, shard_rows, shard_bytes, seed, True, True)
    plain = kind[: len(docs.columns)]
    step = select(_slicer(plain.names[docs.columns.index(text_col)], plain.names))
    return rows.groupBy("_rank", "_shard").applyInArrow(step, plain).toDF(*docs.columns)
