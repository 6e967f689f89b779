"""Exact Jaccard join of word-shingle sets by parity sketches.

A sketch cuts the hash space into m segments and flips one bit for every shingle of a set.  A shingle that only
one of two sets holds changes one bit of one segment, so the number of differing bits, and of differing segments,
is at most the sets' symmetric difference.  Two uses:

* Candidates.  Jaccard >= 0.8 leaves at most (|A| + |B|) / 9 differing shingles.  Segments with their contents stand
  in one global order, those with most shingles first and those of nothing but common shingles last; each set emits
  its first D + 1 of them, D being that bound for its largest possible partner.  Fewer than D + 1 segments differ, so the first equal one is emitted by both: no pair is lost.
  m follows the size band (a power of two) of the larger set, and a set whose partners may lie in the next band also
  emits there.  A segment is so wide (2^64 / m bits) that it is held as the XOR of its bits' hashes.
* Filter.  A dense sketch of 2^k bits, folded to the smaller of two lengths, drops candidates whose Hamming distance
  exceeds the bound.  What is left is verified on the shingle sets.

Links are only needed to join documents that are not joined yet.  The first rounds verify, for each segment, neighbours
in document order (a chain, not all pairs).  The last takes the segments that still hold three or more documents of
several components: their members are dealt into blocks of BLOCK, the dense sketches of two blocks meet in one task,
and only pairs across components that the sketches don't rule out leave it, to be verified.  So no task holds a hot
segment, no join pairs its members, and the components are exact whatever the first rounds found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from ..session import discard, keep
from .words import SPACES, encoded, give_back

#: Rows of at most 32 bytes that are sent to every executor at once, at most (8 MB); above it the texts are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Members of a block of a segment, about; bytes of a sketch that go there, at most (longer ones are folded); and of a
#: member's other segments the LOWEST keys, by which most pairs are seen to meet elsewhere too.
BLOCK, CARRIED, LOWEST = 512, 256, 16
#: Of the sample that tells common shingles.
SAMPLE_DOCS, COMMON_IN, MOST_COMMON = 6_000, 4, 200_000

#: Bytes of a text that are hashed at once, about, and of a word that has a weight of its own at each place; longer words are
#: hashed whole.
AT_ONCE, PLACES = 262_144, 4_096

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(5)
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_BYTE, _PLACE = _draw.integers(1, 1 << 64, 256, dtype=_U), _draw.integers(0, 1 << 64, PLACES, dtype=_U) | _U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_IS_SPACE] = 0


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, A-Z like a-z: the sum of its bytes' numbers times their places' weights."""
    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    np.logical_not(_IS_SPACE[b], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=_U)
    whole = np.flatnonzero(ends - starts > PLACES)
    for i in whole:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].lower())
    done = 0
    for stop in [*whole.tolist(), len(starts)]:
        while done < stop:
            upto = min(stop, max(done + 1, int(np.searchsorted(starts, starts[done] + AT_ONCE))))
            s, end = starts[done:upto] - starts[done], ends[upto - 1] - starts[done]
            # a word's places go on over the spaces after it, which count nothing
            at = np.arange(end) - np.repeat(s, _lengths(s, end))
            out[done:upto] = np.add.reduceat(_BYTE[b[starts[done] :][:end]] * _PLACE[np.minimum(at, PLACES - 1)], s)
            done = upto
        done = stop + 1
    return out


def _first(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _lengths(start: np.ndarray, end: int) -> np.ndarray:
    """How far it is from each start to the next, and from the last to the end."""
    out = np.empty(len(start), dtype=np.int64)
    np.subtract(start[1:], start[:-1], out=out[:-1])
    out[-1] = end - start[-1]
    return out


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer than k words are one shingle, none are none."""
    w = _word_hashes(encoded(text))
    if not len(w):
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        if len(w) < k:
            h = _U(len(w))
            for x in w:
                h = h * _P + x
            return _mix(np.array([h], dtype=_U))
        n = len(w) - k + 1
        h = np.zeros(n, dtype=_U)
        for i in range(k):
            h = h * _P + w[i : i + n]
        h = np.sort(_mix(h))
        return h[_first(h)]


def _among(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(s), dtype=bool)
    return common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s


def _band_keys(s: np.ndarray, mixed: np.ndarray, band: int, need: int, usual: np.ndarray) -> np.ndarray:
    """Keys of the first `need` segments of a set, in one order of all segments with their contents: those with many
    shingles first, those of nothing but `usual` shingles after them, empty ones last."""
    m = max(16, 3 << band)
    seg = ((s >> _U(32)) * _U(m)) >> _U(32)  # rises with s, which is sorted
    start = np.flatnonzero(_first(seg))
    fp = np.bitwise_xor.reduceat(mixed, start)
    at = seg[start]
    salt = _U(m) * _U(1 << 32)
    keys = _mix(fp ^ _mix(at + salt))
    if len(start) > need:
        usual, count = np.logical_and.reduceat(usual, start), _lengths(start, len(s))
        return keys[np.lexsort((keys, -count, usual))[:need]]
    if len(start) < need:  # segments without a shingle come last
        empty = np.setdiff1d(np.arange(m, dtype=_U), at)[: need - len(start)]
        keys = np.r_[keys, _mix(_mix(empty + salt))]
    return keys


_NONE = np.empty(0, dtype=_U)


def segment_keys(s: np.ndarray, common: np.ndarray = _NONE) -> np.ndarray:
    """All keys that a set emits, for its own band and, where partners reach it, the next."""
    n = len(s)
    if not n:
        return np.empty(0, dtype=np.int64)
    band, most = n.bit_length() - 1, n * 5 // 4
    top = 1 << (band + 1)
    with np.errstate(over="ignore"):
        mixed, usual = _mix(s), _among(s, common)
        keys = [_band_keys(s, mixed, band, (n + min(most, top - 1)) // 9 + 1, usual)]
        if most >= top:
            keys.append(_band_keys(s, mixed, band + 1, (n + most) // 9 + 1, usual))
    return np.concatenate(keys).view(np.int64)


def dense_sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set at the low bits of its hashes; 256 bits or the set's size rounded down to a power of 2."""
    bits = max(256, 1 << (max(len(s), 1).bit_length() - 1))
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def hamming(x: bytes, y: bytes) -> int:
    """Hamming distance of two dense sketches, the longer folded to the shorter."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("nth", pa.int64()),
    ("keys", pa.list_(pa.int64())),
])
_ROW_SQL = "doc_id long, n_shingles long, d1 long, d2 long, nth long, keys array<long>"


def _sketched(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a document; a set that the task has met before carries no keys again, and no number (nth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        nth = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                d1, d2 = _digest(s)
                new = len(s) > 0 and (d1, d2) not in met and doc_id is not None
                if new:
                    if len(met) > 100_000:
                        met.clear()
                    met.add((d1, d2))
                nth += 1
                rows.append((doc_id, len(s), d1, d2, nth if new else None, segment_keys(s, common) if new else None))
                size += len(s)
                if size > 200_000:
                    yield _to_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _to_batch(rows)
        give_back()

    return run


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _sample_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            s = shingle_set(text)
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), _digest(s)[0]))], names=["key", "d"])
    give_back()


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that stand in COMMON_IN or more of some SAMPLE_DOCS different documents, at most MOST_COMMON.

    They only decide the order in which segments are emitted: passages that many documents share come last, which
    keeps unrelated documents apart.  Whatever is in this list, no link is lost.
    """
    n = docs.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    drawn = docs.where(h < 1_000_000 * min(1.0, SAMPLE_DOCS / max(n, 1))).select("text")
    counts = drawn.mapInArrow(_sample_shingles, "key long, d long").groupBy("key").agg(F.count_distinct("d").alias("n"))
    found = counts.where(F.col("n") >= COMMON_IN).orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    return np.sort(found.column("key").to_numpy().view(_U))


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node), sorted, to (key, a, b) for neighbours under one key; holds one batch and one row.

    A range's first row comes as (key, a) and its last as (key, b) with the number of its part, for `_met`.
    """
    part, last_key, last_node = TaskContext.get().partitionId(), None, None

    def rows(key: np.ndarray, a: np.ndarray | None, b: np.ndarray | None, part: int | None = None) -> pa.RecordBatch:
        columns = [pa.nulls(len(key), pa.int64()) if x is None else pa.array(x) for x in (key, a, b)]
        number = pa.repeat(pa.scalar(part, pa.int32()), len(key))
        return pa.RecordBatch.from_arrays([*columns, number], names=["key", "a", "b", "part"])

    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        if last_key is None:
            yield rows(key[:1], node[:1], None, part)
        else:
            key, node = np.r_[last_key, key], np.r_[last_node, node]
        same = (key[1:] == key[:-1]) & (node[1:] != node[:-1])
        yield rows(key[1:][same], node[:-1][same], node[1:][same])
        last_key, last_node = key[-1], node[-1]
    if last_key is not None:
        yield rows(np.array([last_key]), None, np.array([last_node]), part)


def _met(keyed: DataFrame, done: list[DataFrame]) -> DataFrame:
    """(key, a, b) for neighbours under one key of rows (key, node).

    Rows are dealt by ranges of key and node, so a hot key is as many ranges as it fills; neighbours on two sides of a
    border come from one row a range.
    """
    cut = keyed.repartitionByRange("key", "nth").sortWithinPartitions("key", "nth")
    met = keep(cut.mapInArrow(_chains, "key long, a long, b long, part int"), "met")
    done.append(met)
    ends = met.where("part IS NOT NULL").groupBy("part").agg(
        F.max(F.when(F.col("a").isNotNull(), F.struct("key", "a"))).alias("first"), F.max(F.when(F.col("b").isNotNull(), F.struct("key", "b"))).alias("last")
    )
    following = ends.withColumn("next", F.lead("first").over(Window.orderBy("part")))
    borders = following.where("last.key = next.key AND last.b <> next.a").select("last.key", F.col("last.b").alias("a"), F.col("next.a").alias("b"))
    return met.where("part IS NULL").select("key", "a", "b").union(borders)


def _near(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sketches don't rule a link out."""
    for p in pdfs:
        ok = [
            5 * min(na, nb) >= 4 * max(na, nb) and 9 * hamming(x, y) <= na + nb
            for na, nb, x, y in zip(p.na, p.nb, p.xa, p.xb, strict=True)
        ]
        yield p.loc[ok, ["a", "b"]]


_SET = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("carried", pa.binary()), ("s", pa.list_(pa.int64()))])
_SET_SQL = "node long, n long, sketch binary, carried binary, s array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, node, d1, d2) to the sets of the texts that have these digests."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            rows = []
            for text, node, d1, d2 in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                s = shingle_set(text)
                if _digest(s) == (d1, d2):  # else another text of the same id
                    sketch = dense_sketch(s)
                    rows.append((node, len(s), sketch, _folded(sketch, CARRIED // 8).tobytes(), s.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _SET, strict=True)], schema=_SET)
    give_back()


def _sent(rows: DataFrame) -> DataFrame:
    """rows, a written table, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _verified(pairs: DataFrame, sets: DataFrame, tag: str, done: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"x{x}"))
    near = keep(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(_near, "a long, b long"), f"{tag}-near")
    ids = keep(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), f"{tag}-ids")
    some = sets.select("node", "s").join(_sent(ids), "node", "left_semi")
    both = near.join(some.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(some.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", "sa", "sb", F.size(F.array_intersect("sa", "sb")).alias("i"))
    links = keep(both.where("100 * i >= 80 * (size(sa) + size(sb) - i)").select("a", "b").distinct(), f"{tag}-links")
    done += [near, ids, links]
    return links


def _of(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the components ca and cb of their ends."""
    comp = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return pairs.join(comp("a"), "a", "left").join(comp("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def _joined(found: DataFrame, links: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Components after more links: those of the graph whose nodes are the components so far."""
    over = keep(connected_components(_of(found, links).select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "over")
    higher = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = found.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    found = keep(known.union(over.join(found, "node", "left_anti")), "components")
    done += [over, found]
    return found


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, part, v, c, n, carried, lowest), sorted by key, i and j, to the pairs (a, b) of different components
    whose sketches don't rule a link out: between the blocks i and j of a key, or within i where they are equal.  A pair
    that is seen to share a lower key is left to that."""
    held: list[tuple] = []
    found: set[tuple[int, int]] = set()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
            if held and held[0][:3] != row[:3]:
                found.update(_block_pairs(held))
                held = []
            held.append(row)
        if len(found) > 50_000:
            yield _pair_batch(found)
            found = set()
    if held:
        found.update(_block_pairs(held))
    yield _pair_batch(found)


def _pair_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], type=pa.int64()) for k in (0, 1)], names=["a", "b"])


def _folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, dtype=np.uint64)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _block_pairs(rows: list[tuple]) -> list[tuple[int, int]]:
    i, j = rows[0][1:3]
    if all(r[5] == rows[0][5] for r in rows):
        return []
    size = min(len(r[7]) for r in rows) // 8
    x = np.stack([_folded(r[7], size) for r in rows])
    part, v, c, n = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6))
    key, lower = rows[0][0], [frozenset(r[8]) for r in rows]
    out: list[tuple[int, int]] = []
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    for at in range(0, len(left), 64):
        a = left[at : at + 64, None]
        ok = (c[a] != c[right]) & (5 * np.minimum(n[a], n[right]) >= 4 * np.maximum(n[a], n[right]))
        if i == j:
            ok &= a < right
        p, q = np.nonzero(ok)
        p, q = a[p, 0], right[q]
        near = 9 * np.bitwise_count(x[p] ^ x[q]).sum(1, dtype=np.int64) <= n[p] + n[q]
        for x1, x2 in zip(p[near].tolist(), q[near].tolist(), strict=True):
            if min(lower[x1] & lower[x2], default=key) >= key:
                out.append((min(rows[x1][4], rows[x2][4]), max(rows[x1][4], rows[x2][4])))
    return out


def _across(chains: DataFrame, found: DataFrame, sets: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Pairs of different components under one key that the sketches don't rule out.

    A key of two members has none but the pair that was verified as neighbours, so it is left out.
    """
    tagged = _of(found, chains)
    member = tagged.select("key", F.col("a").alias("v"), F.col("ca").alias("c")).union(tagged.select("key", "b", "cb")).distinct()
    size = member.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    mixed = keep(size.where("size > 2 AND lo < hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "mixed")
    done.append(mixed)
    inside = chains.join(mixed, "key")
    member = inside.select("key", "parts", F.col("a").alias("v")).union(inside.select("key", "parts", "b")).distinct()
    member = keep(member, "members")
    done.append(member)
    lowest = member.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LOWEST).alias("lowest"))
    member = member.join(lowest, "v").join(found.select(F.col("node").alias("v"), F.col("component").alias("c")), "v", "left").join(
        sets.select(F.col("node").alias("v"), "n", "carried"), "v"
    )
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    dealt = member.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "v", F.coalesce("c", "v").alias("c"), "n", "carried", "lowest")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocked, "a long, b long").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the least id reachable by links.

    Two documents link when 100 * |A and B| >= 80 * |A or B| over their distinct 5-word shingles, words lower-cased
    in A-Z.  A null or empty text has no shingles and its own id as component; fewer than five words are one
    shingle.  Rows with a null id get the component of equal texts that have ids, else null.  Repeated rows each
    get a row, and rows of one id with different texts are documents of their own.  Equal sets are one node, so copies
    are never paired.  An empty table gives no rows.

    A node is a number that stands for one set.  First, each node is verified against the earlier one with which it
    shares most neighbourhoods; then all other neighbours of different components; then what `_across` leaves.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done: list[DataFrame] = []
    full = keep(docs.mapInArrow(_sketched(common_shingles(docs)), _ROW_SQL), "sketched")
    rows = full.select("doc_id", "n_shingles", "d1", "d2")
    new_sets = full.where("nth IS NOT NULL")
    met = _met(new_sets.select(F.explode("keys").alias("key"), "nth"), done)
    named = full.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = keep(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min("nth").alias("node")), "least")
    copies = new_sets.select("nth", "d1", "d2").join(least, ["d1", "d2"]).where("node < nth").select(F.col("nth").alias("node"), F.col("node").alias("component"))
    copies = keep(copies, "copies")
    chains = keep(_of(copies, met).where("ca <> cb").select("key", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), "chains")
    pairs = keep(chains.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = keep(least.join(some, "node").select(F.col("first").alias("doc_id"), "node", "d1", "d2"), "wanted")
    texts = docs.join(_sent(wanted), "doc_id").select("text", "node", "d1", "d2")
    sets = keep(texts.mapInArrow(_sets, _SET_SQL), "sets")
    done += [full, least, copies, chains, pairs, wanted, sets]
    if sets.count() > wanted.count():  # rows repeated as a whole
        sets = keep(sets.dropDuplicates(["node"]), "sets")
        done.append(sets)
    found = docs.sparkSession.createDataFrame([], "node long, component long")
    for tag in ("best", "chain", "across"):
        if tag == "best":
            left = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
        elif tag == "chain":
            left = _of(found, pairs).where("ca <> cb").select("a", "b")
        else:
            left = _across(chains, found, sets, done)
        links = _verified(left, sets, tag, done)
        if links.head(1):
            found = _joined(found, links, done)
    grouped = least.join(found, "node")
    lowest = grouped.groupBy("component").agg(F.min("first").alias("least_id"))
    grouped = grouped.join(lowest, "component").select("d1", "d2", "least_id")
    final = least.select("d1", "d2", "first").join(grouped, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least_id", "first").alias("component"))
    out = rows.join(final, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = keep(out, "near-components")
    discard(docs.sparkSession, *done)
    return out


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest id.

    Rows that share an id are one document and leave one row, that of the least text (null first).  Rows without an id
    leave one row a text, unless a row with an id has that text.  Columns of any name are kept as they are.
    """
    found = near_components(docs, id_col, text_col)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = keep(first, "firsts")
    named = _sent(ids).select("doc_id")
    out = docs.join(named, docs[id_col] == named["doc_id"], "left_semi")
    repeated = ids.where("n > 1").select("doc_id")
    if repeated.head(1):
        row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
        key = F.struct(docs[text_col].isNotNull(), docs[text_col])
        many = out.join(repeated, out[id_col] == repeated["doc_id"], "left_semi")
        one = many.groupBy(docs[id_col]).agg(F.min_by(row, key).alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)])
        out = out.join(repeated, out[id_col] == repeated["doc_id"], "left_anti").unionByName(one)
    if found.where("doc_id IS NULL AND component_id IS NULL").head(1):
        alone = docs.where(docs[id_col].isNull()).dropDuplicates([text_col])
        texts = docs.where(docs[id_col].isNotNull()).select(F.col(text_col).alias("text")).distinct()
        out = out.unionByName(alone.join(texts, alone[text_col] == texts["text"], "left_anti"))
    return out
