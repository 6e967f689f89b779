"""Nearest neighbours by an inverted file of coarse centroids with product-quantised residuals.

Fitting (on the driver, from a bounded sample): coarse centroids, and one codebook for each slice of the residuals.
The number of lists to probe is then measured: up to MEASURED of the queries themselves are compared with all vectors, by
tasks, and so many lists are probed that `target` of their true neighbours lie in them.
Indexing: every vector becomes its list, its code, how far the code is from it, and the vector's bytes.
Searching: every query goes to the lists that it probes.  A list is cut into cells of about CELL_ROWS codes and
QUERY_ROWS queries by counted numbers of parts, so a hot list is many cells, and codes and queries meet by list and
part.  In a cell, asymmetric distance tables score the codes; a code's distance from its vector bounds the vector's
cosine on both sides, so what can't be among the best k of the cell goes, and only that: near copies whose codes are equal
all stay.  Exact cosines of the rest give a cell's best k a query.  So what is missed lies in lists that aren't probed.  What
is shuffled grows with the vectors and with queries x probes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, keep

#: Vectors that the index is fitted on, at most; there is a list for PER_LIST of them, at most.
SAMPLE_ROWS, PER_LIST = 16_384, 16
#: Codes and queries of a cell, about (fewer codes of vectors longer than 256); queries that are scored at once; components
#: that are compared at once; and queries that are compared with all vectors, at most, to tell how many lists to probe.
CELL_ROWS, QUERY_ROWS, AT_ONCE, COMPARED, MEASURED = 8_192, 2_048, 256, 2_097_152, 256


@dataclass
class Index:
    centroids: np.ndarray  # lists x d
    books: np.ndarray  # slices x codes x width
    probes: int

    def lists(self, x: np.ndarray) -> np.ndarray:
        half = (self.centroids**2).sum(1) / 2
        return np.concatenate([(half - x[i : i + 2048] @ self.centroids.T).argmin(1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, distance of what list and code stand for) of each row."""
        at = self.lists(x)
        rest = x - self.centroids[at]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        off = np.zeros(len(x), dtype=np.float32)
        for j, (book, part) in enumerate(zip(self.books, self._slices(rest), strict=True)):
            codes[:, j] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            off += ((part - book[codes[:, j]]) ** 2).sum(1)
        return at, codes, np.sqrt(off)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """All lists, nearest first, for each row."""
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")

    def _slices(self, x: np.ndarray) -> list[np.ndarray]:
        width = self.books.shape[2]
        full = np.zeros((len(x), len(self.books) * width), dtype=np.float32)
        full[:, : x.shape[1]] = x
        return [full[:, j * width : (j + 1) * width] for j in range(len(self.books))]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: query x slice x code."""
        return np.stack([part @ book.T for book, part in zip(self.books, self._slices(q), strict=True)], axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        half = (c**2).sum(1) / 2
        at = np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(n)
        c[filled] = np.add.reduceat(x[order], (np.cumsum(n) - n)[filled], axis=0) / n[filled, None]
    return c


def fit(sample: np.ndarray, n_rows: int, width: int = 2, seed: int = 3) -> Index:
    """An index for n_rows unit vectors, from a sample of them; it probes all lists until it is told how many."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    lists = int(max(1, min(len(x) // PER_LIST, np.sqrt(n_rows))))
    index = Index(_kmeans(x, lists, 8, rng), np.zeros((0, 0, width), np.float32), lists)
    rest = x - index.centroids[index.lists(x)]
    slices = -(-x.shape[1] // width)
    index.books = np.zeros((slices, 1, width), np.float32)
    index.books = np.stack([_kmeans(np.ascontiguousarray(p), min(256, len(x)), 6, rng) for p in index._slices(rest)])
    return index


_CODE_SQL = "list int, vec_id long, code binary, off float, v binary"
_PROBE_SQL = "list int, query_id long, vector binary"
_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _raw(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: cosines stay, no square over- or underflows."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def _norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / _norm(v)[:, None]).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], type=pa.binary())


def _held(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The rows that _binary has packed."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _coder(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _raw(batch)
                at, codes, off = index.encode(_unit(_scaled(v)))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("vec_id"), _binary(codes), pa.array(off), _binary(v)], names=["list", "vec_id", "code", "off", "v"])

    return run


def _prober(index: Index, sizes: np.ndarray, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every query once for each list that it probes: index.probes, or more until they hold `least` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(lo, AT_ONCE)
                v = _raw(some)
                lists = index.order(_unit(_scaled(v)))
                before = np.cumsum(sizes[lists], axis=1) - sizes[lists]
                row, col = np.nonzero((np.arange(lists.shape[1]) < index.probes) | (before < least))
                columns = [pa.array(lists[row, col].astype(np.int32)), pa.array(some.column("vec_id").to_numpy()[row]), _binary(v[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "query_id", "vector"])

    return run


def _least_of_best(score: np.ndarray, n: int) -> np.ndarray:
    """The n-th greatest score of each row; -inf where there are fewer."""
    return np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n] if score.shape[1] >= n else np.full(len(score), -np.inf)


def _nearest(index: Index, asked: np.ndarray, v: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest of all the task's rows for each of some queries, and at which place of the query's lists each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _scaled(v)
        unit = q / _norm(q)[:, None]
        place = np.argsort(index.order(_unit(q)), axis=1)
        best, at = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                x, ids = _scaled(_raw(some)), some.column("vec_id").to_numpy()
                x /= _norm(x)[:, None]
                score = np.where(asked[:, None] == ids, -np.inf, unit @ x.T)
                both = np.concatenate([best, score], axis=1)
                lists = np.concatenate([at, np.take_along_axis(place, np.broadcast_to(index.lists(x.astype(np.float32)), score.shape), 1)], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best, at = np.take_along_axis(both, top, 1), np.take_along_axis(lists, top, 1)
        row, col = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at[row, col]), pa.array(best[row, col])], names=["row", "place", "score"])

    return run


def probes_for(rows: DataFrame, is_query: str, index: Index, k: int, target: float) -> int:
    """How many lists hold `target` of the true neighbours of up to MEASURED queries, drawn by a hash, among all rows."""
    some = rows.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(MEASURED).toArrow().combine_chunks()
    if not some.num_rows:
        return 1
    v = some.column("v").combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1)
    met = rows.mapInArrow(_nearest(index, some.column("vec_id").to_numpy(), v, k), "row long, place long, score double")
    nearest = met.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "place"))).where(F.col("n") <= k)
    need = np.sort(nearest.select("place").toArrow().column("place").to_numpy())  # k a query
    return int(need[min(len(need) - 1, int(target * len(need)))]) + 1 if len(need) else 1


def _without_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Positions of rows, by id, without all but the k + 1 least ids of equal vectors: no query has use for more."""
    same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    new = np.r_[True, (same[order][1:] != same[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
    order = order[new]
    first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    order = order[nth <= k]
    return order[np.argsort(ids[order], kind="stable")]


def _cell(index: Index, k: int, kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best vectors of a cell for each of its queries, by exact cosine; ties go to the smaller id."""

    def run(coded: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if coded.num_rows and asked.num_rows:
            ids, v = coded.column("vec_id").to_numpy(), _held(coded.column("v"), kind)
            order = _without_copies(ids, v, k)
            ids, v = ids[order], _scaled(v[order])
            norm = _norm(v)
            codes = _held(coded.column("code"), "u1")[order]
            # what float32 sums may be off comes on top
            off = coded.column("off").to_numpy()[order] * np.float32(1.001) + np.float32(1e-6 * (16 + codes.shape[1]))
            centre = index.centroids[coded.column("list")[0].as_py()]
            most = k * int(np.unique(ids, return_counts=True)[1].max())  # rows of one id count once
            for lo in range(0, asked.num_rows, AT_ONCE):
                part = asked.slice(lo, AT_ONCE)
                own, q = part.column("query_id").to_numpy(), _scaled(_held(part.column("vector"), kind))
                unit, q_norm = _unit(q), _norm(q)
                tables = np.ascontiguousarray(index.tables(unit).transpose(1, 2, 0))  # slice x code x query
                score = np.repeat((unit @ centre)[None], len(ids), axis=0)
                for j in range(codes.shape[1]):
                    score += tables[j][codes[:, j]]
                score = np.ascontiguousarray(score.T)
                score[own[:, None] == ids] = -np.inf
                maybe = (score + off >= _least_of_best(score - off, most)[:, None]) & (score > -np.inf)
                some = np.flatnonzero(maybe.any(0))
                close = np.where(maybe[:, some], (q / q_norm[:, None]) @ (v[some] / norm[some, None]).T, -np.inf)
                a, b = np.nonzero((close >= _least_of_best(close, most)[:, None] - 1e-11) & (close > -np.inf))
                b, step = some[b], max(1, COMPARED // v.shape[1])
                exact = np.concatenate([(v[b[i : i + step]] * q[a[i : i + step]]).sum(1) / (norm[b[i : i + step]] * q_norm[a[i : i + step]]) for i in range(0, max(len(a), 1), step)])
                by = np.lexsort((ids[b], -exact, a))
                a, b, exact = a[by], ids[b][by], exact[by]
                if most > k:  # the best of rows that share an id
                    _, at = np.unique(np.stack([a, b]), axis=1, return_index=True)
                    at.sort()
                    a, b, exact = a[at], b[at], exact[at]
                first = np.searchsorted(a, a)
                top = np.arange(len(a)) - first < k
                out.append((own[a[top]], b[top], exact[top]))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[c] for o in out]) if out else [], type=f.type) for c, f in enumerate(_NEAR)], schema=_NEAR)

    return run


def _dealt(rows: DataFrame, parts: DataFrame, mine: str, others: str, *salt: str) -> DataFrame:
    """rows in one part of their list, chosen by a hash, and copied to each part of the other side."""
    own = F.pmod(F.xxhash64(*salt), F.col(mine)).cast("int")
    copies = F.explode(F.expr(f"sequence(0, {others} - 1)"))
    return rows.join(F.broadcast(parts), "list").withColumn(f"{mine}_no", own).withColumn(f"{others}_no", copies).drop(mine, others)


def search(
    vectors: DataFrame, is_query: str, k: int = 5, target: float = 0.985, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine of each row for which is_query, SQL over vec_id,
    holds, among all other rows; ties go to the smaller id.

    Rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take no part;
    nor do vectors of another length than the most frequent one (of equal ones, the shortest).  Rows that share an id are candidates with
    one best score, and never of each other.  No usable row gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    usable = F.size("v") > 0
    usable &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    short = dict(vectors.dtypes)[vector_col] == "array<float>"  # vectors travel as they are, others as doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if short else "array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most, n = usual
    rows = rows.where(F.size("v") == most)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    index = fit(_unit(_scaled(sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, most))), n)
    index.probes = probes_for(rows, is_query, index, k, target)
    codes = keep(rows.mapInArrow(_coder(index), _CODE_SQL).withColumn("nth", F.monotonically_increasing_id()), "codes")
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for at, count in codes.groupBy("list").count().collect():  # a row a list
        sizes[at] = count
    probes = keep(rows.where(is_query).mapInArrow(_prober(index, sizes, 4 * k), _PROBE_SQL), "probes")
    in_parts = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    size = max(512, min(CELL_ROWS, COMPARED // most))
    parts = keep(in_parts(codes, size, "c").join(in_parts(probes, QUERY_ROWS, "q"), "list"), "parts")  # a row a list
    at = ("list", "c_no", "q_no")
    cells = _dealt(codes, parts, "c", "q", "nth").drop("nth").groupBy(*at).cogroup(_dealt(probes, parts, "q", "c", "query_id", "vector").groupBy(*at))
    near = cells.applyInArrow(_cell(index, k, "f4" if short else "f8"), "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = keep(best.select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(spark, codes, probes, parts)
    return out
