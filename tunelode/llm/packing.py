"""Best-fit packing by minimum bin slack.

A sequence is planned around the longest piece left: a bitset subset-sum over the other lengths finds the fullest
combination that fits, which is then removed.  Only how many pieces there are of each length matters, so the plan is
made from a histogram of at most `capacity` numbers whatever the corpus size, and one combination is used as often as
the counts allow.  Pieces find their place by their number among the pieces of their length, which two-level counts
give without gathering a length in one task.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import keep
from .words import encoded

#: Chunks that go through the library as they are: a start of an added token, separators that are white space in
#: Python only, and letters that the two lower differently.
_ODD = regex.compile(r"<\||[\x1c-\x1f]|\u03a3|\u0130")


def _letters(p: str) -> bool:
    """Whether p is one run of Latin letters, which every release of Unicode calls letters."""
    return p.isalpha() and (p.isascii() or max(p) < "\u0250")


class WordTokenizer:
    """The ids of a tokenizers file whose words end in a '</w>' token, with each word's ids kept.

    White space always ends a word there, so a text is cut at ASCII white space, each distinct chunk is tokenized
    once, and a text's ids are its chunks' ids in turn.

    Chunks and words live as long as the worker, in two generations of about half of cache_bytes: what is used again
    moves to the young one, and when that is full the old one goes.
    """

    #: Of an entry: two objects and its place in a table.
    ENTRY_BYTES = 200
    _by_path: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, cache_bytes: int = 96 << 20) -> None:
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.pre_tokenizer.__getstate__())  # not the whole file, which has the vocabulary
        self.pattern = regex.compile(spec["pretokenizers"][0]["pattern"]["Regex"])
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old: tuple[dict[bytes, bytes], dict[str, bytes]] = {}, {}
        self.cache_bytes, self.held = cache_bytes, 0

    @classmethod
    def of(cls, path: str, cache_bytes: int = 96 << 20) -> WordTokenizer:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path, cache_bytes)
        cls._by_path[path].cache_bytes = cache_bytes
        return cls._by_path[path]

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        joined = b" ".join(new).decode()
        if _ODD.search(joined):
            odd = {c for c in new if _ODD.search(c.decode())}
            self.chunks.update((c, self._plain(c.decode())) for c in odd)
            new = [c for c in new if c not in odd]
            joined = b" ".join(new).decode()
        lowered = (joined.lower() if joined.isascii() else unicodedata.normalize("NFC", joined).lower()).split(" ")
        parts = {p: [p[:-1], p[-1]] if p[-1] in ".,;:!?" and _letters(p[:-1]) else self.pattern.findall(p) for p in lowered if not _letters(p)}
        whole = [p for p in lowered if p not in parts]
        words = self._missing({*whole, *(w for p in parts.values() for w in p)}, self.words, self.old[1])
        ids = np.frombuffer(self._plain(" ".join(words)), dtype="<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) == len(words):
            data, ends = ids.tobytes(), ends.tolist()
            self.words.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        else:
            self.words.update((w, self._plain(w)) for w in words)
        of = self.words.__getitem__
        parts = {p: b"".join(map(of, ws)) for p, ws in parts.items()}
        self.chunks.update((c, parts[p] if p in parts else of(p)) for c, p in zip(new, lowered, strict=False))
        self.held += self.ENTRY_BYTES * (len(new) + len(words)) + 2 * len(joined)

    def _missing(self, keys: set, young: dict, old: dict) -> list:
        """The keys that neither generation has; those of the old one move to the young one."""
        keys = keys.difference(young)
        known = keys.intersection(old)
        young.update((k, old.pop(k)) for k in known)
        self.held += self.ENTRY_BYTES * len(known)
        return list(keys - known)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if self.held > self.cache_bytes // 2:
            self.old, self.chunks, self.words, self.held = (self.chunks, self.words), {}, {}, 0
        cut = [encoded(t).split() for t in texts]
        if new := self._missing(set().union(*cut), self.chunks, self.old[0]):
            self._learn(new)
        of = self.chunks.__getitem__
        return [b"".join(map(of, c)) for c in cut]


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("part", pa.int32()), ("nth", pa.int64()),
])


def _cutter(path: str, capacity: int, end_id: int, with_ids: bool, cache_bytes: int, keep_words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([*_PIECES, ("ids", pa.list_(pa.int32()))]) if with_ids else _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen = WordTokenizer.of(path, cache_bytes), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                doc_ids, texts = (batch.column(c).slice(at, 256).to_pylist() for c in (0, 1))
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids, tok.ids(texts), strict=True):
                    data = ids + end
                    for piece, lo in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[lo : lo + 4 * capacity]
                        n = len(cut) // 4
                        rows.append((doc_id, piece, lo // 4, n, zlib.crc32(cut), part, int(seen[n]), *([np.frombuffer(cut, dtype="<i4")] if with_ids else [])))
                        seen[n] += 1
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        if not keep_words:  # Python workers outlive their tasks
            del tok
            WordTokenizer._by_path.clear()
        pa.default_memory_pool().release_unused()

    return run


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths, with how often each, whose sum is the largest that fits in room: a bitset subset-sum."""
    full = 1 << room
    mask = (full << 1) - 1
    reach, steps = 1, []
    for x in range(min(room, len(counts) - 1), 0, -1):
        for _ in range(min(int(counts[x]), room // x)):
            new = (reach | reach << x) & mask
            if new == reach:
                break
            steps.append((x, reach))
            reach = new
            if reach & full:
                break
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for x, before in reversed(steps):
        if not before >> at & 1:  # only with this piece
            used[x] = used.get(x, 0) + 1
            at -= x
    return used


def plan(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Rows (length, first, each, sequence, offset): from piece number `first` of a length on, `each` pieces go into
    every sequence from `sequence` on, the first at `offset`."""
    left = counts.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows, sequence, top = [], 0, capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            break
        left[top] -= 1
        bin_ = fullest(left, capacity - top)
        left[top] += 1
        bin_[top] = bin_.get(top, 0) + 1
        times = min(int(left[x]) // k for x, k in bin_.items())
        offset = 0
        for x, k in sorted(bin_.items(), reverse=True):
            rows.append((x, int(used[x]), k, sequence, offset))
            used[x] += times * k
            left[x] -= times * k
            offset += x * k
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"])


def _placer(table: pd.DataFrame) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    length, first, each, sequence, offset = (table[c].to_numpy(dtype=np.int64) for c in table.columns)
    key = (length << 48) + first

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            n, number = p.length.to_numpy(), p.number.to_numpy()
            i = np.searchsorted(key, (n << 48) + number, side="right") - 1
            k = number - first[i]
            yield p.drop(columns="number").assign(sequence_id=sequence[i] + k // each[i], offset=offset[i] + k % each[i] * n)

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    cache_bytes: int = 96 << 20, keep_words: bool = True,
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then end_id, so a null or empty text is one piece of one id.  Only documents longer
    than capacity are cut.  with_ids adds the ids themselves; a Python worker keeps at most about cache_bytes of words'
    ids for its next tasks, besides those of one batch, and nothing without keep_words.  Null ids stay null; repeated rows are packed again;
    an empty table gives no rows; other columns are left out.
    """
    kind = ", ids array<int>" * with_ids
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _cutter(tokenizer, capacity, end_id, with_ids, cache_bytes, keep_words),
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + kind,
    )
    pieces = keep(cut, "pieces")
    counts = keep(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r.length] = r.n
    numbered = pieces.join(base, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("base") + F.col("nth")).alias("number")
    )
    return numbered.mapInPandas(
        _placer(plan(hist, capacity)),
        f"doc_id long, piece int, start long, length long, ids_crc32 long{kind}, sequence_id long, offset long",
    )
