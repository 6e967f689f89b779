"""SentencePiece encoding with each piece's place in the original text, and decoding.

A text is normalised here, by the longest prefix that the model's compiled character map holds, and every normalised byte
keeps the source byte it came from.  The normalised text is cut where no piece of the vocabulary can reach across, each
distinct stretch is segmented once by the library (with the model's own normaliser taken out), and the ends of the pieces
are projected through the kept places to spans of original bytes.

Defined cases: a null or empty text has no pieces, only the begin and end ids; other columns are left out; repeated rows
and null ids are rows like any other; an empty table gives no rows; a text is never cut.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SPACE = "▁"  # stands for a space in pieces
_MARK = SPACE.encode()
#: Result bytes of one Arrow batch, about.
BATCH_BYTES = 8 << 20
#: Texts that are worked on together.
SLICE = 64


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, raw bytes) of each field of a protocol buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        began, tag = at, number()
        if tag & 7 == 0:
            value: int | bytes = number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            value = message[at : at + size]
            at += size
        yield tag >> 3, value, message[began:at]


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 keys whose values point at their replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        """The node below `node` along a byte, and its unit."""
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        if unit & 0x800000FF != byte:
            return None
        return at ^ self._offset(unit), unit

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 512 else 0)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data holds from `at` on."""
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            below = self._step(node, data[i])
            if below is None:
                break
            node, unit = below
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def first_chars(self) -> str:
        """The characters that keys start with."""
        found = []
        todo = [(self._offset(self.units[0]), b"")]
        while todo:
            node, head = todo.pop()
            for byte in range(128, 192) if head else range(1, 256):
                if below := self._step(node, byte):
                    more = head + bytes([byte])
                    lead = more[0]
                    if len(more) == 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0):
                        found.append(more.decode())
                    else:
                        todo.append((below[0], more))
        return "".join(found)


class Normalizer:
    """What a model does to a text before it looks for pieces, with the source place of each byte."""

    def __init__(self, spec: bytes, symbols: list[str]) -> None:
        got = {n: v for n, v, _ in fields(spec)}
        blob = got.get(2, b"")
        self.map = CharMap(blob) if blob else None
        self.dummy, self.squeeze, self.escape = (bool(got.get(n, 1)) for n in (3, 4, 5))
        ways = [re.escape(s) for s in sorted(symbols, key=len, reverse=True)]
        self.n_symbols = len(ways)
        if self.map and (firsts := self.map.first_chars()):
            ways.append("[" + re.escape(firsts) + "]")
        #: Where a symbol stands, which is taken as it is, or where a key may start; all else stays.
        self.special = re.compile("(" + "|".join(ways[: self.n_symbols] or [r"(?!)"]) + ")|" + "|".join(ways[self.n_symbols :] or [r"(?!)"])) if ways else None

    def _mapped(self, text: str, data: bytes) -> tuple[bytes, np.ndarray]:
        """data after the character map, and each byte's source byte."""
        if self.special is None:
            return data, np.arange(len(data), dtype=np.int64)
        out, places, char, done, at = [], [], 0, 0, 0  # data up to `done` is written; characters up to `char` end at byte `at`
        while hit := self.special.search(text, char):
            at += len(text[char : hit.start()].encode("utf-8", "replace"))
            char = hit.start()
            if hit.group(1) is not None:
                size, new = len(hit.group().encode()), None
            else:
                key = self.map.longest(data, at) if self.map else None
                size, new = key if key else (len(hit.group().encode()), None)
            if new is not None:
                out += [data[done:at], new]
                places += [np.arange(done, at), np.full(len(new), at)]
                done = at + size
            char += len(data[at : at + size].decode())
            at += size
        out.append(data[done:])
        places.append(np.arange(done, len(data)))
        return b"".join(out), np.concatenate(places).astype(np.int64)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text as UTF-8 and, for each of its bytes and its end, the source byte.

        Where spaces are squeezed, a space after a space goes, one inside a replacement too.
        """
        source = text.encode("utf-8", "replace")
        data, place = self._mapped(text, source)
        end = len(source)
        raw = np.frombuffer(data, dtype=np.uint8)
        if self.squeeze:
            space = raw == 32
            stay = ~(space & np.r_[True, space[:-1]])
            last = int(np.flatnonzero(~space)[-1]) + 1 if not space.all() else 0
            if last < len(raw):
                end = int(place[last])
            stay[last:] = False
            raw, place = raw[stay], place[stay]
            data = raw.tobytes()
        if not len(raw):
            return b"", np.array([end])
        head = int(place[0]) if self.squeeze else 0
        mark = _MARK if self.escape else b" "
        if self.escape:
            place = np.repeat(place, np.where(raw == 32, len(mark), 1))
            data = data.replace(b" ", mark)
        if self.dummy:
            data, place = mark + data, np.concatenate([np.full(len(mark), head), place])
        return data, np.append(place, end)


class PieceModel:
    """A sentencepiece model file: encoding to ids and spans of original bytes, and decoding.

    A worker keeps the stretches that it has segmented for its next tasks, at most about cache_bytes of them.
    """

    ENTRY_BYTES = 200
    _by_path: dict[str, PieceModel] = {}

    def __init__(self, path: str, cache_bytes: int = 96 << 20) -> None:
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        self._load(model)
        self.whole = SentencePieceProcessor(model_proto=model)
        self.bos, self.eos = self.whole.bos_id(), self.whole.eos_id()
        self.cache_bytes = cache_bytes
        self._forget()

    def _load(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        parts = list(fields(model))
        spec = b"".join(v for n, v, _ in parts if n == 3)
        pieces = [{n: v for n, v, _ in fields(p)} for k, p, _ in parts if k == 1]
        trainer = {n: v for k, p, _ in parts if k == 2 for n, v, _ in fields(p)}
        if trainer.get(24):
            raise ValueError("models with white space as a suffix are not read")
        texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.normalizer = Normalizer(spec, [t for t, k in zip(texts, kinds, strict=True) if k == 4])
        #: The model without a normaliser: it segments what is already normalised.
        plain = b"\x0a\x08identity" + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0])  # no added, no squeezed and no escaped spaces
        others = b"".join(raw for n, _, raw in parts if n != 3)
        self.bare = SentencePieceProcessor(model_proto=others + bytes([3 << 3 | 2, len(plain)]) + plain)
        self.unknown = kinds.index(2)
        #: A piece's bytes, none for byte pieces, and for a byte piece that starts a character that character's bytes.
        self.sizes = np.array([0 if k == 6 else len(t.encode()) for t, k in zip(texts, kinds, strict=True)])
        first = [int(t[3:5], 16) if k == 6 else 128 for t, k in zip(texts, kinds, strict=True)]
        self.byte_chars = np.array([0 if 128 <= b < 192 else 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0) for b in first])
        words = [t for t, k in zip(texts, kinds, strict=True) if k in (1, 4, 5)]
        # merging or the best path inside a stretch doesn't see its neighbours if no piece reaches across
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in words)
        lines = kinds.count(6) == 256 and not any("\n" in t for t in words)
        bpe = trainer.get(3, 1) == 2
        if crossing or not bpe:
            self.stretches: Callable[[str], list[str]] = lambda text: [text] if text else []
        else:
            self.stretches = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    @classmethod
    def of(cls, path: str, cache_bytes: int = 96 << 20) -> PieceModel:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path, cache_bytes)
        return cls._by_path[path]

    def _forget(self) -> None:
        #: A stretch's number, given at its first sight; `starts` and `counts` give its part of `ids` and `lengths`.
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.starts = self.counts = self.ids = self.lengths = np.zeros(0, dtype=np.int64)
        self.held = 0

    def _learn(self, new: list[str]) -> None:
        """Ids and lengths in normalised bytes of the pieces of stretches; of a character's byte pieces the last has its length."""
        found = self.bare.encode(new, num_threads=1)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum()))
        sizes = self.sizes[ids]
        leads = np.flatnonzero(self.byte_chars[ids])
        wide = self.byte_chars[ids[leads]]
        sizes[leads + wide - 1] = wide
        starts = np.cumsum(counts) - counts
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(ids == self.unknown), side="right") - 1):  # of no fixed length
            ends = [e for _, e in self.bare.encode(new[i].encode(), return_type="offset_mapping", return_bytes=True)["offsets"]]
            sizes[starts[i] : starts[i] + counts[i]] = np.diff(ends, prepend=0)
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, sizes])
        self.held += self.ENTRY_BYTES * len(new) + 2 * sum(map(len, new)) + 16 * len(ids)

    def encode(self, texts: list[str | None], spans: bool = True) -> list[tuple[bytes, bytes | None]]:
        """For each text its ids, begin and end ids around them, and (begin, end) source bytes of each, both as
        little-endian unsigned 32-bit numbers."""
        if self.held > self.cache_bytes:
            self._forget()
        normal = [self.normalizer(t or "") for t in texts]
        cut = [self.stretches(n.decode()) for n, _ in normal]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        if more := len(self.known) - len(self.counts):
            self._learn(list(islice(reversed(self.known), more))[::-1])
        counts = self.counts[at]
        upto = np.cumsum(counts)
        flat = np.repeat(self.starts[at] - upto + counts, counts) + np.arange(int(counts.sum()))
        ids, lengths = self.ids[flat].astype("<u4"), self.lengths[flat]
        parts = np.cumsum([0, *map(len, cut)])
        bounds = np.concatenate([[0], upto])[parts].tolist()
        out = []
        for (_, place), lo, hi in zip(normal, bounds[:-1], bounds[1:], strict=True):
            mine = np.concatenate([[self.bos], ids[lo:hi], [self.eos]]).astype("<u4").tobytes()
            if spans:
                span = np.zeros((hi - lo + 2, 2), dtype="<u4")
                span[1:-1, 1] = place[np.cumsum(lengths[lo:hi])]
                span[0], span[-1] = place[0], place[-1]
                span[1:-1, 0] = span[:-2, 1]
                out.append((mine, span.tobytes()))
            else:
                out.append((mine, None))
        return out

    def decode(self, ids: list[bytes | None]) -> list[str | None]:
        """The texts of ids (little-endian unsigned 32-bit), as the library decodes them; null stays null."""
        some = [np.frombuffer(i, dtype="<u4").tolist() for i in ids if i is not None]
        found = iter(self.whole.decode(some, num_threads=1) if some else [])
        return [None if i is None else next(found) for i in ids]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("spans", pa.binary())])


def _encoder(path: str, spans: bool, cache_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(path, cache_bytes)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for at in range(0, batch.num_rows, SLICE):
                doc_ids, texts = (batch.column(c).slice(at, SLICE).to_pylist() for c in (0, 1))
                for doc_id, (ids, where) in zip(doc_ids, model.encode(texts, spans), strict=True):
                    rows.append((doc_id, len(ids) // 4, ids, where))
                    size += 3 * len(ids)
                if rows and (size > BATCH_BYTES or at + SLICE >= batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ENCODED, strict=True)], schema=_ENCODED)
                    rows, size = [], 0
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, cache_bytes: int = 96 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids, spans) of every row: ids with begin and end ids, and each one's (begin, end) bytes in the
    UTF-8 source, both as little-endian unsigned 32-bit numbers.

    As in the library, a character in byte pieces belongs to the last of them, and added spaces have no width.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _encoder(model, spans, cache_bytes), "doc_id long, n_tokens long, ids binary, spans binary"
    )


def decoded(ids: Column, model: str) -> Column:
    """The text of a column of ids as encode() gives them; null stays null."""

    @pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        known, out = PieceModel.of(model), []
        for at in range(0, len(column), SLICE):
            out += known.decode([None if i is None else bytes(i) for i in column.iloc[at : at + SLICE]])
        return pd.Series(out, dtype=object)

    return run(ids)


def numbers(packed: Column) -> Column:
    """A column of little-endian unsigned 32-bit numbers as an array of bigint."""

    @pandas_udf("array<long>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, dtype="<u4").astype(np.int64) for b in column], dtype=object)

    return run(packed)
