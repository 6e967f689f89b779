"""Language by compression: a text's language is the one whose dictionary compresses it best.

A language's dictionary is raw content: DICT_BYTES bytes, in equal parts from about 2 * SAMPLE_DOCS documents of that
language (a fixed bound), chosen by a hash of id and text.  A part is an excerpt of at most EXCERPT bytes that starts at
a place hashed from its text.  A text keeps its letters only, lower-cased, is cut
into pieces of PIECE bytes and each piece is compressed by zstandard with each dictionary; the language with the
smallest sum wins, ties going to the smaller code.  A margin below min_margin of the runner-up's size is a rejection.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import encoded

DICT_BYTES, SAMPLE_DOCS, EXCERPT, PIECE, LEVEL, MAX_LANGS = 65_536, 200, 2_000, 8_192, 6, 200
UNKNOWN = "und"
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """The text's lower-case letters, its other parts being single spaces."""
    return b" ".join(encoded(text.lower() if text else None).translate(_LETTERS).split())


def excerpt(data: bytes) -> bytes:
    """EXCERPT bytes from the first word after a place hashed from the data, or all of shorter data."""
    room = len(data) - EXCERPT
    if room <= 0:
        return data
    at = zlib.crc32(data) % (room + 1)
    space = data.find(b" ", at, room) if at else -1  # no later than a whole excerpt fits
    return data[space + 1 if space >= 0 else at :][:EXCERPT]


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = [excerpt(letters(t)) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, type=pa.binary())], names=["lang", "h", "part"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Each language's dictionary, from rows that have a text and a language.

    Rows equal in id and text count once; a language whose letters come to fewer than 8 bytes has no dictionary and is
    never predicted; no rows give an empty model; more than MAX_LANGS languages are an error.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not rows:
        return {}
    rate = F.create_map(*[x for r in rows for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * SAMPLE_DOCS / r["n"])))])
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7))
    drawn = known.where(F.pmod(h, F.lit(1_000_000)) < 1_000_000 * rate[F.col(lang_col)])
    parts: dict[str, list[tuple[int, bytes]]] = {}
    cut = drawn.select(F.col(lang_col), h, text_col).mapInArrow(_excerpts, "lang string, h long, part binary")
    for r in cut.distinct().collect():
        parts.setdefault(r.lang, []).append((r.h, bytes(r.part)))
    out = {}
    for lang in sorted(parts):
        texts = list(dict.fromkeys(p for _, p in sorted(parts[lang]) if p))  # a copy adds nothing
        out[lang] = _shared_out(texts)
    return {k: v for k, v in out.items() if len(v) >= 8}


def _shared_out(texts: list[bytes]) -> bytes:
    """DICT_BYTES dealt evenly to texts, in their order; what shorter ones leave goes to the others."""
    room, share = DICT_BYTES, {}
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share[i] = min(len(texts[i]) + 1, room // (len(texts) - k))
        room -= share[i]
    return b" ".join(t[: max(0, share[i] - 1)] for i, t in enumerate(texts))


@functools.cache
def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False)


def sizes(data: bytes, model: dict[str, bytes], level: int = LEVEL) -> np.ndarray:
    """Compressed bytes with each dictionary."""
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return np.array([sum(len(x) for x in map(_coder(d, level).compress, pieces)) for d in model.values()], dtype=np.int64)


def decide(text: str | None, model: dict[str, bytes], min_margin: float) -> tuple[str, float, bool]:
    """(language, score, accepted); the score is 1 for a clear case and 1 / languages for a tie of all."""
    if not text or not model or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, False
    n = sizes(letters(text), model)
    best = int(n.argmin())
    score = 1 / np.exp((n[best] - n) / 8.0).sum()
    rest = np.delete(n, best)
    return list(model)[best], float(score), not len(rest) or bool(rest.min() - n[best] >= min_margin * rest.min())


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01, also: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row, and the columns in also.

    lang_pred is the nearest language even where the margin is too narrow; accepted is false then.  A null, empty or
    letterless text is `und`, score 0, not accepted; so is every text if the model has no language.  Repeated rows get
    the same answers; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score, ok = zip(*(decide(t, model, min_margin) for t in part.column(0).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang), pa.array(score), pa.array(ok)], names=[*part.schema.names[1:], "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"), *also)
    out = rows.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}).schema
    return rows.mapInArrow(run, out)
