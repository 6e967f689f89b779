"""Listings in JSON pages that name their next page, as a Spark data source.

A listing is followed from its first page by `next` until there is none, or until the listing's cap of items, counted as
they come, wrong ones too.  That is one page after the other by nature, so tasks take whole listings.  A page is a JSON
object in a file, or in a folder whose files together are its text; `next` may be relative to its page.  Many small pages
can be lines of one such text, a bundle: `bundle#name` is the line whose `key` is the name.

    spark.dataSource.register(PagedLibrary)
    spark.read.format("paged_library").option("path", folder).load()

`path` holds `index`, a folder or file of JSON lines with the listings: url (relative to `path` or not), kind, source,
user_id, max_items.  The driver reads the index, which takes some hundred bytes a listing; a table of listings of any
length goes through `follow` instead, which reads in the tasks that hold the listings.

Kinds: `liked` and `playlist` items hold a track under `track` or else `item`; `top` items are tracks; `playlists` items are
playlists, at most 200 of them.  Items without an id go, from playlists also those that are local.

A page that is missing, is no JSON object, or has come before ends its listing: with an error, or in mode PERMISSIVE with a
row that says why in `error`.  A page without items is followed like any other.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .listing import place

#: The most playlists that are read of a user.
CAPS = {"playlists": 200}
KINDS = ("liked", "top", "playlist", "playlists")
SCHEMA = (
    "user_id long, source string, kind string, listing string, page int, place long, item_id string, title string, artist string, album string, "
    "duration_ms long, isrc string, artwork_url string, preview_url string, total long, error string"
)
LISTING = "url string, kind string, source string, user_id long, max_items long"


class BrokenPage(ValueError):
    pass


def read_text(url: str) -> str:
    """A file, or all files of a folder by name, from any file system that Arrow knows; a bare path is a local one."""
    from pyarrow import fs

    system, path = place(url)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        files = sorted(i.path for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and not i.base_name.startswith(("_", ".")))
    else:
        files = [path]
    texts = []
    for f in files:
        with system.open_input_stream(f) as stream:
            texts.append(stream.read().decode())
    return "".join(texts)


def resolved(base: str, url: str) -> str:
    """url as seen from a page; file systems that urllib has no rule for are joined like paths."""
    url, name = urldefrag(url)
    base = urldefrag(base).url
    return (_joined(base, url) if url else base) + (f"#{name}" if name else "")


def _joined(base: str, url: str) -> str:
    if urlsplit(url).scheme or url.startswith("/") and not urlsplit(base).scheme:
        return url
    parts = urlsplit(base)
    if not parts.scheme:
        return posixpath.normpath(posixpath.join(posixpath.dirname(base), url))
    return parts._replace(path=urlsplit(urljoin(f"file://{parts.path}", url)).path).geturl()


@lru_cache(maxsize=1)  # listings of a bundle are read one after the other
def bundle(url: str) -> dict[str, dict]:
    """The pages of a bundle by their keys."""
    return {page["key"]: page for page in map(json.loads, read_text(url).splitlines())}


def page_of(url: str) -> dict:
    whole, name = urldefrag(url)
    try:
        page = bundle(whole)[name] if name else json.loads(read_text(whole))
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise BrokenPage(f"{url}: {type(e).__name__}: {e}") from e
    if not isinstance(page, dict):
        raise BrokenPage(f"{url}: no JSON object")
    return page


def items(url: str, max_items: int | None) -> Iterator[tuple[int, int, object]]:
    """(page, place, item) of a listing in its order."""
    place, page, seen = 0, 0, set()
    while url and (max_items is None or place < max_items):
        if url in seen:
            raise BrokenPage(f"{url}: has come before")
        seen.add(url)
        data = page_of(url)
        for item in data.get("items") or []:
            yield page, place, item
            place += 1
            if max_items is not None and place >= max_items:
                return
        url, page = data.get("next") and resolved(url, data["next"]), page + 1


def _part(value: object, *path: str | int) -> object:
    """The value at a path of names and places, or None where there is none."""
    for p in path:
        if isinstance(p, int):
            value = value[p] if isinstance(value, list) and len(value) > p else None
        else:
            value = value.get(p) if isinstance(value, dict) else None
    return value


def _whole(value: object) -> int | None:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def track_of(item: object, kind: str) -> dict | None:
    """The track, or playlist, of an item; None if there is none that counts."""
    if kind in ("top", "playlists"):
        found = item
    else:
        found = next((t for t in (_part(item, "track"), _part(item, "item")) if isinstance(t, dict)), None)
    if not isinstance(found, dict) or not found.get("id") or kind == "playlist" and found.get("is_local"):
        return None
    return found


def rows(listing: dict, mode: str = "FAILFAST") -> Iterator[tuple]:
    """A listing's rows in SCHEMA."""
    kind = listing["kind"]
    if kind not in KINDS:
        raise ValueError(f"unknown kind of listing: {kind}")
    cap = min((c for c in (listing.get("max_items"), CAPS.get(kind)) if c is not None), default=None)
    head = listing.get("user_id"), listing.get("source"), kind, listing["url"]
    try:
        for page, place, item in items(listing["url"], cap):
            t = track_of(item, kind)
            if t is not None:
                yield (
                    *head, page, place, str(t["id"]), _text(t.get("name")), _text(_part(t, "artists", 0, "name")), _text(_part(t, "album", "name")), _whole(t.get("duration_ms")),
                    _text(_part(t, "external_ids", "isrc")), _text(_part(t, "album", "images", 0, "url")), _text(t.get("preview_url")), _whole(_part(t, "tracks", "total")), None,
                )
    except BrokenPage as e:
        if mode.upper() != "PERMISSIVE":
            raise
        yield (*head, *[None] * 11, str(e))


class _Listings(InputPartition):
    def __init__(self, listings: list[dict]) -> None:
        self.listings = listings


class PagedLibrary(DataSource):
    """Options: path, mode (FAILFAST or PERMISSIVE), listings (of a partition, 1), max_items (a cap besides the index's)."""

    @classmethod
    def name(cls) -> str:
        return "paged_library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.mode = options["path"].rstrip("/"), options.get("mode", "FAILFAST")
        self.each = max(1, int(options.get("listings", 1)))
        self.cap = int(options["max_items"]) if "max_items" in options else None

    def partitions(self) -> list[InputPartition]:
        found = [json.loads(line) for line in read_text(f"{self.root}/index").splitlines() if line.strip()]
        for x in found:
            x["url"] = resolved(f"{self.root}/index", x["url"])
            x["max_items"] = min((c for c in (x.get("max_items"), self.cap) if c is not None), default=None)
        return [_Listings(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [_Listings([])]

    def read(self, partition: _Listings) -> Iterator[tuple]:
        bundle.cache_clear()  # a worker outlives its tasks, and a bundle may be written anew
        for listing in partition.listings:
            yield from rows(listing, self.mode)


def follow(listings: DataFrame, mode: str = "FAILFAST", batch: int = 1000) -> DataFrame:
    """SCHEMA's rows of a table of listings (LISTING's columns), read by the tasks that hold them."""
    names = [f.name for f in StructType.fromDDL(SCHEMA)]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle.cache_clear()
        for pdf in pdfs:
            out: list[tuple] = []
            for listing in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                for row in rows(listing, mode):
                    out.append(row)
                    if len(out) == batch:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    return listings.select(*[f.name for f in StructType.fromDDL(LISTING)]).mapInPandas(run, SCHEMA)
