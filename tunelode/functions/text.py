"""Parsing of ids, lists, addresses and stamps, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How sure each source of an item's features is.
SOURCE_RANK = {"spotify_preview": 4, "itunes_isrc": 3, "itunes_term_search": 2, "unknown": 1}


def filled(x: Column) -> Column:
    """A text, NULL where it is ''; a number or boolean, NULL where it is 0 or false."""
    text = x.cast("string")
    empty = F.when(F.typeof(x) == "string", text == "").otherwise(text.rlike(r"^(-?0(\.0+)?(E.*)?|false)$"))
    return F.when(empty, None).otherwise(x)


def first_filled(*xs: Column) -> Column:
    return F.coalesce(*map(filled, xs))


def int_list(x: Column) -> Column:
    """Whole numbers, signed ones too, of a comma-separated list; blanks and others are skipped."""
    parts = F.transform(F.split(x, ","), lambda p: F.regexp_extract(p, r"^\s*([+-]?[0-9]{1,18})\s*$", 1).try_cast("long"))
    return F.filter(parts, lambda p: p.isNotNull())


def playlist_id(x: Column) -> Column:
    """A 22-character playlist id from an address, a URI or the bare id, tried in this order; else the first run of 22
    in a text that names the service or has 22 characters."""
    one = lambda p: filled(F.regexp_extract(F.trim(x), p, 1))
    loose = F.when(F.contains(F.lower(x), F.lit("spotify")) | (F.length(F.trim(x)) == 22), one("([A-Za-z0-9]{22})"))
    return F.coalesce(one("playlist/([A-Za-z0-9]{22})"), one("playlist:([A-Za-z0-9]{22})"), one("^([A-Za-z0-9]{22})$"), loose)


def is_video_id(x: Column) -> Column:
    return F.coalesce(F.length(x) == 11, F.lit(False)) & F.coalesce(x.rlike("^[A-Za-z0-9_-]{11}$"), F.lit(False))


def pairs(x: Column) -> Column:
    """name=value pairs of a ;-separated header in order; the first = splits, blanks and bare names are skipped."""
    parts = F.filter(F.transform(F.split(x, ";"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 1)
    cut = lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("name"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value")
    )
    return F.transform(parts, cut)


def epoch(x: Column) -> Column:
    """Seconds of a stamp's first 19 characters, with a space or a T between day and time; 0 where they don't parse."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    parsed = [F.try_to_timestamp(F.substring(x, 1, 19), F.lit(form)) for form in forms]
    return F.coalesce(F.unix_timestamp(F.coalesce(*parsed)), F.lit(0)).cast("long")


def source_rank(x: Column) -> Column:
    """Rank of a provenance; other texts 0, NULL and '' -1."""
    known = reduce(lambda acc, kv: acc.when(x == kv[0], kv[1]), SOURCE_RANK.items(), F.when(x.isNull() | (x == ""), -1))
    return known.otherwise(0)


def dedup_key(spotify: str = "spotify_id", apple: str = "apple_id", isrc: str = "isrc", title: str = "title", artist: str = "artist", album: str = "album") -> Column:
    """The first key there is: outer id, catalogue id, recording code, else title, artist and album."""
    low = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))
    tag = lambda t, c: F.concat(F.lit(t), filled(F.col(c)).cast("string"))
    return F.coalesce(tag("s:", spotify), tag("a:", apple), tag("i:", isrc), F.concat(F.lit("t:"), F.concat_ws("|", low(title), low(artist), low(album))))


def item_keys(kinds: tuple[str, ...] = ("apple_id", "spotify_id", "isrc")) -> list[Column]:
    """Texts of which two records of one item have one in common: a key a kind, and where all are empty the dedup key, which
    else holds one of them."""
    ks = [F.concat(F.lit(f"{c}:"), filled(F.col(c)).cast("string")) for c in kinds]
    return [*ks, F.when(F.coalesce(*ks).isNull(), F.concat(F.lit("dedup:"), dedup_key()))]


def preview_source(url: Column) -> Column:
    """Provenance by a preview address."""
    u = F.lower(url)
    return F.when(u.isNull() | (u == ""), "none").when(u.contains("scdn.co"), "spotify_preview").when(u.contains("itunes"), "itunes_term_search").otherwise("unknown")


def clock(seconds: Column) -> Column:
    """m:ss of a number of seconds; negative and non-finite ones count as 0."""
    usable = (seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf"))
    s = F.floor(F.when(usable, seconds).otherwise(0)).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """A file's name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^./]+$", "")


def file_suffix(path: Column) -> Column:
    """A file's last suffix with its dot, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def audio_target(id_col: Column, path: Column) -> Column:
    """Where a track's new file goes, with the suffix of the one it has."""
    return F.concat(F.lit("audio/"), id_col.cast("string"), F.coalesce(filled(file_suffix(path)), F.lit(".mp3")))
