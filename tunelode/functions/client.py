"""What a client shows: percents, labels, colours, byte ranges and headers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the sources of an item's features.
SOURCE_LABELS = {
    "spotify_preview": "Spotify preview",
    "itunes_isrc": "iTunes ISRC lookup",
    "itunes_term_search": "iTunes term search",
    "none": "No classification audio",
}


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _clamped(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def percent(v: Column) -> Column:
    """0 to 100 of a share or a percent: up to 1.5 it is a share."""
    return F.when(_finite(v), _clamped(F.when(v > 1.5, v).otherwise(v * 100.0), 0.0, 100.0))


def percent_of(v: Column, most: Column, signed: bool = False) -> Column:
    """0 to 100 of a value against its ceiling, NULL where that is not above 0."""
    return F.when(_finite(v) & _finite(most) & (most > 0), _clamped((F.abs(v) if signed else v) / most * 100.0, 0.0, 100.0))


def lean(v: Column) -> Column:
    """Which mode a valence leans to; '' where it is unknown."""
    label = F.when(v > 0, "major-leaning").when(v < 0, "minor-leaning").otherwise("neutral")
    return F.when(_finite(v), label).otherwise("")


def between(a: float, b: float, t: Column) -> Column:
    return a + (b - a) * t


def rgb(*parts: Column) -> Column:
    """rgb(r, g, b) of rounded parts."""
    whole = [F.floor(p + 0.5).cast("string") for p in parts]
    return F.concat(F.lit("rgb("), F.concat_ws(", ", *whole), F.lit(")"))


def gain(db: Column) -> Column:
    """The factor of a gain in decibels."""
    return F.pow(F.lit(10.0), db / 20.0)


def initials(name: Column) -> Column:
    """First letters of the first and last word, of a single word one, '?' where there is none."""
    words = F.split(F.trim(name), r"\s+")
    first = lambda w: F.substring(w, 1, 1)
    both = F.when(F.size(words) > 1, F.concat(first(words[0]), first(F.element_at(words, -1)))).otherwise(first(words[0]))
    return F.when(F.coalesce(F.length(F.trim(name)), F.lit(0)) == 0, "?").otherwise(F.upper(both))


def source_label(source: Column) -> Column:
    """The label of a source; an unknown one stands for itself, none is Unknown."""
    known = F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])
    return F.when(F.coalesce(source, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.try_element_at(known, source), source))


def verifiable(source: Column, preview: Column) -> Column:
    return F.coalesce(source != "none", F.lit(True)) & (F.coalesce(F.length(preview), F.lit(0)) > 0)


def expiry(ms: Column) -> Column:
    """Time left, of milliseconds, in its two largest units."""
    s = F.floor(ms / 1000).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = F.when(h > 0, F.concat(F.lit("in "), h, F.lit("h "), m, F.lit("m")))
    text = text.when(m > 0, F.concat(F.lit("in "), m, F.lit("m "), s % 60, F.lit("s"))).otherwise(F.concat(F.lit("in "), s, F.lit("s")))
    return F.when(ms.isNull(), "\u2014").when(ms <= 0, "expired").otherwise(text)


def byte_range(header: Column, size: Column) -> Column:
    """(start, length) of a 'bytes=a-b', 'bytes=a-' or 'bytes=-n' header over a file; NULL where it can't be served."""
    form = r"^bytes=([0-9]*)-([0-9]*)$"
    digits = [F.regexp_extract(F.trim(header), form, i) for i in (1, 2)]
    # a number of more than 18 digits is beyond any file; one that isn't there is NULL
    a, b = (F.when(F.length(F.ltrim(d, F.lit("0"))) > 18, 10**18).when(d != "", d.try_cast("long")) for d in digits)
    start = F.when(a.isNotNull(), a).when(b > 0, F.greatest(F.lit(0), size - b))
    end = F.when(a.isNotNull() & b.isNotNull(), b).otherwise(size - 1)
    served = (start < size) & (end < size) & (start <= end)
    return F.when(served, F.struct(start.alias("start"), (end - start + 1).alias("length")))


def bearer(header: Column) -> Column:
    """The token of an authorization header, NULL where it has none."""
    token = F.regexp_extract(header, r"^\s*(?i:bearer)\s+(.*)$", 1)
    return F.when(F.length(F.trim(token)) > 0, F.trim(token))


def token(text: Column) -> Column:
    """A token without blanks, quotes and a leading 'Bearer '."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), '^"+|"+$', ""), "^'+|'+$", ""))
    return F.coalesce(F.trim(F.regexp_replace(bare, "^(?i:bearer) ", "")), F.lit(""))


def whole_number(text: Column) -> Column:
    """The whole number that a text holds, 0 where it holds none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,18})\s*$", 1).try_cast("long"), F.lit(0))


def search_forms(title: Column, artist: Column) -> Column:
    """The six searches for a track, the most exact first."""
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return F.array(
        say('"', title, " - ", artist, ' official music video"'), say('"', title, " - ", artist, '"'),
        say(title, " ", artist, " official music video"), say(title, " ", artist), title, artist,
    )


def eligible(embeddable: Column, age_limit: Column, availability: Column, live_status: Column) -> Column:
    """Whether a video may be shown; what is unknown rules nothing out."""
    known = lambda c: F.coalesce(c, F.lit(True))
    return known(embeddable) & known(age_limit == 0) & known(availability.isin("public", "unlisted")) & known(~live_status.isin("is_upcoming", "post_live"))


def best_image(images: Column, default: Column) -> Column:
    """Of an array of (url, width, height), the url of the largest that has one, the first of equal ones; else the default."""
    place = F.transform(images, lambda t, i: F.struct(
        (F.coalesce(t["width"], F.lit(0)) * F.coalesce(t["height"], F.lit(0))).alias("area"), (-i).alias("order"), t["url"].alias("url")
    ))
    best = F.array_max(F.filter(place, lambda t: t["url"].isNotNull()))["url"]
    return F.coalesce(F.when(best != "", best), default)
