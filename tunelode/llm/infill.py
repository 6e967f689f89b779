"""Fill-in-middle transformation on relational units.

A text is cut into units; their lengths are numbered by posexplode and summed up in a window, requests for cuts join the
sums by the unit's ordinal, the found offsets are aggregated per document, and substrings are put in their new order.

Rows are brought together once, by id and text digest: repeated rows are combined on the map side and counted, and units,
requests and texts are all read from that one exchange, so neither a hot id nor a group of copies lands in a task.

Defined cases: a null or empty text is empty and plain; a null id counts as an empty decimal; repeated rows give one row
each; an empty table gives no rows; other columns are left out; a text is never cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _hashed(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def plan(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs (doc_id, text) with n, form and the two cuts' ordinals, `first` and `second` (null if plain)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (_hashed(F.col("h"), 3) % 100 >= rate)
    cuts = [_hashed(F.col("h"), k) % (F.col("n") + 1) for k in (1, 2)]
    return (
        docs.withColumns({"text": text, "h": h, "n": F.regexp_count(text, F.lit(UNIT)).cast("long")})
        .withColumn("form", F.when(plain, "plain").when(_hashed(F.col("h"), 4) % 100 < spm, "spm").otherwise("psm"))
        .withColumns({"first": F.when(F.col("form") != "plain", F.least(*cuts)), "second": F.when(F.col("form") != "plain", F.greatest(*cuts))})
        .drop("h")
    )


def unit_ends(docs: DataFrame, key: str) -> DataFrame:
    """(key, ordinal from 1, upto): where each unit of a text ends, in code points."""
    units = docs.select(key, F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), lambda u: F.length(u))).alias("at", "chars"))
    upto = F.sum("chars").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return units.select(key, (F.col("at") + 1).alias("ordinal"), upto.alias("upto"))


def offsets(planned: DataFrame, key: str) -> DataFrame:
    """(key, prefix_end, middle_end): the requested cuts of planned texts, as offsets in code points where a unit ends.

    Requests meet a document's units by its key, which both sides are dealt by already, and match by ordinal there.
    """
    cut = planned.where("form != 'plain'")
    asked = cut.select(F.col(key).alias("_key"), "first", "second")
    met = unit_ends(cut, key).join(asked, (F.col(key) == F.col("_key")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second"))))
    found = lambda c: F.max(F.when(F.col("ordinal") == F.col(c), F.col("upto")))
    return met.groupBy(key).agg(found("first").alias("prefix_end"), found("second").alias("middle_end"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    rate: per cent of documents that are cut; spm: per cent of these with the suffix first.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)
    rows = rows.withColumn("key", F.coalesce(F.unhex(digest), F.lit(b"")))  # never null
    once = rows.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    planned = plan(once.where("copies > 0"), seed, rate, spm)  # every reader of the exchange has all its columns, so there is one
    cut = offsets(planned, "key").withColumnRenamed("key", "_key")
    both = planned.join(cut, F.col("key") == F.col("_key"), "left")
    a, b = (F.when(F.col("form") != "plain", F.coalesce(F.col(c), F.lit(0))) for c in ("prefix_end", "middle_end"))  # no unit ends at 0
    out = both.withColumns({"prefix_chars": a.cast("long"), "middle_chars": (b - a).cast("long")})
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", arranged(F.col("text"), F.col("form"), F.col("prefix_chars"), F.col("middle_chars")).alias("output"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    ).drop("_copy")


def arranged(text: Column, form: Column, prefix: Column, middle: Column) -> Column:
    """The text in its form."""
    p, m = prefix.cast("int"), middle.cast("int")
    head, mid, tail = F.substr(text, F.lit(1), p), F.substr(text, p + 1, m), F.substr(text, p + m + 1)
    psm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), mid)
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), mid))


def restored(output: Column, form: Column) -> Column:
    """The text of an output.  Texts that are cut hold no marker, so each marker stands where it was put."""
    first, second = (F.when(form == "psm", x).otherwise(y) for x, y in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    part = lambda begin, end: F.substr(output, F.instr(output, begin) + 3, F.instr(output, end) - F.instr(output, begin) - 3)
    one, two = part(first, second), part(second, F.lit(MIDDLE))
    mid = F.substr(output, F.instr(output, F.lit(MIDDLE)) + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, mid, two)).otherwise(F.concat(two, mid, one))
