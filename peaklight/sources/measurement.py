"""Measurement text to spectra: two columns of numbers in one of several layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Delimiters in the order in which they win ties.
DELIMITERS = (("comma", ","), ("tab", "\t"), ("semicolon", ";"), ("whitespace", None))


def lines_of(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, line (from 1), content without BOM; blank lines and comments (#) are left out."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", "")
    rows = files.select(key, F.posexplode(F.split(clean, "\r\n|\r|\n")).alias("line", "content"))
    return rows.withColumn("line", F.col("line") + 1).withColumn("content", F.trim("content")).where("content <> '' and not startswith(content, '#')")


def fields(content: Column, delimiter: str) -> Column:
    """Fields of a line; quotes around a field go, and a delimiter inside of them doesn't part it ("" stands for a quote there)."""
    sign = dict(DELIMITERS)[delimiter]
    if sign is None:
        return F.transform(F.split(F.trim(content), r"\s+"), lambda p: F.trim(F.regexp_replace(F.trim(p), '^"(.*)"$', "$1")))
    # A field and the delimiter before it; the line gets one in front, so that no match is empty.
    parts = F.regexp_extract_all(F.concat(F.lit(sign), content), F.lit(rf'{sign}(\s*"(?:[^"]|"")*"\s*(?={sign}|$)|[^{sign}]*)'), 1)
    return F.transform(parts, lambda p: F.trim(F.replace(F.regexp_replace(F.trim(p), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))))


def number(field: Column, delimiter: str) -> Column:
    """The field as a number, or NULL; a decimal comma counts where the comma isn't the delimiter."""
    text = field if delimiter == "comma" else F.regexp_replace(field, ",", ".")
    value = text.try_cast("double")
    return F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$") & ~F.isnan(value), value)


def pair(content: Column, delimiter: str) -> Column:
    parts = fields(content, delimiter)
    x, y = number(F.get(parts, F.lit(0)), delimiter), number(F.get(parts, F.lit(1)), delimiter)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def detect_delimiter(lines: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, delimiter, numeric_rows: the delimiter with most numeric rows, the earlier one of equals; NULL without any.

    All four are counted in one aggregate.
    """
    names = [n for n, _ in DELIMITERS]
    counts = lines.groupBy(key).agg(*(F.count_if(pair(F.col(content), n).isNotNull()).alias(n) for n in names))
    most = F.greatest(*names)
    chosen = F.coalesce(*(F.when((F.col(n) == most) & (most > 0), n) for n in names))
    return counts.select(key, chosen.alias("delimiter"), most.alias("numeric_rows"))


def parse(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, axis, intensity, points, error from whole texts, one row per file.

    The first two columns count.  Rows before the first numeric one are a header; a row
    after it that isn't numeric is an error, naming up to five lines.  The
    axis must run one way; values at the same x are averaged; two different x
    are needed.  With an error both arrays are NULL.
    """
    lines = lines_of(files, key, text)
    lines = lines.join(detect_delimiter(lines, key).select(key, "delimiter"), key)
    value = F.coalesce(*(F.when(F.col("delimiter") == n, pair(F.col("content"), n)) for n, _ in DELIMITERS))
    w = Window.partitionBy(key).orderBy("line")
    rows = lines.withColumn("p", value).withColumn("seen", F.count("p").over(w))
    rows = rows.where("seen > 0").withColumn("step", F.col("p.x") - F.lag("p.x", 1).over(Window.partitionBy(key, F.col("p").isNull()).orderBy("line")))
    facts = rows.groupBy(key).agg(
        F.slice(F.array_sort(F.collect_list(F.when(F.col("p").isNull(), F.col("line")))), 1, 5).alias("bad"),
        F.bool_or(F.col("step") > 0).alias("up"),
        F.bool_or(F.col("step") < 0).alias("down"),
        F.count("p").alias("points"),
    )
    merged = rows.where("p is not null").groupBy(key, F.col("p.x").alias("x")).agg(F.avg("p.y").alias("y"))
    arrays = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("a"))
    out = files.select(key).distinct().join(facts, key, "left").join(arrays, key, "left")
    error = (
        F.when(F.coalesce("points", F.lit(0)) == 0, "no numeric rows")
        .when(F.size("bad") > 0, F.concat(F.lit("not numeric: line "), F.array_join(F.transform("bad", lambda b: b.cast("string")), ", ")))
        .when(F.col("up") & F.col("down"), "axis runs both ways")
        .when(F.size("a") < 2, "fewer than two different x")
    )
    ok = F.col("error").isNull()
    return out.withColumn("error", error).select(key, F.when(ok, F.col("a.x")).alias("axis"), F.when(ok, F.col("a.y")).alias("intensity"), F.coalesce("points", F.lit(0)).cast("long").alias("points"), "error")


def split_header(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, header (lines before the numbers, joined), body (pairs as arrays x, y): for tools that must give the header back."""
    rows = files.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""), "\r\n|\r|\n")).alias("line", "content"))
    value = F.coalesce(*(pair(F.col("content"), n) for n in ("tab", "semicolon", "comma", "whitespace")))
    rows = rows.withColumn("p", F.when(F.size(F.split(F.trim("content"), r"[\s;]+")) <= 2, value))
    rows = rows.withColumn("seen", F.count("p").over(Window.partitionBy(key).orderBy("line")))
    order = F.array_sort(F.collect_list(F.when(F.col("seen") == 0, F.struct("line", "content"))))
    body = F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("line", "p"))))
    out = rows.groupBy(key).agg(order.alias("h"), body.alias("b"))
    return out.select(key, F.array_join("h.content", "\n").alias("header"), F.col("b.p.x").alias("x"), F.col("b.p.y").alias("y"))


def rewritten(files: DataFrame, change=None, decimals: int | None = 6, delimiter: str = "\t", key: str = "path", text: str = "value") -> DataFrame:
    """key and value of files whose numbers are written anew below their own header lines.

    ``change`` takes the table key, header, axis, intensity and gives it back with other numbers (a baseline off, scaled, trimmed); by default they stay.  A file
    without numbers keeps its lines alone.
    """
    from peaklight.sources.writers import spectrum_text

    rows = split_header(files, key, text).select(key, "header", F.col("x").alias("axis"), F.col("y").alias("intensity"))
    rows = rows if change is None else change(rows)
    return rows.select(key, spectrum_text(F.col("axis"), F.col("intensity"), F.coalesce("header", F.lit("")), decimals, delimiter).alias("value"))
