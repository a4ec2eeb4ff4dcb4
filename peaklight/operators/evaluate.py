"""Recall at k of ranked answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklight.functions.columns import wilson_half_width
from peaklight.functions.text import loose


def unpivot_ranks(wide: DataFrame, ids: list[str], ranks: dict[str, list[str]]) -> DataFrame:
    """Long rows (ids, app, rank, candidate) from one column per app and rank."""
    every = None
    for app, names in ranks.items():
        part = wide.select(*ids, F.lit(app).alias("app"), F.posexplode(F.array(*map(F.col, names))).alias("rank", "candidate"))
        every = part if every is None else every.unionByName(part)
    return every.withColumn("rank", F.col("rank") + 1).where("candidate is not null and trim(candidate) <> ''")


def rank_number(cell: str | None) -> int | None:
    """The whole number in a cell, or None."""
    try:
        return int(float(str(cell).strip())) if cell is not None else None
    except ValueError:
        return None


def rank_blocks(header: list, ranks: list, labels: list[tuple[tuple[str, ...], str]] = (), size: int = 10) -> dict[str, list[int]]:
    """Columns of each block of ranks 1, 2, ..., ``size``, by the block's name, from the two first rows of a sheet.

    The name is the first of ``labels`` ((parts, name)) of which all parts stand in
    the header's letters and digits, taken together with the cell beside it; else the header itself.  Blocks of
    one name are numbered: name, name #2, ...
    """
    out, seen = {}, {}
    numbers = [rank_number(c) for c in ranks]
    for at in range(1, len(ranks) - size + 1):
        if numbers[at : at + size] != list(range(1, size + 1)):
            continue
        own = [str(c).strip() for c in header[at : at + 2] if c is not None]
        plain = "".join(ch for ch in " ".join(own).lower() if ch.isascii() and ch.isalnum())
        name = next((label for parts, label in labels if all(p in plain for p in parts)), (str(header[at]).strip() if header[at] is not None else "") or "unknown")
        seen[name] = seen.get(name, 0) + 1
        out[name if seen[name] == 1 else f"{name} #{seen[name]}"] = list(range(at, at + size))
    if not out:
        raise ValueError(f"no block of ranks 1 to {size} in the sheet")
    return out


def ranked_sheet(sheet: DataFrame, labels: list[tuple[tuple[str, ...], str]] = (), size: int = 10) -> DataFrame:
    """spectrum, app, rank, candidate from a sheet (line from 0, cells array<string>) whose two first lines are header and ranks.

    Only these two come to the driver.  Cells that are blank or say x hold no candidate.
    """
    top = {r.line: list(r.cells) for r in sheet.where("line < 2").select("line", "cells").collect()}
    if len(top) < 2:
        raise ValueError("a sheet begins with a header and a row of ranks")
    blocks = rank_blocks(top[0], top[1], labels, size)
    rows = sheet.where("line >= 2").select(F.get("cells", F.lit(0)).alias("spectrum"), "cells").where("trim(spectrum) <> ''")
    each = F.array(*(F.struct(F.lit(app).alias("app"), F.lit(i + 1).alias("rank"), F.get("cells", F.lit(c)).alias("candidate")) for app, columns in blocks.items() for i, c in enumerate(columns)))
    return rows.select("spectrum", F.explode(each).alias("e")).select("spectrum", "e.*").where("candidate is not null and lower(trim(candidate)) not in ('', 'x')")


def ranked_sheets(cells: DataFrame, labels: list[tuple[tuple[str, ...], str]] = (), size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(path, sheet, spectrum, app, rank, candidate) of many sheets (path, sheet, line, cells), and the sheets (path, sheet, error) without a block of ranks.

    Each sheet has blocks of its own, which its first two lines tell; these, two rows a sheet, meet its other lines by a join, so neither a sheet nor
    their headers come to the driver.  Rows without a line are left out.
    """
    kind = "error string, blocks array<struct<app:string,rank:int,at:int>>"

    @F.udf(kind)
    def found(top: list, ranks: list):
        try:
            blocks = rank_blocks(list(top or []), list(ranks or []), labels, size)
        except ValueError as e:
            return str(e), []
        return None, [(app, i + 1, at) for app, columns in blocks.items() for i, at in enumerate(columns)]

    head = cells.where("line < 2").groupBy("path", "sheet").agg(F.max(F.when(F.col("line") == 0, F.col("cells"))).alias("top"), F.max(F.when(F.col("line") == 1, F.col("cells"))).alias("ranks"))
    known = head.select("path", "sheet", found("top", "ranks").alias("f")).select("path", "sheet", "f.*")
    every = cells.where("line is not null").select("path", "sheet").distinct()
    bare = every.join(known, ["path", "sheet"], "left").where("error is not null or blocks is null").select("path", "sheet", F.coalesce("error", F.lit("a sheet begins with a header and a row of ranks")).alias("error"))
    lines = cells.where("line >= 2").select("path", "sheet", F.get("cells", F.lit(0)).alias("spectrum"), "cells").where("trim(spectrum) <> ''")
    ranked = lines.join(known.where("size(blocks) > 0").select("path", "sheet", "blocks"), ["path", "sheet"]).select("path", "sheet", "spectrum", "cells", F.explode("blocks").alias("b"))
    out = ranked.select("path", "sheet", "spectrum", F.col("b.app").alias("app"), F.col("b.rank").alias("rank"), F.get("cells", F.col("b.at")).alias("candidate"))
    return out.where("candidate is not null and lower(trim(candidate)) not in ('', 'x')"), bare


def base_name(spectrum: Column) -> Column:
    """The name up to a digit that follows an underscore or a blank; the whole name without one."""
    return F.coalesce(F.nullif(F.regexp_extract(spectrum, r"^(.*?)(?:_\d|\s\d)", 1), F.lit("")), spectrum)


def truth_set(spectrum: Column, aliases: dict[str, list[str]]) -> Column:
    """Names that count as right: those that ``aliases`` has for the base name, else the base name and its parts of three letters or more."""
    base = base_name(spectrum)
    key = loose(base)
    parts = F.filter(F.transform(F.filter(F.split(base, "[^a-zA-Z0-9]+"), lambda p: F.length(p) >= 3), loose), lambda p: p != "")
    out = F.array_sort(F.array_distinct(F.concat(parts, F.when(key != "", F.array(key)).otherwise(F.array().cast("array<string>")))))
    for name, truths in aliases.items():
        out = F.when(key == name, F.array(*map(F.lit, sorted(truths)))).otherwise(out)
    return out


def hit(candidate: Column, truths: Column) -> Column:
    """A candidate names a truth when their letters and digits agree, or one of at least four holds the other."""
    name = loose(candidate)
    return F.exists(truths, lambda t: (loose(t) == name) | ((F.length(loose(t)) >= 4) & F.contains(name, loose(t))) | ((F.length(name) >= 4) & F.contains(loose(t), name)))


def recall_at_k(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 6, 10), query: str = "query", app: str = "app", rank: str = "rank", right: str = "hit") -> DataFrame:
    """app, k, hits, total, percent and Wilson half width; a query hits at k when one of its first k answers is right."""
    first = ranked.groupBy(app, query).agg(F.min(F.when(F.col(right), F.col(rank))).alias("first"))
    rows = first.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    out = rows.groupBy(app, "k").agg(F.count_if(F.col("first") <= F.col("k")).alias("hits"), F.count("*").alias("total"))
    return out.select(app, "k", "hits", "total", (100.0 * F.col("hits") / F.col("total")).alias("percent"), (100 * wilson_half_width(F.col("hits"), F.col("total"))).alias("half_width"))


def combined(ranked: DataFrame, apps: list[str], name: str, query: str = "query") -> DataFrame:
    """Adds an app that is right at a rank where any of the given ones is."""
    both = ranked.where(F.col("app").isin(apps)).groupBy(query, "rank").agg(F.bool_or("hit").alias("hit")).withColumn("app", F.lit(name))
    return ranked.select(query, "rank", "hit", "app").unionByName(both.select(query, "rank", "hit", "app"))


#: Ids that a block of the library and a block of queries span.
ROWS, QUERIES = 512, 12800


def nearest(library: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, app, rank, row_id: of each query the k rows of the library with the best cosine and the least city-block distance.

    Both sides have row_id and a vector of one length; a row isn't its own
    neighbour.  Scores are rounded to nine decimals, ties go to the smaller id.
    Blocks of queries meet blocks of the library, and a pair of blocks gives k
    rows for each query, so neither side has to fit in one task or the driver.
    """

    def blocked(df: DataFrame, size: int, ids: str, vectors: str) -> DataFrame:
        cells = df.select(F.floor(F.col("row_id") / size).alias("_b"), F.struct("row_id", F.col("vector").cast("array<double>").alias("v")).alias("_r"))
        return cells.groupBy("_b").agg(F.sort_array(F.collect_list("_r")).alias("_r")).select(F.col("_r.row_id").alias(ids), F.flatten("_r.v").alias(vectors))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q_ids, q, ids, v = (batch.column(c)[i].values.to_numpy() for c in ("q_ids", "q", "ids", "v"))
                q, v = q.reshape(len(q_ids), -1), v.reshape(len(ids), -1)
                size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
                cosine = np.where(size > 0, q @ v.T / np.where(size > 0, size, 1.0), 0.0)
                block = np.stack([-np.abs(v - one).sum(1) for one in q])
                for app, score in (("cosine", cosine), ("city block", block)):
                    score = np.round(score, 9)
                    score[q_ids[:, None] == ids] = -np.inf
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    won = np.take_along_axis(score, top, 1).ravel()
                    own = won > -np.inf
                    yield pa.RecordBatch.from_pydict({"query": np.repeat(q_ids, top.shape[1])[own], "app": pa.array([app] * int(own.sum()), pa.string()), "score": won[own], "row_id": ids[top].ravel()[own]})

    pairs = blocked(library, ROWS, "ids", "v").crossJoin(blocked(queries, QUERIES, "q_ids", "q"))
    found = pairs.mapInArrow(best, "query long, app string, score double, row_id long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("app", "query").orderBy(F.col("score").desc(), "row_id")))
    return ranked.where(F.col("rank") <= k).select("query", "app", "rank", "row_id")
