"""Library catalogue, integrity checks, publication gates and cache plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_names(rows: DataFrame, name: str, position: str) -> DataFrame:
    """Names without regard to case, each in its first spelling, with counts."""
    return rows.groupBy(F.lower(name).alias("key")).agg(F.expr(f"min_by({name}, {position})").alias("name"), F.count("*").alias("rows"))


def summary(rows: DataFrame, source: str, name: str, formula: str) -> DataFrame:
    """Per source and over all (source 'all'): rows, distinct names without case, distinct (name, formula)."""
    counted = rows.rollup(source).agg(F.count("*").alias("rows"), F.countDistinct(F.lower(name)).alias("names"), F.countDistinct(F.struct(F.lower(name), F.col(formula))).alias("names_and_formulas"), F.grouping(source).alias("_all"))
    return counted.select(F.when(F.col("_all") == 1, "all").otherwise(F.coalesce(source, F.lit(""))).alias("source"), "rows", "names", "names_and_formulas")


def class_pivot(rows: DataFrame, rules: list[tuple[str, Column]], source: str, otherwise: str = "other") -> DataFrame:
    """Class by source with totals; the first rule that holds names the class."""
    kind = F.lit(otherwise)
    for name, rule in reversed(rules):
        kind = F.when(rule, name).otherwise(kind)
    out = rows.withColumn("class", kind).cube("class", source).agg(F.count("*").alias("rows"), F.grouping_id().alias("_g"))
    return out.select(F.when(F.col("_g").bitwiseAND(2) != 0, "total").otherwise(F.col("class")).alias("class"), F.when(F.col("_g").bitwiseAND(1) != 0, "total").otherwise(F.col(source)).alias("source"), "rows")


def inventory_facts(roots: DataFrame, records: DataFrame, issues: DataFrame) -> DataFrame:
    """What an inventory's signature covers, one row per fact: roots (alias) with their state, files, and issues by their code.

    Messages of issues and paths of roots differ from machine to machine and don't count; a root with the issue 'missing root' is missing.
    """
    gone = issues.where("issue = 'missing root'").select("alias").distinct().withColumn("_gone", F.lit(True))
    none = F.lit("")
    state = roots.join(gone, "alias", "left").select(F.lit("root").alias("fact"), "alias", F.when(F.col("_gone"), "missing").otherwise("present").alias("place"), none.alias("size"), none.alias("modified"))
    files = records.select(F.lit("file").alias("fact"), "alias", F.col("relative_path").alias("place"), F.col("size").cast("string").alias("size"), F.col("modified").cast("string").alias("modified"))
    coded = issues.select(F.lit("issue").alias("fact"), "alias", F.col("issue").alias("place"), none.alias("size"), none.alias("modified"))
    return state.unionByName(files).unionByName(coded)


def inventory_signature(rows: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One sha256 over all records in order, in two levels so that no task sees every record.

    The first four digits of a record's digest, as a share of 65,536, pick one of ``buckets`` even ranges; a bucket's digest is taken over its
    sorted record digests, the result over the sorted bucket digests.  Choose ``buckets`` (up to 65,536) with the number of records: a task sorts one bucket.
    """
    record = F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    digests = rows.select(record.alias("_d")).withColumn("_b", F.floor(F.conv(F.substring("_d", 1, 4), 16, 10).cast("long") * buckets / 65536))
    parts = digests.groupBy("_b").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("_d"))), 256).alias("_d"), F.count("*").alias("_n"))
    return parts.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("_d"))), 256).alias("signature"), F.sum("_n").alias("records"))


def failure_gate(rows: DataFrame, failed: Column, category: Column, limit: float = 0.9) -> DataFrame:
    """One row: counts, the leading failure, and publish = some row is valid and no single failure reaches the limit."""
    kinds = rows.select(F.when(failed, F.coalesce(category, F.lit("unknown"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    worst = F.max(F.when(F.col("c").isNotNull(), F.struct(F.col("n"), F.col("c"))))
    out = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("c").isNull(), F.col("n"))), F.lit(0)).alias("valid"), worst.alias("w"))
    share = F.when(F.col("rows") > 0, F.coalesce(F.col("w.n"), F.lit(0)) / F.col("rows")).otherwise(F.lit(0.0))
    return out.select("rows", "valid", F.col("w.c").alias("leading_failure"), share.alias("failure_share"), ((F.col("valid") > 0) & (share < limit)).alias("publish"))


def cleanup_plan(entries: DataFrame, budget: float, protect: int = 2, group: str | None = None) -> DataFrame:
    """What to quarantine of cache entries (entry, bytes, mtime, complete, active), oldest first, until the rest fits the budget.

    Incomplete entries always go; active ones and the ``protect`` newest
    complete ones never do.  With ``group`` each group has its own budget.
    """
    part = [group] if group else [F.lit(0)]
    newest = Window.partitionBy(*part, "complete").orderBy(F.col("mtime").desc(), F.col("entry").desc())
    rows = entries.withColumn("_new", F.row_number().over(newest))
    rows = rows.withColumn("protected", F.col("active") | (F.col("complete") & (F.col("_new") <= protect)))
    rows = rows.withColumn("incomplete", ~F.col("complete") & ~F.col("active"))
    kept = F.sum(F.when(F.col("incomplete"), F.lit(0.0)).otherwise(F.col("bytes").cast("double"))).over(Window.partitionBy(*part))
    free = ~F.col("protected") & ~F.col("incomplete")
    oldest = Window.partitionBy(*part).orderBy("mtime", "entry").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("_free"), F.col("bytes").cast("double")).otherwise(F.lit(0.0))).over(oldest), F.lit(0.0))
    rows = rows.withColumn("_free", free).withColumn("_kept", kept).withColumn("_gone", gone)
    action = F.when(F.col("incomplete"), "quarantine incomplete").when(F.col("_free") & (F.col("_kept") - F.col("_gone") > budget), "quarantine").otherwise("keep")
    return rows.withColumn("action", action).drop("_new", "_free", "_kept", "_gone", "incomplete")


def twin_check(raw: DataFrame, corrected: DataFrame, identity: list[str]) -> DataFrame:
    """One row: rows of each variant, rows without a twin, and twins whose identity differs."""
    a, b = (x.select("row_id", *identity) for x in (raw, corrected))
    both = a.alias("a").join(b.alias("b"), "row_id", "full")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    left = F.col(f"a.{identity[0]}").isNotNull()
    right = F.col(f"b.{identity[0]}").isNotNull()
    return both.agg(F.count_if(left).alias("raw_rows"), F.count_if(right).alias("corrected_rows"), F.count_if(left != right).alias("without_twin"), F.count_if(left & right & ~same).alias("different"))


def row_rules(grid: int) -> Column:
    """The names of the rules that a row of a library breaks: finite norm, support inside the grid and ordered, support where there is signal."""
    runs = F.coalesce("support_runs", F.array(F.struct(F.col("start_idx").alias("start"), F.col("end_idx").alias("end"))))
    ordered = F.size(F.filter(runs, lambda r, i: (i > 0) & (r["start"] <= F.get(runs, i - 1)["end"]))) == 0
    rules = {
        "norm": (F.col("l2") < 0) | F.isnan("l2") | F.col("l2").isNull(),
        "length": F.size("vector") != grid,
        "grid": F.exists(runs, lambda r: (r["start"] < 0) | (r["end"] >= grid) | (r["end"] < r["start"])),
        "support": (F.col("l2") > 0) & (F.size(runs) == 0),
        "order": ~ordered,
        "summary": (F.size(runs) > 0) & ((F.get(runs, F.lit(0))["start"] != F.col("start_idx")) | (F.element_at(runs, -1)["end"] != F.col("end_idx"))),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))


def broken_rows(library: DataFrame, grid: int) -> DataFrame:
    """Rows with the names of the rules they break."""
    return library.withColumn("broken", row_rules(grid)).where("size(broken) > 0")


def name_lookup(library: DataFrame, request: DataFrame, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """Candidates for requested names (one column, request; split on comma, semicolon, newline), and the names not found.

    The first ``limit`` distinct names count; candidates of a name are ordered by flag s, none, x and then file name.
    """
    parts = request.select(F.posexplode(F.split("request", "[,;\n]")).alias("at", "name")).withColumn("name", F.trim("name")).where("name <> ''")
    wanted = parts.groupBy(F.lower("name").alias("key")).agg(F.min("at").alias("at"), F.expr("min_by(name, at)").alias("name")).orderBy("at").limit(limit)
    rank = F.when(F.col("flag") == "s", 0).when(F.coalesce("flag", F.lit("")) == "", 1).otherwise(2)
    found = library.withColumn("key", F.lower("name")).join(F.broadcast(wanted.select("key", "at")), "key")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(rank, "filename")))
    return found, wanted.join(library.select(F.lower("name").alias("key")), "key", "left_anti").select("name")
