"""Files of named roots as a table of records; problems become rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".rod", ".txt")
#: A longer list of roots isn't a list of named folders.
MOST_ROOTS = 1000
SCHEMA = "alias string, relative_path string, size long, modified timestamp, path string"


def coerce_roots(roots: dict[str, str] | list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(alias, path) sorted by alias without case; a repeated alias is an error."""
    pairs = list(roots.items()) if isinstance(roots, dict) else [tuple(r) for r in roots]
    folded = [a.casefold() for a, _ in pairs]
    if len(set(folded)) < len(folded) or not all(a.strip() for a in folded):
        raise ValueError("aliases of roots must be unique and not blank")
    return sorted(((a, p.rstrip("/")) for a, p in pairs), key=lambda r: r[0].casefold())


def numbered_aliases(names: list[str]) -> list[str]:
    """name, name-2, name-3, ... for repeated names."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n.casefold()] = seen.get(n.casefold(), 0) + 1
        out.append(n if k == 1 else f"{n}-{k}")
    return out


def safe_relative(path: Column) -> Column:
    """True for a relative path that has no empty, . or .. part."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return (F.length(path) > 0) & ~path.rlike(r"^(/|\\|[A-Za-z]:)") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def scan(spark: SparkSession, roots, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of all files under the roots with one of the suffixes, in any case.

    Listing is Spark's own binaryFile source with the content column pruned, so nothing is read.
    """
    records, issues = spark.createDataFrame([], SCHEMA), []
    for alias, root in coerce_roots(roots):
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            issues.append((alias, root, "missing root"))
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
        ends = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
        base = at.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(at).toUri().getPath()
        inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + base.rstrip("/").replace(".", r"\.") + "/", "")
        records = records.unionByName(files.where(ends).select(F.lit(alias).alias("alias"), inside.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "path"))
    return records, spark.createDataFrame(issues, "alias string, path string, issue string")


class Inventory:
    """A scan that stays as it is until refresh(); token tells scans apart."""

    def __init__(self, spark: SparkSession, roots):
        self.spark, self.roots, self.generation, self._records = spark, roots, 0, None

    def records(self) -> DataFrame:
        return self._records if self._records is not None else self.refresh()

    def refresh(self) -> DataFrame:
        if self._records is not None:
            self._records.unpersist()
        self._records = scan(self.spark, self.roots)[0].persist()
        self.generation += 1
        return self._records

    def token(self) -> str:
        from peaklight.operators.catalog import inventory_signature

        row = inventory_signature(self.records(), ["alias", "relative_path", "size", "modified"]).first()
        return f"{row.signature or ''}:generation:{self.generation}"


def root_of(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """The deepest root (alias, root) that holds each path, and the path below it; NULL without one.

    Roots are named folders, MOST_ROOTS at most, so they are sent to all tasks; they join on the start of the path.
    """
    if roots.limit(MOST_ROOTS + 1).count() > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} roots")
    hit = paths.join(F.broadcast(roots), F.col(path).startswith(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"))), "left")
    nth = F.row_number().over(Window.partitionBy(path).orderBy(F.length("root").desc_nulls_last(), "alias"))
    below = F.expr(f"substring({path}, length(regexp_replace(root, '/+$', '')) + 2)")
    return hit.withColumn("_n", nth).where("_n = 1").drop("_n").withColumn("relative_path", below)


def resolve_sources(rows: DataFrame, roots, records: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """Where each row's file is: key, alias, relative_path, how, known.

    rows: key, source_alias, source_path (as stated), path (as it once was), filename.  In this order: "stated" (alias and a safe relative
    path); "below root" (the path starts with a root's); "known tail" (a part of the path is a root's alias or folder name, the last such part first, and
    what follows is a file of the inventory, or any safe path without one); "unique name" (only one file of the inventory has that name);
    else "unresolved".  ``known`` tells whether the inventory has the file, NULL without one.  Case doesn't matter for aliases, roots and names.
    """
    pairs = coerce_roots(roots)
    canonical = F.coalesce(*(F.when(F.lower(F.trim("source_alias")) == a.lower(), F.lit(a)) for a, _ in pairs), F.trim("source_alias"))
    stated = F.when((F.trim(F.coalesce("source_alias", F.lit(""))) != "") & F.coalesce(safe_relative(F.col("source_path")), F.lit(False)), F.struct(canonical.alias("alias"), F.col("source_path").alias("relative_path")))
    plain = F.regexp_replace(F.trim(F.coalesce("path", F.lit(""))), r"\\", "/")
    below = [F.when(F.lower(plain).startswith(root.lower() + "/"), F.struct(F.lit(a).alias("alias"), F.substring(plain, len(root) + 2, 1 << 20).alias("relative_path"))) for a, root in pairs]
    out = rows.select(key, stated.alias("_stated"), F.coalesce(*below).alias("_below"), plain.alias("_plain"), F.element_at(F.split(F.coalesce(F.trim("filename"), F.lit("")), r"[/\\]"), -1).alias("_name"))
    parts = F.filter(F.split("_plain", "/"), lambda p: p != "")

    def tails(order: int, a: str, root: str):
        names = {a.lower(), root.rsplit("/", 1)[-1].lower()}
        hits = F.filter(F.transform("_parts", lambda p, i: F.struct(F.lit(order).alias("order"), (-i).alias("late"), F.lit(a).alias("alias"), F.when(F.lower(p).isin(*names), F.concat_ws("/", F.slice("_parts", i + 2, 1 << 16))).alias("relative_path"))), lambda t: t["relative_path"].isNotNull())
        return F.filter(hits, lambda t: t["relative_path"] != "")

    open_rows = out.where("_stated is null and _below is null").withColumn("_parts", parts)
    tried = open_rows.select(key, F.explode(F.concat(*(tails(i, a, r) for i, (a, r) in enumerate(pairs)))).alias("_t")).where(safe_relative(F.col("_t.relative_path")))
    if records is not None:
        there = records.select(F.lower("alias").alias("_a"), F.col("relative_path").alias("_r"))
        tried = tried.join(there, (F.lower("_t.alias") == F.col("_a")) & (F.col("_t.relative_path") == F.col("_r")), "left_semi")
    tail = tried.groupBy(key).agg(F.min("_t").alias("_tail"))
    out = out.join(tail, key, "left")
    if records is not None:
        unique = records.withColumn("_name", F.lower(F.element_at(F.split("relative_path", "/"), -1))).groupBy("_name").agg(F.count("*").alias("_n"), F.first(F.struct("alias", "relative_path")).alias("_only")).where("_n = 1").drop("_n")
        out = out.withColumn("_name", F.lower("_name")).join(unique, "_name", "left")
    else:
        out = out.withColumn("_only", F.lit(None).cast("struct<alias:string,relative_path:string>"))
    tail = F.when(F.col("_tail").isNotNull(), F.struct("_tail.alias", "_tail.relative_path"))
    ways = {"stated": F.col("_stated"), "below root": F.col("_below"), "known tail": tail, "unique name": F.col("_only")}
    how = F.coalesce(*(F.when(way.isNotNull(), name) for name, way in ways.items()), F.lit("unresolved"))
    out = out.select(key, F.coalesce(*ways.values()).alias("_s"), how.alias("how")).select(key, "_s.alias", "_s.relative_path", "how")
    if records is None:
        return out.withColumn("known", F.lit(None).cast("boolean"))
    there = records.select(F.lower("alias").alias("_a"), F.col("relative_path").alias("_r"), F.lit(True).alias("_there")).distinct()
    out = out.join(there, (F.lower("alias") == F.col("_a")) & (F.col("relative_path") == F.col("_r")), "left")
    return out.select(key, "alias", "relative_path", "how", F.when(F.col("alias").isNotNull(), F.coalesce("_there", F.lit(False))).alias("known"))
