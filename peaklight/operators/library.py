"""Building a reference library in two variants: as measured, and baseline-corrected."""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peaklight.functions import kernels
from peaklight.model import Baseline, Grid, library_baseline, signature
from peaklight.operators import postings
from peaklight.operators.catalog import row_rules
from peaklight.sources.lease import Lease
from peaklight.sources.writers import children, listing, promote, quarantine, read_json, write_json

VECTORS = "row_id long, variant string, name string, flag string, filename string, already_processed boolean, db_baseline boolean, vector array<float>, l2 double, start_idx int, end_idx int, support_runs array<struct<start:int,end:int>>, failure string"


def _segments(x: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(x)
    middle = np.median(step) if len(step) else 0.0
    cut = np.flatnonzero(step > max(5 * middle, middle + 10)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True))


def _clean(x, y) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = np.isfinite(x) & np.isfinite(y)
    u, at = np.unique(x[ok], return_inverse=True)
    return u, np.bincount(at, y[ok], len(u)) / np.maximum(np.bincount(at, minlength=len(u)), 1) if len(u) else u


def even_segments(x: np.ndarray, y: np.ndarray, step: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Axis and values of each segment of two points or more, on whole multiples of the step; nothing is interpolated across a gap."""
    x, y = _clean(x, y)
    out = []
    for a, b in _segments(x):
        if b - a >= 2:
            first, last = np.ceil(x[a] / step - 1e-9), np.floor(x[b - 1] / step + 1e-9)
            even = np.arange(first, last + 1) * step if last > first else x[[a, b - 1]]
            out.append((even, np.interp(even, x[a:b], y[a:b])))
    return out


def project(segments: list[tuple[np.ndarray, np.ndarray]], grid: Grid, shift: float = 0.0, normalise: bool = True) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Vector and support runs of segments on a grid; zeros outside of them.

    ``shift`` calibrates the axis alone: it moves where values stand, never the values.
    With ``normalise`` the vector is scaled to 0..1 on the whole grid.
    """
    n = len(grid)
    out, runs, place = np.zeros(n), [], grid.minimum + grid.step * np.arange(n)
    for axis, value in segments:
        axis = axis + shift
        lo = max(0, int(np.ceil((axis[0] - grid.minimum) / grid.step)))
        hi = min(n - 1, int(np.floor((axis[-1] - grid.minimum) / grid.step)))
        if hi >= lo:
            out[lo : hi + 1] = np.interp(place[lo : hi + 1], axis, value)
            if runs and lo <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
            else:
                runs.append((lo, hi))
    return (kernels.minmax(out)[0] if normalise else out), runs


def corrected(segments: list[list[tuple[np.ndarray, np.ndarray]]], how: Baseline) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """The segments of many spectra without their baselines; all of one length are solved together."""
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, own in enumerate(segments):
        for j, (axis, _) in enumerate(own):
            by[len(axis)].append((i, j))
    out = [list(own) for own in segments]
    for at in by.values():
        y = np.stack([segments[i][j][1] for i, j in at])
        for (i, j), z in zip(at, y - how.strength * kernels.baseline(y, how), strict=True):
            out[i][j] = (segments[i][j][0], z)
    return out


def onto_grid(x, y, grid: Grid, how: Baseline | None, shift: float = 0.0) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Vector and support runs of one spectrum: per segment resampled to whole steps, corrected, projected, then scaled to 0..1."""
    segments = [even_segments(x, y, grid.step)]
    return project((corrected(segments, how) if how is not None else segments)[0], grid, shift)


def build_vectors(sources: DataFrame, grid: Grid, how: Baseline | None = None) -> DataFrame:
    """Two rows (DB-RAW, DB-BC) per source (row_id, name, flag, filename, already_processed, axis, intensity, error).

    Each source is read once, and the segments of a batch that are equally long are
    corrected in one matrix.  A source that fails keeps its row numbers with a zero
    vector and a failure category, so both variants stay aligned; one that
    was processed before is not corrected again.  Other columns of the sources (formula, elements, provenance) go with both rows.
    """
    how = how or library_baseline()
    wanted = ["row_id", "name", "flag", "filename", "already_processed", "axis", "intensity", "error"]
    more = [c for c in sources.columns if c not in wanted]
    names = [c.split()[0] for c in VECTORS.split(", ")] + more
    n = len(grid)
    run_kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def lists(column: pa.Array) -> list[np.ndarray]:
        off, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
        off = off - off[0] if len(off) else off
        return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(b)
            errors, done = b.column("error").to_pylist(), [bool(x) for x in b.column("already_processed").to_pylist()]
            axes, values = lists(b.column("axis")), lists(b.column("intensity"))
            raw, broken = [], []
            for i, (x, y) in enumerate(zip(axes, values, strict=True)):
                message = None
                if errors[i] is not None or not b.column("axis")[i].is_valid:
                    message = f"parse: {errors[i] or 'no data'}"
                elif len(x) != len(y):
                    message = "raw-preprocess: axis and values differ in length"
                broken.append(message)
                raw.append(even_segments(x, y, grid.step) if message is None else [])
            fixed = corrected([own if not done[i] else [] for i, own in enumerate(raw)], how)
            vectors, l2, runs, failure, made = np.zeros((2 * k, n), np.float32), np.zeros(2 * k), [], [], []
            for i in range(k):
                for v, own in ((0, raw[i]), (1, raw[i] if done[i] else fixed[i])):
                    vector, support = project(own, grid) if broken[i] is None else (None, [])
                    message = broken[i]
                    if message is None and not np.isfinite(vector).all():
                        message = f"{'baseline' if v else 'raw'}-preprocess: no finite numbers"
                    elif message is None and not (support and vector.any()):
                        message = "validation:unmatchable-row"
                    if message is None:
                        vectors[2 * i + v], l2[2 * i + v] = vector, np.linalg.norm(vector)
                    runs.append(support if message is None else [])
                    failure.append(message)
                    made.append(bool(v) and not done[i] and message is None)
            twice = pa.array(np.repeat(np.arange(k), 2))
            flat = [r for own in runs for r in own]
            spread = pa.StructArray.from_arrays([pa.array([r[j] for r in flat], pa.int32()) for j in (0, 1)], fields=list(run_kind))
            columns = [
                b.column("row_id").take(twice),
                pa.array(["DB-RAW", "DB-BC"] * k),
                *(b.column(c).take(twice) for c in ("name", "flag", "filename")),
                pa.array(np.repeat(np.array(done, bool), 2)),
                pa.array(made, pa.bool_()),
                pa.ListArray.from_arrays(pa.array(np.arange(2 * k + 1, dtype=np.int32) * n), pa.array(vectors.reshape(-1))),
                pa.array(l2),
                pa.array([own[0][0] if own else 0 for own in runs], pa.int32()),
                pa.array([own[-1][1] if own else -1 for own in runs], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32)), spread),
                pa.array(failure, pa.string()),
                *(b.column(c).take(twice) for c in more),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    typed = sources.select(*wanted, *more).withColumn("axis", F.col("axis").cast("array<double>")).withColumn("intensity", F.coalesce(F.col("intensity").cast("array<double>"), F.array().cast("array<double>")))
    kinds = ", ".join([VECTORS, *(f"`{c}` {sources.schema[c].dataType.simpleString()}" for c in more)])
    return typed.mapInArrow(run, kinds)


#: What a failure's category can be, as build_vectors names them.
FAILURES = ("parse", "raw-preprocess", "baseline-preprocess", "validation")


def _facts(grid: int) -> list[Column]:
    """What is counted of the rows while they are written."""
    raw, corrected, failed = F.col("variant") == "DB-RAW", F.col("variant") == "DB-BC", F.col("failure").isNotNull()
    kind = F.regexp_extract("failure", "^([^:]+)", 1)
    # Rows that stand for one source have one print; the sums of both variants agree where each row has its twin.
    print_of = F.xxhash64("row_id", F.coalesce("name", F.lit("")), F.coalesce("filename", F.lit(""))).cast("decimal(38,0)")
    out = [F.count_if(raw).alias("raw"), F.count_if(corrected).alias("corrected"), F.count_if(raw & ~failed).alias("valid"), F.count_if(F.size(row_rules(grid)) > 0).alias("broken")]
    out += [F.sum(F.when(side, print_of)).alias(f"prints_{name}") for name, side in (("raw", raw), ("corrected", corrected))]
    return out + [F.count_if(raw & failed & (kind == name)).alias(name) for name in FAILURES]


def gate(facts: dict, limit: float = 0.9) -> tuple[bool, str | None, float]:
    """(publish, leading failure, its share) of the counts of a build: some row is valid and no single failure reaches the limit."""
    leading = max(((facts[name], name) for name in FAILURES if facts[name]), default=(0, None))
    share = leading[0] / facts["raw"] if facts["raw"] else 0.0
    return facts["valid"] > 0 and share < limit, leading[1], share


def pair_available(spark: SparkSession, manifest: dict | None) -> bool:
    """Whether a manifest names files that are all there, with the sizes it says, and nothing else lies beside them."""
    return manifest is not None and all(listing(spark, manifest[place]) == manifest[files] for place, files in (("path", "files"), ("postings", "posting_files")) if manifest.get(place))


def build_pair(spark: SparkSession, sources: DataFrame, grid: Grid, folder: str, how: Baseline | None = None, inputs: str = "", failure_limit: float = 0.9, on_progress: Callable[[str, dict], None] | None = None, age: float = 60.0, wait: float = 3600.0) -> dict:
    """Write both variants under ``folder`` and, last, the manifest that makes them valid; returns it.

    One driver builds a pair at a time: it holds a lease, and one that waited finds the pair of the other.  A pair with a manifest for the same inputs, grid
    and baseline, whose files are all there, is used as it is; anything else at the place goes to quarantine.  Vectors are written to a staging folder of the builder, and
    counted while they are written: rows, twins, failures by category, broken rows.  These facts decide whether the pair is moved to its place; a build that failed leaves
    no pair, and one that lost its lease publishes nothing.  Where the sources have ``elements`` and ``has_formula`` their postings are kept beside the pair.
    ``on_progress`` is told of each stage and what is known then; what it raises doesn't matter to the build.
    """
    how, root = how or library_baseline(), folder.rstrip("/")
    name = signature({"inputs": inputs, "grid": grid.payload(), "baseline": how.payload()}, 12)
    final, marker, graveyard = f"{root}/{name}", f"{root}/{name}.json", f"{root}/quarantine"

    def tell(stage: str, facts: dict | None = None) -> None:
        if on_progress is not None:
            with contextlib.suppress(Exception):
                on_progress(stage, dict(facts or {}))

    def known() -> dict | None:
        try:
            out = read_json(spark, marker)
        except ValueError:  # a marker that holds no JSON
            return None
        except Py4JJavaError as e:
            if "ChecksumException" in str(e):
                return None
            raise
        return out if out is not None and out.get("name") == name and pair_available(spark, out) else None

    if (there := known()) is not None:
        tell("reused", there)
        return there
    with Lease(spark, f"{root}/{name}.lease", age, wait) as lease:
        if (there := known()) is not None:
            tell("reused", there)
            return there
        # Staging folders of builders that are gone; this lease says that no other is at work.
        for left in (marker, final, f"{final}.postings", *(f"{root}/{x}" for x in children(spark, root) if x.startswith(f"{name}.staging"))):
            quarantine(spark, left, graveyard)
        staged = f"{root}/{name}.staging-{lease.owner}"
        try:
            tell("writing")
            seen = Observation()
            build_vectors(sources, grid, how).observe(seen, *_facts(len(grid))).write.partitionBy("variant").parquet(staged)
            facts = {k: v or 0 for k, v in seen.get.items()}
            tell("written", facts)
            publish, leading, share = gate(facts, failure_limit)
            if not publish:
                raise ValueError(f"nothing to publish: {facts['valid']} valid rows, {leading} in {share:.0%}")
            if facts["raw"] != facts["corrected"] or facts["prints_raw"] != facts["prints_corrected"]:
                raise ValueError("the variants don't match row by row")
            if facts["broken"]:
                raise ValueError("rows break the rules of the grid")
            out = {"name": name, "path": final, "grid": grid.payload(), "baseline": how.payload(), "rows": facts["raw"], "valid": facts["valid"], "bytes_per_variant": facts["raw"] * len(grid) * 4, "inputs": inputs, "failures": {k: facts[k] for k in FAILURES if facts[k]}, "files": listing(spark, staged)}
            if {"elements", "has_formula"} <= set(sources.columns):
                postings.postings(sources).write.partitionBy("kind").parquet(f"{staged}.postings")
                out |= {"postings": f"{final}.postings", "posting_files": listing(spark, f"{staged}.postings")}
            lease.check()
            promote(spark, staged, final)
            if "postings" in out:
                promote(spark, f"{staged}.postings", out["postings"])
            write_json(spark, marker, out)
        except BaseException:
            for left in (staged, f"{staged}.postings"):
                quarantine(spark, left, graveyard)
            raise
        tell("published", out)
        return out


def load_pair(spark: SparkSession, manifest: dict, check: str = "files") -> tuple[DataFrame, DataFrame]:
    """(raw, corrected) of a published pair; reading one variant touches only its partition.

    "files": the files must be those of the manifest, and their footers must count its rows; no vector is read.  "rows": besides, each id must be there once, and vectors must be as
    long as the grid.  "none": nothing is looked at.  What doesn't agree is a ValueError.
    """
    if check not in ("files", "rows", "none"):
        raise ValueError(f"no such check: {check}")
    grid = Grid(**{k: v for k, v in manifest["grid"].items() if k != "kind"})
    wrong = lambda what: ValueError(f"the pair at {manifest['path']} isn't what its manifest says: {what}")
    if check != "none":
        if manifest["bytes_per_variant"] != manifest["rows"] * len(grid) * 4:
            raise wrong("bytes")
        if not pair_available(spark, manifest):
            raise wrong("files")
    rows = spark.read.parquet(manifest["path"])
    if check != "none":
        found = {r.variant: r["count"] for r in rows.groupBy("variant").count().collect()}
        if found != {"DB-RAW": manifest["rows"], "DB-BC": manifest["rows"]}:
            raise wrong(found)
    if check == "rows":
        facts = rows.groupBy("variant").agg(F.countDistinct("row_id").alias("ids"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"))
        for r in facts.collect():
            if (r.ids, r.least, r.most) != (manifest["rows"], len(grid), len(grid)):
                raise wrong(r.asDict())
    return rows.where("variant = 'DB-RAW'"), rows.where("variant = 'DB-BC'")
