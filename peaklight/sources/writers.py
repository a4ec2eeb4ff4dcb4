"""Writers: spectra as text, manifests, and tables that appear whole or not at all."""

from __future__ import annotations

import hashlib
import json
import pathlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklight.functions.text import slug
from peaklight.model import canonical_json


def spectrum_text(axis: Column, intensity: Column, header: Column | None = None, decimals: int | None = 6, delimiter: str = "\t") -> Column:
    """Lines of x and y with fixed decimals (None: ten significant digits), below the header."""
    form = f"%.{decimals}f" if decimals is not None else "%.10g"
    if decimals is not None:
        rows = F.zip_with(axis, intensity, lambda x, y: F.format_string(f"{form}{delimiter}{form}", x, y))
    else:
        rows = F.zip_with(axis, intensity, lambda x, y: F.concat_ws(delimiter, F.expr("null").cast("string"), significant(x), significant(y)))
    text = F.array_join(rows, "\n")
    return text if header is None else F.when(F.length(header) > 0, F.concat(header, F.lit("\n"), text)).otherwise(text)


def significant(x: Column, digits: int = 10) -> Column:
    """At most ``digits`` significant digits, without trailing zeros."""
    scale = digits - 1 - F.floor(F.log10(F.abs(x)))
    value = F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * F.pow(F.lit(10.0), scale)) / F.pow(F.lit(10.0), scale))
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def write_spectra(rows: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One partition of text files per name."""
    rows.select(F.col(name), F.col(text).alias("value")).write.partitionBy(name).mode("errorifexists").text(folder)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place for ``name`` in the folder that driver and executors share: what spark.checkpoint.dir names, or on a machine of its own (master local) a temporary one."""
    import getpass
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or f'file://{tempfile.gettempdir()}/peaklight-core-{getpass.getuser()}').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_json(spark: SparkSession, path: str, value) -> None:
    """Written beside its place and moved over it in one step, so readers see the old content or the new one."""
    _, at = _fs(spark, path)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    temp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.writing")
    fs, _ = _fs(spark, path)
    out = fs.create(temp, True)
    out.write(bytearray(canonical_json(value).encode()))
    out.hsync() if hasattr(out, "hsync") else out.flush()
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    try:
        context.rename(temp, at, options)
    except Exception:
        fs.delete(temp, False)
        raise


def read_json(spark: SparkSession, path: str):
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def promote(spark: SparkSession, staged: str, final: str) -> None:
    """Move a finished folder to its place; never over something that is there."""
    fs, a = _fs(spark, staged)
    _, b = _fs(spark, final)
    if fs.exists(b):
        raise FileExistsError(final)
    if not fs.rename(a, b):
        raise OSError(f"can't move {staged} to {final}")


def listing(spark: SparkSession, folder: str) -> dict[str, int]:
    """The data files below a folder with their sizes, by relative path; as many as tasks wrote."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return {}
    top, out, files = fs.getFileStatus(at).getPath().toString().rstrip("/") + "/", {}, fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString().removeprefix(top)
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            out[name] = f.getLen()
    return out


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies right in a folder; none where there is no folder."""
    fs, at = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def claim(spark: SparkSession, path: str) -> bool:
    """Make a lock file; False if another driver holds it.  release() takes it away."""
    fs, at = _fs(spark, path)
    try:
        fs.create(at, False).close()
    except Exception as e:  # py4j wraps what the file system throws
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def release(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, False)


def quarantine(spark: SparkSession, path: str, folder: str) -> str | None:
    fs, a = _fs(spark, path)
    if not fs.exists(a):
        return None
    fs.mkdirs(_fs(spark, folder)[1])
    to = f"{folder.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}-{spark._jvm.java.lang.System.nanoTime()}"
    promote(spark, path, to)
    return to


def code_identity(folder: str) -> dict:
    """SHA-256 of the library's own files by relative path, and the commit that a plain .git folder above them names (None without one)."""
    root = pathlib.Path(folder).resolve()
    files = {p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}
    commit = None
    for place in (root, *root.parents):
        head = place / ".git" / "HEAD"
        if head.is_file():
            text = head.read_text().strip()
            ref = place / ".git" / text.removeprefix("ref: ")
            commit = ref.read_text().strip() if text.startswith("ref: ") and ref.is_file() else None if text.startswith("ref: ") else text
            break
    return {"files": files, "commit": commit}


def manifest(spark: SparkSession, settings: dict, inputs: dict, outputs: dict, code: str | None = None) -> dict:
    """What is needed to repeat a run; keys sorted, no NaN: settings, inputs, outputs, versions, time in UTC, and the code in the folder ``code``."""
    import datetime
    import platform

    import numpy
    import pandas
    import pyarrow

    versions = {"spark": spark.version, "python": platform.python_version(), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
    made = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = {"settings": settings, "inputs": inputs, "outputs": outputs, "versions": versions, "created_utc": made}
    return json.loads(canonical_json(out | ({"code": code_identity(code)} if code else {})))


def write_reports(declustered: DataFrame, folder: str, group: str = "name") -> None:
    """The reports of a thinned library as CSV: all spectra, the groups, and the detail of each group in a folder of its own."""
    from peaklight.operators.reduce import reduction_report

    rows = declustered.withColumn("group_slug", slug(F.col(group)))
    rows.orderBy(F.lower(group), "row_id").write.mode("errorifexists").option("header", "true").csv(f"{folder}/all_spectra")
    reduction_report(declustered, group).orderBy(F.lower(group)).write.mode("errorifexists").option("header", "true").csv(f"{folder}/groups")
    rows.repartition("group_slug").sortWithinPartitions("group_slug", "cluster", "row_id").write.mode("errorifexists").option("header", "true").partitionBy("group_slug").csv(f"{folder}/detail")


def copy_files(rows: DataFrame, folder: str, path: str = "path", to: str = "relative_path") -> DataFrame:
    """Copy the files that rows name by address to ``folder``, each under its relative path; returns path, to, bytes, error once they are copied.

    A task copies the files of its rows, through a name of the task's own that is then moved into place, so a task that runs again does no harm.  A file that can't be
    copied has an error; paths that lead out of the folder, and two rows for one place, are errors of the caller and raise.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from peaklight.sources.inventory import safe_relative

    spark = rows.sparkSession
    wanted = rows.select(F.col(path).alias("path"), F.col(to).alias("to"))
    wrong = wanted.where(~F.coalesce(safe_relative(F.col("to")), F.lit(False))).limit(1).collect()
    twice = wanted.groupBy("to").count().where("count > 1").limit(1).collect()
    if wrong or twice:
        raise ValueError(f"can't copy to {(wrong or twice)[0]['to']!r}")
    target = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import pyarrow.fs as pafs

        def at(uri: str):
            return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)

        for b in batches:
            sizes, errors = [], []
            for source, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    (a, here), (z, there) = at(source), at(f"{target}/{name}")
                    z.create_dir(os.path.dirname(there), recursive=True)
                    part = f"{there}.{uuid.uuid4().hex}.part"
                    with a.open_input_stream(here) as read, z.open_output_stream(part) as write:
                        n = 0
                        while chunk := read.read(1 << 20):
                            n += write.write(chunk)
                    z.move(part, there)
                    sizes.append(n)
                    errors.append(None)
                except (OSError, pa.ArrowException) as e:
                    sizes.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["path", "to", "bytes", "error"])

    done = wanted.mapInArrow(run, "path string, to string, bytes long, error string").collect()
    return spark.createDataFrame(done, "path string, to string, bytes long, error string")


def write_recall(summary: DataFrame, folder: str) -> None:
    """Recall by app and k as one CSV with a header; as long as there are apps and ks."""
    summary.coalesce(1).orderBy("app", "k").write.mode("errorifexists").option("header", "true").csv(folder)
