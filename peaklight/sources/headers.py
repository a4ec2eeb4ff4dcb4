"""Header values and provenance of library files of two kinds: ##KEY=VALUE text, and CIF-like tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peaklight.functions.columns import once
from peaklight.functions.text import NUMBER, NUMERIC_LINE, claim, first_text, known_value, processing, wavelength

#: What notes say about corrections, as patterns.
CORRECTIONS = {"baseline": "(?i)baseline|background", "cosmic": "(?i)cosmic|spike", "smoothing": "(?i)smooth", "intensity": "(?i)intensity correct|response"}


def key_values(text: Column, limit: int = 256) -> Column:
    """Map of the leading ##KEY=VALUE lines, at most ``limit``; of equal keys the last."""
    lines = F.slice(F.split(text, "\r\n|\r|\n"), 1, limit)

    def leading(bare: Column) -> Column:
        stop = F.array_position(F.transform(bare, lambda x: x.startswith("##")), False)
        return once(stop, lambda n: F.when(n == 0, bare).otherwise(F.slice(bare, 1, F.greatest(n - 1, F.lit(0)).cast("int"))))

    def last(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda p, i: ~F.get(pairs, i + 1)["k"].eqNullSafe(p["k"]))
        return F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(p["i"].alias("i"), p["k"].alias("k"), p["v"].alias("v")))), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))

    head = once(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), leading)
    key, value = lambda x: F.upper(F.trim(F.regexp_extract(x, "^##([^=]*)=", 1))), lambda x: F.trim(F.regexp_extract(x, "^##[^=]*=(.*)$", 1))
    pairs = F.transform(F.filter(head, lambda x: x.contains("=")), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), value(x).alias("v")))
    # In order of key and place, the last of equal keys stands before another key.
    return F.map_from_entries(once(F.array_sort(pairs), last))


def text_meta(text: Column) -> Column:
    """struct(name, formula) of a ##KEY=VALUE file: the name up to a semicolon, the formula without underscores."""

    def of(m: Column) -> Column:
        name = known_value(F.trim(F.split(F.coalesce(m["NAMES"], m["NAME"], F.lit("")), ";")[0]))
        formula = F.regexp_replace(known_value(F.coalesce(m["IDEAL CHEMISTRY"], m["CHEMISTRY"], F.lit(""))), "_", "")
        return F.struct(F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")).alias("name"), F.coalesce(F.nullif(formula, F.lit("")), F.lit("?")).alias("formula"))

    return once(key_values(text), of)


def tag(text: Column, name: str) -> Column:
    """Value of a tag: on its line, on the next one, or between lines of a semicolon; '' where it is missing or unknown."""
    escaped = name.replace(".", r"\.")
    block = F.regexp_extract(text, rf"(?m)^{escaped}[ \t]*\r?\n;[ \t]*\r?\n?([\s\S]*?)\r?\n;", 1)
    inline = F.regexp_extract(text, rf"(?m)^{escaped}[ \t]+(\S.*?)[ \t]*\r?$", 1)
    below = F.regexp_extract(text, rf"(?m)^{escaped}[ \t]*\r?\n[ \t]*(?![_;])(?!loop_)(\S.*?)[ \t]*\r?$", 1)
    return first_text(known_value(block), known_value(inline), known_value(below))


def head(text: Column, lines: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n"), 1, lines), "\n")


def tag_meta(text: Column) -> Column:
    """struct(name, formula) of a tagged file, from its first 201 lines."""

    def of(top: Column) -> Column:
        name, formula = tag(top, "_chemical_name_mineral"), tag(top, "_chemical_formula_sum")
        return F.struct(F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")).alias("name"), F.coalesce(F.nullif(formula, F.lit("")), F.lit("?")).alias("formula"))

    return once(head(text, 201), of)


def text_provenance(text: Column, filename: Column, folder: Column) -> Column:
    """Provenance of a ##KEY=VALUE file: header map, tokens of the file name (exactly eight, by __), quality of the folder."""
    tokens = F.split(F.regexp_replace(filename, r"\.[A-Za-z]+$", ""), "__")
    notes = F.concat_ws(" ", F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.startswith("##")))

    def of(known: Column) -> Column:
        m, parts = known["m"], known["tokens"]
        token = lambda i: F.when(F.size(parts) == 8, F.get(parts, F.lit(i)))
        return F.struct(
            m.alias("header"),
            first_text(known_value(m["RRUFFID"]), token(1)).alias("reference_id"),
            wavelength(token(3)).alias("wavelength"),
            first_text(known_value(m["ORIENTATION"]), token(4)).alias("orientation"),
            processing(first_text(token(6), filename)).alias("processing"),
            F.regexp_extract(F.lower(folder), "(excellent|fair|poor|unrated)", 1).alias("quality"),
            F.when(F.lower(folder).contains("unoriented"), "unoriented").when(F.lower(folder).contains("oriented"), "oriented").otherwise("").alias("sample_orientation"),
            F.array_compact(F.array(*(F.when(known["notes"].rlike(p), k) for k, p in CORRECTIONS.items()))).alias("corrections"),
        )

    return once(F.struct(key_values(text).alias("m"), tokens.alias("tokens"), notes.alias("notes")), of)


def tag_provenance(text: Column) -> Column:
    """Provenance of a tagged file, from its first 512 lines."""

    def of(top: Column) -> Column:
        raw, done = top.contains("_raman_spectrum.raw_intensity"), top.rlike(r"(?m)^_raman_spectrum\.intensity\s*$")
        return F.struct(
            first_text(tag(top, "_rod_database.code"), tag(top, "_rod_database_code")).alias("reference_id"),
            F.regexp_extract(tag(top, "_raman_measurement_device.excitation_laser_wavelength"), f"({NUMBER})", 1).try_cast("double").alias("wavelength"),
            F.when(done, "processed").when(raw, "raw").otherwise("unknown").alias("processing"),
            F.lower(tag(top, "_raman_determination_method")).alias("determination"),
            claim(tag(top, "_raman_measurement.background_subtraction")).alias("background_subtracted"),
            claim(tag(top, "_raman_measurement.baseline_correction")).alias("baseline_corrected"),
        )

    return once(head(text, 512), of)


def meta(text: Column, path: Column) -> Column:
    return F.when(F.lower(path).endswith(".rod"), tag_meta(text)).otherwise(text_meta(text))


def quality_flag(stem: Column) -> Column:
    """s or x where the stem begins with it, in any case; else ''."""
    first = F.lower(F.substring(stem, 1, 1))
    return F.when(first.isin("s", "x"), first).otherwise("")


def sort_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, "^[sSxX]+", "")


def already_processed(stated: Column, filename: Column, builder: bool = False) -> Column:
    """Whether a file was processed before: by provenance, then file name; the library builder looks at the name first."""
    by_name = F.when(F.lower(filename).contains("processed"), True).when(F.lower(filename).contains("_raw"), False)
    by_record = F.when(stated == "processed", True).when(stated == "raw", False)
    return F.coalesce(by_name, by_record, F.lit(False)) if builder else F.coalesce(by_record, by_name, F.lit(False))


def body(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, axis, intensity from every numeric line: its first and its last number.  Files without any have NULL arrays."""
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(NUMERIC_LINE))
    pairs = F.transform(lines, lambda x: F.struct(F.element_at(F.regexp_extract_all(x, F.lit(f"({NUMBER})"), 1), 1).cast("double").alias("x"), F.element_at(F.regexp_extract_all(x, F.lit(f"({NUMBER})"), 1), -1).cast("double").alias("y")))
    out = files.select(key, F.array_sort(pairs).alias("p"))
    some = F.size("p") > 0
    return out.select(key, F.when(some, F.col("p.x")).alias("axis"), F.when(some, F.col("p.y")).alias("intensity"), F.when(~some, F.lit("no numeric lines")).alias("error"))


def loop_pairs(text: Column, least: int = 5) -> Column:
    """Array of (x, y) of a tagged file: of the loop that names the shift column if it has ``least`` rows, else of all lines of two or more numbers if these are as many; NULL otherwise."""
    loops = F.split(text, r"(?m)^\s*loop_\s*$")
    named = F.filter(loops, lambda b: b.contains("_raman_spectrum.raman_shift"))

    def pairs(block: Column) -> Column:
        rows = F.filter(F.split(block, "\r\n|\r|\n"), lambda x: x.rlike(NUMERIC_LINE))
        numbers = F.transform(rows, lambda x: F.regexp_extract_all(x, F.lit(f"({NUMBER})"), 1))
        return F.array_sort(F.transform(numbers, lambda n: F.struct(F.get(n, F.lit(0)).cast("double").alias("x"), F.get(n, F.lit(1)).cast("double").alias("y"))))

    own, every = pairs(F.get(named, F.lit(0))), pairs(text)
    return F.when(F.size(own) >= least, own).when(F.size(every) >= least, every)


def load_folder(spark, roots) -> tuple[DataFrame, DataFrame]:
    """(spectra, skipped) of the library files under the roots, in any depth.

    spectra: alias, path, stem, flag, name, formula, axis, intensity, in the order of the stems without their leading quality
    letters; skipped: path and error of those without numbers.  Texts are read as Latin-1, so no byte is an error.
    """
    from peaklight.sources.inventory import scan

    records, _ = scan(spark, roots)
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = None
    for folder in [p for _, p in (roots.items() if isinstance(roots, dict) else roots)]:
        own = texts.load(folder).select("path", F.decode("content", "ISO-8859-1").alias("value"))
        files = own if files is None else files.unionByName(own)
    files = files.join(records.select("path", "alias"), "path")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    known = files.select("path", "alias", stem.alias("stem"), meta(F.col("value"), F.col("path")).alias("m"))
    rows = known.join(body(files), "path")
    spectra = rows.where("error is null").select("alias", "path", "stem", quality_flag(F.col("stem")).alias("flag"), "m.name", "m.formula", "axis", "intensity")
    return spectra.orderBy(F.lower(sort_stem(F.col("stem"))), "path"), rows.where("error is not null").select("path", "error")


def plain_columns(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, axis, intensity of texts of blank-separated columns: # starts a comment, the first two columns count, lines where these aren't numbers go, the axis ascends."""
    cut = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n"), lambda x: F.split(F.trim(F.regexp_replace(x, "#.*$", "")), r"\s+"))
    pairs = F.transform(cut, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    good = F.array_sort(F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])))
    return files.select(key, good.alias("p")).select(key, F.col("p.x").alias("axis"), F.col("p.y").alias("intensity"))


def load_columns(spark, folder: str, glob: str = "*.txt") -> DataFrame:
    """path, axis, intensity of all files below a folder whose name fits the pattern, by plain_columns(); other files aren't read.  Texts are read as Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return plain_columns(files.select("path", F.decode("content", "ISO-8859-1").alias("value")))


def with_provenance(rows: DataFrame, cached: DataFrame, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(rows with provenance, what is still to be parsed).

    rows: key, path, size, modified and provenance (NULL where none is embedded); cached: path, size, modified, provenance, of
    files parsed before.  An embedded one comes first; a cached one counts only while size and time are the same.
    """
    known = cached.select("path", "size", "modified", F.col("provenance").alias("_cached"))
    out = rows.join(known, ["path", "size", "modified"], "left").withColumn("provenance", F.coalesce("provenance", "_cached")).drop("_cached")
    return out.select(rows.columns), out.where("provenance is null").select("path", "size", "modified").distinct()
