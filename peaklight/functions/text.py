"""Column functions on names, formulas, header values and lines of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peaklight.functions.columns import once

#: A number with optional sign, fraction and exponent.
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: A line of at least two numbers and nothing else but separators.
NUMERIC_LINE = rf"^\s*{NUMBER}(?:[\s,;]+{NUMBER})+[\s,;]*$"


def formula_elements(formula: Column) -> Column:
    """Distinct sorted symbols [A-Z][a-z]?; none for an empty formula or one that begins with a question mark."""
    text = F.trim(F.coalesce(formula, F.lit("")))
    return F.when((text == "") | text.startswith("?"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Z][a-z]?)"), 1))))


def phase_key(name: Column) -> Column:
    """Trimmed, blanks united, lower case; a question mark if nothing is left."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " ")), F.lit("")), F.lit("?"))


def first_text(*columns: Column) -> Column:
    """The first of the columns that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def known_value(c: Column) -> Column:
    """Without quotes; empty where the value is stated as unknown by ? or a full stop."""
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^['\"]|['\"]$", ""))
    return F.regexp_replace(text, r"\A[?.]\z", "")


def number_or_null(c: Column) -> Column:
    return F.regexp_replace(known_value(c), ",", ".").try_cast("double")


def claim(c: Column) -> Column:
    """true, false or NULL (not stated)."""
    return once(F.lower(known_value(c)), lambda text: F.when(text.isin("yes", "y", "true", "1"), True).when(text.isin("no", "n", "false", "0"), False))


def processing(c: Column) -> Column:
    return once(F.lower(F.coalesce(c, F.lit(""))), lambda text: F.when(text.contains("processed"), "processed").when(text.contains("raw"), "raw").otherwise("unknown"))


def wavelength(token: Column) -> Column:
    """514-5 as 514.5; NULL if it isn't a number."""
    return F.regexp_replace(F.trim(token), "-", ".").try_cast("double")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def formula_display(formula: Column) -> Column:
    """Digits after a symbol as subscripts; digits after a middle dot or at the start stay."""
    text = F.regexp_replace(F.coalesce(formula, F.lit("")), r"[*•]", "·")
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(·?\d*\D*?[A-Za-z)\]]\d*|\D+|\d+)"), 1), lambda p: F.concat(F.regexp_extract(p, r"^(.*?)(\d*)$", 1), F.when(p.rlike(r"^\d+$|·\d*$"), F.regexp_extract(p, r"(\d*)$", 1)).otherwise(F.translate(F.regexp_extract(p, r"(\d*)$", 1), "0123456789", "₀₁₂₃₄₅₆₇₈₉"))))
    return F.array_join(parts, "")


def first_and_last_number(line: Column) -> Column:
    """struct(x, y) of a line of numbers, or NULL."""
    numbers = F.regexp_extract_all(line, F.lit(f"({NUMBER})"), 1)
    return F.when(line.rlike(NUMERIC_LINE), F.struct(F.element_at(numbers, 1).cast("double").alias("x"), F.element_at(numbers, -1).cast("double").alias("y")))


def loose(c: Column) -> Column:
    """Only a-z and 0-9, for comparing names."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def acquisition_group(explicit: Column, filename: Column, specimen: Column) -> Column:
    """The stated group; else the file name up to its raw/processed mark, as both come from one measurement; else the specimen."""
    stem = F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[A-Za-z]+$", "")
    paired = stem.rlike(r"(?i)__raman_data_(raw|processed)(__[0-9a-f]+)?$")
    prefix = F.regexp_replace(stem, r"(?i)__raman_data_(raw|processed)(__[0-9a-f]+)?$", "")
    return first_text(explicit, F.when(paired, prefix), specimen)


#: Names of the columns and provenance fields that tell which specimen a reference was measured on, best first.
ACCESSION = ("accession", "rruff_id", "rod_id", "source_accession")
SPECIMEN = ("independence_group", "specimen_id")
ORIGIN = ("source_accession", "source")


def independence_group(row: dict[str, Column], provenance: dict[str, Column], name: Column) -> Column:
    """The group within which references don't count as independent.

    ``row`` and ``provenance`` hold the known columns by field name.  A stated
    group or specimen comes first, of the row before that of its provenance; then an accession of either; then the
    source its provenance names; else all references of the phase are one unresolved group.
    """

    def first(fields: tuple[str, ...], *places: dict[str, Column]) -> Column:
        return first_text(*(place[f] for place in places for f in fields if f in place))

    origin, accession = first(ORIGIN, provenance), first(ACCESSION, row, provenance)
    return first_text(first(SPECIMEN, row, provenance), accession, F.when(origin != "", F.concat(F.lit("provenance-source:"), origin)), F.concat(F.lit("unresolved:"), phase_key(name)))


def element_tokens(text: Column) -> Column:
    """Distinct sorted element symbols of a list typed with blanks, commas or semicolons, each in its usual spelling."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,;]+"), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 10))))))


def switched(text: Column) -> Column:
    """true, yes, on, 1 as true and false, no, off, 0 and blank as false; any other text counts as true."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ~t.isin("false", "no", "off", "0", "")
