"""One query per operator family on the driver's tables.

embeddings serve as a library of 64-point spectra (label = phase), events as
irregular signals per user, the other tables as catalogues and logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peaklight.functions import columns as C
from peaklight.functions import text as T
from peaklight.model import Baseline, Grid, Matching, Query, Reduction, Smoothing, Trim
from peaklight.operators import catalog, evaluate, evidence, index, library, postings, reduce, refresh, residual, search, signal, snapshots, workflow
from peaklight.plans.match import match, residual_match, residual_of
from peaklight.sources import headers, inventory, measurement, writers
from peaklight.streaming import approvals

POINTS = 64
MASK = [2 <= i <= 61 for i in range(POINTS)]
FULL = [True] * POINTS
WIDE = Grid(0, POINTS - 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library: every third row has no stated runs, the others a gap of three points."""
    run = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    i = F.col("vec_id")
    start, end, gap = i % 8, 63 - i % 5, 20 + i % 7
    return table(spark, sf_dir, "embeddings").select(
        i.alias("row_id"),
        F.concat(F.lit("Phase "), "label").alias("name"),
        "label",
        (i % 7).cast("string").alias("specimen"),
        (i % 3).cast("string").alias("acquisition"),
        F.concat(F.lit("REF"), F.lpad(i.cast("string"), 8, "0")).alias("reference_id"),
        F.col("embedding").alias("vector"),
        start.cast("int").alias("start_idx"),
        end.cast("int").alias("end_idx"),
        F.when(i % 3 != 0, F.array(run(start, gap - 1), run(gap + 3, end))).alias("support_runs"),
    )


def whole(library_rows: DataFrame) -> DataFrame:
    return library_rows.withColumn("start_idx", F.lit(0)).withColumn("end_idx", F.lit(POINTS - 1)).withColumn("support_runs", F.lit(None).cast("array<struct<start:int,end:int>>"))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to three tasks for each core: a small file is one task else, however much is to be done for each row."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def query_vector(spark: SparkSession, sf_dir: str, row: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == row).select("embedding").first()[0])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal, x (hours since 2024), y."""
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / F.lit(3.6e9)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("signal"), hours.alias("x"), F.col("value").alias("y"))


def long(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "label", F.posexplode(C.doubles(F.col("vector"))).alias("pos", "v"))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def screen_topk(spark, sf_dir):
    rows = search.shortlist(search.screen(whole(lib(spark, sf_dir)), query_vector(spark, sf_dir), FULL, ["row_id", "name"]), 50)
    return rows.select("row_id", "name", *r6("screen"))


def screen_topk_ranged(spark, sf_dir):
    rows = search.shortlist(search.screen(lib(spark, sf_dir), query_vector(spark, sf_dir), MASK, ["row_id", "name"]), 50)
    return rows.select("row_id", "name", *r6("screen"))


def index_screen(spark, sf_dir):
    """Every row whose id is divisible by 50, as a table of queries against an index of all rows: the first 50 of each."""
    rows = lib(spark, sf_dir)
    built = index.build(rows, writers.shared_folder(spark, "index"), POINTS, ["name"])
    asked = rows.where("row_id % 50 = 0").select(F.col("row_id").alias("query"), "vector", F.array(*map(F.lit, MASK)).alias("mask"))
    blocks, _ = index.screen_many(built, asked)
    out = blocks[0]
    for block in blocks[1:]:
        out = out.union(block)
    return out.select("query", F.col("rank").cast("long").alias("rank"), "row_id", "name", *r6("screen"))


def coverage_filter(spark, sf_dir):
    return search.covered_enough(lib(spark, sf_dir), MASK, 0.85, 3, 58).select("row_id", "requested", "covered", *r6("coverage"))


def legacy_rank(spark, sf_dir):
    return search.legacy_rank(lib(spark, sf_dir), query_vector(spark, sf_dir)).select("row_id", *r6("score"))


def _aligned(spark, sf_dir):
    how = Matching(min_support=POINTS + 1)  # no peaks: the query is about shifts
    return search.refine(lib(spark, sf_dir), query_vector(spark, sf_dir), MASK, how, ["row_id"])


def shift_align(spark, sf_dir):
    return _aligned(spark, sf_dir).select("row_id", F.col("shift").cast("long").alias("shift"), F.col("common").cast("long").alias("common"), *r6("similarity", "shape", "gradient"), "shift_boundary", "grid_clipped")


def rank_components(spark, sf_dir):
    rows = _aligned(spark, sf_dir).select("row_id", "similarity", ((F.col("row_id") % 100) / 100).alias("pcs"))
    out = search.rank_components(rows).withColumn("final", search.final_score(F.when(F.col("row_id") % 2 == 0, F.col("composed")), F.col("similarity"), F.col("pcs")))
    return out.select("row_id", *r6("similarity_part", "pcs_part", "composed", "final"), "consistent")


def _traces(spark, sf_dir):
    rows = search.screen(search.coverage(lib(spark, sf_dir), MASK), query_vector(spark, sf_dir), MASK, ["row_id", "name", "specimen", "acquisition", "reference_id", "coverage", "covered"])
    i = F.col("row_id")
    return rows.select("row_id", "name", "specimen", "acquisition", "reference_id", F.round("screen", 6).alias("rank_score"), F.col("coverage").alias("coverage_fraction"), F.col("covered").alias("common"), (i % 11 == 0).alias("shift_boundary"), (i % 13 == 0).alias("grid_clipped"), F.round("screen", 6).alias("similarity"), ((i % 97) / 97).alias("pcs"))


def phase_rollup(spark, sf_dir):
    rows = evidence.rank_phases(_traces(spark, sf_dir))
    return rows.select("phase_rank", "phase_key", "phase_name", "best_row_id", *r6("aggregate_score", "median_group_score", "best_reference_score", "mean_coverage_fraction", "minimum_group_coverage_fraction"), "minimum_group_common_point_count", "independent_reference_count", "reference_variant_count", "shift_boundary_group_count", "grid_boundary_clipped_group_count")


def evidence_decision(spark, sf_dir):
    return evidence.decide(evidence.rank_phases(_traces(spark, sf_dir))).select("status", "best_phase", "runner_up_phase", *r6("best_score", "runner_up_score", "score_margin"), "reasons")


def _annotated(spark, sf_dir):
    traces = _traces(spark, sf_dir)
    phases = evidence.rank_phases(traces)
    return evidence.annotate(traces, phases, evidence.decide(phases))


def annotate_traces(spark, sf_dir):
    return _annotated(spark, sf_dir).select("row_id", "phase_key", "phase_rank", *r6("phase_score", "rank_score"), "phase_specimens", "evidence_status")


def diverse_topn(spark, sf_dir):
    rows = _annotated(spark, sf_dir).withColumn("identity", search.presentation_identity(F.lit(" "), F.concat(F.lit("id"), (F.col("row_id") % 400).cast("string")), F.col("row_id")))
    rows = rows.withColumn("phase_score", F.round("phase_score", 6))
    return search.diverse_top(rows, 40, Matching(slot_similarity=0.3)).select(F.col("place").cast("long").alias("place"), "row_id", "phase_key", *r6("rank_score", "pcs"))


def match_query(spark, sf_dir):
    """The whole search over both variants of the library."""
    raw = lib(spark, sf_dir).withColumn("variant", F.lit("DB-RAW"))
    corrected = signal.correct_baseline(raw.withColumn("variant", F.lit("DB-BC")), Baseline(lam=1e4), "vector").drop("baseline", "vector")
    corrected = corrected.withColumn("vector", F.col("corrected").cast("array<float>")).select(raw.columns)
    shown, _, _ = match({"DB-RAW": raw, "DB-BC": corrected}, Query(query_vector(spark, sf_dir), MASK), 60)
    return shown.select("place", "row_id", "variant", "name", "shift", "common", *r6("rank_score", "similarity", "pcs", "phase_score"), "phase_rank", "evidence_status", "evidence_reasons")


def residual_search(spark, sf_dir):
    """Subtract the query's best other row and search what is left without its phase."""
    rows = whole(lib(spark, sf_dir)).withColumn("variant", F.lit("DB-RAW"))
    query = Query(query_vector(spark, sf_dir), FULL)
    best = search.shortlist(search.screen(rows.where("row_id > 0"), query.vector, FULL, ["variant", "row_id", "name"]), 1)
    left = residual_of({"DB-RAW": rows}, query, best.withColumn("shift", F.lit(0)))
    shown, _, _ = residual_match({"DB-RAW": rows}, left.vector, left.usable, left.phase)
    return shown.select("place", "row_id", "name", "shift", *r6("rank_score", "similarity", "pcs"), "evidence_status")


def residual_projection(spark, sf_dir):
    """What the query keeps when each row of the library in turn is taken off."""
    runs = C.support_runs(F.col("support_runs"), F.col("start_idx"), F.col("end_idx"))
    rows = lib(spark, sf_dir).select("row_id", C.doubles(F.array(*map(F.lit, query_vector(spark, sf_dir)))).alias("q"), C.doubles(F.col("vector")).alias("c"), F.array(*map(F.lit, MASK)).alias("mask"), C.mask_of(runs, POINTS).alias("support"))
    out = residual.worth_searching(residual.project_vectors(rows))
    usable, size = F.size(F.filter("usable", lambda u: u)).cast("long"), F.aggregate("matching", F.lit(0.0), lambda s, x: s + F.abs(x))
    return out.select("row_id", "common_points", *r6("scale", "improvement", "negative_points", "negative_energy"), "worth", usable.alias("usable"), F.round(size, 6).alias("matching_size"))


def gap_segments(spark, sf_dir):
    return signal.segment_summary(signal.gap_segments(signals(spark, sf_dir))).select("signal", F.col("segment").cast("long").alias("segment"), "points", *r6("start", "end"))


def resample_grid(spark, sf_dir):
    cut = signal.gap_segments(signal.clean_xy(signals(spark, sf_dir)))
    return signal.resample(cut, 4.0).select("signal", F.col("segment").cast("long").alias("segment"), "grid", *r6("x", "y"))


def axis_quality(spark, sf_dir):
    return signal.axis_quality(signals(spark, sf_dir)).select("signal", "point_count", *r6("minimum", "maximum", "median_spacing", "spacing_cv"), "duplicate_count", "gap_count", *r6("saturation_fraction"), "warnings")


def duplicate_mean(spark, sf_dir):
    return signal.clean_xy(signals(spark, sf_dir).withColumn("x", F.floor(F.col("x") / 12).cast("long"))).select("signal", "x", "n_merged", *r6("y"))


def normalise(spark, sf_dir):
    rows = lib(spark, sf_dir).withColumn("v", C.doubles(F.col("vector")))
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    return rows.select("row_id", at(C.minmax(F.col("v")), 5).alias("minmax_5"), at(C.to_peak(F.col("v")), 5).alias("peak_5"), at(C.scaled(F.col("v")), 5).alias("scaled_5"), F.round(F.aggregate(C.minmax(F.col("v")), F.lit(0.0), lambda s, x: s + x), 6).alias("minmax_sum"))


def noise_sigma(spark, sf_dir):
    return signal.noise_sigma(signals(spark, sf_dir)).select("signal", "steps", *r6("sigma"))


def rolling_median(spark, sf_dir):
    return signal.rolling_median(signals(spark, sf_dir), 3).where("median is not null").select("signal", *r6("x", "median"))


def spikes(spark, sf_dir):
    return signal.spikes(signals(spark, sf_dir)).select("signal", "index", *r6("x", "y", "excess"))


def zero_trim(spark, sf_dir):
    return signal.zero_trim(signals(spark, sf_dir), 60.0).select("signal", *r6("first_x", "last_x"), "points", "above")


def first_jump(spark, sf_dir):
    return signal.first_jump(signals(spark, sf_dir), 50.0, 250.0).select("signal", *r6("jump_x", "jump"))


def peak_so_far(spark, sf_dir):
    rows = signals(spark, sf_dir).withColumn("from_x", F.lit(240.0))
    return signal.running_peak_after(rows, "from_x").select("signal", *r6("x", "peak_so_far"))


def local_peaks(spark, sf_dir):
    """Points above the one before and not below the one after, standing out of both by three per cent of the maximum."""
    w = Window.partitionBy("row_id").orderBy("pos")
    rows = long(lib(spark, sf_dir)).withColumn("before", F.lag("v").over(w)).withColumn("after", F.lead("v").over(w)).withColumn("top", F.max("v").over(Window.partitionBy("row_id")))
    weight = F.col("v") - F.greatest("before", "after")
    return rows.where("v > before and v >= after").withColumn("weight", weight).where("weight >= greatest(1e-6, 0.03 * top)").select("row_id", F.col("pos").cast("long").alias("pos"), *r6("v", "weight"))


def spearman(spark, sf_dir):
    """Rank agreement of each library row with the query, ties sharing their mean rank."""
    rows = long(lib(spark, sf_dir))
    q = rows.where("row_id = 0").select("pos", F.round("v", 1).alias("q"))
    pairs = rows.withColumn("v", F.round("v", 1)).join(F.broadcast(q), "pos")  # q: the points of one row
    mean = lambda c: F.rank().over(Window.partitionBy("row_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("row_id", c)) - 1) / 2
    ranked = pairs.select("row_id", mean("v").alias("a"), mean("q").alias("b"))
    return ranked.groupBy("row_id").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


def support_geometry(spark, sf_dir):
    """Runs united with a second set of runs, their points, and the points where a gradient is defined."""
    i = F.col("row_id")
    extra = F.array(F.struct((i % 40).cast("int").alias("start"), (i % 40 + 4).cast("int").alias("end")), F.struct((i % 40 + 5).cast("int").alias("start"), (i % 40 + 6).cast("int").alias("end")))
    rows = lib(spark, sf_dir).withColumn("own", C.support_runs(F.col("support_runs"), F.col("start_idx"), F.col("end_idx")))
    rows = rows.withColumn("merged", C.merged_runs(F.concat("own", extra)))
    count = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return rows.select("row_id", F.size("merged").cast("long").alias("runs"), C.run_points(F.col("merged")).cast("long").alias("points"), count(C.eroded(C.mask_of(F.col("merged"), POINTS))).alias("gradient_points"))


def true_runs(spark, sf_dir):
    rows = long(lib(spark, sf_dir)).withColumn("up", F.col("v") > 0)
    return signal.true_runs(rows, "up", "row_id").select("row_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "points")


def gradient(spark, sf_dir):
    rows = lib(spark, sf_dir).select("row_id", F.posexplode(C.gradient(C.shift(C.doubles(F.col("vector")), 2))).alias("pos", "g"))
    return rows.groupBy("row_id").agg(F.round(F.sum(F.abs("g")), 6).alias("variation"), F.round(F.max("g"), 6).alias("steepest"))


def subtract_reference(spark, sf_dir):
    """Each phase's mean taken off its rows, scaled."""
    rows = long(lib(spark, sf_dir))
    mean = rows.groupBy("label", "pos").agg(F.avg("v").alias("y"))
    spread = rows.select("row_id", "label", "pos", F.col("v").alias("y")).join(mean.withColumnRenamed("y", "m").where("pos % 4 <> 3"), ["label", "pos"], "left")
    ref = spread.where("m is not null").select(F.col("row_id").alias("signal"), F.col("pos").alias("grid"), F.col("m").alias("y"))
    own = spread.select(F.col("row_id").alias("signal"), F.col("pos").alias("grid"), "y")
    out = signal.subtract(own, ref, 0.5)
    return out.groupBy("signal").agg(F.round(F.sum("y"), 6).alias("sum_y"), F.round(F.max("overlap"), 6).alias("overlap"), F.count("*").alias("points"))


def spectrum_difference(spark, sf_dir):
    """Each row less half of the one that begins three points later and ends before, which keeps its end values beyond."""
    rows = _vectors(spark, sf_dir)
    cut = rows.withColumn("other_axis", F.slice("axis", 4, 58)).withColumn("other_intensity", F.slice("intensity", 4, 58))
    return signal.spectrum_difference(cut, 0.5).select("row_id", F.posexplode("difference").alias("pos", "d")).select("row_id", F.col("pos").cast("long").alias("pos"), *r6("d"))


def _elements(spark, sf_dir):
    """Parts as references: formulas from brand, type and size."""
    part = table(spark, sf_dir, "part")
    formula = F.when(F.col("p_partkey") % 9 == 0, "?").otherwise(F.concat(F.initcap(F.substring("p_name", 1, 2)), F.lit("2"), F.initcap(F.substring("p_type", 1, 2)), F.lit("O"), (F.col("p_size") % 4).cast("string")))
    rows = part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), formula.alias("formula"), (F.col("p_size") % 3 == 0).alias("already_processed"))
    return rows.withColumn("elements", T.formula_elements(F.col("formula"))).withColumn("has_formula", F.col("formula") != "?")


def _element_filter(mode: str, include: list[str], exclude: list[str], missing: bool, drop: bool):
    def run(spark, sf_dir):
        fits = search.element_policy(F.col("elements"), F.col("has_formula"), include, exclude, mode, missing)
        return search.eligible(_elements(spark, sf_dir), fits, drop).select("row_id", "formula", F.array_join("elements", ",").alias("elements"))

    return run


def element_index(spark, sf_dir):
    rows = _elements(spark, sf_dir).select("row_id", F.explode("elements").alias("element"))
    return rows.groupBy("element").agg(F.count("*").alias("rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def _posting_filter(mode: str, include: list[str], exclude: list[str], missing: bool, drop: bool):
    def run(spark, sf_dir):
        rows = _elements(spark, sf_dir)
        return postings.row_ids(postings.fitting(postings.postings(rows), include, exclude, mode, missing, drop))

    return run


def posting_counts(spark, sf_dir):
    return postings.counted(postings.postings(_elements(spark, sf_dir)))


def posting_join(spark, sf_dir):
    """References that hold no Sm and were not processed before, by their bits."""
    rows = _elements(spark, sf_dir)
    fits = postings.fitting(postings.postings(rows), [], ["Sm"], allow_missing=False, drop_processed=True)
    return postings.within(rows, fits).select("row_id", "name", "formula")


def formula_display(spark, sf_dir):
    return _elements(spark, sf_dir).select("row_id", T.formula_display(F.col("formula")).alias("shown"))


def phase_keys(spark, sf_dir):
    name = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   "), F.lower("p_brand"), F.lit(" "))
    rows = table(spark, sf_dir, "part").select(T.phase_key(F.when(F.col("p_partkey") % 50 == 0, " ").otherwise(name)).alias("phase_key"), T.slug(name).alias("slug"), "p_partkey")
    return rows.groupBy("phase_key").agg(F.count("*").alias("rows"), F.min("slug").alias("slug"), F.min("p_partkey").alias("first_row"))


def background_neutral(spark, sf_dir):
    rows = _elements(spark, sf_dir).withColumn("db_baseline", F.col("row_id") % 2 == 0)
    return search.background_neutral(rows, rows.where("not already_processed")).select("row_id", "name", "already_processed")


def _headers(spark, sf_dir):
    i = F.col("p_partkey")
    value = F.concat_ws("\n", F.concat(F.lit("##NAMES="), F.col("p_name"), F.lit("; other")), F.concat(F.lit("##RRUFFID=R"), F.lpad(i.cast("string"), 6, "0")), F.concat(F.lit("##IDEAL CHEMISTRY=Fe_2_O_"), (F.col("p_size") % 5).cast("string")), F.lit("##ORIENTATION='c axis'"), F.concat(F.lit("100.5, "), i.cast("string")), F.concat(F.lit("101.5, "), F.col("p_size").cast("string"), F.lit(", 7")), F.lit("##END="))
    kind = F.when(i % 2 == 0, "Raw").otherwise("Processed")
    name = F.concat(F.lit("Quartz__R"), i.cast("string"), F.lit("__Raman__514-5__90-000__ccw__Raman_Data_"), kind, F.lit("__abc.txt"))
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return part.select(i.alias("row_id"), value.alias("value"), name.alias("filename"), F.when(i % 3 == 0, "/lib/excellent_oriented").otherwise("/lib/fair_unoriented").alias("folder"))


def provenance_parse(spark, sf_dir):
    rows = _headers(spark, sf_dir)
    p = headers.text_provenance(F.col("value"), F.col("filename"), F.col("folder"))
    rows = rows.withColumn("p", p).withColumn("m", headers.text_meta(F.col("value")))
    return rows.select("row_id", F.col("m.name").alias("name"), F.col("m.formula").alias("formula"), F.col("p.reference_id").alias("reference_id"), F.round("p.wavelength", 3).alias("wavelength"), F.col("p.orientation").alias("orientation"), F.col("p.processing").alias("processing"), F.col("p.quality").alias("quality"), F.col("p.sample_orientation").alias("sample_orientation"), headers.already_processed(F.col("p.processing"), F.col("filename")).alias("already_processed"), T.acquisition_group(F.lit(""), F.col("filename"), F.lit("none")).alias("acquisition"))


def numeric_body(spark, sf_dir):
    rows = headers.body(_headers(spark, sf_dir), "row_id")
    return rows.select("row_id", F.size("axis").cast("long").alias("points"), F.get("axis", F.lit(0)).alias("x0"), F.get("intensity", F.lit(0)).alias("y0"), F.get("intensity", F.lit(1)).alias("y1"))


def _files(spark, sf_dir):
    """A text per user, of events in one of four layouts; every seventh ends in a broken line."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    i = F.col("user_id")
    sign = F.when(i % 4 == 0, ",").when(i % 4 == 1, "\t").when(i % 4 == 2, ";").otherwise(" ")
    number = F.format_string("%.2f", F.col("value"))
    line = F.concat(F.col("event_id").cast("string"), sign, F.when(i % 4 == 2, F.translate(number, ".", ",")).otherwise(number))
    text = rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).getField("l"), "\n").alias("t"))
    tail = F.when(i % 7 == 0, "\nbroken line").otherwise("")
    return text.select(F.col("user_id").alias("path"), F.concat(F.lit("# made\nshift"), sign, F.lit("counts\n"), "t", tail).alias("value"))


def delimiter_detect(spark, sf_dir):
    return measurement.detect_delimiter(measurement.lines_of(_files(spark, sf_dir)))


def measurement_parse(spark, sf_dir):
    rows = measurement.parse(_files(spark, sf_dir))
    total = F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x)
    return rows.select("path", "points", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.size("axis"), F.lit(0)).cast("long").alias("kept"), F.round(total, 4).alias("total"), F.get("axis", F.lit(0)).alias("x0"))


def spectrum_text(spark, sf_dir):
    rows = measurement.parse(_files(spark, sf_dir)).where("error is null")
    return rows.select("path", F.sha2(writers.spectrum_text(F.col("axis"), F.col("intensity"), F.lit("#head"), 3), 256).alias("sha"))


def catalog_summary(spark, sf_dir):
    return catalog.summary(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_type")


def unique_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("n", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return catalog.unique_names(rows, "n", "p_partkey")


def class_pivot(spark, sf_dir):
    rules = [("round", F.col("p_name").contains("ring")), ("sharp", F.col("p_name").rlike("bolt|gear")), ("small", F.col("p_size") < 10)]
    return catalog.class_pivot(table(spark, sf_dir, "part"), rules, "p_type")


def inventory_signature(spark, sf_dir):
    return catalog.inventory_signature(table(spark, sf_dir, "documents"), ["source", "doc_id", "n_chars"])


def inventory_changes(spark, sf_dir):
    """What differs between two scans of documents as files: some went, some came, some have another size or time."""
    i = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("alias"), i.cast("string").alias("relative_path"), "n_chars", "doc_id")
    before = files.where("doc_id % 5 <> 0").select("alias", "relative_path", F.col("n_chars").alias("size"), (i % 3).alias("modified"))
    after = files.where("doc_id % 7 <> 0").select("alias", "relative_path", F.when(i % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.when(i % 11 == 0, i % 3 + 1).otherwise(i % 3).alias("modified"))
    return refresh.change_set(before, after)


def root_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    path = F.concat(F.lit("/data/"), F.when(i % 3 == 0, "own/").when(i % 3 == 1, "own/deep/").otherwise("else/"), i.cast("string"), F.when(i % 5 == 0, "/../x").otherwise(""), F.lit(".txt"))
    roots = spark.createDataFrame([("OWN", "/data/own"), ("DEEP", "/data/own/deep/")], "alias string, root string")
    out = inventory.root_of(part.select("p_partkey", path.alias("path")), roots)
    return out.select("p_partkey", F.coalesce("alias", F.lit("")).alias("alias"), F.coalesce("relative_path", F.lit("")).alias("relative_path"), F.coalesce(inventory.safe_relative(F.col("relative_path")), F.lit(False)).alias("safe"))


def failure_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return catalog.failure_gate(rows, F.col("event_type").isin("error", "view"), F.concat_ws(":", "event_type", (F.col("user_id") % 3).cast("string"))).select("rows", "valid", "leading_failure", *r6("failure_share"), "publish")


def cache_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("entry"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"), F.col("o_orderdate").alias("mtime"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_orderkey") % 17 == 0).alias("active"))
    return catalog.cleanup_plan(rows, 60_000_000.0, group="owner").select("owner", "entry", "protected", "action")


def twin_check(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    other = raw.where("row_id % 10 <> 3").withColumn("name", F.when(F.col("row_id") % 20 == 1, "changed").otherwise(F.col("name")))
    return catalog.twin_check(raw, other, ["name", "brand"])


def broken_rows(spark, sf_dir):
    rows = lib(spark, sf_dir).withColumn("l2", F.when(F.col("row_id") % 31 == 0, -1.0).otherwise(1.0)).withColumn("end_idx", F.when(F.col("row_id") % 29 == 0, 70).otherwise(F.col("end_idx")))
    return catalog.broken_rows(rows, POINTS).select("row_id", F.array_join("broken", ",").alias("broken"))


def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.element_at(F.array(F.lit("x"), F.lit("s"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("flag"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("filename"))
    ask = spark.createDataFrame([("Red widget, small RING;no such\nblue bolt,red WIDGET",)], "request string")
    found, missing = catalog.name_lookup(rows, ask)
    out = found.select("key", "nth", "filename", "flag")
    return out.unionByName(missing.select(F.lower("name").alias("key"), F.lit(0).alias("nth"), F.lit("").alias("filename"), F.lit("missing").alias("flag"))).withColumn("nth", F.col("nth").cast("long"))


def name_lookup(spark, sf_dir):
    """Every candidate of each name, and the names without any."""
    return _candidates(spark, sf_dir)


name_lookup_all = name_lookup


def recall_at_k(spark, sf_dir):
    """Neighbours by two rankings of every row whose id is divisible by 50, against all rows; right when they share its phase; and the two together."""
    return recall_at_k_all(spark, sf_dir)


def recall_at_k_all(spark, sf_dir):
    """As recall_at_k, under its former name."""
    rows = lib(spark, sf_dir)
    asked = rows.where("row_id % 50 = 0")
    found = evaluate.nearest(rows.select("row_id", "vector"), asked.select("row_id", "vector"))
    ranked = found.join(rows.select("row_id", "label"), "row_id").join(asked.select(F.col("row_id").alias("query"), F.col("label").alias("truth")), "query")
    ranked = ranked.withColumn("hit", F.col("label") == F.col("truth"))
    return evaluate.recall_at_k(evaluate.combined(ranked, ["cosine", "city block"], "either")).select("app", F.col("k").cast("long").alias("k"), "hits", "total", *r6("percent", "half_width"))


def candidate_match(spark, sf_dir):
    """Whether a part's name hits a truth set, by loose comparison of names."""
    truths = F.array(F.lit("Red-Widget!"), F.lit("bolt"), F.lit("ri"))
    rows = table(spark, sf_dir, "part").select("p_partkey", T.loose(F.col("p_name")).alias("loose"), evaluate.hit(F.col("p_name"), truths).alias("hit"))
    return rows


def medoid(spark, sf_dir):
    return reduce.medoid(lib(spark, sf_dir)).select("label", "row_id", *r6("mean_distance"), "members")


def cluster_reps(spark, sf_dir):
    rows = lib(spark, sf_dir).withColumn("flag", F.lit("")).withColumn("fingerprint", F.when(F.col("row_id") % 41 != 0, C.doubles(F.col("vector"))))
    return reduce.decluster(rows, Reduction())


def cluster_in_passes(spark, sf_dir):
    """The whole library as one name, too large for a task: its clusters and representatives by passes over all rows."""
    rows = lib(spark, sf_dir).withColumn("name", F.lit("all")).withColumn("flag", F.lit("")).withColumn("fingerprint", F.when(F.col("row_id") % 41 != 0, C.doubles(F.col("vector"))))
    return reduce.decluster(rows, Reduction(), task_rows=0)


def workflow_stage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return workflow.stage_status(rows, "conv_id", "turn", "role", ["system", "user", "assistant"]).select("conv_id", "events", "next_stage", "stale")


def workflow_chain(spark, sf_dir):
    rows = workflow.chained(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"))
    return rows.select("conv_id", "turn", "signature", F.coalesce("parent", F.lit("")).alias("parent"), "content_repeated")


def _vectors(spark, sf_dir):
    return lib(spark, sf_dir).select("row_id", C.doubles(F.col("vector")).alias("intensity"), F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: i.cast("double")).alias("axis"))


def _total(c: str):
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)


def arpls(spark, sf_dir):
    return signal.correct_baseline(_vectors(spark, sf_dir), Baseline()).select("row_id", _total("baseline").alias("baseline_sum"), _total("corrected").alias("corrected_sum"))


def iasls(spark, sf_dir):
    return signal.correct_baseline(_vectors(spark, sf_dir), Baseline.named("ALS")).select("row_id", _total("baseline").alias("baseline_sum"), _total("corrected").alias("corrected_sum"))


def savgol(spark, sf_dir):
    """Window 5, order 3: a fixed weighted sum in the middle, the cubic of the first or last five points at the ends."""
    return signal.smooth(_vectors(spark, sf_dir), Smoothing()).select("row_id", F.posexplode("smoothed").alias("pos", "y")).select("row_id", F.col("pos").cast("long").alias("pos"), *r6("y"))


def savgol_edges(spark, sf_dir):
    """The two points at either end: the cubic through the first or last five points by least squares."""
    rows = signal.smooth(_vectors(spark, sf_dir), Smoothing()).select("row_id", F.posexplode("smoothed").alias("pos", "y"))
    return rows.where("pos not between 2 and 61").select("row_id", F.col("pos").cast("long").alias("pos"), *r6("y"))


def _diagnosed(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", *r6(*signal.DIAGNOSTICS), _total("processed").alias("processed_sum"))


def preprocess(spark, sf_dir):
    return _diagnosed(signal.preprocess(_vectors(spark, sf_dir), Baseline(), Smoothing()))


def preprocess_plain(spark, sf_dir):
    """Without a baseline: smoothing and the diagnostics."""
    return _diagnosed(signal.preprocess(_vectors(spark, sf_dir), Baseline.named("none"), Smoothing()))


def denoise_guard(spark, sf_dir):
    return signal.denoise(_vectors(spark, sf_dir), lambda x: x * 0.9 + 0.05).select("row_id", _total("denoised").alias("denoised_sum"))


def denoise_batches(spark, sf_dir):
    """A model that takes many windows at once; its proposals are guarded."""
    rows = signal.denoise_in_batches(_vectors(spark, sf_dir), "shrink", lambda: lambda x: x * 0.9 + 0.05)
    return rows.select("row_id", _total("denoised").alias("denoised_sum"))


def edge_trim(spark, sf_dir):
    return signal.trim_edges(_vectors(spark, sf_dir), Trim(edge_range=10, return_range=12)).select("row_id", "keep_from", "keep_to")


def peak_consistency(spark, sf_dir):
    rows = search.refine(lib(spark, sf_dir), query_vector(spark, sf_dir), MASK, Matching(), ["row_id"])
    return search.self_consistency(rows).select("row_id", *r6("pcs", "pcs_f1", "pcs_rho", "rank_score"), F.size("broken").alias("broken_rules"))


def _built(spark, sf_dir):
    rows = lib(spark, sf_dir).select("row_id", "name", F.lit("").alias("flag"), "reference_id", (F.col("row_id") % 4 == 0).alias("already_processed"), C.doubles(F.col("vector")).alias("intensity"))
    axis = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: (i + F.when(i >= 40, 15).otherwise(0)).cast("double"))
    rows = rows.withColumnRenamed("reference_id", "filename").withColumn("axis", F.when(F.col("row_id") % 50 != 7, axis)).withColumn("error", F.when(F.col("row_id") % 50 == 7, "no numeric rows"))
    return library.build_vectors(rows, Grid(0, 90, 1))


def library_build(spark, sf_dir):
    return _built(spark, sf_dir).select("row_id", "variant", "db_baseline", *r6("l2"), "start_idx", "end_idx", F.size("support_runs").alias("runs"), F.coalesce("failure", F.lit("")).alias("failure"))


def library_build_raw(spark, sf_dir):
    """The variant as measured, and of the corrected one the rows that were processed before and so equal it."""
    rows = _built(spark, sf_dir).where("variant = 'DB-RAW' or already_processed")
    long_ = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("row_id", "variant", "db_baseline", *r6("l2"), long_("start_idx"), long_("end_idx"), F.size("support_runs").cast("long").alias("runs"), F.coalesce("failure", F.lit("")).alias("failure"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


def result_rows(spark, sf_dir):
    """What a result states about its alignment and the parts of its rank."""
    how = Matching(min_support=POINTS + 1)  # no peaks: all of it can be said in SQL
    rows = search.refine(lib(spark, sf_dir), query_vector(spark, sf_dir), MASK, how, ["row_id", "name"])
    out = search.result_rows(rows, how, 2.0)
    counts = [F.col(c).cast("long").alias(c) for c in ("support_points", "shifted_support_points", "maximum_shift_points")]
    return out.select("row_id", "independence_group", "acquisition_group", *counts, *r6("shift_cm1", "reference_overlap_fraction", "shape_contribution", "gradient_contribution", "pcs_contribution", "spectral_similarity_weight"))


def result_faults(spark, sf_dir):
    """Result rows of which each breaks another rule, by its number; what is found to be wrong with them."""
    how, c, k = Matching(min_support=POINTS + 1), F.col, F.col("row_id") % 12
    rows = search.result_rows(search.refine(lib(spark, sf_dir), query_vector(spark, sf_dir), MASK, how, ["row_id", "name"]), how, 2.0)
    for at, name, value in (
        (1, "pcs_f1", F.lit(float("nan"))),
        (2, "maximum_shift_points", F.lit(-1)),
        (3, "shift_boundary", F.lit(None).cast("boolean")),
        (4, "shift_cm1", c("shift_cm1") + 1),
        (5, "shape_contribution", c("shape_contribution") + 0.5),
        (6, "requested", c("common") - 1),
        (7, "reference_overlap_fraction", c("reference_overlap_fraction") / 2),
        (8, "support_points", F.lit(0)),
        (9, "grid_clipped", ~c("grid_clipped")),
        (10, "rank_score", c("rank_score") + 0.25),
    ):
        rows = rows.withColumn(name, F.when(k == at, value).otherwise(c(name)))
    return search.self_consistency(rows, step=2.0).select("row_id", F.array_join("broken", "; ").alias("broken"))


def frozen_rows(spark, sf_dir):
    """Library rows frozen as they are, nested supports and nulls included, with one value thawed by its path."""
    rows = lib(spark, sf_dir).select(F.col("row_id").alias("place"), "row_id", "support_runs", "label", F.struct("specimen", F.lit(None).cast("string").alias("accession")).alias("provenance"))
    kept = snapshots.freeze(rows, [])
    return kept.select("place", "digest", F.coalesce(snapshots.at("$.support_runs[1].start", "int"), F.lit(-1)).cast("long").alias("second_run"))


def legacy_search(spark, sf_dir):
    q = query_vector(spark, sf_dir)
    return search.legacy_search(_vectors(spark, sf_dir), [float(i) for i in range(POINTS)], q).select("row_id", *r6("score"))


def fingerprints(spark, sf_dir):
    """Fingerprints of the library's spectra on an axis of their own; some can't be read, some lie outside of the grid."""
    i = F.col("row_id")
    axis = F.transform("axis", lambda x: x * 4 + F.when(i % 13 == 0, 5000.0).otherwise(40.0))
    rows = _vectors(spark, sf_dir).withColumn("axis", F.when(i % 17 != 0, axis)).withColumn("error", F.when(i % 17 == 0, "no numeric lines"))
    out = reduce.fingerprints(rows, Reduction())
    return out.select("row_id", "outside", F.coalesce("failure", F.lit("")).alias("failure"), *r6("x_min", "x_max"), F.coalesce(F.size("fingerprint"), F.lit(-1)).alias("points"), _total("fingerprint").alias("fingerprint_sum"))


def _references(spark, sf_dir):
    """Parts as references whose specimen, accession and source are stated here or there, or nowhere."""
    i, none = F.col("p_partkey"), F.lit(None).cast("string")
    text = lambda cond, prefix: F.when(cond, F.concat(F.lit(prefix), (i % 50).cast("string"))).otherwise(none)
    provenance = F.struct(text(i % 5 == 0, "S").alias("specimen_id"), text(i % 7 == 0, "A").alias("accession"), text(i % 3 == 0, " source ").alias("source"))
    return table(spark, sf_dir, "part").select(i.alias("row_id"), F.col("p_name").alias("name"), F.when(i % 11 == 0, "  ").otherwise(text(i % 4 == 0, "G")).alias("independence_group"), text(i % 13 == 0, "R").alias("rruff_id"), provenance.alias("provenance"))


def independence_groups(spark, sf_dir):
    """The group of each reference and how many references each kind of statement decides."""
    rows = _references(spark, sf_dir)
    row = {c: F.col(c) for c in ("independence_group", "rruff_id")}
    provenance = {c: F.col(f"provenance.{c}") for c in ("specimen_id", "accession", "source")}
    return rows.select("row_id", T.independence_group(row, provenance, F.col("name")).alias("independent"))


def signature_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return workflow.signature_chain(rows, "conv_id", "turn", "role", "size", ["system", "user", "assistant"]).select("conv_id", "stage", F.col("place").cast("long").alias("place"), "parent", "signature")


def approved_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("size", F.length("text") % 4)
    return workflow.approved_chain(rows, "conv_id", "turn", "role", "size", ["system", "user", "assistant"]).withColumn("place", F.col("place").cast("long"))


def approval_stream(spark, sf_dir):
    """The chains that a stream of all turns leaves, by its outcomes."""
    names, place = ["system", "user", "assistant"], writers.shared_folder(spark, "approvals")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") % 4).alias("size"))
    # The batches follow the turns, as they would arrive.
    for i, part in enumerate((F.col("turn") < 3, F.col("turn") >= 3)):
        turns.where(part).write.parquet(f"{place}/events/{i}")
        approvals.run(spark, f"{place}/events/*", turns.schema, f"{place}/out", f"{place}/state", "conv_id", "turn", "role", "size", names)
    return approvals.latest(spark.read.parquet(f"{place}/out"), "conv_id", names).withColumn("place", F.col("place").cast("long"))


def truth_sets(spark, sf_dir):
    """Base names and the names that count as right, for spectra named after parts."""
    i = F.col("p_partkey")
    spectrum = F.concat(F.initcap("p_name"), F.when(i % 3 == 0, F.lit("_")).otherwise(F.lit(" ")), F.when(i % 4 != 0, (i % 9).cast("string")).otherwise(F.lit("run")))
    truths = evaluate.truth_set(spectrum, {"redwidget": ["widget", "red widget"]})
    return table(spark, sf_dir, "part").select("p_partkey", evaluate.base_name(spectrum).alias("base"), F.array_join(truths, "|").alias("truths"))


def ranked_sheet(spark, sf_dir):
    """A sheet with two blocks of three ranks per app, read into one row per candidate."""
    top = [(0, ["", "Alpha", "Search", "", "Beta", "", "", "Alpha", "search", ""]), (1, ["", "1", "2", "3", "1.0", "2", "3", "1", "2", "3"])]
    head = spark.createDataFrame(top, "line long, cells array<string>")
    i, text = F.col("p_partkey"), lambda k: F.when((F.col("p_partkey") + k) % 5 == 0, "x").otherwise(F.concat(F.lit(f"c{k} "), F.col("p_name")))
    rows = table(spark, sf_dir, "part").select((i + 10).alias("line"), F.array(F.concat(F.lit("s"), i.cast("string")), *(text(k) for k in range(9))).alias("cells"))
    out = evaluate.ranked_sheet(head.unionByName(rows), [(("alpha", "search"), "Alpha Search")], 3)
    return out.select("spectrum", "app", F.col("rank").cast("long").alias("rank"), "candidate")


def ranked_sheets(spark, sf_dir):
    """A sheet for each brand, with its blocks of three ranks beside the brand's number of other columns; some sheets have no ranks."""
    i, k = F.col("p_partkey"), F.regexp_extract("p_brand", "([0-9])$", 1).cast("int") % 3
    part = table(spark, sf_dir, "part").select("p_brand", i.alias("i"), "p_name", k.alias("k"))
    blank = lambda c: F.concat(F.array_repeat(F.lit("-"), F.col("k") + 1), c)
    text = lambda n: F.when((F.col("i") + n) % 5 == 0, "x").otherwise(F.concat(F.lit(f"c{n} "), F.col("p_name")))
    rows = part.select(F.col("p_brand").alias("path"), F.lit("s").alias("sheet"), (F.col("i") + 10).alias("line"), F.concat(F.array(F.concat(F.lit("s"), F.col("i").cast("string"))), blank(F.array(*map(text, range(6))))).alias("cells"))
    brands = part.select("p_brand", "k").distinct()
    fixed = lambda line, *cells: brands.select(F.col("p_brand").alias("path"), F.lit("s").alias("sheet"), F.lit(line).cast("long").alias("line"), F.concat(F.array(F.lit("")), blank(F.array(*map(F.lit, cells)))).alias("cells"))
    heads = fixed(0, "Alpha", "Search", "", "Beta", "", "").unionByName(fixed(1, "1", "2", "3", "1.0", "2", "3").where("path <> 'Brand#11'"))
    found, bare = evaluate.ranked_sheets(heads.unionByName(rows), [(("alpha", "search"), "Alpha Search")], 3)
    out = found.select("path", "spectrum", "app", F.col("rank").cast("long").alias("rank"), "candidate")
    return out.unionByName(bare.select("path", F.lit("").alias("spectrum"), F.lit("none").alias("app"), F.lit(0).cast("long").alias("rank"), F.col("error").alias("candidate")))


def resolve_sources(spark, sf_dir):
    """Where parts' files are, by what is stated, by old paths and by unique names."""
    i = F.col("p_partkey")
    name = F.concat(F.lit("f"), i.cast("string"), F.lit(".txt"))
    parts = table(spark, sf_dir, "part")
    records = parts.where("p_partkey % 6 <> 5").select(F.when(i % 2 == 0, "Own").otherwise("ref").alias("alias"), F.concat(F.lit("sub/"), name).alias("relative_path"))
    rows = parts.select(
        i.alias("row_id"),
        F.when(i % 4 == 0, "OWN").alias("source_alias"),
        F.when(i % 8 == 0, F.concat(F.lit("sub/"), name)).when(i % 4 == 0, "../x").alias("source_path"),
        F.when(i % 5 == 0, F.concat(F.lit("/DATA/own/sub/"), name)).when(i % 3 == 0, F.concat(F.lit("C:\\old\\ref\\sub\\"), name)).alias("path"),
        name.alias("filename"),
    )
    out = inventory.resolve_sources(rows, {"Own": "/data/own", "ref": "/data/lib/reference"}, records)
    return out.select("row_id", F.coalesce("alias", F.lit("")).alias("alias"), F.coalesce("relative_path", F.lit("")).alias("relative_path"), "how", F.coalesce(F.col("known").cast("string"), F.lit("")).alias("known"))


def cached_provenance(spark, sf_dir):
    """Rows with the provenance they hold or that was parsed of the same file before; the rest is to be parsed."""
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(i.alias("row_id"), (i % 100).cast("string").alias("path"), (i % 100).alias("size"), (i % 3).alias("modified"), F.when(i % 4 == 0, F.struct(F.lit("own").alias("source"))).alias("provenance"))
    cached = spark.range(0, 100, 2).select(F.col("id").cast("string").alias("path"), F.col("id").alias("size"), F.lit(1).alias("modified"), F.struct(F.lit("cache").alias("source")).alias("provenance"))
    known, rest = headers.with_provenance(rows.withColumn("modified", F.col("modified").cast("int")), cached)
    out = known.select(F.col("row_id").cast("string").alias("item"), F.coalesce("provenance.source", F.lit("none")).alias("source"))
    return out.unionByName(rest.select(F.concat_ws("/", "path", F.col("modified").cast("string")).alias("item"), F.lit("to parse").alias("source")))


def plain_columns(spark, sf_dir):
    """Blank-separated columns with comments and lines that aren't numbers."""
    i = F.col("p_partkey")
    text = F.concat(F.lit("# "), F.col("p_name"), F.lit("\nx y\n"), (i + 2).cast("string"), F.lit("  3.5 9 # end\n"), i.cast("string"), F.lit("\t1e1\r\nnan 4\n7\n"))
    out = headers.plain_columns(table(spark, sf_dir, "part").select(i.alias("path"), text.alias("value")))
    return out.select("path", F.size("axis").cast("long").alias("points"), F.get("axis", F.lit(0)).alias("first_x"), F.get("intensity", F.lit(0)).alias("first_y"), F.get("intensity", F.lit(1)).alias("last_y"))


def config_values(spark, sf_dir):
    """Element lists as typed and switches as text."""
    i = F.col("p_partkey")
    typed = F.concat(F.upper(F.substring("p_name", 1, 2)), F.lit("; o,"), F.lower(F.substring("p_type", 1, 2)), F.lit("  O "))
    switch = F.element_at(F.array(*map(F.lit, [" Yes", "off", "", "1", "maybe", "FALSE"])), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.element_tokens(typed), ",").alias("elements"), T.switched(switch).alias("on"))


def quoted_fields(spark, sf_dir):
    """Fields of lines with quotes that hold the delimiter."""
    i = F.col("p_partkey").cast("string")
    line = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), i, F.lit('""" , '), i, F.lit(',"'), i, F.lit('",,x'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(measurement.fields(line, "comma"), "|").alias("fields"))


element_filter_all = _element_filter("must_include_all", ["O", "Re"], ["Sm"], True, False)
element_filter_only = _element_filter("only_from_list", ["O", "Re", "Bl", "Ec", "Sm", "St"], [], False, True)
posting_filter_all = _posting_filter("must_include_all", ["O", "Re"], ["Sm"], True, False)
posting_filter_only = _posting_filter("only_from_list", ["O", "Re", "Bl", "Ec", "Sm", "St"], [], False, True)
posting_filter_exact = _posting_filter("exact_set", ["O", "Re", "Ec"], [], False, False)
element_filter_exact = _element_filter("exact_set", ["O", "Re", "Ec"], [], False, False)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name not in ("table", "lib", "whole", "query_vector", "signals", "long", "r6")
}
