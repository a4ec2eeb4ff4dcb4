"""From traces to phases: roll-up, order, decision, annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peaklight.functions.text import phase_key
from peaklight.model import Evidence

ORDER = [F.col, ("aggregate_score", "median_group_score", "best_reference_score")]


def _phase_order() -> list:
    return [F.col(c).desc() for c in ORDER[1]] + [F.col("phase_key")]


def rank_phases(traces: DataFrame) -> DataFrame:
    """One row per phase from traces (row_id, name, specimen, acquisition, reference_id, rank_score, coverage_fraction, common, shift_boundary, grid_clipped).

    Traces of one acquisition are averaged; of a specimen the best acquisition
    counts (by mean, best trace, then the larger reference id); the phase's
    score is its best specimen's.  Coverage, common points and warnings come
    from the winning acquisitions of the two strongest specimens (ties: the smaller reference id first).
    All steps are partial aggregates or windows inside a phase.
    """
    keyed = traces.withColumn("phase_key", phase_key(F.col("name"))).withColumn("_spec", phase_key(F.col("specimen"))).withColumn("_acq", phase_key(F.col("acquisition")))
    keyed = keyed.withColumn("_ref", F.lower("reference_id"))
    acquisitions = keyed.groupBy("phase_key", "_spec", "_acq").agg(
        F.avg("rank_score").alias("score"),
        F.max("rank_score").alias("best"),
        F.expr("min_by(_ref, struct(-rank_score, _ref))").alias("ref"),
        F.avg("coverage_fraction").alias("mean_coverage"),
        F.min("coverage_fraction").alias("min_coverage"),
        F.min("common").alias("min_common"),
        F.bool_or("shift_boundary").alias("boundary"),
        F.bool_or("grid_clipped").alias("clipped"),
    )
    fields = ["score", "best", "ref", "mean_coverage", "min_coverage", "min_common", "boundary", "clipped"]
    specimens = acquisitions.groupBy("phase_key", "_spec").agg(F.max(F.struct(*fields)).alias("s")).select("phase_key", "_spec", "s.*")
    strength = Window.partitionBy("phase_key").orderBy(F.col("score").desc(), F.col("best").desc(), "ref")
    ranked = specimens.withColumn("_n", F.row_number().over(strength))
    two = F.col("_n") <= 2
    phases = ranked.groupBy("phase_key").agg(
        F.max("score").alias("aggregate_score"),
        F.expr("percentile(score, 0.5)").alias("median_group_score"),
        F.avg(F.when(two, F.col("mean_coverage"))).alias("mean_coverage_fraction"),
        F.min(F.when(two, F.col("min_coverage"))).alias("minimum_group_coverage_fraction"),
        F.min(F.when(two, F.col("min_common"))).cast("long").alias("minimum_group_common_point_count"),
        F.count("*").alias("independent_reference_count"),
        F.count_if(two & F.col("boundary")).alias("shift_boundary_group_count"),
        F.count_if(two & F.col("clipped")).alias("grid_boundary_clipped_group_count"),
    )
    traces_of = keyed.groupBy("phase_key").agg(
        F.max("rank_score").alias("best_reference_score"),
        F.count("*").alias("reference_variant_count"),
        F.expr("min_by(name, row_id)").alias("phase_name"),
        F.expr("min_by(row_id, struct(-rank_score, _ref))").alias("best_row_id"),
    )
    out = phases.join(traces_of, "phase_key")
    return out.withColumn("phase_rank", F.row_number().over(Window.orderBy(*_phase_order())).cast("long"))


def decide(phases: DataFrame, how: Evidence | None = None) -> DataFrame:
    """One row: status and reasons (in order, joined by commas) for ranked phases.

    First support, then the score, then what makes it ambiguous; an empty
    table is insufficient evidence.  Only the two best phases are looked at.
    """
    how = how or Evidence()
    best = phases.where("phase_rank = 1").select(*(F.col(c).alias(f"b_{c}") for c in phases.columns))
    second = phases.where("phase_rank = 2").select(*(F.col(c).alias(f"r_{c}") for c in phases.columns))
    one = phases.sparkSession.range(1).select(F.lit(1).alias("_one"))
    row = one.join(best, F.lit(True), "left").join(second, F.lit(True), "left")
    margin = F.col("b_aggregate_score") - F.col("r_aggregate_score")
    weak = F.array_compact(
        F.array(
            F.when(F.col("b_minimum_group_common_point_count") < how.min_common, "too_few_common_points"),
            F.when(F.col("b_minimum_group_coverage_fraction") < how.min_coverage, "insufficient_minimum_group_coverage"),
        )
    )
    comparable = F.coalesce((F.col("r_minimum_group_common_point_count") >= how.min_common) & (F.col("r_minimum_group_coverage_fraction") >= how.min_coverage), F.lit(False))
    unclear = F.array_compact(
        F.array(
            F.when(~comparable, "phase_separation_not_assessed").when(margin < how.min_margin, "leading_phase_margin_too_small"),
            F.when(F.col("b_independent_reference_count") < how.min_specimens, "too_few_independent_references"),
            F.when(F.lit(how.reject_boundary) & (F.col("b_shift_boundary_group_count") > 0), "leading_phase_has_shift_search_boundary_evidence"),
            F.when(F.lit(how.reject_clipping) & (F.col("b_grid_boundary_clipped_group_count") > 0), "leading_phase_has_grid_clipped_reference_support"),
        )
    )
    cases = [
        (F.col("b_phase_key").isNull(), "insufficient_evidence", F.array(F.lit("no_phase_candidates"))),
        (F.size(weak) > 0, "insufficient_evidence", weak),
        (F.col("b_aggregate_score") < how.min_score, "unknown_or_out_of_library", F.array(F.lit("phase_score_below_uncalibrated_guardrail"))),
        (F.size(unclear) > 0, "ambiguous", unclear),
    ]
    status, reasons = F.lit("supported_candidate"), F.array(F.lit("uncalibrated_evidence_guardrails_passed"))
    for test, name, why in reversed(cases):
        status, reasons = F.when(test, name).otherwise(status), F.when(test, why).otherwise(reasons)
    return row.select(
        status.alias("status"),
        F.col("b_phase_name").alias("best_phase"),
        F.col("b_aggregate_score").alias("best_score"),
        F.col("r_phase_name").alias("runner_up_phase"),
        F.col("r_aggregate_score").alias("runner_up_score"),
        margin.alias("score_margin"),
        F.array_join(reasons, ",").alias("reasons"),
    )


def annotate(traces: DataFrame, phases: DataFrame, decision: DataFrame) -> DataFrame:
    """Traces with their phase's rank and score and the decision; the two small sides join by key or as one row."""
    small = phases.select("phase_key", "phase_rank", F.col("aggregate_score").alias("phase_score"), F.col("median_group_score").alias("phase_median"), F.col("independent_reference_count").alias("phase_specimens"))
    out = traces.withColumn("phase_key", phase_key(F.col("name"))).join(small, "phase_key")
    return out.crossJoin(F.broadcast(decision.select(F.col("status").alias("evidence_status"), F.col("reasons").alias("evidence_reasons"))))


def actionable(decision: DataFrame) -> DataFrame:
    return decision.withColumn("actionable", F.col("status").isin("supported_candidate", "ambiguous"))
