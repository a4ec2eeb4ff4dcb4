"""State of an analysis: approvals in a chain of stages, kept as immutable values or as a table of events."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklight.model import signature

STAGES = ("input", "baseline", "smoothing", "matching")


@dataclass(frozen=True)
class Workflow:
    """Approved signatures by stage, and the signature the last result was made with."""

    approved: dict[str, str] = field(default_factory=dict)
    result: str | None = None
    snapshots: tuple = ()

    def apply(self, stage: str, config: dict) -> Workflow:
        """Approve a stage.  The same signature changes nothing; another one takes later approvals back, not the result."""
        at = STAGES.index(stage)
        if at and STAGES[at - 1] not in self.approved:
            raise ValueError(f"{stage} needs {STAGES[at - 1]} to be approved first")
        new = signature([self.approved[STAGES[at - 1]] if at else "", stage, config])
        if self.approved.get(stage) == new:
            return self
        return replace(self, approved={**{s: self.approved[s] for s in STAGES[:at] if s in self.approved}, stage: new})

    def replace_input(self) -> Workflow:
        return Workflow()

    def record(self, rows: list) -> Workflow:
        """Freeze a result; an empty one is a result too."""
        if self.next_stage is not None:
            raise ValueError("matching isn't approved")
        return replace(self, result=self.approved["matching"], snapshots=(*self.snapshots, (self.approved["matching"], tuple(rows))))

    @property
    def next_stage(self) -> str | None:
        return next((s for s in STAGES if s not in self.approved), None)

    @property
    def stale(self) -> bool:
        return self.result is not None and self.result != self.approved.get("matching")


def signature_chain(events: DataFrame, key: str, order: str, stage: str, content: str, names: list[str]) -> DataFrame:
    """key, stage, place, parent, signature of the latest approval of each stage.

    A signature is the hash of its parent's signature, the stage and its content, so a change shows in all stages after it.
    The chain ends where a stage has no approval, or one older than its parent's.  A key has one row for each stage
    at most, whatever the length of its log: the latest are taken by partial aggregation, and the chain runs over those.
    """
    last = events.where(F.col(stage).isin(names)).groupBy(key).agg(*(F.max(F.when(F.col(stage) == n, F.struct(F.col(order).alias("at"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content")))).alias(f"_s{i}") for i, n in enumerate(names)))
    rows, parent, before, open_ = [], F.lit(""), None, F.lit(True)
    for i, n in enumerate(names):
        own = F.col(f"_s{i}")
        open_ = open_ & own.isNotNull() & (F.lit(True) if before is None else F.coalesce(own["at"] >= before, F.lit(False)))
        last = last.withColumn(f"_g{i}", F.when(open_, F.sha1(F.concat_ws("|", parent, F.lit(n), own["content"]))))
        rows.append(F.struct(F.lit(n).alias("stage"), F.lit(i).alias("place"), parent.alias("parent"), F.col(f"_g{i}").alias("signature")))
        parent, before = F.col(f"_g{i}"), own["at"]
    return last.select(key, F.explode(F.array(*rows)).alias("_r")).where("_r.signature is not null").select(key, "_r.*")


def approved_chain(events: DataFrame, key: str, order: str, stage: str, content: str, names: list[str]) -> DataFrame:
    """key, stage, place, parent, signature of what a log of approvals leaves, by the rules of Workflow.apply.

    A stage counts from the last change of the one before it: approvals before that were taken back, and repeating what is approved changes nothing.  So stage by stage
    only three times are needed for each key: the latest approval, the last one with another content, and the first one behind that, which is the change.  All
    are aggregates, so a log of any length may belong to one key.  Events of one key have different places in ``order``; of equal ones the greatest content counts.
    """
    rows = events.where(F.col(stage).isin(names) & F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("t"), F.col(stage).alias("s"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("c"))
    rows = rows.groupBy("k", "t", "s").agg(F.max("c").alias("c"))
    out, before = None, None
    for i, name in enumerate(names):
        own = rows.where(F.col("s") == name).select("k", "t", "c")
        if before is not None:
            own = own.join(before.select("k", "since", "g"), "k").where("t > since")
        else:
            own = own.withColumn("g", F.lit(""))
        last = own.groupBy("k").agg(F.max_by("c", "t").alias("now"))
        other = own.join(last, "k").groupBy("k").agg(F.max(F.when(F.col("c") != F.col("now"), F.col("t"))).alias("other"))
        change = own.join(last, "k").join(other, "k").where("other is null or t > other").groupBy("k").agg(F.min("t").alias("since"), F.first("now").alias("now"), F.first("g").alias("parent"))
        before = change.withColumn("g", F.sha1(F.concat_ws("|", "parent", F.lit(name), "now")))
        part = before.select(F.col("k").alias(key), F.lit(name).alias("stage"), F.lit(i).alias("place"), "parent", F.col("g").alias("signature"))
        out = part if out is None else out.unionByName(part)
    return out


def chained(events: DataFrame, key: str, order: str, content: Column) -> DataFrame:
    """Adds the signature of each event of a log, that of the one before, and whether it repeats it.

    A log may be of any length, so its events are hashed one by one, with their position; signature_chain() chains the stages.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("signature", F.sha1(F.concat_ws("|", F.col(order).cast("string"), content)))
    rows = rows.withColumn("parent", F.lag("signature").over(w))
    return rows.withColumn("content_repeated", F.coalesce(F.lag(content).over(w) == content, F.lit(False)))


def stage_status(events: DataFrame, key: str, order: str, stage: str, names: list[str]) -> DataFrame:
    """Per key: events, latest event of each stage, the next stage to approve, and whether a later stage is stale.

    A stage is stale when an earlier stage has a later event.
    """
    last = events.groupBy(key).agg(F.count("*").alias("events"), *(F.max(F.when(F.col(stage) == n, F.col(order))).alias(f"last_{n}") for n in names))
    upcoming = F.coalesce(*(F.when(F.col(f"last_{n}").isNull(), n) for n in names), F.lit("done"))
    stale = F.lit(False)
    for i, n in enumerate(names[1:], 1):
        earlier = F.greatest(*(F.col(f"last_{m}") for m in names[:i])) if i > 1 else F.col(f"last_{names[0]}")
        stale = stale | F.coalesce(F.col(f"last_{n}") < earlier, F.lit(False))
    return last.withColumn("next_stage", upcoming).withColumn("stale", stale)
