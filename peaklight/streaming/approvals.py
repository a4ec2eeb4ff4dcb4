"""Approvals of analyses as they arrive: a stream of events, the approved chain of each key as its state.

The rules are those of a workflow: a stage needs the one before it; approving what is approved already changes nothing; another content takes
later approvals back.  ``operators.workflow.approved_chain`` says the same of a whole log at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last long, contents array<string>, signatures array<string>, ats array<long>"


def link(parent: str, stage: str, content: str) -> str:
    """The signature of an approval: a hash of the signature before it, the stage and what was approved."""
    return hashlib.sha1("|".join((parent, stage, content)).encode()).hexdigest()


def advance(chain: list[tuple[str, str, int]], names: list[str], at: int, stage: str, content: str) -> tuple[list[tuple[str, str, int]], str, list[str]]:
    """(chain, outcome, stages taken back) after an event; a chain holds (content, signature, at) of the approved stages in order.

    Outcomes: applied, unchanged, wrong order (the stage before isn't approved), unknown stage.
    """
    if stage not in names:
        return chain, "unknown stage", []
    i = names.index(stage)
    if i > len(chain):
        return chain, "wrong order", []
    signature = link(chain[i - 1][1] if i else "", stage, content)
    if i < len(chain) and chain[i][1] == signature:
        return chain, "unchanged", []
    return [*chain[:i], (content, signature, at)], "applied", names[i + 1 : len(chain)]


def approvals(events: DataFrame, key: str, at: str, stage: str, content: str, names: list[str], idle: str | None = None) -> DataFrame:
    """Of a stream of events one row each: key, at, stage, outcome, signature, parent, taken_back.

    Events of a key are taken in order of ``at`` (then stage, content) inside a batch; one that isn't later than the last one of an earlier batch is
    "late" and changes nothing, so a batch that is given twice does no harm.  A key without events for ``idle`` (milliseconds as text) is forgotten: a row
    with the outcome "expired" and no stage.  A null content is an empty one, a null stage unknown; events without a key or ``at`` are left out.  A task holds the events of one key in one batch; bound
    the batch (files or bytes per trigger) and that is bounded.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.coalesce(F.col(stage).cast("string"), F.lit("")).alias("stage"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "at", "stage", "outcome", "signature", "parent", "taken_back"]
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(name[0], last, None, "expired", None, None, [])], columns=columns)
            return
        last, contents, signatures, ats = state.get if state.exists else (None, [], [], [])
        chain, out = list(zip(contents, signatures, ats, strict=True)), []
        own = pd.concat(list(parts)).sort_values(["at", "stage", "content"])
        bar = last
        for t, s, c in zip(own["at"].tolist(), own["stage"], own["content"], strict=True):
            if bar is not None and t <= bar:
                out.append((name[0], t, s, "late", None, None, []))
                continue
            chain, outcome, back = advance(chain, names, t, s, c)
            i = names.index(s) if outcome in ("applied", "unchanged") else None
            out.append((name[0], t, s, outcome, None if i is None else chain[i][1], None if i is None else chain[i - 1][1] if i else "", list(back)))
            last = t
        if chain or last is not None:
            state.update((last, [c for c, _, _ in chain], [g for _, g, _ in chain], [t for _, _, t in chain]))
        if idle is not None:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    shape = f"key {kind}, at long, stage string, outcome string, signature string, parent string, taken_back array<string>"
    return rows.groupBy("key").applyInPandasWithState(step, shape, STATE, "append", timeout).withColumnRenamed("key", key)


def latest(outcomes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, stage, place, parent, signature: the chain that the outcomes of a stream leave, whichever batches they came in.

    Of each stage the last applied approval counts unless a later one of an earlier stage took it back, which the chain of signatures tells; expired keys are out.
    """
    place = F.array_position(F.array(*map(F.lit, names)), F.col("stage")) - 1
    gone = outcomes.where("outcome = 'expired'").groupBy(key).agg(F.max("at").alias("gone"))
    applied = outcomes.where("outcome = 'applied'").groupBy(key, "stage").agg(F.max(F.struct("at", "signature", "parent")).alias("a")).select(key, "stage", place.cast("int").alias("place"), "a.*")
    rows = applied.join(gone, key, "left").where("gone is null or at > gone")
    # A stage stands on the one before it if its parent is that one's last signature; names are few, so the chain is a fold over one row per key.
    chain = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "stage", "parent", "signature"))).alias("s"))
    start = F.array().cast("array<struct<place:int,stage:string,parent:string,signature:string>>")
    kept = F.aggregate("s", start, lambda done, x: F.when((x["place"] == F.size(done)) & (x["parent"] == F.coalesce(F.try_element_at(done, F.lit(-1))["signature"], F.lit(""))), F.concat(done, F.array(x))).otherwise(done))
    return chain.select(key, F.explode(kept).alias("r")).select(key, "r.stage", "r.place", "r.parent", "r.signature")


def run(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, key: str, at: str, stage: str, content: str, names: list[str], per_batch: int = 1000, form: str = "parquet") -> None:
    """Take all files of a folder that are new since the checkpoint, and append their outcomes to ``out``; a batch that runs again replaces its own rows."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    query = approvals(events, key, at, stage, content, names).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
