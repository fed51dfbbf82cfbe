"""The file-change stream: debounce, coalescing and cancellation of short-lived files.

Per path the latest change waits; it's released when `window` passes without another change. A deletion less than `window`
after a creation or modification takes both away. The stateful stream keeps one waiting change per path and releases it by
event-time timers; changes without path, kind or time are left out. The batch form says the same by the neighbouring changes alone, since only gaps under `window` matter."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODIFIED, DELETED = "created_or_modified", "deleted"
BUCKET_MS = 3_600_000


def released(changes: DataFrame, window_ms: int = 500) -> DataFrame:
    """changes: path, kind, ts, seq (breaks ties). Result: path, kind, ts of released changes.

    A busy path is cut into time buckets; changes near a bucket's ends stand in the next one too, as neighbours only."""
    bucket = max(BUCKET_MS, 4 * window_ms)
    c = changes.where("path IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL").withColumn("ms", F.unix_millis("ts"))
    own = F.floor(F.col("ms") / bucket)
    c = c.withColumn("own", own).withColumn("b", F.explode(F.array_distinct(F.array(F.col("own"), F.floor((F.col("ms") - window_ms) / bucket), F.floor((F.col("ms") + window_ms) / bucket)))))
    w = Window.partitionBy("path", "b").orderBy("ms", "seq")
    n = c.withColumn("p_kind", F.lag("kind").over(w)).withColumn("p_ms", F.lag("ms").over(w)).withColumn("n_kind", F.lead("kind").over(w)).withColumn("n_ms", F.lead("ms").over(w))
    near_before = F.coalesce(F.col("ms") - F.col("p_ms") < window_ms, F.lit(False))
    near_after = F.coalesce(F.col("n_ms") - F.col("ms") < window_ms, F.lit(False))
    cancelled = (F.col("kind") == DELETED) & near_before & (F.col("p_kind") == MODIFIED)
    return n.where((F.col("b") == F.col("own")) & ~near_after & ~cancelled).select("path", "kind", "ts")


def churn_cancelled(changes: DataFrame, window_ms: int = 500) -> DataFrame:
    """Deletions that take a modification away: path, ts."""
    w = Window.partitionBy("path").orderBy("ms", "seq")
    c = changes.withColumn("ms", F.unix_millis("ts")).withColumn("p_kind", F.lag("kind").over(w)).withColumn("p_ms", F.lag("ms").over(w))
    return c.where((F.col("kind") == DELETED) & (F.col("p_kind") == MODIFIED) & (F.col("ms") - F.col("p_ms") < window_ms)).select("path", "ts")


STATE = "kind string, ms long"
OUT = "path string, kind string, ts timestamp"


def _debounce(window_ms: int):
    def run(key, batches, state):
        path = key[0]
        out = []
        kind, at = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            if kind is not None:
                out.append((path, kind, at))
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values(["ms", "seq"])
            for k, ms in zip(pdf["kind"], pdf["ms"]):
                if kind is not None and ms - at >= window_ms:
                    out.append((path, kind, at))
                    kind = at = None
                if k == DELETED and kind == MODIFIED:
                    kind = at = None
                else:
                    kind, at = k, int(ms)
            if kind is None:
                state.remove() if state.exists else None
            else:
                state.update((kind, at))
                state.setTimeoutTimestamp(max(at + window_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"path": [o[0] for o in out], "kind": [o[1] for o in out], "ts": pd.to_datetime([o[2] for o in out], unit="ms")})

    return run


def debounced_stream(changes: DataFrame, window_ms: int = 500, late: str = "10 seconds", exclude=None) -> DataFrame:
    """The live form. changes: a stream of path, kind, ts, seq. Excluded paths never reach the state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    if exclude is not None:
        changes = changes.where(~exclude)
    rows = changes.where("path IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("path").applyInPandasWithState(_debounce(window_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def flush(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Runs the stream; each micro-batch of released changes goes to `write` (a merge by path makes it idempotent)."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def as_actions(batch: DataFrame, known: DataFrame, max_size: int = 50 * 1024 * 1024) -> DataFrame:
    """What a released change does: known holds path, size of files that exist now. A vanished file is marked deleted, one
    that is too large is skipped, others are put in the catalogue. path, action."""
    j = batch.join(known.select("path", "size"), "path", "left")
    return j.select("path", F.when((F.col("kind") == DELETED) | F.col("size").isNull(), "delete").when(F.col("size") > max_size, "skip").otherwise("upsert").alias("action"))
