"""Run logs: batch views and the streaming state machine over the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..operators.sequences import row_numbers, running_last

# Lines of a run that stay readable.
MAX_LINES = 2000
CHUNK = 10_000
# How long the stream keeps a run after its last event once it has ended, and while it runs.
LINGER_MS, SILENT_MS = 3_600_000, 7 * 24 * 3_600_000


def kept_lines(lines: DataFrame) -> DataFrame:
    """Log lines without progress bars."""
    return lines.where(~text.is_progress_bar("line"))


def _by_sequence() -> Column:
    return F.floor(F.col("seq") / CHUNK).cast("bigint")


def stages(lines: DataFrame) -> DataFrame:
    """The latest stage named up to each kept line, `starting` before the first."""
    marked = kept_lines(lines).withColumn("_mark", text.log_stage("line"))
    followed = running_last(marked, ["run_id"], ["seq"], "_mark", name="stage", chunk=_by_sequence())
    return followed.withColumn("stage", F.coalesce("stage", F.lit("starting"))).drop("_mark")


def tail(lines: DataFrame, *, since: int = 0, max_lines: int = MAX_LINES) -> DataFrame:
    """Lines from position `since` on, at most the last `max_lines` of each run.

    Positions are counted over the whole run, so a poll keeps working after the buffer
    has started to drop lines.
    """
    placed = row_numbers(kept_lines(lines), ["run_id"], ["seq"], name="pos", chunk=_by_sequence())
    totals = placed.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_lines"))
    return placed.join(totals, "run_id").where(
        (F.col("pos") >= F.col("total_lines") - max_lines) & (F.col("pos") >= since)
    )


def statuses(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """Final state per run from its lines and `(run_id, returncode, cancelled)`.

    A cancelled run stays cancelled whatever its exit code; a finished run counts as
    having reached the last stage.
    """
    marked = kept_lines(lines).withColumn("_mark", text.log_stage("line"))
    named = F.when(F.col("_mark").isNotNull(), F.col("seq"))
    reached = marked.groupBy("run_id").agg(F.max_by("_mark", named).alias("_stage"), F.count(F.lit(1)).alias("lines"))
    status = (
        F.when(F.col("cancelled"), "cancelled").when(F.col("returncode").isNull(), "running")
        .when(F.col("returncode") == 0, "done").otherwise("failed")
    )
    stage = F.when(F.col("status") == "done", F.lit(text.STAGES[-1])).otherwise(F.coalesce("_stage", F.lit("starting")))
    return (
        reached.join(ends, "run_id").withColumn("status", status).withColumn("stage", stage)
        .withColumn("stage_index", text.stage_index("stage")).drop("_stage")
    )


def recent(runs: DataFrame, tie_break: list[str], limit: int = 10) -> DataFrame:
    """The latest runs by start time."""
    return runs.orderBy(F.col("started").desc(), *tie_break).limit(limit)


_STATE = "stage string, status string, total bigint, lines array<string>"
_OUTPUT = "run_id string, status string, stage string, stage_index int, total_lines bigint, lines array<string>"


def _advance(max_lines: int, linger_ms: int, silent_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import re

        if state.hasTimedOut:
            state.remove()
            return
        marker = re.compile(r"^\s*\[(" + "|".join(text.STAGES) + r")\]")
        bar = re.compile(r"\d+%\|")
        stage, status, total, kept = state.get if state.exists else ("starting", "running", 0, [])
        kept = list(kept)
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, line in zip(rows["kind"], rows["line"]):
            if kind == "line":
                if bar.search(line):
                    continue
                kept.append(line)
                total += 1
                found = marker.match(line)
                stage = found.group(1) if found else stage
            elif kind == "cancel" and status == "running":
                status = "cancelled"
            elif kind == "exit" and status == "running":
                status = "done" if line == "0" else "failed"
                stage = text.STAGES[-1] if status == "done" else stage
        kept = kept[-max_lines:]
        state.update((stage, status, total, kept))
        seen = int(rows["_seen_ms"].max())
        state.setTimeoutTimestamp(seen + (silent_ms if status == "running" else linger_ms))
        index = text.STAGES.index(stage) if stage in text.STAGES else -1
        yield pd.DataFrame({
            "run_id": [key[0]], "status": [status], "stage": [stage], "stage_index": [index],
            "total_lines": [total], "lines": [kept],
        })

    return step


def follow(
    events: DataFrame, *, max_lines: int = MAX_LINES, linger_ms: int = LINGER_MS, silent_ms: int = SILENT_MS,
    clock_slack: str = "10 minutes",
) -> DataFrame:
    """Streaming run states from `(run_id, seq, kind, line)`.

    `kind` is `line`, `exit` (the line holds the return code) or `cancel`. Every batch
    emits the new state of the runs it touched; the state of one run is bounded by the
    line buffer.

    Late lines of an ended run are kept and counted and leave its status as it is. A run is
    forgotten by a batch that comes more than `linger_ms` after the last event of an ended run,
    or `silent_ms` after that of a running one; events beyond that begin a new run. Times are
    those of the batches; `clock_slack`, by which removal is later, is how far the clock of a
    restarted driver may be behind. `events` has no watermark of its own.
    """
    timed = events.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", clock_slack)
    return timed.withColumn("_seen_ms", F.unix_millis("_seen")).groupBy("run_id").applyInPandasWithState(
        _advance(max_lines, linger_ms, silent_ms), _OUTPUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def line_source(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of run events from a folder of JSON-lines files written by the runners."""
    return spark.readStream.schema("run_id string, seq bigint, kind string, line string").json(folder)
