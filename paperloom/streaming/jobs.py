"""Streams of log lines and job events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.functions.labels import progress

# Which state a job may enter from which.
MOVES = {
    "queued": {"running", "canceled"}, "running": {"paused", "completed", "failed", "canceled"}, "paused": {"running", "canceled", "failed"},
    "failed": {"queued"}, "canceled": {"queued"}, "completed": set(),
}


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """value, file of new lines in log files."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", 100).load(folder).select("value", F.col("_metadata.file_path").alias("file"))


def progress_stream(lines: DataFrame, job: str, at: str, line: str, late: str = "1 hour") -> DataFrame:
    """job, current_page, total_pages, percent: the furthest page each job's lines tell of, kept per job under a watermark."""
    page = r"(?i)(?:Memproses Halaman\s+|\[Slide\s+)(\d+)\s*/\s*(\d+)"
    n = lambda k: F.regexp_extract(line, page, k).try_cast("int")
    x = lines.withWatermark(at, late).where(F.col(line).rlike(page)).select(job, at, n(1).alias("_current"), n(2).alias("_total"))
    last = x.groupBy(job).agg(F.max(F.struct(at, "_current", "_total")).alias("_m"))
    current, total = F.col("_m._current"), F.col("_m._total")
    return last.select(job, current.alias("current_page"), total.alias("total_pages"), progress(F.lit("running"), current, total).alias("percent"))


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per kind and time window; those later than the watermark are left out of closed windows."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), kind, "n")


def job_states(events: DataFrame) -> DataFrame:
    """job, status, n_events, n_refused: a state machine per job over job, seq, status events.

    A move that is not allowed is refused and counted. State survives restarts in the query's checkpoint.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, refused = state.get if state.exists else ("queued", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for wanted in rows["status"]:
            n += 1
            if wanted in MOVES.get(status, ()):
                status = wanted
            elif wanted != status:
                refused += 1
        state.update((status, n, refused))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "n_events": [n], "n_refused": [refused]})

    return events.groupBy("job").applyInPandasWithState(
        step, "job string, status string, n_events long, n_refused long", "status string, n long, refused long", "update", GroupStateTimeout.NoTimeout
    )


def clause_cursor(events: DataFrame) -> DataFrame:
    """doc, open_path: the open clauses of each document after every micro-batch, carried as state of the tree's depth."""
    from paperloom.functions.ordinals import BLOCKED_IN_PREAMBLE, LEVELS

    rank = {k: i for i, k in enumerate(LEVELS)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path = [tuple(p.split("\t")) for p in state.get[0].split("\n") if p] if state.exists else []
        for e in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            if e["kind"] == "teks":
                continue
            level = rank.get(e["kind"], len(rank))
            path = [p for p in path if rank.get(p[0], len(rank)) < level and not (p[0] == "pembukaan" and e["kind"] in BLOCKED_IN_PREAMBLE)]
            path.append((e["kind"], str(e["ordinal"] or "")))
        text = "\n".join("\t".join(p) for p in path)
        state.update((text,))
        yield pd.DataFrame({"doc": [key[0]], "open_path": [" > ".join(" ".join(p).strip() for p in path)]})

    return events.groupBy("doc").applyInPandasWithState(step, "doc string, open_path string", "path string", "update", GroupStateTimeout.NoTimeout)


def complete_pages(text: DataFrame, key: str, content: str) -> DataFrame:
    """What readers may see of a document that is still being written: up to its last closing rule."""
    from paperloom.functions.cells import strip

    seen = F.regexp_extract(F.col(content), r"(?s)^(.*)\n---[ \t]*(?:\n|$)", 1)
    return text.select(key, strip(seen).alias("visible"))


def append_pages(pages: DataFrame, folder: str, checkpoint: str, every: str = "2 seconds"):
    """Write finished pages as they come, each micro-batch once even after a restart; returns the running query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
