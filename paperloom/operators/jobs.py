"""Bookkeeping of files, selections, jobs and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.labels import ACTIVE, FAILED, batch_state
from paperloom.operators.skew import ranked, running_total


def folder_summary(files: DataFrame, folder: str, name: str) -> DataFrame:
    """folder, total_documents, extension_counts, sample_files (the first five names) of each folder.

    Counting is by folder and extension first; names beyond the first five per folder are dropped before they meet.
    """
    ext = F.lower(F.concat(F.lit("."), F.substring_index(F.col(name), ".", -1)))
    counts = files.groupBy(folder, ext.alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    maps = counts.groupBy(folder).agg(F.sum("_n").alias("total_documents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_e", "_n")))).alias("extension_counts"))
    ranked = files.withColumn("_s", F.pmod(F.xxhash64(name), F.lit(32)))
    few = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(folder, "_s").orderBy(name))).where("_r <= 5")
    names = few.groupBy(folder).agg(F.slice(F.array_sort(F.collect_list(name)), 1, 5).alias("sample_files"))
    return maps.join(names, folder)


def find_files(files: DataFrame, name: str, query: str, limit: int | None = None) -> DataFrame:
    """Files whose name holds a text or fits a pattern with * and ?, with a limit the first in order."""
    import re as _re

    low = F.lower(F.col(name))
    if any(c in query for c in "*?"):
        pattern = "".join(".*" if c == "*" else "." if c == "?" else _re.escape(c) for c in query.lower())
        hit = low.rlike(f"^{pattern}$")
    else:
        hit = low.contains(query.lower())
    found = files.where(hit)
    return found if limit is None else found.orderBy(name).limit(limit)


def indices_of(text: str) -> list[tuple[int, int]]:
    """"1,5,10-12" as closed ranges; parts that are no numbers are left out."""
    out = []
    for part in text.replace(" ", "").split(","):
        a, _, b = part.partition("-")
        if a.isdigit() and (not b or b.isdigit()):
            lo, hi = int(a), int(b or a)
            out.append((min(lo, hi), max(lo, hi)))
    return out


def select_batch(files: DataFrame, folder: str, name: str, pattern: str | None = None, indices: str | None = None, per_folder: int | None = None, limit: int | None = None) -> DataFrame:
    """Files narrowed by name, by their 1-based place in the whole list, to the first of each folder, to the first of all."""
    x = files
    if pattern:
        x = find_files(x, name, pattern)
    if indices:
        hit = F.lit(False)
        x = ranked(x, folder, name, out="_i")
        for lo, hi in indices_of(indices):
            hit = hit | F.col("_i").between(lo, hi)
        x = x.where(hit).drop("_i")
    if per_folder:
        x = x.withColumn("_r", F.row_number().over(Window.partitionBy(folder).orderBy(name))).where(F.col("_r") <= per_folder).drop("_r")
    return x.orderBy(folder, name).limit(limit) if limit else x


def seeded_sample(candidates: DataFrame, key: str, n: int, seed: int, done: DataFrame | None = None) -> DataFrame:
    """n distinct candidates in a pseudorandom order fixed by the seed, without those already done."""
    x = candidates.dropDuplicates([key])
    if done is not None:
        x = x.join(done.select(key), key, "left_anti")
    return x.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def batch_rollup(jobs: DataFrame, batch: str, status: str) -> DataFrame:
    """batch, n_jobs, n_done, n_failed, n_active, state of each batch."""
    s = F.col(status)
    active, failed = s.isin(*ACTIVE), s.isin(*FAILED)
    return jobs.groupBy(batch).agg(
        F.count(s).alias("n_jobs"), F.count_if(s == "completed").alias("n_done"), F.count_if(failed).alias("n_failed"), F.count_if(active).alias("n_active"),
    ).withColumn("state", batch_state(F.col("n_active") > 0, F.col("n_failed") > 0, F.col("n_jobs")))


STATES = ("queued", "running", "paused", "completed", "failed", "canceled")


def status_counts(jobs: DataFrame, key: str, status: str) -> DataFrame:
    """key and a column per state: how many jobs are in it, 0 where none is. The states are known, so one pass does."""
    return jobs.groupBy(key).pivot(status, list(STATES)).count().na.fill(0, list(STATES))


def run_summary(results: DataFrame, ok: Column) -> DataFrame:
    """total, n_success, n_error, status of a run."""
    x = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("n_success")).withColumn("n_error", F.col("total") - F.col("n_success"))
    return x.withColumn("status", F.when(F.col("n_error") == 0, "success").when(F.col("n_success") > 0, "partial").otherwise("error"))


def latest_progress(log: DataFrame, job: str, order: str, line: str) -> DataFrame:
    """job, current_page, total_pages, stage as of the last line that tells progress."""
    t = F.col(line)
    page, slide, done = r"(?i)Memproses Halaman\s+(\d+)\s*/\s*(\d+)", r"(?i)\[Slide\s+(\d+)\s*/\s*(\d+)\]", r"(?i)Selesai render\s+(\d+)\s+slide gambar"
    n = lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
    current = F.when(t.rlike(page), n(page, 1)).when(t.rlike(slide), n(slide, 1))
    total = F.when(t.rlike(page), n(page, 2)).when(t.rlike(slide), n(slide, 2)).when(t.rlike(done), n(done, 1))
    stage = (
        F.when(t.contains("Mengekstrak PDF multi-halaman"), "init").when(t.contains("Memulai rendering slide menjadi gambar"), "render").when(t.contains("Sub-Agent SQL"), "tabular")
        .when(t.contains("Guardrail Cross-Verification"), "audit").when(t.contains("Hasil Markdown berhasil disimpan ke:"), "saved").when(current.isNotNull(), "page")
        .when(t.rlike(done), "rendered")
    )
    x = log.select(job, order, current.alias("_current"), total.alias("_total"), stage.alias("_stage"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return x.groupBy(job).agg(last("_current").alias("current_page"), last("_total").alias("total_pages"), last("_stage").alias("stage"))


def merge_listings(memory: DataFrame, disk: DataFrame, key: str, active: str, changed: str) -> DataFrame:
    """Documents known in memory and on disk, memory first for the same key; active ones and late changes sort first."""
    return memory.unionByName(disk.join(memory.select(key), key, "left_anti"), allowMissingColumns=True).orderBy(F.desc(active), F.desc(changed), key)


def unreferenced(outputs: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Outputs that no batch names any more."""
    return outputs.join(references.select(key).distinct(), key, "left_anti")


def queue_order(queued: DataFrame, position: str, key: str) -> DataFrame:
    """Jobs with how many run before them; ties go by key. One queue is one order, by definition."""
    return ranked(queued, position, key, out="_place").withColumn("ahead", F.col("_place") - 1).drop("_place")


def prioritise(queued: DataFrame, position: str, first: Column) -> DataFrame:
    """The queue in which the chosen jobs stand before all."""
    low = queued.agg(F.min(position).alias("_m"))
    at = low.first()["_m"] or 0
    return queued.withColumn(position, F.when(first, F.lit(at - 1)).otherwise(F.col(position)))


def unique_stems(uploads: DataFrame, stem: str, order: str) -> DataFrame:
    """Uploads with a number behind names met before, along a whole-number order of arrival; a name used very often is numbered in ranges."""
    x = running_total(uploads.withColumn("_low", F.lower(stem)), "_low", order, F.lit(1), "_n").drop("_low")
    numbered = F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    return x.withColumn("unique_name", numbered).drop("_n")


def dedupe_uploads(uploads: DataFrame, path: str, content: Column, order: str) -> DataFrame:
    """Uploads of which the same path and content came once before are left out; the first stays."""
    others = [c for c in uploads.columns if c not in (path, order)]
    g = uploads.withColumn("_h", F.sha2(content, 256)).groupBy(path, "_h").agg(F.min(F.struct(order, *others)).alias("_f"))
    return g.select(path, "_f.*").select(*uploads.columns)
