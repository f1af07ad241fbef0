"""Queries over text quality and chunking, and streams run to their end over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import mermaid as M
from paperloom.operators import chunks as K
from paperloom.operators import quality as Q
from paperloom.session import cut, drop_folder, load, shared_folder
from paperloom.streaming import jobs as J


def finish(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over the input that is there, and read what its last batches wrote."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{place}/out")
    done = cut(out)
    drop_folder(spark, place)
    return done


def table_stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of parts."""
    reader = spark.readStream.schema(load(spark, d, table).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(d)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table_stream(spark, d, "events")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and day, as a stream with a watermark would hold them."""
    e = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    x = finish(J.windowed_counts(e, "ts", "event_type", "1 day", "2 days"), "update")
    last = x.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as moves of a job's state machine."""
    kinds = {"click": "running", "view": "running", "purchase": "completed", "error": "failed", "login": "queued", "logout": "paused"}
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("canceled"))
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), status.alias("status"))
    x = finish(J.job_states(e), "update")
    return x.groupBy("job").agg(F.max_by(F.struct("status", "n_events", "n_refused"), "batch").alias("s")).select("job", "s.status", "s.n_events", "s.n_refused")


def stream_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The clauses open at the end of each chunk preview, its headings read as a stream of events."""
    docs = table_stream(spark, d, "documents")
    heads = F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("seq"), F.regexp_extract(s, r"^#+ (Pasal|Bagian|Section) (\d+)", 1).alias("k"), F.regexp_extract(s, r"^#+ (?:Pasal|Bagian|Section) (\d+)", 1).alias("o"))), lambda s: s["k"] != "")
    e = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc"), F.explode(heads).alias("h"))
    kind = F.when(F.col("h.k") == "Pasal", "pasal").when(F.col("h.k") == "Bagian", "bagian").otherwise("bab")
    x = finish(J.clause_cursor(e.select("doc", F.col("h.seq").cast("long").alias("seq"), kind.alias("kind"), F.col("h.o").alias("ordinal"))), "update")
    return x.groupBy("doc").agg(F.max_by("open_path", "batch").alias("open_path"))


def chunk_preview(spark: SparkSession, d: str) -> DataFrame:
    """How documents fall into chunks without overlap: the characters that are not blank, whether every chunk fits, and the statistics of the preview."""
    chunks = K.preview_chunks(load(spark, d, "documents"), "doc_id", "text", 400, 0)
    dense = F.length(F.regexp_replace("content", r"[\s\p{Z}\x1c-\x1f\x85]", ""))
    held = chunks.groupBy("doc_id").agg(F.sum(dense).alias("n_dense"), (F.max(F.length("content")) <= 400).alias("fits"), (F.max("chunk_id") == F.count(F.lit(1))).alias("numbered"), F.sum("char_count").alias("n_chars"))
    stats = K.chunk_stats(chunks, "doc_id")
    return held.join(stats, "doc_id").select("doc_id", "n_dense", "fits", "numbered", (F.col("n_chars") == F.col("total_characters")).alias("counted"))


def trust(spark: SparkSession, d: str) -> DataFrame:
    """Scanned regions by trust in their text."""
    r = load(spark, d, "ocr_regions").select("region_id", "text", F.when(F.col("bbox_model").isNotNull(), 1).otherwise(0).alias("n")).distinct()
    return Q.assessed(r, "text", "n").groupBy("trust_level", "score").agg(F.count(F.lit(1)).alias("n_regions"))


def styles(spark: SparkSession, d: str) -> DataFrame:
    """The style of each source file."""
    x = load(spark, d, "documents").where(F.col("source_file").isNotNull()).select("source_file", "doc_id", F.coalesce("spec", F.lit("plain")).alias("spec"))
    return Q.style_consensus(x, "source_file", "doc_id", "spec")


def diagrams(spark: SparkSession, d: str) -> DataFrame:
    """Flow charts built from nations under regions, spoilt and mended."""
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.concat(F.lit("  R"), F.col("r_regionkey").cast("string"), F.lit("["), F.col("r_name"), F.lit(" (benua)]] --> N"), F.col("n_nationkey").cast("string"), F.lit("["), F.col("n_name"), F.lit("]")).alias("e"))
    g = edges.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("e")), "\n").alias("t"))
    code = F.concat(F.lit("```mermaid\ngraph TD\n"), F.col("t"), F.lit("\n"), F.col("t"), F.lit("\n```"))
    return g.select("r_name", M.problems(F.col("t")).alias("before"), M.problems(M.sanitized(code)).alias("after"), M.sanitized(code).alias("code"))


QUERIES = {
    "streams_windows": stream_windows, "streams_jobs": stream_jobs, "streams_cursor": stream_cursor, "text_chunks": chunk_preview, "text_trust": trust, "text_styles": styles, "text_diagrams": diagrams,
}
_MOVES = "(st = 'queued' AND status IN ('running', 'canceled')) OR (st = 'running' AND status IN ('paused', 'completed', 'failed', 'canceled')) OR (st = 'paused' AND status IN ('running', 'canceled', 'failed')) OR (st IN ('failed', 'canceled') AND status = 'queued')"
ORACLE = {
    "streams_jobs": f"""
        WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS job, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
            CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'login' THEN 'queued' WHEN 'logout' THEN 'paused' ELSE 'canceled' END AS status FROM events),
        w AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS k, 'queued' AS st, 0 AS refused FROM e
            UNION ALL SELECT job, w.k + 1, CASE WHEN {_MOVES} THEN status ELSE st END, refused + CASE WHEN NOT ({_MOVES}) AND status <> st THEN 1 ELSE 0 END FROM w JOIN e USING (job) WHERE e.k = w.k + 1)
        SELECT job, arg_max(st, k) AS status, max(k) AS n_events, arg_max(refused, k) AS n_refused FROM w GROUP BY job""",
    "streams_cursor": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents WHERE text IS NOT NULL),
        h AS (SELECT doc_id, seq, regexp_extract(t, '^#+ (Pasal|Bagian|Section) (\d+)', 1) AS k, regexp_extract(t, '^#+ (?:Pasal|Bagian|Section) (\d+)', 1) AS o FROM l),
        e AS (SELECT doc_id, seq, CASE k WHEN 'Pasal' THEN 'pasal' WHEN 'Bagian' THEN 'bagian' ELSE 'bab' END AS kind, CASE k WHEN 'Pasal' THEN 6 WHEN 'Bagian' THEN 4 ELSE 3 END AS level, o FROM h WHERE k <> ''),
        open AS (SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id AND b.seq > a.seq AND b.level <= a.level))
        SELECT CAST(doc_id AS VARCHAR) AS doc, string_agg(kind || ' ' || o, ' > ' ORDER BY seq) AS open_path FROM open GROUP BY 1""",
    "text_chunks": r"""SELECT doc_id, length(regexp_replace(text, '[\s\pZ\x{1c}-\x{1f}\x{85}]', '', 'g')) AS n_dense, true AS fits, true AS numbered, true AS counted FROM documents WHERE regexp_matches(text, '[^\s\pZ\x{1c}-\x{1f}\x{85}]')""",
    "text_trust": r"""
        WITH r AS (SELECT DISTINCT region_id, text, CASE WHEN bbox_model IS NOT NULL THEN 1 ELSE 0 END AS regions FROM ocr_regions),
        v AS (SELECT regions, regexp_replace(coalesce(text, ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS v FROM r),
        x AS (SELECT *, length(v) AS n, CASE WHEN v = '' THEN 0 ELSE length(regexp_replace(v, '[^\pL\pN]', '', 'g')) / length(v) END AS a, CASE WHEN v = '' THEN 0 ELSE 1 - length(regexp_replace(regexp_replace(v, '[\n\t]', '', 'g'), '[^\pC]', '', 'g')) / length(v) END AS p,
            list_filter(list_transform(string_split(v, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM v),
        s AS (SELECT round(greatest(0, least(1, 0.46 + CASE WHEN n >= 12 THEN 0.08 WHEN n < 4 THEN -0.30 ELSE 0 END + CASE WHEN p >= 0.98 THEN 0.08 WHEN p < 0.90 THEN -0.20 ELSE 0 END + CASE WHEN a >= 0.35 THEN 0.08 WHEN a < 0.15 THEN -0.18 ELSE 0 END
            + CASE WHEN regions > 0 THEN 0.15 ELSE -0.10 END + CASE WHEN len(l) >= 4 AND len(list_distinct(l)) / len(l) < 0.5 THEN -0.22 ELSE 0 END + CASE WHEN contains(v, '<|det|>') OR contains(v, '<|/det|>') THEN -0.20 ELSE 0 END)), 6) AS score FROM x)
        SELECT CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.48 THEN 'medium' ELSE 'low' END AS trust_level, CAST(score AS DOUBLE) AS score, count(*) AS n_regions FROM s GROUP BY ALL""",
    "streams_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "text_styles": """SELECT source_file, coalesce(arg_min(spec, doc_id) FILTER (spec IS NOT NULL AND spec <> 'plain'), 'plain') AS spec FROM documents WHERE source_file IS NOT NULL GROUP BY source_file""",
    "text_diagrams": """WITH e AS (SELECT r_name, '  R' || r_regionkey || '[' || r_name || ' (benua)]] --> N' || n_nationkey || '[' || n_name || ']' AS seen, '  R' || r_regionkey || '["' || r_name || ' (benua)"] --> N' || n_nationkey || '[' || n_name || ']' AS right_one FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT r_name, 'unknown header' AS before, NULL::VARCHAR AS after, 'flowchart TD' || chr(10) || string_agg(right_one, chr(10) ORDER BY seen) AS code FROM e GROUP BY r_name""",
}
