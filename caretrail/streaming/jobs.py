"""Incremental forms of the batch jobs. Stores are cut into buckets by a hash of their key; a batch writes the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caretrail.sources.shared import dealt, written

BUCKETS = 64


def _latest(spark: SparkSession, root: str, store: str, before: int | None = None) -> dict[int, int]:
    """bucket -> the last batch that wrote it; at most as many as there are buckets."""
    schema = "bucket int, batch bigint"
    index = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{store}-index")
    index = index if before is None else index.where(F.col("batch") < before)
    return {r["bucket"]: r["batch"] for r in index.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def read_snapshot(spark: SparkSession, root: str, store: str) -> DataFrame:
    """The store's rows after the last batch."""
    paths = [f"{root}/{store}/batch={n}/bucket={b}" for b, n in sorted(_latest(spark, root, store).items())]
    return spark.read.parquet(*paths)


def upsert_batch(rows: DataFrame, n: int, root: str, store: str, key: list[str], buckets: int = BUCKETS, order: str | None = None) -> None:
    """Writes batch n's rows into the store; of a batch's rows with one key the one that is last by the column `order` stays. Only the buckets they fall into are read and written again, beside their earlier
    versions, so a batch that is tried again starts from what was there before it and gives the same."""
    from caretrail.sources.store import upsert

    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    rows = written(rows, "batch")  # read twice: for the buckets, and for their rows
    rows = rows.withColumn("_seq", F.struct(F.lit(n).cast("long").alias("n"), *([F.col(order).alias("o")] if order else [])))
    touched = [r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most as many as there are buckets
    old = _latest(spark, root, store, n) if n else {}
    paths = [f"{root}/{store}/batch={old[b]}/bucket={b}" for b in touched if b in old]
    current = spark.read.schema(rows.drop("_seq").schema).parquet(*paths) if paths else rows.drop("_seq").limit(0)
    upsert(current, rows, key, "_seq").withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{store}/batch={n}")
    spark.createDataFrame([(b, n) for b in touched], "bucket int, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/{store}-index/part-{n}")


def stream_ingest(documents: DataFrame, job: Callable[[DataFrame], DataFrame], root: str, store: str, key: list[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Each batch of new documents goes through the batch job, and its rows are upserted into the store, the last by `order`."""
    apply = lambda batch, n: upsert_batch(job(batch), n, root, store, key, order=order)
    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_job(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The batch job of documents (record_id, text): redact, cut into chunks, read what the model said of each chunk (responses:
    record_id, chunk_no, content), hand down the report's attribution, and merge the mentions into one row per condition."""
    from caretrail.functions.scalars import classify_system
    from caretrail.operators import merge, text

    def job(documents: DataFrame) -> DataFrame:
        documents = dealt(documents.select("record_id", "text"), documents.count())
        chunks = text.chunk(text.redact(documents.select("record_id", "text", F.lit(None).cast(text.SECTION).alias("sections"))).drop("edits"))
        by = ["record_id", "chunk_no"]
        # written, as parsing reads the answers three times: otherwise every text would be redacted and cut for each
        parsed = text.parse_extraction(written(written(chunks.select(*by), "chunks").join(responses.select(*by, "content"), by), "answers"), by)
        said = text.inherit_report_attribution(parsed, by).withColumns(
            {
                "seq": F.col("chunk_no").cast("long") * 1_000_000 + F.col("line_no"),
                "organ": F.lit(None).cast("string"),
                "system": classify_system(F.col("name_medical"), F.col("notes")),
                "status": F.lit("documented"),
                "date_diagnosed": F.col("earliest_date"),
                "provider_name": F.col("provider"),
                "facility_name": F.col("facility"),
            }
        )
        merged = merge.merge_conditions(said.drop("provider", "facility"), ["record_id"])
        return merged.select("record_id", "condition_key", "name_medical", "system", "status", "date_diagnosed", "provider_name", "facility_name", "n_mentions")

    return job


def keep_current(groups: DataFrame, root: str, store: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts the groups that a batch changed; with a watermark, state of groups that can no longer change is dropped."""
    apply = lambda batch, n: upsert_batch(batch, n, root, store, key)
    return groups.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_call_health(calls: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Calls and failures per model and window; rows later than the watermark are left out."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "model")
        .agg(F.count("*").alias("n_attempts"), F.sum(F.when(F.col("http_status") == 200, 1).otherwise(0)).alias("n_ok"), F.sum(F.when(F.col("http_status") == 429, 1).otherwise(0)).alias("n_limited"))
        .select("model", F.col("w.start").alias("since"), "n_attempts", "n_ok", "n_limited")
    )


def stream_call_outcome(calls: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """The outcome of each call as its attempts come in; a call's attempts are within one window."""
    from caretrail.operators.views import call_outcome

    return call_outcome(calls.withWatermark("ts", late), [F.window("ts", window).alias("w"), "call_id"])
