"""Pages to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caretrail import reference_data as R


def assemble_document(pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, page_no, text) -> text joined by line breaks, start offset of each page, number of pages."""
    start = F.sum(F.length("text") + 1).over(Window.partitionBy(*by).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    p = pages.select(*by, "page_no", F.coalesce("text", F.lit("")).alias("text")).withColumn("start", F.coalesce(start, F.lit(0)).cast("int"))
    p = p.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page_no", "text", "start"))).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    return p.select(*by, F.array_join(texts, "\n").alias("text"), F.transform("p", lambda x: x["start"]).alias("page_breaks"), F.size("p").alias("page_count"), texts.alias("pages"))


def classify_scanned(docs: DataFrame, min_chars: int = R.SCANNED_CHARS) -> DataFrame:
    """ocr below min_chars characters a page, else text; and the pages that are images only (numbers from 1)."""
    thin = F.transform("pages", lambda x, i: F.when(F.length(F.trim(x)) < min_chars, i + 1))
    return docs.withColumn("method", F.when(F.length("text") / F.greatest("page_count", F.lit(1)) < min_chars, "ocr").otherwise("text")).withColumn(
        "image_only_pages", F.array_compact(thin)
    )
