"""Quality rules: fences from mergeable quantile sketches per language and source, in place of fixed cutoffs.

The figures of each text are built-in functions over its words and lines. KLL sketches (partial ones per task, merged by
group) give each (lang, source) the quartiles of its figures and the median of what they are shares of; the groups' sketches
merge once more into one per language. A document fails where a figure lies more than FENCE spreads beyond its group's quartile.
The spread is the larger of the group's and the language's distance between quartiles, so that a group of equal documents
takes its language's; shorter texts than the group's median vary more, by the root of the ratio, and a share cannot vary by
less than one event of the text's own size (a repeat, a line, a mark). No cutoff is fixed.

Defined cases: a null text has no words and fails the base rule; null lang or source are groups of their own; a group whose
documents all fail the base rule has no sketch and rejects nothing more; repeated rows count each; an empty table gives no
rows; further columns are ignored. Five-word windows are compared by their 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import materialize, table, text_of, words

WINDOW = 5
FENCE = 4.0
SKETCH = 2048  # k of the sketches: groups of about so many documents are exact, larger ones to 0.2 % of ranks
#: figure, what it is a share of, the least event as a part of that, whether low values fail too
FIGURES = [
    ("symbols", "word_chars", 1, False),
    ("marks", "word_chars", 1, False),
    ("capitals", "word_chars", 1, False),
    ("word_length", "n_words", 0, True),
    ("line_repeats", "n_lines", 1, False),
    ("repeats", "n_words", 2 * WINDOW, False),
]


def window_hashes(w: Column, width: int = WINDOW) -> Column:
    """A hash for each window of `width` words, in order."""
    n = F.size(w)
    hashes = F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))
    return F.coalesce(hashes, F.array().cast("array<bigint>"))


def covered(h: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, from the hashes: sort with positions, keep those equal to a neighbour, sum up the union of their spans."""
    order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    equal = lambda s, x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
    one = F.transform(F.array(order), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: equal(s, x, j)), lambda x: x["i"])))
    spans = F.flatten(F.transform(one, lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)


def text_figures(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    out = docs.select(*keep, text.alias("_text")).withColumn("_words", words(F.col("_text")))
    out = out.withColumn("_h", window_hashes(F.col("_words"))).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    )
    names = [c for c in out.columns if not c.startswith("_")]
    return out.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(covered(F.col("_h"))).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("_text", F.lit("[!-/:-@\\[-`{-~]")).cast("long").alias("n_marks"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """(doc_id, figures..., base_failed, kept), one row per input row."""
    keep = [F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    base = text_figures(docs, keep, text_of(text_col)).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )
    figures = materialize(base, "quality-figures").select(
        "*",
        _ratio("n_symbols", "word_chars").alias("symbols"),
        _ratio("n_marks", "word_chars").alias("marks"),
        _ratio("n_capitals", "word_chars").alias("capitals"),
        _ratio("word_chars", "n_words").alias("word_length"),
        _ratio("n_dup_lines", "n_lines").alias("line_repeats"),
        _ratio("n_repeat_words", "n_words").alias("repeats"),
    )
    fences = materialize(group_quartiles(figures.where(~F.col("base_failed"))), "quality-fences")
    joined = figures.join(fences, figures["lang"].eqNullSafe(F.col("_of.lang")) & figures["source"].eqNullSafe(F.col("_of.source")), "left")
    beyond = F.lit(False)
    for name, _, _, _ in FIGURES:
        beyond = beyond | fails(name)
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("_of", "_q")


def group_quartiles(figures: DataFrame) -> DataFrame:
    """(_of, _q): of each lang and source, per figure its quartiles, the language's spread and the median size."""
    sizes = sorted({size for _, size, _, _ in FIGURES})
    values = [name for name, _, _, _ in FIGURES] + sizes
    sketches = figures.groupBy("lang", "source").agg(*[F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(SKETCH)).alias(v) for v in values])
    sketches = materialize(sketches, "quality-sketches")
    at = lambda v, rank: F.kll_sketch_get_quantile_double(v, F.lit(rank))
    whole = sketches.groupBy("lang").agg(*[F.kll_merge_agg_double(name).alias(name) for name, _, _, _ in FIGURES])
    whole = whole.select(F.col("lang").alias("_lang"), F.struct(*[(at(name, 0.75) - at(name, 0.25)).alias(name) for name, _, _, _ in FIGURES]).alias("_all"))
    of = lambda name, size: F.struct(at(name, 0.25).alias("low"), at(name, 0.75).alias("high"), F.col(f"_all.{name}").alias("spread"), at(size, 0.5).alias("size")).alias(name)
    joined = sketches.join(whole, F.col("lang").eqNullSafe(F.col("_lang")))
    return joined.select(F.struct("lang", "source").alias("_of"), F.struct(*[of(name, size) for name, size, _, _ in FIGURES]).alias("_q"))


def fails(name: str) -> Column:
    """Whether the figure is beyond its group's fence (_q)."""
    (size, event, low), q = next(f[1:] for f in FIGURES if f[0] == name), F.col("_q")[name]
    n = F.greatest(F.col(size), F.lit(1))
    spread = F.greatest(q["high"] - q["low"], q["spread"]) * F.sqrt(F.greatest(q["size"] / n, F.lit(1.0))) + event / n
    out = F.col(name) > q["high"] + FENCE * spread
    return F.coalesce(out | (F.col(name) < q["low"] - FENCE * spread) if low else out, F.lit(False))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
