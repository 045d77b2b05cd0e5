"""Quality classifier: a sparse rule ensemble.

Statistics of the text are Spark columns. Boosted shallow trees on a bounded sample of labelled rows give paths; each path is
a conjunctive rule over the statistics. Lasso logistic regression weighs the rules and drops most. The rules left are compiled
to one Spark column expression, so scoring is a single pass over the texts without Python.

Defined cases: null texts count as empty; empty texts get the score of their (zero) statistics; labels without a text, without
a quality or with a null doc_id are not learnt from; a doc_id labelled twice takes the larger label, and of several texts of one
doc_id the one with the least statistics is learnt from; without labels of both
kinds every text gets the share of label 1 (0.5 without labels) as its score; repeated rows get a row each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import crc_mod, table, text_of, words

#: At most so many labelled rows are learnt from (those with the smallest hashes of their ids).
SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK, LASSO = 16, 3, 48, 0.4, 3e-4
STATISTICS = ["words", "word_length", "length_spread", "variety", "function_words", "symbols", "capitals", "digits", "marks", "lines", "line_spread", "word_runs"]
#: Short words that prose of the languages at hand is full of (fixed values: English, French, German, Spanish).
FUNCTION_WORDS = (
    "a an and are as at be but by for from has have he her his i in is it its my not of on or our she so that the their they this to was we were what which who will with you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dem den der die ein eine einen er es hat ich im ist mit nach nicht oder sich sie sind und von war wie wir zu zum zur "
    "al como con del el ella ellos eran esta este ha han las lo los mas me mi no nos para pero por se si sin su sus una y yo"
).split()


def text_statistics(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """keep and the STATISTICS of each text as columns."""
    out = docs.select(*keep, text.alias("_text"))
    names = [c for c in out.columns if c != "_text"]
    out = out.withColumn("_words", words(F.col("_text")))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    spread = lambda lengths: F.aggregate(lengths, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, n: F.struct((a["s"] + n).alias("s"), (a["q"] + n * n).alias("q")))
    out = out.select(
        *names,
        F.size("_words").alias("words"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).alias("_chars"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(FUNCTION_WORDS))).alias("_function"),
        spread(F.transform("_words", lambda w: F.length(w).cast("double"))).alias("_of_words"),
        spread(F.transform(F.split("_text", "\n", -1), lambda x: F.length(x).cast("double"))).alias("_of_lines"),
        count("[#$%&*<>|~^=+@_{}\\[\\]\\\\/]").alias("_symbols"),
        count("[A-Z]").alias("_capitals"),
        count("[0-9]").alias("_digits"),
        count("[.,;:?!()'\"-]").alias("_marks"),
        count("\\n").alias("_lines"),
        count("(?<![^\\x20\\x09-\\x0D])([^\\x20\\x09-\\x0D]+)(?:\\x20\\1){2}(?![^\\x20\\x09-\\x0D])").alias("_runs"),
    )
    per = lambda a, b: F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(0.0))

    def relative_spread(of: str, n: Column) -> Column:
        """Standard deviation by mean."""
        mean = F.col(f"{of}.s") / n
        return F.coalesce(F.sqrt(F.greatest(F.col(f"{of}.q") / n - mean * mean, F.lit(0.0))) / F.nullif(mean, F.lit(0.0)), F.lit(0.0))

    return out.select(
        *names,
        F.col("words").cast("double").alias("words"),
        per("_chars", "words").alias("word_length"),
        relative_spread("_of_words", F.greatest(F.col("words"), F.lit(1))).alias("length_spread"),
        # log distinct / log words: unlike the plain share it hardly falls with the length
        F.coalesce(F.log(F.col("_distinct") + 1.0) / F.log(F.greatest(F.col("words"), F.lit(1)) + 1.0), F.lit(0.0)).alias("variety"),
        per("_function", "words").alias("function_words"),
        per("_symbols", "_chars").alias("symbols"),
        per("_capitals", "_chars").alias("capitals"),
        per("_digits", "_chars").alias("digits"),
        per("_marks", "words").alias("marks"),
        per("_lines", "words").alias("lines"),
        relative_spread("_of_lines", F.col("_lines") + 1).alias("line_spread"),
        per("_runs", "words").alias("word_runs"),
    )


def _tree(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: list, out: list) -> None:
    """Grows one regression tree on binned statistics; out gets (path, leaf rows, leaf value) for every node below the root."""
    value = -grad[rows].sum() / (hess[rows].sum() + 1.0)
    if path:
        out.append((list(path), rows, value, depth == 0))
    if depth == 0 or len(rows) < 20:
        return
    best, total_g, total_h = (1e-6, None, None), grad[rows].sum(), hess[rows].sum()
    for f in range(codes.shape[1]):
        g = np.bincount(codes[rows, f], grad[rows], BINS).cumsum()[:-1]
        h = np.bincount(codes[rows, f], hess[rows], BINS).cumsum()[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(h < 1) | (total_h - h < 1)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] is None:
        return
    _, f, k = best
    low = codes[rows, f] <= k
    _tree(codes, grad, hess, rows[low], depth - 1, [*path, (f, k, True)], out)
    _tree(codes, grad, hess, rows[~low], depth - 1, [*path, (f, k, False)], out)


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, list[tuple[int, float, bool]]]]]:
    """(bias, [(weight, [(statistic, threshold, at most?)...])...])."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
        return float(np.log(share / (1 - share))), []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        nodes: list = []
        _tree(codes, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), DEPTH, [], nodes)
        step = np.zeros(len(y))
        for path, rows, value, _ in nodes:  # deeper nodes come later and overwrite
            step[rows] = value
            rules.setdefault(tuple(sorted(path)))
        margin += SHRINK * step
    paths = list(rules)
    on = np.ones((len(y), len(paths)), np.float64)
    for r, path in enumerate(paths):
        for f, k, low in path:
            on[:, r] *= (codes[:, f] <= k) == low
    weights, bias = _lasso(on, y)
    kept = [(float(w), [(f, float(edges[f][k]) if k < len(edges[f]) else float("inf"), low) for f, k, low in path]) for w, path in zip(weights, paths, strict=True) if w]
    return float(bias), kept


def _lasso(on: np.ndarray, y: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = on.shape
    step = 4.0 / max(1e-9, np.linalg.norm(on.T @ on / n, 2) + 1)
    w, b, v, vb, t = np.zeros(m), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(m), 0.0, 1.0
    v, vb = w.copy(), b
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(on @ v + vb))) - y
        new = v - step * (on.T @ r / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_b = vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def compile_rules(bias: float, rules) -> Column:
    """The ensemble's score in [0, 1] as an expression over the statistics' columns."""
    z = F.lit(bias)
    for weight, path in rules:
        holds = F.lit(True)
        for f, threshold, low in path:
            c = F.col(STATISTICS[f])
            holds = holds & ((c <= threshold) if low else (c > threshold))
        z = z + F.when(holds, weight).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text"):
    """Fits the rules on at most `sample` labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
    chosen = docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_t")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = text_statistics(chosen, [F.col("_doc").alias("id"), F.col("_y").alias("y")], F.col("_t"))
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(*STATISTICS)).alias("s"))  # one text for each id: `sample` rows at most
    rows = rows.orderBy("id").select("y", "s.*").toPandas()
    return fit_rules(rows[STATISTICS].to_numpy(float), (rows["y"].to_numpy(float) > 0).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(row, score): every input row as a struct, with its score."""
    bias, rules = learn(docs, labels, id_col=id_col, text_col=text_col)
    scored = text_statistics(docs, [F.struct("*").alias("row")], text_of(text_col)).select("row", compile_rules(bias, rules).alias("score"))
    # as the fields of a generated row: a filter on the score then stays above the statistics, which it would otherwise work
    # out once for every rule that names them
    return scored.select(F.inline(F.array(F.struct("row", "score"))))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        F.col("row.doc_id").alias("doc_id"),
        (crc_mod(F.col("row.doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
