"""Model calls as a stage: prompts in, attempts out. The model and the check of its answers are the caller's functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, REJECTED, FAILED = 200, 422, 500
LOG = "attempt int, http_status int, content string, error string"


def extract(prompts: DataFrame, by: list[str], extractor: Callable[[pd.Series, int], pd.Series], validate: Callable[[str], bool] | None = None, attempts: int = 3, batch: int = 32, model: str = "model", input_col: str = "input") -> DataFrame:
    """prompts (by, input) -> a row per attempt: by, model, attempt (from 1), http_status, content, error.

    extractor takes a batch of inputs and the attempt's number and gives an answer each; validate says whether an answer will do.
    Inputs whose answer is rejected or null, or whose call raised, are tried again, up to `attempts` times. A call that raises
    fails its whole batch with the exception's `status` (FAILED without one). Prompts stream through the tasks; nothing is kept
    but one batch. A lost task calls the model again, so write the result before using it twice.

    Defined cases: null inputs are empty; an answer list of another length fails the batch; no prompts give no rows.
    """

    def call(inputs: list[str], attempt: int) -> list[tuple[int, str | None, str | None]]:
        try:
            answers = list(extractor(pd.Series(inputs, dtype=object), attempt))
            if len(answers) != len(inputs):
                raise ValueError(f"{len(answers)} answers to {len(inputs)} inputs")
        except Exception as e:  # the caller's model may fail in any way; that is an outcome here
            return [(int(getattr(e, "status", FAILED)), None, f"{type(e).__name__}: {e}")] * len(inputs)
        good = [a is not None and (validate is None or bool(validate(a))) for a in answers]
        return [(OK if g else REJECTED, a, None) for a, g in zip(answers, good, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                open_, inputs = list(range(len(part))), part["_input"].tolist()
                for attempt in range(1, attempts + 1):
                    said = call([inputs[i] for i in open_], attempt)
                    log = pd.DataFrame([(attempt, *s) for s in said], columns=["attempt", "http_status", "content", "error"])
                    log = log.assign(content=[s[1] for s in said], error=[s[2] for s in said])
                    yield pd.concat([part[by].iloc[open_].reset_index(drop=True), log], axis=1)
                    open_ = [i for i, s in zip(open_, said, strict=True) if s[0] != OK]
                    if not open_:
                        break

    rows = prompts.select(*by, F.coalesce(input_col, F.lit("")).alias("_input"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    return rows.mapInPandas(run, f"{keys}, {LOG}").select(*by, F.lit(model).alias("model"), "attempt", "http_status", "content", "error")


def answers(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, content): what was accepted, as parse_extraction reads it."""
    return log.where(F.col("http_status") == OK).select(*by, "content")


def call_log(log: DataFrame, by: list[str]) -> DataFrame:
    """The attempts as rows of a call log: call_id, seq, model, http_status."""
    return log.select(F.concat_ws(":", *[F.col(c).cast("string") for c in by]).alias("call_id"), F.col("attempt").cast("long").alias("seq"), "model", "http_status")
