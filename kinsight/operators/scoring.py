"""Text scorers that work in batches and survive a text they can't handle.

A model takes a list of texts and returns a (score, JSON text) pair for each. Where it raises, the batch is halved
until the failing texts stand alone: each keeps its error, and every other text its result. A batch of n texts with f
failing ones costs at most about 2 f log2(n) calls more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[tuple[float | None, str | None]]]
SCORED = "sentiment_raw double, extraction_raw string, scorer_error string"


def in_bounds(texts: list[str], max_rows: int, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive (begin, end) of at most so many texts and so many UTF-8 bytes; a longer text stands alone."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text.encode("utf-8", "replace"))
        if i > begin and (held + size > max_bytes or i - begin >= max_rows):
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def isolated(model: Model, texts: list[str]) -> list[tuple[float | None, str | None, str | None]]:
    """The model's results with an error each; a batch that raises, or returns another number of results, is halved."""
    out: list[tuple[float | None, str | None, str | None]] = []
    todo = [texts]
    while todo:
        batch = todo.pop()
        try:
            found = list(model(batch))
            if len(found) != len(batch):
                raise ValueError(f"{len(found)} results for {len(batch)} texts")
            rows = [(None if s is None else float(s), None if j is None else str(j), None) for s, j in found]
        except Exception as error:  # whatever a model raises belongs to its texts, not to the job
            if len(batch) == 1:
                out.append((None, None, f"{type(error).__name__}: {error}"))
            else:
                half = len(batch) // 2
                todo += [batch[half:], batch[:half]]
            continue
        out += rows
    return out


def batched_scorer(model_factory: Callable[[], Model], max_rows: int = 256, max_bytes: int = 1_000_000):
    """A scorer for ``enrichment.enrich`` from a model that ``model_factory`` makes once per task.

    Refused texts are NULL here and never reach the model; they, and all texts without an answer, have NULL results.
    ``scorer_error`` holds the whole message of a text that the model raised on. A task that is run again after a lost
    executor makes its results anew, so the model must answer alike for equal texts.
    """

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, columns = model_factory(), ["sentiment_raw", "extraction_raw", "scorer_error"]
        for batch in batches:
            given = [i for i, text in enumerate(batch) if text is not None]
            texts = [batch.iloc[i] for i in given]
            out: list[tuple[float | None, str | None, str | None]] = [(None, None, None)] * len(batch)
            for begin, end in in_bounds(texts, max_rows, max_bytes):
                for i, row in zip(given[begin:end], isolated(model, texts[begin:end]), strict=True):
                    out[i] = row
            yield pd.DataFrame(out, columns=columns).astype({"sentiment_raw": "float64", "extraction_raw": object, "scorer_error": object})

    def scorer(df: DataFrame) -> DataFrame:
        return df.withColumn("_scored", score("scorable_text")).select(*df.columns, "_scored.*")

    return scorer
