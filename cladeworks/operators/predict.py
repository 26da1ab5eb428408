"""Predictors of classes behind one interface: a text in, a primary class and all candidates out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import stored

#: What a predictor gives for a text: its primary class, or None, and all classes in order of preference.
Predictor = Callable[[str], tuple[str | None, Iterable[str]]]

PREDICTED = "text_ string, primary string, candidates array<string>, failure string"


def predicted(df: DataFrame, column: str, predictor: Predictor, batch: Callable[[list[str]], list[tuple]] | None = None) -> DataFrame:
    """Adds primary, candidates (distinct, in the predictor's order, the primary first) and failure (the error's name, else null).

    The predictor runs once for each distinct text, a null being the empty one; with ``batch`` it is given many at
    a time. An error leaves primary null and candidates empty for that text alone; what a batch
    fails on is tried text by text.
    """

    def one(text: str) -> tuple:
        try:
            primary, every = predictor(text)
            first = [primary] if primary is not None else []
            return primary, list(dict.fromkeys([*first, *(x for x in every if x is not None)])), None
        except Exception as e:
            return None, [], type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text_"].tolist()
            rows = None
            if batch is not None:
                try:
                    answers = dict(zip(texts, batch(texts), strict=True))
                    rows = [(p, list(dict.fromkeys([*([p] if p is not None else []), *(x for x in every if x is not None)])), None) for p, every in map(answers.__getitem__, texts)]
                except Exception:
                    rows = None
            rows = rows or [one(t) for t in texts]
            yield pd.DataFrame({"text_": texts, "primary": [r[0] for r in rows], "candidates": [r[1] for r in rows], "failure": [r[2] for r in rows]})

    done = stored(df.select(F.coalesce(F.col(column), F.lit("")).alias("text_")).distinct().mapInPandas(run, PREDICTED))
    kept = df.drop("primary", "candidates", "failure")
    return kept.join(done, F.coalesce(F.col(column), F.lit("")) == done["text_"]).drop("text_")


def with_lineage(predictions: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds lineage, the path (array, from the root) of the primary class; empty where there is none. ``paths``: node, path."""
    known = stored(paths.groupBy("node").agg(F.max("path").alias("lineage")).withColumnRenamed("node", "primary"))
    empty = F.array().cast("array<string>")
    return predictions.drop("lineage").join(known, "primary", "left").withColumn("lineage", F.coalesce("lineage", empty))
