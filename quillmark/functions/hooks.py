"""Hooks for models of the user's own: embed texts, adjudicate requests, grade requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType


def embedder(embed: Callable[[list[str]], list[list[float]]], dims: int):
    """A column function from texts to vectors at length one; the model is called batch by batch.

    The wrong count of vectors, or a wrong width, is an error.
    """

    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = [np.asarray(v, dtype=float) for v in embed(texts.fillna("").tolist())]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            if any(len(v) != dims for v in vectors):
                raise ValueError(f"a vector is not {dims} wide")
            yield pd.Series([(v / n if (n := np.linalg.norm(v)) else v).tolist() for v in vectors])

    return run


def embed_distinct(texts: DataFrame, column: str, run, model: str, dims: int) -> DataFrame:
    """texts with a vector column; each different text is embedded once."""
    from ..operators.candidates import distinct_texts
    from .signals import embedding_key

    once = distinct_texts(texts, column, model, dims).select("embedding_key", run(F.col("text")).alias("vector"))
    return texts.withColumn("embedding_key", embedding_key(F.col(column), model, dims)).join(once, "embedding_key").drop("embedding_key")


def _each(requests: DataFrame, ask: Callable[[dict], dict | None], schema: str, failed: dict | None) -> DataFrame:
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    said = ask(r)
                except Exception as e:  # one failed call must not lose the others
                    said = None if failed is None else {**failed, "failure": str(e)}
                if said is not None:
                    out.append({"assessment_id": r["assessment_id"], "answer_id": r["answer_id"], **said})
            yield pd.DataFrame(out, columns=names)

    return requests.mapInPandas(run, schema)


def adjudicate(requests: DataFrame, ask: Callable[[dict], dict | None]) -> DataFrame:
    """Verdict rows; a request whose call fails has none, which counts as not consulted."""
    return _each(requests, ask, "assessment_id long, answer_id long, decision string, question_id long, model_confidence double", None)


RECOMMENDED = "assessment_id long, answer_id long, criteria array<struct<criterion_id: string, awarded: double, reason: string>>, total double, confidence double, feedback string, failure string"


def grade(requests: DataFrame, ask: Callable[[dict], dict | None]) -> DataFrame:
    """What the model recommends (RECOMMENDED): marks and reason of each criterion, its own total, confidence, feedback.

    A failed call gives a row with a failure and nothing else, and the others go on.
    """
    return _each(requests, ask, RECOMMENDED, {"criteria": None, "total": None, "confidence": None, "feedback": None})


def recommendation_rows(graded: DataFrame) -> DataFrame:
    """One row per recommended criterion, as grading.verify_recommendations takes them; failed calls have none."""
    rows = graded.where("failure is null").select("assessment_id", "answer_id", F.posexplode("criteria").alias("ordinal", "c"), "total", "confidence")
    return rows.select("assessment_id", "answer_id", "ordinal", "c.criterion_id", "c.awarded", F.col("total").alias("reported_total"), "confidence")
