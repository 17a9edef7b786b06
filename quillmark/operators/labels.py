"""Label jobs over questions: orphans resolved in reading order, total order, display numbers, embedding texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normalized_label, parse_label, roman_to_int
from ..sources.scratch import stash
from .scan import WHOLE_ROWS, in_order


def with_parsed(rows: DataFrame, label: str, name: str, **more: F.Column) -> DataFrame:
    """Adds name: parse_label of the column label, and more: other expressions over it (as the column label).

    Labels repeat, so each different one is parsed once, and rows look it up; null labels have nulls.
    """
    different = rows.select(F.col(label).alias("label")).where("label is not null").distinct()
    parsed = stash(different.select(F.col("label").alias("__label"), parse_label(F.col("label")).alias(name), *(v.alias(k) for k, v in more.items())))
    return rows.join(parsed, F.col(label) == F.col("__label"), "left").drop("__label")


def resolve_orphans(questions: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Adds major, minor, roman, normalized_label, parent_label, is_sub to rows with label_raw, page, y, question_id.

    Within an assessment the last number printed above is carried forward: an orphan '(a)' under 6 becomes 6-a; a row
    without any number, such as OR, only borrows the number for its place in the order.
    """
    parsed = with_parsed(questions, "label_raw", "p")
    printed = F.when((F.col("p.major") > 0) & ~F.col("p.is_orphan"), F.col("p.major"))
    rows = in_order(parsed, "assessment_id", ["page", "y", "question_id"], carried={"above": printed}, whole_rows=whole_rows)
    rows = rows.withColumn("above", F.coalesce("above", F.lit(0)))
    adopted = F.col("p.is_orphan") & (F.col("above") > 0)
    major = F.when(F.col("p.major") > 0, F.col("p.major")).otherwise(F.col("above"))
    return rows.select(
        *questions.columns,
        major.alias("major"),
        F.col("p.minor").alias("minor"),
        F.col("p.roman").alias("roman"),
        F.when(adopted, normalized_label(F.col("above"), F.col("p.minor"), F.col("p.roman"), F.lit(""))).otherwise(F.col("p.normalized")).alias("normalized_label"),
        F.when(adopted, F.col("above").cast("string")).otherwise(F.col("p.parent")).alias("parent_label"),
        F.col("p.is_sub").alias("is_sub"),
        (F.col("p.is_orphan") & ~adopted).alias("is_orphan"),
    )


def question_order() -> list:
    """Sort keys: number, then missing sub-parts before present ones, then the label as printed."""
    return [F.col("major"), F.col("minor").asc_nulls_first(), roman_to_int(F.col("roman")).asc_nulls_first(), F.col("label_raw"), F.col("question_id")]


def with_question_index(questions: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Adds question_at (from 0) and question_count within the assessment."""
    return in_order(questions, "assessment_id", question_order(), at="question_at", count="question_count", whole_rows=whole_rows)


def display_numbers(questions: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Adds display_number: the printed number, else the last one above it in order, else the place in the order."""
    own = F.nullif(F.regexp_extract("label_raw", r"([0-9]+)", 1), F.lit(""))
    rows = in_order(questions, "assessment_id", question_order(), at="__place", carried={"__above": own}, whole_rows=whole_rows)
    return rows.withColumn("display_number", F.coalesce("__above", (F.col("__place") + 1).cast("string"))).drop("__place", "__above")


def embedding_texts(questions: DataFrame) -> DataFrame:
    """(assessment_id, question_id, embedding_text): a sub-question's text stands under its parent's."""
    parents = questions.where(~F.col("is_sub")).groupBy("assessment_id", F.col("major").cast("string").alias("parent_label"))
    parents = parents.agg(F.min_by("text", F.struct("page", "y", "question_id")).alias("parent_text"))
    joined = questions.join(parents, ["assessment_id", "parent_label"], "left")
    text = F.when(F.col("is_sub") & F.col("parent_text").isNotNull(), F.concat_ws("\n", "parent_text", "text")).otherwise(F.col("text"))
    return joined.select("assessment_id", "question_id", text.alias("embedding_text"))
