"""Validation: readings split into accepted rows and rejects with the first broken rule; reports and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, valid_rect
from ..functions.labels import parse_label, trimmed

UNCLEAR = "[unclear]"


def blank(col: F.Column) -> F.Column:
    return F.coalesce(F.length(trimmed(col)) == 0, F.lit(True))


def _split(judged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return judged.where("reject_code is null").select(*columns), judged.where("reject_code is not null").select(*columns, "reject_code", "reject_reason")


def _judged(df: DataFrame, rules: list[tuple[F.Column, str, str]]) -> DataFrame:
    code, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bad, c, why in reversed(rules):
        code, reason = F.when(bad, c).otherwise(code), F.when(bad, why).otherwise(reason)
    return df.withColumn("reject_code", code).withColumn("reject_reason", reason)


def _with_regions(readings: DataFrame, pages: DataFrame, column: str, flags: dict[str, F.Column]) -> DataFrame:
    """readings with flags, __none (no region) and __fault: what is wrong with the first bad region, the array column or
    the one of the row; null if nothing: page, geometry, zero area.

    All that needs no pages is judged before the pages of the assessment (few) are joined, so that neither texts nor
    rectangles have to be shuffled unless a caller asks for them.
    """
    known = pages.groupBy("assessment_id").agg(F.collect_set(F.col("page").cast("long")).alias("__known"))
    flaw = lambda r: F.when(~valid_rect(r["x"], r["y"], r["width"], r["height"]), "geometry").when((r["width"] <= 0) | (r["height"] <= 0), "zero area")
    place = lambda r: F.struct(r["page"].cast("long").alias("page"), flaw(r).alias("flaw"))
    regions = F.col(column) if column in readings.columns else F.array(F.struct("page", "x", "y", "width", "height"))
    none = F.coalesce(F.size(regions) < 1, F.lit(True))
    judged = readings.withColumns(flags | {"__none": none, "__places": F.transform(regions, place)}).join(known, "assessment_id", "left")
    fault = lambda p: F.when(~F.coalesce(F.array_contains("__known", p["page"]), F.lit(False)), "page").otherwise(p["flaw"])
    return judged.withColumn("__fault", F.get(F.filter(F.transform("__places", fault), lambda x: x.isNotNull()), F.lit(0)))


def _region_rules() -> list[tuple[F.Column, str, str]]:
    bad = lambda why: F.coalesce(F.col("__fault") == why, F.lit(False))
    return [(F.col("__none"), "REJECTED_CANDIDATE", "no region"), (bad("page"), "PAGE_OUT_OF_RANGE", "page"), (bad("geometry"), "REJECTED_CANDIDATE", "geometry"), (bad("zero area"), "REJECTED_CANDIDATE", "zero area")]


def validate_questions(readings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the first rule broken: label, text, page, marks, no rectangle, first bad rectangle.

    readings: page is the question's own; rects, if there is such a column, holds its rectangles (page, x, y, width,
    height), else the row has one. Empty tables give none, rows whose assessment has no page are rejected.
    """
    bad_marks = F.col("marks").isNotNull() & (~finite(F.col("marks")) | (F.col("marks") < 0))
    joined = _with_regions(readings, pages, "rects", {"__label": blank(F.col("label_raw")), "__text": blank(F.col("text")), "__marks": bad_marks})
    no_page = ~F.coalesce(F.array_contains("__known", F.col("page").cast("long")), F.lit(False))
    rules = [(F.col("__label"), "REJECTED_CANDIDATE", "no label"), (F.col("__text"), "REJECTED_CANDIDATE", "no text"), (no_page, "PAGE_OUT_OF_RANGE", "page"), (F.col("__marks"), "REJECTED_CANDIDATE", "marks"), *_region_rules()]
    return _split(_judged(joined, rules), readings.columns)


def validate_answers(readings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the first rule broken: text, all unclear, no region, first bad region.

    readings: regions, if there is such a column, holds the regions (page, x, y, width, height), else the row has one.
    """
    unclear = F.length(trimmed(F.replace(F.col("text"), F.lit(UNCLEAR), F.lit("")))) == 0
    joined = _with_regions(readings, pages, "regions", {"__text": blank(F.col("text")), "__unclear": unclear})
    rules = [(F.col("__text"), "REJECTED_CANDIDATE", "no text"), (F.col("__unclear"), "REJECTED_CANDIDATE", "all unclear"), *_region_rules()]
    return _split(_judged(joined, rules), readings.columns)


def substantive(text: F.Column) -> F.Column:
    """Whether text is left once the marks of unclear passages are taken away."""
    return F.coalesce(F.length(trimmed(F.replace(text, F.lit(UNCLEAR), F.lit("")))) > 0, F.lit(False))


def derive_answer_columns(answers: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds the trimmed claim, its canonical key, distinct pages, spans_pages, uncertain and contains_diagram.

    regions: (answer_id, page, kind) rows.
    """
    grouped = regions.groupBy("answer_id").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.bool_or(F.col("kind") == "diagram").alias("contains_diagram"))
    claim = F.nullif(trimmed(F.col("claimed_label_raw")), F.lit(""))
    rows = answers.withColumn("claim", claim).join(grouped, "answer_id", "left")
    return rows.withColumn("claim_key", parse_label(F.col("claim"))["normalized"]).withColumn("spans_pages", F.coalesce(F.size("pages") > 1, F.lit(False))).withColumn("uncertain", F.col("text").contains(UNCLEAR))


def duplicate_report(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys that several rows of an assessment share; all rows are kept, this only warns."""
    found = df.where(F.col(key).isNotNull()).groupBy("assessment_id", key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids"))
    return found.where("n > 1")


def answer_reports(answers: DataFrame) -> DataFrame:
    """Counts of uncertain and unlabelled answers per assessment."""
    return answers.groupBy("assessment_id").agg(F.count("*").alias("answers"), F.count_if(F.col("text").contains(UNCLEAR)).alias("uncertain"), F.count_if(blank(F.col("claimed_label_raw"))).alias("unlabelled"))


def enum_violations(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows whose value is outside the domain; null counts as outside."""
    return df.where(~F.coalesce(F.col(column).isin(domain), F.lit(False)))


def all_rejected_assessments(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Assessments with readings of which none was accepted."""
    return rejected.groupBy("assessment_id").agg(F.count("*").alias("rejected")).join(accepted.select("assessment_id"), "assessment_id", "left_anti")
