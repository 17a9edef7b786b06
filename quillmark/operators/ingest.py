"""Ingest: nested records and model responses flattened into tables, uploads classified, pages reconciled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.geometry import finite
from ..functions.labels import let

# Formats by leading bytes (hex), MIME type and extension.
SIGNATURES = (("89504E470D0A1A0A", "PNG"), ("255044462D", "PDF"), ("FFD8FF", "JPEG"))
MIME_FORMATS = {"application/pdf": "PDF", "image/png": "PNG", "image/jpeg": "JPEG"}
EXTENSION_FORMATS = {".pdf": "PDF", ".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG"}

RECT = "x double, y double, width double, height double"
ASSESSMENT_SCHEMA = (
    "id string, status string, stage string, title string, createdAt string, updatedAt string, "
    "documents array<struct<id: string, type: string, status: string, sizeBytes: bigint, pageCount: int, uploadedAt: string, pages: array<struct<pageNumber: int, width: int, height: int, sizeBytes: bigint>>>>, "
    "questions array<struct<id: string, labelRaw: string, normalizedLabel: string, text: string, marks: double, pageNumber: int>>, "
    "answers array<struct<id: string, claimedLabelRaw: string, text: string, regions: array<struct<pageNumber: int, x: double, y: double, width: double, height: double, kind: string>>>>, "
    "mappings array<struct<id: string, answerId: string, questionId: string, status: string, confidence: double, confidenceBand: string, reasonCodes: array<string>>>, "
    "reviews array<struct<id: string, answerId: string, status: string, trigger: string>>, "
    "grades array<struct<id: string, answerId: string, questionId: string, status: string, awardedMarks: double, maximumMarks: double, isCurrent: boolean, supersededReason: string>>, "
    "completedStages array<struct<stage: string, completedAt: string>>"
)


def read_assessments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(ASSESSMENT_SCHEMA).format(fmt).load(path)


def flatten_assessments(df: DataFrame) -> dict[str, DataFrame]:
    """The relations of nested assessment records; a missing or null array gives no rows."""
    out = {"assessments": df.select(F.col("id").alias("assessment_id"), "status", "stage", "title", F.to_timestamp("createdAt").alias("created_at"), F.to_timestamp("updatedAt").alias("updated_at"))}
    for name in ("documents", "questions", "answers", "mappings", "reviews", "grades", "completedStages"):
        out[name] = df.select(F.col("id").alias("assessment_id"), F.posexplode(name).alias("position", "r")).select("assessment_id", "position", "r.*")
    docs = out["documents"]
    out["pages"] = docs.select("assessment_id", F.col("id").alias("document_id"), F.explode("pages").alias("p")).select("assessment_id", "document_id", "p.*")
    out["regions"] = out["answers"].select("assessment_id", F.col("id").alias("answer_id"), F.posexplode("regions").alias("region", "r")).select("assessment_id", "answer_id", "region", "r.*")
    return out


def number(col: Column) -> Column:
    """A number that may be written as a string; null if it is none or not finite."""
    return let(F.trim(col).try_cast("double"), lambda value: F.when(finite(value), value))


def page_number(col: Column) -> Column:
    return let(number(col), lambda value: F.when((value >= 1) & (value == F.floor(value)), value.cast("int")))


NUMBERS = "x: string, y: string, width: string, height: string"
QUESTION_RESPONSE = f"questions array<struct<labelRaw: string, text: string, marks: string, pageNumber: string, rects: array<struct<rectPageNumber: string, {NUMBERS}>>>>"
ANSWER_RESPONSE = f"answers array<struct<claimedLabelRaw: string, text: string, regions: array<struct<pageNumber: string, {NUMBERS}, kind: string>>>>"
VERDICT_RESPONSE = "decision string, questionId string, reasonCode string, confidence string"
GRADING_RESPONSE = "criteria array<struct<criterionId: string, awardedMarks: string, reason: string>>, totalAwardedMarks string, confidence string, feedback string"


def _parsed(df: DataFrame, schema: str, column: str) -> DataFrame:
    return df.withColumn("j", F.from_json(F.col(column), schema))


def _judged(df: DataFrame, schema: str, column: str, list_name: str, item: Callable[[Column], Column], bad: Callable[[Column], Column]) -> DataFrame:
    """df's other columns with found: reject_reason, null if the response is good, and items, each as item makes it of a
    record of its list. A response is parsed, and its numbers are read, once: found comes out of a generator, behind
    which no later filter or projection can copy the expression."""

    def judge(items: Column) -> Column:
        reason = F.when(items.isNull(), "malformed").when(F.exists(items, bad), "invalid item")
        return F.struct(reason.alias("reject_reason"), items.alias("items"))

    found = let(F.transform(F.from_json(F.col(column), schema)[list_name], item), judge)
    return df.select(*(c for c in df.columns if c != column), F.explode_outer(F.array(found)).alias("found"))


def _broken(rect: Column) -> Column:
    """Whether a rectangle of _rect lacks its page or a number."""
    return rect["page"].isNull() | rect["x"].isNull() | rect["y"].isNull() | rect["width"].isNull() | rect["height"].isNull()


def _rect(page: Column, r: Column) -> list[Column]:
    return [page_number(page).alias("page"), *(number(r[c]).alias(c) for c in ("x", "y", "width", "height"))]


def parse_question_responses(df: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(questions, rejects) of JSON responses. Numbers may be strings; absent marks are null; unknown fields vanish. A
    response with any bad number or missing field is rejected whole, with the reason."""
    item = lambda q: F.struct(
        q["labelRaw"].alias("label_raw"), q["text"].alias("text"), number(q["marks"]).alias("marks"), q["marks"].isNotNull().alias("marked"), page_number(q["pageNumber"]).alias("page"),
        F.transform(q["rects"], lambda r: F.struct(*_rect(r["rectPageNumber"], r))).alias("rects"),
    )
    bad = lambda q: q["label_raw"].isNull() | q["text"].isNull() | q["page"].isNull() | (q["marked"] & q["marks"].isNull()) | q["rects"].isNull() | F.coalesce(F.exists(q["rects"], _broken), F.lit(False))
    judged = _judged(df, QUESTION_RESPONSE, column, "questions", item, bad)
    keys = [c for c in df.columns if c != column]
    good = judged.where("found.reject_reason is null").select(*keys, F.posexplode("found.items").alias("ordinal", "q")).select(*keys, "ordinal", *(f"q.{c}" for c in ("label_raw", "text", "marks", "page", "rects")))
    return good, judged.where("found.reject_reason is not null").select(*keys, "found.reject_reason")


def parse_answer_responses(df: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(answers, rejects); a region of an unknown kind is text, an absent label is null."""
    kind = lambda r: F.when(r["kind"].isin("text", "diagram"), r["kind"]).otherwise("text").alias("kind")
    item = lambda a: F.struct(a["claimedLabelRaw"].alias("claimed_label_raw"), a["text"].alias("text"), F.transform(a["regions"], lambda r: F.struct(*_rect(r["pageNumber"], r), kind(r))).alias("regions"))
    bad = lambda a: a["text"].isNull() | a["regions"].isNull() | F.coalesce(F.exists(a["regions"], _broken), F.lit(False))
    judged = _judged(df, ANSWER_RESPONSE, column, "answers", item, bad)
    keys = [c for c in df.columns if c != column]
    good = judged.where("found.reject_reason is null").select(*keys, F.posexplode("found.items").alias("ordinal", "a")).select(*keys, "ordinal", "a.claimed_label_raw", "a.text", "a.regions")
    return good, judged.where("found.reject_reason is not null").select(*keys, "found.reject_reason")


def parse_verdicts(df: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(verdicts, rejects): an unknown decision is rejected; a missing reason is INSUFFICIENT_EVIDENCE, a bad confidence 0."""
    parsed = _parsed(df, VERDICT_RESPONSE, column)
    keys = [c for c in df.columns if c != column]
    ok = F.coalesce(F.col("j.decision").isin("MATCH", "NO_MATCH"), F.lit(False))
    good = parsed.where(ok).select(*keys, F.col("j.decision").alias("decision"), F.col("j.questionId").alias("question_id"), F.coalesce("j.reasonCode", F.lit("INSUFFICIENT_EVIDENCE")).alias("reason_code"), F.coalesce(number(F.col("j.confidence")), F.lit(0.0)).alias("model_confidence"))
    return good, parsed.where(~ok).select(*keys, F.lit("decision").alias("reject_reason"))


def parse_recommendations(df: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(criterion rows, rejects): at least one criterion, no negative or broken mark; a bad confidence is 0."""
    parsed = _parsed(df, GRADING_RESPONSE, column)
    keys = [c for c in df.columns if c != column]
    mark = lambda c: F.coalesce(number(c) >= 0, F.lit(False))
    bad = F.exists("j.criteria", lambda c: F.coalesce(F.length(c["criterionId"]) == 0, F.lit(True)) | ~mark(c["awardedMarks"]) | c["reason"].isNull())
    reason = F.when(F.coalesce(F.size("j.criteria"), F.lit(0)) < 1, "no criteria").when(bad, "invalid criterion").when(~mark(F.col("j.totalAwardedMarks")), "total").when(F.col("j.feedback").isNull(), "feedback")
    judged = parsed.withColumn("reject_reason", reason)
    rows = judged.where("reject_reason is null").select(*keys, F.posexplode("j.criteria").alias("ordinal", "c"), number(F.col("j.totalAwardedMarks")).alias("reported_total"), F.coalesce(number(F.col("j.confidence")), F.lit(0.0)).alias("confidence"))
    good = rows.select(*keys, "ordinal", F.col("c.criterionId").alias("criterion_id"), number(F.col("c.awardedMarks")).alias("awarded"), F.trim("c.reason").alias("reason"), "reported_total", "confidence")
    return good, judged.where("reject_reason is not null").select(*keys, "reject_reason")


def scan_uploads(spark: SparkSession, path: str, c: Config = DEFAULT) -> DataFrame:
    """(filename, size, head): the first bytes of each file whose size may be accepted; others are not opened, and have
    no head. Spark's reader does not list files of no bytes at all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length").between(1, c.max_bytes)
    opened = files.where(fits).select(F.col("path").alias("filename"), F.col("length").alias("size"), F.substring("content", 1, 8).alias("head"))
    return opened.unionAll(files.where(~fits).select("path", "length", F.lit(None).cast("binary")))


def classify_uploads(df: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Adds verdict (ACCEPTED, EMPTY, TOO_LARGE, UNSUPPORTED), format and claim_mismatch. df: filename, size, head, mime.

    Size is judged before content; content decides the format, MIME type and extension are only claims.
    """
    head, found = F.hex("head"), F.lit(None).cast("string")
    for prefix, name in reversed(SIGNATURES):
        found = F.when(head.startswith(prefix), name).otherwise(found)
    lookup = lambda table, key: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    by_mime = lookup(MIME_FORMATS, F.lower(F.trim(F.substring_index("mime", ";", 1))))
    by_name = lookup(EXTENSION_FORMATS, F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)))
    verdict = F.when((F.coalesce("size", F.lit(0)) <= 0) | F.coalesce(F.length("head") == 0, F.lit(False)), "EMPTY").when(F.col("size") > c.max_bytes, "TOO_LARGE").when(found.isNull(), "UNSUPPORTED").otherwise("ACCEPTED")
    mismatch = F.coalesce(by_mime != found, F.lit(False)) | F.coalesce(by_name != found, F.lit(False))
    ok = F.col("verdict") == "ACCEPTED"
    return df.withColumn("verdict", verdict).withColumn("format", F.when(ok, found)).withColumn("claim_mismatch", F.when(ok, mismatch))


def latest_document_per_type(documents: DataFrame) -> DataFrame:
    order = Window.partitionBy("assessment_id", "type").orderBy(F.desc("uploaded_at"), F.desc("document_id"))
    return documents.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def reconcile_pages(expected: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with reusable, pages to prepare again): a page is reusable if it is stored with the same size and
    dimensions; a document if all its pages are."""
    s = stored.select("document_id", "page_number", F.col("size").alias("has_size"), F.col("width").alias("has_width"), F.col("height").alias("has_height"))
    joined = expected.join(s, ["document_id", "page_number"], "left")
    same = F.coalesce((F.col("size") == F.col("has_size")) & (F.col("width") == F.col("has_width")) & (F.col("height") == F.col("has_height")), F.lit(False))
    judged = joined.withColumn("reusable", same)
    return judged.groupBy("document_id").agg(F.bool_and("reusable").alias("reusable"), F.count("*").alias("pages")), judged.where("not reusable").select("document_id", "page_number")


def missing_document_types(assessments: DataFrame, documents: DataFrame, types: tuple[str, ...] = ("QUESTION_PAPER", "ANSWER_SHEET")) -> DataFrame:
    """(assessment_id, type) that an assessment lacks."""
    wanted = assessments.select("assessment_id", F.explode(F.array(*map(F.lit, types))).alias("type"))
    return wanted.join(documents.select("assessment_id", "type"), ["assessment_id", "type"], "left_anti")


def write_results(df: DataFrame, path: str, partition: str) -> None:
    """Replace the slices (values of partition) that df has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def public_projection(df: DataFrame, private: tuple[str, ...] = ("storage_key", "storage_path", "path")) -> DataFrame:
    """Without the columns that say where things are stored."""
    return df.drop(*private)
