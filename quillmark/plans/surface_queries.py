"""Registered queries of the jobs at the edges: nested records, files, regions, hooks for models, and running streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import hooks
from ..operators import candidates as cd
from ..operators import decide as dc
from ..operators import grading as gr
from ..operators import ingest as ig
from ..sources import fixtures as fx
from ..sources.scratch import SWEPT, delete, discard, in_place, settings, shared_dir, stash
from ..streaming import jobs
from .queries import query, resolved, shortlist
from .review_queries import as_reviews, event_questions, said, targets_of


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# -- nested records and files -------------------------------------------------------------------------------------
def nested(spark: SparkSession, d: str) -> DataFrame:
    """Assessment records as a service stores them, with their questions, and their answers with regions inside."""
    q, a = fx.questions(spark, d), fx.answers(spark, d)
    region = F.struct(F.col("page").cast("int").alias("pageNumber"), "x", "y", "width", "height", F.when(F.col("diagram"), "diagram").otherwise("text").alias("kind"))
    asked = q.groupBy("assessment_id").agg(F.array_sort(F.collect_list(F.struct(F.col("question_id").cast("string").alias("id"), F.col("label_raw").alias("labelRaw"), F.lit(None).cast("string").alias("normalizedLabel"), "text", "marks", F.col("page").cast("int").alias("pageNumber")))).alias("questions"))
    given = a.groupBy("assessment_id").agg(F.array_sort(F.collect_list(F.struct(F.col("answer_id").cast("string").alias("id"), F.col("claimed_label_raw").alias("claimedLabelRaw"), "text", F.array(region).alias("regions")))).alias("answers"))
    return asked.join(given, "assessment_id", "left").withColumn("id", F.col("assessment_id").cast("string")).drop("assessment_id")


def flattened(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    path = scratch(spark)
    nested(spark, d).write.json(path)
    return ig.flatten_assessments(ig.read_assessments(spark, path))


@query("SELECT CAST(assessment_id AS VARCHAR) AS assessment_id, CAST(question_id AS VARCHAR) AS question_id, label_raw, text, marks, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY assessment_id ORDER BY CAST(question_id AS VARCHAR)) - 1 AS INTEGER) AS position FROM fx_q")
def ingest_nested_questions(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON, read again and flattened to questions."""
    return flattened(spark, d)["questions"].select("assessment_id", F.col("id").alias("question_id"), F.col("labelRaw").alias("label_raw"), "text", "marks", F.col("pageNumber").alias("page"), "position")


@query("SELECT CAST(assessment_id AS VARCHAR) AS assessment_id, CAST(answer_id AS VARCHAR) AS answer_id, CAST(0 AS INTEGER) AS region, CAST(page AS INTEGER) AS page, round(y, 9) AS y, CASE WHEN diagram THEN 'diagram' ELSE 'text' END AS kind FROM fx_a")
def ingest_nested_regions(spark: SparkSession, d: str) -> DataFrame:
    """The same, flattened to the regions of answers."""
    return flattened(spark, d)["regions"].select("assessment_id", "answer_id", "region", F.col("pageNumber").alias("page"), F.round("y", 9).alias("y"), "kind")


QUESTION_BODY = """SELECT question_id, CASE WHEN question_id % 31 = 0 THEN '{{"questions":' ELSE '{{"questions":[{{"labelRaw":"' || label_raw || '","text":"' || text || '","extra":[1],' || CASE WHEN marks IS NULL THEN '' WHEN question_id % 2 = 0 THEN '"marks":"' || cast(cast(marks AS int) AS string) || '",' ELSE '"marks":' || cast(cast(marks AS int) AS string) || ',' END || '"pageNumber":'
  || CASE WHEN question_id % 37 = 0 THEN '0.5' ELSE cast(page AS string) END || ',"rects":[{{"rectPageNumber":"' || cast(page AS string) || '","x":0.1,"y":' || CASE WHEN question_id % 41 = 0 THEN '"Infinity"' ELSE '0.2' END || ',"width":0.7,"height":"0.1"}}]}}]}}' END AS body FROM {q}"""


@query("SELECT question_id, label_raw, text, marks, page, 1 AS n_rects, 'kept' AS outcome FROM fx_q WHERE question_id % 31 <> 0 AND question_id % 37 <> 0 AND question_id % 41 <> 0 UNION ALL SELECT question_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN question_id % 31 = 0 THEN 'malformed' ELSE 'invalid item' END FROM fx_q WHERE question_id % 31 = 0 OR question_id % 37 = 0 OR question_id % 41 = 0")
def ingest_question_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses of a model with numbers as strings, absent marks, unknown fields, and some that are broken."""
    good, bad = ig.parse_question_responses(spark.sql(QUESTION_BODY, q=fx.questions(spark, d)))
    kept = good.select("question_id", "label_raw", "text", "marks", F.col("page").cast("long").alias("page"), F.size("rects").alias("n_rects"), F.lit("kept").alias("outcome"))
    none = lambda kind: F.lit(None).cast(kind)
    return kept.unionAll(bad.select("question_id", none("string"), none("string"), none("double"), none("long"), none("int"), "reject_reason"))


@query("SELECT document_id, assessment_id, type, CASE WHEN type = 'ANSWER_SHEET' THEN size + 1 ELSE size END AS size FROM ups")
def ingest_written_results(spark: SparkSession, d: str) -> DataFrame:
    """All documents written by type, then the answer sheets again with another size; the other slice stays."""
    path, u = scratch(spark), spark.sql(fx.UPLOADS, **fx.frames(spark, d, "orders")).select("document_id", "assessment_id", "type", "size")
    ig.write_results(u, path, "type")
    ig.write_results(u.where("type = 'ANSWER_SHEET'").withColumn("size", F.col("size") + 1), path, "type")
    return spark.read.parquet(path).select("document_id", "assessment_id", "type", "size")


@query("SELECT document_id, type FROM ups")
def ingest_public_documents(spark: SparkSession, d: str) -> DataFrame:
    u = spark.sql(fx.UPLOADS, **fx.frames(spark, d, "orders")).select("document_id", "type", F.col("filename").alias("storage_path"), F.lit("k").alias("storage_key"))
    return ig.public_projection(u)


@query("SELECT assessment_id, page, min(x) AS x, round(min(y), 9) AS y, round(max(x + width) - min(x), 9) AS width, round(max(y + height) - min(y), 9) AS height FROM fx_q GROUP BY 1, 2")
def ingest_page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Smallest rectangle around the questions of each page."""
    rects = fx.questions(spark, d).groupBy("assessment_id", "page").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("rects"))
    box = rects.select("assessment_id", "page", geo.union_rects(F.col("rects")).alias("b"))
    return box.select("assessment_id", "page", "b.x", F.round("b.y", 9).alias("y"), F.round("b.width", 9).alias("width"), F.round("b.height", 9).alias("height"))


@query(
    "SELECT p_partkey, w > 0 AS known, CASE WHEN w > 0 THEN round(least(1.0, 100.0 / w), 9) END AS x, CASE WHEN w > 0 THEN round(least(1.0, (100.0 + p_size * 20) / w) - least(1.0, 100.0 / w), 9) END AS width, CASE WHEN w > 0 THEN round(0.25 * w, 6) END AS pixel_x, CASE WHEN w > 0 THEN CAST(700 AS DOUBLE) END AS pixel_height FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE CAST(50 + p_partkey % 901 AS DOUBLE) END AS w FROM part)"
)
def ingest_rect_units(spark: SparkSession, d: str) -> DataFrame:
    """Pixel rectangles to clamped unit rectangles, and unit rectangles to pixels; pages without a size give null."""
    w = F.when(F.col("p_partkey") % 9 == 0, 0.0).otherwise((50 + F.col("p_partkey") % 901).cast("double"))
    p = fx.frames(spark, d, "part")["part"].select("p_partkey", "p_size", w.alias("w"))
    unit = geo.to_normalized_rect(F.lit(100.0), F.lit(100.0), F.col("p_size") * 20.0, F.lit(50.0), F.col("w"), F.lit(1400.0))
    pixel = geo.to_pixel_rect(F.lit(0.25), F.lit(0.25), F.lit(0.5), F.lit(0.5), F.col("w"), F.lit(1400.0))
    return p.select("p_partkey", unit.alias("u"), pixel.alias("p")).select("p_partkey", F.col("u").isNotNull().alias("known"), F.round("u.x", 9).alias("x"), F.round("u.width", 9).alias("width"), F.round("p.x", 6).alias("pixel_x"), F.col("p.height").alias("pixel_height"))


# -- hooks: small functions stand in for models -------------------------------------------------------------------
def _embed(texts: list[str]) -> list[list[float]]:
    return [[1.0, float(len(t))] for t in texts]


@query("SELECT conv_id, turn, round(1 / sqrt(1 + length(t) * length(t)), 9) AS first FROM (SELECT conv_id, turn, min(text) OVER (PARTITION BY regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL)")
def hook_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Each different text is embedded once and its vector joined back."""
    rows = fx.frames(spark, d, "conversations")["conversations"].where("text is not null")
    return hooks.embed_distinct(rows, "text", hooks.embedder(_embed, 2), "lengths", 2).select("conv_id", "turn", F.round(F.col("vector")[0], 9).alias("first"))


def _adjudicate(r: dict) -> dict:
    if r["answer_id"] % 11 == 0:
        raise RuntimeError("no answer")
    return {"decision": "MATCH", "question_id": r["shortlist"][0]["question_id"], "model_confidence": 0.5}


@query("SELECT t.assessment_id, t.answer_id, 'MATCH' AS decision, t.question_id, CAST(0.5 AS DOUBLE) AS model_confidence FROM top3 t JOIN gate g ON t.answer_id = g.answer_id AND NOT g.decisive WHERE t.rank = 1 AND t.answer_id % 11 <> 0")
def hook_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Requests to a function that takes the first of each shortlist, and fails now and then."""
    requests = dc.build_verdict_requests(shortlist(spark, d), fx.answers(spark, d), resolved(spark, d))
    return stash(hooks.adjudicate(requests, _adjudicate), fx.dealing(spark, d), bucketed=False)


def _grade(r: dict) -> dict:
    if r["answer_id"] % 11 == 0:
        raise RuntimeError("no answer")
    marks = [{"criterion_id": c["criterion_id"], "awarded": float(c["max_marks"] // 2), "reason": "half"} for c in r["criteria"]]
    return {"criteria": marks, "total": sum(m["awarded"] for m in marks), "confidence": 0.5, "feedback": "f", "failure": None}


@query("SELECT c.answer_id, c.criterion_id, floor(c.max_marks / 2) AS awarded, sum(floor(c.max_marks / 2)) OVER (PARTITION BY c.answer_id) AS reported_total FROM crit c WHERE c.answer_id % 11 <> 0")
def hook_grades(spark: SparkSession, d: str) -> DataFrame:
    """Requests to a function that gives half of each criterion's marks, and fails now and then."""
    requests = gr.build_grading_requests(targets_of(spark, d), fx.answers(spark, d))
    return hooks.recommendation_rows(hooks.grade(requests, _grade)).select("answer_id", "criterion_id", "awarded", "reported_total")


# -- streams ------------------------------------------------------------------------------------------------------
def table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream; a pattern, since streams take folders and patterns but no single file."""
    return jobs.read_events(spark, f"{d}/{name}.parque[t]")


def events_stream(spark: SparkSession, d: str, query_text: str) -> DataFrame:
    return spark.sql(query_text, events=table_stream(spark, d, "events"))


@query("SELECT assessment_id, event_id, answer_id, action, target, outcome, sts[i] AS status, nws[i] + assessment_id * 10 AS final_question_id FROM rv_steps WHERE k > 0")
def stream_review_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The action log run as a stream, with keyed state."""
    found = jobs.stream_review_state(events_stream(spark, d, fx.ACTIONS), as_reviews(said(spark, d)), event_questions(spark, d))
    return jobs.run_once(found, scratch(spark), "append", scratch(spark), expires=True).drop("batch_id")


@query("SELECT assessment_id, arg_max(stage, row(ts, event_id)) AS stage, CAST(round(arg_max(stage, row(ts, event_id)) / 6.0 * 100) AS INTEGER) AS progress FROM fx_st GROUP BY 1")
def stream_live_progress(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_once(jobs.progress(events_stream(spark, d, fx.STAGES)), scratch(spark), "complete", scratch(spark))


@query("SELECT provider, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls FROM fx_us GROUP BY 1, 2")
def stream_live_usage(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.run_once(jobs.usage_by_minute(events_stream(spark, d, fx.USAGE)), scratch(spark), "complete", scratch(spark))
    return found.withColumn("minute", F.col("minute").cast("long"))


#: Files that one batch of an arriving table may have: as many as there are.
ALL_FILES = 1_000_000


def arriving(spark: SparkSession, rows: DataFrame, parts: int, part: Column, run: Callable[[DataFrame], None]) -> None:
    """Lets rows come in so many parts, one micro-batch each: run starts a stream over what has come, with one checkpoint."""
    path = scratch(spark)
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(path)
        run(jobs.read_events(spark, path, ALL_FILES))


@query("SELECT assessment_id, answer_id, question_id, rank, candidate_score FROM top3")
def stream_new_answer_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Answers arrive in three parts that cut through assessments, and are scored against the static questions."""
    path, checkpoint, dealt = scratch(spark), scratch(spark), fx.dealing(spark, d)
    asked, vectors = stash(resolved(spark, d), dealt), fx.embeddings(spark, d)
    score = lambda answers: cd.best_candidates(answers, asked, vectors).select("assessment_id", "answer_id", "question_id", "rank", "candidate_score")
    with settings(spark, SWEPT | (in_place(dealt) if dealt else {})):
        arriving(spark, fx.answers(spark, d), 3, F.pmod(F.xxhash64("answer_id"), F.lit(3)), lambda rows: jobs.stream_new_answers(rows, score, checkpoint, path))
    found = stash(jobs.new_answer_results(spark, path))
    discard(asked)
    delete(spark, path)
    return found


@query(
    "SELECT assessment_id, stage, batch_id, asked_at FROM (SELECT *, max(asked_at) OVER (PARTITION BY assessment_id, stage ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT assessment_id, stage, batch_id, max(ts) OVER (PARTITION BY assessment_id, batch_id) AS asked_at FROM (SELECT *, CAST(event_id % 4 AS INTEGER) AS batch_id FROM fx_st))) WHERE before IS NULL OR asked_at > before"
)
def stream_incremental_runs(spark: SparkSession, d: str) -> DataFrame:
    """Requests for stages arrive in four parts, out of order; what has not been done since it was asked for is done."""
    path, checkpoint = scratch(spark), scratch(spark)
    requests = spark.sql(fx.STAGES, **fx.frames(spark, d, "events"))
    arriving(spark, requests, 4, F.col("event_id") % 4, lambda rows: jobs.run_incrementally(rows.select("assessment_id", "stage", "ts"), lambda todo: todo, checkpoint, path))
    return spark.read.parquet(f"{path}/results").select("assessment_id", "stage", "batch_id", "asked_at")


@query(
    "SELECT provider, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls, (SELECT count(*) FROM arrived WHERE gone) AS late FROM arrived WHERE NOT gone GROUP BY 1, 2",
    arrived="SELECT *, coalesce(date_trunc('minute', ts) + INTERVAL 1 MINUTE <= newest - INTERVAL 5 MINUTE, false) AS gone FROM (SELECT u.*, (SELECT max(o.ts) FROM fx_us o WHERE o.event_id % 4 <= u.event_id % 4 - 2) AS newest FROM fx_us u)",
)
def stream_late_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage arrives in four parts, out of order; rows beyond the watermark are dropped and counted."""
    path, checkpoint = scratch(spark), scratch(spark)
    found: list[tuple[DataFrame, int]] = []
    take = lambda rows: found.append(jobs.usage_with_late_rows(rows, checkpoint, path))
    arriving(spark, spark.sql(fx.USAGE, **fx.frames(spark, d, "events")), 4, F.col("event_id") % 4, take)
    late = sum(n for _, n in found)
    return found[-1][0].select("provider", F.col("minute").cast("long").alias("minute"), "tokens", "calls", F.lit(late).cast("long").alias("late"))
