"""Registered queries of ingest, validation, chunks and merging, and of the event jobs as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import geometry as geo
from ..functions import signals as s
from ..operators import ingest as ig
from ..operators import merge as mg
from ..operators import validate as vd
from ..sources import fixtures as fx
from ..sources.scratch import stash
from ..streaming import jobs
from .oracle import PARTS, parsed
from .queries import query, resolved

TOKENS = "list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+')), lambda w: w <> '')"
IOU = "CASE WHEN least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) AND least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y) THEN (least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) / (a.width * a.height + b.width * b.height - (least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))) ELSE 0 END"
BAD_RECT = "x IS NULL OR x < 0 OR x > 1 OR y < 0 OR y > 1 OR width < 0 OR width > 1 OR height < 0 OR height > 1 OR x + width > 1 + 1e-6 OR y + height > 1 + 1e-6"
JAC = "CASE WHEN len(a.tk) = 0 AND len(b.tk) = 0 THEN 1.0 WHEN len(a.tk) = 0 OR len(b.tk) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.tk, b.tk)) AS DOUBLE) / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) END"

PARTS.update(
    pgs="SELECT DISTINCT assessment_id, page FROM fx_q",
    judged="SELECT r.*, CASE WHEN length(trim(text)) = 0 THEN 'REJECTED_CANDIDATE' WHEN length(trim(replace(text, '[unclear]', ''))) = 0 THEN 'REJECTED_CANDIDATE' WHEN p.page IS NULL THEN 'PAGE_OUT_OF_RANGE' WHEN " + BAD_RECT + " THEN 'REJECTED_CANDIDATE' WHEN width <= 0 OR height <= 0 THEN 'REJECTED_CANDIDATE' END AS reject_code, CASE WHEN length(trim(text)) = 0 THEN 'no text' WHEN length(trim(replace(text, '[unclear]', ''))) = 0 THEN 'all unclear' WHEN p.page IS NULL THEN 'page' WHEN " + BAD_RECT + " THEN 'geometry' WHEN width <= 0 OR height <= 0 THEN 'zero area' END AS reject_reason FROM fx_r r LEFT JOIN pgs p ON r.assessment_id = p.assessment_id AND r.page = p.page",
    rd="SELECT *, answer_id * 10007 + chunk AS reading_id, CASE WHEN answer_id % 7 = 0 THEN 2 ELSE 1 END AS n_pages, CASE WHEN answer_id % 7 = 0 AND local_page = 0 THEN 2 ELSE 1 END AS n_seen, " + TOKENS.format(t="text") + " AS tk FROM fx_r",
    dpages="SELECT assessment_id AS document_id, pos AS page FROM fx_base",
    planned="SELECT document_id, chunk, CAST(i - chunk * 2 AS INTEGER) AS local_index, page FROM (SELECT *, unnest([i // 2 - 1, i // 2]) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM dpages)) WHERE chunk >= 0 AND i < chunk * 2 + 3 AND chunk <= greatest(0, ceil((n - 3) / 2.0))",
    ups=fx.UPLOADS.format(orders="orders"),
)


def with_ids(readings: DataFrame) -> DataFrame:
    """Readings with ids of their own; every seventh answer goes on over the next page, which its first chunk holds."""
    long = F.col("answer_id") % 7 == 0
    seen = F.when(long & (F.col("local_page") == 0), 2).otherwise(1)
    return readings.withColumn("reading_id", F.col("answer_id") * 10007 + F.col("chunk")).withColumn("n_pages", F.when(long, 2).otherwise(1)).withColumn("n_seen", seen)


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    return fx.questions(spark, d).select("assessment_id", "page").distinct()


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return fx.base(spark, d).select(F.col("assessment_id").alias("document_id"), F.col("pos").alias("page"))


# -- validation ---------------------------------------------------------------------------------------------------
@query("SELECT answer_id, chunk FROM judged WHERE reject_code IS NULL")
def ingest_accepted_answers(spark: SparkSession, d: str) -> DataFrame:
    return vd.validate_answers(fx.readings(spark, d), pages_of(spark, d))[0].select("answer_id", "chunk")


@query("SELECT answer_id, chunk, reject_code, reject_reason FROM judged WHERE reject_code IS NOT NULL")
def ingest_rejected_answers(spark: SparkSession, d: str) -> DataFrame:
    return vd.validate_answers(fx.readings(spark, d), pages_of(spark, d))[1].select("answer_id", "chunk", "reject_code", "reject_reason")


BROKEN_Q = "SELECT assessment_id, question_id, CASE WHEN question_id % 41 = 0 THEN ' ' ELSE label_raw END AS label_raw, CASE WHEN question_id % 43 = 0 THEN '' ELSE text END AS text, CASE WHEN question_id % 47 = 0 THEN -1.0 ELSE marks END AS marks, CASE WHEN question_id % 53 = 0 THEN 50 ELSE page END AS page, x, y, CASE WHEN question_id % 59 = 0 THEN cast(0 AS double) WHEN question_id % 61 = 0 THEN cast(0.95 AS double) ELSE width END AS width, height FROM {q}"


@query(
    "SELECT b.question_id, CASE WHEN trim(label_raw) = '' THEN 'no label' WHEN trim(text) = '' THEN 'no text' WHEN p.page IS NULL THEN 'page' WHEN marks < 0 THEN 'marks' WHEN " + BAD_RECT + " THEN 'geometry' WHEN width <= 0 THEN 'zero area' ELSE 'ok' END AS verdict FROM bq b LEFT JOIN pgs p ON b.assessment_id = p.assessment_id AND b.page = p.page",
    bq=BROKEN_Q.format(q="fx_q"),
)
def ingest_judged_questions(spark: SparkSession, d: str) -> DataFrame:
    good, bad = vd.validate_questions(spark.sql(BROKEN_Q, q=fx.questions(spark, d)), pages_of(spark, d))
    return good.select("question_id", F.lit("ok").alias("verdict")).unionAll(bad.select("question_id", "reject_reason"))


@query("SELECT answer_id, nullif(trim(claimed_label_raw), '') AS claim, p_norm AS claim_key, contains(text, '[unclear]') AS uncertain, diagram OR answer_id % 14 = 0 AS contains_diagram, answer_id % 7 = 0 AS spans_pages FROM a_parsed")
def ingest_answer_columns(spark: SparkSession, d: str) -> DataFrame:
    a = fx.answers(spark, d)
    regions = a.select("answer_id", "page", F.when(F.col("diagram"), "diagram").otherwise("text").alias("kind"))
    regions = regions.unionAll(a.where("answer_id % 7 = 0").select("answer_id", F.col("page") + 1, F.when(F.col("answer_id") % 2 == 0, "diagram").otherwise("text")))
    return vd.derive_answer_columns(a, regions).select("answer_id", "claim", "claim_key", "uncertain", "contains_diagram", "spans_pages")


@query("SELECT assessment_id, normalized_label, count(*) AS n, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) AS ids FROM q_res GROUP BY 1, 2 HAVING count(*) > 1")
def ingest_duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    return vd.duplicate_report(resolved(spark, d), "normalized_label", "question_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("SELECT assessment_id, count(*) AS answers, CAST(count_if(contains(text, '[unclear]')) AS BIGINT) AS uncertain, CAST(count_if(claimed_label_raw IS NULL OR trim(claimed_label_raw) = '') AS BIGINT) AS unlabelled FROM fx_a GROUP BY 1")
def ingest_answer_reports(spark: SparkSession, d: str) -> DataFrame:
    return vd.answer_reports(fx.answers(spark, d))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click') OR event_type IS NULL")
def ingest_enum_violations(spark: SparkSession, d: str) -> DataFrame:
    return vd.enum_violations(fx.frames(spark, d, "events")["events"], "event_type", ["view", "click"]).select("event_id", "event_type")


@query("SELECT assessment_id, count(*) AS rejected FROM judged WHERE reject_code IS NOT NULL AND assessment_id NOT IN (SELECT assessment_id FROM judged WHERE reject_code IS NULL) GROUP BY 1")
def ingest_all_rejected(spark: SparkSession, d: str) -> DataFrame:
    return vd.all_rejected_assessments(*vd.validate_answers(fx.readings(spark, d), pages_of(spark, d)))


@query(
    "SELECT answer_id, chunk, CASE WHEN length(trim(text)) = 0 THEN 'no text' WHEN length(trim(replace(text, '[unclear]', ''))) = 0 THEN 'all unclear' WHEN answer_id % 13 = 0 THEN 'no region' WHEN reject_reason IS NOT NULL THEN reject_reason WHEN answer_id % 11 = 0 THEN 'page' WHEN answer_id % 17 = 0 THEN 'zero area' WHEN answer_id % 19 = 0 THEN 'geometry' ELSE 'ok' END AS verdict FROM judged"
)
def ingest_multi_region_answers(spark: SparkSession, d: str) -> DataFrame:
    """Readings with no region, or two of which the second may be bad: on an unknown page, flat, or out of bounds."""
    own = F.struct("page", "x", "y", "width", "height")
    bad = lambda n: F.col("answer_id") % n == 0
    second = F.struct(F.when(bad(11), 77).otherwise(F.lit(1)).cast("long").alias("page"), F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.when(bad(17), 0.0).otherwise(0.2).alias("width"), F.when(bad(19) & ~bad(17), 1.5).otherwise(0.2).alias("height"))
    readings = fx.readings(spark, d).withColumn("regions", F.when(bad(13), F.slice(F.array(own), 1, 0)).otherwise(F.array(own, second)))
    good, rejected = vd.validate_answers(readings, pages_of(spark, d))
    return good.select("answer_id", "chunk", F.lit("ok").alias("verdict")).unionAll(rejected.select("answer_id", "chunk", "reject_reason"))


# -- chunks and merging -------------------------------------------------------------------------------------------
@query("SELECT * FROM planned")
def merge_chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return mg.plan_chunks(document_pages(spark, d), 3, 1).select("document_id", F.col("chunk").cast("long").alias("chunk"), "local_index", "page")


@query("SELECT a.document_id, a.page AS start, a.page + 2 AS \"end\" FROM dpages a WHERE EXISTS (SELECT 1 FROM dpages b WHERE b.document_id = a.document_id AND b.page = a.page + 2) AND NOT EXISTS (SELECT 1 FROM (SELECT document_id, chunk, min(page) AS low, max(page) AS high FROM planned GROUP BY 1, 2) h WHERE h.document_id = a.document_id AND low <= a.page AND high >= a.page + 2)")
def merge_spanning_violations(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three pages, more than the overlap promises."""
    pages = document_pages(spark, d)
    return mg.spanning_violations(pages, mg.plan_chunks(pages, 3, 1), 3)


@query("SELECT document_id, chunk, page AS ordinal, page AS absolute_page FROM planned WHERE page % 5 <> 0")
def merge_absolute_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth page is read under a number that its chunk does not have."""
    chunks = mg.plan_chunks(document_pages(spark, d), 3, 1).withColumn("chunk", F.col("chunk").cast("long"))
    readings = chunks.select("document_id", "chunk", F.col("page").alias("ordinal"), F.when(F.col("page") % 5 == 0, 7).otherwise(F.col("local_index")).alias("local_page"))
    return mg.to_absolute_pages(readings, chunks).select("document_id", "chunk", "ordinal", "absolute_page")


@query(f"SELECT * FROM (SELECT a.assessment_id, a.reading_id AS first, b.reading_id AS second, max(round({IOU}, 6)) AS place, max(round({JAC}, 6)) AS likeness FROM rd a JOIN rd b ON a.assessment_id = b.assessment_id AND a.page = b.page AND a.chunk < b.chunk GROUP BY 1, 2, 3) WHERE place >= 0.5 OR place >= 0.15 AND likeness >= 0.6")
def merge_same_answers(spark: SparkSession, d: str) -> DataFrame:
    return mg.same_answer_pairs(with_ids(fx.readings(spark, d)))


@query(f"SELECT * FROM (SELECT a.assessment_id, a.reading_id AS first, b.reading_id AS second, max(round({IOU}, 6)) AS place, max(round({JAC}, 6)) AS likeness FROM rd a JOIN rd b ON a.assessment_id = b.assessment_id AND a.page = b.page AND a.chunk < b.chunk GROUP BY 1, 2, 3) WHERE place >= 0.5 OR place >= 0.15 AND likeness >= 0.6")
def merge_answers_by_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same by the plan for large pages, on all pages."""
    return mg.same_answer_pairs(with_ids(fx.readings(spark, d)), page_rows=0)


Q_READINGS = "SELECT assessment_id, question_id, question_id * 10007 + c.chunk AS reading_id, c.chunk, page, CASE WHEN question_id % 5 = 0 THEN '' ELSE label_raw END AS label_raw, CASE WHEN c.chunk = 2 THEN text || ' more' ELSE text END AS text, marks FROM {q} CROSS JOIN (SELECT 1 AS chunk UNION ALL SELECT 2) c"


def question_pairs(spark: SparkSession, d: str, **how: int) -> DataFrame:
    dealt = fx.dealing(spark, d)
    return stash(mg.same_question_pairs(spark.sql(Q_READINGS, q=fx.questions(spark, d)), dealt=dealt, **how), dealt, bucketed=False)


@query(
    f"SELECT a.assessment_id, a.reading_id AS first, b.reading_id AS second FROM qk a JOIN qk b ON a.assessment_id = b.assessment_id AND a.chunk < b.chunk AND a.k = b.k UNION SELECT a.assessment_id, a.reading_id, b.reading_id FROM qk a JOIN qk b ON a.assessment_id = b.assessment_id AND a.chunk < b.chunk AND a.page = b.page AND (a.k IS NULL OR b.k IS NULL) WHERE round({JAC}, 6) >= 0.7",
    qr=Q_READINGS.format(q="fx_q"),
    qp=parsed("qr", "label_raw"),
    qk="SELECT *, CASE WHEN trim(label_raw) <> '' THEN p_norm END AS k, " + TOKENS.format(t="text") + " AS tk FROM qp",
)
def merge_same_questions(spark: SparkSession, d: str) -> DataFrame:
    return question_pairs(spark, d)


@query(
    f"SELECT a.assessment_id, a.reading_id AS first, b.reading_id AS second FROM qk a JOIN qk b ON a.assessment_id = b.assessment_id AND a.chunk < b.chunk AND a.k = b.k UNION SELECT a.assessment_id, a.reading_id, b.reading_id FROM qk a JOIN qk b ON a.assessment_id = b.assessment_id AND a.chunk < b.chunk AND a.page = b.page AND (a.k IS NULL OR b.k IS NULL) WHERE round({JAC}, 6) >= 0.7",
    qr=Q_READINGS.format(q="fx_q"),
    qp=parsed("qr", "label_raw"),
    qk="SELECT *, CASE WHEN trim(label_raw) <> '' THEN p_norm END AS k, " + TOKENS.format(t="text") + " AS tk FROM qp",
)
def merge_questions_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The same by the plan for large pages, on all pages."""
    return question_pairs(spark, d, page_rows=0)


@query(
    "SELECT assessment_id, reading_id, reading_id AS group_id FROM rd WHERE NOT real UNION ALL SELECT assessment_id, unnest(ids) AS reading_id, unnest(groups) AS group_id FROM rd_steps WHERE (assessment_id, k) IN (SELECT assessment_id, max(k) FROM rd_order GROUP BY 1)".replace("NOT real", "length(trim(replace(text, '[unclear]', ''))) = 0"),
    rd_pairs=f"SELECT a.assessment_id, a.reading_id AS l, b.reading_id AS r, max(round({IOU}, 6)) AS place, max(round({JAC}, 6)) AS likeness FROM rd a JOIN rd b ON a.assessment_id = b.assessment_id AND a.page = b.page AND a.chunk < b.chunk WHERE length(trim(replace(a.text, '[unclear]', ''))) > 0 AND length(trim(replace(b.text, '[unclear]', ''))) > 0 GROUP BY 1, 2, 3",
    rd_links="SELECT assessment_id, l, r FROM rd_pairs WHERE place >= 0.5 OR place >= 0.15 AND likeness >= 0.6",
    rd_order="SELECT d.assessment_id, d.reading_id, coalesce(list(x.l) FILTER (WHERE x.l IS NOT NULL), []) AS near, row_number() OVER (PARTITION BY d.assessment_id ORDER BY d.chunk, d.reading_id) AS k FROM (SELECT * FROM rd WHERE length(trim(replace(text, '[unclear]', ''))) > 0) d LEFT JOIN (SELECT assessment_id, l, r FROM rd_links UNION ALL SELECT assessment_id, r, l FROM rd_links) x ON x.assessment_id = d.assessment_id AND x.r = d.reading_id GROUP BY d.assessment_id, d.reading_id, d.chunk",
    # groups in order of their founders: the first match that belongs to the earliest founder decides
    rd_steps="SELECT DISTINCT assessment_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS groups FROM rd_order UNION ALL SELECT o.assessment_id, o.k, list_append(s.ids, o.reading_id), list_append(s.groups, coalesce(s.ids[list_min([list_position(s.ids, s.groups[list_position(s.ids, m)]) FOR m IN o.near IF list_contains(s.ids, m)])], o.reading_id)) FROM rd_steps s JOIN rd_order o ON o.assessment_id = s.assessment_id AND o.k = s.k + 1",
)
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    r = with_ids(fx.readings(spark, d))
    return mg.group_readings(r, mg.same_answer_pairs(r))


@query("SELECT assessment_id, answer_id AS group_id, arg_max(reading_id, row(n_seen, n_pages, length(trim(text)), -chunk)) AS winner, coalesce(first(label_raw ORDER BY n_seen DESC, n_pages DESC, length(trim(text)) DESC, chunk), arg_min(label_raw, chunk) FILTER (WHERE label_raw IS NOT NULL)) AS label_raw, count(*) AS n_readings FROM rd GROUP BY 1, 2")
def merge_folded_answers(spark: SparkSession, d: str) -> DataFrame:
    members = with_ids(fx.readings(spark, d)).withColumn("group_id", F.col("answer_id"))
    return mg.fold_answer_group(members).drop("text")


@query("SELECT assessment_id, question_id AS group_id, arg_max(text, row(length(text), -chunk)) AS text, arg_min(marks, chunk) FILTER (WHERE marks IS NOT NULL) AS marks, min(page) AS page FROM qr GROUP BY 1, 2", qr=Q_READINGS.format(q="fx_q"))
def merge_folded_questions(spark: SparkSession, d: str) -> DataFrame:
    members = spark.sql(Q_READINGS, q=fx.questions(spark, d)).withColumn("group_id", F.col("question_id"))
    return mg.fold_question_group(members).drop("label_raw")


@query("SELECT answer_id, CAST(count(*) AS INTEGER) AS n_read, CAST(1 AS INTEGER) AS n_kept, round(arg_min(y, chunk), 9) AS kept_y FROM fx_r WHERE x <= 1 GROUP BY 1")
def merge_deduped_regions(spark: SparkSession, d: str) -> DataFrame:
    region = F.struct("page", "y", "x", "width", "height")
    r = fx.readings(spark, d).where("x <= 1").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("chunk", region.alias("r")))).alias("rs"))
    regions = F.transform("rs", lambda c: c["r"])
    return r.select("answer_id", F.size("rs").alias("n_read"), F.size(mg.dedupe_regions(regions)).alias("n_kept"), F.round(mg.dedupe_regions(regions)[0]["y"], 9).alias("kept_y"))


@query("SELECT r.assessment_id, received, chunks, coalesce(rejected, 0) AS rejected, merged, unlabelled FROM (SELECT assessment_id, count(*) AS received, count(DISTINCT chunk) AS chunks FROM fx_r GROUP BY 1) r LEFT JOIN (SELECT assessment_id, count(*) AS rejected FROM judged WHERE reject_code IS NOT NULL GROUP BY 1) j USING (assessment_id) LEFT JOIN (SELECT assessment_id, CAST(sum(n - 1) AS BIGINT) AS merged, CAST(count_if(l IS NULL) AS BIGINT) AS unlabelled FROM (SELECT assessment_id, answer_id, count(*) AS n, coalesce(first(label_raw ORDER BY n_seen DESC, n_pages DESC, length(trim(text)) DESC, chunk), arg_min(label_raw, chunk) FILTER (WHERE label_raw IS NOT NULL)) AS l FROM rd GROUP BY 1, 2) GROUP BY 1) m USING (assessment_id)")
def merge_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = with_ids(fx.readings(spark, d))
    merged = mg.fold_answer_group(r.withColumn("group_id", F.col("answer_id")))
    return mg.extraction_metrics(r, vd.validate_answers(r, pages_of(spark, d))[1], merged).drop("failed_chunks", "partial")


USAGE = "SELECT assessment_id, chunk, CASE WHEN min(answer_id) % 3 = 0 THEN NULL ELSE 1600 + 50 * count(*) END AS prompt_tokens, CASE WHEN min(answer_id) % 3 = 0 THEN NULL ELSE cast(sum(length(text)) AS bigint) END AS response_tokens FROM {readings} GROUP BY 1, 2"


@query("SELECT r.assessment_id, received, chunks, coalesce(failed_chunks, 0) AS failed_chunks, coalesce(failed_chunks, 0) > 0 AS partial, prompt_tokens, response_tokens, prompt_tokens + response_tokens AS total_tokens FROM (SELECT assessment_id, count(*) AS received, count(DISTINCT chunk) AS chunks FROM fx_r GROUP BY 1) r LEFT JOIN (SELECT assessment_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(response_tokens) AS BIGINT) AS response_tokens FROM used GROUP BY 1) u USING (assessment_id) LEFT JOIN (SELECT assessment_id, count(*) AS failed_chunks FROM used WHERE chunk % 4 = 3 GROUP BY 1) f USING (assessment_id)", used=USAGE.format(readings="fx_r"))
def merge_usage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with the tokens that calls reported, some of which reported none; every fourth chunk counts as failed."""
    r = with_ids(fx.readings(spark, d))
    used = spark.sql(USAGE, readings=fx.readings(spark, d))
    merged = mg.fold_answer_group(r.withColumn("group_id", F.col("answer_id")))
    return mg.extraction_metrics(r, r.where("false"), merged, used.where("chunk % 4 = 3"), used).drop("rejected", "merged", "unlabelled")


# -- ingest -------------------------------------------------------------------------------------------------------
@query("SELECT answer_id, chunk, label_raw AS claimed_label_raw, text, page, round(x, 9) AS x, round(y, 9) AS y, CASE WHEN answer_id % 6 = 0 THEN 'text' WHEN diagram THEN 'diagram' ELSE 'text' END AS kind FROM fx_r WHERE answer_id % 31 <> 0 AND answer_id % 37 <> 0")
def ingest_answer_responses(spark: SparkSession, d: str) -> DataFrame:
    good, _ = ig.parse_answer_responses(spark.sql(fx.RESPONSES, readings=fx.readings(spark, d)))
    rows = good.select("answer_id", "chunk", "claimed_label_raw", "text", F.explode("regions").alias("r"))
    return rows.select("answer_id", "chunk", "claimed_label_raw", "text", F.col("r.page").cast("long").alias("page"), F.round("r.x", 9).alias("x"), F.round("r.y", 9).alias("y"), "r.kind")


@query("SELECT answer_id, chunk, CASE WHEN answer_id % 31 = 0 THEN 'malformed' ELSE 'invalid item' END AS reject_reason FROM fx_r WHERE answer_id % 31 = 0 OR answer_id % 37 = 0")
def ingest_rejected_responses(spark: SparkSession, d: str) -> DataFrame:
    return ig.parse_answer_responses(spark.sql(fx.RESPONSES, readings=fx.readings(spark, d)))[1].select("answer_id", "chunk", "reject_reason")


VERDICT_BODY = "SELECT answer_id, '{{\"decision\":\"' || CASE WHEN answer_id % 11 = 0 THEN 'MAYBE' ELSE decision END || '\",\"questionId\":\"' || cast(question_id AS string) || '\",\"confidence\":' || CASE WHEN answer_id % 13 = 0 THEN '\"sure\"' ELSE '\"0.5\"' END || '}}' AS body FROM {v}"


@query("SELECT answer_id, decision, CAST(question_id AS VARCHAR) AS question_id, 'INSUFFICIENT_EVIDENCE' AS reason_code, CAST(CASE WHEN answer_id % 13 = 0 THEN 0 ELSE 0.5 END AS DOUBLE) AS model_confidence FROM fx_v WHERE answer_id % 11 <> 0")
def ingest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return ig.parse_verdicts(spark.sql(VERDICT_BODY, v=fx.verdicts(spark, d)))[0]


GRADE_BODY = "SELECT answer_id, '{{\"criteria\":[' || CASE WHEN answer_id % 11 = 0 THEN '' ELSE '{{\"criterionId\":\"c1\",\"awardedMarks\":\"' || cast(answer_id % 4 - 1 AS string) || '\",\"reason\":\" ok \"}}' END || '],\"totalAwardedMarks\":1,\"confidence\":0.5,\"feedback\":\"f\"}}' AS body FROM {a}"


@query("SELECT answer_id, 'c1' AS criterion_id, CAST(answer_id % 4 - 1 AS DOUBLE) AS awarded, 'ok' AS reason, 'kept' AS outcome FROM fx_a WHERE answer_id % 11 <> 0 AND answer_id % 4 <> 0 UNION ALL SELECT answer_id, NULL, NULL, NULL, CASE WHEN answer_id % 11 = 0 THEN 'no criteria' ELSE 'invalid criterion' END FROM fx_a WHERE answer_id % 11 = 0 OR answer_id % 4 = 0")
def ingest_recommendations(spark: SparkSession, d: str) -> DataFrame:
    good, bad = ig.parse_recommendations(spark.sql(GRADE_BODY, a=fx.answers(spark, d)))
    none = F.lit(None).cast("string")
    return good.select("answer_id", "criterion_id", "awarded", "reason", F.lit("kept").alias("outcome")).unionAll(bad.select("answer_id", none, none.cast("double"), none, "reject_reason"))


@query("SELECT document_id, CASE WHEN size <= 0 OR octet_length(head) = 0 THEN 'EMPTY' WHEN size > 10485760 THEN 'TOO_LARGE' WHEN f IS NULL THEN 'UNSUPPORTED' ELSE 'ACCEPTED' END AS verdict, CASE WHEN size > 0 AND octet_length(head) > 0 AND size <= 10485760 THEN f END AS format, coalesce(CASE WHEN size > 0 AND octet_length(head) > 0 AND size <= 10485760 AND f IS NOT NULL THEN coalesce(m <> f, false) OR coalesce(e <> f, false) END, false) AS claim_mismatch FROM (SELECT *, CASE WHEN hex(head) LIKE '89504E470D0A1A0A%' THEN 'PNG' WHEN hex(head) LIKE '255044462D%' THEN 'PDF' WHEN hex(head) LIKE 'FFD8FF%' THEN 'JPEG' END AS f, CASE lower(trim(split_part(mime, ';', 1))) WHEN 'application/pdf' THEN 'PDF' WHEN 'image/png' THEN 'PNG' WHEN 'image/jpeg' THEN 'JPEG' END AS m, CASE lower(filename) WHEN 'scan.pdf' THEN 'PDF' WHEN 'scan.png' THEN 'PNG' WHEN 'scan.jpeg' THEN 'JPEG' END AS e FROM ups)")
def ingest_uploads(spark: SparkSession, d: str) -> DataFrame:
    u = ig.classify_uploads(spark.sql(fx.UPLOADS, **fx.frames(spark, d, "orders")))
    return u.select("document_id", "verdict", "format", F.coalesce("claim_mismatch", F.lit(False)).alias("claim_mismatch"))


@query("SELECT assessment_id, type, document_id FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id, type ORDER BY uploaded_at DESC, document_id DESC) AS r FROM ups) WHERE r = 1")
def ingest_latest_documents(spark: SparkSession, d: str) -> DataFrame:
    return ig.latest_document_per_type(spark.sql(fx.UPLOADS, **fx.frames(spark, d, "orders"))).select("assessment_id", "type", "document_id")


@query("SELECT c.c_custkey AS assessment_id, t.type FROM customer c CROSS JOIN (SELECT unnest(['QUESTION_PAPER', 'ANSWER_SHEET']) AS type) t WHERE NOT EXISTS (SELECT 1 FROM ups u WHERE u.assessment_id = c.c_custkey AND u.type = t.type)")
def ingest_missing_documents(spark: SparkSession, d: str) -> DataFrame:
    t = fx.frames(spark, d, "orders", "customer")
    return ig.missing_document_types(t["customer"].select(F.col("c_custkey").alias("assessment_id")), spark.sql(fx.UPLOADS, orders=t["orders"]))


@query("SELECT p_partkey, CAST(greatest(1, round(w * sc)) AS INTEGER) AS width, CAST(greatest(1, round(h * sc)) AS INTEGER) AS height, round(sc, 9) AS scale, CAST(CASE WHEN o IN (3, 4) THEN 180 WHEN o IN (5, 6) THEN 90 WHEN o IN (7, 8) THEN 270 ELSE 0 END AS INTEGER) AS rotation FROM (SELECT *, least(1.0, 2000.0 / greatest(w, h)) AS sc FROM (SELECT p_partkey, p_partkey % 9 AS o, CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN 1 + p_partkey % 3001 ELSE p_size * 137 END AS w, CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN p_size * 137 ELSE 1 + p_partkey % 3001 END AS h FROM part))")
def ingest_page_geometry(spark: SparkSession, d: str) -> DataFrame:
    p = fx.frames(spark, d, "part")["part"]
    g = p.select("p_partkey", geo.page_geometry(F.col("p_size") * 137, 1 + F.col("p_partkey") % 3001, F.col("p_partkey") % 9, DEFAULT.max_dimension).alias("g"))
    return g.select("p_partkey", "g.width", "g.height", F.round("g.scale", 9).alias("scale"), "g.rotation")


PAGE_LIST = "SELECT assessment_id AS document_id, pos AS page_number, 100 + pos AS size, 10 AS width, 20 AS height FROM {b}"
STORED = "SELECT document_id, page_number, CASE WHEN document_id % 7 = 0 AND page_number = 2 THEN size + 1 ELSE size END AS size, width, height FROM {e} WHERE NOT (document_id % 5 = 0 AND page_number = 1)"


@query("SELECT document_id, NOT (document_id % 5 = 0 OR document_id % 7 = 0 AND count(*) >= 2) AS reusable, count(*) AS pages FROM fx_pl GROUP BY 1", fx_pl=PAGE_LIST.format(b="fx_base"))
def ingest_reconciled_documents(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.sql(PAGE_LIST, b=fx.base(spark, d))
    return ig.reconcile_pages(expected, spark.sql(STORED, e=expected))[0]


# -- events -------------------------------------------------------------------------------------------------------
@query("SELECT assessment_id, arg_max(stage, row(ts, event_id)) AS stage, CAST(round(arg_max(stage, row(ts, event_id)) / 6.0 * 100) AS INTEGER) AS progress FROM fx_st GROUP BY 1")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    return jobs.progress(fx.of_events(spark, d, fx.STAGES))


@query("SELECT DISTINCT assessment_id, stage FROM fx_st")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return jobs.dedupe_events(fx.of_events(spark, d, fx.STAGES), ["assessment_id", "stage"]).select("assessment_id", "stage")


@query("SELECT event_id, CAST(sum(tokens) OVER w AS BIGINT) AS spent, sum(tokens) OVER w > 8000 AS over_budget FROM (SELECT *, epoch_us(ts) / 1e6 AS sec FROM fx_us) WINDOW w AS (PARTITION BY provider ORDER BY sec RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)")
def stream_rolling_spend(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rolling_token_spend(fx.of_events(spark, d, fx.USAGE)).select("event_id", "spent", "over_budget")


@query("SELECT provider, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls FROM fx_us GROUP BY 1, 2")
def stream_usage_by_minute(spark: SparkSession, d: str) -> DataFrame:
    u = fx.of_events(spark, d, fx.USAGE).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.usage_by_minute(u).withColumn("minute", F.col("minute").cast("long"))


@query("SELECT provider, CAST(start AS BIGINT) AS start, CAST(sum(tokens) AS BIGINT) AS spent, sum(tokens) > 8000 AS over_budget FROM (SELECT provider, tokens, (floor(epoch_us(ts) / 1e6 / 10) - k) * 10 AS start FROM fx_us CROSS JOIN (SELECT unnest(range(6)) AS k) ks) GROUP BY 1, 2")
def stream_sliding_spend(spark: SparkSession, d: str) -> DataFrame:
    u = fx.of_events(spark, d, fx.USAGE).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sliding_token_spend(u).withColumn("start", F.col("start").cast("long"))


@query("SELECT DISTINCT assessment_id, stage FROM fx_st s WHERE NOT EXISTS (SELECT 1 FROM fx_st l WHERE l.event_id % 3 = 0 AND l.assessment_id = s.assessment_id AND l.stage = s.stage AND l.ts >= (SELECT max(ts) FROM fx_st q WHERE q.event_id % 10 = 0 AND q.assessment_id = l.assessment_id)) AND assessment_id IN (SELECT assessment_id FROM fx_st WHERE event_id % 10 = 0)")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Requests are every tenth event with all stages seen; the ledger is every third."""
    e = fx.of_events(spark, d, fx.STAGES)
    asked = e.where("event_id % 10 = 0").groupBy("assessment_id").agg(F.max("ts").alias("ts"))
    requests = e.select("assessment_id", "stage").distinct().join(asked, "assessment_id")
    return jobs.incremental_run(requests, e.where("event_id % 3 = 0"))


@query("SELECT user_id AS assessment_id, max(ts) AS updated_at FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_expired(spark: SparkSession, d: str) -> DataFrame:
    e = fx.frames(spark, d, "events")["events"]
    state = e.groupBy(F.col("user_id").alias("assessment_id")).agg(F.max("ts").alias("updated_at"))
    last = e.agg(F.max("ts").cast("timestamp").alias("now"))  # one row
    return jobs.expired(state.crossJoin(F.broadcast(last)), F.col("now")).drop("now")
