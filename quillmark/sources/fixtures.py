"""Derived inputs: assessments made from orders, by one SQL text that Spark and DuckDB both read.

One order is one assessment; its lines are its questions and answers, all of them. Modulus constants only make every
branch of every rule appear; ids are assessment_id * 1000003 + pos, a prime, so that they do not follow pos alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scan import WHOLE_ROWS, fullest_part
from .scratch import Dealing, stash

BASE = """
SELECT *, count(*) OVER (PARTITION BY assessment_id) AS n, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS letter
FROM (SELECT l_orderkey AS assessment_id, l_partkey, l_suppkey, cast(l_quantity AS bigint) AS quantity, l_discount AS discount, l_returnflag AS flag, p_name,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS bigint) AS pos
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) t"""

QUESTIONS = """
SELECT assessment_id, assessment_id * 1000003 + pos AS question_id, pos, n,
  CASE l_suppkey % 5 WHEN 0 THEN 'Q' || cast(pos AS string) WHEN 1 THEN cast(pos AS string) || '.' WHEN 2 THEN 'Question ' || cast(pos AS string)
    WHEN 3 THEN cast(pos AS string) || ' (' || letter || ')' ELSE '(' || letter || ')' END AS label_raw,
  CASE WHEN l_partkey % 7 = 0 THEN 'Draw a labelled diagram of ' ELSE '' END || p_name AS text,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE cast(1 + l_partkey % 5 AS double) END AS marks,
  cast(1 + floor((pos - 1) / 3.0) AS bigint) AS page, cast(0.1 AS double) AS x, cast(0.1 AS double) + cast(0.25 AS double) * ((pos - 1) % 3) AS y,
  cast(0.7 AS double) AS width, cast(0.1 AS double) AS height, l_partkey % (SELECT count(*) FROM {embeddings}) AS vec_id, l_partkey
FROM {base}"""

ANSWERS = """
SELECT assessment_id, assessment_id * 1000003 + pos AS answer_id, pos, n,
  CASE (l_suppkey + pos) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Q' || cast(pos AS string) WHEN 2 THEN cast(pos AS string) WHEN 3 THEN '(' || letter || ')'
    WHEN 4 THEN 'Ans ' || cast(pos AS string) || '(' || letter || ')' ELSE 'Q' || cast(1 + pos % 7 AS string) END AS claimed_label_raw,
  repeat(p_name || ' ', cast(1 + quantity % 20 AS int)) || CASE WHEN quantity % 7 = 0 THEN '[unclear]' ELSE '' END AS text,
  flag = 'R' AS diagram, cast(1 + floor((pos - 1) / 3.0) AS bigint) AS page,
  cast(0.1 AS double) AS x, cast(0.1 AS double) + cast(0.25 AS double) * ((pos - 1) % 3) + discount / 10 AS y, cast(0.7 AS double) AS width, cast(0.1 AS double) AS height,
  (l_partkey + pos % 2) % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {base} WHERE l_partkey % 10 <> 3"""

#: Every answer as read by each chunk of two pages (overlap one) that holds its page, with some bad rows.
READINGS = """
SELECT assessment_id, answer_id, chunk, row_number() OVER (PARTITION BY assessment_id, chunk ORDER BY answer_id) - 1 AS ordinal,
  CASE WHEN again = 1 AND answer_id % 4 = 0 THEN NULL ELSE claimed_label_raw END AS label_raw,
  CASE WHEN answer_id % 101 = 0 THEN '' WHEN again = 1 THEN substr(text, 1, cast(floor(length(text) * 0.8) AS int)) ELSE text END AS text, diagram,
  CASE WHEN answer_id % 103 = 0 THEN 99 ELSE page END AS page, page - chunk AS local_page,
  CASE WHEN answer_id % 97 = 0 THEN cast(1.4 AS double) ELSE x END AS x, y + CASE WHEN again = 1 THEN cast(0.01 AS double) ELSE cast(0 AS double) END AS y, width, height
FROM (SELECT a.*, page - again AS chunk, again FROM {answers} a CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1) c WHERE page - again >= 1 AND page - again <= greatest(1, floor((n - 1) / 3.0))) t"""

VERDICTS = """
SELECT assessment_id, assessment_id * 1000003 + pos AS answer_id, CASE WHEN (assessment_id * 1000003 + pos) % 7 = 0 THEN 'NO_MATCH' ELSE 'MATCH' END AS decision,
  assessment_id * 1000003 + 1 + (pos - 1 + (assessment_id * 1000003 + pos) % 2) % n AS question_id,
  cast(0.5 AS double) + cast((assessment_id * 1000003 + pos) % 50 AS double) / 100 AS model_confidence
FROM {base} WHERE (assessment_id * 1000003 + pos) % 3 <> 0"""

RUBRICS = """
SELECT assessment_id, question_id AS rubric_id, CASE l_partkey % 3 WHEN 0 THEN 'QUESTION ' || trim(label_raw) WHEN 1 THEN trim(label_raw) || ' ' ELSE label_raw END AS label_raw,
  marks AS total_marks, criterion_id, 'Criterion ' || criterion_id AS description,
  CASE WHEN criterion_id = 'c1' THEN cast(1 AS double) + CASE WHEN l_partkey % 8 = 0 THEN 1 ELSE 0 END ELSE coalesce(marks, cast(3 AS double)) - 1 END AS max_marks, l_partkey % 3 <> 0 AS allows_partial
FROM {questions} CROSS JOIN (SELECT 'c1' AS criterion_id UNION ALL SELECT 'c2') c WHERE l_partkey % 4 = 0"""

ACTIONS = """
SELECT user_id AS assessment_id, user_id * 10 + 1 + event_id % 5 AS answer_id, event_id, ts,
  CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'purchase' THEN 'REMAP' WHEN 'error' THEN 'REJECT' ELSE 'SKIP' END AS action,
  CASE WHEN event_type = 'purchase' THEN user_id * 10 + 1 + event_id % 7 END AS target,
  CASE WHEN event_id % 41 = 0 THEN repeat('long ', 201) WHEN event_id % 3 = 0 THEN '  checked  ' WHEN event_id % 3 = 1 THEN ' ' END AS reason
FROM {events}"""

#: What the matcher said about the answers that actions refer to.
ACTION_MAPPINGS = """
SELECT DISTINCT user_id AS assessment_id, user_id * 10 + 1 + k AS answer_id, CASE WHEN (user_id + k) % 4 = 0 THEN NULL ELSE user_id * 10 + 1 + (k + user_id) % 5 END AS question_id,
  cast((user_id * 7 + k * 13) % 100 AS double) / 100 AS confidence
FROM {events} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks"""

STAGES = "SELECT event_id, user_id AS assessment_id, event_id % 6 AS stage, ts FROM {events}"

USAGE = "SELECT event_id, event_type AS provider, cast(floor(value * 10) AS bigint) AS tokens, ts FROM {events}"


def frames(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


#: Lines of orders in a bucket of the base table, about.
BUCKET_ROWS = 200_000
_BASES: dict[tuple[str, str], tuple[DataFrame, Dealing | None]] = {}


def _base(spark: SparkSession, sf_dir: str, whole_rows: int = WHOLE_ROWS) -> tuple[DataFrame, Dealing | None]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BASES:
        inputs = frames(spark, sf_dir, "lineitem", "part")
        most, total = fullest_part(inputs["lineitem"], "l_orderkey")
        dealt = ("assessment_id", max(spark.sparkContext.defaultParallelism, total // BUCKET_ROWS + 1)) if most <= whole_rows else None
        _BASES[key] = stash(spark.sql(BASE, **inputs), dealt), dealt
    return _BASES[key]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once for each session and input: all derived tables start from it."""
    return _base(spark, sf_dir)[0]


def dealing(spark: SparkSession, sf_dir: str) -> Dealing | None:
    """How the base table is dealt: by assessment, so that what follows within assessments needs no shuffle. Not at all
    if an assessment may have more rows than one task should: then joins and groups are dealt by all their keys."""
    return _base(spark, sf_dir)[1]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUESTIONS, base=base(spark, sf_dir), **frames(spark, sf_dir, "embeddings"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ANSWERS, base=base(spark, sf_dir), **frames(spark, sf_dir, "embeddings"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READINGS, answers=answers(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VERDICTS, base=base(spark, sf_dir))


def rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUBRICS, questions=questions(spark, sf_dir))


def of_events(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, **frames(spark, sf_dir, "events"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding")


#: What is in effect for grading: mostly each answer's own question, some none, some unknown.
EFFECTIVE = """
SELECT assessment_id, answer_id, CASE WHEN answer_id % 9 = 0 THEN NULL WHEN answer_id % 23 = 0 THEN -1 ELSE answer_id END AS question_id,
  CASE WHEN answer_id % 4 = 0 THEN 'HUMAN' ELSE 'AI' END AS mapping_source FROM {answers}"""

#: Criterion marks recommended for each gradeable answer. crit: keys, i (place of the criterion), criterion_id, max_marks.
RECOMMENDATIONS = """
SELECT assessment_id, answer_id, ordinal, criterion_id, awarded, sum(awarded) OVER (PARTITION BY assessment_id, answer_id) + CASE WHEN answer_id % 13 = 0 THEN 1 ELSE 0 END AS reported_total,
  cast(0.4 AS double) + cast(answer_id % 60 AS double) / 100 AS confidence
FROM (SELECT assessment_id, answer_id, i AS ordinal, criterion_id, awarded FROM {rated} WHERE NOT (i = 2 AND answer_id % 17 = 0)
  UNION ALL SELECT assessment_id, answer_id, 9, 'cX', cast(1 AS double) FROM {rated} WHERE i = 1 AND answer_id % 19 = 0
  UNION ALL SELECT assessment_id, answer_id, 8, criterion_id, awarded FROM {rated} WHERE i = 1 AND answer_id % 23 = 5) t"""

RATED = """
SELECT assessment_id, answer_id, i, criterion_id, least(max_marks, cast(floor(max_marks * (answer_id % 3) / 2) AS double)) + CASE WHEN answer_id % 29 = 0 AND i = 1 THEN cast(0.5 AS double) ELSE cast(0 AS double) END AS awarded FROM {crit}"""

PRIOR = """
SELECT assessment_id, answer_id, CASE WHEN assessment_id % 5 = 0 THEN answer_id + 1 ELSE answer_id END AS question_id, CASE WHEN answer_id % 14 = 0 THEN 'FAILED' ELSE 'GRADED' END AS status,
  cast(1 AS double) AS awarded, cast(2 AS double) AS maximum, answer_id % 8 <> 0 AS is_current, cast('2024-01-01' AS date) + cast(answer_id % 300 AS int) AS graded_at FROM {answers} WHERE answer_id % 2 = 0"""

#: One model response per reading, with numbers as strings now and then, and kinds that do not exist.
RESPONSES = """
SELECT assessment_id, answer_id, chunk, CASE WHEN answer_id % 31 = 0 THEN '{{"answers":' ELSE '{{"answers":[{{"claimedLabelRaw":' || coalesce('"' || label_raw || '"', 'null') || ',"text":"' || text || '","extra":1,"regions":[{{"pageNumber":' || cast(page AS string)
  || ',"x":' || CASE WHEN answer_id % 5 = 0 THEN '"' || cast(x AS string) || '"' ELSE cast(x AS string) END || ',"y":' || CASE WHEN answer_id % 37 = 0 THEN '"high"' ELSE cast(y AS string) END || ',"width":0.7,"height":0.1,"kind":"'
  || CASE WHEN answer_id % 6 = 0 THEN 'blob' WHEN diagram THEN 'diagram' ELSE 'text' END || '"}}]}}]}}' END AS body FROM {readings}"""

UPLOADS = """
SELECT o_orderkey AS document_id, o_custkey AS assessment_id, CASE WHEN o_orderstatus = 'F' THEN 'ANSWER_SHEET' ELSE 'QUESTION_PAPER' END AS type, o_orderdate AS uploaded_at,
  cast(o_orderkey * 977 % 12000000 AS bigint) * CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 END AS size, 'scan.' || CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PNG' WHEN 2 THEN 'jpeg' ELSE 'doc' END AS filename,
  CASE o_orderkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/PNG; q=1' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN NULL ELSE 'text/plain' END AS mime,
  unhex(CASE o_orderkey % 7 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN 'FFD8FFE000104A46' WHEN 3 THEN '47494638' WHEN 4 THEN '' ELSE '255044462D' END) AS head FROM {orders}"""


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EFFECTIVE, answers=answers(spark, sf_dir))
