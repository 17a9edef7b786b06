"""Registered queries of the review and grading jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as s
from ..operators import grading as gr
from ..operators import review as rv
from ..sources import fixtures as fx
from ..sources.scratch import discard, stash
from .oracle import PARTS, parsed
from .queries import query, ranked_and_mapped, resolved

PARTS.update(
    am="SELECT *, CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS band, CASE WHEN question_id IS NULL THEN CASE answer_id % 3 WHEN 0 THEN 'NO_CANDIDATES' WHEN 1 THEN 'LLM_NO_MATCH' ELSE 'NO_MATCH' END WHEN answer_id % 5 = 0 THEN 'CONFLICT_RESOLVED' ELSE 'DIRECT_LABEL_MATCH' END AS reason FROM fx_am",
    trig="SELECT *, CASE WHEN question_id IS NULL THEN CASE reason WHEN 'NO_CANDIDATES' THEN 'NO_CANDIDATES' WHEN 'LLM_NO_MATCH' THEN 'AI_NO_MATCH' ELSE 'UNMAPPED' END WHEN band = 'LOW' THEN 'LOW_CONFIDENCE' WHEN band = 'MEDIUM' THEN 'MEDIUM_CONFIDENCE' WHEN reason = 'CONFLICT_RESOLVED' THEN 'CONFLICT_RESOLVED' END AS trigger FROM am",
    act="SELECT * FROM fx_act",
    simple_st="SELECT m.assessment_id, m.answer_id, CASE WHEN f.settled IS NOT NULL THEN 'RESOLVED' WHEN k.skips > 0 THEN 'SKIPPED' ELSE 'PENDING' END AS status, coalesce(f.settled, CASE WHEN k.skips > 0 THEN 'SKIP' END) AS action, CASE WHEN f.settled = 'REMAP' THEN f.wanted END AS target FROM fx_am m LEFT JOIN (SELECT assessment_id, answer_id, arg_min(action, row(ts, event_id)) AS settled, arg_min(target, row(ts, event_id)) AS wanted FROM act WHERE action <> 'SKIP' GROUP BY 1, 2) f ON m.answer_id = f.answer_id AND m.assessment_id = f.assessment_id LEFT JOIN (SELECT assessment_id, answer_id, count(*) AS skips FROM act WHERE action = 'SKIP' GROUP BY 1, 2) k ON m.answer_id = k.answer_id AND m.assessment_id = k.assessment_id",
    rv_last="SELECT * FROM rv_steps WHERE (assessment_id, k) IN (SELECT assessment_id, max(k) FROM rv_steps GROUP BY 1)",
    st="SELECT m.assessment_id, m.answer_id, l.sts[m.answer_id - m.assessment_id * 10] AS status, l.acs[m.answer_id - m.assessment_id * 10] AS action, l.tgs[m.answer_id - m.assessment_id * 10] + m.assessment_id * 10 AS target FROM fx_am m JOIN rv_last l ON m.assessment_id = l.assessment_id",
    eff="SELECT m.assessment_id, m.answer_id, CASE WHEN s.action = 'REJECT' THEN NULL WHEN s.action = 'REMAP' THEN s.target ELSE m.question_id END AS question_id, CASE WHEN s.action IN ('ACCEPT', 'REJECT', 'REMAP') THEN 'HUMAN' ELSE 'AI' END AS source, CASE WHEN s.action IN ('ACCEPT', 'REJECT', 'REMAP') THEN NULL ELSE m.confidence END AS confidence, CASE WHEN s.action IS NOT NULL THEN 'HUMAN' ELSE 'AI' END AS mapping_source FROM fx_am m JOIN st s ON m.answer_id = s.answer_id AND m.assessment_id = s.assessment_id",
    # the action log step by step: lists of the five answers of an assessment
    rv_acts="SELECT *, answer_id - assessment_id * 10 AS i, target - assessment_id * 10 AS t, row_number() OVER (PARTITION BY assessment_id ORDER BY ts, event_id) AS k FROM fx_act",
    rv_steps="""SELECT assessment_id, CAST(0 AS BIGINT) AS k, list('PENDING') AS sts, list(CAST(NULL AS VARCHAR)) AS acs, list(CAST(NULL AS BIGINT)) AS tgs, list(question_id - assessment_id * 10 ORDER BY answer_id) AS nws, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS answer_id, CAST(NULL AS BIGINT) AS i, '' AS action, CAST(NULL AS BIGINT) AS target, '' AS outcome FROM fx_am GROUP BY 1
      UNION ALL SELECT assessment_id, k, CASE WHEN outcome = 'APPLIED' THEN [CASE WHEN j = i THEN CASE WHEN action = 'SKIP' THEN 'SKIPPED' ELSE 'RESOLVED' END ELSE sts[j] END FOR j IN [1, 2, 3, 4, 5]] ELSE sts END,
        CASE WHEN outcome = 'APPLIED' THEN [CASE WHEN j = i THEN action ELSE acs[j] END FOR j IN [1, 2, 3, 4, 5]] ELSE acs END, CASE WHEN outcome = 'APPLIED' THEN [CASE WHEN j = i THEN t ELSE tgs[j] END FOR j IN [1, 2, 3, 4, 5]] ELSE tgs END,
        CASE WHEN outcome = 'APPLIED' THEN [CASE WHEN j = i THEN CASE action WHEN 'REJECT' THEN NULL WHEN 'REMAP' THEN t ELSE nws[j] END ELSE nws[j] END FOR j IN [1, 2, 3, 4, 5]] ELSE nws END, event_id, answer_id, i, action, target, outcome
      FROM (SELECT a.assessment_id, a.k, a.event_id, a.answer_id, a.i, a.t, a.action, a.target, s.sts, s.acs, s.tgs, s.nws, CASE WHEN length(trim(a.reason)) > 1000 THEN 'REASON_TOO_LONG' WHEN s.acs[a.i] = a.action AND (a.action <> 'REMAP' OR s.tgs[a.i] IS NOT DISTINCT FROM a.t) THEN 'REPEAT' WHEN s.sts[a.i] = 'RESOLVED' THEN 'CONFLICT_SETTLED'
          WHEN a.action = 'REMAP' AND a.t IS NULL THEN 'INVALID_TARGET' WHEN a.action = 'REMAP' AND a.t NOT BETWEEN 1 AND 6 THEN 'UNKNOWN_QUESTION' WHEN a.action = 'REMAP' AND len([j FOR j IN [1, 2, 3, 4, 5] IF j <> a.i AND s.nws[j] = a.t]) > 0 THEN 'QUESTION_ALREADY_ASSIGNED' ELSE 'APPLIED' END AS outcome
        FROM rv_steps s JOIN rv_acts a ON a.assessment_id = s.assessment_id AND a.k = s.k + 1)""",
    g_eff=fx.EFFECTIVE.format(answers="fx_a"),
    rub0="SELECT assessment_id, rubric_id, min(label_raw) AS label_raw, min(total_marks) AS total_marks, sum(max_marks) AS sums, bool_or(max_marks <= 0) AS bad FROM fx_rub GROUP BY 1, 2",
    rub1=parsed("rub0", "label_raw"),
    label_counts="SELECT assessment_id, normalized_label, count(*) AS n, min(question_id) AS question_id, min(marks) AS marks FROM q_res GROUP BY 1, 2",
    rub2="SELECT r.*, n, CASE WHEN n = 1 THEN question_id END AS question_id, marks, CASE WHEN n = 1 THEN CASE WHEN bad THEN 'INVALID_ALLOCATION' WHEN abs(sums - coalesce(marks, total_marks, sums)) > 1e-6 THEN 'INCONSISTENT_TOTAL' END END AS broken FROM rub1 r LEFT JOIN label_counts q ON r.assessment_id = q.assessment_id AND r.p_norm = q.normalized_label",
    rub3="SELECT *, CASE WHEN n = 1 THEN min(CASE WHEN n = 1 AND broken IS NULL THEN rubric_id END) OVER (PARTITION BY assessment_id, question_id) END AS first_ok FROM rub2",
    rub4="SELECT *, CASE WHEN n IS NULL THEN 'NO_QUESTION' WHEN n > 1 THEN 'AMBIGUOUS_LABEL' WHEN first_ok < rubric_id THEN 'ALREADY_CLAIMED' ELSE broken END AS reason FROM rub3",
    schemes="SELECT assessment_id, question_id, 'PROVIDED' AS source, coalesce(marks, total_marks, sums) AS total_marks, rubric_id FROM rub4 WHERE reason IS NULL UNION ALL SELECT assessment_id, question_id, 'GENERATED', marks, NULL FROM q_res q WHERE marks > 0 AND NOT EXISTS (SELECT 1 FROM rub4 r WHERE r.reason IS NULL AND r.question_id = q.question_id)",
    crits="SELECT s.assessment_id, s.question_id, r.criterion_id, r.max_marks, r.allows_partial FROM schemes s JOIN fx_rub r ON s.rubric_id = r.rubric_id UNION ALL SELECT assessment_id, question_id, 'overall', total_marks, true FROM schemes WHERE rubric_id IS NULL",
    targets="SELECT e.assessment_id, e.answer_id, e.question_id, s.source, s.total_marks, regexp_matches(q.text, '(?i)\\b(draw|sketch|diagram|illustrate|plot)\\b') AS asks, CASE WHEN e.question_id IS NULL THEN 'NO_EFFECTIVE_QUESTION_MAPPING' WHEN q.question_id IS NULL THEN 'QUESTION_NOT_FOUND' WHEN s.total_marks IS NULL THEN 'MARK_SCHEME_UNAVAILABLE' END AS reason FROM g_eff e LEFT JOIN q_res q ON e.question_id = q.question_id LEFT JOIN schemes s ON e.question_id = s.question_id",
    crit="SELECT t.assessment_id, t.answer_id, c.criterion_id, c.max_marks, c.allows_partial, row_number() OVER (PARTITION BY t.answer_id ORDER BY c.criterion_id) AS i FROM targets t JOIN crits c ON t.question_id = c.question_id WHERE t.reason IS NULL",
    rated=fx.RATED.format(crit="crit"),
    recs=fx.RECOMMENDATIONS.format(rated="rated"),
    cited="SELECT *, row_number() OVER (PARTITION BY answer_id, criterion_id ORDER BY ordinal) AS again FROM recs",
    rated_crit="SELECT coalesce(r.assessment_id, c.assessment_id) AS assessment_id, coalesce(r.answer_id, c.answer_id) AS answer_id, r.ordinal, r.awarded, r.reported_total, r.confidence, c.max_marks, CASE WHEN r.ordinal IS NULL THEN NULL WHEN c.max_marks IS NULL THEN 'UNKNOWN_CRITERION' WHEN again > 1 THEN 'REPEATED_CRITERION' WHEN r.awarded <> floor(r.awarded) OR r.awarded < 0 THEN 'INVALID_MARK' WHEN r.awarded > c.max_marks THEN 'OVER_MAXIMUM' WHEN NOT c.allows_partial AND r.awarded <> 0 AND r.awarded <> c.max_marks THEN 'ALL_OR_NOTHING' END AS fault FROM cited r FULL OUTER JOIN crit c ON r.answer_id = c.answer_id AND r.criterion_id = c.criterion_id",
    checked="SELECT b.assessment_id, b.answer_id, coalesce(arg_min(fault, ordinal) FILTER (WHERE fault IS NOT NULL), CASE WHEN count(*) FILTER (WHERE ordinal IS NULL) > 0 THEN 'MISSING_CRITERION' WHEN abs(sum(awarded) - max(reported_total)) > 1e-6 THEN 'INCONSISTENT_TOTAL' WHEN sum(awarded) > any_value(t.total_marks) THEN 'OVER_TOTAL' END) AS failure, sum(awarded) AS awarded, count(*) FILTER (WHERE awarded > 0 AND awarded < max_marks) AS partials, count(max_marks) AS n_criteria, max(b.confidence) AS model FROM rated_crit b JOIN targets t ON b.answer_id = t.answer_id GROUP BY 1, 2 HAVING count(ordinal) > 0",
    sure="SELECT t.*, c.failure, c.awarded, contains(a.text, '[unclear]') AS uncertain, a.diagram AS drawn, t.reason IS NULL AND c.failure IS NULL AND c.awarded IS NOT NULL AS good, floor(least(1.0, greatest(0.0, CAST(0.3 AS DOUBLE) * (CASE WHEN t.source = 'PROVIDED' THEN CAST(1 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END * CASE WHEN asks AND a.diagram THEN CAST(0.6 AS DOUBLE) ELSE 1 END) + CAST(0.25 AS DOUBLE) * CASE WHEN contains(a.text, '[unclear]') THEN CAST(0.4 AS DOUBLE) ELSE 1 END + CAST(0.3 AS DOUBLE) * least(1.0, greatest(0.0, model)) + CAST(0.15 AS DOUBLE) * (CAST(n_criteria - partials AS DOUBLE) / n_criteria * CAST(0.4 AS DOUBLE) + CAST(0.6 AS DOUBLE)))) * 1e6 + 0.500001) / 1e6 AS conf FROM targets t JOIN fx_a a ON t.answer_id = a.answer_id LEFT JOIN checked c ON t.answer_id = c.answer_id",
    grades="SELECT assessment_id, answer_id, question_id, CASE WHEN reason IS NOT NULL THEN 'NOT_GRADEABLE' WHEN NOT good THEN 'FAILED' WHEN conf < 0.75 OR uncertain OR source = 'GENERATED' OR asks AND drawn THEN 'REVIEW_REQUIRED' ELSE 'GRADED' END AS status, CASE WHEN good THEN awarded END AS awarded, CASE WHEN reason IS NULL THEN total_marks END AS maximum, CASE WHEN good THEN conf END AS confidence, CASE WHEN good THEN concat_ws(',', CASE WHEN conf < 0.75 THEN 'LOW_GRADING_CONFIDENCE' END, CASE WHEN uncertain THEN 'UNCERTAIN_TRANSCRIPTION' END, CASE WHEN source = 'GENERATED' THEN 'GENERATED_RUBRIC' END, CASE WHEN asks AND drawn THEN 'DIAGRAM_NOT_ASSESSABLE' END) ELSE coalesce(reason, failure, 'NO_RECOMMENDATION') END AS reasons, source FROM sure",
    prior=fx.PRIOR.format(answers="fx_a"),
    history="SELECT p.assessment_id, p.answer_id, p.question_id, p.status, p.awarded, p.maximum, p.is_current AND g.answer_id IS NULL AS is_current, p.graded_at, CASE WHEN p.is_current AND g.answer_id IS NOT NULL THEN CASE WHEN p.question_id IS NOT DISTINCT FROM g.question_id THEN 'REGRADED' ELSE 'MAPPING_CHANGED' END END AS superseded_reason FROM prior p LEFT JOIN grades g ON p.answer_id = g.answer_id UNION ALL SELECT assessment_id, answer_id, question_id, status, awarded, maximum, true, NULL, NULL FROM grades",
    verdict="SELECT *, CASE WHEN status = 'FAILED' THEN 'Could not be marked' WHEN status = 'NOT_GRADEABLE' THEN CASE WHEN reasons = 'MARK_SCHEME_UNAVAILABLE' THEN 'No marks to grade against' ELSE 'Not gradeable' END WHEN awarded >= maximum THEN 'Correct' WHEN awarded > 0 THEN 'Partially correct' ELSE 'Incorrect' END AS verdict FROM grades",
)


def said(spark: SparkSession, d: str) -> DataFrame:
    m = fx.of_events(spark, d, fx.ACTION_MAPPINGS)
    none = F.when(F.col("answer_id") % 3 == 0, "NO_CANDIDATES").when(F.col("answer_id") % 3 == 1, "LLM_NO_MATCH").otherwise("NO_MATCH")
    reason = F.when(F.col("question_id").isNull(), none).when(F.col("answer_id") % 5 == 0, "CONFLICT_RESOLVED").otherwise("DIRECT_LABEL_MATCH")
    from ..config import DEFAULT

    return m.withColumn("band", s.confidence_band(F.col("confidence"), DEFAULT)).withColumn("reasons", F.array(reason))


def log(spark: SparkSession, d: str) -> DataFrame:
    return fx.of_events(spark, d, fx.ACTIONS)


def as_reviews(m: DataFrame) -> DataFrame:
    return m.select("assessment_id", "answer_id", F.col("question_id").alias("original_question_id"))


def states(spark: SparkSession, d: str) -> DataFrame:
    """The reviews as the whole action log leaves them, under the rule that a remap target has to be free. Written once:
    what follows reads it several times."""
    reviews = as_reviews(said(spark, d))
    return stash(rv.review_states(reviews, rv.apply_review_actions(reviews, event_questions(spark, d), log(spark, d))).drop("original_question_id"))


def event_questions(spark: SparkSession, d: str) -> DataFrame:
    users = fx.of_events(spark, d, "SELECT DISTINCT user_id AS assessment_id FROM {events}")
    return users.select("assessment_id", F.explode(F.sequence(F.col("assessment_id") * 10 + 1, F.col("assessment_id") * 10 + 6)).alias("question_id"))


@query("SELECT assessment_id, answer_id, trigger FROM trig WHERE trigger IS NOT NULL")
def review_triggers(spark: SparkSession, d: str) -> DataFrame:
    return rv.build_review_queue(said(spark, d)).select("assessment_id", "answer_id", "trigger")


@query("SELECT assessment_id, answer_id, CASE WHEN answer_id % 6 = 0 THEN 'RESOLVED' ELSE 'PENDING' END AS status, CASE WHEN answer_id % 6 = 0 THEN 'UNMAPPED' ELSE trigger END AS trigger FROM trig WHERE answer_id % 6 = 0 OR trigger IS NOT NULL")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    m = said(spark, d)
    existing = m.where("answer_id % 6 = 0").select("assessment_id", "answer_id", F.lit("RESOLVED").alias("status"), F.lit("UNMAPPED").alias("trigger"), F.col("question_id").alias("original_question_id"), F.col("confidence").alias("original_confidence"))
    return rv.build_review_queue(m, existing).select("assessment_id", "answer_id", "status", "trigger")


@query("SELECT assessment_id, event_id, answer_id, action, target, k - 1 AS step, outcome, sts[i] AS status, nws[i] + assessment_id * 10 AS final_question_id FROM rv_steps WHERE k > 0")
def review_actions(spark: SparkSession, d: str) -> DataFrame:
    return rv.apply_review_actions(as_reviews(said(spark, d)), event_questions(spark, d), log(spark, d))


@query("SELECT assessment_id, event_id, answer_id, action, target, k - 1 AS step, outcome, sts[i] AS status, nws[i] + assessment_id * 10 AS final_question_id FROM rv_steps WHERE k > 0")
def review_actions_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same by the plan for large assessments, for all of them."""
    return rv.apply_review_actions(as_reviews(said(spark, d)), event_questions(spark, d), log(spark, d), whole_actions=0)


@query(
    "SELECT r.assessment_id, r.answer_id, r.event_id, r.action, nws[i] + r.assessment_id * 10 AS final_question_id, nullif(trim(a.reason), '') AS reason, m.question_id AS original_question_id FROM rv_steps r JOIN fx_act a ON r.event_id = a.event_id JOIN fx_am m ON r.assessment_id = m.assessment_id AND r.answer_id = m.answer_id WHERE outcome = 'APPLIED'"
)
def review_audit(spark: SparkSession, d: str) -> DataFrame:
    reviews, actions = as_reviews(said(spark, d)), log(spark, d)
    return rv.audit_events(rv.apply_review_actions(reviews, event_questions(spark, d), actions), reviews, actions)


@query("SELECT * FROM st")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d)


@query("SELECT * FROM simple_st")
def review_simple_states(spark: SparkSession, d: str) -> DataFrame:
    """Remaps taken as they come."""
    return rv.simple_review_states(as_reviews(said(spark, d)), log(spark, d))


@query("SELECT * FROM eff")
def review_effective(spark: SparkSession, d: str) -> DataFrame:
    return rv.effective_mappings(said(spark, d), states(spark, d))


@query("SELECT a.assessment_id, a.question_id, a.answer_id, b.answer_id AS other_answer_id FROM eff a JOIN eff b ON a.assessment_id = b.assessment_id AND a.question_id = b.question_id AND a.answer_id <> b.answer_id")
def review_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return rv.remap_conflicts(rv.effective_mappings(said(spark, d), states(spark, d)))


STATUS_LOG = "SELECT answer_id, ts, event_id, CASE action WHEN 'SKIP' THEN 'SKIPPED' WHEN 'REMAP' THEN 'IN_REVIEW' ELSE 'RESOLVED' END AS status FROM {actions}"


@query(
    "SELECT answer_id, event_id, before, status FROM (SELECT *, lag(status, 1, 'PENDING') OVER (PARTITION BY answer_id ORDER BY ts, event_id) AS before FROM slog) WHERE before <> status AND (before, status) NOT IN (('PENDING', 'IN_REVIEW'), ('PENDING', 'RESOLVED'), ('PENDING', 'SKIPPED'), ('IN_REVIEW', 'RESOLVED'), ('IN_REVIEW', 'SKIPPED'), ('SKIPPED', 'IN_REVIEW'), ('SKIPPED', 'RESOLVED'))",
    slog=STATUS_LOG.format(actions="fx_act"),
)
def review_illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rv.illegal_transitions(spark.sql(STATUS_LOG, actions=log(spark, d)), "answer_id", start="PENDING")


def listed(*values: object) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


DOCUMENT_LOG = "SELECT user_id AS document_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'PREPARING' WHEN 1 THEN 'READY' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PREPARING' ELSE 'UPLOADED' END AS status FROM {events}"
ASSESSMENT_LOG = "SELECT user_id AS assessment_id, ts, event_id, CASE event_id % 7 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'QUEUED' ELSE 'PROCESSING' END AS status FROM {events}"
ILLEGAL = "SELECT {entity}, event_id, before, status FROM (SELECT *, lag(status, 1, {start}) OVER (PARTITION BY {entity} ORDER BY ts, event_id) AS before FROM slog) WHERE before <> status AND (before, status) NOT IN {allowed}"


@query(ILLEGAL.format(entity="document_id", start="'UPLOADED'", allowed=listed(*rv.DOCUMENT_TRANSITIONS)), slog=DOCUMENT_LOG.format(events="events"))
def review_illegal_documents(spark: SparkSession, d: str) -> DataFrame:
    """Steps that a document may not take."""
    return rv.illegal_transitions(fx.of_events(spark, d, DOCUMENT_LOG), "document_id", rv.DOCUMENT_TRANSITIONS, "UPLOADED")


@query(ILLEGAL.format(entity="assessment_id", start="'CREATED'", allowed=listed(*rv.ASSESSMENT_TRANSITIONS)), slog=ASSESSMENT_LOG.format(events="events"))
def review_illegal_assessments(spark: SparkSession, d: str) -> DataFrame:
    """Steps that an assessment may not take; a completed one takes none."""
    return rv.illegal_transitions(fx.of_events(spark, d, ASSESSMENT_LOG), "assessment_id", rv.ASSESSMENT_TRANSITIONS, "CREATED")


@query(
    "SELECT a.assessment_id, answers, ai_mapped, pending, skipped, resolved, accept, remap, reject, effective_mapped, human, effective_unmapped FROM (SELECT assessment_id, count(*) AS answers, count(question_id) AS ai_mapped FROM fx_am GROUP BY 1) a JOIN (SELECT assessment_id, CAST(count_if(status = 'PENDING') AS BIGINT) AS pending, CAST(count_if(status = 'SKIPPED') AS BIGINT) AS skipped, CAST(count_if(status = 'RESOLVED') AS BIGINT) AS resolved, CAST(count_if(action = 'ACCEPT') AS BIGINT) AS accept, CAST(count_if(action = 'REMAP') AS BIGINT) AS remap, CAST(count_if(action = 'REJECT') AS BIGINT) AS reject FROM st GROUP BY 1) s USING (assessment_id) JOIN (SELECT assessment_id, count(question_id) AS effective_mapped, CAST(count_if(source = 'HUMAN') AS BIGINT) AS human, CAST(count_if(question_id IS NULL) AS BIGINT) AS effective_unmapped FROM eff GROUP BY 1) e USING (assessment_id)"
)
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    m, st = said(spark, d), states(spark, d)
    return rv.review_summary(m, st, rv.effective_mappings(m, st))


@query(
    "SELECT s.assessment_id, s.answer_id, s.status, m.band, e.question_id AS effective_question_id, e.source, 'Q' || (s.answer_id % 10) AS claimed_label_raw, CASE WHEN e.question_id - e.assessment_id * 10 <= 6 THEN (e.question_id % 10) || '.' END AS label_raw, CAST(CASE s.status WHEN 'PENDING' THEN 1 WHEN 'SKIPPED' THEN 3 ELSE 4 END AS INTEGER) AS place FROM st s JOIN am m ON s.answer_id = m.answer_id AND s.assessment_id = m.assessment_id JOIN eff e ON s.answer_id = e.answer_id AND s.assessment_id = e.assessment_id"
)
def review_work_list(spark: SparkSession, d: str) -> DataFrame:
    m, st = said(spark, d), states(spark, d)
    answers = m.select("assessment_id", "answer_id", F.concat(F.lit("Q"), F.col("answer_id") % 10).alias("claimed_label_raw"))
    questions = event_questions(spark, d).withColumn("label_raw", F.concat(F.col("question_id") % 10, F.lit(".")))
    items = rv.review_items(st, m, rv.effective_mappings(m, st), answers, questions)
    return items.select("assessment_id", "answer_id", "status", "band", "effective_question_id", "source", "claimed_label_raw", "label_raw", "place")


@query("SELECT m.assessment_id, m.answer_id, m.question_id AS ai_question_id, m.confidence AS ai_confidence, m.band AS ai_band, s.status AS human_status, s.action AS human_action, s.target AS human_question_id, e.question_id AS effective_question_id, e.source AS effective_source FROM am m JOIN st s ON m.assessment_id = s.assessment_id AND m.answer_id = s.answer_id JOIN eff e ON m.assessment_id = e.assessment_id AND m.answer_id = e.answer_id")
def review_layers(spark: SparkSession, d: str) -> DataFrame:
    m, st = said(spark, d), states(spark, d)
    return rv.mapping_layers(m, st, rv.effective_mappings(m, st)).drop("ai_reasons")


@query(
    "SELECT m.assessment_id, m.answer_id, CASE WHEN m.question_id IS NULL THEN CASE WHEN contains(m.reasons, 'NO_CANDIDATES') THEN 'NO_CANDIDATES' WHEN contains(m.reasons, 'LLM_NO_MATCH') THEN 'AI_NO_MATCH' ELSE 'UNMAPPED' END WHEN m.band = 'LOW' THEN 'LOW_CONFIDENCE' WHEN m.band = 'MEDIUM' THEN 'MEDIUM_CONFIDENCE' ELSE 'CONFLICT_RESOLVED' END AS trigger, q.label_raw, a.claimed_label_raw, c.shortlist FROM maps m JOIN fx_a a ON a.answer_id = m.answer_id LEFT JOIN fx_q q ON q.question_id = m.question_id LEFT JOIN (SELECT r.answer_id, string_agg(r.question_id || '=' || q.label_raw || '/' || length(q.text) || '/' || CAST(round(r.confidence * 1e6) AS BIGINT), ';' ORDER BY r.final_rank) AS shortlist FROM ranked r JOIN fx_q q ON r.question_id = q.question_id GROUP BY 1) c ON c.answer_id = m.answer_id WHERE m.question_id IS NULL OR m.band <> 'HIGH' OR contains(m.reasons, 'CONFLICT_RESOLVED')"
)
def review_item_list(spark: SparkSession, d: str) -> DataFrame:
    """The queue of the matcher's mappings with each answer's shortlist and its questions."""
    again, maps = ranked_and_mapped(spark, d)
    states = rv.build_review_queue(maps)
    questions = resolved(spark, d).select("assessment_id", "question_id", "label_raw", "text")
    effective = rv.effective_mappings(maps, states.select("assessment_id", "answer_id", F.lit(None).cast("string").alias("action"), F.lit(None).cast("long").alias("target")))
    items = rv.review_items(states, maps, effective, fx.answers(spark, d), questions, again.drop("rank").withColumnRenamed("final_rank", "rank"))
    shown = F.transform("candidates", lambda c: F.concat(c["question_id"].cast("string"), F.lit("="), c["label_raw"], F.lit("/"), F.length(c["question_text"]).cast("string"), F.lit("/"), F.round(c["confidence"] * 1e6).cast("long").cast("string")))
    out = stash(items.select("assessment_id", "answer_id", "trigger", "label_raw", "claimed_label_raw", F.array_join(shown, ";").alias("shortlist")), fx.dealing(spark, d), bucketed=False)
    discard(again)
    return out


# -- grading ------------------------------------------------------------------------------------------------------
def schemes_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return gr.resolve_rubrics(resolved(spark, d), gr.provided_rubrics(fx.rubrics(spark, d)))


def targets_of(spark: SparkSession, d: str, schemes: DataFrame | None = None) -> DataFrame:
    return stash(gr.grading_targets(fx.effective(spark, d), resolved(spark, d), schemes_of(spark, d)[0] if schemes is None else schemes))


def recommendations(spark: SparkSession, targets: DataFrame) -> DataFrame:
    crit = targets.where("reason is null").select("assessment_id", "answer_id", F.posexplode(F.array_sort("criteria")).alias("i", "c"))
    crit = crit.select("assessment_id", "answer_id", (F.col("i") + 1).alias("i"), "c.criterion_id", "c.max_marks")
    return spark.sql(fx.RECOMMENDATIONS, rated=spark.sql(fx.RATED, crit=crit))


def graded(spark: SparkSession, d: str, schemes: DataFrame | None = None) -> DataFrame:
    t = targets_of(spark, d, schemes)
    return gr.grade_answers(t, fx.answers(spark, d), recommendations(spark, t))


def history(spark: SparkSession, d: str, schemes: DataFrame | None = None) -> DataFrame:
    return stash(gr.supersede_grades(spark.sql(fx.PRIOR, answers=fx.answers(spark, d)), graded(spark, d, schemes)))


@query("SELECT assessment_id, question_id, source, total_marks FROM schemes")
def grade_schemes(spark: SparkSession, d: str) -> DataFrame:
    return schemes_of(spark, d)[0].select("assessment_id", "question_id", "source", "total_marks")


@query("SELECT assessment_id, rubric_id, reason FROM rub4 WHERE reason IS NOT NULL")
def grade_unresolved_rubrics(spark: SparkSession, d: str) -> DataFrame:
    return schemes_of(spark, d)[1].select("assessment_id", "rubric_id", "reason")


@query(
    "SELECT question_id, substr(sha256('{\"questionId\":' || question_id || ',\"totalMarks\":' || CAST(total_marks AS VARCHAR) || ',\"criteria\":[' || items || ']}'), 1, 16) AS version FROM (SELECT s.question_id, s.total_marks, string_agg('{\"id\":\"' || r.criterion_id || '\",\"description\":\"' || trim(r.description) || '\",\"maxMarks\":' || CAST(r.max_marks AS VARCHAR) || '}', ',' ORDER BY r.criterion_id) AS items FROM schemes s JOIN fx_rub r ON s.rubric_id = r.rubric_id GROUP BY 1, 2)"
)
def grade_rubric_versions(spark: SparkSession, d: str) -> DataFrame:
    provided = schemes_of(spark, d)[0].where("source = 'PROVIDED'")
    return provided.select("question_id", gr.rubric_version(F.col("question_id"), F.col("total_marks"), F.col("criteria")).alias("version"))


@query("SELECT assessment_id, answer_id, question_id, source, total_marks, reason FROM targets")
def grade_targets(spark: SparkSession, d: str) -> DataFrame:
    return targets_of(spark, d).select("assessment_id", "answer_id", "question_id", "source", "total_marks", "reason")


@query("SELECT t.answer_id, t.question_id, t.total_marks, count(*) AS n_criteria, any_value(length(a.text)) AS n_chars FROM targets t JOIN crit c ON t.answer_id = c.answer_id JOIN fx_a a ON a.answer_id = t.answer_id GROUP BY 1, 2, 3")
def grade_requests(spark: SparkSession, d: str) -> DataFrame:
    r = gr.build_grading_requests(targets_of(spark, d), fx.answers(spark, d))
    return r.select("answer_id", "question_id", "total_marks", F.size("criteria").cast("long").alias("n_criteria"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT assessment_id, answer_id, failure, awarded, partials, n_criteria FROM checked")
def grade_verified(spark: SparkSession, d: str) -> DataFrame:
    t = targets_of(spark, d)
    return gr.verify_recommendations(t, recommendations(spark, t)).select("assessment_id", "answer_id", "failure", "awarded", "partials", "n_criteria")


@query("SELECT * FROM grades")
def grade_results(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT t.assessment_id, t.answer_id FROM targets t WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.answer_id = t.answer_id AND p.is_current AND p.status <> 'FAILED' AND p.question_id IS NOT DISTINCT FROM t.question_id)")
def grade_again(spark: SparkSession, d: str) -> DataFrame:
    t = targets_of(spark, d)
    return gr.reuse_or_regrade(t, spark.sql(fx.PRIOR, answers=fx.answers(spark, d))).select(t.assessment_id, t.answer_id)


@query("SELECT * FROM history")
def grade_supersede(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d)


@query("SELECT assessment_id, answer_id, question_id, superseded_reason, CAST(row_number() OVER (PARTITION BY assessment_id ORDER BY graded_at DESC, answer_id) AS INTEGER) AS newest FROM history WHERE NOT is_current")
def grade_old(spark: SparkSession, d: str) -> DataFrame:
    return gr.grade_history(history(spark, d)).select("assessment_id", "answer_id", "question_id", "superseded_reason", "newest")


@query("SELECT assessment_id, answer_id, question_id, CAST(row_number() OVER (PARTITION BY assessment_id, question_id ORDER BY graded_at DESC, answer_id) AS INTEGER) AS newest FROM history WHERE NOT is_current")
def grade_old_by_question(spark: SparkSession, d: str) -> DataFrame:
    return gr.grade_history(history(spark, d), per_question=True).select("assessment_id", "answer_id", "question_id", "newest")


@query("SELECT r.answer_id, r.criterion_id, r.ordinal, CASE WHEN c.max_marks <= 0 OR r.awarded <= 0 THEN 'NOT_SATISFIED' WHEN r.awarded >= c.max_marks THEN 'SATISFIED' ELSE 'PARTIAL' END AS outcome, floor(r.awarded * 0.7 + 0.5) AS whole, floor(r.awarded * 0.7 * 2 + 0.5) / 2 AS half FROM recs r JOIN crit c ON r.answer_id = c.answer_id AND r.criterion_id = c.criterion_id")
def grade_criterion_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each recommended criterion, and seven tenths of its marks rounded to whole and to half marks."""
    t = targets_of(spark, d)
    maximum = t.where("reason is null").select("answer_id", F.explode("criteria").alias("c")).select("answer_id", "c.criterion_id", "c.max_marks")
    rows, some = recommendations(spark, t).join(maximum, ["answer_id", "criterion_id"]), F.col("awarded") * 0.7
    return rows.select("answer_id", "criterion_id", "ordinal", gr.criterion_outcome(F.col("awarded"), F.col("max_marks")).alias("outcome"), gr.round_mark(some, "WHOLE").alias("whole"), gr.round_mark(some, "HALF").alias("half"))


@query(
    "SELECT a.assessment_id, graded, review_required, failed, not_gradeable, awarded, available, coalesce(ungraded, 0.0) AS ungraded, CASE WHEN available > 0 THEN round(awarded / available * 1000) / 10 END AS percent FROM (SELECT assessment_id, CAST(count_if(status = 'GRADED') AS BIGINT) AS graded, CAST(count_if(status = 'REVIEW_REQUIRED') AS BIGINT) AS review_required, CAST(count_if(status = 'FAILED') AS BIGINT) AS failed, CAST(count_if(status = 'NOT_GRADEABLE') AS BIGINT) AS not_gradeable, coalesce(sum(awarded) FILTER (WHERE status IN ('GRADED', 'REVIEW_REQUIRED')), 0.0) AS awarded, coalesce(sum(maximum) FILTER (WHERE status IN ('GRADED', 'REVIEW_REQUIRED')), 0.0) AS available FROM history WHERE is_current GROUP BY 1) a LEFT JOIN (SELECT assessment_id, sum(total_marks) AS ungraded FROM schemes s WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.is_current AND h.status IN ('GRADED', 'REVIEW_REQUIRED') AND h.question_id = s.question_id AND h.assessment_id = s.assessment_id) GROUP BY 1) u USING (assessment_id)"
)
def grade_totals(spark: SparkSession, d: str) -> DataFrame:
    """The mark schemes are found once: grading and the marks left over both read them."""
    schemes = stash(schemes_of(spark, d)[0])
    return gr.grade_summary(history(spark, d, schemes), schemes)


@query("SELECT v.assessment_id, v.answer_id, v.verdict, q.label_raw, e.mapping_source, CAST(CASE v.status WHEN 'REVIEW_REQUIRED' THEN 1 WHEN 'FAILED' THEN 2 WHEN 'NOT_GRADEABLE' THEN 3 ELSE 4 END AS INTEGER) AS place FROM verdict v LEFT JOIN fx_q q ON v.question_id = q.question_id JOIN g_eff e ON v.answer_id = e.answer_id")
def grade_work_list(spark: SparkSession, d: str) -> DataFrame:
    return gr.grade_items(graded(spark, d), resolved(spark, d), fx.effective(spark, d)).select("assessment_id", "answer_id", "verdict", "label_raw", "mapping_source", "place")


@query(
    "SELECT q.assessment_id, answered, unanswered, coalesce(unmatched, 0) AS unmatched, coalesce(correct, 0) AS correct, coalesce(partial, 0) AS partial, coalesce(incorrect, 0) AS incorrect, coalesce(not_gradeable, 0) AS not_gradeable, coalesce(failed, 0) AS failed FROM (SELECT q.assessment_id, CAST(count_if(e.question_id IS NOT NULL) AS BIGINT) AS answered, CAST(count_if(e.question_id IS NULL) AS BIGINT) AS unanswered FROM fx_q q LEFT JOIN (SELECT DISTINCT question_id FROM g_eff) e USING (question_id) GROUP BY 1) q LEFT JOIN (SELECT assessment_id, CAST(count_if(question_id IS NULL) AS BIGINT) AS unmatched FROM g_eff GROUP BY 1) u USING (assessment_id) LEFT JOIN (SELECT assessment_id, CAST(count_if(verdict = 'Correct') AS BIGINT) AS correct, CAST(count_if(verdict = 'Partially correct') AS BIGINT) AS partial, CAST(count_if(verdict = 'Incorrect') AS BIGINT) AS incorrect, CAST(count_if(status = 'NOT_GRADEABLE') AS BIGINT) AS not_gradeable, CAST(count_if(status = 'FAILED') AS BIGINT) AS failed FROM verdict GROUP BY 1) g USING (assessment_id)"
)
def grade_overview(spark: SparkSession, d: str) -> DataFrame:
    return gr.paper_overview(fx.questions(spark, d), fx.effective(spark, d), graded(spark, d))


@query("SELECT assessment_id, count(*) AS considered, CAST(count_if(status IN ('GRADED', 'REVIEW_REQUIRED')) AS BIGINT) AS scored, CAST(count_if(status = 'NOT_GRADEABLE') AS BIGINT) AS not_gradeable, CAST(count_if(status = 'REVIEW_REQUIRED') AS BIGINT) AS review, coalesce(CAST(count_if(source = 'PROVIDED') AS BIGINT), 0) AS provided FROM grades GROUP BY 1")
def grade_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return gr.grading_run_summary(graded(spark, d))


@query("SELECT a.answer_id, a.page, a.x, a.y, coalesce(q.label_raw, 'Unmapped') AS label FROM fx_a a JOIN g_eff e ON a.answer_id = e.answer_id LEFT JOIN fx_q q ON e.question_id = q.question_id")
def grade_regions(spark: SparkSession, d: str) -> DataFrame:
    return gr.regions_by_page(fx.answers(spark, d), fx.effective(spark, d), fx.questions(spark, d)).select("answer_id", "page", "x", "y", "label")
