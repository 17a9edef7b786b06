"""Decisions: external verdicts folded in, candidates ranked again, mappings banded and explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import signals as s
from ..functions.geometry import clamp01

KEY = ["assessment_id", "answer_id"]
EXACT = ("EXACT_NORMALIZED_LABEL", "EXACT_PARENT_AND_SUBQUESTION")


def decisive_gate(top: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """(assessment_id, answer_id, decisive): the best candidate has an exact label, a good score and a clear margin,
    and the label says nothing for the second."""
    at = lambda rank, col: F.max(F.when(F.col("rank") == rank, F.col(col)))
    ends = top.groupBy(*KEY).agg(at(1, "label_kind").alias("kind"), at(1, "candidate_score").alias("first"), at(2, "candidate_score").alias("second"), at(2, "label").alias("other"))
    margin = F.round(F.col("first") - F.coalesce("second", F.lit(0.0)), 6)
    good = F.col("kind").isin(*EXACT) & (F.col("first") >= c.decisive_score) & (F.coalesce("other", F.lit(0.0)) == 0) & (margin >= c.decisive_margin)
    return ends.select(*KEY, good.alias("decisive"))


def build_verdict_requests(top: DataFrame, answers: DataFrame, questions: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One row per answer that is not decisive: its text and claim, and the shortlist in rank order with labels and texts."""
    open_ = decisive_gate(top, c).where(~F.col("decisive")).select(*KEY)
    listed = top.join(open_, KEY).join(questions.select("assessment_id", "question_id", "label_raw", F.col("text").alias("question_text"), "marks", "parent_label"), ["assessment_id", "question_id"])
    short = listed.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "question_id", "label_raw", "question_text", "marks", "parent_label"))).alias("shortlist"))
    return short.join(answers.select(*KEY, "text", "claimed_label_raw"), KEY)


def guard_verdicts(verdicts: DataFrame, top: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(assessment_id, answer_id, decision, question_id, model_confidence, reason_code): verdicts that may be used.

    A match with a question outside the shortlist becomes NO_MATCH with INVALID_CANDIDATE_ID and no confidence; a
    NO_MATCH has no question. Only answers in asked count, if that is given.
    """
    rows = verdicts if asked is None else verdicts.join(asked.select(*KEY), KEY, "left_semi")
    listed = top.select("assessment_id", "answer_id", "question_id", F.lit(True).alias("listed"))
    joined = rows.join(listed, ["assessment_id", "answer_id", "question_id"], "left")
    bad = (F.col("decision") == "MATCH") & F.col("listed").isNull()
    none = bad | (F.col("decision") != "MATCH")
    return joined.select(
        *KEY, F.when(none, "NO_MATCH").otherwise("MATCH").alias("decision"), F.when(~none, F.col("question_id")).alias("chosen"),
        F.when(bad, 0.0).otherwise(F.col("model_confidence")).alias("model_confidence"), F.when(bad, "INVALID_CANDIDATE_ID").alias("reason_code"),
    )


def final_confidence(top: DataFrame, verdicts: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Adds consulted, selected, no_match, llm_confidence and confidence, and ranks again (ties keep the old order)."""
    joined = top.join(verdicts.select(*KEY, "decision", "chosen", "model_confidence"), KEY, "left")
    consulted = F.col("decision").isNotNull()
    selected = F.coalesce(F.col("chosen") == F.col("question_id"), F.lit(False))
    weight = F.when(consulted, c.weight_verdict).otherwise(0.0)
    agreement = F.when(selected, clamp01(F.col("model_confidence"))).otherwise(0.0)
    penalty = F.when(F.col("label_kind") == "CONFLICTING_LABEL", c.label_conflict_penalty).otherwise(0.0)
    value = s.round6(clamp01((1 - weight) * F.col("candidate_score") + weight * agreement - penalty))
    out = joined.select(*top.columns, consulted.alias("consulted"), selected.alias("selected"), F.coalesce(F.col("decision") == "NO_MATCH", F.lit(False)).alias("no_match"), F.col("model_confidence").alias("llm_confidence"), value.alias("confidence"))
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("confidence"), "rank")))


def contested_answers(ranked: DataFrame, assignment: DataFrame) -> DataFrame:
    """Answers assigned to another question than their own best after ranking again."""
    best = ranked.where("final_rank = 1").select(*KEY, F.col("question_id").alias("best"))
    return assignment.join(best, KEY).where("question_id != best").select(*KEY)


def reason_codes(contested: F.Column, skipped: F.Column, band: F.Column) -> F.Column:
    """Why a mapped answer ended where it did, strongest evidence first."""
    kind, strong, sure = F.col("label_kind"), F.col("semantic") >= 0.7, F.col("label") >= 0.9
    return F.array_compact(
        F.array(
            F.when(kind == "EXACT_NORMALIZED_LABEL", "DIRECT_LABEL_MATCH").when(kind.isin("EXACT_PARENT_AND_SUBQUESTION", "PARENT_MATCH_SUBPART_MATCH"), "PARENT_SUBPART_MATCH").when(kind == "SUBPART_ONLY", "SUBPART_ONLY_MATCH").when(kind == "CONFLICTING_LABEL", "LABEL_CONFLICT"),
            F.when(strong & sure, "LABEL_AND_SEMANTIC_AGREE").when(strong, "SEMANTIC_MATCH"),
            F.when(F.col("position") >= 0.8, "POSITIONAL_SUPPORT"),
            F.when(F.col("structure") >= 0.7, "STRUCTURAL_SUPPORT"),
            F.when(skipped, "ADJUDICATION_UNNECESSARY").when(~F.col("consulted"), "LLM_UNAVAILABLE").when(F.col("no_match"), "LLM_NO_MATCH").when(F.col("selected"), "LLM_VERIFIED").otherwise("LLM_SELECTED_ALTERNATIVE"),
            F.when(contested, "CONFLICT_RESOLVED"),
            F.when(band == "LOW", "LOW_CONFIDENCE"),
        )
    )


def build_mappings(answers: DataFrame, ranked: DataFrame, assignment: DataFrame, decisive: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One row per answer: question, status, confidence, band and ordered reasons; unmapped answers have confidence 0."""
    mapped = ranked.join(assignment.select(*KEY, "question_id"), [*KEY, "question_id"], "left_semi")
    facts = ranked.groupBy(*KEY).agg(F.bool_or("no_match").alias("said_none"), F.max_by("question_id", F.struct(-F.col("final_rank"))).alias("best"))
    rows = answers.select(*KEY).join(mapped, KEY, "left").join(facts, KEY, "left").join(decisive, KEY, "left")
    has = F.col("question_id").isNotNull()
    band = F.when(has, s.confidence_band(F.col("confidence"), c)).otherwise("LOW")
    none = F.array(F.when(F.col("best").isNull(), "NO_CANDIDATES").when(F.col("said_none"), "LLM_NO_MATCH").otherwise("BELOW_ASSIGNMENT_THRESHOLD"), F.lit("NO_MATCH"))
    reasons = reason_codes(F.col("question_id") != F.col("best"), F.coalesce("decisive", F.lit(False)), band)
    return rows.select(
        *KEY, "question_id", F.when(has, s.status_for_band(band)).otherwise("UNMAPPED").alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        band.alias("band"), F.when(has, reasons).otherwise(none).alias("reasons"), F.coalesce("consulted", F.lit(False)).alias("consulted"),
    )


def unmapped_questions(questions: DataFrame, mappings: DataFrame) -> DataFrame:
    return questions.join(mappings.where("question_id is not null"), ["assessment_id", "question_id"], "left_anti").select("assessment_id", "question_id")


def unmapped_answers(mappings: DataFrame) -> DataFrame:
    return mappings.where("question_id is null").select(*KEY)


def mapping_run_summary(mappings: DataFrame) -> DataFrame:
    """Counts by status per assessment."""
    n = lambda cond: F.count_if(cond)
    status = F.col("status")
    return mappings.groupBy("assessment_id").agg(
        F.count("*").alias("answers"), n(status == "AUTO_MAPPED").alias("auto_mapped"), n(status == "REVIEW_REQUIRED").alias("review_required"),
        n(status == "HUMAN_REVIEW").alias("human_review"), n(status == "UNMAPPED").alias("unmapped"), n(F.col("consulted")).alias("consulted"),
    )


def mapping_run_report(mappings: DataFrame, questions: DataFrame, texts: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """mapping_run_summary with the questions, the different texts that had to be embedded, and the parameters of the run.

    texts: (assessment_id, embedding_key) of all questions and answers; a text that an assessment has twice is embedded
    once. Assessments without a mapping have no row; null keys are not embedded.
    """
    asked = questions.groupBy("assessment_id").agg(F.count("*").alias("questions"))
    keys = texts.where("embedding_key is not null").distinct().groupBy("assessment_id").agg(F.count("*").alias("embeddings"))
    out = mapping_run_summary(mappings).join(asked, "assessment_id", "left").join(keys, "assessment_id", "left").na.fill(0, ["questions", "embeddings"])
    weights = {"label": c.weight_label, "semantic": c.weight_semantic, "position": c.weight_position, "structure": c.weight_structure, "llm": c.weight_verdict}
    limits = {"high": c.band_high, "medium": c.band_medium, "minimum": c.min_assignment}
    return out.withColumns({"top_k": F.lit(c.top_k)} | {f"weight_{k}": F.lit(v) for k, v in weights.items()} | {f"threshold_{k}": F.lit(v) for k, v in limits.items()})


def band_counts(ranked: DataFrame, c: Config = DEFAULT, score: str = "candidate_score") -> DataFrame:
    """Best candidates per assessment by band."""
    band = s.confidence_band(F.col(score), c)
    return ranked.where("rank = 1").groupBy("assessment_id").agg(*(F.count_if(band == b).alias(b.lower()) for b in ("HIGH", "MEDIUM", "LOW")))
