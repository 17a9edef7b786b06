"""Grading: rubrics tied to questions, recommendations verified, confidence, history and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import signals as s
from ..functions.geometry import clamp01
from ..sources.scratch import stash
from .labels import with_parsed

KEY = ["assessment_id", "answer_id"]
EPS = 1e-6


def valid_mark(mark: Column, granularity: str) -> Column:
    """Whole marks, or halves, that are finite and not negative."""
    unit = mark * (1 if granularity == "WHOLE" else 2)
    return F.coalesce((mark >= 0) & ~F.isnan(mark) & (F.abs(mark) < float("inf")) & (unit == F.floor(unit)), F.lit(False))


def round_mark(mark: Column, granularity: str) -> Column:
    return F.round(mark) if granularity == "WHOLE" else F.round(mark * 2) / 2


def criterion_outcome(awarded: Column, maximum: Column) -> Column:
    return F.when((maximum <= 0) | (awarded <= 0), "NOT_SATISFIED").when(awarded >= maximum, "SATISFIED").otherwise("PARTIAL")


def provided_rubrics(criteria: DataFrame) -> DataFrame:
    """Criterion rows to one row per rubric: (assessment_id, rubric_id, label_raw, total_marks, criteria)."""
    item = F.struct("criterion_id", "description", "max_marks", "allows_partial")
    return criteria.groupBy("assessment_id", "rubric_id").agg(F.first("label_raw").alias("label_raw"), F.first("total_marks").alias("total_marks"), F.array_sort(F.collect_list(item)).alias("criteria"))


def validate_rubric(marks: Column, total: Column, criteria: Column) -> Column:
    """Why a rubric cannot be used; null if it can: criteria, positive allocations, distinct ids, and the right sum."""
    sums = F.aggregate(F.transform(criteria, lambda c: c["max_marks"]), F.lit(0.0), lambda a, x: a + x)
    ids = F.transform(criteria, lambda c: c["criterion_id"])
    bad = F.exists(criteria, lambda c: c["max_marks"].isNull() | F.isnan(c["max_marks"]) | (c["max_marks"] <= 0) | (c["max_marks"] == float("inf")))
    worth = F.coalesce(marks, total, sums)
    return F.when(F.size(criteria) == 0, "NO_CRITERIA").when(bad, "INVALID_ALLOCATION").when(F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE_CRITERION").when(F.abs(sums - worth) > EPS, "INCONSISTENT_TOTAL")


def resolve_rubrics(questions: DataFrame, rubrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schemes, unresolved). A rubric belongs to the one question with its canonical label; the first valid rubric of
    a question, by id, counts. Questions left over with marks get one criterion worth them; others get none."""
    keyed = with_parsed(rubrics, "label_raw", "__p").withColumn("key", F.col("__p.normalized")).drop("__p")
    q = questions.select("assessment_id", "question_id", F.col("normalized_label").alias("key"), "marks")
    n = F.count("*").over(Window.partitionBy("assessment_id", "key"))
    unique = q.withColumn("n", n)
    counts = unique.groupBy("assessment_id", "key").agg(F.max("n").alias("n"), F.min("question_id").alias("question_id"), F.min("marks").alias("marks"))
    joined = keyed.join(counts, ["assessment_id", "key"], "left")
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    checked = joined.withColumn("broken", F.when(single, validate_rubric(F.col("marks"), F.col("total_marks"), F.col("criteria"))))
    usable = single & F.col("broken").isNull()
    first = F.min(F.when(usable, F.col("rubric_id"))).over(Window.partitionBy("assessment_id", "question_id"))
    judged = checked.withColumn("first", F.when(single, first))
    # a rubric after the first valid one of its question finds it taken, whatever its own state
    reason = F.when(F.col("n").isNull(), "NO_QUESTION").when(F.col("n") > 1, "AMBIGUOUS_LABEL").when(F.col("first") < F.col("rubric_id"), "ALREADY_CLAIMED").otherwise(F.col("broken"))
    judged = stash(judged.withColumn("reason", reason))  # read three times
    sums = F.aggregate(F.transform("criteria", lambda c: c["max_marks"]), F.lit(0.0), lambda a, x: a + x)
    provided = judged.where("reason is null").select("assessment_id", "question_id", F.lit("PROVIDED").alias("source"), F.coalesce("marks", "total_marks", sums).alias("total_marks"), "criteria")
    rest = questions.join(provided.select("assessment_id", "question_id"), ["assessment_id", "question_id"], "left_anti").where("marks > 0")
    schemes = provided.unionByName(generate_rubric(rest))
    return schemes, judged.where("reason is not null").select("assessment_id", "rubric_id", "label_raw", "reason")


def generate_rubric(questions: DataFrame) -> DataFrame:
    """One criterion worth the printed marks."""
    one = F.array(F.struct(F.lit("overall").alias("criterion_id"), F.lit("Overall").alias("description"), F.col("marks").alias("max_marks"), F.lit(True).alias("allows_partial")))
    return questions.select("assessment_id", "question_id", F.lit("GENERATED").alias("source"), F.col("marks").alias("total_marks"), one.alias("criteria"))


def rubric_version(question: Column, total: Column, criteria: Column) -> Column:
    """First 16 hex digits of a hash over the question, total and criteria in order of their ids."""
    items = F.transform(F.array_sort(criteria), lambda c: F.struct(c["criterion_id"].alias("id"), F.trim(c["description"]).alias("description"), c["max_marks"].alias("maxMarks")))
    return F.substring(F.sha2(F.to_json(F.struct(question.alias("questionId"), total.alias("totalMarks"), items.alias("criteria"))), 256), 1, 16)


def grading_targets(effective: DataFrame, questions: DataFrame, schemes: DataFrame) -> DataFrame:
    """(keys, question_id, scheme columns, reason): reason says why an answer cannot be graded, or is null."""
    q = questions.select("assessment_id", "question_id", F.col("text").rlike(s.GRADING_ASKS_DIAGRAM).alias("asks"), F.lit(True).alias("known"))
    joined = effective.select(*KEY, "question_id").join(q, ["assessment_id", "question_id"], "left").join(schemes, ["assessment_id", "question_id"], "left")
    reason = F.when(F.col("question_id").isNull(), "NO_EFFECTIVE_QUESTION_MAPPING").when(F.col("known").isNull(), "QUESTION_NOT_FOUND").when(F.col("total_marks").isNull(), "MARK_SCHEME_UNAVAILABLE")
    return joined.select(*KEY, "question_id", "source", "total_marks", "criteria", "asks", reason.alias("reason"))


def build_grading_requests(targets: DataFrame, answers: DataFrame) -> DataFrame:
    return targets.where("reason is null").join(answers.select(*KEY, "text"), KEY).select(*KEY, "question_id", "text", "total_marks", "criteria")


def verify_recommendations(targets: DataFrame, recommendations: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """(keys, failure, awarded, partials, n_criteria, reported, model_confidence) per recommended, gradeable answer.

    recommendations: criterion rows (keys, ordinal, criterion_id, awarded, reported_total, confidence). The first rule
    broken, by ordinal, is the failure: unknown or repeated criterion, illegal mark, over the maximum, part of an
    all-or-nothing criterion; then a missing criterion, a wrong total, a total over the scheme's.
    """
    rubric = targets.where("reason is null").select(*KEY, "total_marks", F.explode("criteria").alias("c"))
    rubric = rubric.select(*KEY, "total_marks", F.col("c.criterion_id").alias("criterion_id"), F.col("c.max_marks").alias("max_marks"), F.col("c.allows_partial").alias("allows_partial"))
    asked = recommendations.join(rubric.select(*KEY).distinct(), KEY, "left_semi")
    again = F.row_number().over(Window.partitionBy(*KEY, "criterion_id").orderBy("ordinal"))
    both = asked.withColumn("again", again).join(rubric, [*KEY, "criterion_id"], "full_outer")
    mark, top = F.col("awarded"), F.col("max_marks")
    fault = (
        F.when(F.col("ordinal").isNull(), None)
        .when(top.isNull(), "UNKNOWN_CRITERION")
        .when(F.col("again") > 1, "REPEATED_CRITERION")
        .when(~valid_mark(mark, c.granularity), "INVALID_MARK")
        .when(mark > top, "OVER_MAXIMUM")
        .when(~F.col("allows_partial") & (mark != 0) & (mark != top), "ALL_OR_NOTHING")
    )
    judged = both.withColumn("fault", fault).groupBy(*KEY).agg(
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal"))).alias("fault"),
        F.count_if(F.col("ordinal").isNull()).alias("missing"),
        F.count("ordinal").alias("cited"),
        F.sum("awarded").alias("awarded"),
        F.max("reported_total").alias("reported"),
        F.max("confidence").alias("model_confidence"),
        F.max("total_marks").alias("total"),
        F.count_if(F.coalesce((mark > 0) & (mark < top), F.lit(False))).alias("partials"),
        F.count("max_marks").alias("n_criteria"),
    )
    failure = F.coalesce("fault", F.when(F.col("missing") > 0, "MISSING_CRITERION").when(F.abs(F.col("awarded") - F.col("reported")) > EPS, "INCONSISTENT_TOTAL").when(F.col("awarded") > F.col("total"), "OVER_TOTAL"))
    return judged.where("cited > 0").select(*KEY, failure.alias("failure"), "awarded", "partials", "n_criteria", "model_confidence")


def grading_confidence(source: Column, asks: Column, drawn: Column, uncertain: Column, model: Column, clear_share: Column, c: Config = DEFAULT) -> Column:
    rubric = clamp01(F.when(source == "PROVIDED", 1.0).otherwise(0.55) * F.when(asks & drawn, 0.6).otherwise(1.0))
    clarity = F.when(clear_share.isNull(), 0.5).otherwise(clamp01(clear_share) * 0.4 + 0.6)
    return clamp01(c.grade_weight_rubric * rubric + c.grade_weight_transcription * F.when(uncertain, 0.4).otherwise(1.0) + c.grade_weight_model * clamp01(model) + c.grade_weight_criterion * clarity)


def grade_answers(targets: DataFrame, answers: DataFrame, recommendations: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One row per target: status, marks, confidence and reasons. Not gradeable and failed rows have null marks, never 0."""
    checked = verify_recommendations(targets, recommendations, c)
    a = answers.select(*KEY, F.col("text").contains("[unclear]").alias("uncertain"), F.col("diagram").alias("drawn"))
    rows = targets.join(a, KEY, "left").join(checked, KEY, "left")
    share = F.when(F.col("n_criteria") > 0, (F.col("n_criteria") - F.col("partials")) / F.col("n_criteria"))
    sure = s.round6(grading_confidence(F.col("source"), F.col("asks"), F.col("drawn"), F.col("uncertain"), F.col("model_confidence"), share, c))
    failed = F.col("reason").isNull() & (F.col("failure").isNotNull() | F.col("awarded").isNull())
    good = F.col("reason").isNull() & ~failed
    why = F.array_compact(F.array(F.when(sure < c.grade_threshold, "LOW_GRADING_CONFIDENCE"), F.when(F.col("uncertain"), "UNCERTAIN_TRANSCRIPTION"), F.when(F.col("source") == "GENERATED", "GENERATED_RUBRIC"), F.when(F.col("asks") & F.col("drawn"), "DIAGRAM_NOT_ASSESSABLE")))
    status = F.when(F.col("reason").isNotNull(), "NOT_GRADEABLE").when(failed, "FAILED").when(F.size(why) > 0, "REVIEW_REQUIRED").otherwise("GRADED")
    return rows.select(
        *KEY, "question_id", status.alias("status"), F.when(good, F.col("awarded")).alias("awarded"), F.when(F.col("reason").isNull(), F.col("total_marks")).alias("maximum"),
        F.when(good, sure).alias("confidence"), F.when(good, why).otherwise(F.array_compact(F.array(F.coalesce("reason", F.coalesce("failure", F.lit("NO_RECOMMENDATION")))))).alias("reasons"), "source",
    )


def reuse_or_regrade(targets: DataFrame, previous: DataFrame) -> DataFrame:
    """Targets to grade again: all but those whose current grade has the same question and did not fail."""
    good = previous.where("is_current and status != 'FAILED'").select(*KEY, F.col("question_id").alias("had"))
    return targets.join(good, [targets.assessment_id == good.assessment_id, targets.answer_id == good.answer_id, targets.question_id.eqNullSafe(good.had)], "left_anti")


def supersede_grades(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """History: old current rows of answers graded again stop being current, with a reason; nothing is deleted.

    graded_at is carried along where the tables have it, and null where they have not."""
    at = lambda df: F.col("graded_at") if "graded_at" in df.columns else F.lit(None).cast(previous.schema["graded_at"].dataType if "graded_at" in previous.columns else "date").alias("graded_at")
    new = fresh.select(*KEY, F.col("question_id").alias("new_question"), F.lit(True).alias("again"))
    joined = previous.join(new, KEY, "left")
    hit = F.col("is_current") & F.coalesce("again", F.lit(False))
    reason = F.when(hit, F.when(F.col("question_id").eqNullSafe(F.col("new_question")), "REGRADED").otherwise("MAPPING_CHANGED"))
    old = joined.select(*KEY, "question_id", "status", "awarded", "maximum", (F.col("is_current") & ~hit).alias("is_current"), reason.alias("superseded_reason"), at(previous))
    return old.unionByName(fresh.select(*KEY, "question_id", "status", "awarded", "maximum", F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("superseded_reason"), at(fresh)))


def grade_summary(grades: DataFrame, schemes: DataFrame) -> DataFrame:
    """Totals per assessment over current grades, and the marks of questions without a scored one."""
    current = grades.where("is_current")
    scored = F.col("status").isin("GRADED", "REVIEW_REQUIRED")
    n = lambda x: F.count_if(F.col("status") == x)
    sums = current.groupBy("assessment_id").agg(
        n("GRADED").alias("graded"), n("REVIEW_REQUIRED").alias("review_required"), n("FAILED").alias("failed"), n("NOT_GRADEABLE").alias("not_gradeable"),
        F.coalesce(F.sum(F.when(scored, F.col("awarded"))), F.lit(0.0)).alias("awarded"), F.coalesce(F.sum(F.when(scored, F.col("maximum"))), F.lit(0.0)).alias("available"),
    )
    done = current.where(scored).select("assessment_id", "question_id").distinct()
    left = schemes.join(done, ["assessment_id", "question_id"], "left_anti").groupBy("assessment_id").agg(F.sum("total_marks").alias("ungraded"))
    percent = F.when(F.col("available") > 0, F.round(F.col("awarded") / F.col("available") * 1000) / 10)
    return sums.join(left, "assessment_id", "left").withColumn("ungraded", F.coalesce("ungraded", F.lit(0.0))).withColumn("percent", percent)


def grade_history(grades: DataFrame, per_question: bool = False) -> DataFrame:
    """Superseded grades with newest: 1 for the last graded of the assessment, or of each question, and so on; equal
    times go by answer."""
    own = Window.partitionBy("assessment_id", *(["question_id"] if per_question else [])).orderBy(F.desc_nulls_last("graded_at"), "answer_id")
    return grades.where("not is_current").withColumn("newest", F.row_number().over(own))


def verdict_label(status: Column, awarded: Column, maximum: Column, reasons: Column) -> Column:
    scored = F.when(awarded >= maximum, "Correct").when(awarded > 0, "Partially correct").otherwise("Incorrect")
    return F.when(status == "FAILED", "Could not be marked").when(status == "NOT_GRADEABLE", F.when(F.array_contains(reasons, "MARK_SCHEME_UNAVAILABLE"), "No marks to grade against").otherwise("Not gradeable")).otherwise(scored)


def grade_place(status: Column) -> Column:
    """Order to work on: to review, failed, not gradeable, the rest."""
    return F.when(status == "REVIEW_REQUIRED", 1).when(status == "FAILED", 2).when(status == "NOT_GRADEABLE", 3).otherwise(4)


def grade_items(grades: DataFrame, questions: DataFrame, effective: DataFrame) -> DataFrame:
    q = questions.select("assessment_id", "question_id", "label_raw")
    e = effective.select(*KEY, "mapping_source")
    wide = grades.join(q, ["assessment_id", "question_id"], "left").join(e, KEY, "left")
    return wide.withColumn("verdict", verdict_label(F.col("status"), F.col("awarded"), F.col("maximum"), F.col("reasons"))).withColumn("place", grade_place(F.col("status")))


def paper_overview(questions: DataFrame, effective: DataFrame, grades: DataFrame) -> DataFrame:
    """Per assessment: questions answered or not, answers without a question, and verdicts."""
    held = effective.where("question_id is not null").select("assessment_id", "question_id").distinct().withColumn("answered", F.lit(1))
    q = questions.join(held, ["assessment_id", "question_id"], "left").groupBy("assessment_id").agg(F.count("answered").alias("answered"), F.count_if(F.col("answered").isNull()).alias("unanswered"))
    u = effective.groupBy("assessment_id").agg(F.count_if(F.col("question_id").isNull()).alias("unmatched"))
    v = verdict_label(F.col("status"), F.col("awarded"), F.col("maximum"), F.col("reasons"))
    g = grades.groupBy("assessment_id").agg(F.count_if(v == "Correct").alias("correct"), F.count_if(v == "Partially correct").alias("partial"), F.count_if(v == "Incorrect").alias("incorrect"), F.count_if(F.col("status") == "NOT_GRADEABLE").alias("not_gradeable"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return q.join(u, "assessment_id", "left").join(g, "assessment_id", "left").na.fill(0)


def grading_run_summary(grades: DataFrame) -> DataFrame:
    n = lambda *x: F.count_if(F.col("status").isin(*x))
    return grades.groupBy("assessment_id").agg(F.count("*").alias("considered"), n("GRADED", "REVIEW_REQUIRED").alias("scored"), n("NOT_GRADEABLE").alias("not_gradeable"), n("REVIEW_REQUIRED").alias("review"), F.count_if(F.col("source") == "PROVIDED").alias("provided"))


def regions_by_page(answers: DataFrame, effective: DataFrame, questions: DataFrame) -> DataFrame:
    """Each answer region with the label of the question in effect."""
    q = questions.select("assessment_id", "question_id", "label_raw")
    e = effective.select(*KEY, "question_id").join(q, ["assessment_id", "question_id"], "left")
    return answers.join(e, KEY, "left").select(*KEY, "page", "x", "y", "width", "height", F.coalesce("label_raw", F.lit("Unmapped")).alias("label"))
