"""Review: a queue from mappings, an action log folded into review states, and what is in effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, stash
from .matching import fold_blocks
from .scan import WHOLE_ROWS, in_order

KEY = ["assessment_id", "answer_id"]
# Transitions that are allowed, and the longest reason.
REVIEW_TRANSITIONS = (("PENDING", "IN_REVIEW"), ("PENDING", "RESOLVED"), ("PENDING", "SKIPPED"), ("IN_REVIEW", "RESOLVED"), ("IN_REVIEW", "SKIPPED"), ("SKIPPED", "IN_REVIEW"), ("SKIPPED", "RESOLVED"))
DOCUMENT_TRANSITIONS = (("UPLOADED", "PREPARING"), ("UPLOADED", "FAILED"), ("PREPARING", "READY"), ("PREPARING", "FAILED"), ("READY", "PREPARING"), ("FAILED", "PREPARING"))
ASSESSMENT_TRANSITIONS = (("CREATED", "QUEUED"), ("CREATED", "FAILED"), ("QUEUED", "PROCESSING"), ("QUEUED", "FAILED"), ("PROCESSING", "COMPLETED"), ("PROCESSING", "FAILED"), ("FAILED", "QUEUED"))
MAX_REASON = 1000
ORDER = ("PENDING", "IN_REVIEW", "SKIPPED")


def review_trigger() -> F.Column:
    """Why a mapping needs a look; null if it does not."""
    has = lambda code: F.array_contains("reasons", code)
    none = F.when(has("NO_CANDIDATES"), "NO_CANDIDATES").when(has("LLM_NO_MATCH"), "AI_NO_MATCH").otherwise("UNMAPPED")
    return F.when(F.col("question_id").isNull(), none).when(F.col("band") == "LOW", "LOW_CONFIDENCE").when(F.col("band") == "MEDIUM", "MEDIUM_CONFIDENCE").when(has("CONFLICT_RESOLVED"), "CONFLICT_RESOLVED")


def build_review_queue(mappings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Existing reviews untouched, and a pending one, with what the matcher said, for each other answer that needs it."""
    fresh = mappings.withColumn("trigger", review_trigger()).where("trigger is not null")
    fresh = fresh.select(*KEY, F.lit("PENDING").alias("status"), "trigger", F.col("question_id").alias("original_question_id"), F.col("confidence").alias("original_confidence"))
    if existing is None:
        return fresh
    return existing.select(*fresh.columns).unionByName(fresh.join(existing.select(*KEY), KEY, "left_anti"))


def normal_reason(reason: F.Column) -> F.Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(reason), F.lit(""))


OUTCOMES = "assessment_id long, event_id long, answer_id long, action string, target long, step long, outcome string, status string, final_question_id long"


def with_facts(actions: DataFrame, reviews: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds what an action has to be judged by, so that the fold needs no copies of an assessment's tables: found (there
    is such a review), original (its question), known (the target exists), holders (answers that the matcher gave the
    target to) and refused (its reason is too long). actions may be a stream, and need not have reasons; the other two
    are tables."""
    long = F.coalesce(F.length(normal_reason(F.col("reason"))) > MAX_REASON, F.lit(False)) if "reason" in actions.columns else F.lit(False)
    actions = actions.withColumn("refused", long).drop("reason")
    own = reviews.select(*KEY, F.lit(True).alias("found"), F.col("original_question_id").alias("original"))
    there = questions.select("assessment_id", F.col("question_id").alias("target"), F.lit(True).alias("known")).distinct()
    holders = reviews.where("original_question_id is not null").groupBy("assessment_id", F.col("original_question_id").alias("target")).agg(F.collect_set("answer_id").alias("holders"))
    return actions.join(own, KEY, "left").join(there, ["assessment_id", "target"], "left").join(holders, ["assessment_id", "target"], "left")


class ReviewFold:
    """The reviews of one assessment as actions arrive, in order; answers without an action so far are not held."""

    def __init__(self, rows: list[tuple[int, str, str | None, int | None, int | None]] = ()):
        """rows: (answer_id, status, action, target, question now)."""
        self.state = {r[0]: list(r[1:]) for r in rows}
        self.holds: dict[int, set[int]] = {}
        for a, (_, _, _, now) in self.state.items():
            if now is not None:
                self.holds.setdefault(now, set()).add(a)

    def taken(self, r: dict) -> bool:
        """Whether another answer has the target now."""
        if self.holds.get(r["target"], set()) - {r["answer_id"]}:
            return True
        return any(a != r["answer_id"] and a not in self.state for a in (r["holders"] if r["holders"] is not None else ()))

    def apply(self, r: dict) -> tuple[str, str | None, int | None]:
        """(outcome, status, question) after an action with its facts (with_facts)."""
        a, action, target = r["answer_id"], r["action"], r["target"]
        status, before, to, now = self.state.get(a, ["PENDING", None, None, r["original"]] if r["found"] else [None] * 4)
        if r["refused"]:
            return "REASON_TOO_LONG", status, now
        if not r["found"]:
            return "NOT_FOUND", None, None
        if before == action and (action != "REMAP" or to == target):
            outcome = "REPEAT"
        elif status == "RESOLVED":
            outcome = "CONFLICT_SETTLED"
        elif action == "REMAP" and target is None:
            outcome = "INVALID_TARGET"
        elif action == "REMAP" and not r["known"]:
            outcome = "UNKNOWN_QUESTION"
        elif action == "REMAP" and self.taken(r):
            outcome = "QUESTION_ALREADY_ASSIGNED"
        elif status == "SKIPPED" and action == "SKIP":
            outcome = "ILLEGAL_TRANSITION"
        else:
            outcome, status = "APPLIED", "SKIPPED" if action == "SKIP" else "RESOLVED"
            if now is not None:
                self.holds.get(now, set()).discard(a)
            now = None if action == "REJECT" else target if action == "REMAP" else r["original"]
            if now is not None:
                self.holds.setdefault(now, set()).add(a)
            self.state[a] = [status, action, target, now]
        return outcome, status, now


def fold_actions(key: object, rows: list[dict]) -> list[dict]:
    """Actions of one assessment in order, each with its facts."""
    fold, out = ReviewFold(), []
    for step, r in enumerate(rows):
        outcome, status, question = fold.apply(r)
        out.append({"assessment_id": key, "event_id": r["event_id"], "answer_id": r["answer_id"], "action": r["action"], "target": r["target"], "step": step, "outcome": outcome, "status": status, "final_question_id": question})
    return out


#: Actions of an assessment from which on they are judged in rounds instead of one after another.
WHOLE_ACTIONS = 100_000


def apply_review_actions(reviews: DataFrame, questions: DataFrame, actions: DataFrame, whole_actions: int = WHOLE_ACTIONS, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Outcome of each action of the log, by assessment in (ts, event_id) order; see OUTCOMES.

    An action with a reason of over MAX_REASON characters is refused before anything is looked at. A repeat of the
    recorded decision changes nothing; a settled review refuses others; a remap target has to exist and be free at that
    moment. reviews: assessment_id, answer_id, original_question_id for every answer. Assessments of up to whole_actions
    actions are folded one by one, larger ones are judged in rounds (judge_in_rounds); both give the same rows.
    """
    log = actions.select("assessment_id", "answer_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "action", "target", *(["reason"] if "reason" in actions.columns else []))
    large = stash(log.groupBy("assessment_id").count().where(F.col("count") > whole_actions).select("assessment_id"))
    if large.isEmpty():
        return fold_blocks(with_facts(log, reviews, questions), "assessment_id", ["ts", "event_id"], fold_actions, OUTCOMES)
    small = fold_blocks(with_facts(log.join(large, "assessment_id", "left_anti"), reviews, questions), "assessment_id", ["ts", "event_id"], fold_actions, OUTCOMES)
    return small.unionByName(judge_in_rounds(log.join(large, "assessment_id", "left_semi"), reviews, questions, whole_rows).select(*small.columns))


def judge_in_rounds(log: DataFrame, reviews: DataFrame, questions: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """What ReviewFold says of each action, without going through them one by one.

    An answer is settled by its first action that is an acceptance, a rejection, or a remap to a known question that is
    free. Only the last asks about other answers: how many hold the question at that moment, which follows from when they
    were settled. So: assume which remaps find their question taken, settle all answers, count who holds what when, and
    assume again, until nothing changes. What a remap finds depends on earlier actions only, so there is one such state,
    and after n rounds at least the first n remaps that wait for one another are right. Each round is a few joins and a
    running sum by question; no task holds an assessment.
    """
    facts = with_facts(log, reviews, questions).drop("holders")
    known = stash(in_order(facts, "assessment_id", ["ts", "event_id"], at="step", whole_rows=whole_rows))
    valid = known.where("found and not refused")
    remap = F.coalesce(F.col("action") == "REMAP", F.lit(False))
    asks = valid.where(remap & F.col("target").isNotNull() & F.coalesce(F.col("known"), F.lit(False))).select(*KEY, "step", "target", "original")
    others = valid.where(~remap & (F.col("action") != "SKIP")).select(*KEY, "step", "action", F.lit(None).cast("long").alias("target"), "original")
    held = reviews.where("original_question_id is not null").groupBy("assessment_id", F.col("original_question_id").alias("question")).agg(F.count("*").alias("held"))
    spot = F.struct("assessment_id", "question").alias("spot")

    def settled(taken: DataFrame) -> DataFrame:
        """(keys, at, by, to, original): when, how and to which question answers are settled."""
        free = asks.join(taken, ["assessment_id", "step"], "left_anti").select(*KEY, "step", F.lit("REMAP").alias("action"), "target", "original")
        return others.unionByName(free).groupBy(*KEY).agg(F.min(F.struct("step", "action", "target", "original")).alias("s")).select(*KEY, F.col("s.step").alias("at"), F.col("s.action").alias("by"), F.col("s.target").alias("to"), F.col("s.original").alias("original"))

    def taken_after(state: DataFrame) -> DataFrame:
        """(assessment_id, step): remaps that find their question held by another answer."""
        leaves = state.where("original is not null and (by = 'REJECT' or by = 'REMAP' and `to` != original)").select("assessment_id", F.col("original").alias("question"), F.col("at").alias("step"), F.lit(-1).alias("change"))
        joins = state.where("by = 'REMAP' and not (`to` <=> original)").select("assessment_id", F.col("to").alias("question"), F.col("at").alias("step"), F.lit(1).alias("change"))
        # an answer that is settled asks no more, so it holds its own question still when it asks
        asked = asks.select("assessment_id", F.col("target").alias("question"), "step", F.lit(0).alias("change"), F.coalesce(F.col("original") == F.col("target"), F.lit(False)).cast("int").alias("own"))
        moves = leaves.unionByName(joins).withColumn("own", F.lit(None).cast("int"))
        rows = asked.unionByName(moves).withColumn("later", F.col("own").isNull()).select("assessment_id", "question", "step", "change", "own", "later", spot)
        counted = in_order(rows, "spot", ["step", "later"], summed={"moved": F.col("change")}, whole_rows=whole_rows).where("not later")
        return counted.join(held, ["assessment_id", "question"], "left").where(F.coalesce("held", F.lit(0)) + F.col("moved") - F.col("own") > 0).select("assessment_id", "step")

    taken, mark = stash(asks.select("assessment_id", "step").where("false")), None
    while True:
        state = stash(settled(taken))
        again = stash(taken_after(state))
        found = tuple(again.agg(F.count("*"), F.bit_xor(F.xxhash64("assessment_id", "step"))).first())
        discard(taken)
        taken = again
        if found == mark:
            break
        mark = found
        discard(state)

    skipped = valid.where("action = 'SKIP'").groupBy(*KEY).agg(F.min("step").alias("skip"))
    all_of = known.join(state.drop("original"), KEY, "left").join(skipped, KEY, "left")
    over = F.col("step") > F.col("at")
    same = (F.col("action") == F.col("by")) & ((F.col("action") != "REMAP") | F.col("target").eqNullSafe(F.col("to")))
    skip = F.col("action") == "SKIP"
    outcome = (
        F.when(F.col("refused"), "REASON_TOO_LONG").when(F.col("found").isNull(), "NOT_FOUND").when(F.col("step") == F.col("at"), "APPLIED")
        .when(over, F.when(same, "REPEAT").otherwise("CONFLICT_SETTLED")).when(skip, F.when(F.col("step") == F.col("skip"), "APPLIED").otherwise("REPEAT"))
        .when(F.col("target").isNull(), "INVALID_TARGET").when(F.col("known").isNull(), "UNKNOWN_QUESTION").otherwise("QUESTION_ALREADY_ASSIGNED")
    )
    now = F.when(F.col("step") >= F.col("at"), F.when(F.col("by") == "REJECT", F.lit(None)).when(F.col("by") == "REMAP", F.col("to")).otherwise(F.col("original"))).otherwise(F.col("original"))
    status = F.when(F.col("found").isNull(), F.lit(None)).when(F.col("step") >= F.col("at"), "RESOLVED").when(F.col("step") >= F.col("skip"), "SKIPPED").otherwise("PENDING")
    return all_of.select("assessment_id", "event_id", "answer_id", "action", "target", F.col("step").cast("long").alias("step"), outcome.alias("outcome"), status.alias("status"), F.when(F.col("found"), now).alias("final_question_id"))


def review_states(reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Reviews with the last applied action: (keys, status, action, target)."""
    last = outcomes.where("outcome = 'APPLIED'").groupBy(*KEY).agg(F.max_by(F.struct("status", "action", "target", "final_question_id"), "step").alias("d"))
    return reviews.join(last, KEY, "left").select(*KEY, "original_question_id", F.coalesce("d.status", F.lit("PENDING")).alias("status"), F.col("d.action").alias("action"), F.col("d.target").alias("target"))


def simple_review_states(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Same with remaps taken as they come: the first settling action wins, a skip before it is forgotten. All native."""
    settle = F.col("action") != "SKIP"
    first = actions.where(settle).groupBy(*KEY).agg(F.min_by(F.struct("action", "target"), F.struct("ts", "event_id")).alias("settled"))
    skips = actions.where(~settle).groupBy(*KEY).agg(F.count("*").alias("skips"))
    joined = reviews.join(first, KEY, "left").join(skips, KEY, "left")
    status = F.when(F.col("settled").isNotNull(), "RESOLVED").when(F.col("skips") > 0, "SKIPPED").otherwise("PENDING")
    return joined.select(*KEY, status.alias("status"), F.coalesce("settled.action", F.when(F.col("skips") > 0, "SKIP")).alias("action"), F.when(F.col("settled.action") == "REMAP", F.col("settled.target")).alias("target"))


def effective_mappings(mappings: DataFrame, states: DataFrame) -> DataFrame:
    """What holds: the reviewer's decision if there is one (but for a skip), else the matcher's. Human rows have no confidence."""
    d = states.select(*KEY, F.col("action").alias("decided"), F.col("target").alias("to"))
    joined = mappings.join(d, KEY, "left")
    human = F.coalesce(F.col("decided").isin("ACCEPT", "REJECT", "REMAP"), F.lit(False))
    question = F.when(F.col("decided") == "REJECT", F.lit(None).cast("long")).when(F.col("decided") == "REMAP", F.col("to")).otherwise(F.col("question_id"))
    return joined.select(*KEY, question.alias("question_id"), F.when(human, "HUMAN").otherwise("AI").alias("source"), F.when(~human, F.col("confidence")).alias("confidence"), F.when(F.col("decided").isNotNull(), "HUMAN").otherwise("AI").alias("mapping_source"))


def remap_conflicts(effective: DataFrame) -> DataFrame:
    """(assessment_id, question_id, answer_id, other_answer_id): questions in effect for more than one answer."""
    held = effective.where("question_id is not null").select("assessment_id", "question_id", "answer_id")
    return held.join(held.withColumnRenamed("answer_id", "other_answer_id"), ["assessment_id", "question_id"]).where("answer_id != other_answer_id")


def illegal_transitions(log: DataFrame, entity: str, allowed=REVIEW_TRANSITIONS, start: str | None = None) -> DataFrame:
    """Steps of a status log (entity, ts, event_id, status) that are not among the allowed ones."""
    pairs = log.sparkSession.createDataFrame(list(allowed), "before string, status string")
    before = F.lag("status").over(Window.partitionBy(entity).orderBy("ts", "event_id"))
    steps = log.withColumn("before", F.coalesce(before, F.lit(start)) if start else before).where("before is not null and before != status")
    return steps.join(F.broadcast(pairs), ["before", "status"], "left_anti").select(entity, "event_id", "before", "status")


def audit_events(outcomes: DataFrame, reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per applied action: question before and after, and the trimmed reason. Actions with over-long reasons have
    not been applied."""
    applied = outcomes.where("outcome = 'APPLIED'").select("assessment_id", "answer_id", "event_id", "action", "final_question_id")
    reasons = actions.select("event_id", normal_reason(F.col("reason")).alias("reason"))
    return applied.join(reasons, "event_id").join(reviews.select(*KEY, "original_question_id"), KEY)


def review_summary(mappings: DataFrame, states: DataFrame, effective: DataFrame) -> DataFrame:
    """Counts per assessment over mappings, reviews and what is in effect."""
    a = mappings.groupBy("assessment_id").agg(F.count("*").alias("answers"), F.count("question_id").alias("ai_mapped"))
    r = states.groupBy("assessment_id").agg(*(F.count_if(F.col("status") == x).alias(x.lower()) for x in ("PENDING", "SKIPPED", "RESOLVED")), *(F.count_if(F.col("action") == x).alias(x.lower()) for x in ("ACCEPT", "REMAP", "REJECT")))
    e = effective.groupBy("assessment_id").agg(F.count("question_id").alias("effective_mapped"), F.count_if(F.col("source") == "HUMAN").alias("human"), F.count_if(F.col("question_id").isNull()).alias("effective_unmapped"))
    return a.join(r, "assessment_id", "left").join(e, "assessment_id", "left").na.fill(0)


def mapping_layers(mappings: DataFrame, states: DataFrame, effective: DataFrame) -> DataFrame:
    """One row per mapping with its three layers side by side: what the matcher said (ai_), what a reviewer decided
    (human_, null where nobody looked at it), and what holds (effective_)."""
    ai = mappings.select(*KEY, F.col("question_id").alias("ai_question_id"), F.col("confidence").alias("ai_confidence"), F.col("band").alias("ai_band"), F.col("reasons").alias("ai_reasons"))
    human = states.select(*KEY, F.col("status").alias("human_status"), F.col("action").alias("human_action"), F.col("target").alias("human_question_id"))
    held = effective.select(*KEY, F.col("question_id").alias("effective_question_id"), F.col("source").alias("effective_source"))
    return ai.join(human, KEY, "left").join(held, KEY, "left")


def review_candidates(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """(keys, candidates): the shortlist of each answer (top_k at most) in rank order, with label and text of the questions."""
    q = questions.select("assessment_id", "question_id", "label_raw", F.col("text").alias("question_text"))
    listed = candidates.join(q, ["assessment_id", "question_id"], "left")
    return listed.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "question_id", "label_raw", "question_text", "candidate_score", "confidence"))).alias("candidates"))


def review_items(states: DataFrame, mappings: DataFrame, effective: DataFrame, answers: DataFrame, questions: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Wide view in the order to work on: pending, in review, skipped, the rest.

    states may bring the review's own snapshot (trigger, original_question_id, original_confidence), which stays;
    candidates: ranked rows (keys, question_id, rank, candidate_score, confidence) to list with their questions.
    """
    e = effective.select(*KEY, F.col("question_id").alias("effective_question_id"), "source")
    q = questions.select("assessment_id", F.col("question_id").alias("effective_question_id"), "label_raw")
    own = answers.select(*KEY, "claimed_label_raw", *(F.col(c).alias(f"answer_{c}") for c in ("text", "page") if c in answers.columns))
    wide = states.join(mappings.select(*KEY, "confidence", "band"), KEY, "left").join(e, KEY, "left").join(own, KEY, "left").join(q, ["assessment_id", "effective_question_id"], "left")
    if candidates is not None:
        wide = wide.join(review_candidates(candidates, questions), KEY, "left")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col("status")), F.lit(0))
    return wide.withColumn("place", F.when(rank > 0, rank).otherwise(len(ORDER) + 1).cast("int"))
