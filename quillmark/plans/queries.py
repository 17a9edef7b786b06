"""The registered queries of the matching and scoring jobs, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import labels as lb
from ..functions import signals as s
from ..operators import candidates as cd
from ..operators import decide as dc
from ..operators import labels as lo
from ..operators import matching as mt
from ..sources import fixtures as fx
from ..sources.scratch import discard, stash
from .oracle import roman_int, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, **parts: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, **parts)
        return f

    return add


# -- shared steps -------------------------------------------------------------------------------------------------
def resolved(spark: SparkSession, d: str) -> DataFrame:
    return lo.resolve_orphans(fx.questions(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return cd.score_pairs(fx.answers(spark, d), resolved(spark, d), fx.embeddings(spark, d), dealt=fx.dealing(spark, d))


def top3(spark: SparkSession, d: str, **how: bool) -> DataFrame:
    return cd.best_candidates(fx.answers(spark, d), resolved(spark, d), fx.embeddings(spark, d), dealt=fx.dealing(spark, d), **how)


#: What verdicts and ranking again read of a shortlist.
SHORT = ["assessment_id", "answer_id", "question_id", "rank", "label_kind", "label", "candidate_score"]


def shortlist(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Used several times by what follows, so written once, with the columns that are needed, and dealt like the base."""
    dealt = fx.dealing(spark, d)
    best = top3(spark, d, together=dealt is not None)
    out = stash(best.select(*SHORT, *more), dealt)
    for tiles in best._tiles:
        discard(tiles)
    return out


def verdicts_of(spark: SparkSession, d: str, top: DataFrame) -> DataFrame:
    return dc.guard_verdicts(fx.verdicts(spark, d), top, dc.decisive_gate(top).where("not decisive"))


def ranked(spark: SparkSession, d: str, *columns: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The shortlist (with more of its columns) ranked again, or some columns of that; the shortlist itself goes."""
    top = shortlist(spark, d, *more)
    again = dc.final_confidence(top, verdicts_of(spark, d, top))
    out = stash(again.select(*(columns or again.columns)), fx.dealing(spark, d))
    discard(top)
    return out


def edges_of(again: DataFrame) -> DataFrame:
    return again.where(F.col("confidence") >= DEFAULT.min_assignment).select("assessment_id", "answer_id", "question_id", "confidence")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(ranked(spark, d, "assessment_id", "answer_id", "question_id", "confidence"))


def assigned(spark: SparkSession, d: str, chosen: DataFrame) -> DataFrame:
    return mt.assign_one_to_one(chosen, dealt=fx.dealing(spark, d))


def ranked_and_mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    again = ranked(spark, d, more=("semantic", "position", "structure"))
    maps = dc.build_mappings(fx.answers(spark, d), again, assigned(spark, d, edges_of(again)), dc.decisive_gate(again))
    return again, stash(maps, fx.dealing(spark, d))


def mappings(spark: SparkSession, d: str) -> DataFrame:
    again, maps = ranked_and_mapped(spark, d)
    discard(again)
    return maps


# -- labels -------------------------------------------------------------------------------------------------------
@query("SELECT question_id, label_raw, major, minor, roman, normalized_label, parent_label, is_sub, is_orphan FROM q_res")
def label_questions(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("question_id", "label_raw", "major", "minor", "roman", "normalized_label", "parent_label", "is_sub", "is_orphan")


@query("SELECT answer_id, claimed_label_raw, p_major AS major, p_minor AS minor, p_roman AS roman, p_norm AS normalized, p_sub AS is_sub, p_orphan AS is_orphan FROM a_parsed")
def label_claims(spark: SparkSession, d: str) -> DataFrame:
    p = fx.answers(spark, d).select("answer_id", "claimed_label_raw", lb.parse_label(F.col("claimed_label_raw")).alias("p"))
    return p.select("answer_id", "claimed_label_raw", "p.major", "p.minor", "p.roman", "p.normalized", F.coalesce("p.is_sub", F.lit(False)).alias("is_sub"), F.coalesce("p.is_orphan", F.lit(False)).alias("is_orphan"))


@query("SELECT question_id, CAST(question_at AS INTEGER) AS question_at, question_count FROM q_at")
def label_order(spark: SparkSession, d: str) -> DataFrame:
    return lo.with_question_index(resolved(spark, d)).select("question_id", "question_at", "question_count")


@query(
    "SELECT question_id, coalesce(last_value(nullif(regexp_extract(label_raw, '([0-9]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY assessment_id ORDER BY question_at ROWS UNBOUNDED PRECEDING), CAST(question_at + 1 AS VARCHAR)) AS display_number FROM q_at"
)
def label_display_numbers(spark: SparkSession, d: str) -> DataFrame:
    return lo.display_numbers(resolved(spark, d)).select("question_id", "display_number")


@query(f"SELECT part AS token, n, is_roman, CASE WHEN is_roman THEN v END AS value FROM (SELECT part, count(*) AS n, any_value((length(part) > 0 AND regexp_matches(part, '{lb.ROMAN}'))) AS is_roman, any_value(value_of) AS v FROM tokens GROUP BY part)",
       tokens="SELECT part, {} AS value_of FROM (SELECT regexp_replace(lower(w), '[^ivxlcdm]', '', 'g') AS part FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT unnest(['i', 'iv', 'ix', 'xii', 'ib', '', 'mcm', 'iiii'])))".replace("{}", roman_int("part")))
def label_roman_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = fx.frames(spark, d, "part")["part"].select(F.explode(F.split("p_name", " ")).alias("w")).unionAll(spark.range(1).select(F.explode(F.array(*map(F.lit, ("i", "iv", "ix", "xii", "ib", "", "mcm", "iiii"))))))
    tokens = words.groupBy(F.regexp_replace(F.lower("w"), "[^ivxlcdm]", "").alias("token")).agg(F.count("*").alias("n"))
    return tokens.select("token", "n", lb.is_roman(F.col("token")).alias("is_roman"), F.when(lb.is_roman(F.col("token")), lb.roman_to_int(F.col("token"))).alias("value"))


@query(
    "SELECT q.question_id, CASE WHEN q.is_sub AND p.t IS NOT NULL THEN p.t || chr(10) || q.text ELSE q.text END AS embedding_text FROM q_res q LEFT JOIN (SELECT assessment_id, CAST(major AS VARCHAR) AS pl, arg_min(text, row(page, y, question_id)) AS t FROM q_res WHERE NOT is_sub GROUP BY 1, 2) p ON q.assessment_id = p.assessment_id AND q.parent_label = p.pl"
)
def label_embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return lo.embedding_texts(resolved(spark, d)).select("question_id", "embedding_text")


@query("SELECT answer_id, trim(text) AS embedding_text FROM fx_a")
def label_answer_texts(spark: SparkSession, d: str) -> DataFrame:
    return fx.answers(spark, d).select("answer_id", s.answer_embedding_text(F.col("text")).alias("embedding_text"))


# -- candidates ---------------------------------------------------------------------------------------------------
@query("SELECT * FROM pairs")
def link_score_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)


@query("SELECT assessment_id, answer_id, question_id, rank, candidate_score FROM top3")
def link_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    return top3(spark, d).select("assessment_id", "answer_id", "question_id", "rank", "candidate_score")


@query("SELECT assessment_id, answer_id, question_id, rank, candidate_score FROM top3")
def link_tiled_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The same by the plan for large assessments, with tiles so small that most assessments have several."""
    best = cd.best_candidates(fx.answers(spark, d), resolved(spark, d), fx.embeddings(spark, d), side=2, dealt=fx.dealing(spark, d))
    return best.select("assessment_id", "answer_id", "question_id", "rank", "candidate_score")


@query("SELECT assessment_id, CAST(count_if(candidate_score >= 0.9) AS BIGINT) AS high, CAST(count_if(candidate_score >= 0.7 AND candidate_score < 0.9) AS BIGINT) AS medium, CAST(count_if(candidate_score < 0.7) AS BIGINT) AS low FROM top3 WHERE rank = 1 GROUP BY 1")
def link_band_counts(spark: SparkSession, d: str) -> DataFrame:
    return dc.band_counts(top3(spark, d))


@query("SELECT answer_id, CAST(answer_at AS INTEGER) AS answer_at, answer_count FROM a_at")
def link_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return cd.reading_order(fx.answers(spark, d)).select("answer_id", "answer_at", "answer_count")


TEXT_KEY = "sha256('hashed:64:' || regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'))"


@query(f"SELECT {TEXT_KEY} AS embedding_key, min(text) AS text, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def link_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return cd.distinct_texts(fx.frames(spark, d, "conversations")["conversations"].where("text is not null"), "text")


HASHED = """SELECT id, list(x ORDER BY b) AS v FROM (SELECT ids.id, bs.b, 0.05 + coalesce(n, 0) AS x FROM ids CROSS JOIN (SELECT unnest(range(64)) AS b) bs LEFT JOIN
  (SELECT id, CAST(('0x' || substr(sha256(w), 1, 8)) AS BIGINT) % 64 AS b, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS w FROM ids) WHERE length(w) > 2 GROUP BY 1, 2) c ON ids.id = c.id AND bs.b = c.b) GROUP BY id"""


@query(
    "SELECT d.id AS doc_id, arg_max(i.id, row(round(list_dot_product(d.v, i.v) / sqrt(list_dot_product(d.v, d.v)) / sqrt(list_dot_product(i.v, i.v)), 6), -i.id)) AS item_id, max(round(list_dot_product(d.v, i.v) / sqrt(list_dot_product(d.v, d.v)) / sqrt(list_dot_product(i.v, i.v)), 6)) AS cosine FROM dv d, iv i GROUP BY 1",
    dv=HASHED.replace("FROM ids CROSS", "FROM dids CROSS").replace("FROM ids)", "FROM dids)").replace("ids.", "dids.").replace("ddids", "dids"),
    iv=HASHED.replace("FROM ids CROSS", "FROM iids CROSS").replace("FROM ids)", "FROM iids)").replace("ids.", "iids.").replace("iiids", "iids"),
    dids="SELECT doc_id AS id, text FROM documents",
    iids="SELECT item_id AS id, text FROM benchmark",
)
def link_hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    t = fx.frames(spark, d, "documents", "benchmark")
    return cd.best_items(t["documents"], t["benchmark"], "doc_id", "item_id")


@query("SELECT id AS item_id, array_to_string([printf('%.6f', x / sqrt(list_dot_product(v, v))) FOR x IN v], ',') AS vector FROM iv", iv=HASHED.replace("FROM ids CROSS", "FROM iids CROSS").replace("FROM ids)", "FROM iids)").replace("ids.", "iids.").replace("iiids", "iids"), iids="SELECT item_id AS id, text FROM benchmark")
def link_item_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = cd.hashed_vectors(fx.frames(spark, d, "benchmark")["benchmark"], "item_id", "text")
    return v.select("item_id", F.array_join(F.transform("vector", lambda x: F.format_string("%.6f", x)), ",").alias("vector"))


@query("SELECT a.vec_id, round(CASE WHEN a.vec_id % 7 = 0 THEN 0 ELSE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) END, 6) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def link_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector and the next one; every seventh is taken as zero."""
    v = fx.embeddings(spark, d)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    own = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return v.join(after, "vec_id").select("vec_id", F.round(s.cosine_similarity(own, F.col("next")), 6).alias("cosine"))


# -- decisions ----------------------------------------------------------------------------------------------------
@query("SELECT * FROM gate")
def decide_gate(spark: SparkSession, d: str) -> DataFrame:
    return dc.decisive_gate(top3(spark, d))


@query(
    "SELECT t.assessment_id, t.answer_id, count(*) AS n, string_agg(CAST(t.question_id AS VARCHAR) || '=' || q.label_raw || '/' || coalesce(q.parent_label, ''), ';' ORDER BY t.rank) AS shortlist, any_value(a.claimed_label_raw) AS claim FROM top3 t JOIN gate g ON t.assessment_id = g.assessment_id AND t.answer_id = g.answer_id AND NOT g.decisive JOIN q_res q ON q.question_id = t.question_id JOIN fx_a a ON a.answer_id = t.answer_id GROUP BY 1, 2"
)
def decide_requests(spark: SparkSession, d: str) -> DataFrame:
    r = dc.build_verdict_requests(shortlist(spark, d), fx.answers(spark, d), resolved(spark, d))
    listed = F.array_join(F.transform("shortlist", lambda x: F.concat(x["question_id"].cast("string"), F.lit("="), x["label_raw"], F.lit("/"), F.coalesce(x["parent_label"], F.lit("")))), ";")
    return stash(r.select("assessment_id", "answer_id", F.size("shortlist").cast("long").alias("n"), listed.alias("shortlist"), F.col("claimed_label_raw").alias("claim")), fx.dealing(spark, d))


@query("SELECT * FROM guarded")
def decide_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return stash(verdicts_of(spark, d, shortlist(spark, d)), fx.dealing(spark, d))


@query("SELECT assessment_id, answer_id, question_id, consulted, selected, llm_confidence, confidence, final_rank FROM ranked")
def decide_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, "assessment_id", "answer_id", "question_id", "consulted", "selected", "llm_confidence", "confidence", "final_rank")


@query("SELECT assessment_id, round(sum(confidence), 6) AS total FROM assigned GROUP BY 1")
def decide_best_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the best assignment of every assessment with an edge."""
    return assigned(spark, d, edges(spark, d)).groupBy("assessment_id").agg(F.round(F.sum("confidence"), 6).alias("total"))


@query()
def decide_all_totals(spark: SparkSession, d: str) -> DataFrame:
    """The same without SQL; a test compares it with brute force."""
    return decide_best_totals(spark, d)


@query("SELECT * FROM assigned")
def decide_assignment(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d, edges(spark, d))


@query("SELECT e.assessment_id, answer_id, question_id, confidence FROM g_edges e JOIN g_steps s ON e.assessment_id = s.assessment_id AND e.k = s.k AND s.took")
def decide_greedy(spark: SparkSession, d: str) -> DataFrame:
    return mt.greedy_assignment(edges(spark, d))


@query("SELECT * FROM mutual")
def decide_mutual_best(spark: SparkSession, d: str) -> DataFrame:
    return mt.mutual_best(edges(spark, d))


@query("SELECT h.assessment_id, h.answer_id FROM assigned h JOIN facts f ON h.assessment_id = f.assessment_id AND h.answer_id = f.answer_id WHERE h.question_id <> f.best")
def decide_contested(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d, "assessment_id", "answer_id", "question_id", "confidence", "final_rank")
    return stash(dc.contested_answers(r, assigned(spark, d, edges_of(r))), fx.dealing(spark, d), bucketed=False)


@query("SELECT * FROM maps")
def decide_mappings(spark: SparkSession, d: str) -> DataFrame:
    return mappings(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT q.assessment_id, q.question_id FROM fx_q q WHERE NOT EXISTS (SELECT 1 FROM maps m WHERE m.question_id = q.question_id)")
def decide_unmapped_questions(spark: SparkSession, d: str) -> DataFrame:
    return stash(dc.unmapped_questions(fx.questions(spark, d), mappings(spark, d)), fx.dealing(spark, d))


@query("SELECT assessment_id, answer_id FROM maps WHERE question_id IS NULL")
def decide_unmapped_answers(spark: SparkSession, d: str) -> DataFrame:
    return dc.unmapped_answers(mappings(spark, d))


@query("SELECT assessment_id, count(*) AS answers, CAST(count_if(status = 'AUTO_MAPPED') AS BIGINT) AS auto_mapped, CAST(count_if(status = 'REVIEW_REQUIRED') AS BIGINT) AS review_required, CAST(count_if(status = 'HUMAN_REVIEW') AS BIGINT) AS human_review, CAST(count_if(status = 'UNMAPPED') AS BIGINT) AS unmapped, CAST(count_if(consulted) AS BIGINT) AS consulted FROM maps GROUP BY 1")
def decide_summary(spark: SparkSession, d: str) -> DataFrame:
    return dc.mapping_run_summary(mappings(spark, d))


RUN = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in {"weight_label": DEFAULT.weight_label, "weight_semantic": DEFAULT.weight_semantic, "weight_position": DEFAULT.weight_position, "weight_structure": DEFAULT.weight_structure, "weight_llm": DEFAULT.weight_verdict, "threshold_high": DEFAULT.band_high, "threshold_medium": DEFAULT.band_medium, "threshold_minimum": DEFAULT.min_assignment}.items())


@query(
    f"SELECT m.assessment_id, answers, auto_mapped, review_required, human_review, unmapped, consulted, coalesce(questions, 0) AS questions, coalesce(embeddings, 0) AS embeddings, CAST({DEFAULT.top_k} AS INTEGER) AS top_k, {RUN} FROM ({ORACLES['decide_summary'].rsplit(chr(10), 1)[-1]}) m LEFT JOIN (SELECT assessment_id, count(*) AS questions FROM fx_q GROUP BY 1) q ON q.assessment_id = m.assessment_id LEFT JOIN (SELECT assessment_id, count(DISTINCT {TEXT_KEY}) AS embeddings FROM (SELECT assessment_id, embedding_text AS text FROM q_texts UNION ALL SELECT assessment_id, text FROM fx_a) GROUP BY 1) t ON t.assessment_id = m.assessment_id",
    q_texts=ORACLES["label_embedding_texts"].rsplit(chr(10), 1)[-1].replace("SELECT q.question_id", "SELECT q.assessment_id, q.question_id", 1),
)
def decide_run_report(spark: SparkSession, d: str) -> DataFrame:
    """The summary of a run with its embedded texts and parameters."""
    asked = resolved(spark, d)
    key = s.embedding_key(F.col("embedding_text"), "hashed", 64).alias("embedding_key")
    texts = lo.embedding_texts(asked).select("assessment_id", key).unionAll(fx.answers(spark, d).select("assessment_id", s.answer_embedding_text(F.col("text")).alias("embedding_text")).select("assessment_id", key))
    return stash(dc.mapping_run_report(mappings(spark, d), asked, texts), fx.dealing(spark, d))
