"""The queries again as DuckDB SQL: named parts, put together as far as a final SELECT refers to them."""

from __future__ import annotations

import re

from ..functions.labels import NOISE, ROMAN
from ..operators.matching import MICRO, TIE_PRIME, TIE_RANGE
from ..sources import fixtures as fx

Q = "'"


def roman(t: str) -> str:
    return f"(length({t}) > 0 AND regexp_matches(lower({t}), '{ROMAN}'))"


def parsed(source: str, column: str) -> str:
    """SELECT of all columns of source and p_major, p_minor, p_roman, p_sub, p_orphan, p_norm of a label column."""
    bare = f"regexp_replace(lower(regexp_replace({column}, '^\\s+|\\s+$', '', 'g')), '{NOISE}', '')"
    return f"""
SELECT * EXCLUDE (tk, k, af, lone), CASE WHEN {column} IS NULL THEN NULL WHEN p_major = 0 AND p_minor IS NULL AND p_roman IS NULL
  THEN coalesce(nullif(regexp_replace(lower({column}), '[^a-z0-9]+', '', 'g'), ''), 'unlabelled')
  ELSE concat_ws('-', CASE WHEN p_major > 0 THEN CAST(p_major AS VARCHAR) END, p_minor, p_roman) END AS p_norm,
  p_minor IS NOT NULL OR p_roman IS NOT NULL AS p_sub
FROM (SELECT *, CASE WHEN {column} IS NULL THEN NULL WHEN k > 0 THEN coalesce(try_cast(tk[k] AS INTEGER), 0) ELSE 0 END AS p_major,
  coalesce([t FOR t IN af IF length(t) = 1 OR NOT {roman("t")}][1], CASE WHEN length(lone) = 1 THEN lone END) AS p_minor,
  coalesce([t FOR t IN af IF length(t) > 1 AND {roman("t")}][1], CASE WHEN length(lone) > 1 AND {roman("lone")} THEN lone END) AS p_roman,
  coalesce(length(lone) = 1 OR {roman("lone")}, false) AS p_orphan
  FROM (SELECT *, CASE WHEN k > 0 THEN [t FOR t IN tk[k + 1:] IF NOT regexp_matches(t, '^[0-9]+$')] ELSE CAST([] AS VARCHAR[]) END AS af, CASE WHEN k = 0 AND len(tk) = 1 THEN tk[1] END AS lone
    FROM (SELECT *, coalesce(list_position([regexp_matches(t, '^[0-9]+$') FOR t IN tk], true), 0) AS k
      FROM (SELECT *, regexp_extract_all({bare}, '[a-z]+|[0-9]+') AS tk FROM {source}) a) b) c) d"""


ROMAN_INT = "list_sum([CASE substr(r, CAST(i AS INTEGER), 1) {v} ELSE 0 END * CASE WHEN CASE substr(r, CAST(i AS INTEGER), 1) {v} ELSE 0 END < CASE substr(r, CAST(i AS INTEGER) + 1, 1) {v} ELSE 0 END THEN -1 ELSE 1 END FOR i IN range(1, length(r) + 1)])"
VALUES = "WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000"


def roman_int(r: str) -> str:
    return ROMAN_INT.replace("{v}", VALUES).replace("substr(r,", f"substr({r},").replace("length(r)", f"length({r})")


def clamp(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


ORDER = f"major, minor ASC NULLS FIRST, coalesce(roman_n, -1), label_raw, question_id"
COS = "list_sum([a * b FOR a, b IN list_zip(x, y)])"

PARTS: dict[str, str] = {
    "fx_base": fx.BASE.format(lineitem="lineitem", part="part"),
    "fx_q": fx.QUESTIONS.format(base="fx_base", embeddings="embeddings"),
    "fx_a": fx.ANSWERS.format(base="fx_base", embeddings="embeddings"),
    "fx_r": fx.READINGS.format(answers="fx_a"),
    "fx_v": fx.VERDICTS.format(base="fx_base"),
    "fx_rub": fx.RUBRICS.format(questions="fx_q"),
    "fx_act": fx.ACTIONS.format(events="events"),
    "fx_am": fx.ACTION_MAPPINGS.format(events="events"),
    "fx_st": fx.STAGES.format(events="events"),
    "fx_us": fx.USAGE.format(events="events"),
    "q_parsed": parsed("fx_q", "label_raw"),
    "a_parsed": parsed("fx_a", "claimed_label_raw"),
    "q_above": "SELECT *, coalesce(last_value(CASE WHEN p_major > 0 AND NOT p_orphan THEN p_major END IGNORE NULLS) OVER (PARTITION BY assessment_id ORDER BY page, y, question_id ROWS UNBOUNDED PRECEDING), 0) AS above FROM q_parsed",
    "q_res": f"""SELECT * EXCLUDE (p_major, p_minor, p_roman, p_norm, p_sub, p_orphan, above), CASE WHEN p_major > 0 THEN p_major ELSE above END AS major, p_minor AS minor, p_roman AS roman,
      CASE WHEN p_orphan AND above > 0 THEN concat_ws('-', CAST(above AS VARCHAR), p_minor, p_roman) ELSE p_norm END AS normalized_label,
      CASE WHEN p_orphan AND above > 0 THEN CAST(above AS VARCHAR) WHEN p_sub AND NOT p_orphan THEN CAST(p_major AS VARCHAR) END AS parent_label, p_sub AS is_sub, p_orphan AND above = 0 AS is_orphan,
      {roman_int("p_roman")} AS roman_n FROM q_above""",
    "q_at": f"SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY {ORDER}) - 1 AS question_at, count(*) OVER (PARTITION BY assessment_id) AS question_count FROM q_res",
    "a_at": "SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY page, y, x, text, answer_id) - 1 AS answer_at, count(*) OVER (PARTITION BY assessment_id) AS answer_count FROM a_parsed",
    "vec": "SELECT vec_id, CASE WHEN n > 0 THEN [v / n FOR v IN e] ELSE e END AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN embedding])) AS n FROM embeddings)",
    "vcos": "SELECT a.vec_id AS va, b.vec_id AS vb, coalesce(list_dot_product(a.v, b.v), 0) AS c FROM vec a, vec b",
    "pairs0": f"""SELECT a.assessment_id, a.answer_id, q.question_id,
      CASE WHEN claimed_label_raw IS NULL OR claimed_label_raw = '' THEN 'NO_LABEL'
        WHEN p_norm = normalized_label THEN CASE WHEN is_sub THEN 'EXACT_PARENT_AND_SUBQUESTION' ELSE 'EXACT_NORMALIZED_LABEL' END
        WHEN p_orphan THEN CASE WHEN coalesce(p_minor, p_roman) = coalesce(minor, roman) THEN 'SUBPART_ONLY' ELSE 'CONFLICTING_LABEL' END
        WHEN p_major > 0 AND p_major = major THEN CASE WHEN coalesce(p_minor, p_roman) IS NOT NULL AND coalesce(minor, roman) IS NOT NULL
          THEN CASE WHEN coalesce(p_minor, p_roman) = coalesce(minor, roman) THEN 'PARENT_MATCH_SUBPART_MATCH' ELSE 'CONFLICTING_LABEL' END ELSE 'PARENT_ONLY' END
        ELSE 'CONFLICTING_LABEL' END AS label_kind,
      round(coalesce(c, 0), 6) AS semantic_cosine,
      CASE WHEN answer_count <= 1 OR question_count <= 1 THEN 0.5 ELSE {clamp("0.5 + (1 - abs(CAST(answer_at AS DOUBLE) / (answer_count - 1) - CAST(question_at AS DOUBLE) / (question_count - 1)) - 0.5) * 0.5")} END AS position,
      (CASE WHEN asks AND diagram THEN 0.9 WHEN asks THEN 0.35 ELSE 0.5 END
       + CASE WHEN marks IS NULL OR marks <= 0 OR length(a.text) = 0 THEN 0.5 ELSE {clamp("0.35 + CAST(least(length(a.text), marks * 90) AS DOUBLE) / greatest(length(a.text), marks * 90) * 0.55")} END
       + CASE WHEN claimed_label_raw IS NULL THEN 0.5 WHEN regexp_matches(claimed_label_raw, '(?i)\\(?[a-z]\\)|\\((i|ii|iii|iv|v|vi|vii|viii|ix|x)\\)') = is_sub THEN 0.75 ELSE 0.4 END) / 3 AS structure
      FROM a_at a JOIN (SELECT *, regexp_matches(text, '(?i)\\b(draw|sketch|diagram|label(led|led diagram)?|illustrate|plot)\\b') AS asks FROM q_at) q ON a.assessment_id = q.assessment_id
      LEFT JOIN vcos ON va = a.vec_id AND vb = q.vec_id""",
    "pairs1": """SELECT *, CASE label_kind WHEN 'EXACT_NORMALIZED_LABEL' THEN 1.0 WHEN 'EXACT_PARENT_AND_SUBQUESTION' THEN 1.0 WHEN 'PARENT_MATCH_SUBPART_MATCH' THEN 0.95 WHEN 'PARENT_ONLY' THEN 0.6 WHEN 'SUBPART_ONLY' THEN 0.45 WHEN 'NO_LABEL' THEN 0.5 ELSE 0.0 END AS label,
      min(semantic_cosine) OVER (PARTITION BY assessment_id, answer_id) AS lo, max(semantic_cosine) OVER (PARTITION BY assessment_id, answer_id) AS hi FROM pairs0""",
    "pairs2": f"SELECT *, {clamp('0.7 * ' + clamp('(semantic_cosine - 0.65) / (1 - 0.65)') + ' + 0.3 * CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE 0.2 + ' + clamp('(semantic_cosine - lo) / (hi - lo)') + ' * 0.6 END')} AS semantic FROM pairs1",
    "pairs": """SELECT assessment_id, answer_id, question_id, label_kind, round(CAST(label AS DOUBLE), 6) AS label, semantic_cosine, round(semantic, 6) AS semantic, round(position, 6) AS position, round(structure, 6) AS structure,
      round(CASE WHEN w = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, s / w)) END, 6) AS candidate_score FROM (SELECT *,
        CAST(CASE WHEN abs(label - 0.5) >= 1e-6 THEN 0.45 * CAST(label AS DOUBLE) ELSE 0 END AS DOUBLE) + CASE WHEN abs(semantic - 0.5) >= 1e-6 THEN CAST(0.35 AS DOUBLE) * semantic ELSE 0 END + CASE WHEN abs(position - 0.5) >= 1e-6 THEN CAST(0.1 AS DOUBLE) * position ELSE 0 END + CASE WHEN abs(structure - 0.5) >= 1e-6 THEN CAST(0.1 AS DOUBLE) * structure ELSE 0 END AS s,
        CAST(CASE WHEN abs(label - 0.5) >= 1e-6 THEN 0.45 ELSE 0 END AS DOUBLE) + CASE WHEN abs(semantic - 0.5) >= 1e-6 THEN CAST(0.35 AS DOUBLE) ELSE 0 END + CASE WHEN abs(position - 0.5) >= 1e-6 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN abs(structure - 0.5) >= 1e-6 THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS w FROM pairs2)""",
    "top3": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY assessment_id, answer_id ORDER BY candidate_score DESC, label DESC, semantic DESC, question_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 3",
    "gate0": "SELECT assessment_id, answer_id, max(CASE WHEN rank = 1 THEN label_kind END) AS kind, max(CASE WHEN rank = 1 THEN candidate_score END) AS first, max(CASE WHEN rank = 2 THEN candidate_score END) AS second, max(CASE WHEN rank = 2 THEN label END) AS other FROM top3 GROUP BY 1, 2",
    "gate": "SELECT assessment_id, answer_id, kind IN ('EXACT_NORMALIZED_LABEL', 'EXACT_PARENT_AND_SUBQUESTION') AND first >= 0.6 AND coalesce(other, 0) = 0 AND round(first - coalesce(second, 0), 6) >= 0.35 AS decisive FROM gate0",
    "guarded": """SELECT v.assessment_id, v.answer_id, CASE WHEN v.decision = 'MATCH' AND t.question_id IS NOT NULL THEN 'MATCH' ELSE 'NO_MATCH' END AS decision,
      CASE WHEN v.decision = 'MATCH' AND t.question_id IS NOT NULL THEN v.question_id END AS chosen, CASE WHEN v.decision = 'MATCH' AND t.question_id IS NULL THEN 0.0 ELSE v.model_confidence END AS model_confidence,
      CASE WHEN v.decision = 'MATCH' AND t.question_id IS NULL THEN 'INVALID_CANDIDATE_ID' END AS reason_code
      FROM fx_v v JOIN gate g ON v.assessment_id = g.assessment_id AND v.answer_id = g.answer_id AND NOT g.decisive LEFT JOIN top3 t ON t.assessment_id = v.assessment_id AND t.answer_id = v.answer_id AND t.question_id = v.question_id""",
    "ranked0": """SELECT t.*, g.decision IS NOT NULL AS consulted, coalesce(g.chosen = t.question_id, false) AS selected, coalesce(g.decision = 'NO_MATCH', false) AS no_match, g.model_confidence AS llm_confidence,
      floor(least(1.0, greatest(0.0, (1 - CASE WHEN g.decision IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE 0 END) * candidate_score + CASE WHEN g.decision IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE 0 END * CASE WHEN coalesce(g.chosen = t.question_id, false) THEN least(1.0, greatest(0.0, g.model_confidence)) ELSE 0 END - CASE WHEN label_kind = 'CONFLICTING_LABEL' THEN CAST(0.25 AS DOUBLE) ELSE 0 END)) * 1e6 + 0.500001) / 1e6 AS confidence
      FROM top3 t LEFT JOIN guarded g ON t.assessment_id = g.assessment_id AND t.answer_id = g.answer_id""",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY assessment_id, answer_id ORDER BY confidence DESC, rank) AS INTEGER) AS final_rank FROM ranked0",
    "edges": "SELECT assessment_id, answer_id, question_id, confidence FROM ranked WHERE confidence >= 0.35",
    "mutual": "SELECT assessment_id, answer_id, question_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id, answer_id ORDER BY confidence DESC, question_id) AS ra, row_number() OVER (PARTITION BY assessment_id, question_id ORDER BY confidence DESC, answer_id) AS rq FROM edges) WHERE ra = 1 AND rq = 1",
    # best assignment by dynamic programming: one step an answer; a state is the set of taken questions that later answers want
    "m_edges": f"SELECT assessment_id, answer_id, question_id, confidence, CAST(round(confidence * {MICRO}) AS BIGINT) * {1 << 28} + (answer_id % {TIE_PRIME}) * (question_id % {TIE_PRIME}) % {TIE_PRIME} % {TIE_RANGE} AS w, CAST(1 AS BIGINT) << CAST(question_id - assessment_id * 1000003 - 1 AS INTEGER) AS bit FROM edges",
    "m_lefts": "SELECT *, coalesce(bit_or(bits) OVER (PARTITION BY assessment_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY answer_id) AS k FROM (SELECT assessment_id, answer_id, bit_or(bit) AS bits FROM m_edges GROUP BY 1, 2))",
    "m_opts": "SELECT l.assessment_id, k, later, question_id, bit, w FROM m_lefts l JOIN m_edges e ON l.assessment_id = e.assessment_id AND l.answer_id = e.answer_id UNION ALL SELECT assessment_id, k, later, NULL, 0, 0 FROM m_lefts",
    "m_paths": """SELECT DISTINCT assessment_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS path FROM m_lefts
      UNION ALL SELECT assessment_id, k, mask, max(total), arg_max(path, total) FROM (SELECT p.assessment_id, o.k, (p.mask | o.bit) & o.later AS mask, p.total + o.w AS total, list_append(p.path, o.question_id) AS path
        FROM m_paths p JOIN m_opts o ON o.assessment_id = p.assessment_id AND o.k = p.k + 1 WHERE p.mask & o.bit = 0) GROUP BY 1, 2, 3""",
    "m_last": "SELECT assessment_id, unnest(path) AS question_id, generate_subscripts(path, 1) AS k FROM m_paths WHERE (assessment_id, k) IN (SELECT assessment_id, max(k) FROM m_lefts GROUP BY 1)",
    "assigned": "SELECT e.assessment_id, e.answer_id, e.question_id, e.confidence FROM m_last p JOIN m_lefts l ON p.assessment_id = l.assessment_id AND p.k = l.k JOIN m_edges e ON e.assessment_id = l.assessment_id AND e.answer_id = l.answer_id AND e.question_id = p.question_id",
    "g_edges": "SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY confidence DESC, answer_id, question_id) AS k FROM edges",
    "g_steps": """SELECT DISTINCT assessment_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS lefts, CAST([] AS BIGINT[]) AS rights, false AS took FROM g_edges
      UNION ALL SELECT assessment_id, k, CASE WHEN free THEN list_append(lefts, answer_id) ELSE lefts END, CASE WHEN free THEN list_append(rights, question_id) ELSE rights END, free
        FROM (SELECT e.*, s.lefts, s.rights, NOT list_contains(s.lefts, e.answer_id) AND NOT list_contains(s.rights, e.question_id) AS free FROM g_steps s JOIN g_edges e ON e.assessment_id = s.assessment_id AND e.k = s.k + 1)""",
    "facts": "SELECT assessment_id, answer_id, bool_or(no_match) AS said_none, max(CASE WHEN final_rank = 1 THEN question_id END) AS best FROM ranked GROUP BY 1, 2",
    "maps0": """SELECT a.assessment_id, a.answer_id, r.question_id, r.confidence, r.label_kind, r.label, r.semantic, r.position, r.structure, r.consulted, r.selected, r.no_match, f.said_none, f.best, coalesce(g.decisive, false) AS decisive,
      CASE WHEN r.question_id IS NULL THEN 'LOW' WHEN r.confidence >= 0.9 THEN 'HIGH' WHEN r.confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS band
      FROM fx_a a LEFT JOIN (SELECT r.* FROM ranked r JOIN assigned m USING (assessment_id, answer_id, question_id)) r ON a.assessment_id = r.assessment_id AND a.answer_id = r.answer_id
      LEFT JOIN facts f ON a.assessment_id = f.assessment_id AND a.answer_id = f.answer_id LEFT JOIN gate g ON a.assessment_id = g.assessment_id AND a.answer_id = g.answer_id""",
    "maps": """SELECT assessment_id, answer_id, question_id, CASE WHEN question_id IS NULL THEN 'UNMAPPED' WHEN band = 'HIGH' THEN 'AUTO_MAPPED' WHEN band = 'MEDIUM' THEN 'REVIEW_REQUIRED' ELSE 'HUMAN_REVIEW' END AS status, coalesce(confidence, 0.0) AS confidence, band,
      CASE WHEN question_id IS NULL THEN CASE WHEN best IS NULL THEN 'NO_CANDIDATES' WHEN said_none THEN 'LLM_NO_MATCH' ELSE 'BELOW_ASSIGNMENT_THRESHOLD' END || ',NO_MATCH'
      ELSE concat_ws(',', CASE label_kind WHEN 'EXACT_NORMALIZED_LABEL' THEN 'DIRECT_LABEL_MATCH' WHEN 'EXACT_PARENT_AND_SUBQUESTION' THEN 'PARENT_SUBPART_MATCH' WHEN 'PARENT_MATCH_SUBPART_MATCH' THEN 'PARENT_SUBPART_MATCH' WHEN 'SUBPART_ONLY' THEN 'SUBPART_ONLY_MATCH' WHEN 'CONFLICTING_LABEL' THEN 'LABEL_CONFLICT' END,
        CASE WHEN semantic >= 0.7 AND label >= 0.9 THEN 'LABEL_AND_SEMANTIC_AGREE' WHEN semantic >= 0.7 THEN 'SEMANTIC_MATCH' END, CASE WHEN position >= 0.8 THEN 'POSITIONAL_SUPPORT' END, CASE WHEN structure >= 0.7 THEN 'STRUCTURAL_SUPPORT' END,
        CASE WHEN decisive THEN 'ADJUDICATION_UNNECESSARY' WHEN NOT consulted THEN 'LLM_UNAVAILABLE' WHEN no_match THEN 'LLM_NO_MATCH' WHEN selected THEN 'LLM_VERIFIED' ELSE 'LLM_SELECTED_ALTERNATIVE' END,
        CASE WHEN question_id <> best THEN 'CONFLICT_RESOLVED' END, CASE WHEN band = 'LOW' THEN 'LOW_CONFIDENCE' END) END AS reasons, coalesce(consulted, false) AS consulted FROM maps0""",
}


def sql(final: str, **more: str) -> str:
    """The final SELECT with every part that it refers to, in order; what is used more than once is computed once."""
    parts = {**PARTS, **more}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", text):
            if name in parts and name not in order and name not in pending:
                pending.append(name)
                need(parts[name])
                order.append(name)

    pending: list[str] = []
    need(final)
    used = " ".join([final, *(parts[n] for n in order)])
    often = {n for n in order if len(re.findall(rf"\b{n}\b", used)) > 1}
    recursive = {n for n in order if re.search(rf"\b{n}\b", parts[n])}
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in often - recursive else ''}({parts[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{final}" if order else final
