"""Signals that tie an answer to a question, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from .geometry import unit

NEUTRAL, TOLERANCE = 0.5, 1e-6
# Scores of label comparisons, wordings that ask for a drawing, characters of writing for one mark.
LABEL_SCORES = {
    "EXACT_NORMALIZED_LABEL": 1.0,
    "EXACT_PARENT_AND_SUBQUESTION": 1.0,
    "PARENT_MATCH_SUBPART_MATCH": 0.95,
    "PARENT_ONLY": 0.6,
    "SUBPART_ONLY": 0.45,
    "NO_LABEL": 0.5,
    "CONFLICTING_LABEL": 0.0,
}
ASKS_DIAGRAM = r"(?i)\b(draw|sketch|diagram|label(led|led diagram)?|illustrate|plot)\b"
GRADING_ASKS_DIAGRAM = r"(?i)\b(draw|sketch|diagram|illustrate|plot)\b"
SUB_SPELLING = r"(?i)\(?[a-z]\)|\((i|ii|iii|iv|v|vi|vii|viii|ix|x)\)"
CHARS_PER_MARK = 90


def round6(c: Column) -> Column:
    """Six decimals; what stands within 1e-12 of half a unit goes up, so that engines agree on ties."""
    return F.floor(c * 1e6 + 0.500001) / 1e6


def decimals6(c: Column) -> Column:
    """F.round(c, 6) of numbers from 0 to 1; only what stands near half a unit is rounded as a decimal number."""
    scaled = c * 1e6
    off = F.abs(scaled - F.floor(scaled) - 0.5)
    return F.when((off >= 1e-4) & (off <= 1), F.floor(scaled + 0.5) / 1e6).otherwise(F.round(c, 6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is zero; vectors of different length are an error."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    said = F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(F.size(a) != F.size(b), said).when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def absolute_semantic(cosine: Column, floor: float) -> Column:
    return unit(cosine) if floor >= 1 else unit((cosine - floor) / (1 - floor))


def relative_semantic(cosine: Column, low: Column, high: Column) -> Column:
    """Standing among one answer's cosines, from 0.2 to 0.8; neutral if they do not differ."""
    spread = high - low
    return F.when(spread < TOLERANCE, NEUTRAL).otherwise(0.2 + unit((cosine - low) / spread) * 0.6)


def semantic_score(cosine: Column, low: Column, high: Column, floor: float) -> Column:
    return unit(0.7 * absolute_semantic(cosine, floor) + 0.3 * relative_semantic(cosine, low, high))


def label_match_kind(claimed: Column, parsed: Column, claim_key: Column, key: Column, major: Column, sub: Column, is_sub: Column) -> Column:
    """Outcome of comparing a claim (raw, parsed, canonical) with a question's key, number and sub-part."""
    own_sub = F.coalesce(parsed["minor"], parsed["roman"])
    return (
        F.when(claimed.isNull() | (claimed == ""), "NO_LABEL")
        .when(claim_key == key, F.when(is_sub, "EXACT_PARENT_AND_SUBQUESTION").otherwise("EXACT_NORMALIZED_LABEL"))
        .when(parsed["is_orphan"], F.when(own_sub == sub, "SUBPART_ONLY").otherwise("CONFLICTING_LABEL"))
        .when(
            (parsed["major"] > 0) & (parsed["major"] == major),
            F.when(own_sub.isNotNull() & sub.isNotNull(), F.when(own_sub == sub, "PARENT_MATCH_SUBPART_MATCH").otherwise("CONFLICTING_LABEL")).otherwise("PARENT_ONLY"),
        )
        .otherwise("CONFLICTING_LABEL")
    )


def label_score(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, score in LABEL_SCORES.items():
        out = F.when(kind == name, score).otherwise(out)
    return out


def position_score(answer_at: Column, answers: Column, question_at: Column, questions: Column) -> Column:
    """Agreement of relative ranks, from 0.25 to 0.75; neutral where either side has one item."""
    apart = F.abs(answer_at / F.greatest(answers - 1, F.lit(1)) - question_at / F.greatest(questions - 1, F.lit(1)))
    return F.when((answers <= 1) | (questions <= 1), NEUTRAL).otherwise(unit(NEUTRAL + (1 - apart - NEUTRAL) * 0.5))


def diagram_compatibility(asked: Column, drawn: Column) -> Column:
    return F.when(asked & drawn, 0.9).when(asked, 0.35).otherwise(NEUTRAL)


def length_compatibility(length: Column, marks: Column) -> Column:
    expected = marks * CHARS_PER_MARK
    ratio = F.when(length > expected, expected / length).otherwise(length / expected)
    return F.when(marks.isNull() | (marks <= 0) | (length == 0), NEUTRAL).otherwise(unit(0.35 + ratio * 0.55))


def subquestion_compatibility(claims_sub: Column, is_sub: Column) -> Column:
    """claims_sub: whether the claim is spelled like a sub-part (SUB_SPELLING); null without a claim."""
    return F.when(claims_sub.isNull(), NEUTRAL).when(claims_sub == is_sub, 0.75).otherwise(0.4)


def structure_score(*parts: Column) -> Column:
    return unit(sum(parts[1:], parts[0]) / len(parts))


def candidate_score(label: Column, semantic: Column, position: Column, structure: Column, c: Config) -> Column:
    """Weighted mean of the signals that say something; those at neutral abstain, and if all do the score is neutral."""
    speaks = lambda s: F.abs(s - NEUTRAL) >= TOLERANCE
    pairs = [(c.weight_label, label), (c.weight_semantic, semantic), (c.weight_position, position), (c.weight_structure, structure)]
    total = sum(F.when(speaks(s), w * s).otherwise(0.0) for w, s in pairs)
    weight = sum(F.when(speaks(s), w).otherwise(0.0) for w, s in pairs)
    return unit(F.coalesce(F.try_divide(total, weight), F.lit(NEUTRAL)))


def confidence_band(score: Column, c: Config) -> Column:
    return F.when(score >= c.band_high, "HIGH").when(score >= c.band_medium, "MEDIUM").otherwise("LOW")


def status_for_band(band: Column) -> Column:
    return F.when(band == "HIGH", "AUTO_MAPPED").when(band == "MEDIUM", "REVIEW_REQUIRED").otherwise("HUMAN_REVIEW")


def text_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def answer_embedding_text(text: Column) -> Column:
    """What is embedded of an answer: its text without white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def embedding_key(text: Column, model: str, dims: int) -> Column:
    """Hash under which a text is embedded once: lower case, white space folded."""
    folded = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")
    return F.sha2(F.concat(F.lit(f"{model}:{dims}:"), folded), 256)
