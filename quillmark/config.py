"""Parameters of all jobs, and the checks they must pass."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of the matching, merging and scoring jobs."""

    top_k: int = 3
    weight_label: float = 0.45
    weight_semantic: float = 0.35
    weight_position: float = 0.10
    weight_structure: float = 0.10
    weight_verdict: float = 0.30
    label_conflict_penalty: float = 0.25
    semantic_floor: float = 0.65
    band_high: float = 0.90
    band_medium: float = 0.70
    min_assignment: float = 0.35
    decisive_score: float = 0.60
    decisive_margin: float = 0.35
    answer_chunk_pages: int = 4
    answer_chunk_overlap: int = 1
    question_chunk_pages: int = 20
    question_chunk_overlap: int = 1
    grade_weight_rubric: float = 0.30
    grade_weight_transcription: float = 0.25
    grade_weight_model: float = 0.30
    grade_weight_criterion: float = 0.15
    grade_threshold: float = 0.75
    granularity: str = "WHOLE"
    state_ttl_seconds: int = 86_400
    max_bytes: int = 10 * 1024 * 1024
    max_pages: int = 50
    max_dimension: int = 2000
    token_budget: int = 8000

    def __post_init__(self) -> None:
        problems = check_config(self)
        if problems:
            raise ValueError("; ".join(problems))


def check_config(c: Config) -> list[str]:
    """What is wrong with the parameters; empty if nothing."""
    mapping = c.weight_label + c.weight_semantic + c.weight_position + c.weight_structure
    grading = c.grade_weight_rubric + c.grade_weight_transcription + c.grade_weight_model + c.grade_weight_criterion
    rules = (
        (abs(mapping - 1) <= 1e-6, f"mapping weights sum to {mapping:g}, not 1"),
        (abs(grading - 1) <= 1e-6, f"grading weights sum to {grading:g}, not 1"),
        (c.band_medium < c.band_high, "the medium band must start below the high one"),
        (c.answer_chunk_overlap < c.answer_chunk_pages, "answer chunks overlap by all their pages"),
        (c.question_chunk_overlap < c.question_chunk_pages, "question chunks overlap by all their pages"),
        (c.granularity in ("WHOLE", "HALF"), f"unknown granularity {c.granularity}"),
    )
    return [said for good, said in rules if not good]


DEFAULT = Config()
