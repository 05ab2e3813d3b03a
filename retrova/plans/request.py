"""A search request: defaults, query profiles, validation, and the planner's candidate budgets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

PROFILES = ("latency", "balanced", "recall")
VECTOR_FIRST, TEXT_FIRST, BALANCED = "vector_first", "text_first", "balanced"
#: From this candidate_limit on, a full vector list saves the lexical rescoring.
SKIP_RESCORE_FROM = 512


@dataclass(frozen=True)
class SearchRequest:
    text: str | None = None
    vector: Sequence[float] | None = None
    top_k: int = 5
    alpha: float = 0.65
    candidate_limit: int = 1000
    include_payloads: bool = True
    filters: dict[str, str] = field(default_factory=dict)
    doc_id: str | None = None
    rrf_constant: float | None = None
    profile: str = "balanced"

    def resolved(self) -> SearchRequest:
        """With the candidate limit that the profile makes of the given one."""
        return replace(self, candidate_limit=candidate_limit(self.profile, self.top_k, self.candidate_limit))

    def validate(self) -> None:
        if self.text is not None and not self.text.strip():
            raise ValueError("query text is empty")
        if self.text is None and self.vector is None:
            raise ValueError("a query needs text, a vector, or both")
        if self.vector is not None and not len(self.vector):
            raise ValueError("query vector is empty")
        if self.top_k < 1:
            raise ValueError("top_k must be 1 or more")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be from 0 to 1")
        if self.candidate_limit < self.top_k:
            raise ValueError("candidate_limit must not be under top_k")
        if self.rrf_constant is not None and self.rrf_constant <= 0:
            raise ValueError("the rank constant must be positive")

    def mode(self, has_text_index: bool = True, has_vector_index: bool = True) -> str | None:
        """How a hybrid query starts; None for one of one kind."""
        if self.text is None or self.vector is None:
            return None
        if not has_text_index:
            return VECTOR_FIRST
        if not has_vector_index:
            return TEXT_FIRST
        if self.alpha >= 0.6 or self.profile == "latency":
            return VECTOR_FIRST
        return TEXT_FIRST if self.alpha <= 0.35 else BALANCED

    def _budget(self, mode: str, steps: tuple[int, int, int], floor: int) -> int:
        if mode == BALANCED:
            return self.candidate_limit
        return max(self.top_k, min(self.candidate_limit, max(floor, self.top_k * steps[PROFILES.index(self.profile)])))

    def primary_budget(self, mode: str) -> int:
        return self._budget(mode, (4, 8, 12), 32)

    def secondary_budget(self, mode: str) -> int:
        return self._budget(mode, (2, 4, 6), 16)

    def rerank_budget(self, mode: str | None) -> int:
        steps = (4, 6, 10) if mode in (None, BALANCED) else (2, 4, 8)
        return min(self.candidate_limit, self.top_k * steps[PROFILES.index(self.profile)])


def candidate_limit(profile: str, top_k: int, given: int) -> int:
    if profile not in PROFILES:
        raise ValueError(f"unknown query profile {profile!r}")
    if profile == "latency":
        return max(top_k, min(given, max(8 * top_k, 32)))
    if profile == "recall":
        return max(given, 32 * top_k, 200)
    return given
