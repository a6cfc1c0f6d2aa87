"""Settings of a run: thresholds and weights with the values used by default."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScoringConfig:
    probative_weight: float = 0.4
    relevance_weight: float = 0.3
    admissibility_weight: float = 0.3
    prejudice_penalty: float = 0.1
    hits_for_full_score: float = 5.0
    min_relevance: float = 0.5
    min_impact: float = 0.3


@dataclass(frozen=True)
class UsageLimits:
    requests_per_minute: int = 20
    tokens_per_hour: float = 100_000.0
    cost_per_hour: float = 10.0
    max_backoff_seconds: float = 300.0
    cost_per_token: float = 0.0001


@dataclass(frozen=True)
class CaseConfig:
    case_name: str = "Case"
    case_type: str = "general"
    theories: list[str] = field(default_factory=list)
    facts: list[str] = field(default_factory=list)
    scoring: ScoringConfig = ScoringConfig()
    limits: UsageLimits = UsageLimits()
