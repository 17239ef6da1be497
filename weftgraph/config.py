"""Limits, thresholds, weights and closed vocabularies of the engine, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Limits and thresholds.
CHAIN_DEPTH, IMPACT_DEPTH, HARD_DEPTH = 10, 5, 20
MAX_PATHS, SUGGESTIONS = 100, 10
GRAPH_TTL_HOURS, RESULT_TTL_DAYS = 24, 7
BATCH_SIZE, DEFAULT_TIMEOUT_S = 100, 30
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE, LOW_CONFIDENCE = 0.9, 0.7, 0.8
AGREEMENT_BONUS, SECOND_PENALTY, CONFLICT_GAP = 0.1, 0.9, 0.3
FIRST_DEFAULT, SECOND_DEFAULT = 1.0, 0.7
PATH_DEFAULT_CONFIDENCE, NON_POSITIVE_COST = 0.5, 100.0
RATE_LIMIT, RATE_WINDOW_S, COST_PER_1K = 60, 60, 0.003
SQL_PREVIEW, EDGE_SQL, SOURCE_CHARS, CONTEXT_LINES, LINK_TEXT = 200, 100, 10_000, 15, 50
DIAGRAM_NODES, DIAGRAM_FANOUT = 50, 2

# Types that count as one, layers, weights, seconds a file may take by kind.
SQL_TYPES = ("SQL", "SQL_STATEMENT")
#: Layers of a chain, each a set of types.
LAYERS = (("JSP",), ("CONTROLLER", "CONTROLLER_METHOD"), ("SERVICE", "SERVICE_METHOD"), ("MAPPER", "MAPPER_METHOD"), SQL_TYPES, ("TABLE", "VIEW", "PROCEDURE"))
#: Weight of a type in an impact score; others weigh 1.
TYPE_WEIGHTS = {"JSP": 5, "CONTROLLER": 4, "CONTROLLER_METHOD": 4, "SERVICE": 3, "SERVICE_METHOD": 3, "MAPPER": 2, "MAPPER_METHOD": 2}
TIMEOUTS_S = {"jsp": 10, "controller": 15, "service": 15, "mapper": 45}


@dataclass(frozen=True)
class EngineConfig:
    chain_depth: int = CHAIN_DEPTH
    impact_depth: int = IMPACT_DEPTH
    max_paths: int = MAX_PATHS
    low_confidence: float = LOW_CONFIDENCE
    agreement_bonus: float = AGREEMENT_BONUS
    second_penalty: float = SECOND_PENALTY
    skip_patterns: tuple[str, ...] = ("/target/", "/build/", "/.git/", "/node_modules/")
    type_weights: dict[str, int] = field(default_factory=lambda: dict(TYPE_WEIGHTS))
