"""Constants that define results."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    # Defaults of the memory pipeline and the benchmark.
    candidate_shards: int = 8
    probe_shards: int = 8
    recall_shards: int = 4
    recall_tokens: int = 1200
    recall_confidence: float = 0.45
    inferred_confidence: float = 0.7
    probe_index_chars: int = 1200
    probe_head_chars: int = 80
    recall_body_chars: int = 480
    claim_chars: int = 240
    answer_chars: int = 320
    scaffolding_tokens: int = 512
    context_limit: int = 128_000
    rag_floor_events: int = 8
    rag_floor_score: float = 4.0
    floor_k: int = 10
    expand_k: int = 3
    expand_max: int = 16
    entity_k: int = 6
    entity_max: int = 24
    entity_ranks: int = 24
    lexical_max: int = 20
    lexical_ranks: int = 16
    k_lexical: int = 20
    k_vector: int = 20
    k_final: int = 10
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    seed: int = 42
    early_stop: float = 0.5
    accuracy: float = 0.8
    bootstrap: int = 10_000
    bootstrap_loop: int = 200
    alpha: float = 0.05
    recency_days: float = 90.0
    coverage_buckets: int = 12
    coverage_per_bucket: int = 2
    summary_return: int = 24
    reasoning_return: int = 32
    capsule_coverage: int = 36
    capsule_top: int = 24
    capsule_pinned: int = 8
    capsule_reasoning: int = 10
    capsule_other: int = 8
    snippet_chars: int = 360
    trend: float = 0.005

    @classmethod
    def read(cls, settings: Mapping[str, str], prefix: str = "MNEMOFLOW_") -> Config:
        """Settings such as MNEMOFLOW_FLOOR_K over the defaults. A whole number may be followed by other text;
        what is blank or no number leaves the default. Pass ``os.environ`` for the environment's."""
        found = {}
        for f in fields(cls):
            whole = f.type in ("int", int)
            said = re.match(r"\s*([+-]?\d+)" if whole else r"\s*([+-]?\d+(?:\.\d*)?)", settings.get(prefix + f.name.upper()) or "")
            if said:
                found[f.name] = (int if whole else float)(said[1])
        return cls(**found)


DEFAULT = Config()
