"""Settings of every stage; all are immutable, copies are made with dataclasses.replace."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from lodestone.errors import ConfigError


class Fusion(str, Enum):
    RRF = "rrf"
    WEIGHTED = "weighted"
    COMB_SUM = "combSum"
    MAX_SCORE = "maxScore"


class Merge(str, Enum):
    INTERLEAVE = "interleave"
    HIGH_FIRST = "highFirst"
    LOW_FIRST = "lowFirst"
    WEIGHTED = "weighted"


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 1000
    overlap: int = 200
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", "! ", "? ", "; ", ": ", " ", "")
    min_size: int | None = None
    """Shortest trimmed chunk that is kept; None: min(50, max(1, size // 4))."""
    keywords: int = 5

    def __post_init__(self):
        if self.size <= 0:
            raise ConfigError("chunk size must be positive")
        if self.overlap < 0:
            raise ConfigError("chunk overlap must not be negative")
        if self.overlap >= self.size:
            raise ConfigError("chunk overlap must be smaller than the chunk size")

    @property
    def shortest(self) -> int:
        return min(50, max(1, self.size // 4)) if self.min_size is None else self.min_size


@dataclass(frozen=True)
class BM25Config:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class HybridConfig:
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    fusion: Fusion = Fusion.RRF
    rrf_k: float = 60.0
    max_candidates: int = 100
    min_score: float = 0.1


@dataclass(frozen=True)
class TraversalConfig:
    max_depth: int = 3
    max_paths: int = 100
    use_weights: bool = True
    min_strength: float = 0.5


@dataclass(frozen=True)
class PageRankConfig:
    damping: float = 0.85
    max_iterations: int = 100
    tolerance: float = 1e-6


@dataclass(frozen=True)
class CommunityConfig:
    resolution: float = 1.0
    max_iterations: int = 100
    min_gain: float = 1e-6


@dataclass(frozen=True)
class KeywordConfig:
    max_keywords: int = 20
    language: str = "English"

    def __post_init__(self):
        object.__setattr__(self, "max_keywords", max(0, self.max_keywords))


@dataclass(frozen=True)
class DualConfig:
    high_weight: float = 0.6
    low_weight: float = 0.4
    strategy: Merge = Merge.INTERLEAVE


@dataclass(frozen=True)
class SearchOptions:
    threshold: float = 0.0
    include_keyword: bool = True


@dataclass(frozen=True)
class ModelServerConfig:
    host: str = "http://localhost"
    port: int = 11434
    chat_model: str = "llama3.2:3b"
    embedding_model: str = "nomic-embed-text"
    embedding_dimension: int = 1024
    temperature: float = 0.7
    max_tokens: int = 2000
    timeout_seconds: float = 30.0
    keep_alive: str | None = None
    num_ctx: int | None = None

    @property
    def base_url(self) -> str:
        """The address with a scheme, and with the port unless the host names one."""
        full = self.host if "://" in self.host else f"http://{self.host}"
        return full if ":" in full.split("://", 1)[1] else f"{full}:{self.port}"


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    max_entities_per_chunk: int = 10
    top_k: int = 10
    similarity_threshold: float = 0.8
    approach: str = "hybrid"
    output_dir: str = "./output"
    embedding_dimension: int = 384
    embedding_backend: str = "hash"
    languages: tuple[str, ...] = ("en",)
    min_confidence: float = 0.7
    extract_relationships: bool = True
    server: ModelServerConfig = field(default_factory=ModelServerConfig)
    use_chat_model: bool = False

    @property
    def includes_keyword(self) -> bool:
        return self.approach.lower() != "semantic"

    @property
    def includes_semantic(self) -> bool:
        return self.approach.lower() != "keyword"
