"""Settings of chunking and retrieval, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    small_document_chars: int = 2048
    max_chunk_chars: int = 800
    max_sentences: int = 12
    retrieval_chars: int = 30_000
    heading_levels: int = 10
    index_code: bool = True
    table_raw_text: bool = True


@dataclass(frozen=True)
class RetrievalConfig:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    dense_top_k: int = 30
    sparse_top_k: int = 30
    fused_top_k: int = 30
    top_k: int = 8
    minimum_should_match: int = 1
    max_adjacent_rows: int = 2
    budget_tokens: int = 4292
    tokens_per_char: float = 0.25

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k is 1 to 20")
