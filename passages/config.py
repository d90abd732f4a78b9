"""Retrieval settings and the presets of the three entry points."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data model.
VECTOR_SIZE = 768
EMBED_BATCH = 64
SCROLL_LIMIT = 100
UNKNOWN_SOURCE = "Unknown"
OTHER_LABEL = "other"


@dataclass(frozen=True)
class RetrievalConfig:
    chunk_size: int = 500
    chunk_overlap: int = 50
    recursive: bool = True
    vector_k: int = 5
    use_lexical: bool = False
    lexical_k: int = 1
    use_rerank: bool = False
    rerank_k: int = 7
    threshold: float = 0.2
    max_context_tokens: int = 4096
    apply_budget: bool = False

    @property
    def context_budget(self) -> int:
        """Half of the model window is for the context, the other half for the answer."""
        return int(0.5 * self.max_context_tokens)


INGEST = RetrievalConfig(chunk_size=1000, chunk_overlap=50, recursive=False)
ASK = RetrievalConfig()
SERVICE = RetrievalConfig(
    chunk_size=700,
    chunk_overlap=50,
    vector_k=30,
    use_lexical=True,
    lexical_k=5,
    use_rerank=True,
    rerank_k=10,
    threshold=0.9,
)
