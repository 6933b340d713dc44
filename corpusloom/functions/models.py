"""The embedding models an index can be built for, and what makes two indexes comparable."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from corpusloom.operators.chunking import OVERLAP, TARGET, VERSION


@dataclass(frozen=True)
class Model:
    alias: str
    repo: str
    file: str
    dims: int
    context: int
    pooling: str
    query_prefix: str
    document_prefix: str
    threshold: float


#: Published models, their prompts and least scores.
MODELS = (
    Model("gemma-q4", "ggml-org/embeddinggemma-300M-qat-q4_0-GGUF", "embeddinggemma-300M-qat-Q4_0.gguf", 768, 2048, "mean", "task: search result | query: ", "title: none | text: ", 0.40),
    Model("gemma-gguf", "ggml-org/embeddinggemma-300M-GGUF", "embeddinggemma-300M-Q8_0.gguf", 768, 2048, "mean", "task: search result | query: ", "title: none | text: ", 0.40),
    Model("granite-gguf", "bartowski/granite-embedding-278m-multilingual-GGUF", "granite-embedding-278m-multilingual-Q8_0.gguf", 768, 512, "mean", "", "", 0.55),
    Model("bge-m3-gguf", "gpustack/bge-m3-GGUF", "bge-m3-Q8_0.gguf", 1024, 8192, "mean", "", "", 0.35),
    Model("qwen3-gguf", "Qwen/Qwen3-Embedding-0.6B-GGUF", "Qwen3-Embedding-0.6B-Q8_0.gguf", 1024, 8192, "last", "Instruct: Given a search query, retrieve relevant passages that answer it\nQuery: ", "", 0.35),
)
DEFAULT = "gemma-q4"
#: Feature hashing: needs no weights.
OFFLINE = Model("hash-64", "local/feature-hashing", "", 64, 1 << 20, "sum", "", "", 0.1)


def resolve(name: str) -> Model:
    """A model by alias or repository."""
    for model in (*MODELS, OFFLINE):
        if name in (model.alias, model.repo):
            return model
    raise KeyError(f"unknown model {name!r}; known: {', '.join(m.alias for m in (*MODELS, OFFLINE))}")


def signature(model: Model) -> str:
    """Equal only where vectors are comparable: the model, its prompts and the way texts are cut."""
    parts = (model.repo, model.file, model.query_prefix, model.document_prefix, model.pooling, str(TARGET), str(OVERLAP), str(VERSION))
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]
