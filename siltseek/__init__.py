"""A PySpark engine for hybrid text and code retrieval."""

from siltseek.plans.retriever import CodeIndex, HybridRetriever
from siltseek.sources.config import PipelineConfig

__all__ = ["CodeIndex", "HybridRetriever", "PipelineConfig"]
