"""The retrieval configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of index and search. ``load`` drops names it does not know."""

    model: str = "gte-modernbert-base"
    max_seq_length: int | None = None
    cache_path: str | None = ".cache/embeddings.sqlite"
    batch_size: int = 32
    doc_max_chars: int = 1800
    augment_tags: bool = False
    w_full: float = 0.6
    w_stmt: float = 0.4
    fusion: str = "zscore"
    bm25_weight: float = 0.25
    topic_weight: float = 0.15
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: int = 60
    query_chunk: int = 128

    @classmethod
    def load(cls, source: str | dict | None = None) -> PipelineConfig:
        """Defaults, a JSON file or a dict."""
        data = {} if source is None else source if isinstance(source, dict) else json.loads(Path(source).read_text())
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in names})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def resolve(root: str | Path, config: str | None = None, model: str | None = None) -> PipelineConfig:
    """``config``, else configs/tuned.json, else configs/default.json below ``root``, else defaults.

    ``model`` overrides the file's; a relative cache path is anchored at ``root``.
    """
    root = Path(root)
    found = [p for p in ([config] if config else [root / "configs/tuned.json", root / "configs/default.json"]) if config or Path(p).exists()]
    loaded = asdict(PipelineConfig.load(str(found[0]) if found else None))
    if model:
        loaded["model"] = model
    if loaded["cache_path"] and not Path(loaded["cache_path"]).is_absolute():
        loaded["cache_path"] = str(root / loaded["cache_path"])
    return PipelineConfig(**loaded)
