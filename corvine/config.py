"""Settings with defaults; an environment variable of the same name overrides each (source of configuration, not of data)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


def from_file(path: str) -> dict[str, str]:
    """NAME=value a line; blank lines and comments count for nothing, quotes around a value go."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().removeprefix("export ").split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


# Names and defaults are fixed values.
@dataclass(frozen=True)
class Settings:
    MAX_FILE_SIZE: int = 50 * 1024 * 1024
    MAX_TOTAL_SIZE: int = 200 * 1024 * 1024
    ALLOWED_TYPES: tuple = (".txt", ".pdf", ".docx", ".md")
    CHUNK_SIZE: int = 2000
    CHUNK_OVERLAP: int = 100
    CACHE_EXPIRE_DAYS: int = 7
    BM25_SEARCH_K: int = 8
    BM25_K1: float = 1.5
    BM25_B: float = 0.75
    BM25_EPSILON: float = 0.25
    VECTOR_FETCH_K: int = 35
    VECTOR_SEARCH_K: int = 25
    MMR_K: int = 15
    MMR_LAMBDA: float = 0.7
    RRF_C: int = 60
    BM25_WEIGHT: float = 0.4
    VECTOR_WEIGHT: float = 0.6
    RELEVANCE_CHECK_K: int = 20
    RESEARCH_TOP_K: int = 15
    MAX_RESEARCH_ATTEMPTS: int = 5
    NUM_RESEARCH_CANDIDATES: int = 2
    CHART_MIN_CONFIDENCE: float = 0.4
    CHART_CALL_COST: float = 0.0125
    RATE_WINDOW_S: int = 3600
    RATE_MAX_CALLS: int = 5

    @classmethod
    def load(cls, file: str = ".env") -> Settings:
        """Defaults, overridden by a file of settings where there is one, and by the environment; a value of the wrong type raises."""
        found, given = {}, from_file(file) | os.environ
        for f in fields(cls):
            if (value := given.get(f.name)) is not None:
                kind = type(f.default)
                found[f.name] = tuple(value.split(",")) if kind is tuple else kind(value)
        out = cls(**found)
        if out.CHUNK_OVERLAP >= out.CHUNK_SIZE:
            raise ValueError("CHUNK_OVERLAP must be below CHUNK_SIZE")
        return out


def usable_key(key: str | None) -> bool:
    """Whether a provider's key is set and no placeholder (fixed values)."""
    return bool(key and key.strip()) and not key.strip().startswith("your_") and key.strip() != "YOUR_API_KEY_HERE"


DEFAULTS = Settings()
