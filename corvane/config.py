"""Settings of an analysis: defaults, TOML files, overrides and checks."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

DEFAULT_FILE = "corvane.toml"
REMOTE_MODEL = "text-embedding-3-small"
REMOTE_BASE = "https://api.openai.com/v1"


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class Embedding:
    """Which embedder turns text into vectors: the deterministic local one, or a remote service."""

    provider: str = "null"
    model: str = REMOTE_MODEL
    base_url: str = REMOTE_BASE

    @property
    def tag(self) -> str:
        return "null" if self.provider == "null" else self.model


@dataclass(frozen=True)
class Config:
    chunk_size: int = 400
    chunk_overlap: int = 40
    max_tokens: int = 1200
    min_tokens: int = 60
    top_k: int = 5
    dominant_threshold: float = 0.3
    required_metadata: tuple[str, ...] = ("product", "region", "version")
    embedder: Embedding = field(default_factory=Embedding)
    cache_dir: str = ".corvane-cache"
    low_sim_threshold: float = 0.35
    no_match_threshold: float = 0.25
    max_retries: int = 3
    retry_backoff_ms: int = 300
    request_timeout_ms: int = 15000
    seed: int = 42

    @classmethod
    def load(cls, path: str | Path | None = None) -> Config:
        """Settings of a TOML file; a file that isn't there, named or not, means the defaults."""
        file = Path(path or DEFAULT_FILE)
        if not file.is_file():
            return cls()
        try:
            found = tomllib.loads(file.read_text(encoding="utf-8"))
        except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
            raise ConfigError(f"{file} is no valid TOML: {error}") from error
        embedder = found.pop("embedder", None)
        top = {k: found.pop(k) for k in ("provider", "model", "base_url") if k in found}
        if isinstance(embedder, str):
            embedder = {"provider": embedder}
        settings = {k: v for k, v in found.items() if k in cls.__dataclass_fields__}
        if "required_metadata" in settings:
            settings["required_metadata"] = tuple(settings["required_metadata"])
        named = {k: v for k, v in ((embedder or {}) | top).items() if k in Embedding.__dataclass_fields__}
        return cls(**settings, embedder=Embedding(**named)).checked()

    def overridden(self, embedder: str | None = None, cache_dir: str | None = None, low_sim: float | None = None, no_match: float | None = None) -> Config:
        """These settings with those of the command line, checked again."""
        changes: dict = {}
        if embedder is not None:
            kind = embedder.strip().lower()
            if kind not in ("null", "openai"):
                raise ConfigError(f"unknown embedder {embedder!r}: null or openai")
            changes["embedder"] = replace(self.embedder, provider=kind)
        for name, value in (("cache_dir", cache_dir), ("low_sim_threshold", low_sim), ("no_match_threshold", no_match)):
            if value is not None:
                changes[name] = value
        return replace(self, **changes).checked()

    def checked(self) -> Config:
        rules = (
            (self.chunk_size > 0, "chunk_size must be above 0"),
            (self.chunk_overlap < self.chunk_size, "chunk_overlap must be less than chunk_size"),
            (self.top_k > 0, "top_k must be above 0"),
            (self.min_tokens <= self.max_tokens, "min_tokens must not exceed max_tokens"),
            (0 <= self.dominant_threshold <= 1, "dominant_threshold must be from 0 to 1"),
            (-1 <= self.low_sim_threshold <= 1, "low_sim_threshold must be from -1 to 1"),
            (-1 <= self.no_match_threshold <= 1, "no_match_threshold must be from -1 to 1"),
            (self.no_match_threshold <= self.low_sim_threshold, "no_match_threshold must not exceed low_sim_threshold"),
            (self.embedder.provider in ("null", "openai"), "embedder must be null or openai"),
        )
        for holds, message in rules:
            if not holds:
                raise ConfigError(message)
        return self

    def snapshot(self) -> dict:
        """The settings that reports carry."""
        names = ("chunk_size", "chunk_overlap", "min_tokens", "max_tokens", "top_k", "dominant_threshold", "low_sim_threshold", "no_match_threshold")
        return {k: getattr(self, k) for k in names} | {"embedder": str(asdict(self.embedder)), "seed": self.seed}
