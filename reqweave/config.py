"""Settings of the engine: directories, model, and the sizes that bound chunks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """What a job can set. Read from a mapping or a YAML file; unknown names are an error."""

    input_dir: str = "data/input"
    output_dir: str = "data/output"
    markdown_dir: str = "data/markdown"
    model: str = "llama3:latest"
    host: str = "http://localhost:11434"
    timeout: float = 300.0
    temperature: float = 0.1
    max_retries: int = 3
    workers: int = 5
    max_tokens: int = 3500
    overlap: int = 200
    pages_per_request: int = 2
    dialect: str = "strict"
    prompt: str = "requirement_extraction"

    @property
    def split_size(self) -> int:
        """Characters of a piece of an oversize section."""
        return int(self.max_tokens * 3.8)

    @classmethod
    def of(cls, values: dict) -> EngineConfig:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **values)

    @classmethod
    def from_yaml(cls, path: str) -> EngineConfig:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f) or {})
