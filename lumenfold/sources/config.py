"""Application settings: JSON with defaults, validated; a broken file gives the defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

# Standard exclusions.
EXCLUSIONS = ["**/.git/**", "**/node_modules/**", "**/target/**", "**/.cache/**", "**/__pycache__/**", "**/.venv/**", "**/*.tmp", "**/~$*"]


@dataclass
class Settings:
    folders: list[str] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=lambda: list(EXCLUSIONS))
    max_file_size: int = 50 * 1024 * 1024
    workers: int = 2
    index_documents: bool = True
    index_code: bool = True
    index_images: bool = True

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            raw = json.loads(Path(path).read_text("utf-8"))
        except (OSError, ValueError):
            return cls()
        known = {f.name: f for f in fields(cls)}
        base = cls()
        out = {k: v for k, v in raw.items() if k in known and isinstance(v, type(getattr(base, k)))} if isinstance(raw, dict) else {}
        return cls(**out)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False), "utf-8")

    def validate(self) -> list[str]:
        out = []
        if self.max_file_size <= 0:
            out.append("max_file_size must be positive")
        if not 1 <= self.workers <= 64:
            out.append("workers must be 1 to 64")
        out += [f"folder doesn't exist: {f}" for f in self.folders if not Path(f).is_dir()]
        return out + ["empty exclusion pattern" for e in self.exclusions if not e.strip()]
