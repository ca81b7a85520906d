"""The user's configuration: named repositories and a default one."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

HOME = "SNAPQUARRY_HOME"


def directory() -> Path:
    return Path(os.environ.get(HOME) or Path.home() / ".snapquarry")


@dataclass
class Config:
    default_repo: str = ""
    repos: dict[str, dict[str, str]] = field(default_factory=dict)

    @staticmethod
    def load() -> Config:
        """An absent file is an empty configuration."""
        path = directory() / "config.json"
        if not path.exists():
            return Config()
        data = json.loads(path.read_text())
        return Config(data.get("default_repo", ""), data.get("repos") or {})

    def save(self) -> None:
        directory().mkdir(mode=0o755, parents=True, exist_ok=True)
        (directory() / "config.json").write_text(json.dumps({"default_repo": self.default_repo, "repos": self.repos}, indent=2) + "\n")

    def resolve(self, name: str = "") -> str:
        """The directory of a repository by name."""
        name = name or self.default_repo
        if not name:
            raise LookupError("no repository given and no default set")
        if name not in self.repos:
            raise LookupError(f"repository {name!r} is not configured")
        ref = self.repos[name]
        if ref.get("store", "local") not in ("", "local"):
            raise ValueError(f"store {ref['store']!r} is not supported")
        return ref["location"]
