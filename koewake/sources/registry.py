"""The registered directories, in a small JSON file; and settings from a dotenv file."""

from __future__ import annotations

import json
import os
from pathlib import Path


class Registry:
    """An ordered set of directories. Paths are resolved; those that are gone are left out when read."""

    def __init__(self, file: str) -> None:
        self.file = Path(file)

    def all(self) -> list[str]:
        try:
            data = json.loads(self.file.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return []
        if not isinstance(data, dict):
            return []
        old = [data["audio_dir"]] if data.get("audio_dir") else []
        return [d for d in data.get("audio_dirs", old) if Path(d).exists()]

    def first(self) -> str | None:
        return next(iter(self.all()), None)

    def add(self, directory: str) -> bool:
        """Whether it is new."""
        new, have = str(Path(directory).resolve()), self.all()
        if new in (str(Path(d).resolve()) for d in have):
            return False
        self._save([*have, new])
        return True

    def remove(self, directory: str) -> bool:
        """Whether it was there."""
        gone, have = str(Path(directory).resolve()), self.all()
        left = [d for d in have if str(Path(d).resolve()) != gone]
        if len(left) < len(have):
            self._save(left)
        return len(left) < len(have)

    def _save(self, dirs: list[str]) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        part = self.file.with_suffix(".part")
        part.write_text(json.dumps({"audio_dirs": [str(Path(d).resolve()) for d in dirs]}, ensure_ascii=False), encoding="utf-8")
        part.replace(self.file)


def load_dotenv(file: str, into: dict | None = None) -> dict[str, str]:
    """Sets what the environment does not have yet, and returns it; a missing file sets nothing."""
    env = os.environ if into is None else into
    loaded: dict[str, str] = {}
    try:
        lines = Path(file).read_text(encoding="utf-8").splitlines()
    except OSError:
        return loaded
    for line in map(str.strip, lines):
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if key not in env:
            env[key] = loaded[key] = value
    return loaded
