"""Settings from a file of KEY=VALUE lines; what the environment has already wins."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path


def load(path: str | Path, env: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Adds a file's settings to env and returns those added. Comments and lines without = are skipped, quotes around values go."""
    env = os.environ if env is None else env
    added = {}
    if not Path(path).exists():
        return added
    for line in Path(path).read_text().splitlines():
        name, sep, value = line.strip().partition("=")
        name, value = name.strip(), value.strip()
        if not sep or not name or name.startswith("#") or name in env:
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        env[name] = added[name] = value
    return added
