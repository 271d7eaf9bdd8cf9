"""Loads a comparison from a YAML file."""

from __future__ import annotations

from pathlib import Path

import yaml
from pydantic import ValidationError

from deltaloom.errors import ConfigError
from deltaloom.spec import DiffConfig, SourceConfig


def _read_yaml(path: Path) -> dict:
    if not path.is_file():
        raise ConfigError(f"No configuration file at {path.absolute()}")
    try:
        content = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as problem:
        raise ConfigError(f"{path} is no valid YAML:\n{problem}") from problem
    if not isinstance(content, dict):
        raise ConfigError(f"{path} must hold a mapping of settings")
    return content


def load_config(path: str | Path) -> tuple[DiffConfig, SourceConfig, SourceConfig]:
    """Reads ``source``, ``target`` and, from all other root keys, the comparison itself."""
    content = _read_yaml(Path(path))
    sides = {side: content.pop(side, None) for side in ("source", "target")}
    if absent := [side for side, block in sides.items() if block is None]:
        raise ConfigError(f"The configuration needs a 'source' and a 'target' block; missing: {', '.join(absent)}")
    try:
        source, target = (SourceConfig.model_validate(block) for block in sides.values())
        return DiffConfig.model_validate(content), source, target
    except ValidationError as problem:
        found = "\n".join(f"  {' -> '.join(map(str, e['loc']))}: {e['msg']}" for e in problem.errors())
        raise ConfigError(f"The configuration is not valid:\n{found}") from problem
