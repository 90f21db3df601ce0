"""Settings of a run: input and output paths and processing parameters from a YAML or JSON file."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def load_config(path: str) -> dict[str, Any]:
    """The file's settings, with the file's folder under `base`. It must have a `pipeline` section. YAML needs a YAML reader; JSON doesn't."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ModuleNotFoundError as lacking:
            raise RuntimeError("this installation reads JSON settings only") from lacking
        found = yaml.safe_load(text)
    if not isinstance(found, dict) or "pipeline" not in found:
        raise ValueError(f"{path} has no section `pipeline`")
    return found | {"base": str(Path(path).resolve().parent)}


def _located(config: dict[str, Any], section: str, key: str) -> str:
    """A path of a section: as it is if it is absolute or has a scheme (hdfs://, s3://), else below the file's folder."""
    where = config["pipeline"][section][key]
    return where if "://" in where or where.startswith("/") else str(Path(config.get("base", ".")) / where)


def input_path(config: dict[str, Any], key: str) -> str:
    """KeyError if there is no such input."""
    return _located(config, "inputs", key)


def output_path(config: dict[str, Any], key: str) -> str:
    """KeyError if there is no such output."""
    return _located(config, "outputs", key)


def processing(config: dict[str, Any], key: str, default: Any = None) -> Any:
    return config["pipeline"].get("processing", {}).get(key, default)
