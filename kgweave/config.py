"""Settings: defaults, a user's file laid over them, and a first file to start from."""

from __future__ import annotations

import json
from pathlib import Path

from kgweave.sources.detect import CATEGORIES, EXTRACTORS, SERVERS, merge_config

DEFAULTS: dict = {
    "lsp": dict(SERVERS), "language_ids": {e: e for e in SERVERS}, "extractors": dict(EXTRACTORS), "file_extensions": {k: list(v) for k, v in CATEGORIES.items()},
    "neo4j": {"uri": "", "batch": 50}, "labeling": {"enabled": False, "model": ""},
}


def load_config(path: str | None) -> dict:
    """The settings of a JSON file (or YAML, where a YAML library is installed) over DEFAULTS; absent or invalid files give DEFAULTS."""
    if not path or not Path(path).exists():
        return merge_config(DEFAULTS, {})
    text = Path(path).read_text()
    try:
        user = json.loads(text)
    except ValueError:
        try:
            import yaml

            user = yaml.safe_load(text)
        except Exception:  # no YAML library, or no YAML
            user = None
    return merge_config(DEFAULTS, user if isinstance(user, dict) else {})


def init_config(path: str) -> bool:
    """Write DEFAULTS to a new file; an existing one is left as it is and False returned."""
    if Path(path).exists():
        return False
    Path(path).write_text(json.dumps(DEFAULTS, indent=2, sort_keys=True) + "\n")
    return True
