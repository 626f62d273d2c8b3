"""Configuration: layered mappings, signatures, and the registry of named strategies."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from typing import Any


class ConfigError(ValueError):
    """A setting that does not exist or does not fit."""


class UnknownStrategy(KeyError):
    """A name that no strategy of its kind has."""


# What stays out of a configuration's hash.
PATH_KEYS = (
    "manifest", "pdf_root", "txt_root", "path", "url", "db_url", "tracking_uri", "jsonl_dir", "qa_dev", "qa_test", "finalists_file", "results_root", "api_url", "endpoint", "source_path",
)
SECRET_KEYS = ("password", "secret", "token", "api_key", "api_key_env")
SECRET_ENDS = ("_key", "_secret", "_password")
RUNTIME_KEYS = frozenset(("device", "batch_size"))

#: The default profile.
BASE: dict[str, Any] = {
    "ingestion": {
        "loader": {"name": "txt", "params": {}},
        "chunker": {"name": "recursive", "params": {"chunk_tokens": 512, "overlap_tokens": 64}},
        "dense_embedder": {"name": "hash", "params": {"dim": 8}},
        "sparse_encoder": {"name": "hash_sparse", "params": {"modulus": 10_000}},
        "pipeline_version": 1,
    },
    "retrieval": {"mode": "hybrid", "k_candidates": 20, "fusion": {"name": "rrf", "params": {"k": 60}}, "reranker": {"name": "none", "params": {}}, "filters": {"use_agreement_type": True, "use_doc_hint": True}},
    "agent": {"max_rewrites": 2, "min_relevant": 2, "support": 0.8, "quote_threshold": 90},
    "evaluation": {"ks": [1, 3, 5, 10], "span_threshold": 90},
}


def merged(base: dict, over: dict) -> dict:
    """over laid on base, mapping by mapping."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def with_environment(config: dict, prefix: str = "DOCGRAIN__", environ: dict[str, str] | None = None) -> dict:
    """Settings named PREFIX_A__B: the path must exist; the value takes the kind of the one it replaces."""
    for name, raw in sorted((os.environ if environ is None else environ).items()):
        if not name.startswith(prefix):
            continue
        path = name.removeprefix(prefix).lower().split("__")
        at: Any = config
        for key in path:
            if not isinstance(at, dict) or key not in at:
                raise ConfigError(f"{name}: no such setting")
            at = at[key]
        value: Any = coerced(name, raw, at)
        for key in reversed(path):
            value = {key: value}
        config = merged(config, value)
    return config


def coerced(name: str, raw: str, old: Any) -> Any:
    if isinstance(old, bool):
        if raw.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ConfigError(f"{name}: not a boolean: {raw!r}")
        return raw.lower() in ("true", "1", "yes")
    try:
        return type(old)(raw) if isinstance(old, (int, float)) else json.loads(raw) if isinstance(old, (list, dict)) else raw
    except ValueError as e:
        raise ConfigError(f"{name}: {e}") from e


def load(path: str | None = None, profile: str | None = None, environ: dict[str, str] | None = None) -> dict:
    """The base, a YAML file and a profile's YAML file laid on it, then the environment."""
    config = BASE
    for name in (path, profile):
        if name:
            import yaml

            with open(name, encoding="utf-8") as f:
                over = yaml.safe_load(f) or {}
            if not isinstance(over, dict):
                raise ConfigError(f"{name}: not a mapping")
            config = merged(config, over)
    return with_environment(config, environ=environ)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def plain(value: Any) -> Any:
    """Without paths and secrets."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if k not in PATH_KEYS and k.lower() not in SECRET_KEYS and not k.lower().endswith(SECRET_ENDS)}
    return [plain(v) for v in value] if isinstance(value, list) else value


def config_hash(config: dict) -> str:
    return hashlib.sha256(canonical(plain({k: v for k, v in config.items() if k != "profile"})).encode()).hexdigest()


def index_signature(config: dict) -> str:
    """What decides an index's content; runtime settings do not."""
    own = config["ingestion"]
    steps = {s: own[s] | {"params": {k: v for k, v in own[s].get("params", {}).items() if k not in RUNTIME_KEYS}} for s in ("loader", "chunker", "dense_embedder", "sparse_encoder")}
    return hashlib.sha256(canonical(steps | {"pipeline_version": own["pipeline_version"]}).encode()).hexdigest()


def collection_name(config: dict, prefix: str = "docs") -> str:
    return f"{prefix}__{index_signature(config)[:12]}"


class Strategies:
    """Functions by name, of one kind."""

    def __init__(self, kind: str):
        self.kind, self.made = kind, {}

    def register(self, name: str) -> Callable:
        def keep(f: Callable) -> Callable:
            if name in self.made:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.made[name] = f
            return f

        return keep

    def get(self, name: str) -> Callable:
        if name not in self.made:
            raise UnknownStrategy(f"{self.kind} {name!r}; known: {', '.join(self.names())}")
        return self.made[name]

    def names(self) -> list[str]:
        return sorted(self.made)
