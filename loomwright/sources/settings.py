"""Which provider and model each step uses: a YAML file, checked as a whole, and folders by environment."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

try:
    import yaml
except ImportError:  # only settings and node files need it
    yaml = None

SECTIONS = ("providers", "pricing", "defaults", "steps")


def check_settings(settings: dict) -> dict:
    """The settings, or ``ValueError``: unknown sections, an API without address or key, and providers that nobody defines."""
    if unknown := set(settings) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    known = settings.get("providers") or {}
    for name, p in known.items():
        if p.get("kind") == "api" and not (p.get("base_url") and p.get("api_key_env")):
            raise ValueError(f"provider {name!r} is an API without base_url or api_key_env")
    named = {"defaults": (settings.get("defaults") or {}).get("provider")}
    named |= {f"pricing of {n!r}": n for n in settings.get("pricing") or {}}
    for name, step in (settings.get("steps") or {}).items():
        named |= {f"step {name!r}": step.get("provider"), f"fallback of {name!r}": (step.get("fallback") or {}).get("provider")}
    for where, provider in named.items():
        if provider is not None and provider not in known:
            raise ValueError(f"{where} names the unknown provider {provider!r}; known are {sorted(known)}")
    return settings


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings of a YAML file, read by Spark and checked."""
    if yaml is None:
        raise RuntimeError("PyYAML is needed to read settings")
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    loaded = yaml.safe_load(text) or {}
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} is no mapping")
    return check_settings(loaded)


def folder(name: str, default: str, env: dict[str, str] | None = None) -> str:
    """A folder's path: the environment's, else the default."""
    return (os.environ if env is None else env).get(name) or default
