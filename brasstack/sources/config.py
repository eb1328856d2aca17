"""The pipeline's configuration: YAML, checked and filled with defaults, and its dimensions as DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Defaults of the configuration, environment variables of keys, requests a minute by provider.
DEFAULTS = {
    "data": {"seed_target_count": 100, "mutations_per_seed": 10, "total_benchmark_size": 1000, "paths": {}},
    "eval": {"temperature": 0.0, "max_tokens": 1024, "concurrency": 5, "checkpoint_every": 10, "dry_run": False,
             "judge": {"provider": "openai", "model": "gpt-4o", "temperature": 0.0, "max_tokens": 512, "kappa_threshold": 0.80, "calibration_sample_size": 100}},
    "plots": {"style": "science", "dpi": 300, "formats": ["pdf", "png"], "output_dir": "plots", "figsize_double_column": [7.0, 4.0], "figsize_single_column": [3.5, 2.5], "colorblind_safe": True},
    "scrapers": None,
}
REQUIRED = {"data": ("domain_distribution",), "constraints": ("financial", "environmental", "infrastructural")}
TIERS = ("frontier", "open_weights", "indic_native")
MODEL = {"max_tokens": 1024, "api_base": None, "api_key_env": None}
KEYS = {
    "openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "google": "GOOGLE_API_KEY", "together": "TOGETHER_API_KEY", "deepseek": "DEEPSEEK_API_KEY",
    "fireworks": "FIREWORKS_API_KEY", "youtube": "YOUTUBE_API_KEY", "krutrim": "KRUTRIM_API_KEY",
}
PER_MINUTE = {"openai": 500, "anthropic": 100, "google": 300, "together": 200, "deepseek": 200, "fireworks": 200, "default": 50}


def _filled(given: dict, defaults: dict) -> dict:
    return defaults | given | {k: _filled(given.get(k) or {}, v) for k, v in defaults.items() if isinstance(v, dict) and v}


def parse_config(given: dict) -> dict:
    """The tree with defaults; raises with the names of what is missing or of the wrong kind."""
    missing = [f"{a}.{b}" for a, names in REQUIRED.items() for b in names if b not in (given.get(a) or {})]
    if missing:
        raise ValueError(f"missing in the configuration: {', '.join(missing)}")
    out = {k: _filled(given.get(k) or {}, v) if v else given.get(k) for k, v in DEFAULTS.items()}
    out["constraints"] = {k: list(given["constraints"][k]) for k in REQUIRED["constraints"]}
    models = given.get("models") or {}
    out["models"] = {t: [MODEL | m for m in models.get(t) or []] for t in TIERS}
    wrong = [f"data.domain_distribution.{k}" for k, v in out["data"]["domain_distribution"].items() if not isinstance(v, int)]
    wrong += [f"constraints.{k}" for k, v in out["constraints"].items() if not all(isinstance(x, str) for x in v)]
    wrong += [f"models.{t}" for t, ms in out["models"].items() if not all({"name", "provider", "model_id"} <= m.keys() for m in ms)]
    if wrong:
        raise ValueError(f"wrong in the configuration: {', '.join(wrong)}")
    return out


def load_config(path: str | Path) -> dict:
    import yaml

    return parse_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def project_root(start: str | Path, mark: str = "pyproject.toml") -> Path:
    """The nearest folder above that holds the mark."""
    for p in (Path(start).resolve(), *Path(start).resolve().parents):
        if (p / mark).exists():
            return p
    raise FileNotFoundError(f"no {mark} above {start}")


def data_path(config: dict, key: str, root: str = ".") -> str:
    """The configured path of a kind of data, data/{key} where none is set. Writers create it."""
    return f"{root.rstrip('/')}/{config['data']['paths'].get(key, f'data/{key}')}"


def api_key(provider: str, env_var: str | None = None) -> str:
    name = env_var or KEYS.get(provider.lower())
    if name is None:
        raise ValueError(f"no key is known for provider {provider!r}; known: {', '.join(KEYS)}")
    if not (key := os.environ.get(name)):
        raise ValueError(f"the environment variable {name} is not set")
    return key


def axes(config: dict) -> dict[str, tuple[str, ...]]:
    """The constraint axes by column name, for sample.constraint_space."""
    c = config["constraints"]
    return {"budget": tuple(c["financial"]), "environment": tuple(c["environmental"]), "infrastructure": tuple(c["infrastructural"])}


def model_dim(spark: SparkSession, config: dict) -> DataFrame:
    """(ord, tier, name, provider, model_id, max_tokens, api_base, api_key_env): tiers one after the other."""
    rows = [(tier, m) for tier in TIERS for m in config["models"][tier]]
    names = ("name", "provider", "model_id", "max_tokens", "api_base", "api_key_env")
    return spark.createDataFrame([(i, t, *(m[k] for k in names)) for i, (t, m) in enumerate(rows)], "ord int, tier string, name string, provider string, model_id string, max_tokens int, api_base string, api_key_env string")


def domain_dim(spark: SparkSession, config: dict) -> DataFrame:
    """(ord, domain, quota)."""
    return spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(config["data"]["domain_distribution"].items())], "ord int, domain string, quota int")


def only(models: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Models with exactly these names; all where none are given."""
    return models.filter(models["name"].isin(names)) if names else models
