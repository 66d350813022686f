"""Subset tags, path templates and the registry of data sets; all small and on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graincart.sources.files import load_yaml

DATA_ROOT = "GRAINCART_DATA_ROOT"


def download_mode(value: str | None) -> str:
    mode = (value or "partial").strip().lower()
    if mode not in ("partial", "full"):
        raise ValueError(f"a download is partial or full, not {value}")
    return mode


def sample_fraction(value: float) -> float:
    fraction = float(value)
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"sample_fraction must be over 0 and at most 1, got {value}")
    return fraction


def subset_tag(mode: str, fraction: float) -> str:
    """`full`, or `partial_<percent>pct` with the percentage rounded half to even."""
    mode, fraction = download_mode(mode), sample_fraction(fraction)
    return "full" if mode == "full" or fraction >= 1.0 else f"partial_{round(fraction * 100)}pct"


def data_root(repo_root: str, explicit: str | None = None) -> str:
    """The explicit root, else that of the environment, else `data` in the repository."""
    return os.path.abspath(os.path.expanduser(explicit or os.environ.get(DATA_ROOT) or os.path.join(repo_root, "data")))


def prefix_limit(total: int | None, mode: str | None, fraction: float) -> int | None:
    """How many of a split's first rows a download takes: at least one; None (all of them) in full mode or where the total isn't known."""
    if download_mode(mode) == "full" or total is None:
        return None
    return max(1, int(total * sample_fraction(fraction)))


def runtime_settings(defaults: dict[str, Any], repo_root: str, mode: str | None = None, fraction: float | None = None, tag: str | None = None, root: str | None = None) -> dict[str, Any]:
    """download_mode, sample_fraction, subset_tag and data_root of a run. What isn't given, or is empty or 0, is the registry's default."""
    mode, fraction = mode or defaults.get("download_mode", "partial"), fraction or defaults.get("sample_fraction", 0.1)
    return {"download_mode": mode, "sample_fraction": fraction, "subset_tag": tag or subset_tag(mode, fraction), "data_root": data_root(repo_root, root)}


def render(template: str, **context: Any) -> str:
    return os.path.abspath(os.path.expanduser(str(template).format(**context)))


def relative_posix(path: str, base: str) -> str:
    return os.path.relpath(path, base).replace(os.sep, "/")


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    normalizer: str
    task_family: str = "sft"
    default_task_type: str = "vqa"
    source_type: str = "manual"
    access: str = "manual"
    license_name: str | None = None
    eval_only: bool = False
    raw_dir: str = "{data_root}/raw/{dataset_name}/{subset_tag}"
    interim_path: str = "{data_root}/interim/{subset_tag}/{dataset_name}.jsonl"
    extra: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)


def load_registry(path: str) -> dict[str, DatasetSpec]:
    """The data sets of a YAML file `{defaults: {...}, datasets: [{name: ..., ...}]}`; defaults fill what an entry leaves out."""
    data = load_yaml(path)
    defaults, known = data.get("defaults") or {}, set(DatasetSpec.__dataclass_fields__) - {"extra"}
    specs = {}
    for entry in data.get("datasets") or []:
        merged = {**defaults, **entry}
        specs[merged["name"]] = DatasetSpec(**{k: v for k, v in merged.items() if k in known}, extra={k: v for k, v in merged.items() if k not in known})
    return specs


def registry_table(spark: SparkSession, specs: dict[str, DatasetSpec]) -> DataFrame:
    rows = [(s.name, s.task_family, s.normalizer, s.default_task_type, s.eval_only) for s in specs.values()]
    return spark.createDataFrame(rows, "source_dataset string, task_family string, normalizer string, default_task_type string, eval_only boolean")


def existing_sources(paths: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Those of the configured files that exist, and the names of those that don't."""
    found = {k: v for k, v in paths.items() if os.path.exists(v)}
    return found, [k for k in paths if k not in found]
