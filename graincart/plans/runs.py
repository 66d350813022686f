"""What a run leaves beside its results: its settings, where it ran, and where its outputs are."""

from __future__ import annotations

import datetime
import os
import platform
import socket
import subprocess
from dataclasses import dataclass
from typing import Any

from graincart.sources.files import write_json, write_yaml

#: Environment variables whose values are kept with a run, if they are set.
KEPT = ("SLURM_JOB_ID", "SPARK_HOME", "PYTHONHASHSEED", "OMP_NUM_THREADS")


@dataclass(frozen=True)
class Run:
    """A run's name, stage and folder; its files have fixed places below the folder."""

    name: str
    stage: str
    folder: str

    def at(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def places(self) -> dict[str, str]:
        return {
            "metrics_jsonl": self.at("metrics", "train_metrics.jsonl"), "legacy_metrics_jsonl": self.at("metrics.jsonl"), "tensorboard_dir": self.at("tensorboard"), "artifact_dir": self.at("artifacts"),
            "resolved_config": self.at("resolved_config.yaml"), "run_metadata": self.at("run_metadata.json"), "artifact_manifest": self.at("artifact_manifest.json"),
        }


def _revision(folder: str) -> str | None:
    done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True) if os.path.isdir(folder) else None
    return done.stdout.strip() or None if done is not None and done.returncode == 0 else None


def prepare_run(stage: str, folder: str, settings: dict[str, Any], name: str | None = None, rank: int = 0, dry_run: bool = False) -> Run:
    """The folders of a run; the process of rank 0 also writes its resolved settings and where and when it ran."""
    run = Run(name or os.path.basename(os.path.abspath(folder)), stage, folder)
    places = run.places()
    for place in (os.path.dirname(places["metrics_jsonl"]), places["tensorboard_dir"], places["artifact_dir"]):
        os.makedirs(place, exist_ok=True)
    if rank == 0:
        plain = {k: v if isinstance(v, (str, int, float, bool, list, dict, type(None))) else str(v) for k, v in settings.items()}
        write_yaml(places["resolved_config"], {"stage": stage, "run_name": run.name, "settings": plain})
        where = {"hostname": socket.gethostname(), "python": platform.python_version(), "working_dir": os.getcwd(), "revision": _revision(os.getcwd()), "environment": {k: os.environ[k] for k in KEPT if k in os.environ}}
        write_json(places["run_metadata"], {"stage": stage, "run_name": run.name, "created_at_utc": datetime.datetime.now(datetime.timezone.utc).isoformat(), "dry_run": dry_run, "output_dir": folder, **places, **where})
    return run


def write_run_manifest(run: Run, extra: dict[str, Any] | None = None) -> str:
    """A small file that points to the outputs of a run and names its checkpoints in order."""
    places = run.places()
    found = sorted(n for n in os.listdir(run.folder) if n.startswith("checkpoint-") and os.path.isdir(run.at(n)))
    write_json(places["artifact_manifest"], {"run_name": run.name, "output_dir": run.folder, "checkpoints": found, **{k: v for k, v in places.items() if k != "artifact_manifest"}, **(extra or {})})
    return places["artifact_manifest"]
