"""Configuration, provenance and the run of a job in checked stages."""

from __future__ import annotations

import hashlib
import json
import os
import platform
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load_config(path: str) -> dict:
    """A YAML file (JSON is YAML too) as a dictionary; JSON alone where no YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def arm_configs(base: dict, arms: dict[str, dict], stage: str) -> dict[str, dict]:
    """arm -> the base with the arm's changes and paths of its own; keys the base doesn't know are refused."""
    out = {}
    for arm, changes in arms.items():
        strange = set(changes) - set(base)
        if strange:
            raise KeyError(f"{arm}: {sorted(strange)}")
        own = json.loads(json.dumps(base)) | changes
        own["paths"] = {k: os.path.join(v, stage, arm) for k, v in base.get("paths", {}).items()}
        out[arm] = own
    return out


def check_judge(config: dict) -> None:
    """A report may be judged by its own model only if the configuration says so."""
    if config.get("judge_model") == config.get("report_model") and not config.get("same_model_judge"):
        raise ValueError("judge_model equals report_model without same_model_judge")


def load_plan(path: str, required: tuple[str, ...] = ("name", "command", "expected", "log_dir"), repository: str | None = None) -> dict:
    """A job's plan with environment variables filled in; its logs may not lie inside the repository."""
    plan = load_config(path)
    missing = [k for k in required if k not in plan]
    if missing:
        raise KeyError(f"{path}: {missing}")
    plan["command"] = [os.path.expandvars(str(c)) for c in plan["command"]]
    plan["log_dir"] = os.path.expandvars(str(plan["log_dir"]))
    if repository and Path(plan["log_dir"]).resolve().is_relative_to(Path(repository).resolve()):
        raise ValueError("log_dir lies inside the repository")
    return plan


def plan_hash(plan: dict) -> str:
    return hashlib.sha256(json.dumps(plan, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def touches_protected(command: list[str], names: tuple[str, ...] = ("test",)) -> list[str]:
    """The arguments in which the name of a protected split stands."""
    return [c for c in command if any(n in str(c).lower() for n in names)]


def prompt_sources(templates: dict[str, str]) -> dict[str, str]:
    return {name: hashlib.sha256(text.encode()).hexdigest() for name, text in templates.items()}


def run_provenance(spark: SparkSession, requested: dict, effective: dict) -> DataFrame:
    """(key, requested, effective, mismatch): what was asked for against what ran, with the surroundings of the run."""
    around = {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master}
    rows = [(k, _text(requested.get(k)), _text(effective.get(k)), k in requested and requested.get(k) != effective.get(k)) for k in sorted({*requested, *effective})]
    rows += [(k, None, v, False) for k, v in around.items()]
    return spark.createDataFrame(rows, "key string, requested string, effective string, mismatch boolean")


def _text(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


Check = Callable[[], DataFrame]


def contract(checks: dict[str, Check], spark: SparkSession) -> DataFrame:
    """(rule, ok, sample): each rule's violations, of which a few are shown; a rule holds if its table is empty."""
    rows = []
    for rule, violations in checks.items():
        bad = [json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in violations().take(3)]
        rows.append((rule, not bad, bad))
    return spark.createDataFrame(rows, "rule string, ok boolean, sample array<string>")


def run_stages(stages: list[tuple[str, Callable[[], object], dict[str, Check]]], spark: SparkSession, marker: str) -> list[str]:
    """Runs the stages in order, each behind its contract; the marker is written only when all have passed."""
    if os.path.exists(marker):
        raise FileExistsError(marker)
    done = []
    for name, work, checks in stages:
        work()
        bad = contract(checks, spark).where("NOT ok").collect()
        if bad:
            raise ValueError(f"{name}: {[(r.rule, r.sample) for r in bad]}")
        done.append(name)
    Path(marker).write_text(json.dumps(done))
    return done
