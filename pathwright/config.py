"""Parameters of the stages with their defaults, YAML files and the paths in them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

#: Keys whose texts are paths.
PATH_KEYS = {"base_model_path", "config_path", "dataset_path", "input_dir", "model_name_or_path", "model_path", "output_dir", "output_path", "preference_path", "report_dir", "root", "run_root", "sft_adapter_path"}
#: Further ones of this engine: predictions, rollouts, and recorded answers, wordings and judgements in place of an endpoint.
PATH_KEYS |= {"predictions_path", "rollout_path", "recorded_answers", "recorded_wordings", "recorded_judgements"}

#: First folders of a path that stand for a folder of the environment, by its variable and what it is without one.
ALIASES = {"data": ("PROJECT_DATA_DIR", "data"), "models": ("PROJECT_MODEL_DIR", "models"), "outputs": ("PROJECT_OUTPUT_DIR", "outputs"), "runs": ("PROJECT_OUTPUT_DIR", "outputs"), "logs": ("PROJECT_LOG_DIR", "logs"), "cache": ("PROJECT_CACHE_DIR", ".cache"), ".cache": ("PROJECT_CACHE_DIR", ".cache")}


def folders(root: str | Path = ".") -> dict[str, str]:
    """The environment's folders by variable, as absolute paths: what subprocesses are given."""
    base = Path(os.environ.get("PROJECT_ROOT") or root).expanduser().resolve()
    return {"PROJECT_ROOT": str(base)} | {name: str(Path(os.environ.get(name) or base / default).expanduser()) for name, default in dict.fromkeys(ALIASES.values())}


def mapped(path: str, root: str | Path = ".") -> str:
    """A relative path under its alias's folder (runs lie in the outputs' folder), else under the root; absolute paths stay."""
    if os.path.isabs(path):
        return path
    known, (first, *rest) = folders(root), Path(path).parts or (".",)
    if first not in ALIASES:
        return str((Path(known["PROJECT_ROOT"]) / path).resolve())
    inner = ["runs"] if first == "runs" else []
    return str(Path(known[ALIASES[first][0]], *inner, *rest).resolve())


@dataclass(frozen=True)
class Factory:
    output_dir: str
    seed: int
    template_weights: dict[str, int]
    splits: dict[str, float]
    timeout_seconds: int = 20
    question_variants_per_seed: int = 2
    include_canonical_question: bool = True
    question_rewrite_styles: list[str] = field(default_factory=list)
    question_rewrite_temperature: float = 0.6
    question_rewrite_max_tokens: int = 1200
    trajectories_per_variant: int = 3
    trajectory_temperatures: list[float] = field(default_factory=list)
    trajectory_temperature_min: float = 0.25
    trajectory_temperature_max: float = 0.8
    trajectory_max_tokens: int = 2200
    target_verified_samples: int = 120
    num_samples: int | None = None  # an older name of the target
    data_model_env_var: str = "PATHWRIGHT_DATA_MODEL"
    max_seed_problems: int | None = None
    request_timeout_seconds: float = 60
    request_max_retries: int = 2
    request_retry_backoff_seconds: float = 1.5

    def seeds(self) -> int:
        """How many seed problems to try: 40 at least, else one for each `question_variants_per_seed` rows wanted."""
        return self.max_seed_problems or max(40, -(-self.target_verified_samples // max(1, self.question_variants_per_seed)))

    def temperatures(self) -> list[float]:
        n, low, high = self.trajectories_per_variant, self.trajectory_temperature_min, self.trajectory_temperature_max
        return list(self.trajectory_temperatures) or ([0.3] if n <= 1 else [round(low + i * (high - low) / (n - 1), 2) for i in range(n)])


@dataclass(frozen=True)
class Rollout:
    timeout_seconds: int = 20
    teacher_evaluation: bool = False
    seed: int = 2026
    do_sample: bool = True
    temperature: float = 0.8
    top_p: float = 0.9
    max_new_tokens: int = 900
    num_return_sequences: int = 3
    is_adapter: bool = True


@dataclass(frozen=True)
class Compare:
    seed: int = 2026
    target_questions: int = 50
    max_seed_problems: int | None = None
    include_canonical_question: bool = True
    question_variants_per_seed: int = 1
    teacher_evaluation: bool = True


def load(path: str) -> dict[str, Any]:
    """A YAML file with its paths resolved against the file's folder; {} for an empty file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return resolve(yaml.safe_load(f) or {}, Path(path).resolve().parent)


def resolve(value: Any, base: Path) -> Any:
    """Dicts and lists of dicts with the texts of path keys resolved; other lists stay."""
    if isinstance(value, dict):
        return {k: str(local(v, base)) if k in PATH_KEYS and isinstance(v, str) and looks_local(v) else resolve(v, base) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, base) if isinstance(v, dict) else v for v in value]
    return value


def looks_local(text: str) -> bool:
    """The same test as `functions.documents.looks_like_path`, for one text."""
    from .functions.documents import PATH_ENDINGS, PATH_FOLDERS

    if text.startswith(("http://", "https://")):
        return False
    return text.startswith(".") or "/" in text or "\\" in text or text.endswith(tuple(PATH_ENDINGS)) or text in PATH_FOLDERS


def local(text: str, base: Path) -> Path:
    """Absolute paths stay. Else the path under its alias's folder or the root, unless nothing is there while something lies under base."""
    if os.path.isabs(text):
        return Path(text)
    placed, beside = Path(mapped(text)), base / text
    return beside if not placed.exists() and beside.exists() else placed


def stage(kind: type, config: dict[str, Any]) -> Any:
    """A stage's parameters from a config; keys that it does not know are left out."""
    if config.get("target_verified_samples") is None and config.get("num_samples") is not None:
        config = config | {"target_verified_samples": config["num_samples"]}
    return kind(**{f.name: config[f.name] for f in fields(kind) if config.get(f.name) is not None})
