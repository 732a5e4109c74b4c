"""Settings, and the hash of settings by which stages know what was done with them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Clips:
    target_s: float = 16.0
    min_s: float = 8.0
    max_s: float = 30.0
    stride_ratio: float = 1.0


@dataclass(frozen=True)
class Scenes:
    min_s: float = 120.0
    max_s: float = 300.0


@dataclass(frozen=True)
class Speech:
    max_words: int = 60
    max_seconds: float = 20.0
    no_speech_threshold: float = 0.6
    min_avg_logprob: float = -1.0
    align_window_s: float = 20.0
    align_pad_s: float = 0.5


@dataclass(frozen=True)
class Retrieval:
    level: int = 0
    top_k: int = 20
    max_gap_s: float = 2.0
    rrf_k: int = 60


@dataclass(frozen=True)
class Settings:
    """All defaults; `strategy` other than fixed is refused."""

    strategy: str = "fixed"
    clips: Clips = field(default_factory=Clips)
    scenes: Scenes = field(default_factory=Scenes)
    speech: Speech = field(default_factory=Speech)
    retrieval: Retrieval = field(default_factory=Retrieval)
    silent_words_per_s: float = 0.3
    vfr_tolerance_fps: float = 0.05

    def __post_init__(self):
        if self.strategy != "fixed":
            raise NotImplementedError(f"the strategy {self.strategy!r} isn't available, only 'fixed'")

    def stage(self, name: str) -> dict[str, Any]:
        """What a stage depends on; anything else may change without making it run again."""
        whole = asdict(self)
        speech = whole["speech"]
        limits = {k: speech[k] for k in ("max_words", "max_seconds")}
        return {
            "ingest": {"vfr_tolerance_fps": self.vfr_tolerance_fps},
            "transcribe": {"asr": {k: speech[k] for k in ("no_speech_threshold", "min_avg_logprob")}, "sentence": limits},
            "align": {"align": {k: speech[k] for k in ("align_window_s", "align_pad_s")}, "sentence": limits},
            "segment": {k: whole[k] for k in ("strategy", "clips", "scenes", "silent_words_per_s")},
            "index": {"level": self.retrieval.level},
        }[name]


def _parsed(path: Path) -> dict[str, Any]:
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("settings in YAML need the package yaml; JSON needs none") from e
        return yaml.safe_load(path.read_text()) or {}
    return json.loads(path.read_text())


def load_settings(path: str | Path) -> Settings:
    """Settings from a JSON or YAML file with any of the groups of fields; what isn't given keeps its default."""
    groups = {"clips": Clips, "scenes": Scenes, "speech": Speech, "retrieval": Retrieval}
    return Settings(**{k: groups[k](**(v or {})) if k in groups else v for k, v in _parsed(Path(path)).items()})


def config_hash(config: dict[str, Any]) -> str:
    """The first 16 hex digits of the sha256 of the JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
