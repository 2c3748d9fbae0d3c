"""Gate thresholds: code defaults and the shipped settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class QualityGate:
    """limits of the quality gate; a value equal to its limit passes. The numbers here and below are fixed values."""

    min_coverage: float = 0.04
    min_legibility: float = 0.55
    min_words: int = 4
    min_sharpness: float = 35.0
    min_char_h: float = 10.0
    max_char_h_cv: float = 0.80
    max_line_angle_std: float = 12.0
    min_centrality: float = 0.35
    max_border_ratio: float = 0.35
    min_char_density: float = 80.0
    min_text_density: float = 20.0
    max_clutter: float = 0.18
    min_contrast: float = 0.08
    min_side: int = 512
    max_side: int = 4096
    min_ar: float = 0.35
    max_ar: float = 3.0
    watermark: bool = True
    require_language: bool = True
    languages: tuple[str, ...] = ()

    @staticmethod
    def shipped() -> QualityGate:
        return QualityGate(
            min_coverage=0.25, min_legibility=0.5, min_sharpness=50.0, max_char_h_cv=0.75, max_line_angle_std=60.0, min_centrality=0.15,
            max_border_ratio=0.30, min_char_density=3.0, min_text_density=23.0, min_contrast=0.07, min_side=384, require_language=False,
        )

    @staticmethod
    def of(settings: dict) -> QualityGate:
        known = {f.name for f in fields(QualityGate)}
        return QualityGate(**{k: v for k, v in settings.items() if k in known})


@dataclass(frozen=True)
class Minima:
    """minima per dimension."""

    topic: float
    subtopic: float
    combined: float
    enabled: bool = True


SEMANTIC = Minima(0.55, 0.57, 0.55)
TEXT = Minima(0.2, 0.23, 0.2)


@dataclass(frozen=True)
class Settings:
    quality: QualityGate = field(default_factory=QualityGate.shipped)
    semantic: Minima = SEMANTIC
    text: Minima = TEXT
    max_distance: int = 3
    dedup_scope: str = "global"
    round_size: int = 1000
    top_k: int = 10
    semantic_window: int = 2
