"""Settings of a run, with their defaults; each has an effect in plans/document.py or the command."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass


# The keys and defaults of a settings file.
@dataclass
class Image:
    max_dimension: int = 4096
    color_mode: str = "rgb"
    allowed_formats: tuple = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")


@dataclass
class Preprocess:
    denoise: bool = True
    denoise_ksize: int = 3
    binarize: bool = True
    binarize_method: str = "adaptive"
    binarize_block_size: int = 31
    deskew: bool = True
    clahe: bool = True
    clahe_clip_limit: float = 2.0
    remove_borders: bool = True


@dataclass
class Detection:
    method: str = "mser_contour"
    min_region_area: int = 100
    max_region_area: int = 50_000
    min_aspect_ratio: float = 0.1
    max_aspect_ratio: float = 10.0
    nms_threshold: float = 0.3


@dataclass
class Ocr:
    engine: str = "tesseract"
    language: str = "chi_sim+eng"
    tesseract_config: str = "--psm 6"
    easyocr_gpu: bool = False
    confidence_threshold: float | None = None


@dataclass
class Extraction:
    document_type: str = "auto"
    confidence_threshold: float = 0.6


@dataclass
class Output:
    format: str = "json"
    output_dir: str = "output"
    save_annotated_image: bool = True
    generate_html_report: bool = True


@dataclass
class Settings:
    image: Image = field(default_factory=Image)
    preprocess: Preprocess = field(default_factory=Preprocess)
    detection: Detection = field(default_factory=Detection)
    ocr: Ocr = field(default_factory=Ocr)
    extraction: Extraction = field(default_factory=Extraction)
    output: Output = field(default_factory=Output)


def _fill(kind, values: dict):
    """Unknown keys are left out, missing ones keep their defaults."""
    known = {f.name: getattr(kind(), f.name) for f in fields(kind)}
    own = {k: v for k, v in values.items() if k in known}
    return kind(**{k: _fill(type(known[k]), v) if is_dataclass(known[k]) and isinstance(v, dict) else tuple(v) if isinstance(known[k], tuple) else v for k, v in own.items()})


def load(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        return _fill(Settings, json.load(f))


def save(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(show(settings))


def show(settings: Settings) -> str:
    return json.dumps(asdict(settings), indent=2, ensure_ascii=False)
