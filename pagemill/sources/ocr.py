"""Recognition engines: a registry; each turns an image into lines.

``precomputed`` reads lines that are already there and is the default.  Other
engines load only where their library is installed.
"""

from __future__ import annotations

import importlib.util
import sys
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.config import Ocr, Settings
from pagemill.operators.images import enhance, pixels_of, shrink

Line = tuple[str, float, int, int, int, int]


def _tesseract(settings: Ocr) -> Callable[[np.ndarray], list[Line]]:
    import pytesseract

    def read(image: np.ndarray) -> list[Line]:
        d = pytesseract.image_to_data(image, lang=settings.language, config=settings.tesseract_config, output_type=pytesseract.Output.DICT)
        rows = zip(d["text"], d["conf"], d["left"], d["top"], d["width"], d["height"], strict=True)
        return [(t.strip(), float(c) / 100, x, y, w, h) for t, c, x, y, w, h in rows if t.strip() and float(c) >= 0 and w > 0 and h > 0]

    return read


def _box(points) -> tuple[int, int, int, int]:
    p = np.array(points).astype(int)
    (x, y), (x2, y2) = p.min(axis=0), p.max(axis=0)
    return int(x), int(y), int(x2 - x), int(y2 - y)


def _easyocr(settings: Ocr) -> Callable[[np.ndarray], list[Line]]:
    import easyocr

    reader = easyocr.Reader(settings.language.split("+"), gpu=settings.easyocr_gpu)
    return lambda image: [(t, float(c), *_box(p)) for p, t, c in reader.readtext(image)]


def _rapidocr(settings: Ocr) -> Callable[[np.ndarray], list[Line]]:
    from rapidocr_onnxruntime import RapidOCR

    engine = RapidOCR()
    return lambda image: [(t.strip(), float(c), *_box(p)) for p, t, c in (engine(image)[0] or []) if t.strip()]


ENGINES = {"tesseract": (_tesseract, "pytesseract"), "easyocr": (_easyocr, "easyocr"), "rapidocr": (_rapidocr, "rapidocr_onnxruntime")}
SCHEMA = "path string, success boolean, error string, took double, line_idx int, text string, confidence double, x int, y int, w int, h int"


def available() -> list[str]:
    return ["precomputed", *[k for k, (_, library) in ENGINES.items() if importlib.util.find_spec(library)]]


REGIONS = "path string, success boolean, error string, region_idx bigint, text string, confidence double"


def _reader(name: str, settings: Settings):
    make = ENGINES[name][0]

    def run(frames):
        engine = None  # once a worker task
        for frame in frames:
            out = []
            for _, row in frame.iterrows():
                try:
                    engine = engine or make(settings.ocr)
                    gray = enhance(shrink(pixels_of(row), settings.image.max_dimension), settings.preprocess)[1]
                    began = time.perf_counter()
                    lines = engine(gray)
                    took = round((time.perf_counter() - began) * 1000, 1)
                    out += [(row["origin"], True, None, took, i, *line) for i, line in enumerate(lines)] or [(row["origin"], True, None, took, -1, "", 0.0, 0, 0, 0, 0)]
                except Exception as e:  # an engine failure is that page's error
                    out.append((row["origin"], False, f"{type(e).__name__}: {e}", None, -1, "", 0.0, 0, 0, 0, 0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def _region_reader(name: str, settings: Settings, pad: int):
    make = ENGINES[name][0]

    def run(frames):
        engine = None
        for frame in frames:
            out = []
            for _, row in frame.iterrows():
                try:
                    engine = engine or make(settings.ocr)
                    page = shrink(pixels_of(row), settings.image.max_dimension)
                    for r in row["regions"]:
                        own = page[max(0, r["y"] - pad) : max(0, r["y"] + r["h"] + pad), max(0, r["x"] - pad) : max(0, r["x"] + r["w"] + pad)]
                        lines = [x for x in engine(own) if x[0].strip()] if own.size else []
                        mean = float(np.mean([x[1] for x in lines])) if lines else 0.0
                        out.append((row["origin"], True, None, r["region_idx"], " ".join(x[0].strip() for x in lines), mean))
                except Exception as e:  # an engine failure is that page's error
                    out.append((row["origin"], False, f"{type(e).__name__}: {e}", None, "", 0.0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REGIONS.split(", ")])

    return run


def _checked(engine: str) -> str:
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine}")
    return engine


def recognize(images: DataFrame, engine: str = "precomputed", settings: Settings | None = None) -> DataFrame:
    """Lines of images by an engine; precomputed lines pass as they are.

    A page without text is one row of line_idx -1.
    """
    if engine == "precomputed":
        return images
    read = _reader(_checked(engine), settings or Settings())
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(read, SCHEMA)


def recognize_regions(images: DataFrame, regions: DataFrame, engine: str, settings: Settings | None = None, pad: int = 3) -> DataFrame:
    """The text and mean confidence of each region (path, region_idx, x, y, w, h).

    A region is read with ``pad`` pixels around it, cut at the page's edge; its
    words are joined by spaces.
    """
    own = regions.groupBy("path").agg(F.collect_list(F.struct("region_idx", "x", "y", "w", "h")).alias("regions"))
    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").join(own, F.col("origin") == F.col("path")).drop("path")
    return rows.mapInPandas(_region_reader(_checked(engine), settings or Settings(), pad), REGIONS)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
