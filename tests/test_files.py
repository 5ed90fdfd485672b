"""Images, sources, settings and streams."""

import json
import struct
import zlib

import numpy as np
import pytest

from pagemill import config
from pagemill.operators import images
from pagemill.plans import document
from pagemill.sinks import files as sinks
from pagemill.sources import files, ocr
from pagemill.streaming import landing


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def page() -> np.ndarray:
    p = np.full((200, 300, 3), 255, np.uint8)
    p[12:20, 40:240] = 0
    for y in range(60, 150, 18):
        p[y : y + 10, 30:120] = 0
    p[150:180, 220:250] = (220, 20, 20)
    return p


def test_kernels():
    p = page()
    gray = images.to_gray(p)
    assert gray[0, 0] == 255 and images.to_rgb(gray).shape == p.shape and images.shrink(p, 100).shape == (66, 100, 3)
    assert images.otsu_threshold(np.array([[10, 10, 200, 200]], np.uint8)) in range(10, 200)
    for method in ("otsu", "adaptive", "sauvola", "other"):
        assert set(np.unique(images.binarize(gray, method))) <= {0, 255}
    assert images.denoise(np.full((9, 9), 7, np.uint8)).tolist() == np.full((9, 9), 7).tolist()
    assert images.equalize(gray).shape == gray.shape
    assert images.rotate(gray, 90).shape == (300, 200) and images.rotate(gray, 0).tolist() == gray.tolist()


def test_components():
    mask = np.zeros((6, 8), bool)
    mask[0, 0] = mask[1, 1] = mask[2, 0] = True
    mask[4:6, 5:8] = True
    assert sorted(map(tuple, images.components(mask).tolist())) == [(0, 0, 2, 3, 3), (5, 4, 3, 2, 6)]
    assert len(images.components(np.zeros((3, 3), bool))) == 0


def test_grow_and_erode():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert images.grow(mask, 3, 5).sum() == 15 and images.erode(images.grow(mask, 3, 5), 3, 5).sum() == 1


def test_skew_is_found():
    line = np.full((400, 400), 255, np.uint8)
    line[60:340:40, 40:360] = line[61:341:40, 40:360] = 0
    assert images.skew(line) == 0.0
    assert abs(abs(images.skew(images.rotate(line, 5.0))) - 5.0) <= 1.0


def test_skew_is_found_to_45_degrees():
    page = np.full((300, 300), 255, np.uint8)
    page[40:260:20, 30:270] = page[41:260:20, 30:270] = 0
    for turned in (-40.0, -20.0, 30.0):
        assert abs(abs(images.skew(images.rotate(page, turned))) - abs(turned)) <= 1.0
        assert images.skew(images.rotate(page, turned)) * images.skew(images.rotate(page, -turned)) < 0


def test_layout():
    got = images.layout_boxes(images.binarize(images.to_gray(page()), "otsu"), page())
    assert [g[4] for g in got] == ["title", "header", "seal"]
    assert any(w > 100 and h < 20 for x, y, w, h, _ in images.contour_boxes(page()))


def test_folder_of_images(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(png(page()))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("no")
    assert [r.path[-5:] for r in files.scan(spark, str(tmp_path)).select("path").collect()] == ["a.PNG", "b.png"]
    read = files.images(spark, str(tmp_path))
    assert sorted(r.success for r in files.decoded(read).collect()) == [False, True]
    got = {r.path[-5:]: r for r in images.analyse(read).collect()}
    assert got["a.PNG"].success and {x.region_type for x in got["a.PNG"].layout} >= {"seal"} and not got["b.png"].success and got["b.png"].error


def test_images_to_results(spark, tmp_path):
    """PNG files and recognized lines in, JSON, report and overlay out."""
    from pagemill.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png(page()))
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    (tmp_path / "in" / "c.png").write_bytes(images.png(np.full((50, 60), 255, np.uint8)))
    path = files.images(spark, str(tmp_path / "in")).filter("image.origin like '%a.png'").first().image.origin
    texts = ["增值税发票", "发票号码：１２３４５６７８", " ", "价税合计：¥99.50", "unsure: Tel 138-1234-5678"]
    lines = [dict(path=path, line_idx=i, text=t, confidence=0.9 if i < 4 else 0.2, x=30, y=60 + 18 * i, w=90, h=10) for i, t in enumerate(texts)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(x) for x in lines))
    own = config.Settings()
    own.ocr.confidence_threshold, own.detection.method = 0.5, "contour_only"
    own.preprocess.remove_borders, own.preprocess.deskew, own.preprocess.binarize_method = False, False, "otsu"
    config.save(own, str(tmp_path / "s.json"))
    main(["process", str(tmp_path / "in"), str(tmp_path / "out"), "--lines", str(tmp_path / "lines.json"), "--settings", str(tmp_path / "s.json")])
    got = {r["image_path"][-5:]: r for r in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "out" / "json")).collect())}
    a, b, c = got["a.png"], got["b.png"], got["c.png"]
    assert a["success"] and "error" not in a and "warnings" not in a
    assert a["extraction"]["document_type"] == "invoice" and a["extraction"]["fields"]["invoice_number"]["value"] == "12345678"
    assert "receiver_phone" not in a["extraction"]["fields"] and a["ocr"]["total_lines"] == 4
    assert a["detection"]["total_regions"] > 0 and {"load", "preprocess", "detection", "layout"} == set(a["processing_times_ms"])
    assert not b["success"] and b["error"] and b["extraction"] is None and b["ocr"] is None
    assert c["success"] and c["warnings"] == ["no text was recognized"] and c["detection"]["total_regions"] == 0
    rows = {r.path[-5:]: r for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()}
    assert {r.method if "method" in r else "contour" for r in rows["a.png"].regions} == {"contour"} and all(r.confidence == 0.6 for r in rows["a.png"].regions)
    told = {r.path[-5:]: r for r in spark.read.parquet(str(tmp_path / "out" / "reports")).collect()}
    assert set(told) == {"a.png", "c.png"} and told["a.png"].svg.count("<rect") >= a["detection"]["total_regions"] and "12345678" in told["a.png"].html


def test_method_of_detection():
    gray = images.to_gray(page())
    kinds = lambda m: {b[5] for b in images.found_boxes(gray, config.Detection(method=m))}
    assert kinds("mser_only") == {"mser"} and kinds("contour_only") == {"contour"} and kinds("mser_contour") == kinds("odd") == {"mser", "contour"}


def _ink(settings):
    """An engine that reads how dark an image is, and its size."""

    def read(image):
        dark = int((images.to_gray(image) < 128).sum())
        return [(f"{image.shape[1]}x{image.shape[0]}", 0.5, 0, 0, 1, 1), (" ", 0.1, 0, 0, 1, 1)] if dark else []

    return read


def test_engines_read_pages_and_regions(spark, tmp_path, monkeypatch):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
    monkeypatch.setitem(ocr.ENGINES, "ink", (_ink, "numpy"))
    (tmp_path / "a.png").write_bytes(images.png(page()))
    (tmp_path / "b.png").write_bytes(b"broken")
    rows = files.images(spark, str(tmp_path))
    got = ocr.recognize(rows, "ink").collect()
    assert sorted((r.path[-5:], r.success, r.line_idx) for r in got) == [("a.png", True, 0), ("a.png", True, 1), ("b.png", False, -1)]
    origin = rows.filter("image.height > 0").first().image.origin
    asked = spark.createDataFrame([(origin, 0, 30, 60, 90, 10), (origin, 1, 0, 0, 10, 10), (origin, 2, 290, 190, 50, 50), (origin, 3, 219, 149, 5, 5)], "path string, region_idx long, x int, y int, w int, h int")
    read = {r.region_idx: (r.text, r.confidence) for r in ocr.recognize_regions(rows, asked, "ink").collect()}
    assert read == {0: ("96x16", 0.5), 1: ("", 0.0), 2: ("", 0.0), 3: ("11x11", 0.5)}
    own = config.Settings()
    own.ocr.engine = "ink"
    done = {r.path[-5:]: r for r in document.process(rows, settings=own).collect()}
    assert done["a.png"].success and "ocr" in done["a.png"].timings and done["a.png"].full_text and not done["b.png"].success


def test_saved_images_are_the_same(spark, tmp_path):
    (tmp_path / "in").mkdir(), (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(page()))
    saved = sinks.save_images(files.images(spark, str(tmp_path / "in")), str(tmp_path / "out")).collect()
    again = files.images(spark, str(tmp_path / "out")).first().image
    assert len(saved) == 1 and (images.pixels_of(again) == page()).all()


def filtered_png(image: np.ndarray, colour: int) -> bytes:
    """Each row by another of the five filters."""
    h, w, n = image.shape
    rows, above = [], np.zeros((w, n), int)
    for y in range(h):
        row = image[y].astype(int)
        left = np.vstack([np.zeros((1, n), int), row[:-1]])
        corner = np.vstack([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        near = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        nearest = np.choose(near.argmin(axis=0), [left, above, corner])
        guess = [0, left, above, (left + above) // 2, nearest][y % 5]
        rows.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_bytes_decode_as_files_do(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name, n, colour in (("rgb", 3, 2), ("gray", 1, 0), ("alpha", 4, 6)):
        image = rng.integers(0, 256, (11, 7, n)).astype(np.uint8)
        data = filtered_png(image, colour)
        assert (images.decode(data).reshape(11, 7, -1) == image[..., :3]).all(), name
        if n < 4:
            (tmp_path / f"{name}.png").write_bytes(data)
    (tmp_path / "bad.png").write_bytes(b"broken")
    flat = b"".join(bytes([1, 2, 3] * 3 + [0] * 3) for _ in range(2))
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(flat), 0, 0, 54, 40, 3, 2, 1, 24, 0, len(flat), 0, 0, 0, 0) + flat
    assert images.decode(bmp).tolist() == [[[3, 2, 1]] * 3] * 2
    read = {r.image.origin[-7:]: images.pixels_of(r.image) if r.image.height > 0 else None for r in files.images(spark, str(tmp_path)).collect()}
    got = {r.image.origin[-7:]: images.pixels_of(r.image) if r.image.height > 0 else None for r in files.from_bytes(files.scan(spark, str(tmp_path))).collect()}
    assert set(read) == set(got) and all((read[k] is None and got[k] is None) or (read[k] == got[k]).all() for k in read)


def test_images_that_land(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png(page()))
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    landing.start_images(landing.images(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.path[-5:]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a.png"].success and got["a.png"].regions is not None and not got["b.png"].success


def test_hash_of_an_image():
    steps = np.tile(np.arange(90, dtype=np.uint8) * 2, (40, 1))
    assert images.difference_hash(steps) == "f" * 16 and images.difference_hash(steps[:, ::-1]) == "0" * 16
    assert images.difference_hash(np.repeat(np.repeat(steps, 2, 0), 2, 1)) == "f" * 16


def test_lite_clean_up_keeps_hue():
    out = images.lite_enhance(np.full((10, 10, 3), (200, 100, 50), np.uint8))
    assert out.shape == (10, 10, 3) and (out[..., 0] >= out[..., 1]).all() and (out[..., 1] >= out[..., 2]).all()


def test_templates(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"document_type": "k", "name": "n", "field_types": ["a"], "layout_hints": {"x": "y"}}, indent=1))
    (tmp_path / "two.json").write_text(json.dumps({"name": "m"}))
    (tmp_path / "bad.json").write_text("{")
    assert {r.document_type: r.name for r in files.templates(spark, str(tmp_path)).collect()} == {"k": "n", "two": "m"}


def test_engines(spark):
    words = spark.createDataFrame([("a", 90.0, 1, 1), (" ", 90.0, 1, 1), ("b", -1.0, 1, 1), ("c", 50.0, 0, 1)], "text string, conf double, w int, h int")
    assert [(r.text, r.confidence) for r in files.engine_words(words).collect()] == [("a", 0.9)]
    quads = spark.createDataFrame([(1, 0, [(1.9, 2.0), (5.5, 2.2), (5.0, 9.9)], "t", "0.5"), (1, 1, [(0.0, 0.0)], " ", "x")], "doc_id long, idx long, pts array<struct<x:double,y:double>>, text string, conf string")
    assert [tuple(r) for r in files.quads_to_lines(quads).collect()] == [(1, 0, "t", 0.5, 1, 2, 4, 7)]
    assert "precomputed" in ocr.available() and ocr.recognize(words) is words
    with pytest.raises(ValueError):
        ocr.recognize(words, "none")


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    own = config.Settings()
    own.detection.nms_threshold = 0.5
    config.save(own, path)
    assert config.load(path) == own
    (tmp_path / "t.json").write_text('{"image": {"max_dimension": 9, "odd": 1}, "more": 2}')
    assert config.load(str(tmp_path / "t.json")).image.max_dimension == 9


def test_stream_is_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"doc_id": 1, "full_text": "发票号码：12345678", "document_type_hint": "auto"}, {"doc_id": 2, "full_text": "Total: 5", "document_type_hint": "receipt"}]
    (tmp_path / "in" / "p.json").write_text("\n".join(json.dumps(r) for r in rows))
    out = str(tmp_path / "out")
    landing.start(landing.pages(spark, str(tmp_path / "in")), out, str(tmp_path / "check")).awaitTermination()
    got = {r.doc_id: r for r in spark.read.parquet(out).collect()}
    assert got[1].document_type == "invoice" and got[1].total_fields == 1 and got[2].document_type == "receipt" and "amount_total" in got[2].fields


def test_command_writes_results(spark, tmp_path, capsys):
    from pagemill.__main__ import main

    (tmp_path / "pages.json").write_text(json.dumps({"doc_id": 1, "full_text": "发票号码：12345678\n备注: a\"b,c"}))
    main(["extract", str(tmp_path / "pages.json"), str(tmp_path / "out"), "--form", "both"])
    got = json.loads(spark.read.text(str(tmp_path / "out" / "json")).first().value)
    assert got["doc_id"] == 1 and got["result"]["fields"]["invoice_number"]["value"] == "12345678"
    rows = spark.read.option("escape", '"').csv(str(tmp_path / "out" / "csv"), header=True).collect()
    assert {r.field_type: r.value for r in rows} == {"invoice_number": "12345678", "remarks": 'a"b,c'}
    main(["config"])
    assert json.loads(capsys.readouterr().out.split("\n\n")[-1])["detection"]["nms_threshold"] == 0.3
    with pytest.raises(SystemExit):
        main(["extract"])


def test_logger_is_set_up_once():
    from pagemill.sinks.files import logger

    assert logger("x") is logger("x") and len(logger("x").handlers) == 1
