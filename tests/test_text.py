"""Hand-made rows for text, types, fields and boxes."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import boxes, extract, report
from pagemill.plans import catalog


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("r")).first().r


CASES = [
    (tx.normalize_amount, [("¥1,234.56", 1234.56), ("1234.56", 1234.56), ("￥1,234.56元", 1234.56), ("CNY 1234.56", 1234.56), ("12.", 12.0), ("abc, 12", None), ("", None), (None, None)]),
    (tx.normalize_date, [("2024-01-15", "2024-01-15"), ("2024/1/5", "2024-01-05"), ("2024年01月15日", "2024-01-15"), ("20240115", "2024-01-15"), ("2024-99-99", "2024-99-99"), ("none", None)]),
    (tx.normalize_phone, [("123456789", None), ("123-456-7890", "1234567890"), ("1234567890123", "1234567890123"), ("12345678901234", None)]),
    (tx.correct_words, [("detect", "datect"), ("发票Invioce号", "发票invoice号"), ("发票 invioce号", "发票 invioce号"), ("TOTAL Amout", "total amount"), ("INVIOCE发", "invoice发")]),
    (tx.remove_noise, [("", ""), (".", ""), ("--", ""), ("---", ""), ("¥12.5%", "12.5"), ("_", ""), ("a\n\n..\n---\nb.", "a\n\nb"), ("__", ""), ("_a_", "_a_")]),
    (tx.fullwidth_to_halfwidth, [("Ａ１ｚ（：", "A1z（：")]),
    (tx.normalize_whitespace, [("a  b\n\n\n\nc\t\t", "a b\n\nc\t\t")]),
    (tx.clean_ocr_text, [("　a \t b\n\n\n\nc ", "a b\n\nc"), (None, "")]),
    (tx.process_text, [("Ｉnvioce  １２\n..\n", "invoice 12"), (None, "")]),
    (tx.company_name, [("购买方：客户甲有限公司，", "客户甲有限公司"), ("某某Ltd.", "某某Ltd."), ("none", None)]),
    (tx.text_lines, [(" a \n　\n b", ["a", "b"])]),
]


@pytest.mark.parametrize("f,value,want", [(f, v, w) for f, rows in CASES for v, w in rows])
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("a,b,want", [("", "x", 0), ("abc", "CBA", 100), ("ab", "cd", 0), ("abc", "abd", 50), (None, "a", 0)])
def test_similarity(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(tx.similarity("a", "b").alias("r")).first().r == want


@pytest.mark.parametrize(
    "text,standard,lite",
    [("INVOICE", "invoice", "unknown"), ("发票 收据", "invoice", "invoice"), ("报价单", "quotation", "unknown"), ("", "unknown", "unknown"), ("合同 协议 发票", "contract", "contract")],
)
def test_types(spark, text, standard, lite):
    frame = spark.createDataFrame([(text,)], "t string")
    assert tuple(frame.select(extract.document_type(F.col("t")), extract.document_type(F.col("t"), "lite")).first()) == (standard, lite)


def fields(spark, text, **options):
    frame = spark.createDataFrame([(text, "receipt")], "full_text string, hint string")
    return {f.field_type: f for f in extract.extract(frame, **options).first().fields}


def test_second_pattern_wins_only_if_better(spark):
    got = fields(spark, "发票\n12345678")
    assert got["invoice_number"].value == "12345678" and round(got["invoice_number"].confidence, 6) == 0.8
    assert fields(spark, "发票号码：12345678 99999999")["invoice_number"].value == "12345678"


def test_empty_capture_is_a_field(spark):
    got = fields(spark, "发票 备注: 　x"), fields(spark, "备注:　　\n　")
    assert got[0]["remarks"].value == "x"
    assert all(f.value == f.value.strip() for f in got[1].values())


def test_failed_validity_and_hint(spark):
    got = fields(spark, "大写壹佰（¥100）")
    assert got["amount_total"].value == "¥100" and round(got["amount_total"].confidence, 6) == 0.8
    assert set(fields(spark, "发票号码：12345678 Total: 5", hint="hint")) == {"amount_total"}


def test_all_fields_and_high_count(spark):
    frame = spark.createDataFrame([("Page 3 Currency: CNY",)], "full_text string")
    got = extract.summary(extract.extract(frame, every=True)).first()
    assert {f.field_type: f.value for f in got.fields} == {"page_number": "3", "currency": "CNY"} and got.total_fields == 2


def test_lite_scores(spark):
    got = fields(spark, "合同编号：A 总计：￥12.50", profile="lite")
    assert got["contract_number"].confidence == 0.75 and got["amount_total"].confidence == 0.85


def test_catalog():
    assert {c: len(catalog.by_category(c)) for c in ("identification", "temporal", "entity", "monetary", "contact", "metadata")} == {"identification": 5, "temporal": 2, "entity": 5, "monetary": 4, "contact": 2, "metadata": 5}
    assert catalog.route("standard", "quotation") == catalog.route("standard", "unknown")


@pytest.mark.parametrize("a,b,want", [((0, 0, 10, 10), (10, 0, 10, 10), 0.0), ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0), ((0, 0, 10, 10), (0, 0, 5, 10), 0.5)])
def test_iou(spark, a, b, want):
    box = lambda v: F.struct(*[F.lit(x).alias(k) for k, x in zip("xywh", v, strict=True)])
    assert spark.range(1).select(boxes.iou(box(a), box(b)).alias("r")).first().r == want


@pytest.mark.parametrize("y,h,w,want", [(145, 10, 10, "body"), (140, 10, 10, "header"), (100, 31, 10, "title"), (895, 10, 10, "body"), (896, 10, 10, "footer"), (300, 10, 501, "title"), (395, 10, 501, "body"), (0, 30, 10, "header")])
def test_position(spark, y, h, w, want):
    frame = spark.createDataFrame([(0, y, w, h)], "x int, y int, w int, h int")
    assert frame.select(boxes.class_by_position(1000, 1000).alias("r")).first().r == want


def test_kept_boxes_overlap_little(spark):
    rows = [(1, i, 7 * i % 40, 5 * i % 30, 30, 20, 0.6 + i % 3 / 10) for i in range(40)]
    kept = boxes.suppress(spark.createDataFrame(rows, "doc_id long, region_idx long, x int, y int, w int, h int, confidence double")).collect()

    def iou(a, b):
        i = max(0, min(a.x + a.w, b.x + b.w) - max(a.x, b.x)) * max(0, min(a.y + a.h, b.y + b.h) - max(a.y, b.y))
        return i / (a.w * a.h + b.w * b.h - i)

    assert kept and all(iou(a, b) < 0.3 for a in kept for b in kept if a != b)


def test_html_is_escaped(spark):
    frame = spark.createDataFrame([("备注：<b>&",)], "full_text string")
    got = extract.extract(frame).select(report.html(F.lit("d"), F.col("document_type"), F.col("fields"), F.col("full_text")).alias("h")).first().h
    assert "&lt;b&gt;&amp;" in got and "<b>" not in got
