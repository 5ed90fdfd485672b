"""Business documents and boxes made from the supplied tables.

Each is one SELECT that Spark and DuckDB run alike, so a query and its SQL
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_NL = "chr(10)"

INVOICES = f"""
SELECT o_orderkey AS doc_id,
  CASE o_orderkey % 5 WHEN 0 THEN '增值税发票' WHEN 1 THEN '收据' WHEN 2 THEN '对账单' WHEN 3 THEN '采购合同' ELSE 'memo' END || {_NL} ||
  '发票号码：' || lpad(CAST(o_orderkey AS STRING), 10, '0') || {_NL} ||
  '开票日期：' || CAST(year(o_orderdate) AS STRING) || '年' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '月' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '日' || {_NL} ||
  '购买方：' || CASE WHEN o_custkey % 2 = 0 THEN '客户甲公司' ELSE '客户乙公司' END || {_NL} ||
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '价税合计：¥' || CAST(CAST(floor({_CENTS} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({_CENTS} % 100 AS STRING), 2, '0') || {_NL} END ||
  'Tel: 138-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || '-5678' || {_NL} ||
  'Remark: ' || o_orderpriority AS text
FROM orders
"""

def _lines(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


_MONEY = f"CAST(CAST(floor({_CENTS} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')"
_YEAR, _MONTH, _DAY = (f"CAST({part}(o_orderdate) AS STRING)" for part in ("year", "month", "day"))
_KEY = "lpad(CAST(o_orderkey AS STRING), 10, '0')"
_TAX = f"'91110000' || {_KEY}"
_BUYER = "CASE WHEN o_custkey % 2 = 0 THEN '客户甲公司' ELSE '客户乙公司' END"

#: A text for each document type and some for none, with every field somewhere.
_TEXTS = [
    _lines("'增值税发票'", f"'发票代码：' || {_KEY} || '12'", f"'发票号码：' || {_KEY}", f"'开票日期：' || {_YEAR} || '年' || lpad({_MONTH}, 2, '0') || '月' || lpad({_DAY}, 2, '0') || '日'",
           f"'销售方：北方 ' || CASE WHEN o_custkey % 3 = 0 THEN '食品厂' ELSE '贸易公司' END", f"'销方 纳税人识别号：' || {_TAX}", f"'购买方：' || {_BUYER}", f"'购方 纳税人识别号：' || {_TAX}",
           f"'金额：¥' || {_MONEY}", "'税额：¥1,024.50'", "'税率：13%'", f"'价税合计：¥' || {_MONEY}", "'收款人：张三'", "'电话：138-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || '-5678'", "'货物：办公用品'", "'备注：' || o_orderpriority"),
    _lines("'INVOICE'", f"'No. ' || {_KEY}", f"'Date: ' || {_YEAR} || '-' || {_MONTH} || '-' || {_DAY}", "'Seller: North Star 公司'", f"'Buyer: South ' || {_BUYER}", f"'Amount: $' || {_MONEY}", "'Tax: $10.00'", f"'TOTAL: $' || {_MONEY}", "'Payee: Ann'", "'Tel: 010-8888-7777'", "'Note: ' || o_orderpriority"),
    _lines("'收据 receipt'", f"'日期：' || {_YEAR} || '/' || {_MONTH} || '/' || {_DAY}", f"'合计：' || {_MONEY}", "'支付方式：微信'", "'收款人：李四'", "'商户：街角 小店'", "'商品：茶叶'", "'Phone: 010-8888-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')", "'Remark: ' || o_orderpriority"),
    _lines("'对账单 statement'", "'开户行：中国银行'", f"'账号：622200' || {_KEY}", f"'合计：¥' || {_MONEY}", "'收款单位：王五'", f"'日期：' || {_YEAR} || '-' || {_MONTH} || '-' || {_DAY}", "'名称：东方公司'", "'Account: 12345'"),
    _lines("'采购合同'", f"'合同编号：HT-' || {_KEY}", "'卖方：南方 机械厂'", f"'买方：' || {_BUYER}", f"'日期：' || {_YEAR} || '.' || {_MONTH} || '.' || {_DAY}", f"'总金额：¥' || {_MONEY}", "'联系电话：139-1234-5678'", "'地址：北京市 中山路'", "'甲方 乙方 签署'"),
    _lines("'报价单'", "'单价：12.50'", f"'总计：' || {_MONEY}", "'客户：远方 商店'", f"'编号：' || {_KEY}", "'到期：2025-01-02'", "'表格合计：99.5'", "'Page 3'"),
    _lines("'memo'", f"'see ' || {_KEY} || ' and 2024-3-4 of'", "'号码：' || lpad(CAST(o_orderkey AS STRING), 12, '7')", "'时间：2023年4月5日'", "'paid ¥ 12.5 in all'", "'Remark: ' || o_orderpriority"),
    _lines("'收据 合同'", "'大写：壹佰元（¥100.00）'", "'名称：华东商店'", "'Merchant: Corner Shop'"),
    _lines("' '", "''", "' '"),
    _lines("'发票 合同'", f"'No.' || {_KEY}", "'Invoice Date 2022-12-31'", "'Total : 5'", "'Total: 77.00'", "'收款人：'", "'电话：12'", "'备注： '"),
    _lines("'note'", "'币种：CNY'", "'寄件人：赵六'", "'Payment: card'", "'Bank: First Branch'", "'第 2 页'", "'Item Total: 12.50'", f"'Due: ' || {_YEAR} || '-' || {_MONTH} || '-' || {_DAY}", "'税号：ABCDEFGHJKLMNPQ'", "'Address: 长安街'"),
]
BUSINESS = f"""
SELECT o_orderkey AS doc_id, CASE o_orderkey % {len(_TEXTS)} {" ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS))} END AS text
FROM orders
"""

DIRTY = f"""
SELECT doc_id,
  CASE doc_id % 4 WHEN 0 THEN translate(text, '0123456789', '０１２３４５６７８９') WHEN 1 THEN 'Invioce  totla   ' || CAST(doc_id AS STRING) || {_NL} || '..' || {_NL} || '---' || {_NL} || {_NL} || {_NL} || 'The Reciept detect (x).'
    WHEN 2 THEN '发票Invioce号' || {_NL} || '**' || text ELSE 'plain AMOUT, numebr #' || CAST(doc_id AS STRING) || '!' END AS text
FROM ({INVOICES}) i
"""

REGIONS = """
SELECT doc_id, region_idx, x, y, w, h, CASE WHEN f = 'A' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS confidence
FROM (SELECT l_orderkey AS doc_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS region_idx,
    CAST(l_partkey % 200 AS INT) AS x, CAST(l_suppkey % 20 AS INT) AS y, CAST(60 + l_quantity AS INT) AS w, CAST(20 + l_linenumber AS INT) AS h, l_returnflag AS f
  FROM lineitem WHERE l_orderkey IS NOT NULL) r
"""

LAYOUT = """
SELECT doc_id, layout_idx, x, y, w, h, region_type FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_orderkey % 3 <> 0) d
CROSS JOIN (VALUES (0, 0, 0, 300, 12, 'title'), (1, 0, 0, 300, 12, 'header'), (2, 100, 10, 80, 30, 'seal'), (3, 0, 500, 300, 20, 'footer')) AS v(layout_idx, x, y, w, h, region_type)
"""

LINES = """
SELECT doc_id, idx, x, y, w, h, text, confidence FROM (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS BIGINT) AS idx,
    CAST(l_partkey % 300 AS INT) AS x, CAST(l_suppkey % 60 AS INT) AS y, CAST(20 + l_linenumber AS INT) AS w, CAST(8 + l_linenumber AS INT) AS h,
    CASE WHEN l_partkey % 11 = 0 THEN ' ' WHEN l_partkey % 13 = 0 THEN '' ELSE 'p' || CAST(l_partkey AS STRING) END AS text,
    CASE WHEN l_returnflag = 'A' THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence
  FROM lineitem) t
"""

PAGES = """
SELECT doc_id, 500 + CAST(doc_id % 300 AS INT) AS height, 400 + CAST(doc_id % 200 AS INT) AS width FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) d
"""

TABLES = ("orders", "lineitem", "documents", "embeddings")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a fixture on Spark."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql}
    for t in read:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **read)


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 gray pictures made from the embeddings."""
    from pyspark.sql import functions as F

    px = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 256).cast("int") + 128)))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), px.alias("px"))


GRIDS = "SELECT vec_id AS doc_id, 8 AS height, 8 AS width, list_transform(embedding, lambda e: greatest(0, least(255, CAST(floor(CAST(e AS DOUBLE) * 256) AS INT) + 128))) AS px FROM embeddings"

TALL = f"SELECT doc_id, 64 AS height, 8 AS width, list_transform(range(0, 512), lambda i: CASE WHEN i < 160 AND doc_id % 2 = 0 OR i >= 352 AND doc_id % 3 = 0 THEN 255 ELSE px[i % 64 + 1] END) AS px FROM ({GRIDS}) t"


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 64 rows of 8, the upper strip light in every second and the lower in every third."""
    from pyspark.sql import functions as F

    light = lambda i: ((i < 160) & (F.col("doc_id") % 2 == 0)) | ((i >= 352) & (F.col("doc_id") % 3 == 0))
    px = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.when(light(i), 255).otherwise(F.get("px", i % 64)))
    return grids(spark, sf_dir).select("doc_id", F.lit(64).alias("height"), "width", px.alias("px"))
