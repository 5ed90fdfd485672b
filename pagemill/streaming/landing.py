"""Pages, as text or as images, that land in a folder, handled as a stream.

Each micro-batch is stateless: the same columns as in a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.config import Settings
from pagemill.functions.text import process_text
from pagemill.operators.extract import extract, summary
from pagemill.operators.images import analyse
from pagemill.sources import files

PAGE = "doc_id long, full_text string, document_type_hint string"


def pages(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """JSON pages from a landing folder."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_a_batch).json(folder)


def extracted(stream: DataFrame, profile: str = "standard") -> DataFrame:
    clean = stream.withColumn("full_text", process_text("full_text")) if profile == "standard" else stream
    return summary(extract(clean, profile, hint="document_type_hint"), profile)


def start(stream: DataFrame, out: str, checkpoint: str, profile: str = "standard") -> StreamingQuery:
    """Write results as Parquet, each file's pages once."""
    rows = extracted(stream, profile).withColumn("fields", F.to_json("fields"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def images(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Rows of the image source from PNG or BMP files that land in a folder."""
    content = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return files.from_bytes(content)


def start_images(stream: DataFrame, out: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Analyse images as they land, one Parquet row each."""
    return analyse(stream, settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
