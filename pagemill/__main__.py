"""Batch jobs: python -m pagemill extract PAGES OUT [--profile lite] [--type invoice] [--form both].

PAGES is a folder of JSON lines with doc_id and full_text, or of images with
``analyse`` and ``process``.  ``process`` goes from images to results; it reads
them by the engine of the settings, or takes recognized lines from --lines (JSON:
path, line_idx, text, confidence, x, y, w, h).  ``templates`` and ``config``
print what is known.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions.text import process_text
from pagemill.operators import extract, images, report
from pagemill.plans import document
from pagemill.sinks import files as sinks
from pagemill.sources import files


LINE = "path string, line_idx int, text string, confidence double, x int, y int, w int, h int"


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    settings = config.load(args.settings) if args.settings else config.Settings()
    settings.extraction.document_type = args.type or settings.extraction.document_type
    if args.job == "process":
        lines = spark.read.schema(LINE).json(args.lines) if args.lines else None
        rows = files.images(spark, args.source, settings.image.allowed_formats)
        document.process(rows, lines, settings, args.profile).write.mode("overwrite").parquet(f"{args.out}/results")
        done = spark.read.parquet(f"{args.out}/results")
        done.select(document.result_json(done, settings).alias("value")).write.mode("overwrite").text(f"{args.out}/json")
        if settings.output.generate_html_report or settings.output.save_annotated_image:
            sinks.write_reports(done, f"{args.out}/reports")
        report.batch_summary(done).show()
    elif args.job == "extract":
        pages = spark.read.schema("doc_id long, full_text string").json(args.source)
        if args.profile == "standard":
            pages = pages.withColumn("full_text", process_text("full_text"))
        pages = pages.withColumn("hint", F.lit(settings.extraction.document_type))
        found = extract.summary(extract.extract(pages, args.profile, hint="hint"), args.profile)
        sinks.write(found, args.out, args.form or settings.output.format)
        found.groupBy("document_type").agg(F.count("*").alias("documents"), F.sum("total_fields").alias("fields")).show()
    elif args.job == "analyse":
        images.analyse(files.images(spark, args.source, settings.image.allowed_formats), settings, args.profile).write.mode("overwrite").parquet(args.out)
        report.batch_summary(spark.read.parquet(args.out)).show()
    elif args.job == "templates":
        report.templates(spark, args.profile).show(truncate=False)
    else:
        print(config.show(settings))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagemill")
    parser.add_argument("job", choices=["extract", "process", "analyse", "templates", "config"])
    parser.add_argument("source", nargs="?")
    parser.add_argument("out", nargs="?", default="output")
    parser.add_argument("--profile", choices=["standard", "lite"], default="standard")
    parser.add_argument("--type")
    parser.add_argument("--form", choices=["json", "csv", "both"])
    parser.add_argument("--settings")
    parser.add_argument("--lines")
    args = parser.parse_args(argv)
    if args.job in ("extract", "process", "analyse") and not args.source:
        parser.error(f"{args.job} needs a source")
    run(args, SparkSession.builder.appName("pagemill").getOrCreate())


if __name__ == "__main__":
    main()
