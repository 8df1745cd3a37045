"""Command line: ``python -m quire.cli layout analyze --input FILE --model FILE``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.detector import OnnxDetector, detect, onnx_detector
from .options import MAX_PAGES, PDF_DPI, LoadOptions
from .plans.layout import analyze_packed, document_json
from .sources.documents import load_pages


def positive_int(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise argparse.ArgumentTypeError(f"invalid unsigned integer: {text}")
    if int(text) == 0:
        raise argparse.ArgumentTypeError("value must be greater than 0")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire")
    layout = top.add_subparsers(dest="command", required=True).add_parser("layout")
    own = layout.add_subparsers(dest="action", required=True).add_parser("analyze")
    own.add_argument("--input", required=True)
    own.add_argument("--model", required=True)
    own.add_argument("--max-page", "--max_page", dest="max_page", type=positive_int, default=MAX_PAGES)
    own.add_argument("--pdf-dpi", "--pdf_dpi", dest="pdf_dpi", type=float, default=PDF_DPI)
    own.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    OnnxDetector(args.model)  # a missing model is told before a bad input
    spark = SparkSession.builder.appName("quire").getOrCreate()
    pages = load_pages(spark, args.input, LoadOptions(args.max_page, args.pdf_dpi))
    found = detect(pages, lambda: onnx_detector(args.model), batch_size=1)
    text = document_json(analyze_packed(found).withColumn("page_index", F.col("page_index")))
    if args.output:
        with open(args.output, "w") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
