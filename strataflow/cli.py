"""python -m strataflow.cli ingest PATH [-o FILE]: text files to JSON lines of chunks, or with --json to their documents. info: what is supported."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataflow.api import Config, cache_dir, ingest, parse
from strataflow.functions.languages import REGISTRY
from strataflow.operators import ocr
from strataflow.sources import files, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataflow")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("path")
    a.add_argument("-o", "--out")
    a.add_argument("--lang", default="en")
    for k in ("chunk-tokens", "overlap", "min-tokens"):
        a.add_argument(f"--{k}", type=int)
    a.add_argument("--skip-underscored", action="store_true")
    a.add_argument("--json", metavar="FILE", help="the parsed documents, beside the chunks")
    sub.add_parser("info")
    args = p.parse_args(argv)
    if args.command == "info":
        print("languages: " + ", ".join(f"{x.iso} ({x.name}, {x.pack})" for x in REGISTRY))
        print("formats: " + ", ".join(sorted(files.FORMATS)))
        print(f"OCR engines: none is part of this package; modes: none, auto, tesseract, {', '.join(ocr.NEURAL)}")
        print(f"GPU: {'yes' if ocr.gpu_there() else 'no'}; OCR cache: {cache_dir()}")
        return 0
    if not os.path.exists(args.path):
        print(f"no such file or folder: {args.path}", file=sys.stderr)
        return 2
    began = time.time()
    spark = SparkSession.builder.appName("strataflow").getOrCreate()
    named = [x for x in args.lang.replace("/", ",").split(",") if x]
    config = Config.of(chunk_tokens=args.chunk_tokens, overlap=args.overlap, min_tokens=args.min_tokens, languages=tuple(named), skip_underscored=args.skip_underscored)
    found, chunks = ingest(spark, args.path, config)
    if args.json:
        sinks.dump_documents(parse(spark, args.path, config=config)[1], args.json)
    n = sinks.write_one(chunks, args.out) if args.out else sinks.write_to(chunks, sys.stdout)
    seen = found.groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("ok")).first()
    print(f"{seen['n']} files, {seen['n'] - seen['ok']} failed, {n} chunks", file=sys.stderr)
    if seen["ok"]:
        print(f"{time.time() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
