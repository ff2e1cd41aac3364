"""Command line: ``python -m tokenloom extract|build|batches|schedule|save-position|runlog|decode``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import batches as bt
from tokenloom.operators import runlog, tokenizers
from tokenloom.operators.decoding import decode
from tokenloom.operators.layout import chunked_docs
from tokenloom.operators.reports import shard_counts
from tokenloom.operators.shards import SHARD_SIZE, VAL_RATIO
from tokenloom.plans.corpus import GRACE, Corpus
from tokenloom.plans.cursors import Cursors
from tokenloom.plans.extraction import Extraction
from tokenloom.session import with_defaults
from tokenloom.sources import readers
from tokenloom.sources.catalog import Category, numbered_sources


def _tokenizer(name: str) -> tokenizers.Tokenizer:
    if name == "codepoint":
        return tokenizers.codepoint()
    if name == "bytes":
        return tokenizers.utf8_bytes()
    return tokenizers.tokenizer_json(name)


def _category(text: str) -> Category:
    name, prefix, suffix, *first = text.split(":")
    return Category(name, prefix, suffix, int(first[0]) if first else None)


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tokenloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    extract = commands.add_parser("extract", help="fetched files to numbered sources")
    extract.add_argument("folder")
    extract.add_argument("out")
    extract.add_argument("--category", type=_category, action="append", required=True, help="name:prefix:suffix[:first]")
    extract.add_argument("--categories", nargs="+", default=["all"])
    extract.add_argument("--start-from", type=int, default=0)
    extract.add_argument("--num-files", type=int, default=None)
    extract.add_argument("--strict", action="store_true", help="a bad record drops its whole file")
    extract.add_argument("--nulls", choices=["drop", "literal", "empty"], default=None, help="missing texts of web and articles")

    build = commands.add_parser("build", help="sources to published shards")
    build.add_argument("source", help="an extraction folder, or a folder of numbered text files with --text")
    build.add_argument("root")
    build.add_argument("--text", action="store_true")
    build.add_argument("--chunk-chars", type=int, default=None, help="tokenize each source in chunks of so many characters, across its lines and documents")
    build.add_argument("--force", action="store_true", help="tokenize everything again")
    build.add_argument("--detect", choices=["number", "content"], default="number")
    build.add_argument("--eos", choices=["source", "document", "none"], default="source")
    build.add_argument("--shard-size", type=int, default=SHARD_SIZE)
    build.add_argument("--val-ratio", type=float, default=VAL_RATIO)
    build.add_argument("--grace", type=float, default=GRACE, help="seconds for which replaced shards and cache runs stay")

    batches = commands.add_parser("batches", help="write the batches of a split")
    batches.add_argument("root")
    batches.add_argument("out")
    batches.add_argument("--split", choices=["train", "val"], default="train")
    batches.add_argument("--rows", type=int, default=bt.BATCH_ROWS)
    batches.add_argument("--length", type=int, default=bt.ROW_TOKENS)

    plan = commands.add_parser("schedule", help="write the order in which batches are still to be read")
    plan.add_argument("root")
    plan.add_argument("out")
    plan.add_argument("--split", choices=["train", "val"], default="train")
    plan.add_argument("--rows", type=int, default=bt.BATCH_ROWS)
    plan.add_argument("--length", type=int, default=bt.ROW_TOKENS)
    plan.add_argument("--epochs", type=int, default=1, help="whole passes after the rest of the current one")

    save = commands.add_parser("save-position", help="save how far the published shards have been read")
    save.add_argument("root")
    save.add_argument("step", type=int)
    save.add_argument("shard", type=int)
    save.add_argument("position", type=int)

    log = commands.add_parser("runlog", help="write the step metrics of log files")
    log.add_argument("logs")
    log.add_argument("out")

    text = commands.add_parser("decode", help="write published shards as text")
    text.add_argument("root")
    text.add_argument("out")

    for command in (build, batches, text, plan, save):
        command.add_argument("--tokenizer", default="codepoint", help="codepoint, bytes, or a tokenizer.json file")
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = with_defaults(SparkSession.builder.appName("tokenloom").getOrCreate())
    if args.command == "extract":
        job = Extraction(spark, args.out)
        made = job.run(args.folder, args.category, args.categories, args.start_from, args.num_files, strict=args.strict, nulls=args.nulls)
        for row in made.groupBy("category").agg(F.count_distinct("source_no").alias("sources"), F.count("*").alias("files")).collect():
            print(f"  {row.category}: {row.sources} new sources of {row.files} files")
        aside = job.set_aside()
        if n := aside.count():
            print(f"{n} files set aside so far, see {args.out}/set_aside; first:")
            for row in aside.limit(10).collect():
                print(f"  {row.category}: {row.path} ({row.reason})")
    elif args.command == "build":
        docs = numbered_text(spark, args.source) if args.text else Extraction(spark, args.source).docs()
        if args.chunk_chars is not None:
            docs = chunked_docs(docs, args.chunk_chars)
        corpus = Corpus(spark, args.root, _tokenizer(args.tokenizer), args.eos)
        corpus.add(docs, force=args.force, detect=args.detect)
        version = corpus.publish(args.shard_size, args.val_ratio)
        corpus.expire(grace=args.grace)
        corpus.vacuum(grace=args.grace)
        print(f"published {version}")
        for row in shard_counts(corpus.current()).collect():
            print(f"  {row.split}: {row.shards} shards, {row.n_tokens:,} tokens")
    elif args.command == "batches":
        shards = Corpus(spark, args.root, _tokenizer(args.tokenizer)).current(args.split)
        bt.batch_rows(shards, bt.BatchShape(args.rows, args.length)).write.parquet(args.out)
    elif args.command in ("schedule", "save-position"):
        corpus = Corpus(spark, args.root, _tokenizer(args.tokenizer))
        version, cursors = corpus.current_version(), Cursors(spark, f"{corpus.root}/positions")
        if args.command == "save-position":
            cursors.save(version, args.step, args.shard, args.position)
        else:
            sizes = corpus.current(args.split).select("split", "shard", "n_tokens")
            cursors.resume(sizes, version, bt.BatchShape(args.rows, args.length), args.epochs).write.parquet(args.out)
    elif args.command == "runlog":
        lines = spark.read.text(args.logs).withColumnRenamed("value", "line")
        runlog.step_lines(lines).write.parquet(args.out)
    else:
        tokenizer = _tokenizer(args.tokenizer)
        decode(Corpus(spark, args.root, tokenizer).current(), tokenizer).write.parquet(args.out)


def numbered_text(spark: SparkSession, folder: str):
    """Documents of a folder of ``input<N>.txt`` files, one per line."""
    files = numbered_sources(spark, folder)
    lines = readers.documents_by_line(spark, f"{folder.rstrip('/')}/input*.txt")
    return readers.place(lines, files.select("path", "source_no", F.lit(0).alias("file_ord")))


if __name__ == "__main__":
    main()
