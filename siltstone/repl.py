"""Read commands from a stream: ``python -m siltstone.repl --data-dir FOLDER``."""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from siltstone.command import respond
from siltstone.config import KIB, MIB, Settings
from siltstone.sources.documents import DocumentStore
from siltstone.sources.store import Store


def run(engine: Store | DocumentStore, lines: TextIO, out: TextIO) -> None:
    """Answer lines until EXIT or their end."""
    for line in lines:
        answer = respond(engine, line)
        if answer is not None:
            print(answer, file=out, flush=True)
        if answer == "bye":
            return


#: Spark's name of each log level (fixed values).
LOG_LEVELS = {"off": "OFF", "error": "ERROR", "warn": "WARN", "info": "INFO", "debug": "DEBUG", "trace": "TRACE"}


def options(args: list[str]) -> tuple[str, str, Settings]:
    """Folder, log level and checked settings of a command line."""
    own = Settings()
    flags = argparse.ArgumentParser(prog="siltstone.repl", description="A key-value and document store on Spark.")
    flags.add_argument("folder", nargs="?", help="the same as --data-dir")
    flags.add_argument("-d", "--data-dir", default=".")
    flags.add_argument("-l", "--log-level", default="error", type=str.lower, choices=sorted(LOG_LEVELS))
    flags.add_argument("-v", "--verbose", action="store_true", help="the same as --log-level debug")
    flags.add_argument("--memtable-size-mb", type=int, default=own.memtable_size_threshold // MIB)
    flags.add_argument("--block-size-kb", type=int, default=own.sstable_block_size // KIB)
    flags.add_argument("--max-level0-files", type=int, default=own.max_level0_files)
    flags.add_argument("--wal-segment-size-mb", type=int, default=own.wal_segment_size // MIB)
    flags.add_argument("--bloom-fp-rate", type=float, default=own.bloom_false_positive_rate)
    got = flags.parse_args(args)
    settings = Settings(
        memtable_size_threshold=got.memtable_size_mb * MIB, sstable_block_size=got.block_size_kb * KIB,
        max_level0_files=got.max_level0_files, wal_segment_size=got.wal_segment_size_mb * MIB,
        bloom_false_positive_rate=got.bloom_fp_rate,
    )
    return got.folder or got.data_dir, LOG_LEVELS["debug" if got.verbose else got.log_level], settings.validate()


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    folder, level, settings = options(args)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    spark.sparkContext.setLogLevel(level)
    engine = DocumentStore.open(Store.open(spark, folder, settings))
    try:
        run(engine, sys.stdin, sys.stdout)
    finally:
        engine.close()


if __name__ == "__main__":
    main(sys.argv[1:])
