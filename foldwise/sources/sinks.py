"""Writers: split trees, audit tables, summaries and JSON records."""

from __future__ import annotations

import codecs
import csv
import io
import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_splits(df: DataFrame, path: str, partitions: Sequence[str], columns: Sequence[str], fmt: str = "csv") -> None:
    """Original columns only, one directory per partition value.

    The rows stay where they are: no repartitioning by split, so a split that
    holds most of the data is still written by all tasks.
    """
    out = df.select(*[F.col(f"`{c}`") for c in columns], *partitions)
    writer = out.write.mode("overwrite").partitionBy(*partitions)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_shuffled_splits(df: DataFrame, path: str, partitions: Sequence[str], columns: Sequence[str], key: str) -> None:
    """Split files whose rows are in the order of a shuffle key, without sorting the whole table.

    Rows are range-partitioned by (partitions, key) and sorted inside each part, so a split is one run of
    parts: its files, by name, and the rows in them follow the key, and a large split has many files.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *partitions, key).sortWithinPartitions(*partitions, key)
    write_splits(ranged, path, partitions, columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Audit and bridge tables of any size."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union over the union of the columns, first seen first."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


@contextmanager
def _text_file(spark: SparkSession, path: str, bom: bool = False):
    """A function that appends text to one new file on any file system that Spark can write to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        if bom:
            stream.write(bytearray(codecs.BOM_UTF8))
        yield lambda text: stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def _chunks(df: DataFrame, rows: int = 5000) -> Iterator[list[dict]]:
    """Rows of any number of them, one partition at a time."""
    held = []
    for row in df.toLocalIterator():
        held.append(row.asDict(recursive=True))
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def write_report_csv(df: DataFrame, path: str) -> None:
    """A summary as one CSV file with a byte-order mark, as spreadsheets expect."""
    with _text_file(df.sparkSession, path, bom=True) as append:
        text = io.StringIO()
        csv.DictWriter(text, df.columns).writeheader()
        append(text.getvalue())
        for rows in _chunks(df):
            text = io.StringIO()
            csv.DictWriter(text, df.columns).writerows(rows)
            append(text.getvalue())


def write_report_json(df: DataFrame, path: str) -> None:
    with _text_file(df.sparkSession, path) as append:
        before = "["
        for rows in _chunks(df):
            append("".join(f"{before if i == 0 else ','}\n{json.dumps(row, indent=2, default=str)}" for i, row in enumerate(rows)))
            before = ","
        append("\n]" if before == "," else "[]")


def write_metadata(spark: SparkSession, values: Mapping, path: str) -> None:
    with _text_file(spark, path) as append:
        append(json.dumps(dict(values), indent=2, default=str))


def write_sheets(tables: Mapping[str, DataFrame], folder: str) -> None:
    """A multi-sheet report as one CSV per sheet, under its whole name; an empty sheet says so."""
    for name, table in tables.items():
        path = f"{folder}/{name}.csv"
        if table.isEmpty():
            with _text_file(table.sparkSession, path, bom=True) as append:
                append("message\nNo data available\n")
        else:
            write_report_csv(table, path)
