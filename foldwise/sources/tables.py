"""Readers: parquet tables, entity CSVs, split triples and prediction files.

File discovery uses Spark's own listing (globs and the ``_metadata`` column), so
one query reads a whole directory tree and derives its keys from the paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from foldwise.functions.scalars import SPLITS, normalize_name

# Accepted names of a prediction file, best first.
PREDICTION_FILES = ("test_predictions.csv", "predictions.csv", "test.csv")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header.  With a schema there is no inference pass; without one all
    columns are read as text and typed later by lenient casts."""
    reader = spark.read.option("header", True).options(**options)
    return (reader.schema(schema) if schema is not None else reader).csv(path if isinstance(path, str) else list(path))


def read_optional(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A table that may be missing: empty with the given schema, or an error if required."""
    if path_exists(spark, path):
        return read_csv(spark, path, schema)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def with_path_parts(df: DataFrame, depth: Sequence[str] = ("Benchmark", "TaskGroup", "File")) -> DataFrame:
    """Add the trailing path components of each row's file as columns.

    Spark reports percent-encoded paths; a plus sign in a name is not a blank.
    """
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(path, "/")
    n = len(depth)
    return df.select("*", *[F.element_at(parts, i - n).alias(c) for i, c in enumerate(depth)])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def existing_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the named columns that the table has, in the order of the names."""
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


def read_entities(
    spark: SparkSession, root: str, schema: str | None = None, text: str = "molecules", hyphens: bool = True
) -> DataFrame:
    """All ``<benchmark>/<task group>/<dataset>.csv`` files under a root as one table."""
    df = require_columns(read_csv(spark, f"{root}/*/*/*.csv", schema), text)
    named = with_path_parts(df)
    stem = F.regexp_replace("File", r"\.csv$", "")
    return named.withColumn("Dataset", normalize_name(stem, hyphens)).drop("File")


def missing_folders(spark: SparkSession, root: str, benchmarks: Sequence[str], task_groups: Sequence[str]) -> list[str]:
    """Expected folders that are not there, for the caller to report."""
    wanted = [f"{root}/{b}/{t}" for b in benchmarks for t in task_groups]
    return [w for w in wanted if not path_exists(spark, w)]


def file_catalog(spark: SparkSession, glob: str) -> DataFrame:
    """Listing of the files that match a glob: directory and file name, no content read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path")
    return listing.select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")
    )


def split_dirs(listing: DataFrame) -> DataFrame:
    """Directories that hold both a test and a train file."""
    has = [F.bool_or(F.col("name") == f"{split}.csv").alias(split) for split in ("test", "train")]
    return listing.groupBy("dir").agg(*has).where("test and train").select("dir").orderBy("dir")


def sample_catalog(catalog: DataFrame, key: str, n: int | None, seed: int = 20250328) -> DataFrame:
    """Seeded sample of catalogue rows (datasets, not data), in key order."""
    if n is None:
        return catalog
    return catalog.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))).limit(n).orderBy(key)


def read_split_triple(
    spark: SparkSession, folder: str, schema: str, text: str = "molecules", allow_missing: bool = False
) -> DataFrame:
    """train / valid / test of one directory as one table with a ``split`` column."""
    frames = []
    for split in SPLITS:
        path = f"{folder}/{split}.csv"
        frame = read_optional(spark, path, schema, required=not allow_missing)
        frames.append(require_columns(frame, text).withColumn("split", F.lit(split)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.where(F.col(text).isNotNull())


def prediction_paths(root: str, model: str, benchmark: str, task_group: str, dataset: str, fold: str) -> list[str]:
    base = f"{root}/{model}/{benchmark}/{task_group}/{dataset}/{fold}"
    return [f"{base}/{name}" for name in PREDICTION_FILES]


def read_predictions(
    spark: SparkSession, root: str, model: str, benchmark: str, task_group: str, dataset: str, fold: str, schema: str | None = None
) -> tuple[DataFrame | None, str | None]:
    """First of the accepted prediction files that exists, with its path."""
    for path in prediction_paths(root, model, benchmark, task_group, dataset, fold):
        if path_exists(spark, path):
            return read_csv(spark, path, schema), path
    return None, None


# Columns that are never targets, and the names a score column may have.
NOT_TARGETS = ("molecules", "Scaffold", "ScaffoldStatus", "Fingerprint")
SCORE_NAMES = (
    "{t}_pred", "{t}_score", "{t}_prob", "pred_{t}", "score_{t}", "prob_{t}",
    "{t}_predfile", "{t}_score_predfile", "{t}_prob_predfile", "{t}",
)
PREDICTION_NAMES = (
    "{t}_pred", "{t}_prediction", "pred_{t}", "prediction_{t}", "{t}_predfile", "{t}_prediction_predfile", "{t}",
)
KEY_NAMES = ("molecules", "smiles", "id")
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def target_columns(df: DataFrame, exclude: Sequence[str] = NOT_TARGETS) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def score_column(df: DataFrame, target: str, names: Sequence[str] = SCORE_NAMES) -> str | None:
    """The column holding the prediction of a target: by name, else the only numeric column."""
    for pattern in names:
        if pattern.format(t=target) in df.columns:
            return pattern.format(t=target)
    numeric = [f.name for f in df.schema if f.name not in KEY_NAMES and isinstance(f.dataType, NUMERIC_TYPES)]
    return numeric[0] if len(numeric) == 1 else None


def targets_long(df: DataFrame, targets: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One row per (row, target) with the value as DOUBLE."""
    typed = df.select(*ids, *[F.col(f"`{t}`").try_cast("double").alias(t) for t in targets])
    return typed.unpivot(list(ids), [f"`{t}`" for t in targets], "Target", "y")
