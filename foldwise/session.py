"""Session helpers shared by the tests, the bench and the query catalogue."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

LARGEST_ESTIMATE = (1 << 63) - 1  # bytes; what Spark assumes of a table that it knows nothing of

def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foldwise")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between steps, which the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; a private temporary folder
    is set only in local mode when nothing is configured.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="foldwise-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, used between the rounds of an iterative operator."""
    shared_folder(df.sparkSession)
    return _with_bounded_estimate(df.checkpoint(eager=True))


def _with_bounded_estimate(df: DataFrame) -> DataFrame:
    """A checkpointed table, without its estimated size where that is beyond LARGEST_ESTIMATE.

    A checkpoint keeps its plan's estimate, and that of a join is the product of both sides.  A table that is joined
    with what was made from it, round after round, has an estimate whose digits multiply with every round, until
    they fill the driver's memory.  Without one, Spark assumes its largest size, which chooses the same plans.
    """
    plan = df._jdf.queryExecution().logical()
    if not _is_beyond(plan.stats()):
        return df
    option, session = df.sparkSession.sparkContext._jvm.scala.Option, df.sparkSession._jsparkSession
    same = plan.copy(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        session, option.empty(), option.apply(plan.constraints()),
    )
    return DataFrame(df.sparkSession.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, same), df.sparkSession)


def _is_beyond(estimate) -> bool:
    try:
        return estimate.sizeInBytes() > LARGEST_ESTIMATE
    except ValueError:  # more digits than Python reads as one number
        return True


def balance_factor(spark: SparkSession) -> int:
    """Number of value buckets used by the two-level running totals.

    A power of two that follows ``spark.sql.shuffle.partitions``, so that the
    largest bucket shrinks as the cluster (and the data) grows.
    """
    wanted = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (wanted - 1).bit_length()
