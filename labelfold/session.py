"""Spark session helpers.

On a cluster the session is created by ``spark-submit`` and this module only
reads settings from it.  ``local_session`` exists for tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "labelfold") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", os.environ.get("LABELFOLD_AQE", "true"))
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LABELFOLD_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", os.environ.get("LABELFOLD_ANSI", "true"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` wins.  Only when it is unset (local
    tests) a scratch folder is created and registered.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            # a folder of one machine would be another disk on each executor
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all machines of {master} share")
        path = tempfile.mkdtemp(prefix="labelfold-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, name: str = "table"):
    """Cut lineage by writing a parquet table into the shared checkpoint folder.

    Used where one expensive frame (a split, cleaned whole texts) feeds several
    branches of a job.  The table is columnar, so later branches read only the
    columns they need, and it survives executor loss (unlike a local checkpoint).
    """
    import uuid
    spark = df.sparkSession
    path = checkpoint_path(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Characters of text a task gets from ``spread``: pieces of them held in a task's hash tables stay bounded as the input grows.
SPREAD_CHARS = 4_000_000


def spread(df, *keys: str, text: str | None = None, chars: int = SPREAD_CHARS):
    """Deal the rows of a scan of few, large row groups over the cores before CPU-heavy work on whole texts.

    Only the number of tasks depends on the cluster, never a result: row keys come from the
    data (``jobs.content_keys``).  With at least as many input files as cores nothing is
    moved; files are listed from the plan, without a job.

    Work that counts pieces of the column ``text`` names it: rows are then always dealt by ``keys``, to
    tasks of about ``chars`` characters each, and groups that hold ``keys`` need no further shuffle.
    """
    from pyspark.sql import functions as F
    cores = df.sparkSession.sparkContext.defaultParallelism
    if text is not None:
        size = df.agg(F.coalesce(F.sum(F.char_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
        return df.repartition(max(cores, -(-size // chars)), *keys)
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def spread_groups(df, sizes, by, key: str, chars: int = 4 * SPREAD_CHARS):
    """Deal whole texts to tasks of about ``chars`` characters that hold as few groups ``by`` as can be, and give the number of such tasks.

    ``sizes(by…, chars)`` has the characters of each group.  A large group gets tasks of its own, over which its rows are dealt by
    ``key``; small ones share tasks.  All rows of a group and key come to one task.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    by = list(by)
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = materialize(sizes, "sizes")  # texts are read for them once
    total = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    chars = max(1, min(chars, -(-total // cores)))
    # at most 4 x total / chars groups are large; the others are dealt by their hash
    large = sizes.filter(F.col("chars") > chars / 4).orderBy(F.desc("chars"), *by).collect()
    tasks = [-(-r["chars"] // chars) for r in large]
    rest = max(1, -(-(total - sum(r["chars"] for r in large)) // chars))
    task = F.pmod(F.hash(*by, F.lit(0)), F.lit(rest))
    if large and by:
        names = [f"_of_{c}" for c in by]
        schema = T.StructType([T.StructField(n, sizes.schema[c].dataType) for c, n in zip(by, names)] + [T.StructField(c, T.LongType()) for c in ("_n", "_first")])
        plan = df.sparkSession.createDataFrame([(*[r[c] for c in by], n, rest + sum(tasks[:i])) for i, (r, n) in enumerate(zip(large, tasks))], schema)
        df = df.join(F.broadcast(plan), [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)], "left")
        task = F.coalesce(F.col("_first") + F.pmod(F.hash(key), F.col("_n")), task)
    elif large:
        task = rest + F.pmod(F.hash(key), F.lit(tasks[0]))
    tasks = rest + sum(tasks)
    return df.repartitionById(tasks, task.cast("int")).drop("_n", "_first", *[f"_of_{c}" for c in by]), max(cores, tasks)
