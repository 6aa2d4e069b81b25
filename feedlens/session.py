"""Session helpers.

The library never creates a session inside an operator; callers pass one in.
`get_session` is for scripts and tests. `checkpoint_dir` reads the shared folder the
cluster names in ``spark.checkpoint.dir`` and only falls back to a fresh scratch folder
when the setting is absent (local tests).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # model calls are paid: a speculative copy of a task would pay twice
    "spark.speculation": "false",
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "feedlens",
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's setting wins; a scratch folder only if unset.

    ``spark.checkpoint.dir`` is read-only at run time, so the fallback is set on the context alone.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_library(spark: SparkSession) -> None:
    """Make `feedlens` importable on the executors' Python workers (like `--py-files`).

    Pandas-backed operators are pickled by reference to this package, so workers must be able to
    import it. The package is zipped into a driver-local scratch file; `addPyFile` hands it to the
    executors over Spark's own file distribution.
    """
    import os
    import zipfile

    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="feedlens-lib-"), "feedlens-lib.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(pkg):
            for f in sorted(names):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("feedlens", os.path.relpath(full, pkg)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(key)
