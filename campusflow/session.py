"""SparkSession helper: UTC session time, UI off, AQE on.

On a cluster the session already exists and carries its own settings; the
helper only fills in what is unset.  ``spark.checkpoint.dir`` must name a
shared folder there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on; applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "campusflow",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # a pre-existing session ignores builder configs for static keys; pin the SQL ones
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine uses a folder of its warehouse;
    on a cluster the setting is required, as a local folder would differ from
    machine to machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not d:
        d = context.getCheckpointDir()
    if not d:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set; configure a folder that all executors share")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(d)
    return d
