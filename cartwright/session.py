"""Where a job may write its intermediate tables, and a session for local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, *parts: str) -> str:
    """A folder of this application in a place all executors share.

    Intermediate tables have to outlive the executor that wrote them: they go below the folder named
    by ``spark.checkpoint.dir``, or below the session's warehouse if that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return "/".join([root.rstrip("/"), "cartwright", spark.conf.get("spark.app.id"), *parts])


def local_session(cpus: int | str = "*", app_name: str = "cartwright", **conf: str) -> SparkSession:
    """A single-machine session for tests, the bench and small command-line runs.

    On a cluster the caller's own session is used; nothing else in the package creates one.
    """
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
