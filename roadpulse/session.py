"""Session settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "roadpulse", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; master and any setting can be given."""
    build = SparkSession.builder.appName(app)
    if master:
        build = build.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return build.config(map=settings).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that the cluster shares: `spark.checkpoint.dir` of the session, else one of the warehouse; /tmp for local masters alone."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
            place = "/tmp/checkpoints" if one_machine else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(place)
    return df.checkpoint()
