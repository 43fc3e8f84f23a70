"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where the cluster names it.

    A session on one machine without that setting (tests) gets a temporary folder; on a cluster it has to be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkward-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Has Spark delete the shuffle files of a query once it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """df as a table in the shared folder, in folders by the values of `by`: cuts the lineage and survives lost executors. Its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Empties tables made by saved() that nothing reads any more."""
    for df in tables:
        top = shared_dir(df.sparkSession).split(":", 1)[-1].strip("/")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].strip("/").startswith(top + "/"):
                df.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
