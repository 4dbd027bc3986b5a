"""Session helpers: cutting lineage through shared storage, sessions for tests and benches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session without that setting (tests, one machine) gets a temporary folder.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to shared storage, so that a lost executor costs no recomputation.

    `cut` writes a DataFrame as Parquet and reads it back: the plan restarts at a scan with
    known size, which is what lets Catalyst pick a broadcast only when the table is small.
    `drop` removes a generation that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._skein_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_skein_path", None)
            if path:
                _delete(self.spark, path)

    def release(self) -> None:
        """Have the shuffle files of finished jobs removed.

        Spark's cleaner removes them once the driver's JVM has collected what refers to them,
        which a driver with much free heap may put off for a long time. One collection seldom
        suffices: Python's cycles hold references in the JVM, and some go only after the cleaner
        has handled what a first collection found. For use after large shuffles, not in every
        round of a loop.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
        self.spark.sparkContext._jvm.System.gc()

    def shrink(self) -> None:
        """Have the executors' JVMs collect their garbage and give free heap back to the system.

        A heap that large shuffles have widened stays so, beside the Python workers of whatever
        runs next. One task a core asks for it, so each executor is reached if all are idle; one
        that is missed only keeps what it has.
        """
        n = self.spark.sparkContext.defaultParallelism
        ask = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
        self.spark.range(0, n, 1, n).select(ask.alias("asked")).write.format("noop").mode("overwrite").save()


def local_session(cores: str = "8", app: str = "skein", **conf: str) -> SparkSession:
    """A single-machine session with the settings that the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
