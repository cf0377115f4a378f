"""Session settings that every query of this library assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Results depend on these: plain base64 without line breaks, UTC time stamps.
REQUIRED = {"spark.sql.chunkBase64String.enabled": "false", "spark.sql.session.timeZone": "UTC"}


def build(app: str = "cuewright", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, bring your own and call ``prepare``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = REQUIRED | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on, and see that workers can import this package; leave resources as the cluster has them."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, once per application, if it isn't installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    name = __name__.partition(".")[0]

    def missing(_: int) -> bool:
        import importlib.util

        return importlib.util.find_spec(name) is None

    missing.__module__ = "__main__"  # pickled by value: the package can't be imported there yet
    if context.parallelize([0], 1).map(missing).first():
        import shutil

        folder = tempfile.mkdtemp(prefix=name)
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        context.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))
    _shipped.add(context.applicationId)
