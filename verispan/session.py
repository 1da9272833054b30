"""Session defaults for local work and tests; a cluster keeps its own settings."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from verispan.scale import new_path

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application.

    The archive is written to the folder that all executors share and added from there, so nothing
    depends on where the workers start.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        path = new_path(spark, "package") + "/verispan.zip"
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def local_session(cores: int = 8, memory: str = "6g", partitions: int = 8, app: str = "verispan", shared: str | None = None) -> SparkSession:
    """A local session with UTC, adaptive execution and few shuffle partitions; ``shared`` is the folder for tables that cut lineage."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", shared or "file://" + tempfile.mkdtemp(prefix="verispan-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str):
    """One parquet table of a test-data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
