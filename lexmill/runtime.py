"""Session helpers: table reads, staged intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow key table (ids, hashes) is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or a local one where it is unset and the master is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
    return at.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  (the session may be gone already)
        pass


def stage(df: DataFrame) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged key table for broadcast if its counted rows stay within the bound; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
