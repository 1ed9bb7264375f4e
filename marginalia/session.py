"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 4, shuffle_partitions: int = 8, memory: str = "4g", name: str = "marginalia") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: the shared one that spark.checkpoint.dir names; a private one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and getattr(spark, "_jsc", None) is not None:
        set_by_hand = spark._jsc.sc().getCheckpointDir()
        named = set_by_hand.get() if set_by_hand.isDefined() else None
    if named is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or (Path(tempfile.gettempdir()) / "marginalia-lineage").as_uri()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    own = f"{shared_folder(spark).rstrip('/')}/marginalia-{spark.conf.get('spark.app.id', 'app')}"
    _delete_at_end(spark, own)
    return own


_tables = itertools.count()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there: nothing before it is computed again, whoever is lost.

    A written table also tells the optimizer its size, so small sides of later joins are broadcast by the
    size check, and iterations with self joins keep no growing plans or estimates. Tables of an application
    lie in one folder, which is deleted when its driver ends.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{next(_tables)}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    jvm = getattr(spark, "_jvm", None)  # without a JVM beside it (a remote session) the server's own clean-up holds
    if jvm is not None:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per context, so that they need no path of their own."""
    context = spark.sparkContext
    if getattr(context, "_marginalia_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="marginalia-")  # the driver serves the archive to every executor from here, as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "marginalia.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._marginalia_shipped = True
