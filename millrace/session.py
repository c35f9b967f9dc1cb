"""Session factory and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "millrace", cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session is the caller's."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="millrace-code-"), "millrace_code.zip")
        atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, Path(home.name, p.relative_to(home)))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
    return spark


_shipped: set[str] = set()
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the session is local (tests, a single machine) a temporary folder of this
    machine is used; on a cluster executors couldn't read each other's, so there the setting is needed. What this
    application has put into its folders is deleted when it ends; ``keep`` in :func:`cut` names a folder that stays.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        return f"file://{_local[app]}/millrace-{uuid.uuid4().hex}"
    own = f"{base.rstrip('/')}/millrace-{app}"
    if app not in _shared:
        _shared.add(app)
        atexit.register(_clean, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


_shared: set[str] = set()


def _clean(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that was stopped before can delete nothing
        remove_dir(spark, path)


def cut(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = keep or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by Hadoop's file system layer."""
    system, target = _file_system(spark, path)
    return system.exists(target)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system layer."""
    system, target = _file_system(spark, path)
    system.delete(target, True)
