"""Session helpers shared by every subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def get_session(app: str = "quire", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context.

    The package's sources go to the executors as a zip file, so a job doesn't
    depend on a folder that only the driver has.
    """
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quire-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quire_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_ROOT.rglob("*.py")):
            archive.write(path, f"quire/{path.relative_to(_ROOT)}")
    context.addPyFile(target)
    context._quire_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests on one machine, a temporary folder is made and set;
    on a cluster a missing setting is an error, as executors don't see the driver's.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_quire_shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="quire-shared-")).as_uri()
        spark.sparkContext._quire_shared = folder
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """Have the driver delete ``path`` when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def give_name(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that gets its name in one step once it is whole; False if the name is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = target.getFileSystem(conf)
    if store.exists(target):
        return False
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf)
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        store.delete(draft, False)
        if store.exists(target):
            return False
        raise
    return True


def keep_once(spark: SparkSession, path: str, make: Callable[[], str]) -> str:
    """The text kept at ``path``; where there is none, that of the first session to make and keep one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        give_name(spark, path, make())
    return spark.read.text(path, wholetext=True).first()[0]


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a single run of the plan (``checkpoint()`` runs it
    twice), and the files outlive any executor. They go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
