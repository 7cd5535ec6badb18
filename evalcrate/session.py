"""Session helpers: local defaults for tests/bench, cluster-safe checkpoint dir."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # text rows are CPU-heavy per byte: let AQE keep small post-shuffle
    # partitions instead of merging a few MB of text into one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # a small file scans as one task: a shuffled join spreads the text work behind it over the cores
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def _given_settings() -> set[str]:
    """Names of the settings that spark-submit or spark-defaults.conf bring."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its JVM holds them
        SparkContext._ensure_initialized()
        return {kv._1() for kv in SparkContext._jvm.org.apache.spark.SparkConf(True).getAll()}
    names = set(re.findall(r"(spark\.[\w.]+)=", os.environ.get("PYSPARK_SUBMIT_ARGS", "")))
    if "--driver-memory" in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        names.add("spark.driver.memory")
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    path = os.path.join(folder, "spark-defaults.conf")
    if os.path.isfile(path):
        with open(path) as f:
            names |= set(re.findall(r"^\s*(spark\.[\w.]+)", f.read(), re.M))
    return names


def get_spark(master: str | None = None, app: str = "evalcrate", extra: dict | None = None) -> SparkSession:
    """The active session if there is one, else a new one; the local defaults fill only settings
    that neither the submit command nor spark-defaults.conf gives."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        given = _given_settings()
        b = SparkSession.builder.appName(app)
        if master:
            b = b.master(master)
        for k, v in {**{k: v for k, v in LOCAL_CONF.items() if k not in given}, **(extra or {})}.items():
            b = b.config(k, v)
        spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone.  Only
    in local mode a private scratch folder stands in for it; on a cluster without
    it this raises, since executors do not see each other's local folders.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="evalcrate-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set = set()


def _workers_import_us(spark: SparkSession) -> bool:
    def probe(batches):
        import pandas as pd
        try:
            import evalcrate  # noqa: F401
            ok = True
        except ImportError:
            ok = False
        for _ in batches:
            pass
        yield pd.DataFrame({"ok": [ok]})

    return all(r.ok for r in spark.range(1).mapInPandas(probe, "ok boolean").collect())


def ship_package(spark: SparkSession) -> None:
    """Make ``evalcrate`` importable by Python workers (pandas UDFs pickle our
    functions by reference).  Clusters normally ship it with ``--py-files``;
    when a probe shows the workers cannot import it, the package is zipped on
    the driver and added with ``addPyFile`` (Spark serves it to executors)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        return
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    _SHIPPED.add(key)
    if _workers_import_us(spark):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="evalcrate-pyfiles-"), "evalcrate.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
