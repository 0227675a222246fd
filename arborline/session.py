"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import shlex

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

#: What a session gets that neither its submitter nor the caller has set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: For one machine only; a cluster's submitter knows better.
LOCAL_DEFAULTS = {"spark.ui.enabled": "false", "spark.driver.memory": "8g"}


def submitted_settings() -> dict[str, str]:
    """What spark-submit, its arguments in the environment, or the defaults file have set."""
    if "PYSPARK_GATEWAY_PORT" in os.environ or SparkContext._gateway is not None:
        SparkContext._ensure_initialized()
        return dict(SparkConf(_jvm=SparkContext._jvm).getAll())
    # No JVM yet: it will be started with these arguments, and reads the defaults file itself.
    out: dict[str, str] = {}
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    try:
        with open(os.path.join(folder, "spark-defaults.conf"), encoding="utf-8") as f:
            out |= dict((*line.split(None, 1), "")[:2] for line in f if line.strip() and not line.startswith("#"))
    except OSError:
        pass
    names = {"--master": "spark.master", "--name": "spark.app.name", "--driver-memory": "spark.driver.memory", "--executor-memory": "spark.executor.memory"}
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for arg, value in zip(args, args[1:], strict=False):
        if arg in ("--conf", "-c"):
            out |= dict([value.split("=", 1)])
        elif arg in names:
            out[names[arg]] = value
    return out


def settings(submitted: dict[str, str], master: str | None = None, **conf: str) -> dict[str, str]:
    """The settings to be added to those submitted: what the caller names, and defaults for what
    nobody has set.  A master is only chosen where none was submitted."""
    out = dict(conf)
    if master or "spark.master" not in submitted:
        out["spark.master"] = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    local = {"spark.sql.shuffle.partitions": os.environ.get("BENCH_CPUS", "8")} | LOCAL_DEFAULTS if out.get("spark.master", submitted.get("spark.master", "")).startswith("local") else {}
    return {k: v for k, v in (DEFAULTS | local).items() if k not in submitted} | out


def build_session(master: str | None = None, app: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and AQE; on one machine shuffle partitions near the core count.

    What spark-submit, the defaults file or a running context sets wins over the defaults here;
    ``master``, ``app`` and ``conf`` win over both.
    """
    submitted = submitted_settings()
    active = SparkSession.getActiveSession()
    if active is not None:
        submitted |= dict(active.sparkContext.getConf().getAll())
    builder = SparkSession.builder
    if app or "spark.app.name" not in submitted:
        builder = builder.appName(app or "arborline")
    for k, v in settings(submitted, master, **conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
