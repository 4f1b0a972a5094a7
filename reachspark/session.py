"""Session helpers: local session, shared scratch folder, lineage cuts, literal tables."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, app: str = "reachspark") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without one; there a temporary folder is made and remembered
    in the session. A cluster without the setting is refused, because a machine-local folder
    would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("reachspark.scratch.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-reach-")
    spark.conf.set("reachspark.scratch.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Iterative operators call this once per round. The table survives a lost executor, drops
    the lineage, and carries its true size, so the optimizer picks join sides from facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new name in this application's part of the shared scratch folder."""
    return f"{_run_dir(spark)}/{uuid.uuid4().hex}"


class Guard:
    """Fails if a counted column stayed NULL in all rows of an action, without a second scan.

    ``watch`` adds the count to a plan, ``verify`` raises after the plan's first action.
    """

    def __init__(self, message: str):
        self.message, self._seen = message, Observation(f"guard-{uuid.uuid4().hex}")

    def watch(self, df: DataFrame, column: str) -> DataFrame:
        return df.observe(self._seen, F.count(column).alias("valid"))

    def verify(self) -> None:
        if not self._seen.get["valid"]:
            raise ValueError(self.message)


def _run_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/reachspark-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables this application wrote with ``cut``; results built on them end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by the keys of a following Python group step, at full shuffle width.

    Without this the adaptive planner sizes partitions by bytes, which starves steps whose cost
    is computing, not volume. The grouping reuses the partitioning.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def deal(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by the keys of following windows, joins or aggregations, eight tasks a core at least.

    Sorted cell numbers compress so well that tasks sized by their bytes would sort or hash far
    more rows than fit. The following steps reuse the partitioning.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return df.repartition(width, *keys)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, float) and not math.isfinite(value):
        return f"double('{value}')"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_table(spark: SparkSession, rows: Iterable[Sequence], ddl: str) -> DataFrame:
    """A parameter table as a local relation, typed by ``ddl`` (``"q double, name string"``).

    Local relations have exact size statistics: Catalyst broadcasts them when they are small
    and does not when they are not.
    """
    fields = [part.strip().split(None, 1) for part in _split_ddl(ddl)]
    names = [name for name, _ in fields]
    rows = [tuple(row) for row in rows]
    if not rows:
        return spark.createDataFrame([], ddl.replace(" ", " "))
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(names)})")


def _split_ddl(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p for p in parts + [current] if p.strip()]
