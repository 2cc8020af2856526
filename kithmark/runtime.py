"""Session helpers shared by all operators: shared checkpoints, table loading, partition sizing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "kithmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution, skew joins)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read from the session.
    Only where neither the setting nor a folder is present (a local test run) a temporary one is set.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="kithmark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialises as a table in the shared checkpoint folder and cuts the lineage.

    The table survives lost executors, is written in one pass (a reliable checkpoint computes its last stage
    twice) and is removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    written = _written.get()
    if written is not None:
        written.append(out)
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables written by ``cut`` that nothing reads any more, such as those of the round before."""
    for t in tables:
        _drop(t.sparkSession, t._table)


#: Setting by which an action deletes its shuffle files when it is over, instead of when the driver's heap is collected.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written in the phase that runs, if one does.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def phase(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A part of a long job: what ``cut`` writes in it is deleted at its end, but for the tables given to the function it yields.

    Shuffle files go as soon as the action that wrote them is over. At the end the driver is collected: plans and broadcasts go only with the
    objects in its heap that stand for them, and it grows towards its limit with the plans of one phase after the other before they do.
    """
    written: list[DataFrame] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._table)
        return table

    before, shuffles = _written.set(written), spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield keep
    finally:
        spark.conf.set(SHUFFLES_GO, shuffles)
        _written.reset(before)
    free(*[t for t in written if t._table not in kept])
    written.clear()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and with it the folder's owner
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
