"""Shared building blocks of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space and word classes of every operator here: ASCII blanks only.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Spark deletes the shuffle files of a statement when it ends where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (SQL has no LET)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only on a single machine a temporary folder is taken where the setting is
    absent, and remembered in the session so that every caller agrees; a
    cluster must name a folder that all its machines see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="consilium-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


class Tables:
    """Paths of tables written while it is the current scope; ``clear`` deletes them."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession, reader: DataFrame | None = None) -> None:
        """Delete the tables, but for those that ``reader`` reads."""
        used = reader.inputFiles() if reader is not None and self.paths else []
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        stay = [p for p in self.paths if any(f"/{p.rpartition('/')[2]}/" in f for f in used)]
        for p in self.paths:
            if p not in stay:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
        self.paths = stay


_scopes: ContextVar[tuple[Tables, ...]] = ContextVar("scopes", default=())


@contextmanager
def collected(tables: Tables) -> Iterator[Tables]:
    """Note in ``tables`` what ``materialize`` writes meanwhile."""
    token = _scopes.set((*_scopes.get(), tables))
    try:
        yield tables
    finally:
        _scopes.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Tables]:
    """What ``materialize`` writes meanwhile is deleted at the end; results that stay go through ``keep``."""
    with collected(Tables()) as tables:
        try:
            yield tables
        finally:
            tables.clear(spark)


def _write(df: DataFrame, name: str, scopes: tuple[Tables, ...]) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if scopes:
        scopes[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor never recomputes what came before,
    evaluates expensive expressions once, and frees the shuffle files that
    made the table.  Inside ``scratch`` the table lives until that ends.
    """
    return _write(df, name, _scopes.get())


def keep(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for the result of a ``scratch`` block: the table belongs to the scope around it."""
    return _write(df, name, _scopes.get()[:-1])


def bounded(df: DataFrame, rows: int, limit: int = 4096) -> DataFrame:
    """Broadcast ``df`` when its counted ``rows`` are few, else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df
