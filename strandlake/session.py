"""Session helpers: where shared intermediate tables go and how lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.schema import EngineError, ErrorCode

_written: list[tuple[SparkSession, str]] = []


def local_session(app: str = "strandlake", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests, the command line and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a session whose master is local (one
    host, as in tests and the bench) gets a temporary folder; on a cluster it is refused, as executors on other hosts would
    write where nobody else reads."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise EngineError(ErrorCode.INVALID_CONFIG, f"spark.checkpoint.dir must name a folder that all hosts of {master} share")
    made = "file://" + tempfile.mkdtemp(prefix="strandlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # the session may be gone
        pass


def _drop_written(since: int = 0) -> None:
    while len(_written) > since:
        _drop(*_written.pop())


atexit.register(_drop_written)


@contextlib.contextmanager
def intermediates() -> Iterator[None]:
    """Tables that materialize() writes inside the block are deleted at its end: for work whose result is then stored
    elsewhere. Others stay until the process exits, as the lazy results that read them may be used at any time."""
    began = len(_written)
    try:
        yield
    finally:
        _drop_written(began)


def drop_later(spark: SparkSession, path: str) -> None:
    """Have a folder deleted with the intermediate tables."""
    _written.append((spark, path))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small_or_none(df: DataFrame, max_rows: int) -> list | None:
    """The rows of df if there are at most max_rows of them, else None: the size check before a broadcast."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows and, as JSON, max_bytes bytes, both measured; else df
    unhinted (Catalyst shuffles)."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["rows"] <= max_rows and seen["bytes"] <= max_bytes else df


_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped_to:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandlake-")) / "strandlake_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped_to.add(app)


def shipped(query: Callable) -> Callable:
    """The query, run after the package has been given to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
