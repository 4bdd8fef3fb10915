"""Session set-up and the two ways this library materialises something.

``gather_small`` is the only road by which rows reach the driver: it takes at most
``max_rows`` of them, so whatever is broadcast afterwards has a proven bound.  A table
that turns out larger stays distributed, written to reliable checkpoint storage.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MAX_SMALL_ROWS = 50_000


def build_session(app: str = "tilth", cpus: str = "*", **conf) -> SparkSession:
    """Local session for tests and the bench; on a cluster pass the session you have."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see: the checkpoint folder named by the session.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would lose data with its host, so its absence is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tilth-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def importable(spark: SparkSession) -> None:
    """Let the Python workers find this package where the driver found it, if they share the path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once as parquet in the shared folder and read it back, columns prunable."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def gather_small(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> tuple[DataFrame, list | None]:
    """Return (table, rows): a local relation and its rows (dicts) when it has at most
    ``max_rows`` rows, else the checkpointed distributed table and None.

    Catalyst knows the exact size of a local relation and broadcasts it on its own;
    the distributed form is joined by shuffle, where AQE splits skewed partitions.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return reliable(df), None
    return df.sparkSession.createDataFrame(table, df.schema), table.to_pylist()


def one_row(df: DataFrame):
    """First row of a table that is one row by construction (a global aggregate)."""
    return df.limit(1).collect()[0]


def local_if_small(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """A dimension as a local relation when a bounded look proves it small, else as it is.

    Catalyst multiplies the sizes of joined dimensions and then shuffles the fact table
    for a side of a thousand rows; a local relation has its true size.
    """
    table = df.limit(max_rows + 1).toArrow()
    return df if table.num_rows > max_rows else df.sparkSession.createDataFrame(table, df.schema)


def hash_joins(spark: SparkSession, largest: str = "64m") -> None:
    """Let adaptive execution join shuffled sides by hash where it has seen that no partition of
    the smaller one is larger than ``largest``: a fact table is then not sorted, so nothing spills.
    A session that has chosen a size keeps it.  Spark asks for at least its advisory size, 64 MB."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(name) in ("0", "0b", "0B"):
        spark.conf.set(name, largest)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on an input of few splits (one small file is one task otherwise).

    An input with at least as many splits as the cluster has cores, which is what a large
    table has, is returned as it is: nothing large is ever shuffled for this.  Spreading by
    the key of a later join lets that join reuse the partitioning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
