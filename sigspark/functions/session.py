"""Where a job may put intermediate tables."""
import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_SHARED: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in ``spark.checkpoint.dir``.

    Only when nothing is set, as in local tests, a folder of our own is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    app = sc.applicationId
    if app not in _SHARED:
        _SHARED[app] = tempfile.mkdtemp(prefix="sigspark-")
        atexit.register(shutil.rmtree, _SHARED[app], True)
        sc.setCheckpointDir(_SHARED[app])
    return _SHARED[app]


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Before heavy work per row: dealt out by a unique key if the scan has fewer splits than there are cores.

    A large input, also of few large files, has splits enough and is left where
    it is. Splits are counted from file sizes; nothing is run to decide.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def sized(df: DataFrame, stem: str = "sized") -> DataFrame:
    """A table that should be small, written and read again: its size is known from its files.

    The optimiser broadcasts it below ``spark.sql.autoBroadcastJoinThreshold``,
    so that rows with a hot key stay where they are; a larger one is joined by a shuffle.
    """
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint; the data outlives the executors that wrote it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that ``sized`` or a like step wrote to the shared folder, once a later one has taken its place."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    if root.toUri().getPath().rstrip("/") not in folder.toUri().getPath():
        raise ValueError(f"{folder} is not below the shared folder")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
