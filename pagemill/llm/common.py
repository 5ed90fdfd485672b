"""Helpers shared by the corpus operators: shared storage, words, row order."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the ASCII white space that separates words in the contracts.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def ship(module_name: str) -> None:
    """Send this module's functions to executors by value.

    Executors then need no copy of the package on their own path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    name = "pagemill_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


ship(__name__)


def lean(kernel, keeps: bool = False):
    """A batch kernel that gives freed memory back when its task ends.

    Python workers live on between stages beside the executor's heap.  A
    kernel that does not keep what others have cached drops it first.
    """

    def run(batches):
        if not keeps:
            cache = worker_cache()
            for key in [k for k in cache if isinstance(k, tuple)]:
                del cache[key]
        try:
            yield from kernel(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library keeps its own counsel

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set as the checkpoint folder.

    Only a local session, whose executors are this machine, may have neither.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


#: Lists of paths made while a scratch() is open, the innermost last.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Delete what is written inside, when left, but for what keep(df) names."""
    made: list[str] = []
    kept: set[str] = set()
    _OPEN.append(made)
    try:
        yield lambda df: kept.add(df.materialised_path)
    finally:
        _OPEN.remove(made)
        for path in made:
            if path not in kept:
                delete(spark, path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts lineage; a lost executor loses none of it.  The shuffles that made
    it are deleted at once.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialised_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialise() that no plan needs any more."""
    path = getattr(df, "materialised_path", None)
    if path:
        delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 100_000


def lookup_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join of big to small, unique on key, nulls equal, without hot tasks.

    small is counted first (pass a materialised table): a small one is
    broadcast; a larger one is repeated once a salt and big's rows are dealt
    over the salts, so that one key never lands in one task.
    """
    right = small.withColumnRenamed(key, "_key")
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("_deal", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_deal") == F.col("_salt"))
    return left.join(right, on, "left").drop("_key", "_salt", "_deal")


#: Rows of one key that one task gets in counted_join().
MOST = 4000


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join of big to small, unique on keys, rows of a hot key dealt over salts.

    small (a materialised table) counts big's rows by key in a column, which is
    dropped.  The keys of more than ``most`` rows are broadcast; should they be
    more than ``BROADCAST_ROWS``, of more than an even share of that many, which
    no more keys can have.
    """
    most = MOST
    hot = small.filter(F.col(count) > most).select(*keys, count)
    if hot.count() > BROADCAST_ROWS:
        most = small.agg(F.sum(count)).first()[0] // BROADCAST_ROWS + 1
        hot = hot.filter(F.col(count) > most)
    if hot.isEmpty():
        return big.join(small.drop(count), keys, how)
    salts = hot.select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_salts"))
    left = big.join(F.broadcast(salts), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*big.columns, F.monotonically_increasing_id()), "_salts").cast("int"), F.lit(0))).drop("_salts")
    last = F.when(F.col(count) > most, F.ceil(F.col(count) / most).cast("int") - 1).otherwise(F.lit(0))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop(count)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def share(spark: SparkSession, value):
    """Broadcast a value of bounded size, its class sent along by value."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared):
    """What share() has sent, on an executor."""
    return cloudpickle.loads(shared.value)


def shielded(docs: DataFrame, *used: str):
    """docs with all columns but the used ones renamed, and the way back.

    Extra columns then never clash with an operator's own.
    """
    names = {c: c if c in used else f"_extra{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])
