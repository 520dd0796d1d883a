"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTLED = "settled_"
_SCOPES: list[list] = []
#: Narrow rows (keys and numbers, no texts or sets) that one task takes.
ROWS_A_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Bound the Arrow batches of texts, where the session keeps Spark's default of
    10,000 rows: a worker and its executor hold a batch of whole texts each."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, "1000")


def map_texts(
    docs: DataFrame,
    start: Callable[[], Callable[[str], tuple]],
    schema: str,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Apply a function of one text to every row, in Arrow batches.

    ``start`` runs once a task and returns the function; its tuple follows the
    key columns. Null texts count as empty. A batch's results are built column
    by column, so memory holds one input batch and its results only.
    """
    key_types = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys]
    full = ", ".join([*key_types, schema])
    width = len(_parse_datatype_string(schema).fields)
    arrow = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            rows = [f(x or "") for x in batch.column(len(keys)).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * width
            made = [pa.array(c, type=arrow.field(len(keys) + i).type) for i, c in enumerate(cols)]
            own = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *made], schema=arrow)

    small_batches(docs)
    return docs.select(*keys, text).mapInArrow(run, full)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session that names none (a test)
    takes one under the warehouse directory. A cluster must name one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query has ended, not when the
    driver's collector next runs. What is asked for again is computed again."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a table written in the shared folder and read
    again, which a lost executor leaves whole. It goes with ``release``, or with the driver.

    Other than checkpoint() it is compressed, and read in parts by its bytes."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{_SETTLED}{uuid4().hex}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    with dropped_shuffles(spark):
        df.write.parquet(folder.toString())
    for names in _SCOPES:
        names.append(folder)
    return spark.read.schema(df.schema).parquet(folder.toString())


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``settle`` what ``make`` returns, and delete what was settled on the way there."""
    made: list = []
    _SCOPES.append(made)
    try:
        df = make()
    finally:
        _SCOPES[:] = [names for names in _SCOPES if names is not made]
    try:
        return settle(df)
    finally:
        for folder in made:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*frames: DataFrame) -> None:
    """Delete the settled tables under the frames; nothing may read them any more."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.rsplit("/", 1)[1].startswith(_SETTLED):
                folder = spark._jvm.org.apache.hadoop.fs.Path(name)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """So many narrow rows in no more parts than they need; the number grows with them."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def settle_narrow(df: DataFrame, weight: Column | int = 1) -> DataFrame:
    """``settle`` and count narrow rows, and read them in no more parts than they need.

    ``weight`` says how many narrow rows one counts for, or is made into."""
    done = settle(df)
    with dropped_shuffles(df.sparkSession):
        rows = done.agg(F.sum(F.lit(weight) if isinstance(weight, int) else weight)).first()[0]
    return fewer(done, int(rows or 0))
