"""Shared helpers of the training-data operators: shared storage, Arrow mapping, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words in most contracts: space and \t \n \v \f \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

_U = np.uint64
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all runs in one process, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="cardloom-"))
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cardloom/{label}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch between the JVM and Python where rows are whole documents: a batch is in memory several times over on both sides.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, if they are larger; for operators that run when their result is read."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialise(df: DataFrame, label: str, codec: str = "snappy", files: int | None = None, batch: int = BATCH_ROWS) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. files: at most so many, for tables of few rows; batch: rows of an Arrow batch."""
    path = new_path(df.sparkSession, label)
    with batches(df.sparkSession, batch):
        (df if files is None else df.coalesce(files)).write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by materialise() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Temporary:
    """Tables made by materialise() that are deleted together."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, label: str, codec: str = "snappy", files: int | None = None, batch: int = BATCH_ROWS) -> DataFrame:
        self.tables.append(materialise(df, label, codec, files, batch))
        return self.tables[-1]

    def drop(self) -> None:
        release(*self.tables)
        self.tables = []


def with_row(docs: DataFrame, *cols: str) -> DataFrame:
    """`row`, a struct of all columns of docs, and the columns named: computed columns beside it can't clash with any of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in cols])


def give_back() -> None:
    """Return freed memory to the system at the end of a task: its Python worker is kept for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list], setup: Callable[[], None] | None = None, rows: int = 512) -> DataFrame:
    """Append `fields`, computed by fn from slices of at most `rows` rows; columns of df with the same names are replaced."""
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [f.name for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, rows):
                b = big.slice(at, rows)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in kept] + fn(b), names=kept + [f.name for f in fields])
        give_back()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Characters in a chunk of a text that is cut at many places.
CHUNK = 4096


def chunks(text: str) -> str:
    """SQL for a text in chunks, so that piece() needs no count of characters from its beginning."""
    return f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"


def piece(p: str, q: str, ch: str = "ch") -> str:
    """SQL for characters p to q (exclusive, not before p) of the text whose chunks are ch."""
    one = lambda at, n: f"substring(coalesce(get({ch}, cast({at} div {CHUNK} as int)), ''), cast({at} % {CHUNK} as int) + 1, cast({n} as int))"
    whole = f"array_join(slice({ch}, cast({p} div {CHUNK} as int) + 2, cast({q} div {CHUNK} - {p} div {CHUNK} as int) - 1), '')"
    last = f"if({q} % {CHUNK} = 0, '', substring(get({ch}, cast({q} div {CHUNK} as int)), 1, cast({q} % {CHUNK} as int)))"
    return f"if({p} div {CHUNK} = {q} div {CHUNK}, {one(p, f'{q} - {p}')}, concat({one(p, CHUNK)}, {whole}, {last}))"


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def lower_ascii(col):
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For str.translate: A-Z to a-z, nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-case A-Z of a Python string (the bytes method touches ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
