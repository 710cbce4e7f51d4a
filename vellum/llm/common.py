"""Helpers that the corpus operators share: shared folder, written tables, row-wise Arrow stages."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Kept = TypeVar("Kept")

#: Rows that one Arrow batch holds at most: with whole texts in them, memory is what counts.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and names a shared folder where the cluster names none (tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._vellum_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, but with a local master only: executors elsewhere would not share it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if named or held.isDefined():
        return (named or held.get()).rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="vellum-")
    sc.setCheckpointDir(own)
    return own


#: Shuffle files of a SQL execution are deleted as it ends (not when the driver happens to collect its garbage).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time being."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """documents with row_file and row_at, which name a row in every evaluation.

    They are the hash of its file's path and its place in it where documents are projections and filters of
    Parquet files; anything else is written once, and numbered there.
    """
    plan = documents._jdf.queryExecution().optimizedPlan()
    steady = plan.deterministic()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if steady and plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString():
        with contextlib.suppress(AnalysisException):
            return documents.withColumns({"row_file": F.xxhash64("_metadata.file_path"), "row_at": F.col("_metadata.row_index")})
    return scratch.save(documents.withColumns({"row_file": F.lit(0).cast("long"), "row_at": F.monotonically_increasing_id()}))


#: Of each temporary() that is going on, what has been opened in it.
_opened: list[list[Scratch]] = []


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Deletes at its end the tables of every Scratch that was opened in it."""
    _opened.append([])
    try:
        yield
    finally:
        for scratch in _opened.pop():
            scratch.clear()


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _opened:
            _opened[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """df as a written table; shuffle files of the writing go with it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with settings(self.spark, {_CLEANUP: "true"}):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vellum_path = path
        return out

    def clear(self) -> None:
        """Deletes all of its tables."""
        delete(self.spark, self.root)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for t in tables:
            delete(self.spark, t._vellum_path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What this worker keeps from task to task, by the operator that it is of.
_kept: dict[str, object] = {}


def only(operator: str) -> None:
    """Forgets what this worker keeps for other operators: in a pipeline the next stage gets the same workers."""
    if others := [k for k in _kept if k != operator]:
        for k in others:
            del _kept[k]
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)


def kept(operator: str, make: Callable[[], Kept]) -> Kept:
    """What make() gave this worker for an operator, until another one runs in it."""
    only(operator)
    if operator not in _kept:
        _kept[operator] = make()
    return _kept[operator]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: Columns that operators read or change under these names.
_OWN = ("doc_id", "text", "n_chars")


def shielded(documents: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """change() of documents, by which only rows go or texts change, whatever other columns are called."""
    safe = [c if c in _OWN else f"other{k}" for k, c in enumerate(documents.columns)]
    return change(documents.toDF(*safe)).select(*safe).toDF(*documents.columns)


def append_columns(df: DataFrame, added: list[tuple[str, T.DataType]], work: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], replace: bool = False) -> DataFrame:
    """df with columns that work() computes from Arrow batches; all others pass through untouched.

    work() gets the batches of a partition and yields for each one the added columns' arrays. With
    replace, columns of the added names that df has already are taken over by the new ones.
    """
    names = {n for n, _ in added}
    if not replace and names & set(df.columns):
        raise ValueError(f"columns {sorted(names & set(df.columns))} are there already")
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in added)])
    kept, arrow = [f.name for f in keep], [(n, to_arrow_type(t)) for n, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield b

        for arrays in work(each()):
            b = held.pop(0)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in kept] + [pa.array(a, type=t) if not isinstance(a, pa.Array) else a.cast(t) for a, (_, t) in zip(arrays, arrow, strict=True)], names=kept + [n for n, _ in arrow])

    return df.mapInArrow(run, schema)


#: Bytes of words stay, A-Z as a-z; every other byte becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and all that is not ASCII, with A-Z as a-z."""
    return text.translate(_FOLD).split()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def single(df: DataFrame) -> tuple:
    """The one row of an aggregate without groups."""
    return tuple(df.first())
