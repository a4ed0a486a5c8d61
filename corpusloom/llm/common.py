"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids whose labels no model may see."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where that is unset, one of our own, if all run on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one operator call, written as Parquet in the shared folder.

    A written table cuts the lineage and outlives any executor. drop() removes a table that nothing reads any more;
    what the returned DataFrame still reads goes when the driver ends.
    """

    #: Those opened inside passing().
    opened: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        for within in self.opened:
            within.append(self)
        self.path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def write(self, df: DataFrame, name: str, tasks: int | None = None, compression: str = "uncompressed") -> DataFrame:
        """df as a written table; by so many tasks at most where its size is known to be small.

        Hashes and ids do not compress, and a codec's buffers would stay outside the heap until a collection.
        """
        at = f"{self.path}/{name}"
        df = df.coalesce(tasks) if tasks else df
        df.write.mode("overwrite").parquet(at, compression=compression)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                _delete(self.spark, self.path)
            except Exception:  # the JVM may be gone at exit; the folder's owner cleans it then
                return


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """The intermediate tables that are opened inside go at the end: what was made of them is written by then."""
    Scratch.opened.append([])
    try:
        yield
    finally:
        for scratch in Scratch.opened.pop():
            scratch._close()


#: Rows that a Python worker holds at a time.
ROWS = 500


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into short ones, so that a worker holds few texts and results at a time; an empty one stays."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def tasks_for(rows: int, each: int = 20_000) -> int:
    """Tasks for a table of that many narrow rows."""
    return max(1, -(-rows // each))


#: Ids (16 bytes each in a hash relation, about) up to which a counted side of a join is broadcast.
IDS = 2_000_000


def counted(side: DataFrame, rows: int, most: int = IDS) -> DataFrame:
    """A side of a join that holds so many rows, counted: broadcast up to `most`, joined by a shuffle beyond."""
    return F.broadcast(side) if rows <= most else side


def fresh(df: DataFrame, base: str, taken: Iterable[str] = ()) -> str:
    """A column name like base that df has not got, whatever else its rows carry."""
    used = {c.lower() for c in (*df.columns, *taken)}
    name = base
    while name.lower() in used:
        name += "_"
    return name


# Decisions on rows, told where the rows are read

#: Rows of a file whose marks are gathered together, at most.
MARKED = 1 << 15


def located(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the file and the row of it that each row is, and the names of these columns.

    Files don't change, so a row has the same place whenever it is read. Only a table as it is read has places; any other
    docs are written first.
    """
    kind = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if kind != "LogicalRelation" or not docs.inputFiles() or "row_index" not in _hidden(docs):
        docs = scratch.write(docs, "placed", compression="snappy")
    file, row = fresh(docs, "in_file"), fresh(docs, "in_row")
    return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row


def _hidden(docs: DataFrame) -> list[str]:
    try:
        return docs.select("_metadata.*").columns
    except Exception:  # the source tells nothing of its files
        return []


def chosen(scratch: Scratch, at: DataFrame, file: str, row: str, marks: DataFrame, name: str, otherwise: int, then: tuple[Callable, str] | None = None) -> DataFrame:
    """The rows of at (docs located) as often as marks (file, row, n) say, and `otherwise` times where they don't, without file
    and row. then: what the same workers make of the rows, as for mapInArrow, and its columns.

    The marks of a file are an array in a folder of its own, and a task reads those of the files that it reads. So at any size
    the rows are read once more and never shuffled, and what a task holds of the decisions grows with its file alone.
    """
    files = max(1, len(at.inputFiles()))
    part = F.pmod(F.crc32(F.col(file)), F.lit(files)).cast("int").alias("part")
    runs = marks.groupBy(part, F.col(file).alias("file"), F.expr(f"`{row}` div {MARKED}").alias("run")).agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("row"), F.col("n").cast("int").alias("n")))).alias("m"))
    runs = runs.select("part", "file", F.col("m.row").alias("rows"), F.col("m.n").alias("n")).repartition("part")
    folder = f"{scratch.path}/{name}"
    runs.write.mode("overwrite").partitionBy("part").parquet(folder, compression="uncompressed")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    columns = [c for c in at.columns if c not in (file, row)]
    kept = at.select(*(F.col(f"`{c}`") for c in columns), F.pmod(F.crc32(F.col(file)), F.lit(files)).cast("int"), file, row)
    first = _chosen(folder, otherwise)
    if then:
        return kept.mapInArrow(lambda batches: then[0](first(batches)), then[1])
    return kept.mapInArrow(first, at.select(*(F.col(f"`{c}`") for c in columns)).schema)


def _chosen(folder: str, otherwise: int):
    def marks(part: int, file: str) -> tuple[np.ndarray, np.ndarray]:
        store, root = fs.FileSystem.from_uri(folder)
        there = store.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
        rows, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in there:
            if at.path.endswith(".parquet"):
                table = pq.ParquetFile(store.open_input_file(at.path)).read()
                for named, own, k in zip(table["file"].to_pylist(), table["rows"], table["n"], strict=True):
                    if named == file:
                        rows.append(own.values.to_numpy(zero_copy_only=False))
                        n.append(k.values.to_numpy(zero_copy_only=False))
        rows, n = np.concatenate(rows), np.concatenate(n)
        order = np.argsort(rows, kind="stable")
        return rows[order], n[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, np.ndarray, np.ndarray] = (None, np.empty(0), np.empty(0))
        for batch in slices(batches):
            parts, files, rows = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
            rows, n = rows.to_numpy(), np.full(batch.num_rows, otherwise, dtype=np.int64)
            files, names = np.array(files.to_pylist(), dtype=object), parts.to_pylist()
            for file in dict.fromkeys(files):  # one, as a rule
                mine = np.flatnonzero(files == file)
                if held[0] != file:
                    held = (file, *marks(names[mine[0]], file))
                _, known, often = held
                if len(known):
                    at = np.minimum(np.searchsorted(known, rows[mine]), len(known) - 1)
                    n[mine] = np.where(known[at] == rows[mine], often[at], otherwise)
            own = batch.select(list(range(batch.num_columns - 3)))
            yield own if (n == 1).all() else own.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))

    return run
