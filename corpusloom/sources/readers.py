"""Sources: Parquet tables, JSON lines in three tempers, file families, unions with one id space, column harvest, sinks."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, bad: str = "skip") -> DataFrame:
    """JSON lines, plain or compressed by their suffix; blank lines are no rows.

    bad: skip drops lines that do not parse, fail raises on the first, keep has them as nulls with _corrupt_record.
    """
    mode = {"skip": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[bad]
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if bad == "keep" and "_corrupt_record" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", mode).json(path)


def family(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """All files of a glob with file (the name) and category (the name up to the first dot), so rows can be counted by file."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.schema(schema).json(glob).withColumn("file", name).withColumn("category", F.substring_index("file", ".", 1))


def union(parts: list[DataFrame], order: Column | str) -> DataFrame:
    """One table of several sources: src is the source's number, ln the row's given number in it."""
    tagged = [p.withColumn("src", F.lit(i)).withColumn("ln", F.expr(order) if isinstance(order, str) else order) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def landed(spark: SparkSession, path: str) -> str:
    """Where an object lies: the path, or the file in it if it landed as a folder that holds only a file of its own name."""
    at, store = _store(spark, path)
    inner = [f.getPath() for f in store.listStatus(at)] if store.exists(at) and store.getFileStatus(at).isDirectory() else []
    return inner[0].toString() if len(inner) == 1 and inner[0].getName() == at.getName() else path


def write_artifact(spark: SparkSession, value: object, path: str, overwrite: bool = False) -> None:
    """One JSON document at a path of any file system Spark knows; an existing one stops the write unless asked for."""
    at, store = _store(spark, path)
    out = store.create(at, overwrite)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
    out.close()


def harvest(rows: DataFrame, preferred: list[str], name: str = "harvest", least: int = 30, levels: int = 6, most: int = 64) -> DataFrame:
    """rows with the text to compare: the preferred string columns that are there, joined by newlines; without any, every
    string of `least` characters and more found in the row as JSON, so many levels down, the first `most` + 1 of them."""
    found = [c for c in preferred if c in rows.columns and rows.schema[c].dataType == T.StringType()]
    if found:
        return rows.withColumn(name, F.concat_ws("\n", *found))

    def walk(x: object, depth: int, out: list[str]) -> None:
        if len(out) > most or depth > levels:
            return
        if isinstance(x, str):
            if len(x) >= least:
                out.append(x)
        elif isinstance(x, dict):
            for v in x.values():
                walk(v, depth + 1, out)
        elif isinstance(x, list):
            for v in x:
                walk(v, depth + 1, out)

    @F.pandas_udf("string")
    def strings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = []
            for row in batch:
                out: list[str] = []
                walk(json.loads(row), 0, out)
                texts.append("\n".join(out))
            yield pd.Series(texts)

    return rows.withColumn(name, strings(F.to_json(F.struct(*rows.columns))))


def write_manifest(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Gzip JSON lines; an existing target stops the write unless overwriting is asked for."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip").json(path)


def _renamed(store, a, b) -> bool:
    return store.rename(a, b)


def summed(rows: DataFrame) -> dict[str, str | int]:
    """The number of rows and a digest of them that does not depend on their order; rows that repeat count."""
    h = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}))
    n, digest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
    return {"rows": n, "digest": str(digest)}


def promote(spark: SparkSession, outputs: dict[str, DataFrame], target: str, expected: dict[str, dict] | None = None, force: bool = False) -> dict[str, dict]:
    """Publish several tables together below target: all of them, verified, or none; what each holds is returned.

    The tables are written beside the target first and read again there. expected says what is known of any of them (rows,
    digest, as summed gives them); another number or digest stops everything before the target is touched, and so do tables
    that are there already, unless forced. Only then are the folders renamed; where that fails, what was there comes back.
    """
    at, store = _store(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = [name for name in outputs if store.exists(path(at, name))]
    if there and not force:
        raise FileExistsError(f"{target} holds {', '.join(there)}")
    work = path(at.getParent() or at, f".staged-{uuid.uuid4().hex}")
    fresh, old = path(work, "staged"), path(work, "old")
    done, moved, told = [], [], {}
    try:
        for name, rows in outputs.items():
            folder = path(fresh, name).toString()
            rows.write.parquet(folder)
            told[name] = summed(spark.read.schema(rows.schema).parquet(folder))
            wrong = {k: v for k, v in (expected or {}).get(name, {}).items() if told[name][k] != v}
            if wrong:
                raise ValueError(f"{name} holds {told[name]}, not {wrong}")
        store.mkdirs(at)
        store.mkdirs(old)
        for name in outputs:
            if store.exists(path(at, name)):
                if not _renamed(store, path(at, name), path(old, name)):
                    raise OSError(f"{name} can't be set aside")
                moved.append(name)
            if not _renamed(store, path(fresh, name), path(at, name)):
                raise OSError(f"{name} can't be published")
            done.append(name)
        return told
    except OSError:
        for name in done:
            store.delete(path(at, name), True)
        for name in moved:
            _renamed(store, path(old, name), path(at, name))
        raise
    finally:
        store.delete(work, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, which goes when the driver ends; on one machine a temporary one will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='corpusloom-')).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, at)
    return at


def _gone(spark: SparkSession, at: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            where, store = _store(spark, at)
            store.delete(where, True)
        except Exception:  # the JVM may be gone at exit; the folder's owner cleans it then
            return


def write_splits(rows: DataFrame, path: str, split: str, pool: Column, overwrite: bool = False) -> None:
    """Rows by split, and the pool rows (those without a target) beside them."""
    mode = "overwrite" if overwrite else "errorifexists"
    rows.filter(~pool).write.mode(mode).partitionBy(split).json(f"{path}/rows", compression="gzip")
    rows.filter(pool).write.mode(mode).json(f"{path}/pool", compression="gzip")


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more rows than `most` are refused rather than cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report")
    cells = lambda r: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |"
    return "\n".join([f"## {title}", "", cells(rows.columns), "|" + " --- |" * len(rows.columns), *map(cells, found)]) + "\n"
