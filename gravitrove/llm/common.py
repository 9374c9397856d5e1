"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space (regular expression for Spark and Python).
WORD = r"[^\x20\x09-\x0D]+"

#: What separates the words of the decontamination and licence operators.
PLAIN_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of PLAIN_BREAK become spaces and A-Z become a-z; every byte of a non-ASCII character stays.
PLAIN_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))

#: A table is sent to every executor only if its measured bytes are no more than this.
BROADCAST_BYTES = 32 << 20
#: Bytes of one Arrow batch between Spark and a Python worker; a batch holds at least one row.
BATCH_BYTES = 4 << 20
#: Spark's setting (4.1 and later) that removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in local tests, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gravitrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, release: bool = False) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor then costs only the tasks that read these files. Sizes of files tell Catalyst how
    large the table is. With `release` the shuffle files of the write go at its end; else they stay until
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gravitrove-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        if release:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES: rows of text differ too much in size for a limit on their number.

    PySpark's mapInArrow can't take a column name with a dot; run gets such columns under a number.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if any(set("`.") & set(c) for c in df.columns):
        df = df.toDF(*[f"column_{k}" if set("`.") & set(c) else c for k, c in enumerate(df.columns)])
    return df.mapInArrow(run, schema)


def measured_bytes(df: DataFrame, *texts: str) -> int:
    """Bytes of df: its strings in `texts` and 64 bytes a row for the rest."""
    rows = [F.lit(64), *[F.coalesce(F.octet_length(c), F.lit(0)) for c in texts]]
    return df.agg(F.sum(reduce(lambda a, b: a + b, rows).cast("long"))).first()[0] or 0


def named(name: str) -> Column:
    """The column of this very name, whatever dots or quotes it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not use, in any case of letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def plain_names(operator: Callable) -> Callable:
    """Makes an operator of a DataFrame take columns with dots or backticks in their names: it sees them under other names."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        odd = {c: free_name(df, f"column_{k}") for k, c in enumerate(df.columns) if set("`.") & set(c)}
        if not odd:
            return operator(df, *args, **options)
        options = {k: odd.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        found = operator(df.toDF(*[odd.get(c, c) for c in df.columns]), *args, **options)
        back = {v: k for k, v in odd.items()}
        return found.toDF(*[back.get(c, c) for c in found.columns])

    return run


def without(df: DataFrame, names) -> list[str]:
    """The columns of df but those named like `names`, in any case of letters."""
    names = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in names]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of one piece have at most limit bytes, or are one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def listed(strings: pa.LargeStringArray | pa.LargeBinaryArray) -> list[bytes]:
    """The bytes of each string of an array that dictionary_encode made; to_pylist() makes an object more of each."""
    _, offsets, raw = strings.buffers()
    if not len(strings):
        return []
    ends, raw = np.frombuffer(offsets, "<i8", len(strings) + 1).tolist(), raw.to_pybytes() if raw else b""
    return [raw[i:j] for i, j in zip(ends, ends[1:])]
