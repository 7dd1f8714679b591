"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence, Sized

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table: A-Z to a-z, all else unchanged
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Arrow batches are worked on in slices of about this many text bytes
SLICE_BYTES = 8 << 20
SLICE_ROWS = 4096


_kept: dict[tuple[str, object], object] = {}


def kept(operator: str, key, make: Callable):
    """An object that a worker process keeps between the tasks of one operator; what other operators kept goes."""
    if any(o != operator for o, _ in _kept):
        let_go()
    if (operator, key) not in _kept:
        _kept[operator, key] = make()
    return _kept[operator, key]


def let_go() -> None:
    """Empties what this worker process kept, and hands free memory back to the system."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else (no locale, no Unicode folding)."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; on one machine a temporary one where unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """The columns of the struct `row` of the rows where the condition holds.

    As a generator of no or one row: a filter would be pushed below the projections
    and would there compute what the condition reads anew for each use.
    """
    return df.select(F.explode(F.when(condition, F.array("row"))).alias("row")).select("row.*")


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """UTF-8 bytes of a text column, over all rows (0 for an empty table), and the number of rows."""
    size, rows = df.agg(F.sum(F.octet_length(column)), F.count(F.lit(1))).first()
    return size or 0, rows


def spread_join(rows: DataFrame, key: str, stats: DataFrame, values: Sequence[str], heavy: Column, spare: Column) -> DataFrame:
    """rows with the columns `values` of their key's row in `stats` (one per key at most), null where there is none.

    No task gets all rows of a hot key: the rows of stats for which `heavy` holds (the caller sees to it that they are
    few, e.g. keys with over 1 / 2048 of all rows) are broadcast, and rows of their keys are dealt by `spare`
    (of the key's type) in the join with the others.
    """
    held = [F.col(c) for c in rows.columns]
    hot = F.broadcast(stats.where(heavy).select(F.col(key).alias("__hot"), F.struct(*values).alias("__of_hot")))
    cold = stats.where(~F.coalesce(heavy, F.lit(False))).select(F.col(key).alias("__cold"), F.struct(*values).alias("__of_cold"))
    out = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    out = out.withColumn("__at", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spare))
    out = out.join(cold, F.col("__at") == F.col("__cold"), "left")
    of = F.when(F.col("__hot").isNotNull(), F.col("__of_hot")).when(F.col(key) == F.col("__cold"), F.col("__of_cold"))
    return out.select(*held, of.alias("__of")).select(*rows.columns, *[F.col("__of")[v].alias(v) for v in values])


def slices(batch: Sized, sizes: Sequence[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about `most` bytes each, one row at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most or i - start >= SLICE_ROWS):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(docs: DataFrame, carry: Sequence[str], make: Callable, out: str, text: str = "text", beside: Column | None = None) -> DataFrame:
    """Adds the columns `out` (DDL) to the columns `carry`, by a function of whole texts.

    `make()` runs once in each task and returns a function from a list of UTF-8
    byte strings (None for null) to a list of Python lists or Arrow arrays, one
    for each column of `out`; with `beside`, it also gets that column's values. The carried columns travel
    as one struct, so that no name of theirs can clash with an output's.
    """
    kind = _parse_datatype_string(out)
    more = [] if beside is None else [beside.alias("beside")]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).cast("string").alias("text"), *more)
    schema = StructType([StructField("row", source.schema["row"].dataType), StructField("out", kind)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        apply = make()
        arrow = to_arrow_type(kind)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist() if len(batch) else []
            for a, b in slices(batch, sizes):
                got = apply(*[c.slice(a, b - a).to_pylist() for c in (texts, *batch.columns[2:])])
                columns = [x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(i).type) for i, x in enumerate(got)]
                made = pa.StructArray.from_arrays(columns, fields=[arrow.field(i) for i in range(arrow.num_fields)])
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), made], names=["row", "out"])

    return source.mapInArrow(run, schema)
