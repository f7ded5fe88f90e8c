"""Helpers shared by the operators: batched Python work, word caches, checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trialspark.session import shared_folder

# Rows handled at once by Python code, so that a batch of long texts stays small.
SLICE = 256
# Words of one generation of a worker's cache; two generations live at once.
CACHE_WORDS = 150_000
# Longer words are worked out anew each time, so that the cache is bounded in bytes too.
CACHE_LETTERS = 64


class WordCache(dict):
    """Results by word, at most two generations of ``size`` words.

    ``make`` computes a missing word. When the young generation is full it becomes the old
    one, and the former old one goes; words met again move back to the young generation.
    Words of over ``CACHE_LETTERS`` letters are not kept.
    """

    def __init__(self, make: Callable, size: int = CACHE_WORDS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) > CACHE_LETTERS:
            return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_trialspark_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        root = os.path.dirname(package)
        with tempfile.NamedTemporaryFile(suffix=".zip", prefix="trialspark-", delete=False) as file:
            with zipfile.ZipFile(file, "w") as bundle:
                for folder, _, names in os.walk(package):
                    for name in names:
                        if name.endswith(".py"):
                            path = os.path.join(folder, name)
                            bundle.write(path, os.path.relpath(path, root))
        context.addPyFile(file.name)
    context._trialspark_shipped = True


def map_batches(
    df: DataFrame,
    columns: Sequence[str],
    schema: str | T.StructType,
    start: Callable[[], Callable[..., dict[str, Sequence]]],
    rows: int = SLICE,
) -> DataFrame:
    """Run Python over ``columns`` of ``df``, ``rows`` rows at a time.

    ``start`` is called once per task and returns the function for a slice: it gets one list
    per column and returns the output columns by name. Other columns of ``df`` are not read.
    """
    ship(df.sparkSession)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                out = work(*(column.to_pylist() for column in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in target], schema=target
                )

    return df.select(*columns).mapInArrow(run, schema)


def extend_batches(
    df: DataFrame,
    columns: Sequence[str],
    added: str,
    start: Callable[[], Callable[..., dict[str, Sequence]]],
    rows: int = SLICE,
) -> DataFrame:
    """All columns of ``df`` with the ``added`` ones, which replace columns of their names.

    ``start`` is as in ``map_batches``; the other columns pass through as they are.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names]
    schema = T.StructType([*kept, *new])
    target = to_arrow_schema(new)
    whole = to_arrow_schema(schema)
    read = [f"read_{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows).columns
                out = work(*(column.to_pylist() for column in part[len(kept) :]))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(part[: len(kept)], whole)]
                    + [pa.array(out[f.name], f.type) for f in target],
                    schema=whole,
                )

    # The read columns come last, under their own names, so they cannot clash with kept ones.
    picked = [F.col(f"`{f.name}`").alias(f"kept_{i}") for i, f in enumerate(kept)]
    picked += [F.col(f"`{c}`").alias(r) for c, r in zip(columns, read)]
    return df.select(*picked).mapInArrow(run, schema)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
