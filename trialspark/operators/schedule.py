"""Word draws and trial order of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.operators.joins import lookup
from trialspark.operators.ordered import CHUNK_ROWS, row_numbers

BREAK_EVERY = 44


def hash_number(*parts: Column) -> Column:
    """Repeatable number in [0, 2^32) from the first hex digits of an MD5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_word(key: Column, words: Sequence[str]) -> tuple[Column, Column]:
    """One of the word columns, and the blank it belongs to: first half subject."""
    index = F.pmod(key, F.lit(len(words)))
    word = F.element_at(F.array(*words), (index + 1).cast("int"))
    return word, F.when(index < len(words) // 2, "[subj]").otherwise("[obj]")


def assign_words(
    trials: DataFrame, items: DataFrame, words: Sequence[str], seed: int = 0
) -> DataFrame:
    """Draw the word of each filler or practice trial.

    ``trials`` lists (subject, item); ``items`` holds the word columns of each item. A trial of
    an unlisted item is kept, without word and target.
    """
    listed = items.select("item", *words, F.lit(True).alias("_listed"))
    joined = trials.join(listed, "item", "left")
    key = hash_number(
        F.lit(str(seed)), F.col("subject").cast("string"), F.col("item").cast("string")
    )
    word, target = draw_word(key, words)
    target = F.when(F.col("_listed"), target)
    return joined.select("subject", "item", word.alias("word"), target.alias("target_response"))


def interleave_every_n(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    separators: Sequence[str],
    n: int,
    kind: str = "row_kind",
    chunk: Column | None = None,
) -> DataFrame:
    """Reverse the rows of each key and put the separators after every ``n`` of them.

    Adds the 0-based ``position`` and ``kind``: NULL for rows, the separator otherwise.
    There is no separator after the last row. Separators come from the row before them, so
    a long list is never expanded in one task.
    """
    if n < 1:
        raise ValueError("n must be positive")
    numbered = row_numbers(df, keys, order, "_forward", chunk, total="_length")
    index = F.col("_length") - F.col("_forward")
    position = index + F.floor(index / n) * len(separators)
    closes = (index % n == n - 1) & (F.col("_forward") > 1)

    def slot(offset: int, label: Column) -> Column:
        return F.struct((position + offset).alias("position"), label.alias(kind))

    row = slot(0, F.lit(None).cast("string"))
    gaps = [slot(i + 1, F.lit(s)) for i, s in enumerate(separators)]
    slots = F.when(closes, F.array(row, *gaps)).otherwise(F.array(row)) if gaps else F.array(row)
    spread = numbered.withColumn("_slot", F.explode(slots)).select(
        *df.columns, F.col("_slot.position").cast("bigint").alias("position"),
        F.col(f"_slot.{kind}").alias(kind),
    )
    is_row = F.col(kind).isNull()
    return spread.select(
        *(F.col(c) if c in keys else F.when(is_row, F.col(c)).alias(c) for c in df.columns),
        "position", kind,
    )


def schedule(
    trials: DataFrame, n: int = BREAK_EVERY, seed: int = 0, slice_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Shuffled test trials of each subject with a break after every ``n``.

    ``trials`` lists (subject, item) once each. The shuffle orders by a hash, and every subject
    is cut by as many leading hex digits as leave about ``slice_rows`` trials in a slice or
    fewer, so slices do not grow with the subject.
    """
    digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.col("subject").cast("string"),
                    F.col("item").cast("string"))
    )
    digits = F.ceil(F.log(16.0, F.count(F.lit(1)) / slice_rows))
    sizes = trials.groupBy("subject").agg(
        F.greatest(F.lit(0), digits).cast("int").alias("_digits")
    )
    sized = lookup(
        trials.select("subject", "item", digest.alias("_digest")), sizes, ["subject"]
    )
    placed = interleave_every_n(
        sized, ["subject"], ["_digest", "item"], ["break"], n,
        chunk=F.substring(F.col("_digest"), F.lit(1), F.col("_digits")),
    )
    return placed.drop("_digest", "_digits").withColumn(
        "row_kind", F.coalesce("row_kind", F.lit("trial"))
    )
