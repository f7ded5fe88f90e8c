"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one gets as docs.
All but the last return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.llm import langid, linededup, neardup, packing, pii
from trialspark.llm.queries import held_out, vocabulary
from trialspark.operators.joins import drop_in, keep_in
from trialspark.session import settle, shared_folder

LEAST_SCORE = 0.5


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, as the length of the present text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Rejected are texts without a letter, missing ones included, and texts for which the best
    language has a posterior probability below ``LEAST_SCORE``. Without any labelled document
    nothing can be rejected, and all stay.
    """
    model = langid.fit(docs.where(~held_out()), rows_per_language=4000)
    if not model.languages:
        return docs
    names = (
        linededup.fresh("lang_pred", docs.columns), linededup.fresh("lang_score", docs.columns)
    )
    labelled = langid.label(docs, model, names=names)
    known = (F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)
    return labelled.where(known).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of three lines; those emptied stay, empty."""
    cleaned = linededup.drop_repeated_runs(docs, window=3)
    return counted(cleaned.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Five-word shingles and a similarity of 0.8 or more. A document is an id with a text, so texts
    that share an id are compared like any others. A document without an id takes part and comes
    after all that have one. Of rows with the same id and text one stays, the least when written
    as JSON.
    """
    name = linededup.fresh("place", docs.columns)
    # Text that sorts as the ids do, missing ones last.
    unsigned = F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    place = F.concat_ws(
        ":", F.coalesce(F.lpad(unsigned.cast("string"), 20, "0"), F.lit("~")),
        F.hex(F.xxhash64("text")),
    )
    placed = docs.withColumn(name, place)
    found = neardup.near_duplicates(placed, neardup.Plan(words=5, percent=80), key=name)
    marked = settle(
        found.groupBy(name).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
        .where("not kept or rows > 1")
    )
    row = F.struct(*docs.columns)
    repeated = keep_in(placed, marked.where("kept"), [name]).groupBy(name).agg(
        F.min_by(row, F.to_json(row)).alias("row")
    )
    return drop_in(placed, marked, [name]).select(*docs.columns).union(repeated.select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets."""
    selector = pii.fit(docs)
    return counted(pii.redact(docs, selector).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048, stop=0)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

# Language identification and the selection of personal data are learned, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
