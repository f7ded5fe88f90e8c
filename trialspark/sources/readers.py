"""Readers. Every schema is declared; nothing is inferred from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trialspark import schemas as S


def _field(parts: Column, position: int, field: T.StructField) -> Column:
    text = F.get(parts, F.lit(position))
    known = F.when(text != "NA", text)
    if isinstance(field.dataType, T.StringType):
        # a short row is padded with blanks, and a blank text is not missing
        return F.when(text.isNull(), "").otherwise(known).alias(field.name)
    return F.trim(known).try_cast(field.dataType).alias(field.name)


def read_event_log(
    spark: SparkSession, path: str | list[str], schema: T.StructType = S.EVENT_LOG
) -> DataFrame:
    """Headerless log without quoting: ``#`` starts a comment, short rows are padded.

    ``fields`` counts the fields of a line, and ``surplus`` holds those past the schema as they
    stand, NULL if there are none; ``bad_numbers`` counts numbers that cannot be read and are
    NULL for that. Adds ``row_id``, a struct that sorts in file order over any number of files and splits.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "#.*$", "").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("row_id"),
    )
    filled = lines.where(F.trim("line") != "").withColumn("parts", F.split("line", ","))
    parts, width = F.col("parts"), len(schema)
    unread = [
        (F.trim(F.get(parts, F.lit(i))) != "") & (F.get(parts, F.lit(i)) != "NA")
        & _field(parts, i, f).isNull()
        for i, f in enumerate(schema) if not isinstance(f.dataType, T.StringType)
    ]
    return filled.select(
        "row_id", *(_field(parts, i, f) for i, f in enumerate(schema)),
        F.size("parts").alias("fields"),
        F.when(
            F.size("parts") > width,
            F.array_join(F.slice("parts", width + 1, F.greatest(F.size("parts") - width, F.lit(1))), ","),
        ).alias("surplus"),
        sum((F.coalesce(x, F.lit(False)).cast("int") for x in unread), F.lit(0)).alias("bad_numbers"),
    )


def read_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Item file of a kind in ``schemas.ITEMS``, with header and quoted sentences."""
    return spark.read.csv(path, header=True, schema=S.ITEMS[kind], escape='"', enforceSchema=False)


def _by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name; one that is not there is NULL, and so is NaN."""

    def one(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(f"`{field.name}`").try_cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            value = F.nanvl(value, F.lit(None).cast("double"))
        return value.alias(field.name)

    return df.select("row_id", *map(one, schema))


def _read_gzipped(
    spark: SparkSession, root: str, pattern: str, schema: T.StructType, spread: int | None
) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    lines = files.text(root).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    # One header per file; files with the same header are read together.
    headers = (
        lines.groupBy("file").agg(F.min_by("value", "seq").alias("header"))
        .groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    )
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    parts = [
        _by_name(
            spark.read.csv(row.files, header=True, nullValue="NA", escape='"', enforceSchema=False)
            .withColumn("row_id", place),
            schema,
        )
        for row in sorted(headers, key=lambda row: row.header)
    ]
    if not parts:
        raise FileNotFoundError(f"no {pattern} with rows below {root}")
    rows = reduce(DataFrame.unionByName, parts).select(*schema.names, "row_id")
    return rows.repartition(spread) if spread else rows


def read_model_scores(
    spark: SparkSession, root: str, spread: int | None = None,
    pattern: str = "*odds_ratios.csv.gz",
) -> DataFrame:
    """All model score files below ``root``, matched by column name.

    Headers may differ in order and in further columns; a column that a file lacks is NULL. The
    first lines are looked up in a pass of their own.

    A gzipped file is read by one task; ``spread`` repartitions afterwards, for few large
    files.
    """
    return _read_gzipped(spark, root, pattern, S.MODEL_SCORES, spread)


def read_cossims(
    spark: SparkSession, root: str, spread: int | None = None,
    pattern: str = "*cossims.csv.gz",
) -> DataFrame:
    """All cosine-similarity files below ``root``."""
    return _read_gzipped(spark, root, pattern, S.COSSIMS, spread).drop("row_id")


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """A written accuracy table; ``subject`` and ``item`` are labels, not numbers."""
    df = spark.read.csv(path, header=True, nullValue="NA")
    # names as R writes them, such as ``voice.n``
    df = df.toDF(*(c.replace(".", "_") for c in df.columns))
    kinds = {
        "correct": "boolean", "log_rt": "double", "rt": "double", "f_score": "double",
        "f_score_pre_training": "double", "target_response_n": "double",
        "data_source_n": "double", "voice_n": "double",
        "max_cossim_to_targets": "double", "mean_cossim_to_targets": "double",
        "max_cossim_to_targets_pre_training": "double",
        "mean_cossim_to_targets_pre_training": "double",
    }
    nested = {c: "double" for c in df.columns if "_i_n_" in c}
    return df.withColumns(
        {c: F.col(f"`{c}`").try_cast(kind) for c, kind in {**kinds, **nested}.items() if c in df.columns}
    )
