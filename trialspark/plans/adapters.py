"""The benchmark tables read as experiment data; every table is used whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark import schemas as S
from trialspark.operators.metrics import contrasts
from trialspark.operators.ordered import row_numbers

# People have ids below this one; models get theirs after it.
LAST_HUMAN = 10_000_000_000
CLOCK_SCALE = 600
VERBS = ["break", "buy", "eat", "read", "regret"]
WORDS = list(S.EAT_TO_DRINK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


# -- lineitem: trials ---------------------------------------------------------------------


def _trial_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject, item = F.col("l_suppkey"), F.col("l_partkey")
    source = subject % 4
    filler = F.col("l_returnflag") == "N"
    passive = F.col("l_linestatus") == "O"
    to_subject = F.when(filler, item % 2 == 0).otherwise(F.col("l_returnflag") == "A")
    correct = F.col("l_quantity") <= 25 + 5 * (subject % 5)
    human = source == 0
    adverb = pick(S.ADVERBS, item % 4)
    word = F.when(filler, pick(WORDS, item % 12)).otherwise(
        F.when(item == 0, "pearl").when(item == 1, "lobster")
        .otherwise(F.concat(F.lit("w"), item.cast("string")))
    )
    return table(spark, sf_dir, "lineitem").select(
        subject.alias("subject"),
        F.when(filler, "filler").otherwise("experimental").alias("condition"),
        F.lit(S.TRAINING_LABEL).alias("training"),
        item.cast("string").alias("item"),
        word.alias("word"),
        F.when(to_subject, "[subj]").otherwise("[obj]").alias("target_response"),
        F.when(filler, pick(VERBS, item % 5)).otherwise("buildings_vehicles")
        .alias("args_group"),
        F.when(passive, "perfect passive").otherwise("perfect transitive")
        .alias("sentence_type"),
        F.when(passive, F.concat(F.lit("The [obj] has "), adverb,
                                 F.lit(" been blorked by the [subj].")))
        .otherwise(F.concat(F.lit("The [subj] has "), adverb, F.lit(" blorked the [obj].")))
        .alias("sentence"),
        adverb.alias("adverb"),
        F.when(~filler, "True").alias("seen_in_training"),
        pick([S.HUMAN, *S.MODELS], source).alias("data_source"),
        F.lit(None).cast("string").alias("mouse"),
        F.when(to_subject == correct, "[subj]").otherwise("[obj]").alias("response"),
        F.when(human, F.ln("l_extendedprice")).alias("log_rt"),
        correct.alias("correct"),
        F.when(~human, F.col("l_discount") < 0.05).alias("correct_pre_training"),
        F.when(passive, S.PASSIVE).otherwise(S.ACTIVE).alias("voice"),
        F.when(subject % 8 == 7, S.MASKED).otherwise(S.UNMASKED).alias("mask_added_tokens"),
        F.when(subject % 8 == 5, S.EARLY_STOP).otherwise(S.CONVERGENCE).alias("stop_at"),
        F.when(~human, F.concat(F.lit("model-"), (subject % 10).cast("string")))
        .alias("model_id"),
        "l_quantity", "l_discount", "l_linenumber",
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged trial table with display labels."""
    rows = _trial_columns(spark, sf_dir)
    return rows.select(*(f.name for f in S.TRIALS)).withColumns(
        {
            "target_response": F.when(F.col("target_response") == "[subj]", S.SUBJECT_TARGET)
            .otherwise(S.OBJECT_TARGET),
            "seen_in_training": F.when(F.col("seen_in_training") == "True", "Seen"),
        }
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People's trials as they leave the log, fillers with one group per item."""
    rows = _trial_columns(spark, sf_dir).where(F.col("data_source") == S.HUMAN)
    own_group = F.when(
        F.col("condition") == "filler", F.concat(F.lit("verb"), F.col("item"))
    ).otherwise(F.col("args_group"))
    return rows.select(
        *(f.name for f in S.TRIALS if f.name not in ("training", "model_id"))
    ).withColumn("args_group", own_group)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows as raw scores; models come in the order of their ids."""
    rows = _trial_columns(spark, sf_dir).where(F.col("data_source") != S.HUMAN)
    filler = F.col("condition") == "filler"
    large = F.col("data_source").startswith("Modern")
    odds = 25.5 + 5 * (F.col("subject") % 5) - F.col("l_quantity")
    token = (
        F.when(large & (F.col("word") == "pearl"), "chalk")
        .when(large & (F.col("word") == "lobster"), "crab").otherwise(F.col("word"))
    )
    return rows.select(
        "model_id",
        F.lower("data_source").alias("model_name"),
        (F.col("subject") + LAST_HUMAN + 1000).alias("random_seed"),
        F.when(filler, F.concat(F.lit("syn_verb"), F.col("item"), F.lit("_ext_for_human_exp")))
        .otherwise(S.EXPERIMENTAL_EVAL).alias("eval_data"),
        F.concat(F.when(large, "Ġ").otherwise(""), token).alias("token"),
        F.when(filler, F.when(F.col("l_linenumber") == 1, "eval added").otherwise("eval special"))
        .otherwise(F.when(F.col("item").cast("bigint") % 3 == 2, "eval added").otherwise("tuning"))
        .alias("token_type"),
        F.col("target_response").alias("arg_type"),
        F.when(F.col("target_response") == "[subj]", "[subj]/[obj]").otherwise("[obj]/[subj]")
        .alias("ratio_name"),
        odds.alias("odds_ratio"),
        (odds - (0.045 - F.col("l_discount"))).alias("odds_ratio_pre_post_difference"),
        F.when(F.col("stop_at") == S.CONVERGENCE, 5000).otherwise(260).cast("bigint")
        .alias("max_epochs"),
        (F.col("mask_added_tokens") == S.MASKED).alias("mask_added_tokens"),
        F.lower("sentence").alias("sentence"),
        "sentence_type",
        F.when(~filler, F.col("args_group")).alias("args_group"),
        F.col("subject").alias("row_id"),
    )


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experimental trials with contrasts."""
    rows = trials(spark, sf_dir).where(F.col("condition") == "experimental")
    return rows.select(
        "subject", "item", "data_source", "target_response", "voice", "correct"
    ).transform(contrasts)


def session_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which subject gets which item, once each."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("item")
    ).distinct()


def word_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with twelve candidate words."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        *(F.concat("p_name", F.lit(f" {i}")).alias(f"word_{i}") for i in range(12)),
    )


def filler_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as filler items; sentences hold commas and quotes."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("item"),
        F.concat(F.lit('The "'), "p_name", F.lit('" has, '), "p_brand").alias("sentence"),
        F.col("p_type").alias("sentence_type"), F.col("p_brand").alias("filler_group"),
        *(F.concat("p_name", F.lit(f" {i}")).alias(f"word_{i}") for i in range(12)),
        F.lit("always").alias("adverb"),
    )


# -- events: the log ----------------------------------------------------------------------


def _event_ms(ts: Column) -> Column:
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    second = F.extract(F.lit("SECOND"), ts)
    return (
        day * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000
        + F.floor(second * 1000)
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns(
        {
            "subject": F.col("user_id"),
            "row_id": F.col("event_id"),
            "event_time": _event_ms(F.col("ts")),
            "order": F.dayofmonth("ts").cast("bigint"),
            "data_source": F.lit(S.HUMAN),
            "mask_added_tokens": F.lit(S.UNMASKED),
            "stop_at": F.lit(S.CONVERGENCE),
        }
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views as drops; the day is the trial, six days make a block."""
    block = pick(["trial_train_rep00", *S.TRAINING_BLOCKS[:4]], F.floor((F.col("order") - 1) / 6))
    flipped = (F.col("subject") + F.col("order")) % 3 == 0
    return _events(spark, sf_dir).withColumns(
        {
            "condition": F.when(F.col("order") > 30, S.TRAINING_BLOCKS[4]).otherwise(block),
            "parameter": F.when(F.col("event_type").isin("click", "view"), "Drop")
            .otherwise("Drag"),
            "sentence": F.when(flipped, "It is the [obj] that the [subj] has always blorked.")
            .otherwise("The [subj] has always blorked the [obj]."),
        }
    )


def gate_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_log(spark, sf_dir).where(F.col("parameter") == "Drop")
    return rows.select(
        "subject", "condition", F.col("order").alias("trial"),
        (F.col("value") >= 5).alias("is_correct"), "row_id",
    )


def break_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as break rows, odd ones of a subject Start, on a faster clock."""
    rows = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    numbered = row_numbers(
        rows.select("subject", "event_time", "row_id"), ["subject"], "row_id", "_n"
    )
    return numbered.select(
        "subject", F.lit("break").alias("condition"),
        F.when(F.col("_n") % 2 == 1, "Start").otherwise("End").alias("value"),
        F.floor(F.col("event_time") / CLOCK_SCALE).alias("event_time"), "row_id",
    )


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as test-trial events; a subject's day is a trial."""
    kind = F.col("event_type")
    bound = kind.isin("signup", "error")
    return _events(spark, sf_dir).select(
        "subject", F.lit("trial").alias("condition"), "order",
        F.when(kind == "click", "dd").when(bound, "trial").otherwise("mouse")
        .alias("element_name"),
        F.when(kind == "purchase", "Click").when(bound, "_Trial_").when(kind == "click", "Drop")
        .alias("parameter"),
        F.when(kind == "signup", "Start").when(kind == "error", "End")
        .when(kind == "click", F.when(F.col("value") >= 20, "[subj]").otherwise("[obj]"))
        .otherwise(F.col("props")).alias("value"),
        "event_time",
        F.col("order").cast("string").alias("item"),
        F.concat(F.lit("The [subj] has "), pick(S.ADVERBS, F.col("order") % 4),
                 F.lit(" blorked the [obj].")).alias("sentence"),
        F.when(F.col("subject") % 2 == 0, "[subj]").otherwise("[obj]").alias("target_response"),
        F.when(F.col("order") % 3 == 0, "eat").otherwise("buildings_vehicles")
        .alias("args_group"),
        F.when(F.col("order") % 5 == 0, "perfect passive").otherwise("perfect transitive")
        .alias("sentence_type"),
        F.lit(None).cast("string").alias("template"),
        "row_id",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a raw log: comments, missing values and short rows included."""
    kind = F.col("event_type")
    fields = {f.name: F.lit("x") for f in S.EVENT_LOG} | {
        "time_received": F.col("event_time").cast("string"),
        "ip_md5": F.md5(F.col("user_id").cast("string")),
        "order": F.col("order").cast("string"),
        "condition": kind,
        "parameter": F.when(kind == "view", "NA").otherwise("Drop"),
        "value": F.col("props"),
        "event_time": F.when(kind == "error", "NA").otherwise(F.col("event_time").cast("string")),
        "item": F.when(kind == "click", "").otherwise(F.col("order").cast("string")),
    }
    whole = F.concat_ws(",", *fields.values())
    short = F.concat_ws(",", *list(fields.values())[:13])
    line = F.when(kind == "signup", F.concat(short, F.lit("# left, early"))).otherwise(whole)
    return _events(spark, sf_dir).orderBy("event_id").select(line.alias("value"))


# -- documents, conversations, embeddings -------------------------------------------------


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between two blanks, some with adverbs."""
    doc = F.col("doc_id")
    extra = pick(
        ["always", "often", "usually", "typically", "rarely", "typically and always"], doc % 6
    )
    blanks = [F.lit("[subj]"), F.lit("[obj]")]
    first = F.when(doc % 2 == 0, blanks[0]).otherwise(blanks[1])
    second = F.when(doc % 2 == 0, blanks[1]).otherwise(blanks[0])
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang",
        F.concat(F.lit("The "), first, F.lit(" "), F.col("text"), F.lit(" "), extra,
                 F.lit(" blorked the "), second, F.lit(".")).alias("sentence"),
    )


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as escaped feedback texts."""
    escaped = F.replace(F.col("text"), F.lit(","), F.lit("%2C"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("subject"),
        F.lit("feedback").alias("element_name"), F.lit("Final").alias("parameter"),
        F.when(F.col("lang") == "de", "Shift").otherwise("box").alias("item"),
        F.replace(escaped, F.lit("\n"), F.lit("%0A")).alias("value"),
    )


def cossims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to vector 0, labels as models."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
        )

    anchor = vectors.where("vec_id = 0").select("v").scalar()
    with_anchor = vectors.withColumn("_a", anchor)
    cosine = dot(F.col("v"), F.col("_a")) / F.sqrt(
        dot(F.col("v"), F.col("v")) * dot(F.col("_a"), F.col("_a"))
    )
    return with_anchor.select(
        F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model_id"),
        F.lit("bert").alias("model_name"),
        F.lit("blork").alias("token"),
        pick(["BLORKED", "other", "BLORKED most similar"], F.col("vec_id") % 3)
        .alias("target_group"),
        F.lit("all_but_the_top").alias("correction"),
        (F.col("vec_id") % 2).cast("bigint").alias("eval_epoch"),
        F.lit("convergence").alias("epoch_criteria"),
        F.round(cosine, 6).alias("cossim"),
    )


# Parameter names of the draws, one per vector element.
SLOPES = [
    "b_Intercept", "b_voice.n", "b_data_source.n", "b_target_response.n",
    "b_voice.n:data_source.n", "b_voice.n:target_response.n",
    "b_data_source.n:target_response.n", "b_voice.n:data_source.n:target_response.n",
    "b_voice.n_i_n_tr_a_t_object_target_i_n_ds_a_t_human",
]


def draw_names(width: int) -> list[str]:
    rest = width - len(SLOPES)
    return [
        *SLOPES[:width],
        *(f"sd_subject_{i}" for i in range(rest // 2)),
        *(f"cor_subject_{i}" for i in range(rest - rest // 2)),
    ]


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as one draw, every element as one parameter."""
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    return vectors.select(
        *(F.col("embedding")[i].cast("double").alias(name)
          for i, name in enumerate(draw_names(width)))
    )


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws as four chains by turns."""
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    return vectors.select(
        (F.col("vec_id") % 4).alias("chain"), F.floor(F.col("vec_id") / 4).alias("iteration"),
        *(F.col("embedding")[i].cast("double").alias(name)
          for i, name in enumerate(draw_names(width)))
    )
