"""From the event log and the model scores to one row per trial."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark import schemas as S
from trialspark.functions import text
from trialspark.functions.nulls import in_set, truth
from trialspark.operators import joins
from trialspark.operators.joins import fold, keep_in, lookup, lookup_some, unfold
from trialspark.operators.ordered import first_seen, first_seen_id, pair_number, run_id
from trialspark.session import settle

RUN_KEYS = ["subject", "mask_added_tokens", "stop_at"]
LEARNER_KEYS = ["subject", "data_source", "mask_added_tokens", "stop_at"]

# Columns of scores that repeat over the items of a model, and over the models of a sentence.
SCORE_GROUPS = {
    "_run": ["model_id", "data_source", "max_epochs", "mask_added_tokens"],
    "_template": ["sentence", "token_type", "target_response", "response"],
}


def tag_source(log: DataFrame, source: str = S.HUMAN) -> DataFrame:
    """Columns that people's rows need to share a table with model rows."""
    return log.withColumns(
        {
            "data_source": F.lit(source),
            "correct_pre_training": F.lit(None).cast("boolean"),
            "mask_added_tokens": F.lit(S.UNMASKED),
            "stop_at": F.lit(S.CONVERGENCE),
        }
    )


def number_subjects(log: DataFrame, person: str = "ip_md5", order: str = "row_id") -> DataFrame:
    """Replace the participant hash by a small id in order of first appearance."""
    return first_seen_id(log, person, order, "subject").drop(person)


def prepare_log(log: DataFrame) -> DataFrame:
    """The columns of the raw log that later steps use, with ids and source tags."""
    kept = log.drop(
        "time_received", "controller", "element_no", "latin_square_group", "element_type",
        "comments",
    )
    return kept.transform(number_subjects).transform(tag_source)


# -- side tables of the log ---------------------------------------------------------------


def break_times(log: DataFrame, order: str = "row_id") -> DataFrame:
    """Duration and label of each break; an unfinished break has no duration."""
    rows = log.where(F.col("condition") == "break").select(
        "subject", "value", "event_time", order
    )
    paired = pair_number(rows, ["subject"], order, "break_number")
    ends = paired.groupBy("subject", "break_number").pivot("value", ["Start", "End"]).agg(
        F.min("event_time")
    )
    duration = F.col("End") - F.col("Start")
    return ends.select(
        "subject", "break_number", text.clock_label(duration).alias("break_time"),
        duration.alias("duration"),
    )


def excessive_breaks(breaks: DataFrame, max_ms: int = S.MAX_BREAK_MS) -> DataFrame:
    return breaks.where(F.col("duration") > max_ms)


def training_drops(log: DataFrame, order: str = "row_id") -> DataFrame:
    """The drops of training trials."""
    return log.where(
        F.col("condition").contains("trial_train") & (F.col("parameter") == "Drop")
    ).select(*LEARNER_KEYS, "condition", "sentence", "order", order)


def training_tries(
    log: DataFrame, order: str = "row_id", only_reversed: bool = False
) -> DataFrame:
    """Number of drops in each training trial; a trial is a run of equal ``order`` values."""
    runs = run_id(training_drops(log, order), "order", RUN_KEYS, order)
    if only_reversed:
        runs = runs.where(F.col("sentence").rlike(r"(?s)\[obj\].*\[subj\]"))
    return runs.groupBy(*LEARNER_KEYS, "condition", "run").agg(
        F.count(F.lit(1)).alias("n_tries")
    )


def session_accuracy(
    log: DataFrame,
    first: int = 21,
    block: int = 15,
    only_reversed: bool = False,
    order: str = "row_id",
) -> DataFrame:
    """Share of training trials of each session that took the subject's fewest tries.

    The fewest tries are those of the subject, so a session without such a trial has no row.
    """
    return accuracy_of_tries(training_tries(log, order, only_reversed), first, block, only_reversed)


def accuracy_of_tries(
    tries: DataFrame, first: int = 21, block: int = 15, only_reversed: bool = False
) -> DataFrame:
    """``session_accuracy`` from the number of drops in each training trial."""
    session = F.when(F.col("run") <= first, 1).otherwise(
        F.ceil((F.col("run") - first) / block) + 1
    )
    keys = [*LEARNER_KEYS, "session_no"]
    counts = settle(
        tries.groupBy(*LEARNER_KEYS, session.cast("bigint").alias("session_no"), "n_tries")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # A session holds at most `block` trials, so this window is small for every key.
    total = F.sum("count").over(Window.partitionBy(*keys))
    shares = counts.withColumn("total", total)
    fewest = counts.groupBy(*LEARNER_KEYS).agg(F.min("n_tries").alias("_fewest"))
    kept = lookup(shares, fewest, LEARNER_KEYS, settled=True).where(F.col("n_tries") == F.col("_fewest"))
    return kept.select(
        *keys,
        *(["n_tries", "total"] if only_reversed else []),
        (F.col("count") / F.col("total")).alias("pr_first_choice_correct"),
    )


def below_training(accuracy: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Subjects whose last session is below the threshold."""
    last = accuracy.groupBy(*LEARNER_KEYS).agg(
        F.max("session_no").alias("session_no"),
        F.max_by("pr_first_choice_correct", "session_no").alias("pr_first_choice_correct"),
    )
    return last.where(F.col("pr_first_choice_correct") < threshold)


def training_gate(
    drops: DataFrame,
    passing: float = 0.9,
    max_attempts: int = 5,
    blocks: Sequence[str] = S.TRAINING_BLOCKS,
    order: str = "row_id",
) -> DataFrame:
    """The training criterion per subject from first-drop correctness.

    ``drops`` has subject, condition, trial, is_correct and the order column. The warm-up
    block is not in ``blocks`` and never counts. A subject who never passes has a NULL
    ``passed_at``.
    """
    attempt = F.array_position(F.array(*(F.lit(b) for b in blocks)), F.col("condition"))
    firsts = (
        drops.withColumn("attempt", attempt.cast("bigint"))
        .where(F.col("attempt").between(1, max_attempts))
        .groupBy("subject", "attempt", "trial")
        .agg(F.min_by("is_correct", order).alias("first_correct"))
    )
    accuracy = firsts.groupBy("subject", "attempt").agg(
        F.avg(F.col("first_correct").cast("int")).alias("accuracy")
    )
    passed = F.when(F.col("accuracy") >= passing, F.col("attempt"))
    gates = accuracy.groupBy("subject").agg(
        F.min(passed).alias("passed_at"),
        F.coalesce(F.min(passed), F.max("attempt")).alias("attempts"),
        F.coalesce(
            F.min_by("accuracy", passed), F.max_by("accuracy", "attempt")
        ).alias("final_accuracy"),
    )
    return gates.withColumn("passed", F.col("passed_at").isNotNull())


def feedback(log: DataFrame) -> DataFrame:
    """Final free text of each subject."""
    final = log.where(
        (F.col("element_name") == "feedback") & (F.col("item") != "Shift")
        & (F.col("parameter") == "Final")
    )
    return final.select("subject", text.decode_feedback(F.col("value")).alias("feedback"))


# -- trials -------------------------------------------------------------------------------

TRIAL_ELEMENTS = {
    "_Trial_Start": "trial_start", "_Trial_End": "trial_end", "response": "response",
    "mouse": "mouse",
}


def trial_events(log: DataFrame) -> DataFrame:
    """Test-trial events with one element name and value each."""
    kept = log.where(
        (F.col("condition") == "trial")
        & ~in_set(F.col("parameter"), ["Click", "Drag", "Final"])
    )
    bounded = kept.withColumn(
        "parameter",
        F.when(F.col("value").isin("Start", "End"), F.concat("parameter", "value"))
        .otherwise(F.col("parameter")),
    )
    named = bounded.withColumn(
        "element_name",
        F.when(F.col("element_name") == "dd", "response")
        .when(F.col("parameter").startswith("_Trial"), F.col("parameter"))
        .otherwise(F.col("element_name")),
    )
    return named.withColumn(
        "value",
        F.when(
            F.col("parameter").isin("_Trial_Start", "_Trial_End"),
            F.col("event_time").cast("string"),
        ).otherwise(F.col("value")),
    ).drop("parameter", "event_time", "order", "template")


def build_trials(log: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per test trial. A repeated element keeps its first value in file order."""
    events = trial_events(log)
    keys = [c for c in events.columns if c not in ("element_name", "value", order)]

    def first_value(element: str) -> Column:
        return F.min_by("value", F.when(F.col("element_name") == element, F.col(order)))

    return events.groupBy(*keys).agg(
        *(first_value(e).alias(name) for e, name in TRIAL_ELEMENTS.items())
    )


def repeated_elements(log: DataFrame, order: str = "row_id") -> DataFrame:
    """Trial keys that hold an element more than once."""
    events = trial_events(log)
    keys = [c for c in events.columns if c not in ("value", order)]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def log_rt(
    trials: DataFrame,
    ms_per_word: int = S.MS_PER_WORD,
    bad_delay: Sequence[int] = (),
) -> DataFrame:
    """Log of the time from when the word appeared to the end; NULL if not positive."""
    rate = F.when(F.col("subject").isin(list(bad_delay)), 1).otherwise(ms_per_word)
    delay = text.word_count(F.col("sentence")) * rate
    net = F.col("trial_end").try_cast("bigint") - delay - F.col("trial_start").try_cast("bigint")
    return trials.withColumn("log_rt", F.ln(net.cast("double"))).drop("trial_start", "trial_end")


def label_trials(trials: DataFrame) -> DataFrame:
    """Condition, correctness and voice of a trial."""
    return trials.withColumns(
        {
            "condition": F.when(F.col("args_group").contains("_"), "experimental")
            .otherwise("filler"),
            "correct": truth(F.col("response") == F.col("target_response")),
            "voice": voice_of(F.col("sentence_type")),
        }
    )


def voice_of(sentence_type: Column) -> Column:
    return F.when(sentence_type.contains("passive"), S.PASSIVE).otherwise(S.ACTIVE)


# -- item ids and model scores ------------------------------------------------------------


def item_ids(trials: DataFrame) -> DataFrame:
    """Distinct items people saw, plus drinking items made from the eating ones."""
    items = settle(
        trials.select(
            F.col("item").try_cast("bigint").alias("item"), "condition", "word", "args_group",
            "sentence_type", "adverb",
        ).distinct()
    )
    return items.unionByName(drink_items(items))


def drink_items(items: DataFrame) -> DataFrame:
    """Drinking fillers: recoded words, ids shifted past the largest item id."""
    eating = items.where(F.col("args_group") == "eat")
    last = items.agg(F.max("item")).scalar()
    first_eating = eating.agg(F.min("item")).scalar()
    return eating.withColumns(
        {
            "item": last - first_eating + F.col("item") + 1,
            "word": text.recode(F.col("word"), S.EAT_TO_DRINK),
            "args_group": F.lit("drink"),
        }
    )


def attach_item_ids(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of experimental items for score rows; rows without one keep NULL.

    ``items`` is what ``item_ids`` returns, or another checkpointed table.
    """
    experimental = items.where(F.col("condition") == "experimental").drop("args_group")
    on = ["condition", "word", "sentence_type", "adverb"]
    return lookup_some(
        scores, experimental, on, F.col("condition") == "experimental", settled=True
    )


def resolve_item(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of filler items where the experimental join found none."""
    fillers = (
        items.where(F.col("condition") == "filler").drop("word").distinct()
        .select("condition", "args_group", "sentence_type", F.col("item").alias("_filler_item"))
    )
    on = ["condition", "args_group", "sentence_type"]
    joined = lookup_some(scores, fillers, on, F.col("condition") == "filler")
    return joined.withColumn("item", F.coalesce("item", "_filler_item")).drop("_filler_item")


def number_models(scores: DataFrame, last_human: int, order: str) -> DataFrame:
    """Subject ids of models, by first appearance of their seed, after those of people.

    A seed that is also the id of a person would merge the two, so it is an error.
    """
    ids = settle(
        first_seen(scores, "random_seed", order, "subject").withColumn(
            "subject", F.col("subject") + last_human
        )
    )
    clash = ids.where(F.col("random_seed") <= last_human).first()
    if clash:
        raise ValueError(f"model seed {clash['random_seed']} is also the id of a person")
    return lookup(scores, ids, ["random_seed"], settled=True)


def score_rows(scores: DataFrame) -> DataFrame:
    """Model scores in the columns of the trial table, before ids are attached.

    Odds that are NaN are missing, as they are for files.
    """
    return scores.transform(score_keys).transform(score_labels)


def score_keys(scores: DataFrame) -> DataFrame:
    """The columns by which ids are attached, and those that replace the odds."""
    scores = scores.withColumns({
        name: F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        for name in ("odds_ratio", "odds_ratio_pre_post_difference")
    })
    experimental = F.col("eval_data") == S.EXPERIMENTAL_EVAL
    rows = scores.withColumns(
        {
            "data_source": text.model_label(F.col("model_name")),
            "word": text.clean_token(F.col("token")),
            "target_response": F.col("arg_type"),
            "condition": F.when(experimental, "experimental").otherwise("filler"),
        }
    ).where((F.col("condition") == "experimental") | (F.col("token_type") == "eval special"))
    swapped = F.coalesce(text.recode(F.col("word"), S.TOKEN_SWAPS), F.col("word"))
    return rows.withColumns(
        {
            "word": F.when(
                F.col("data_source").contains("ModernBERT") & (F.col("token_type") == "tuning"),
                swapped,
            ).otherwise(F.col("word")),
            "correct": F.col("odds_ratio") > 0,
            "correct_pre_training":
                (F.col("odds_ratio") - F.col("odds_ratio_pre_post_difference")) > 0,
            "sentence": text.sentence_case(F.col("sentence")),
            "response": F.when(F.col("odds_ratio") > 0, F.col("target_response"))
            .otherwise(text.alt_response(F.col("ratio_name"))),
        }
    ).withColumns(
        {
            "adverb": text.find_adverb(F.col("sentence")),
            "args_group": F.when(F.col("condition") == "experimental", F.col("args_group"))
            .otherwise(text.eval_group(F.col("eval_data"))),
        }
    )


def score_labels(rows: DataFrame) -> DataFrame:
    """The other columns of the trial table; best made after joins, which then move less."""
    reversed_order = F.col("sentence").rlike(r"(?s)\[obj\].*\[subj\].*blorked")
    return rows.withColumns(
        {
            "stop_at": F.when(F.col("max_epochs") == 5000, S.CONVERGENCE)
            .otherwise(S.EARLY_STOP),
            "mask_added_tokens": F.when(F.col("mask_added_tokens"), S.MASKED)
            .when(~F.col("mask_added_tokens"), S.UNMASKED),
            "training": F.lit(S.TRAINING_LABEL),
            "seen_in_training": F.when(F.col("token_type") == "tuning", "True")
            .when(F.col("token_type") == "eval added", "False"),
            "mouse": F.lit(None).cast("string"),
            "log_rt": F.lit(None).cast("double"),
            "voice": F.when(F.col("sentence_type").contains("passive"), S.PASSIVE)
            .when(reversed_order, S.REVERSED).otherwise(S.ACTIVE),
        }
    )


def normalise_scores(
    scores: DataFrame, items: DataFrame, last_human: int, order: str = "row_id"
) -> DataFrame:
    """Model scores as trials of the items that people saw.

    Where the items are too many to broadcast, the scores are shuffled with numbers in place of the
    columns that describe models and sentences.
    """
    keyed, folded = score_keys(number_models(scores, last_human, order)), {}
    if joins.value_bytes(items) > joins.BROADCAST_BYTES:
        keyed, folded = fold(keyed, SCORE_GROUPS)
    known = keyed.transform(attach_item_ids, items).transform(resolve_item, items)
    whole = unfold(known.where(F.col("item").isNotNull()), folded)
    return whole.transform(score_labels).select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.TRIALS)
    )


def union_sources(people: DataFrame, models: DataFrame) -> DataFrame:
    """People and models in one table, by column name."""
    own = people.withColumns(
        {
            "training": F.lit(S.TRAINING_LABEL),
            "subject": F.col("subject").cast("bigint"),
            "model_id": F.lit(None).cast("string"),
        }
    )
    return own.select(*models.columns).unionByName(models)


def merge_sources(people: DataFrame, models: DataFrame) -> DataFrame:
    """Union with display labels."""
    merged = union_sources(people, models)
    return merged.withColumns(
        {
            "seen_in_training": F.when(F.col("seen_in_training") == "True", "Seen")
            .when(F.col("seen_in_training") == "False", "Unseen"),
            "target_response": F.when(F.col("target_response") == "[subj]", S.SUBJECT_TARGET)
            .when(F.col("target_response") == "[obj]", S.OBJECT_TARGET),
            "args_group": text.group_label(F.col("args_group")),
            "voice": voice_of(F.col("sentence_type")),
        }
    )


def with_ranks(
    df: DataFrame, columns: Sequence[str] | None = None,
    levels: Mapping[str, Sequence[str]] = {**S.LEVELS, "stage": S.STAGES},
) -> DataFrame:
    """Integer ``*_rank`` columns that carry the display order of the labels.

    ``columns`` are by default those of ``levels`` that there are. Stacked stages are ranked in a
    column ``stage``, or elsewhere with ``{"data_source": schemas.STAGES}`` as ``levels``.
    """
    columns = [c for c in levels if c in df.columns] if columns is None else columns
    return df.withColumns(
        {f"{c}_rank": text.rank_of(F.col(c), levels[c]).cast("bigint") for c in columns}
    )


def subject_view(df: DataFrame, subjects: Sequence[int] | DataFrame) -> DataFrame:
    """Rows of the listed subjects, or of those in a table with a ``subject`` column."""
    if isinstance(subjects, DataFrame):
        return keep_in(df, subjects, ["subject"])
    return df.where(F.col("subject").isin(list(subjects)))


def keep_sources(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Rows of the listed data sources."""
    return df.where(F.col("data_source").isin(list(sources)))
