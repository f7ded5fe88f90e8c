"""F-scores, the accuracy table and the tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialspark import schemas as S
from trialspark.functions.nulls import ratio, strict_sum, truth
from trialspark.functions.stats import beta_counts, beta_measures, two_digits
from trialspark.operators.joins import flag_in, keep_in, lookup
from trialspark.operators.ordered import CHUNK_BITS, row_numbers
from trialspark.operators.quantiles import exact_quantiles
from trialspark.session import settle

SCORE_KEYS = ["subject", "voice"]
ROLES = {
    "subjects": (S.SUBJECT_TARGET, S.OBJECT_TARGET, "[subj]"),
    "objects": (S.OBJECT_TARGET, S.SUBJECT_TARGET, "[obj]"),
}


def _counts(response: Column, correct: Column, wrong: dict[str, Column], tag: str):
    """True and false positives and false negatives of both roles."""
    aggregates = []
    for role, (own, other, answer) in ROLES.items():
        false_positive = truth((F.col("target_response") == other) & (response == answer))
        aggregates += [
            strict_sum(correct.cast("int"), F.col("target_response") == own)
            .alias(f"tp_{role}{tag}"),
            F.count_if(false_positive).alias(f"fp_{role}{tag}"),
            F.count_if(wrong[role] & ~false_positive).alias(f"fn_{role}{tag}"),
        ]
    return aggregates


def _counts_after(tag: str = ""):
    wrong = ~F.col("correct")
    return _counts(F.col("response"), F.col("correct"), {role: wrong for role in ROLES}, tag)


def _counts_before(strict: bool, tag: str = ""):
    before, after = F.col("correct_pre_training"), F.col("correct")
    response = (
        F.when(before == after, F.col("response"))
        .when(F.col("response") == "[subj]", "[obj]")
        .when(F.col("response") == "[obj]", "[subj]")
    )
    wrong = {"subjects": ~before, "objects": ~before if strict else ~after}
    return _counts(response, before, wrong, tag)


def _with_scores(counts: DataFrame, tag: str = "") -> DataFrame:
    for role in ROLES:
        hits = F.col(f"tp_{role}{tag}")
        precision, recall = F.col(f"precision_{role}{tag}"), F.col(f"recall_{role}{tag}")
        counts = counts.withColumns(
            {
                f"precision_{role}{tag}": ratio(hits, hits + F.col(f"fp_{role}{tag}")),
                f"recall_{role}{tag}": ratio(hits, hits + F.col(f"fn_{role}{tag}")),
            }
        ).withColumn(
            f"f_score_{role}{tag}", ratio(2 * precision * recall, precision + recall)
        )
    return counts


def f_scores(trials: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both roles per subject and voice, NULL for 0/0.

    A wrong answer that is not a false positive of a role is its false negative.
    """
    return _with_scores(trials.groupBy(*SCORE_KEYS).agg(*_counts_after()))


def f_scores_pre(trials: DataFrame, strict: bool = False) -> DataFrame:
    """The same on the answer before training; NULL for people, who have none.

    Published results take the objects' false negatives from the answer *after* training.
    That is the default here; ``strict`` takes both from before.
    """
    return _with_scores(trials.groupBy(*SCORE_KEYS).agg(*_counts_before(strict)))


def f_scores_long(scores: DataFrame, name: str = "f_score") -> DataFrame:
    """One row per subject, voice and target response."""
    role = F.when(F.col("_role") == "f_score_subjects", S.SUBJECT_TARGET).otherwise(
        S.OBJECT_TARGET
    )
    kept = [c for c in scores.columns if c.startswith(("precision", "recall"))]
    return scores.unpivot(
        [*SCORE_KEYS, *kept], ["f_score_subjects", "f_score_objects"], "_role", name
    ).withColumn("target_response", role).drop("_role")


def attach_f_scores(trials: DataFrame, strict: bool = False) -> DataFrame:
    """Both F-scores on every row of their subject, voice and target response."""
    counts = trials.groupBy(*SCORE_KEYS).agg(*_counts_after(), *_counts_before(strict, "_pre"))
    scores = counts.transform(_with_scores).transform(_with_scores, "_pre")
    by_target = [
        F.struct(
            F.lit(own).alias("target_response"), F.col(f"f_score_{role}").alias("f_score"),
            F.col(f"f_score_{role}_pre").alias("f_score_pre_training"),
        )
        for role, (own, _, _) in ROLES.items()
    ]
    long = scores.select(*SCORE_KEYS, F.inline(F.array(*by_target)))
    return lookup(trials, long, [*SCORE_KEYS, "target_response"])


def seen_by_people(trials: DataFrame) -> DataFrame:
    """Rows whose word and sentence some person saw together."""
    people = trials.where(F.col("data_source") == S.HUMAN)
    return keep_in(trials, people, ["word", "sentence"])


def accuracy_table(trials: DataFrame) -> DataFrame:
    """Input of the accuracy models: runs of interest, contrasts of +-0.5, RT in ms."""
    kept = trials.where(
        (F.col("mask_added_tokens") == S.UNMASKED) & (F.col("stop_at") == S.CONVERGENCE)
    )
    people = trials.where(F.col("data_source") == S.HUMAN)
    table = keep_in(kept, people, ["word", "sentence"])
    dropped = [
        "word", "args_group", "mouse", "correct_pre_training", "f_score", "sentence",
        "training", "adverb", "seen_in_training", "linear",
    ]
    return table.drop(*dropped).transform(contrasts).withColumn("rt", F.exp("log_rt"))


def contrasts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "target_response_n": half(F.col("target_response"), [S.OBJECT_TARGET],
                                      [S.SUBJECT_TARGET]),
            "data_source_n": half(F.col("data_source"), [S.HUMAN], S.MODELS),
            "voice_n": half(F.col("voice"), [S.ACTIVE], [S.PASSIVE]),
        }
    )


def half(column: Column, up: Sequence[str], down: Sequence[str]) -> Column:
    return F.when(column.isin(list(up)), 0.5).when(column.isin(list(down)), -0.5)


# -- tables behind charts -----------------------------------------------------------------


def facet_counts(trials: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Number of subjects per facet as a label."""
    subjects = trials.select("subject", *facets).distinct()
    return subjects.groupBy(*facets).agg(
        F.printf(F.lit("n=%02d"), F.count(F.lit(1))).alias("count")
    )


def stage_labels(source: Column) -> tuple[Column, Column, Column]:
    """Whether there are two stages, and the labels after and before fine-tuning."""
    is_model = source != S.HUMAN
    after = F.when(~is_model, "People").otherwise(F.concat(source, F.lit(" (fine-tuned)")))
    return is_model, after, F.concat(source, F.lit(" (pre-fine-tuning)"))


def stages(is_model: Column, after: Column, before: Column) -> Column:
    """One row for people, two for models."""
    return F.explode(F.when(is_model, F.array(after, before)).otherwise(F.array(after)))


def pre_post_stack(trials: DataFrame) -> DataFrame:
    """Fine-tuned and pre-fine-tuning answers of models under each other, and people."""
    is_model, after, before = stage_labels(F.col("data_source"))
    both = stages(
        is_model,
        F.struct(after.alias("data_source"), F.col("correct")),
        F.struct(before.alias("data_source"), F.col("correct_pre_training").alias("correct")),
    )
    rest = [
        c for c in trials.columns if c not in ("data_source", "correct", "correct_pre_training")
    ]
    return trials.select(*rest, both.alias("_stage")).select(*rest, "_stage.*")


def accuracy_bars(trials: DataFrame) -> DataFrame:
    """Counts and mean accuracy by source and stage, voice and target.

    Both stages are counted in one pass; the few groups are stacked afterwards.
    """
    keys = ["voice", "target_response"]
    outcomes = {"after": "correct", "before": "correct_pre_training"}
    groups = trials.groupBy("data_source", *keys).agg(
        *(F.struct(*beta_measures(c)).alias(stage) for stage, c in outcomes.items())
    )
    is_model, after, before = stage_labels(F.col("data_source"))
    both = stages(
        is_model,
        F.struct(after.alias("data_source"), F.col("after.*")),
        F.struct(before.alias("data_source"), F.col("before.*")),
    )
    return groups.select(*keys, both.alias("_stage")).select("_stage.data_source", *keys,
                                                             "_stage.k", "_stage.n", "_stage.mean")


def accuracy_bars_linear(trials: DataFrame) -> DataFrame:
    """The same by linear tag, after training only, with labels of 2 digits as C prints them."""
    counts = beta_counts(
        trials, ["data_source", "linear", "voice", "target_response"], "correct"
    )
    return counts.withColumn("label", two_digits("mean"))


def rt_ranks(trials: DataFrame) -> DataFrame:
    """People ranked by median log RT, ties by subject id, missing medians last."""
    people = trials.where(F.col("data_source") == S.HUMAN)
    return rank_medians(
        exact_quantiles(people, ["subject"], "log_rt", {"median": 0.5}, strict=True)
    )


def rank_medians(medians: DataFrame) -> DataFrame:
    keyed = medians.withColumn("_last", F.col("median").isNull()).withColumn(
        "_place", F.coalesce(F.floor(F.col("median") * 4096), F.lit(0))
    )
    # Chunks of the order are slices of the median, so ranking needs no single task.
    return row_numbers(
        keyed, [], ["_last", "median", "subject"], "rank",
        # missing medians are ordered by subject, so slices of subjects cut them
        chunk=F.struct(
            "_last", "_place",
            F.when(F.col("_last"), F.shiftright(F.col("subject"), CHUNK_BITS)).alias("_slice"),
        ),
    ).select("subject", "median", "rank")


def attach_ranks(trials: DataFrame, ranks: DataFrame) -> DataFrame:
    return lookup(trials, ranks.drop("median"), ["subject"])


def rt_box(trials: DataFrame, excluded: DataFrame) -> DataFrame:
    """Box statistics of log RT per person: quartiles and extreme values within 1.5 IQR.

    Rows without a log RT are left out, as a box plot does.
    """
    keys = ["subject", "linear"]
    people = trials.where(F.col("data_source") == S.HUMAN).select(*keys, "log_rt")
    quartiles = exact_quantiles(people, keys, "log_rt", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col("log_rt").between(F.col("q1") - reach, F.col("q3") + reach)
    boxes = settle(
        lookup(people, quartiles, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(near, F.col("log_rt"))).alias("low"),
            F.max(F.when(near, F.col("log_rt"))).alias("high"),
            F.count_if(~near).alias("n_outliers"),
            F.count_if(F.col("log_rt").isNull()).alias("_missing"),
        )
    )
    # A rank needs the median of all trials, so one missing RT puts a subject last.
    strict = F.when(F.col("_missing") == 0, F.col("median"))
    ranks = rank_medians(boxes.select("subject", strict.alias("median"))).drop("median")
    ranked = lookup(boxes.drop("_missing"), ranks, ["subject"])
    return flag_in(ranked, excluded, ["subject"], "excluded")
