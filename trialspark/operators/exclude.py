"""Exclusion rules. All rules that read trials share one aggregation per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspark import schemas as S
from trialspark.functions.nulls import strict, strict_sum, truth
from trialspark.functions.stats import chi2_2x2, chi2_critical, chi2_gof, chi2_p
from trialspark.operators.joins import drop_in, flag_in
from trialspark.operators.ordered import complete
from trialspark.session import settle

RUN = ["data_source", "mask_added_tokens", "stop_at"]
SUBJECT_RUN = ["subject", *RUN]

# Reasons in the order they are reported.
REASONS = {
    "below_training": "<90% on training",
    "below_fillers": "<75% on fillers",
    "chance": "n.d. from chance on training structure",
    "breaks": "break time > 15 minutes",
    "linear": "n.d. from linear",
}


def subject_counts(trials: DataFrame) -> DataFrame:
    """Every count the rules need, in one pass: one row per subject, run and training."""
    experimental = F.col("condition") == "experimental"
    filler = F.col("condition") == "filler"
    structure = truth(
        experimental & (F.col("sentence_type") == S.TRAINING_STRUCTURE)
        & (F.col("seen_in_training") == "Seen")
    )
    right, wrong = F.col("correct"), ~F.col("correct")
    hit = right.cast("int")
    # Actives are inverted: a linear reader is right on them and wrong on passives.
    cells = {}
    for role, target in (("subj", S.SUBJECT_TARGET), ("obj", S.OBJECT_TARGET)):
        for voice, label, counted in (
            ("active", S.ACTIVE, wrong), ("passive", S.PASSIVE, right)
        ):
            cell = (
                experimental & (F.col("voice") == label) & (F.col("target_response") == target)
            )
            cells[f"n_{voice}_{role}"] = F.count_if(cell)
            name = "inv_correct" if voice == "active" else "pass_correct"
            cells[f"{name}_{role}"] = F.count_if(cell & counted)
    return trials.groupBy(*SUBJECT_RUN, "training").agg(
        F.count_if(filler).alias("n_filler"),
        strict_sum(hit, truth(filler)).alias("filler_correct"),
        F.count_if(structure).alias("n_structure"),
        strict_sum(hit, structure).alias("correct_total"),
        *(count.alias(name) for name, count in cells.items()),
    )


def filler_accuracy(counts: DataFrame) -> DataFrame:
    """Share of fillers each subject got right; NULL if an answer is missing."""
    sums = counts.groupBy(*SUBJECT_RUN).agg(
        F.sum("n_filler").alias("n"), strict_sum(F.col("filler_correct")).alias("k")
    )
    return sums.where("n > 0").select(*SUBJECT_RUN, (F.col("k") / F.col("n")).alias("mean"))


def below_fillers(counts: DataFrame, threshold: float = 0.75) -> DataFrame:
    return filler_accuracy(counts).where(F.col("mean") < threshold)


def structure_counts(counts: DataFrame) -> DataFrame:
    """Right and wrong answers on the structure seen in training."""
    return counts.where("n_structure > 0").select(
        *SUBJECT_RUN, "training", "correct_total",
        (F.col("n_structure") - F.col("correct_total")).alias("incorrect_total"),
    )


def structure_test(counts: DataFrame) -> DataFrame:
    """Goodness-of-fit statistic of those counts to chance."""
    return structure_counts(counts).withColumn(
        "statistic", chi2_gof(F.col("correct_total"), F.col("incorrect_total"))
    )


def not_above_chance(counts: DataFrame, p: float = 0.2) -> DataFrame:
    """Subjects not different from chance at ``p``, or worse than chance."""
    return structure_test(counts).where(
        (F.col("statistic") < chi2_critical(p))
        | (F.col("correct_total") < F.col("incorrect_total"))
    )


LINEAR_CELLS = [
    f"{name}_{role}"
    for role in ("subj", "obj")
    for name in ("n_active", "n_passive", "inv_correct", "pass_correct")
]


def linear_counts(counts: DataFrame) -> DataFrame:
    """Inverted active and plain passive answers per target, one row per subject."""
    any_row = sum((F.col(c) for c in LINEAR_CELLS if c.startswith("n_")), F.lit(0))
    return counts.where(any_row > 0).select(*SUBJECT_RUN, "training", *LINEAR_CELLS)


def linear_statistic(role: str) -> Column:
    hits, n = F.col(f"inv_correct_{role}"), F.col(f"n_active_{role}")
    passive_hits, n_passive = F.col(f"pass_correct_{role}"), F.col(f"n_passive_{role}")
    return chi2_2x2(hits, n - hits, passive_hits, n_passive - passive_hits)


def linear_test(counts: DataFrame) -> DataFrame:
    """Yates statistics per target; NULL for a zero margin, also when rows are missing."""
    return linear_counts(counts).withColumns(
        {f"statistic_{role}": linear_statistic(role) for role in ("subj", "obj")}
    )


def purely_linear(counts: DataFrame, p: float = 0.05) -> DataFrame:
    """Subjects whose passives are not different from inverted actives on both targets."""
    critical = chi2_critical(p)

    def no_difference(role: str) -> Column:
        statistic = F.col(f"statistic_{role}")
        return statistic.isNull() | (statistic < critical)

    return linear_test(counts).where(no_difference("subj") & no_difference("obj"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """``p_*`` next to each ``statistic*`` column; infinite where there is no statistic."""
    names = [c for c in tests.columns if c.startswith("statistic")]
    return tests.withColumns(
        {
            c.replace("statistic", "p_value"):
                F.coalesce(chi2_p(F.col(c)), F.lit(float("inf")))
            for c in names
        }
    )


def tag_linear(trials: DataFrame, linear: DataFrame, **kw) -> DataFrame:
    """``Linear`` for every row of a subject that is purely linear in any run."""
    flagged = flag_in(trials, linear, ["subject"], "_linear", **kw)
    return flagged.withColumn(
        "linear", F.when(F.col("_linear"), "Linear").otherwise("Non-linear")
    ).drop("_linear")


def exclusions(
    trials: DataFrame,
    below_training: DataFrame | None = None,
    excessive_breaks: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Subjects caught by any rule, with their runs and the reasons joined by ``; ``."""
    counts = settle(subject_counts(trials)) if counts is None else counts
    caught = {
        "below_training": below_training,
        "below_fillers": below_fillers(counts),
        "chance": not_above_chance(counts),
        "breaks": excessive_breaks,
        "linear": purely_linear(counts),
    }
    hits = None
    for rule, table in caught.items():
        if table is None:
            continue
        marked = table.select(F.col("subject").cast("bigint"), F.lit(rule).alias("rule"))
        hits = marked if hits is None else hits.unionByName(marked)
    flags = hits.groupBy("subject").agg(
        *(F.bool_or(F.col("rule") == rule).alias(rule) for rule in REASONS)
    )
    why = F.concat_ws("; ", *(F.when(F.col(rule), text) for rule, text in REASONS.items()))
    listed = flags.select("subject", why.alias("why_excluded"))
    runs = counts.select(*SUBJECT_RUN).distinct()
    return listed.join(runs, "subject", "left").select(*SUBJECT_RUN, "why_excluded")


def other_than_linear(excluded: DataFrame) -> DataFrame:
    """Subjects excluded for anything but linearity alone."""
    return excluded.where(F.col("why_excluded") != REASONS["linear"])


def apply_exclusions(trials: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of subjects that stay; being linear alone is no reason to go."""
    return drop_in(trials, other_than_linear(excluded), ["subject"])


def split_conditions(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Experimental and filler rows."""
    return tuple(
        trials.where(F.col("condition") == name).drop("condition")
        for name in ("experimental", "filler")
    )


def cossim_means(cossims: DataFrame) -> DataFrame:
    """Largest and mean similarity per model to the new word's targets, before and after.

    Both are NULL where any similarity is missing.
    """
    epoch = F.when(F.col("eval_epoch") == 0, "0").otherwise(F.col("epoch_criteria"))
    return (
        cossims.where(
            (F.col("target_group") == "BLORKED") & (F.col("correction") == "all_but_the_top")
        )
        .groupBy("model_id", epoch.alias("eval_epoch"))
        .agg(
            strict(F.max, F.col("cossim")).alias("max_cossim_to_targets"),
            strict(F.avg, F.col("cossim")).alias("mean_cossim_to_targets"),
        )
    )


def cossim_wide(means: DataFrame) -> DataFrame:
    """One row per model with the columns before and after training.

    A model with several stopping criteria has no single value after training: it gets NULL,
    and ``doubled_criteria`` names it.
    """
    before = truth(F.col("eval_epoch") == "0")
    single = F.count_if(~before) <= 1
    measures = ["max_cossim_to_targets", "mean_cossim_to_targets"]
    return means.groupBy("model_id").agg(
        *(F.max(F.when(before, F.col(m))).alias(f"{m}_pre_training") for m in measures),
        *(F.when(single, F.max(F.when(~before, F.col(m)))).alias(m) for m in measures),
    )


def doubled_criteria(means: DataFrame) -> DataFrame:
    """Models with more than one stopping criterion, and their criteria."""
    after = means.where(~truth(F.col("eval_epoch") == "0"))
    found = after.groupBy("model_id").agg(F.sort_array(F.collect_list("eval_epoch")).alias("criteria"))
    return found.where(F.size("criteria") > 1)


def session_chart(accuracy: DataFrame, excluded: DataFrame) -> DataFrame:
    """All sessions of each subject, with facet titles."""
    keys = SUBJECT_RUN
    filled = complete(accuracy, keys, "session_no")
    flagged = flag_in(filled, other_than_linear(excluded), ["subject"], "_out").withColumn(
        "included", F.when(F.col("_out"), "Excluded").otherwise("Included")
    )
    title = F.concat(F.col("subject").cast("string"), F.lit(" ("), F.col("included"), F.lit(")"))
    return flagged.drop("_out").withColumn("title", title)
