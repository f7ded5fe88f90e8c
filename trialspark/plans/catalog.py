"""One query per operator, over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trialspark import schemas as S
from trialspark.functions import stats, text
from trialspark.functions.nulls import in_set
from trialspark.operators import (
    contrasts, draws, exclude, fit, metrics, ordered, prep, schedule as sessions, upkeep,
)
from trialspark.operators.joins import lookup
from trialspark.plans import adapters as A
from trialspark.session import settle, shared_folder
from trialspark.sources import readers, writers
from trialspark.streaming import gate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    """Register a query; doubles are rounded to six digits for comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(spark, sf_dir)
        doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
        return df.select(
            *(F.round(F.col(f"`{c}`"), 6).alias(c) if c in doubles else F.col(f"`{c}`")
              for c in df.columns)
        )

    QUERIES[make.__name__] = run
    return make


def experimental(spark, sf_dir):
    return A.trials(spark, sf_dir).where(F.col("condition") == "experimental")


def fillers(spark, sf_dir):
    return A.trials(spark, sf_dir).where(F.col("condition") == "filler")


# -- projections, filters, labels ---------------------------------------------------------


@query
def project_range(spark, sf_dir):
    kept = A.trials(spark, sf_dir).select("subject", "item", "word", "response", "correct")
    return kept.withColumnRenamed("response", "answer")


@query
def tag_source(spark, sf_dir):
    log = A.table(spark, sf_dir, "events").select("event_id", "user_id")
    return log.transform(prep.tag_source)


@query
def filter_null_safe(spark, sf_dir):
    rows = A.trials(spark, sf_dir).where(
        ~in_set(F.col("model_id"), ["model-1", "model-3"])
        & (F.col("seen_in_training").isNull() | (F.col("voice") == S.PASSIVE))
        & ~(F.col("word") == "pizza")
    )
    return rows.select("subject", "item", "word", "model_id", "voice")


@query
def filter_regex(spark, sf_dir):
    sentence = F.col("sentence")
    rows = A.templates(spark, sf_dir).where(
        sentence.rlike(r"(?s)\[obj\].*\[subj\]") & sentence.contains("typically")
        & sentence.startswith("The") & ~F.col("lang").rlike("e[ns]$")
    )
    return rows.select("doc_id", "lang")


@query
def case_labels(spark, sf_dir):
    trials = A.trial_log(spark, sf_dir).transform(prep.build_trials).transform(prep.label_trials)
    return trials.select("subject", "item", "condition", "correct", "voice").withColumn(
        "args_label", text.group_label(F.lit("buildings_vehicles"))
    )


@query
def recode_map(spark, sf_dir):
    rows = A.trials(spark, sf_dir).withColumn(
        "recoded", text.recode(F.col("word"), S.EAT_TO_DRINK)
    )
    return rows.groupBy("word", "recoded").agg(F.count(F.lit(1)).alias("n"))


@query
def level_order(spark, sf_dir):
    labelled = A.trials(spark, sf_dir).withColumn(
        "args_group", text.group_label(F.col("args_group"))
    )
    keys = list(S.LEVELS)
    return labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).transform(prep.with_ranks)


@query
def subject_view(spark, sf_dir):
    in_debt = A.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(
        F.col("s_suppkey").alias("subject")
    )
    rows = A.trials(spark, sf_dir).select("subject", "item", "correct")
    return prep.subject_view(rows, in_debt)


@query
def keep_sources(spark, sf_dir):
    rows = A.trials(spark, sf_dir).select("subject", "data_source", "item", "correct")
    return prep.keep_sources(rows, S.SOURCE_SETS["bert"])


# -- scalar functions ---------------------------------------------------------------------


@query
def reading_delay(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.reading_delay(F.col("text")).alias("delay_ms"))


@query
def sentence_case(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.sentence_case(F.col("text")).alias("sentence"))


@query
def decode_feedback(spark, sf_dir):
    return A.feedback_log(spark, sf_dir).transform(prep.feedback)


@query
def find_adverb(spark, sf_dir):
    rows = A.templates(spark, sf_dir)
    return rows.select("doc_id", text.find_adverb(F.col("sentence")).alias("adverb"))


@query
def split_template(spark, sf_dir):
    rows = A.templates(spark, sf_dir)
    return rows.select("doc_id", text.split_template(F.col("sentence")).alias("_p")).select(
        "doc_id", "_p.*"
    )


@query
def model_label(spark, sf_dir):
    rows = A.scores(spark, sf_dir)
    return rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "data_source", text.model_label(F.col("model_name"))
    )


@query
def clean_token(spark, sf_dir):
    rows = A.scores(spark, sf_dir)
    return rows.groupBy(text.clean_token(F.col("token")).alias("word")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def alt_response(spark, sf_dir):
    rows = A.scores(spark, sf_dir)
    return rows.select(
        "random_seed", "ratio_name", text.alt_response(F.col("ratio_name")).alias("response")
    )


@query
def eval_group(spark, sf_dir):
    rows = A.scores(spark, sf_dir)
    return rows.groupBy("eval_data").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "args_group", text.eval_group(F.col("eval_data"))
    )


# -- order-dependent operators ------------------------------------------------------------


@query
def run_ids(spark, sf_dir):
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.run_id(turns, "role", ["conv_id"], "turn", "run")


@query
def first_seen_id(spark, sf_dir):
    log = A.table(spark, sf_dir, "events").select(
        "event_id", F.md5(F.col("user_id").cast("string")).alias("ip_md5")
    )
    return prep.number_subjects(log, order="event_id")


@query
def interleave_every_n(spark, sf_dir):
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sessions.interleave_every_n(turns, ["conv_id"], "turn", ["break", "pause"], 2)


@query
def sorted_scores(spark, sf_dir):
    rows = A.scores(spark, sf_dir).transform(prep.score_rows)
    return rows.select("random_seed", "word", "adverb", "correct").orderBy(
        "random_seed", "word", "adverb"
    )


# -- log ----------------------------------------------------------------------------------


@query
def break_times(spark, sf_dir):
    return A.break_log(spark, sf_dir).transform(prep.break_times)


@query
def excessive_breaks(spark, sf_dir):
    return A.break_log(spark, sf_dir).transform(prep.break_times).transform(
        prep.excessive_breaks
    )


@query
def count_tries(spark, sf_dir):
    return A.training_log(spark, sf_dir).transform(prep.training_tries)


@query
def session_accuracy(spark, sf_dir):
    return A.training_log(spark, sf_dir).transform(prep.session_accuracy)


@query
def session_accuracy_reversed(spark, sf_dir):
    return prep.session_accuracy(A.training_log(spark, sf_dir), only_reversed=True)


@query
def below_training(spark, sf_dir):
    return A.training_log(spark, sf_dir).transform(prep.session_accuracy).transform(
        prep.below_training
    )


@query
def training_gate(spark, sf_dir):
    return A.gate_drops(spark, sf_dir).transform(prep.training_gate)


@query
def training_gate_online(spark, sf_dir):
    """The drops arrive in three parts, each after the stream has dealt with the one before."""
    drops, root = A.gate_drops(spark, sf_dir), scratch(spark)
    for part in range(3):
        drops.where(F.pmod(F.xxhash64("row_id"), F.lit(3)) == part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(drops.schema).parquet(f"{root}/in")
        gate.follow_gate(stream, f"{root}/firsts", f"{root}/state", once=True).awaitTermination()
    return gate.current_gate(spark, f"{root}/firsts")


@query
def trials_wide(spark, sf_dir):
    return A.trial_log(spark, sf_dir).transform(prep.build_trials)


@query
def repeated_elements(spark, sf_dir):
    return A.trial_log(spark, sf_dir).transform(prep.repeated_elements).select(
        "subject", "item", "element_name", "n"
    )


@query
def log_rt(spark, sf_dir):
    trials = A.trial_log(spark, sf_dir).transform(prep.build_trials).transform(prep.log_rt)
    return trials.select("subject", "item", "log_rt")


# -- files --------------------------------------------------------------------------------


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query
def read_event_log(spark, sf_dir):
    path = scratch(spark)
    A.log_lines(spark, sf_dir).write.text(path)
    log = readers.read_event_log(spark, path).transform(prep.prepare_log)
    return log.select(
        "subject", "condition", "order", "parameter", "value", "event_time", "item", "word",
        "data_source",
    )


@query
def read_model_scores(spark, sf_dir):
    path = scratch(spark)
    A.scores(spark, sf_dir).drop("row_id").write.csv(
        path, header=True, nullValue="NA", compression="gzip"
    )
    scores = readers.read_model_scores(spark, path, pattern="*.csv.gz")
    return scores.select(
        "model_id", "random_seed", "token_type", "odds_ratio", "mask_added_tokens", "args_group",
        "sentence",
    )


@query
def read_items(spark, sf_dir):
    path = scratch(spark)
    A.filler_items(spark, sf_dir).write.csv(path, header=True, escape='"')
    return readers.read_items(spark, path, "fillers")


@query
def read_cossims(spark, sf_dir):
    path = scratch(spark)
    A.cossims(spark, sf_dir).write.csv(path, header=True, nullValue="NA", compression="gzip")
    found = readers.read_cossims(spark, path, pattern="*.csv.gz")
    return found.select("model_id", "token", "target_group", "correction", "eval_epoch", "cossim")


@query
def nested_long(spark, sf_dir):
    long = contrasts.nested_long(
        A.accuracy(spark, sf_dir), ["subject"], ["voice_n"], ["target_response", "data_source"]
    )
    return long.groupBy("subject", "contrast", F.array_join("levels", ", ").alias("levels")).agg(
        F.sum("value").alias("value")
    )


@query
def nested_sparse(spark, sf_dir):
    rows, columns, factors = A.accuracy(spark, sf_dir), ["voice_n"], ["target_response", "data_source"]
    dictionary = contrasts.level_dictionary(rows, columns, factors)
    entries = contrasts.nested_sparse(rows, columns, factors, dictionary).select(F.explode("nested").alias("entry"))
    sums = entries.groupBy("entry.slot").agg(F.sum("entry.value").alias("value"), F.count(F.lit(1)).alias("n"))
    return dictionary.join(sums, "slot").select(
        "contrast", F.array_join("levels", ", ").alias("levels"), "slot", "value", "n"
    )


@query
def assign_practice_words(spark, sf_dir):
    words = [f"word_{i}" for i in range(8)]
    return sessions.assign_words(
        A.session_trials(spark, sf_dir), A.word_items(spark, sf_dir), words
    )


@query
def accuracy_csv(spark, sf_dir):
    path = scratch(spark)
    writers.write_accuracy(A.accuracy(spark, sf_dir), path, kind="csv")
    return readers.read_accuracy(spark, path)


# -- items and scores ---------------------------------------------------------------------


@query
def distinct_items(spark, sf_dir):
    columns = ["item", "condition", "word", "args_group", "sentence_type", "adverb"]
    return A.trials(spark, sf_dir).select(*columns).distinct()


@query
def synth_items(spark, sf_dir):
    return prep.item_ids(A.trials(spark, sf_dir))


def people_items(spark, sf_dir):
    return prep.item_ids(A.people(spark, sf_dir))


def numbered_rows(spark, sf_dir):
    keys = ["random_seed", "condition", "word", "args_group", "sentence_type", "adverb"]
    return prep.score_rows(A.scores(spark, sf_dir)).select(*keys)


@query
def attach_item_ids(spark, sf_dir):
    return prep.attach_item_ids(numbered_rows(spark, sf_dir), people_items(spark, sf_dir))


@query
def resolve_item(spark, sf_dir):
    items = people_items(spark, sf_dir)
    rows = prep.attach_item_ids(numbered_rows(spark, sf_dir), items)
    return prep.resolve_item(rows, items)


@query
def normalise_scores(spark, sf_dir):
    return prep.normalise_scores(
        A.scores(spark, sf_dir), people_items(spark, sf_dir), A.LAST_HUMAN
    )


@query
def union_sources(spark, sf_dir):
    models = prep.normalise_scores(
        A.scores(spark, sf_dir), people_items(spark, sf_dir), A.LAST_HUMAN
    )
    return prep.merge_sources(A.people(spark, sf_dir), models)


# -- exclusion rules ----------------------------------------------------------------------


def counts(spark, sf_dir):
    return exclude.subject_counts(A.trials(spark, sf_dir))


@query
def filler_accuracy(spark, sf_dir):
    return exclude.filler_accuracy(counts(spark, sf_dir))


@query
def below_fillers(spark, sf_dir):
    return exclude.below_fillers(counts(spark, sf_dir))


@query
def training_structure_counts(spark, sf_dir):
    return exclude.structure_counts(counts(spark, sf_dir))


@query
def training_structure_test(spark, sf_dir):
    return exclude.not_above_chance(counts(spark, sf_dir))


@query
def linear_counts(spark, sf_dir):
    return exclude.linear_counts(counts(spark, sf_dir))


@query
def linear_test(spark, sf_dir):
    return exclude.purely_linear(counts(spark, sf_dir))


@query
def p_values(spark, sf_dir):
    return exclude.with_p_values(exclude.linear_test(counts(spark, sf_dir)))


@query
def flag_linear(spark, sf_dir):
    rows = A.trials(spark, sf_dir).select("subject", "item", "correct")
    return exclude.tag_linear(rows, exclude.purely_linear(counts(spark, sf_dir)))


def excluded(spark, sf_dir):
    trials = A.trials(spark, sf_dir)
    training = prep.session_accuracy(A.training_log(spark, sf_dir))
    breaks = prep.break_times(A.break_log(spark, sf_dir))
    return exclude.exclusions(
        trials, prep.below_training(training), prep.excessive_breaks(breaks)
    )


@query
def exclusion_reasons(spark, sf_dir):
    return excluded(spark, sf_dir)


@query
def exclusions_kept_up(spark, sf_dir):
    """The logs arrive in three parts, each with its own pass; the states are merged."""
    trials, training, breaks = (
        make(spark, sf_dir) for make in (A.trials, A.training_log, A.break_log)
    )
    least, most = training.agg(F.min("row_id"), F.max("row_id")).first()
    path, width = scratch(spark), ((most or 0) - (least or 0)) // 3 + 1
    for part in range(3):
        own = F.floor((F.col("row_id") - (least or 0)) / width) == part
        upkeep.keep_part(
            path, part, trials.where(F.pmod(F.xxhash64("item"), F.lit(3)) == part),
            training.where(own), breaks.where(own),
        )
    return upkeep.current_exclusions(spark, path)


@query
def drop_excluded(spark, sf_dir):
    trials = A.trials(spark, sf_dir)
    rows = trials.select("subject", "item", "correct", F.col("condition").alias("part"))
    return exclude.apply_exclusions(rows, exclude.exclusions(trials))


@query
def complete_sessions(spark, sf_dir):
    accuracy = settle(prep.session_accuracy(A.training_log(spark, sf_dir)))
    return exclude.session_chart(accuracy, exclude.exclusions(
        A.trials(spark, sf_dir), prep.below_training(accuracy)
    ))


# -- similarity ---------------------------------------------------------------------------


@query
def cossim_means(spark, sf_dir):
    return A.cossims(spark, sf_dir).transform(exclude.cossim_means)


@query
def cossim_wide(spark, sf_dir):
    return A.cossims(spark, sf_dir).transform(exclude.cossim_means).transform(
        exclude.cossim_wide
    )


@query
def attach_cossim(spark, sf_dir):
    rows = A.trials(spark, sf_dir).select("subject", "item", "model_id")
    return lookup(rows, cossim_wide(spark, sf_dir), ["model_id"])


# -- scores and tables --------------------------------------------------------------------


@query
def fscore_long(spark, sf_dir):
    return metrics.f_scores_long(metrics.f_scores(experimental(spark, sf_dir)))


@query
def fscore_pre(spark, sf_dir):
    return metrics.f_scores_long(metrics.f_scores_pre(experimental(spark, sf_dir)))


@query
def attach_fscore(spark, sf_dir):
    return metrics.attach_f_scores(experimental(spark, sf_dir)).select(
        "subject", "voice", "target_response", "item", "f_score", "f_score_pre_training"
    )


@query
def semi_seen_by_people(spark, sf_dir):
    return metrics.seen_by_people(
        experimental(spark, sf_dir).select("subject", "data_source", "word", "sentence")
    )


@query
def accuracy_table(spark, sf_dir):
    trials = A.trials(spark, sf_dir)
    per_subject = settle(exclude.subject_counts(trials))
    tagged = exclude.tag_linear(
        trials, exclude.purely_linear(per_subject), settled=True
    )
    similar = lookup(tagged, cossim_wide(spark, sf_dir), ["model_id"])
    kept = exclude.apply_exclusions(similar, exclude.exclusions(trials, counts=per_subject))
    rows, _ = exclude.split_conditions(kept)
    return metrics.accuracy_table(metrics.attach_f_scores(rows))


@query
def facet_counts(spark, sf_dir):
    tagged = exclude.tag_linear(
        experimental(spark, sf_dir), exclude.purely_linear(counts(spark, sf_dir))
    )
    return metrics.facet_counts(
        tagged, ["data_source", "mask_added_tokens", "stop_at", "linear"]
    )


@query
def pre_post_stack(spark, sf_dir):
    return metrics.pre_post_stack(experimental(spark, sf_dir)).select(
        "subject", "data_source", "item", "voice", "correct"
    )


@query
def beta_counts(spark, sf_dir):
    return stats.beta_counts(
        A.trials(spark, sf_dir), ["data_source", "condition", "voice"], "correct"
    )


@query
def beta_interval(spark, sf_dir):
    return stats.beta_interval(metrics.accuracy_bars(experimental(spark, sf_dir)))


@query
def accuracy_bars(spark, sf_dir):
    return metrics.accuracy_bars(experimental(spark, sf_dir))


@query
def accuracy_bars_linear(spark, sf_dir):
    tagged = exclude.tag_linear(
        experimental(spark, sf_dir), exclude.purely_linear(counts(spark, sf_dir))
    )
    return metrics.accuracy_bars_linear(tagged)


@query
def filler_bars(spark, sf_dir):
    return metrics.accuracy_bars(fillers(spark, sf_dir))


@query
def rt_rank(spark, sf_dir):
    trials = A.trials(spark, sf_dir)
    ranked = metrics.attach_ranks(trials, metrics.rt_ranks(trials))
    return ranked.select("subject", "item", "log_rt", "rank")


@query
def rt_box(spark, sf_dir):
    trials = A.trials(spark, sf_dir)
    per_subject = settle(exclude.subject_counts(trials))
    tagged = exclude.tag_linear(
        trials, exclude.purely_linear(per_subject), settled=True
    )
    out = exclude.other_than_linear(exclude.exclusions(trials, counts=per_subject))
    return metrics.rt_box(tagged, out)


# -- contrasts, draws, fit, schedule ------------------------------------------------------


@query
def nested_contrasts(spark, sf_dir):
    rows = A.accuracy(spark, sf_dir)
    factors = ["target_response", "data_source"]
    levels = contrasts.crossed(*(S.LEVELS[f] for f in factors))
    wide = contrasts.nested_contrasts(rows, ["voice_n"], factors, levels)
    new = [c for c in wide.columns if contrasts.NESTING in c]
    return wide.groupBy("subject", "voice_n").agg(*(F.sum(c).alias(c) for c in new))


@query
def interaction_terms(spark, sf_dir):
    rows = A.accuracy(spark, sf_dir)
    wide = contrasts.interaction_terms(rows, "voice_n * data_source_n * target_response_n")
    new = [c for c in wide.columns if ":" in c]
    return wide.groupBy("subject").agg(*(F.sum(f"`{c}`").alias(c.replace(":", "_x_")) for c in new))


@query
def pmcmc(spark, sf_dir):
    return draws.p_mcmc(A.draws(spark, sf_dir))


@query
def pmcmc_report(spark, sf_dir):
    return draws.p_mcmc_report(A.draws(spark, sf_dir), "Crossed model (accuracy)")


@query
def posterior_summary(spark, sf_dir):
    return draws.posterior_summary(A.draws(spark, sf_dir))


@query
def draw_histogram(spark, sf_dir):
    return draws.draw_histogram(A.draws(spark, sf_dir))


@query
def draw_density(spark, sf_dir):
    return draws.draw_density(A.draws(spark, sf_dir))


@query
def draw_trace(spark, sf_dir):
    return draws.draw_trace(A.chains(spark, sf_dir), "chain", "iteration", pattern="^b_", pixels=50)


@query
def design_gram(spark, sf_dir):
    return fit.design_gram(A.accuracy(spark, sf_dir), fit.CROSSED)


@query
def fit_map_logit(spark, sf_dir):
    terms = contrasts.term_names(["voice_n", "data_source_n", "target_response_n"])
    return fit.fit_map_logit(A.accuracy(spark, sf_dir), terms)


@query
def fit_standard_errors(spark, sf_dir):
    terms = contrasts.term_names(["voice_n", "data_source_n", "target_response_n"])
    return fit.fit_with_errors(A.accuracy(spark, sf_dir), terms)


@query
def fit_sources(spark, sf_dir):
    return fit.fit_sources(A.accuracy(spark, sf_dir))


@query
def assign_words(spark, sf_dir):
    words = [f"word_{i}" for i in range(12)]
    return sessions.assign_words(
        A.session_trials(spark, sf_dir), A.word_items(spark, sf_dir), words
    )


@query
def schedule(spark, sf_dir):
    return sessions.schedule(A.session_trials(spark, sf_dir))
