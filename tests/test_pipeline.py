"""Preparation, exclusion and metrics on small planted tables."""

import math

import pytest
from pyspark.sql import functions as F

from trialspark import schemas as S
from trialspark.operators import contrasts, draws, exclude, fit, joins, metrics, prep

ACTIVE, PASSIVE = S.ACTIVE, S.PASSIVE
SUBJ, OBJ = S.SUBJECT_TARGET, S.OBJECT_TARGET

TRIAL = {
    "subject": 1, "condition": "experimental", "training": S.TRAINING_LABEL, "item": "1",
    "word": "w", "target_response": SUBJ, "args_group": "g", "sentence_type":
    "perfect transitive", "sentence": "s", "adverb": "always", "seen_in_training": "Seen",
    "data_source": "human", "mouse": None, "response": "[subj]", "log_rt": 7.0,
    "correct": True, "correct_pre_training": None, "voice": ACTIVE,
    "mask_added_tokens": S.UNMASKED, "stop_at": S.CONVERGENCE, "model_id": None,
}


def trial(target=SUBJ, correct=True, times=1, **changes):
    answer = "[subj]" if (target == SUBJ) == correct else "[obj]"
    row = TRIAL | {"target_response": target, "correct": correct, "response": answer} | changes
    return [tuple(row[f.name] for f in S.TRIALS)] * times


def table(spark, *groups):
    return spark.createDataFrame([row for group in groups for row in group], S.TRIALS)


def filler(correct, times, subject):
    return trial(correct=correct, times=times, subject=subject, condition="filler",
                 seen_in_training=None)


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    for s in (1, 2, 3, 4, 5):
        for target in (SUBJ, OBJ):
            rows.append(trial(target, True, 20, subject=s))
    # 1 good; 2 linear only (passives all wrong); 3 bad fillers; 4 both; 5 no object passives
    for s, right in ((1, True), (2, False), (3, True), (4, False)):
        for target in (SUBJ, OBJ):
            rows.append(trial(target, right, 20, subject=s, voice=PASSIVE,
                              sentence_type="perfect passive"))
    rows.append(trial(SUBJ, False, 20, subject=5, voice=PASSIVE))
    for s, right in ((1, 20), (2, 20), (3, 10), (4, 10), (5, 15)):
        rows += [filler(True, right, s), filler(False, 20 - right, s)]
    # 6 answers the training structure at chance
    rows.append(trial(SUBJ, True, 15, subject=6))
    rows.append(trial(SUBJ, False, 9, subject=6))
    return table(spark, *rows)


def test_exclusion_reasons(spark, planted):
    below = spark.createDataFrame([(1,)], "subject bigint")
    breaks = spark.createDataFrame([(1,), (99,)], "subject bigint")
    got = {r["subject"]: r for r in exclude.exclusions(planted, below, breaks).collect()}
    assert {s: r["why_excluded"] for s, r in got.items()} == {
        1: "<90% on training; break time > 15 minutes",
        2: "n.d. from linear",
        3: "<75% on fillers",
        4: "<75% on fillers; n.d. from linear",
        5: "n.d. from linear",
        6: "n.d. from chance on training structure; n.d. from linear",
        99: "break time > 15 minutes",
    }
    assert got[99]["data_source"] is None and got[1]["data_source"] == "human"


def test_linear_only_subjects_stay(planted):
    kept = exclude.apply_exclusions(planted, exclude.exclusions(planted))
    assert {r[0] for r in kept.select("subject").distinct().collect()} == {1, 2, 5}
    tagged = exclude.tag_linear(planted, exclude.purely_linear(exclude.subject_counts(planted)))
    assert {r[0] for r in tagged.where("linear = 'Linear'").select("subject").distinct()
            .collect()} == {2, 4, 5, 6}
    parts = exclude.split_conditions(kept)
    assert sum(p.count() for p in parts) == kept.count() and "condition" not in parts[0].columns


def test_null_subject_survives_exclusion(spark):
    rows = table(spark, trial(subject=None), trial(subject=1))
    out = spark.createDataFrame([(1, "<75% on fillers")], "subject bigint, why_excluded string")
    assert [r[0] for r in exclude.apply_exclusions(rows, out).select("subject").collect()] == [None]


def test_a_missing_answer_leaves_the_rules_open(spark):
    rows = table(spark, filler(True, 3, 1), filler(False, 3, 1), filler(False, 3, 2),
                 trial(correct=None, subject=1, condition="filler"),
                 trial(correct=None, subject=2), trial(correct=False, subject=2))
    counts = exclude.subject_counts(rows)
    assert {r["subject"]: r["mean"] for r in exclude.filler_accuracy(counts).collect()} == {
        1: None, 2: 0.0
    }
    assert [r["subject"] for r in exclude.below_fillers(counts).collect()] == [2]
    assert exclude.structure_counts(counts).first()["correct_total"] is None
    assert exclude.not_above_chance(counts).count() == 0


def test_f_scores_by_hand(spark):
    rows = table(spark, trial(SUBJ, True, 3), trial(SUBJ, False, 1), trial(OBJ, True, 2),
                 trial(OBJ, False, 2))
    r = metrics.f_scores(rows).first()
    # a wrong answer on the other target that is a false positive is no false negative
    assert r["precision_subjects"] == pytest.approx(3 / 5)
    assert r["recall_subjects"] == pytest.approx(3 / 4)
    assert r["f_score_subjects"] == pytest.approx(2 / 3)
    assert r["precision_objects"] == pytest.approx(2 / 3)
    assert r["recall_objects"] == pytest.approx(2 / 4)
    assert r["f_score_objects"] == pytest.approx(4 / 7)


def test_f_scores_without_rows_or_hits(spark):
    r = metrics.f_scores(table(spark, trial(SUBJ, False, 2))).first()
    assert r["recall_subjects"] == 0 and r["precision_subjects"] is None
    assert r["f_score_subjects"] is None and r["recall_objects"] is None


def test_f_scores_before_training(spark):
    model = {"data_source": "BERT", "subject": 2}
    rows = table(
        spark, trial(SUBJ, True, 3), trial(OBJ, True, 3),
        trial(SUBJ, True, 2, correct_pre_training=True, **model),
        trial(OBJ, True, 1, correct_pre_training=False, **model),
        trial(OBJ, False, 1, correct_pre_training=True, **model),
    )
    got = {r["subject"]: r for r in metrics.f_scores_pre(rows).collect()}
    assert got[1]["f_score_subjects"] is None and got[1]["f_score_objects"] is None
    assert got[2]["precision_subjects"] == pytest.approx(2 / 3)
    assert got[2]["recall_subjects"] == 1
    assert got[2]["recall_objects"] == pytest.approx(1 / 2)
    strict = {r["subject"]: r for r in metrics.f_scores_pre(rows, strict=True).collect()}
    # before training the wrong object answer was '[subj]', wrong and no false positive
    assert strict[2]["recall_objects"] == pytest.approx(1 / 2)


def test_seen_by_people_and_accuracy_table(spark):
    model = {"data_source": "BERT", "subject": 2, "model_id": "m", "log_rt": None,
             "correct_pre_training": True}
    rows = table(
        spark, trial(word="w", sentence="s"), trial(word=None, sentence="s"),
        trial(word="w", sentence="s", **model), trial(word=None, sentence="s", **model),
        trial(word="NA", sentence="s", **model), trial(word="w s", sentence="", **model),
        trial(word="w", sentence="s", **(model | {"stop_at": S.EARLY_STOP})),
    )
    assert metrics.seen_by_people(rows).count() == 5
    got = metrics.accuracy_table(metrics.attach_f_scores(rows))
    assert got.count() == 4 and "word" not in got.columns
    human = got.where("subject = 1").first()
    assert (human["data_source_n"], human["voice_n"], human["target_response_n"]) == (0.5, 0.5, -0.5)
    assert human["rt"] == pytest.approx(math.exp(7))


def test_ranks_break_ties_by_subject(spark):
    rows = table(spark, trial(subject=3, log_rt=5.0), trial(subject=2, log_rt=5.0),
                 trial(subject=4, log_rt=1.0), trial(subject=5, log_rt=None))
    got = {r["subject"]: r["rank"] for r in metrics.rt_ranks(rows).collect()}
    assert got == {4: 1, 2: 2, 3: 3, 5: 4}


def test_facets_and_stack(spark):
    rows = table(spark, trial(subject=1, times=3), trial(subject=2),
                 trial(subject=3, data_source="BERT", correct_pre_training=False))
    got = {r["data_source"]: r["count"] for r in metrics.facet_counts(rows, ["data_source"])
           .collect()}
    assert got == {"human": "n=02", "BERT": "n=01"}
    stack = metrics.pre_post_stack(rows).groupBy("data_source").count().collect()
    assert {tuple(r) for r in stack} == {
        ("People", 4), ("BERT (fine-tuned)", 1), ("BERT (pre-fine-tuning)", 1)
    }


# -- log ----------------------------------------------------------------------------------


def training(spark, runs, subject=1):
    """Drops of trials given as (order, number of drops)."""
    rows, n = [], 0
    for order, drops in runs:
        for _ in range(drops):
            n += 1
            rows.append((subject, "trial_train_rep01", "Drop", order, "s", n))
    df = spark.createDataFrame(
        rows, "subject bigint, condition string, parameter string, order bigint,"
              " sentence string, row_id bigint")
    return prep.tag_source(df)


def test_sessions_and_fewest_tries(spark):
    # 21 trials in session 1, 15 in session 2, then session 3 without a first-try success
    runs = [(i, 2 if i < 5 else 1) for i in range(21)]
    runs += [(100 + i, 1) for i in range(15)] + [(200, 3), (201, 2)]
    got = {r["session_no"]: r["pr_first_choice_correct"]
           for r in prep.session_accuracy(training(spark, runs)).collect()}
    assert got == {1: pytest.approx(16 / 21), 2: 1.0}
    last = prep.below_training(prep.session_accuracy(training(spark, runs[:21])))
    assert [r["subject"] for r in last.collect()] == [1]
    assert prep.below_training(prep.session_accuracy(training(spark, runs))).count() == 0


def test_training_gate(spark):
    rows, n = [], 0
    for subject, blocks in {1: [8, 9], 2: [10], 3: [0, 0, 0, 0, 0]}.items():
        for block, right in zip(["trial_train_rep00", *S.TRAINING_BLOCKS][1:], blocks):
            for t in range(10):
                for ok in ([True] if t < right else [False, True]):
                    n += 1
                    rows.append((subject, block, t, ok, n))
        rows.append((subject, "trial_train_rep00", 0, True, 0))
    df = spark.createDataFrame(
        rows, "subject bigint, condition string, trial bigint, is_correct boolean, row_id bigint")
    got = {r["subject"]: (r["passed_at"], r["attempts"], r["final_accuracy"], r["passed"])
           for r in prep.training_gate(df).collect()}
    assert got == {1: (2, 2, 0.9, True), 2: (1, 1, 1.0, True), 3: (None, 5, 0.0, False)}


def test_trials_from_events(spark):
    sentence = "The [subj] has always blorked the [obj]."
    base = dict(subject=1, condition="trial", order=1, item="7", sentence=sentence,
                target_response="[subj]", args_group="a_b", sentence_type="perfect passive",
                template="t")
    events = [("Trial", "_Trial_", "Start", 1000), ("dd", "Drop", "[subj]", 3000),
              ("dd", "Drag", "[obj]", 2000), ("dd", None, "[obj]", 3500),
              ("next", "Click", "x", 4000), ("Trial", "_Trial_", "End", 4275),
              ("mouse", "move", "m", 2000)]
    rows = [tuple(base.values()) + e + (i,) for i, e in enumerate(events)]
    names = [*base, "element_name", "parameter", "value", "event_time", "row_id"]
    kinds = {"subject": "bigint", "order": "bigint", "event_time": "bigint", "row_id": "bigint"}
    log = spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))
    r = prep.build_trials(log).transform(prep.log_rt).transform(prep.label_trials).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["response"], r["mouse"], r["correct"]) == ("[subj]", "m", True)
    assert (r["condition"], r["voice"]) == ("experimental", PASSIVE)
    assert r["log_rt"] == pytest.approx(math.log(1000))
    bad = prep.build_trials(log).transform(prep.log_rt, bad_delay=[1]).first()
    assert bad["log_rt"] == pytest.approx(math.log(3275 - 7))
    early = log.withColumn("event_time", F.when(F.col("value") == "End", 1001)
                           .otherwise(F.col("event_time")))
    assert prep.build_trials(early).transform(prep.log_rt).first()["log_rt"] is None
    assert [x["n"] for x in prep.repeated_elements(log).collect()] == [2]


def test_drink_items(spark):
    items = [(f"{121 + i}", "filler", w, "eat" if i < 2 else "read", "t", "a")
             for i, w in enumerate(["person", "pizza"] + ["book"] * 48)]
    df = spark.createDataFrame(
        items, "item string, condition string, word string, args_group string,"
               " sentence_type string, adverb string")
    got = prep.item_ids(df)
    drinks = {(r["item"], r["word"]) for r in got.where("args_group = 'drink'").collect()}
    assert drinks == {(171, "man"), (172, "water")} and got.count() == 52


SCORE = dict(
    model_id="m", model_name="modernbert base", random_seed=100, token="Ġchalk",
    eval_data=S.EXPERIMENTAL_EVAL, token_type="tuning", arg_type="[subj]",
    ratio_name="[subj]/[obj]", odds_ratio=1.0, odds_ratio_pre_post_difference=2.0,
    max_epochs=5000, mask_added_tokens=False,
    sentence="the [subj] has always blorked the [obj].", sentence_type="perfect transitive",
    args_group="buildings_vehicles",
)


def scores(spark, *changes):
    rows = [tuple((SCORE | c)[f.name] for f in S.MODEL_SCORES) + (i,)
            for i, c in enumerate(changes)]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.MODEL_SCORES)
    return spark.createDataFrame(rows, f"{fields}, row_id bigint")


def test_normalise_scores(spark):
    items = spark.createDataFrame(
        [(3, "experimental", "pearl", "buildings_vehicles", "perfect transitive", "always"),
         (121, "filler", "pizza", "eat", "perfect transitive", "often")],
        "item bigint, condition string, word string, args_group string, sentence_type string,"
        " adverb string")
    eating = {"eval_data": "syn_eat_ext_for_human_exp", "token_type": "eval special"}
    df = scores(
        spark, {}, {"odds_ratio": -1.0, "random_seed": 50}, {"token_type": "eval added"},
        eating, eating | {"eval_data": "syn_sing_ext_for_human_exp"},
        {"eval_data": "syn_eat_ext_for_human_exp"},
    )
    got = sorted(prep.normalise_scores(df, items, last_human=9).collect(),
                 key=lambda r: (r["condition"], r["subject"]))
    assert [(r["subject"], r["item"], r["word"], r["correct"]) for r in got] == [
        (10, "3", "pearl", True), (11, "3", "pearl", False), (10, "121", "chalk", True)
    ]
    assert got[0]["correct_pre_training"] is False and got[1]["response"] == "[obj]"
    assert got[0]["data_source"] == "ModernBERT Base"
    assert got[0]["seen_in_training"] == "True" and got[2]["seen_in_training"] is None
    assert got[0]["sentence"] == "The [subj] has always blorked the [obj]."
    with pytest.raises(ValueError):
        prep.normalise_scores(df, items, last_human=50)
    people = table(spark, trial(target="[obj]", seen_in_training="True")).drop(
        "training", "model_id")
    merged = prep.merge_sources(people, prep.normalise_scores(df, items, 9))
    assert merged.count() == 4
    assert {r["target_response"] for r in merged.collect()} == {SUBJ, OBJ}
    assert {r["args_group"] for r in merged.collect()} >= {"buildings+vehicles args", "eat args"}


ITEM_ROWS = (
    "item bigint, condition string, word string, args_group string, sentence_type string,"
    " adverb string"
)


@pytest.fixture
def large_tables(spark, monkeypatch):
    """Every table counts as too large to broadcast, and shuffled parts are not merged."""
    monkeypatch.setattr(joins, "value_bytes", lambda table: 1 << 40)
    changes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in changes}
    for key, value in changes.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def join_depth(df):
    """Most joins that a row passes, one after the other."""
    depth, above = 0, []
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        above = [a for a in above if a < at]
        if line.lstrip(" :+-").startswith("Join"):
            above.append(at)
            depth = max(depth, len(above))
    return depth


def test_rows_that_no_item_can_match_stay_where_they_are(spark, large_tables):
    """Rows of one group and type are not gathered in one task to find that none matches."""
    items = spark.createDataFrame(
        [(1, "experimental", "a", "buildings", "t", "often"), (2, "filler", "b", "eat", "t", "often"),
         (3, "filler", "c", "eat", "t", "often"), (None, "filler", "c", None, "t", "often")], ITEM_ROWS)
    rows = spark.range(8000, numPartitions=8).select(
        "id", F.lit("experimental").alias("condition"), F.lit("a").alias("word"), F.lit("buildings").alias("args_group"),
        F.lit("t").alias("sentence_type"), F.lit("often").alias("adverb"), F.lit(1).cast("bigint").alias("item"),
    )
    other = spark.createDataFrame(
        [(8001, "filler", "z", "eat", "t", "often", None), (8002, "filler", None, None, "t", None, None),
         (8003, None, None, "eat", "t", None, None), (8004, "filler", "z", "eat", "t", "often", 9)],
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    found = prep.resolve_item(rows.union(other), items)
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 1100
    assert found.columns == rows.columns and found.where("id < 8000 and item = 1").count() == 8000
    got = sorted(((r.id, r.item) for r in found.where("id > 8000").collect()), key=str)
    assert got == [(8001, 2), (8001, 3), (8002, None), (8003, None), (8004, 9), (8004, 9)]
    unknown = prep.attach_item_ids(other.drop("item"), items)
    assert unknown.columns[-1] == "item" and unknown.where("item is null").count() == 4


def test_a_score_passes_one_large_join(spark, large_tables):
    """Scores are shuffled to the items of their own condition only, with the same result."""
    items = spark.createDataFrame(
        [(3, "experimental", "pearl", "buildings_vehicles", "perfect transitive", "always"),
         (121, "filler", "pizza", "eat", "perfect transitive", "often")], ITEM_ROWS)
    eating = {"eval_data": "syn_eat_ext_for_human_exp", "token_type": "eval special"}
    df = scores(spark, {}, {"odds_ratio": -1.0, "random_seed": 50}, eating, {"token_type": "eval added"})
    found = prep.normalise_scores(df, items, last_human=9)
    assert sorted((r.subject, r.item, r.condition, r.response) for r in found.collect()) == [
        (10, "121", "filler", "[subj]"), (10, "3", "experimental", "[subj]"), (11, "3", "experimental", "[obj]"),
    ]
    assert join_depth(found) == 2  # the subjects' ids, and one table of items


def test_a_merged_score_passes_one_large_join(spark, large_tables):
    items = spark.createDataFrame(
        [(3, "experimental", "pearl", "buildings_vehicles", "perfect transitive", "always")], ITEM_ROWS)
    people = table(spark, trial(target="[obj]")).drop("training", "model_id")
    merged = prep.merge_sources(people, prep.normalise_scores(scores(spark, {}, {"random_seed": 50}), items, 9))
    assert sorted((r.subject, r.item, r.data_source) for r in merged.collect()) == [
        (1, "1", "human"), (10, "3", "ModernBERT Base"), (11, "3", "ModernBERT Base")
    ]
    assert join_depth(merged) == 2


def joined_columns(df, key):
    """Columns of the rows that sort-merge joins on ``key`` take, one set a join."""
    found, stack = [], [df._jdf.queryExecution().sparkPlan()]
    while stack:
        plan = stack.pop()
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "SortMergeJoin" and f"{key}#" in plan.leftKeys().mkString():
            found.append({a.split("#")[0] for a in children[0].output().mkString("\n").split("\n")})
        stack += children
    return found


def test_scores_are_shuffled_without_what_describes_models_and_sentences(spark, large_tables, monkeypatch):
    items = spark.createDataFrame(
        [(3, "experimental", "pearl", "buildings_vehicles", "perfect transitive", "always"),
         (121, "filler", "pizza", "eat", "perfect transitive", "often")], ITEM_ROWS)
    eating = {"eval_data": "syn_eat_ext_for_human_exp", "token_type": "eval special"}
    df = scores(
        spark, {}, {"odds_ratio": -1.0, "random_seed": 50, "model_id": None}, eating,
        {"mask_added_tokens": None, "max_epochs": 260}, {"max_epochs": None, "arg_type": None}, {"token_type": None, "token": "pearl"},
    )
    people = table(spark, trial(target="[obj]")).drop("training", "model_id")
    plain = prep.merge_sources(people, prep.normalise_scores(df, items, 9))  # no table is small: nothing is folded
    expected = sorted(map(str, plain.collect()))
    assert len(expected) == 7
    monkeypatch.setattr(joins, "value_bytes", lambda table: 1 << 40 if {"item", "_filler_item"} & {*table.columns} else 0)
    merged = prep.merge_sources(people, prep.normalise_scores(df, items, 9))
    assert merged.columns == plain.columns and sorted(map(str, merged.collect())) == expected
    moved = joined_columns(merged, "sentence_type")
    assert len(moved) == 2
    wide = {"model_id", "data_source", "max_epochs", "mask_added_tokens", "sentence", "token_type", "target_response", "response"}
    assert not any(wide & columns for columns in moved)


def test_cossims(spark):
    df = spark.createDataFrame(
        [("m", "BLORKED", "all_but_the_top", 0, "convergence", 0.2),
         ("m", "BLORKED", "all_but_the_top", 0, "convergence", 0.4),
         ("m", "BLORKED", "all_but_the_top", 9, "convergence", 0.9),
         ("m", "BLORKED", "none", 9, "convergence", 1.0),
         ("m", "BLORKED most similar", "all_but_the_top", 9, "convergence", 1.0)],
        "model_id string, target_group string, correction string, eval_epoch bigint,"
        " epoch_criteria string, cossim double")
    r = exclude.cossim_wide(exclude.cossim_means(df)).first()
    assert r["max_cossim_to_targets_pre_training"] == 0.4
    assert r["mean_cossim_to_targets_pre_training"] == pytest.approx(0.3)
    assert r["max_cossim_to_targets"] == 0.9


# -- contrasts, draws, fit ----------------------------------------------------------------


def test_nested_contrasts_by_row(spark):
    df = spark.createDataFrame([(0.5, "Object target", "human"), (-0.5, "Object target", None)],
                               "v double, target_response string, data_source string")
    levels = contrasts.crossed(["Object target"], ["human", None])
    got = contrasts.nested_contrasts(df, ["v"], ["target_response", "data_source"], levels)
    assert set(got.columns[3:]) == {
        "v_i_n_tr_a_t_object_target", "v_i_n_ds_a_t_human", "v_i_n_ds_a_t_na",
        "v_i_n_tr_a_t_object_target_i_n_ds_a_t_human", "v_i_n_tr_a_t_object_target_i_n_ds_a_t_na",
    }
    rows = {r["data_source"]: r for r in got.collect()}
    assert rows["human"]["v_i_n_ds_a_t_human"] == 0.5 and rows[None]["v_i_n_ds_a_t_human"] == 0
    assert rows[None]["v_i_n_ds_a_t_na"] == -0.5


def test_histogram_keeps_every_draw(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)], "b_x double, sd_y double")
    got = draws.draw_histogram(df, bins=3).collect()
    assert {(r["name"], r["bin"], r["n"]) for r in got} == {
        ("b_x", 1, 3), ("b_x", 2, 3), ("b_x", 3, 4), ("sd_y", 1, 10)
    }


def test_map_fit_has_no_gradient(spark):
    cells = {(0.5, True): 70, (0.5, False): 30, (-0.5, True): 20, (-0.5, False): 80}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)],
                               "x double, correct boolean")
    est = {r["term"]: r["estimate"] for r in fit.fit_map_logit(df, ["x"], prior_sd=0.5).collect()}
    gradient = {"Intercept": 0.0, "x": -est["x"] / 0.25}
    for (x, y), n in cells.items():
        p = 1 / (1 + math.exp(-(est["Intercept"] + est["x"] * x)))
        gradient["Intercept"] += n * (y - p)
        gradient["x"] += n * (y - p) * x
    assert all(abs(g) < 1e-3 for g in gradient.values())
