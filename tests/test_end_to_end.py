"""A raw log and raw scores through the whole pipeline."""

import gzip

import pytest
from pyspark.sql import functions as F

from trialspark import schemas as S
from trialspark.operators import contrasts, exclude, metrics, prep
from trialspark.sources import readers

NAMES = [f.name for f in S.EVENT_LOG]
ITEMS = [
    # item, sentence, sentence type, group, word, target
    (0, "The [subj] has always blorked the [obj].", "perfect transitive", "b_v", "barn", "[subj]"),
    (1, "The [subj] has always blorked the [obj].", "perfect transitive", "b_v", "bus", "[obj]"),
    (2, "The [obj] has always been blorked by the [subj].", "perfect passive", "b_v", "barn",
     "[subj]"),
    (3, "The [obj] has always been blorked by the [subj].", "perfect passive", "b_v", "bus",
     "[obj]"),
    (121, "The [subj] has always eaten the [obj].", "perfect transitive", "eat", "person",
     "[subj]"),
]


def line(**fields):
    return ",".join(str(fields.get(n, "x")) for n in NAMES)


def session(person, wrong=(), slow_break=False, training_tries=1):
    clock, lines = 1000, []
    for i in range(21):
        for _ in range(training_tries if i < 5 else 1):
            lines.append(line(ip_md5=person, order=i + 1, condition="trial_train_rep00",
                              element_name="dd", parameter="Drop", value="[subj]",
                              event_time=clock, item="prac"))
    for edge, at in (("Start", clock), ("End", clock + (901_000 if slow_break else 61_005))):
        lines.append(line(ip_md5=person, order=40, condition="break", element_name="b",
                          parameter="_Trial_", value=edge, event_time=at))
    for n, (item, sentence, kind, group, word, target) in enumerate(ITEMS):
        answer = target if item not in wrong else {"[subj]": "[obj]", "[obj]": "[subj]"}[target]
        common = dict(ip_md5=person, order=50 + n, condition="trial", item=item, word=word,
                      target_response=target, args_group=group, sentence_type=kind,
                      sentence=sentence, adverb="always",
                      seen_in_training="NA" if group == "eat" else "True")
        for name, parameter, value, at in (
            ("_Trial_", "_Trial_", "Start", clock), ("dd", "Drag", "x", clock + 1),
            ("dd", "Drop", answer, clock + 2), ("mouse", "move", "m", clock + 3),
            ("_Trial_", "_Trial_", "End", clock + 9000),
        ):
            lines.append(line(**common, element_name=name, parameter=parameter, value=value,
                              event_time=at))
    lines.append(line(ip_md5=person, order=90, condition="feedback", element_name="feedback",
                      parameter="Final", value="fine%2C%0Athanks# really"))
    return lines


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    people = session("zz") + ["# note"] + session("aa", slow_break=True, training_tries=3)
    (folder / "log.csv").write_text("\n".join(people) + "\n")
    fields = [f.name for f in S.MODEL_SCORES]
    with gzip.open(folder / "m.odds_ratios.csv.gz", "wt") as out:
        out.write(",".join(fields) + "\n")
        for item, sentence, kind, group, word, target in ITEMS:
            other = {"[subj]": "[obj]", "[obj]": "[subj]"}[target]
            row = dict(
                model_id="m1", model_name="bert", random_seed=77, token=word, arg_type=target,
                eval_data=S.EXPERIMENTAL_EVAL if "_" in group else f"syn_{group}_ext_for_human_exp",
                token_type="tuning" if "_" in group else "eval special",
                ratio_name=f"{target}/{other}", odds_ratio=-1.5 if item == 3 else 2.0,
                odds_ratio_pre_post_difference=3.0, max_epochs=5000, mask_added_tokens="False",
                sentence=sentence.lower(), sentence_type=kind, args_group=group,
            )
            out.write(",".join(str(row[f]) for f in fields) + "\n")
    log = readers.read_event_log(spark, str(folder / "log.csv")).transform(prep.prepare_log)
    trials = log.transform(prep.build_trials).transform(prep.log_rt).transform(prep.label_trials)
    scores = readers.read_model_scores(spark, str(folder))
    models = prep.normalise_scores(scores, prep.item_ids(trials), last_human=2)
    return log, prep.merge_sources(trials, models)


def test_sources_share_one_table(merged):
    _, trials = merged
    got = {(r["subject"], r["data_source"]): r["n"] for r in
           trials.groupBy("subject", "data_source").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "human"): 5, (2, "human"): 5, (3, "BERT"): 5}
    assert [f.name for f in S.TRIALS] == trials.columns
    wrong = trials.where("not correct").collect()
    assert [(r["subject"], r["item"], r["response"]) for r in wrong] == [(3, "3", "[subj]")]
    assert trials.where("log_rt is not null").count() == 10


def test_side_tables(merged):
    log, _ = merged
    assert {r["feedback"] for r in log.transform(prep.feedback).collect()} == {"fine,\nthanks"}
    breaks = {r["subject"]: r["break_time"] for r in prep.break_times(log).collect()}
    assert breaks == {1: "01:01.005", 2: "15:01.000"}
    shares = {r["subject"]: r["pr_first_choice_correct"]
              for r in prep.session_accuracy(log).collect()}
    assert shares == {1: 1.0, 2: pytest.approx(16 / 21)}


def test_exclusion_to_accuracy(merged):
    log, trials = merged
    training = prep.session_accuracy(log)
    out = exclude.exclusions(
        trials, prep.below_training(training), prep.excessive_breaks(prep.break_times(log))
    )
    reasons = {r["subject"]: r["why_excluded"] for r in out.collect()}
    # one row per cell: no test can tell anyone from chance or from linear
    assert reasons[2] == (
        "<90% on training; break time > 15 minutes; n.d. from linear"
    )
    assert reasons[1] == "n.d. from linear"
    kept = exclude.apply_exclusions(trials, out)
    rows, fillers = exclude.split_conditions(kept)
    assert {r[0] for r in rows.select("subject").distinct().collect()} == {1, 3}
    assert fillers.count() == 2
    table = metrics.accuracy_table(metrics.attach_f_scores(rows))
    assert table.count() == 8
    nested = contrasts.nested_contrasts(
        table, ["voice_n"], ["target_response", "data_source"],
        contrasts.crossed(["Object target", "Subject target"], ["human", "BERT"]),
    )
    assert "voice_n_i_n_tr_a_t_object_target_i_n_ds_a_t_human" in nested.columns
    chart = exclude.session_chart(training, out)
    assert {r["title"] for r in chart.collect()} == {"1 (Included)", "2 (Excluded)"}
