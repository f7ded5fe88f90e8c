"""Inputs that the benchmark tables do not hold."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark import schemas as S
from trialspark.functions import stats
from trialspark.operators import contrasts, exclude, metrics, prep, schedule
from trialspark.sources import readers


def test_log_keeps_surplus_fields_and_counts_bad_numbers(spark, tmp_path):
    width = len(S.EVENT_LOG)
    fields = [str(i) for i in range(width + 3)]
    number = next(i for i, f in enumerate(S.EVENT_LOG) if f.dataType.typeName() == "long")
    broken = list(fields[:width])
    broken[number] = "x1"
    (tmp_path / "log.csv").write_text("\n".join([",".join(fields), ",".join(broken), "1,2"]) + "\n")
    rows = {r["fields"]: r for r in readers.read_event_log(spark, str(tmp_path)).collect()}
    assert rows[width + 3]["surplus"] == ",".join(fields[width:])
    assert rows[width]["surplus"] is None and rows[width]["bad_numbers"] == 1
    assert rows[width + 3]["bad_numbers"] == 0 and rows[2]["bad_numbers"] == 0


def test_score_files_with_other_headers(spark, tmp_path):
    files = {
        "a_odds_ratios.csv.gz": "model_id,odds_ratio,sentence\nm1,0.5,one\n",
        "b_odds_ratios.csv.gz": 'extra,sentence,odds_ratio,model_id\n9,"two, three",NaN,m2\n',
        "c_odds_ratios.csv.gz": "model_id,odds_ratio,sentence\nm3,NA,four\n",
    }
    for name, body in files.items():
        with gzip.open(tmp_path / name, "wt") as file:
            file.write(body)
    rows = {r["model_id"]: r for r in readers.read_model_scores(spark, str(tmp_path)).collect()}
    assert (rows["m1"]["odds_ratio"], rows["m1"]["sentence"]) == (0.5, "one")
    assert (rows["m2"]["odds_ratio"], rows["m2"]["sentence"]) == (None, "two, three")
    assert rows["m3"]["odds_ratio"] is None and rows["m1"]["args_group"] is None
    with pytest.raises(FileNotFoundError):
        readers.read_cossims(spark, str(tmp_path))


def test_accuracy_with_dotted_names(spark, tmp_path):
    nested = "voice.n_i_n_tr_a_t_object_target_i_n_ds_a_t_human"
    (tmp_path / "acc.csv").write_text(
        f"subject,log.RT,voice.n,{nested},correct\ns1,6.9,0.5,0.5,TRUE\ns2,NA,-0.5,odd,FALSE\n"
    )
    rows = {r["subject"]: r for r in readers.read_accuracy(spark, str(tmp_path / "acc.csv")).collect()}
    assert rows["s1"]["voice_n"] == 0.5 and rows["s1"][nested.replace(".", "_")] == 0.5
    assert rows["s2"][nested.replace(".", "_")] is None and rows["s1"]["correct"] is True


def test_nested_contrasts_of_a_dotted_column(spark):
    df = spark.createDataFrame([(0.5, "a")], ["voice.n", "f"])
    got = contrasts.nested_contrasts(df, ["voice.n"], ["f"], [("a",), ("b",)]).collect()[0]
    assert list(got[2:]) == [0.5, 0.0]


def test_trials_of_unlisted_items_stay(spark):
    trials = spark.createDataFrame([(1, 1), (1, 2)], "subject long, item long")
    items = spark.createDataFrame([(1, "x", "y")], "item long, w0 string, w1 string")
    rows = {r["item"]: r for r in schedule.assign_words(trials, items, ["w0", "w1"]).collect()}
    assert rows[2]["word"] is None and rows[2]["target_response"] is None
    assert rows[1]["word"] in ("x", "y")


def test_nan_odds_are_missing(spark):
    nan = float("nan")
    row = {f.name: None for f in S.MODEL_SCORES} | {
        "model_id": "m", "model_name": "bert", "eval_data": S.EXPERIMENTAL_EVAL, "token": "a",
        "odds_ratio": nan, "odds_ratio_pre_post_difference": nan, "sentence": "x",
    }
    df = spark.createDataFrame([row], S.MODEL_SCORES)
    got = prep.score_rows(df).collect()[0]
    assert got["correct"] is None and got["correct_pre_training"] is None


def cossims(spark, rows):
    whole = [("m", "BLORKED", "all_but_the_top", epoch, criteria, value) for epoch, criteria, value in rows]
    return spark.createDataFrame(
        whole, "model_id string, target_group string, correction string, eval_epoch long, "
        "epoch_criteria string, cossim double",
    )


def test_missing_similarities_are_not_skipped(spark):
    got = exclude.cossim_means(cossims(spark, [(0, "x", 0.5), (0, "x", None), (1, "x", 0.2)]))
    rows = {r["eval_epoch"]: r for r in got.collect()}
    assert rows["0"]["max_cossim_to_targets"] is None and rows["0"]["mean_cossim_to_targets"] is None
    assert rows["x"]["max_cossim_to_targets"] == 0.2


def test_two_criteria_of_a_model_are_reported(spark):
    means = exclude.cossim_means(cossims(spark, [(0, "x", 0.5), (1, "x", 0.1), (1, "y", 0.9)]))
    wide = exclude.cossim_wide(means).collect()[0]
    assert wide["max_cossim_to_targets"] is None
    assert wide["max_cossim_to_targets_pre_training"] == 0.5
    assert exclude.doubled_criteria(means).collect()[0]["criteria"] == ["x", "y"]


@pytest.mark.parametrize("n", [10, 1e3, 1e4, 1e6, 1e9, 1e11, 1e12])
def test_beta_of_any_size(n):
    half = stats.beta_cdf(np.array([0.5]), np.array([n / 2 + 1]), np.array([n / 2 + 1]))
    assert abs(half[0] - 0.5) < 1e-9
    # a success in none of n: 1 - (1 - x)^(n + 1)
    x = 1.5 / n
    none = stats.beta_cdf(np.array([x]), np.array([1.0]), np.array([n + 1]))
    assert none[0] == pytest.approx(-math.expm1((n + 1) * math.log1p(-x)), rel=1e-9)
    low, high = (stats.beta_quantile(p, np.array([n / 4 + 1]), np.array([3 * n / 4 + 1]))[0] for p in (0.025, 0.975))
    assert low < 0.25 + 2 / n and high > 0.25
    if n >= 1e6:
        sd = math.sqrt(0.25 * 0.75 / n)
        assert low == pytest.approx(0.25 - 1.959964 * sd, abs=0.02 * sd + 2 / n)


def test_integral_and_fraction_agree():
    a, b = np.array([3001.0, 5000.0, 4000.0]), np.array([9000.0, 3500.0, 4000.0])
    x = a / (a + b) + np.array([-0.004, 0.003, 0.0])
    assert np.allclose(stats._beta_integral(x, a, b), stats._beta_fraction(x, a, b), atol=1e-11)


def test_labels_round_as_c_does(spark):
    df = spark.createDataFrame([("human", "l", "v", "t", i == 0) for i in range(8)],
                               "data_source string, linear string, voice string, target_response string, correct boolean")
    assert metrics.accuracy_bars_linear(df).collect()[0]["label"] == "0.12"


def test_stage_labels_have_ranks(spark):
    df = spark.createDataFrame([("People",), ("BERT (pre-fine-tuning)",), ("ModernBERT Large (pre-fine-tuning)",)], "stage string")
    assert [r["stage_rank"] for r in prep.with_ranks(df).collect()] == [1, 3, 7]


def test_many_missing_and_tied_medians(spark):
    df = spark.range(3000).select(
        F.col("id").alias("subject"), F.when(F.col("id") % 3 == 0, F.lit(1.5)).alias("median")
    )
    rows = metrics.rank_medians(df).collect()
    ordered = sorted(rows, key=lambda r: (r["median"] is None, r["subject"]))
    assert [r["rank"] for r in ordered] == list(range(1, 3001))


def test_nested_long_equals_the_wide_form(spark):
    df = spark.createDataFrame([(1, 0.5, "a", "x"), (2, -0.5, "b", None)], "k long, v double, f string, g string")
    got = {(r["k"], r["contrast"], tuple(r["levels"])): r["value"]
           for r in contrasts.nested_long(df, ["k"], ["v"], ["f", "g"]).collect()}
    assert got[1, "v_i_n_f", ("a",)] == 0.5 and got[1, "v_i_n_f", ("b",)] == 0.0
    assert got[2, "v_i_n_f_i_n_g", ("b", None)] == -0.5 and len(got) == 12


def sparse_rows(spark, n=400):
    rng = np.random.default_rng(8)
    rows = [
        (i, float(rng.normal()) if i % 17 else None, float(i % 3), "abc"[rng.integers(3)], int(rng.integers(30)),
         None if i % 11 == 0 else "xy"[i % 2])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k long, v double, w double, f string, g int, `h.i` string")


def test_sparse_vectors_equal_the_rows_of_nested_long(spark):
    df = sparse_rows(spark).withColumnRenamed("h.i", "h")
    columns, factors = ["v", "w"], ["f", "g", "h"]
    dictionary = contrasts.level_dictionary(df, columns, factors)
    slots = {r["slot"]: (r["contrast"], tuple(r["levels"])) for r in dictionary.collect()}
    assert sorted(slots) == list(range(len(slots)))
    order = [(c, tuple((x is not None, x or "") for x in t)) for c, t in (slots[i] for i in range(len(slots)))]
    assert order == sorted(order)
    out = contrasts.nested_sparse(df, columns, factors, dictionary)
    assert out.columns == [*df.columns, "nested"]
    got, rows = {}, out.collect()
    for r in rows:
        assert len(r["nested"]) == 14 and [e["slot"] for e in r["nested"]] == sorted(e["slot"] for e in r["nested"])
        got.update({(r["k"], *slots[e["slot"]]): e["value"] for e in r["nested"]})
    dense = contrasts.nested_long(df, ["k"], columns, factors)
    expected = {(r["k"], r["contrast"], tuple(r["levels"])): r["value"] for r in dense.collect()}
    assert len(rows) == 400 and set(got) <= set(expected)
    assert all(got.get(key, 0.0) == value for key, value in expected.items())


def test_sparse_vectors_need_no_cross_join(spark):
    df = sparse_rows(spark)
    dictionary = contrasts.level_dictionary(df, ["v"], ["f", "g", "h.i"])
    plan = contrasts.nested_sparse(df, ["v"], ["f", "g", "h.i"], dictionary)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "HashJoin" in plan


def test_sparse_vectors_of_unknown_levels_and_empty_tables(spark):
    df = sparse_rows(spark).select("k", "v", "f")
    known = contrasts.level_dictionary(df.where("f = 'a'"), ["v"], ["f"])
    sizes = {(r["f"], len(r["nested"])) for r in contrasts.nested_sparse(df, ["v"], ["f"], known).collect()}
    assert sizes == {("a", 1), ("b", 0), ("c", 0)}
    empty = contrasts.level_dictionary(df.limit(0), ["v"], ["f"])
    assert empty.count() == 0 and contrasts.nested_sparse(df.limit(0), ["v"], ["f"], empty).count() == 0
    alone = contrasts.level_dictionary(df, ["f"], ["f"])
    assert alone.count() == 0


def test_stacked_stages_have_a_display_order(spark):
    rows = spark.createDataFrame(
        [(s,) for s in ["BERT (pre-fine-tuning)", "People", "BERT (fine-tuned)"]], "data_source string"
    )
    ranked = prep.with_ranks(rows, levels={"data_source": S.STAGES})
    assert [r[0] for r in ranked.orderBy("data_source_rank").collect()] == S.STAGES[:3]
