"""Worked examples of the string functions."""

import pytest
from pyspark.sql import functions as F

from trialspark.functions import text
from trialspark.operators import contrasts


def one(spark, make, *values, kind="string"):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {kind}" for n in names)
    df = spark.createDataFrame([values], schema)
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first()[0]


SENTENCE = "The [subj] has always blorked the [obj]."


@pytest.mark.parametrize("given, expected", [
    ("the [subj] hasn't 2x3 Blorked THE", "The [subj] hasn't 2x3 blorked the"),
    ("a", "a"), ("ab", "Ab"), ("1ab2CD", "1Ab2Cd"), ("", ""), (None, None),
])
def test_sentence_case(spark, given, expected):
    assert one(spark, text.sentence_case, given) == expected


@pytest.mark.parametrize("given, expected", [
    ("modernbert base", "ModernBERT Base"), ("bert", "BERT"), ("MODERNBERT LARGE",
     "ModernBERT Large"), ("roberta-large", "RoBERTa-Large"),
])
def test_model_label(spark, given, expected):
    assert one(spark, text.model_label, given) == expected


@pytest.mark.parametrize("given, expected", [
    ("[subj]/[obj]", "[obj]"), ("a/b/c", "c"), ("plain", "plain"),
])
def test_alt_response(spark, given, expected):
    assert one(spark, text.alt_response, given) == expected


def test_small_functions(spark):
    assert one(spark, text.decode_feedback, "a%2Cb%0Ac%20d") == "a,b\nc%20d"
    assert one(spark, text.clean_token, "ĠĠword") == "Ġword"
    assert one(spark, text.eval_group, "syn_eat_ext_for_human_exp") == "eat"
    assert one(spark, text.find_adverb, "typically and always") == "always"
    assert one(spark, text.find_adverb, "rarely") is None
    assert one(spark, text.group_label, "buildings_vehicles") == "buildings+vehicles args"
    assert one(spark, text.group_label, None) == "NA args"
    assert one(spark, text.reading_delay, SENTENCE) == 2275


def test_clock_label(spark):
    assert one(spark, text.clock_label, 61_005, kind="bigint") == "01:01.005"
    assert one(spark, text.clock_label, 6_000_000, kind="bigint") == "100:00.000"
    assert one(spark, text.clock_label, None, kind="bigint") is None


def test_split_template(spark):
    assert tuple(one(spark, text.split_template, SENTENCE)) == (
        "The ", "[subj]", " has always blorked the ", "[obj]", "."
    )


@pytest.mark.parametrize("given, expected", [
    ("person", "man"), ("patient", "person"), ("lamp", None), (None, None),
])
def test_recode_is_one_step(spark, given, expected):
    from trialspark.schemas import EAT_TO_DRINK
    assert one(spark, lambda c: text.recode(c, EAT_TO_DRINK), given) == expected


@pytest.mark.parametrize("given, expected", [
    ("b_voice.n_i_n_tr_a_t_object_target_i_n_ds_a_t_human",
     "Voice (in) Target response @ Object Target (in) Data source @ Human"),
    ("b_voice.n:target_response.n", "Voice × Target Response"),
    ("b_modernbert", "Modernbert"),
    ("b_bert", "BERT"),
])
def test_effect_label(spark, given, expected):
    assert one(spark, text.effect_label, given) == expected


def test_find_all(spark):
    assert one(spark, lambda c: text.find_all(c, "[a-z]+"), "ab 1 cd") == ["ab", "cd"]


def test_nested_names():
    assert contrasts.nested_name(
        "voice.n", ["target_response", "data_source"], ["Object target", "human"]
    ) == "voice.n_i_n_tr_a_t_object_target_i_n_ds_a_t_human"
    assert contrasts.nested_name("v", ["data_source"], ["A (b)!"]) == "v_i_n_ds_a_t_a_b"
    assert contrasts.nested_name("v", ["voice_n"], [0.5]) == "v_i_n_vn_a_t_0.5"
    assert contrasts.term_names(["a", "b", "c"]) == [
        "a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"
    ]
