"""The pipeline, stage by stage, against plain versions of the stages."""

import json

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_texts import TEXTS, check_packing, plain_lines, plain_personal
from trialspark.llm.queries import vocabulary

REPEATED = "a text of nine words that stands in many rows"
SMALL = "/root/testdata/sf0.001/documents.parquet"


def personal(text):
    """Plain rules; texts without a digit or an @ are left out, which they take too long for."""
    return plain_personal(text) if text and any(c == "@" or c.isdigit() for c in text) else []


def in_order(row):
    return tuple((x is not None, x) for x in row)


def rows_of(docs):
    return sorted((tuple(r) for r in docs.collect()), key=in_order)


def without_copies(rows):
    """One row of each (id, text), and one of each group: the smallest id, missing ones last."""
    firsts = {}
    for r in sorted(rows, key=lambda r: json.dumps([x for x in r if x is not None])):
        firsts.setdefault((r[0], r[1]), r)
    # ids that share a number are told apart as the stage does, so only groups are compared
    keys = sorted(firsts, key=lambda k: (k[0] is None, k[0] or 0, k[1] or ""))
    groups = {}
    for place, (_, _, low, _) in enumerate(brute.near_duplicates([(i, k[1]) for i, k in enumerate(keys)], 5, 80)):
        groups.setdefault(low, []).append(keys[place])
    return [firsts[group[0]] for group in groups.values()]


def test_stages_on_documents_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(SMALL)
    odd = [(10**6 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    odd += [(None, "keyless text of some words", None, None, 3), (10**6 + 5, "another text of that key", "en", "s", 3)]
    odd += [(10**6 + 90, REPEATED, "en", "s", n) for n in (7, 7, 7)] + [(None, REPEATED, None, None, n) for n in (1, 1)]
    odd += [(10**6 + 91, "one id and one text in two rows of other sources", "en", x, 3) for x in ("t", "s")]
    odd += [(None, "keyless text in two rows without an id", None, None, n) for n in (5, 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = docs.withColumn("lang_pred", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("starts", F.lit(2))
    docs = docs.withColumn("score", F.lit("s")).withColumn("spans", F.lit(None).cast("string"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        found = stage(spark, docs, "")
        seen.append((name, rows_of(docs)))
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
    inputs = dict(seen)
    assert list(inputs) == [
        "language_id", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing"
    ]

    # Texts without a letter go; labelled documents stay as they were.
    before, after = inputs["language_id"], inputs["line_dedup"]
    assert set(after) <= set(before)
    gone = set(before) - set(after)
    assert {r for r in before if not any(c.isalpha() for c in r[1] or "")} <= gone
    assert not {r for r in gone if r[2] is not None and len(r[1]) > 30}

    before, after = after, inputs["minhash_near_dedup"]
    assert len({r[0] for r in before}) < len(before)  # one key with two texts is among them
    single = [r[0] for r in before]
    single = {k for k in single if single.count(k) == 1 and k is not None}
    expected = [(k, t) for k, t, *_ in plain_lines([(r[0], r[1]) for r in before if r[0] in single])]
    assert len(after) == len(before)
    assert {(r[0], r[1]) for r in after if r[0] in single} == set(expected)

    before, after = after, inputs["pii"]
    assert after == sorted(without_copies(before), key=in_order)
    assert len(set(after)) == len(after) and any(r[0] is None for r in after)
    assert sum(r[1] == REPEATED for r in before) > 3 and sum(r[1] == REPEATED for r in after) == 1
    assert [r[3] for r in after if r[0] == 10**6 + 91] == ["s"]

    before, after = after, inputs["best_fit_packing"]
    assert len(after) == len(before)
    texts = {(r[0], r[1]) for r in after}
    changed = [r for r in before if (r[0], r[1]) not in texts]
    assert changed and {r for r in before if personal(r[1])} <= set(changed)
    assert not any(personal(r[1]) for r in after)

    rows = [(r[0], r[1]) for r in after]
    used, least = check_packing(rows, docs, vocabulary("word_bpe_49k.json"), 2048)
    assert used <= 1.01 * least + 1


def test_run_reads_the_table_and_takes_an_empty_one(spark, tmp_path):
    docs = spark.read.parquet(SMALL)
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} < set(found.columns)
    assert found.select("doc_id", "piece").distinct().count() == found.count() > 0
