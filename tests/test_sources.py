"""Readers and writers."""

import gzip

from trialspark import schemas as S
from trialspark.operators import draws, ordered
from trialspark.sources import readers, writers


def test_event_log_comments_blanks_and_missing(spark, tmp_path):
    schema = S.struct(order="bigint", x="string", y="string", z="double")
    (tmp_path / "log.csv").write_text(
        "# a comment line\n3,NA,z # tail,extra\n\n4,\"q\n5,,y,1.5,beyond\nbad,a,b,NA\n"
    )
    rows = sorted(readers.read_event_log(spark, str(tmp_path), schema).collect(),
                  key=lambda r: r["row_id"])
    assert [tuple(r[f.name] for f in schema) for r in rows] == [
        (3, None, "z ", None), (4, '"q', "", None), (5, "", "y", 1.5), (None, "a", "b", None),
    ]
    assert [(r["fields"], r["surplus"], r["bad_numbers"]) for r in rows] == [
        (3, None, 0), (2, None, 0), (5, "beyond", 0), (4, None, 1),
    ]


def test_row_id_follows_files_and_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part{f}.csv").write_text("".join(f"{f * 500 + i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        log = readers.read_event_log(spark, str(tmp_path), S.struct(n="bigint"))
        assert log.rdd.getNumPartitions() > 3
        numbered = ordered.row_numbers(log, [], "row_id", "at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(numbered) == 1500
    assert all(r["at"] == r["n"] + 1 for r in numbered)


def test_full_log_schema(spark, tmp_path):
    names = [f.name for f in S.EVENT_LOG]
    values = {n: n for n in names} | {"time_received": "1", "order": "2", "event_time": "3"}
    (tmp_path / "log.csv").write_text(",".join(values[n] for n in names) + "\n")
    row = readers.read_event_log(spark, str(tmp_path)).first()
    assert (row["order"], row["event_time"], row["sentence"]) == (2, 3, "sentence")


def test_items_are_quoted(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("item,sentence,sentence_type,group,word,target_response,adverb\n"
                    'prac,"Because the [subj] has blorked the [obj], I am glad.",t,g,w,[subj],a\n')
    row = readers.read_items(spark, str(path), "training").first()
    assert row["sentence"] == "Because the [subj] has blorked the [obj], I am glad."
    assert row["adverb"] == "a"


def test_gzipped_scores_below_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    # column order differs and there is a column too many: matched by name
    for i, place in enumerate(["a", "a/b"]):
        with gzip.open(tmp_path / place / f"x{i}.odds_ratios.csv.gz", "wt") as out:
            out.write("extra,odds_ratio,model_id,random_seed,mask_added_tokens,sentence,"
                      + ",".join(f.name for f in S.MODEL_SCORES if f.name not in (
                          "odds_ratio", "model_id", "random_seed", "mask_added_tokens",
                          "sentence")) + "\n")
            out.write(f'e,{i}.5,m{i},7,True,"a, b",' + ",".join(["1"] * 10) + "\n")
    (tmp_path / "a" / "other.csv.gz").write_bytes(b"")
    rows = readers.read_model_scores(spark, str(tmp_path)).orderBy("model_id").collect()
    assert [(r["model_id"], r["odds_ratio"]) for r in rows] == [("m0", 0.5), ("m1", 1.5)]
    assert rows[0]["mask_added_tokens"] is True and rows[0]["sentence"] == "a, b"
    with gzip.open(tmp_path / "y.cossims.csv.gz", "wt") as out:
        out.write(",".join(f.name for f in S.COSSIMS) + "\nm,bert,t,BLORKED,c,0,conv,0.25\n")
    assert readers.read_cossims(spark, str(tmp_path)).first()["cossim"] == 0.25


def test_accuracy_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "5", True, 0.5, "human"), (2, "6", False, None, "BERT")],
        "subject bigint, item string, correct boolean, log_rt double, data_source string",
    )
    writers.write_accuracy(df, str(tmp_path / "csv"), kind="csv")
    back = {r["subject"]: r for r in readers.read_accuracy(spark, str(tmp_path / "csv")).collect()}
    assert back["1"]["correct"] is True and back["1"]["log_rt"] == 0.5
    assert back["2"]["log_rt"] is None and back["2"]["item"] == "6"
    writers.write_accuracy(df, str(tmp_path / "pq"))
    assert (tmp_path / "pq" / "data_source=human").exists()
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_report(spark, tmp_path):
    table = spark.createDataFrame([(1.0, -1.0), (2.0, -2.0), (-1.0, -3.0), (3.0, -1.0)],
                                  "`b_voice.n` double, `b_bert` double")
    got = {r["name"]: r for r in draws.p_mcmc(table).collect()}
    assert (got["b_voice.n"]["p"], got["b_voice.n"]["direction"]) == (0.25, " < 0")
    assert (got["b_bert"]["p"], got["b_bert"]["stars"]) == (0.0, "***")
    writers.write_report(draws.p_mcmc_report(table, "m"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    assert text.splitlines() == [
        "#" * 81, "m posteriors", "-" * 81, "0.2500: Voice < 0 ", "0.0000: BERT > 0 ***",
        "#" * 81,
    ]


def test_reordered_headers_are_read_by_name(spark, tmp_path):
    names = [f.name for f in S.COSSIMS]
    values = {n: "7" if n in ("eval_epoch", "cossim") else n for n in names}
    for i, header in enumerate([names, names[::-1]]):
        with gzip.open(tmp_path / f"{i}.cossims.csv.gz", "wt") as out:
            out.write(",".join(header) + "\n" + ",".join(values[n] for n in header) + "\n")
    rows = readers.read_cossims(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert rows[0].asDict() == values | {"eval_epoch": 7, "cossim": 7.0}
