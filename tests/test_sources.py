"""Readers and writers."""

import csv
import json
import os
import random

import pyarrow as pa
import pytest

from prefspark.plans import pipelines
from prefspark.schema import EM_SCORES, IM_MARGINS, PAIR
from prefspark.sources import readers, writers
from prefspark.sources.csv_records import csv_records, read_csv
from prefspark.sources.readers import read_any


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_blank_lines_are_skipped_and_bad_lines_fail(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"prompt":"p","chosen":"ü","rejected":"r"}', "", '{"prompt":"q"}')
    assert readers.read_jsonl(spark, good, PAIR).count() == 2
    assert [tuple(r) for r in readers.read_pairs(spark, good).collect()] == [("p", "ü", "r")]
    bad = write(tmp_path / "b.jsonl", '{"prompt":"p"', '{"prompt":"q"}')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, bad, PAIR).collect()


def test_numeric_looking_text_stays_text(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"prompt":"012","chosen":"7","rejected":"8"}')
    assert tuple(readers.read_pairs(spark, path).first()) == ("012", "7", "8")


def test_nan_scores_become_null(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"prompt":"p","chosen":"c","rejected":"r","margin":NaN}')
    assert readers.read_pairs(spark, path, IM_MARGINS).first().margin is None


def test_write_keeps_text_nulls_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("é\n", None, 1.0), ("b", "c", None)], "a string, b string, x double")
    path = str(tmp_path / "out")
    assert writers.write_jsonl(df.coalesce(1), path) == 2
    part = next(f for f in os.listdir(path) if f.endswith(".json"))
    lines = open(f"{path}/{part}", encoding="utf-8").read().splitlines()
    assert [json.loads(x) for x in lines] == [{"a": "é\n", "b": None, "x": 1.0}, {"a": "b", "b": "c", "x": None}]
    assert "é" in lines[0]
    assert writers.write_jsonl(df.limit(1), path, force=False) == 0
    assert spark.read.json(path).count() == 2
    assert writers.write_jsonl(df.limit(1), path) == 1
    assert spark.read.json(path).count() == 1


def test_names():
    assert writers.subset_name("im", 30000) == "im_30k"
    assert writers.subset_name("im", 1500) == "im_1500"
    assert writers.subset_name("rad_ang", 2000, 20.0) == "rad_ang_tau20_2k"
    assert writers.subset_name("rad_ang", 2000, 2.5) == "rad_ang_tau2p5_2k"


def test_specs_and_formats(spark, tmp_path):
    assert readers.parse_spec(" a.jsonl , b@sub/dir") == [("a.jsonl", None), ("b", "sub/dir")]
    schema = "id long, text string"
    rows = [(1, 'a "quoted"\nline'), (2, "ü")]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/c.csv")
    df.write.parquet(f"{tmp_path}/set/train")
    df.write.parquet(f"{tmp_path}/set/extra")
    df.limit(1).write.parquet(f"{tmp_path}/flat")
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    with pa.OSFile(f"{tmp_path}/f.arrow", "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
        for batch in table.to_batches(max_chunksize=1):
            out.write(batch)
    with pa.OSFile(f"{tmp_path}/s.arrow", "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    csv, split, folder, arrow, stream, flat = readers.read_any(
        spark, f"{tmp_path}/c.csv,{tmp_path}/set,{tmp_path}/set@extra,{tmp_path}/f.arrow,{tmp_path}/s.arrow,{tmp_path}/flat"
    )
    for table_ in (csv.selectExpr("CAST(id AS LONG) AS id", "text"), split, folder, arrow, stream):
        assert sorted(map(tuple, table_.collect())) == rows
    assert flat.count() == 1
    assert readers.read_any(spark, f"file://{tmp_path}/f.arrow")[0].count() == 2
    assert [t.count() for t in readers.read_capped([arrow, flat], 1, "id")] == [1, 1]


def test_splits(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/train")
    assert readers.read_split(spark, str(tmp_path), "train").count() == 3
    with pytest.raises(FileNotFoundError):
        readers.read_split(spark, str(tmp_path), "test")


def test_missing_shard_is_an_error(spark, tmp_path):
    spark.range(3).write.json(f"{tmp_path}/0")
    with pytest.raises(FileNotFoundError, match="missing shards"):
        writers.merge_shards(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], "id long")
    spark.range(3, 5).write.json(f"{tmp_path}/1")
    merged = writers.merge_shards(spark, [f"{tmp_path}/{i}" for i in range(2)], "id long", "id")
    assert [r.id for r in merged.collect()] == list(range(5))


def margins(spark, tmp_path, n=40):
    im, rad, em = [], [], []
    for i in range(n):
        pair = {"prompt": f"p{i}", "chosen": "good " * (1 + i % 5), "rejected": "bad " * (1 + i % 3)}
        logps = {"ref_chosen_logprob": -1.0 - i, "ref_rejected_logprob": -2.0, "policy_chosen_logprob": -1.0, "policy_rejected_logprob": -1.0}
        im.append({**pair, **logps, "margin": i * 0.5})
        rad.append({**pair, **logps, "margin": i * 3.0 - 60})
        em.append({**pair, "em": i * 0.1 - 1})
    paths = []
    for name, rows in (("im", im), ("rad", rad), ("em", em)):
        paths.append(write(tmp_path / f"{name}.jsonl", *[json.dumps(r) for r in rows]))
    return [readers.read_pairs(spark, p, s) for p, s in zip(paths, (IM_MARGINS, IM_MARGINS, EM_SCORES))]


def test_subset_pipeline_writes_every_method(spark, tmp_path):
    im, rad, em = margins(spark, tmp_path)
    base = pipelines.prepare_features(im, rad, em)
    assert base.count() == 40
    paths = pipelines.build_subsets(base, "all", str(tmp_path / "out"), 10, "qwen", curriculum="easy-to-hard")
    assert sorted(os.listdir(tmp_path / "out")) == [
        "em_10", "im_10", "im_em_10", "lcpp_10", "map_10", "pplgap_10", "rad_ang_tau20_10", "rip_10"
    ]
    for path in paths.values():
        assert readers.read_pairs(spark, path).count() == 10
    chosen = {r.prompt for r in readers.read_pairs(spark, paths["im"]).collect()}
    assert chosen == {f"p{i}" for i in range(30, 40)}
    # a discrepancy below -20 flips the pair
    two_stage = readers.read_pairs(spark, paths["rad_ang"]).collect()
    flipped = [r for r in two_stage if int(r.prompt[1:]) < 13]
    assert all(r.chosen.startswith("bad") for r in flipped)
    assert all(r.chosen.startswith("good") for r in two_stage if r not in flipped)


def test_pipeline_checks_come_before_work(spark, tmp_path):
    im, rad, em = margins(spark, tmp_path, 3)
    with pytest.raises(ValueError, match="discrepancy margins"):
        pipelines.prepare_features(im)
    plain = pipelines.prepare_features(im, need_rad=False)
    with pytest.raises(ValueError, match="em or em_margin"):
        pipelines.build_subsets(plain, "map", str(tmp_path / "x"), 2)
    with pytest.raises(ValueError, match="rad or margin"):
        pipelines.check_methods(plain.drop("margin", "rad"), ["rad_ang"])


def test_rollout_pipeline(spark):
    rows = [(p, s, float(s), [0.1, 0.1], [1, 1]) for p in range(4) for s in range(2)] + [(9, 0, 1.0, [0.0, 0.0], [1, 1])]
    df = spark.createDataFrame(rows, "prompt_id long, i int, reward double, kl array<double>, action_mask array<int>")
    df = df.withColumn("score", df.reward)
    out = pipelines.rollout_experience(df, 2, "reinforce_baseline", (0.0, 1.0), kl_coef=0.0)
    got = {(r.prompt_id, r.i): r.advantages for r in out.collect()}
    assert len(got) == 8 and got[0, 0] == pytest.approx([-1.0, -1.0]) and got[0, 1] == pytest.approx([1.0, 1.0])


def test_threshold_sweep_writes_one_folder_per_threshold(spark, tmp_path):
    from prefspark.operators.select import tau_sweep

    rows = [(i, "p", "c", f"r{i}", float(i - 50), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string, rad double, ang double")
    out = tau_sweep(df, 5, [10, 45.5])
    got = {}
    for r in out.collect():
        got.setdefault(r.tau, set()).add((r.pair_id, r.ang))
    # above the threshold the gap stands, below its negative it is negated
    assert got == {10.0: {(i, float(i)) for i in range(95, 100)}, 45.5: {(i, float(i)) for i in (96, 97, 98, 99)} | {(0, 0.0)}}
    writers.write_tau_sweep(out, f"{tmp_path}/sweep")
    assert sorted(d for d in os.listdir(f"{tmp_path}/sweep") if d.startswith("tau")) == ["tau=10.0", "tau=45.5"]
    assert spark.read.json(f"{tmp_path}/sweep/tau=45.5").count() == 5


def test_margin_scoring(spark):
    from prefspark.operators.reward import length_scorer

    df = spark.createDataFrame([(1, "p", "aa", "b"), (2, "p", None, "b")], "pair_id long, prompt string, chosen string, rejected string")
    row = pipelines.score_margins(df, length_scorer, save_rad=True).collect()
    assert len(row) == 1 and row[0].margin == row[0].rad == (-1.0 + 0.75) - (-1.25 + 0.625)


def test_post_processing_pipeline(spark):
    df = spark.createDataFrame([("q", "a", 1.0, 0), ("q", "b", 3.0, 1)], "input string, output string, reward double, position long")
    summary, best = pipelines.post_process(df, "rs")
    assert summary.first().reward_mean == 2.0 and best.first().output == "b"
    _, shaped = pipelines.post_process(df, "csft", normalize=True)
    assert {r.input for r in shaped.collect()} == {"q <rm_score>: -0.71 ", "q <rm_score>: 0.71 "}


@pytest.mark.parametrize("size", [60, 333, 5_000, 1 << 20])
def test_csv_with_line_breaks_is_split(spark, tmp_path, size):
    rng = random.Random(size)
    texts = ["plain", "", None, "two\nlines", 'say ""', "a, b", "\n\n", 'x"\n"y', "é\r\nz", '"', "l" * 200, "many\n" * 60]
    rows = [(str(i), rng.choice(texts), rng.choice(texts)) for i in range(150)]
    for part in range(2):
        with open(f"{tmp_path}/{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if part else "\n")
            out.writerow(["id", "a", "b"])
            for r in rows[part::2]:
                out.writerow(["" if x is None else x for x in r])
                if rng.random() < 0.1:
                    f.write("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        (got,) = read_any(spark, f"{tmp_path}", split="") if size == 333 else (read_csv(spark, str(tmp_path)),)
        parts = csv_records(spark, str(tmp_path)).rdd.getNumPartitions()
        got = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    order = lambda r: tuple(x or "" for x in r)
    assert sorted(got, key=order) == sorted(((i, a or None, b or None) for i, a, b in rows), key=order)
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    same = lambda r: tuple(x and x.replace("\r\n", "\n") for x in r)  # one task makes line ends of texts those of the file
    assert sorted(map(same, got), key=order) == sorted((same(r) for r in one.collect()), key=order)
    assert (parts > 20) == (size < 1_000)


def test_csv_with_a_schema(spark, tmp_path):
    (tmp_path / "x.csv").write_text('n,t\n1,"a\nb"\n2,\n')
    (got,) = read_any(spark, str(tmp_path / "x.csv"), schema=spark.createDataFrame([], "n int, t string").schema)
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb"), (2, None)]
