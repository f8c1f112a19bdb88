import json

import numpy as np
import pytest
from corpusloom.model import network
from corpusloom.operators import feasibility as fe
from corpusloom.operators import levels as lv
from corpusloom.operators import manifest as mf
from corpusloom.operators import spectral as sp
from corpusloom.sources import files, jsonl
from pyspark.sql import functions as F


def test_model_sizes_and_lengths():
    shape = network.Shape()
    assert shape.parameters() == 128 * (80 * 3 + 1) + 128 * (128 * 3 + 1) + 3 * 256 * (128 + 256 + 2) + 50 * 257 and shape.stride == 4
    small = network.Network(network.Shape(mels=4, classes=5, layers=((6, 3, 2, 1), (6, 3, 2, 1)), hidden=7))
    rng = np.random.default_rng(0)
    for n in range(1, 40):
        x = rng.standard_normal((n, 4)).astype(np.float32)
        assert small.logits(x).shape == (small.shape.lengths(n), 5)


def test_model_scores_in_batches(spark):
    net = network.Network(network.Shape(mels=2, classes=3, layers=((4, 3, 2, 1),), hidden=4))
    rows = [(1, [[0.1, 0.2]] * 5), (2, []), (3, None)]
    got = {r.utt: r.tokens for r in network.score(spark.createDataFrame(rows, "utt long, mels array<array<float>>"), net).collect()}
    assert len(got[1]) == 3 and got[2] is None and got[3] is None
    assert spark.range(1).select(network.pad_labels(F.array(F.lit(4)), F.lit(3))).first()[0] == [4, 0, 0]


def test_quality_report(spark):
    df = spark.range(1).select(F.lit(1).cast("long").alias("utt"), F.concat(lv.sine(0.5, 440.0), F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda i: F.lit(0.0).cast("float"))).alias("samples"), F.lit(16_000).alias("sample_rate"))
    silent = spark.createDataFrame([(2, [0.0] * 2000, 16_000), (3, [0.1], 16_000)], "utt long, samples array<float>, sample_rate int")
    got = {r.utt: r for r in sp.quality_report(df.unionByName(silent)).collect()}
    assert 0.45 < got[1].silence_ratio < 0.55 and got[1].loudness == "normal" and abs(got[1].duration - 1.0) < 1e-9
    assert got[2].silence_ratio == 1 and got[2].estimated_snr_db == 0 and got[2].loudness == "silent"
    assert got[3].spectral_centroid_hz == 0 and got[3].zero_crossing_rate == 0
    wave = np.array(spark.range(1).select(lv.speech_like(0.25)).first()[0])
    assert len(wave) == 4000 and 0.05 < np.abs(wave).max() <= 0.35
    assert abs(sp.dominant_frequency(np.array(spark.range(1).select(lv.sine(1.0, 440.0)).first()[0]), 16_000) - 440) <= 1
    z = sp.stft(wave.astype(np.float32))
    assert np.allclose(sp.magnitude(z) ** 2, sp.power(z), rtol=1e-4) and np.abs(sp.phase(z)).max() <= np.pi + 1e-6
    assert sp.extract_features(df).count() == 101


def rows(spark):
    data = [(1, "a", "க" * 40, "s1", "A", "train", 0.35), (2, "b", "அ ஆ", "s1", "A", "train", 3.0), (3, "c", "x", "s2", "B", "dev", 1.0)]
    return spark.createDataFrame([(*d, 16_000) for d in data], "row_id long, utterance_id string, text string, speaker_id string, prefix string, split string, duration_seconds double, sample_rate int")


def test_versions(spark, tmp_path):
    df = rows(spark)
    gone = fe.corrupt(df)
    new = fe.curated(df)
    assert all(r.ok for r in mf.curation_checks(df, new, gone.select("row_id")).collect())
    bad = new.withColumn("text", F.when(F.col("row_id") == 3, "changed").otherwise(F.col("text"))).where("row_id <> 2")
    failed = {r.name for r in mf.curation_checks(df, bad, gone.select("row_id")).collect() if not r.ok}
    assert failed == {"nothing but the named rows is gone", "kept rows are unchanged"}
    doc = json.loads(mf.metadata(new, gone, "d", "v002", "v001").first().json)
    assert doc["changes"]["removed_utterances"] == 1 and doc["splits"]["train"]["utterances"] == 1 and doc["speakers"]["dev"] == ["s2"]
    path = mf.write_version(new, str(tmp_path), "v002")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        mf.write_version(new, str(tmp_path), "v002")


def test_words_and_recordings(spark, tmp_path):
    ranks = spark.createDataFrame([("b", 2), ("a", 1)], "word string, rank long")
    jsonl.write_words(ranks, str(tmp_path))
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/word_vocab").collect()) == ["a", "b"]
    assert files.first_recording(spark, str(tmp_path)) is None
    (tmp_path / "b.mp3").write_bytes(b"x"), (tmp_path / "z.wav").write_bytes(b"x"), (tmp_path / "a.wav").write_bytes(b"")
    assert files.first_recording(spark, str(tmp_path)).endswith("z.wav")


def test_issue_texts(spark):
    df = lv.validate(spark.createDataFrame([(1, [0.5] * 9, 16_000)], "utt long, samples array<float>, sample_rate int"))
    r = df.select(lv.summary(F.col("issues")).alias("s"), F.size(lv.of_severity(F.col("issues"), "warning")).alias("w")).first()
    assert r.s == "dc_offset(warning)" and r.w == 1
