"""Checks, guards, settings, headers and the parts of a model's data."""

import json
import struct

import numpy as np
import pytest
from corpusloom.config import TokenizerConfig
from corpusloom.model import network
from corpusloom.operators import decode as de
from corpusloom.operators import feasibility as fe
from corpusloom.operators import frames as fr
from corpusloom.operators import manifest as mf
from corpusloom.operators import vocabulary as vo
from corpusloom.sources import files, jsonl, settings, wav
from pyspark.sql import functions as F

RECORD = "row_id long, utterance_id string, text string, speaker_id string, prefix string, split string, duration_seconds double, sample_rate int, audio_path string"


def records(spark, rows):
    names = [c.split()[0] for c in RECORD.split(", ")]
    usual = {"text": "அ ஆ", "speaker_id": "0000001", "prefix": "A", "split": "train", "duration_seconds": 2.0, "sample_rate": 16_000, "audio_path": "a/b.wav"}
    return spark.createDataFrame([tuple((usual | {"utterance_id": f"u{r['row_id']}"} | r)[n] for n in names) for r in rows], RECORD)


def failed(checks):
    return {r.name: r.detail for r in checks.collect() if not r.ok}


def test_integrity_counts_what_is_wrong(spark):
    rows = records(spark, [{"row_id": 1}, {"row_id": 2, "utterance_id": "u1", "split": "dev"}, {"row_id": 3, "text": " ", "audio_path": "/x", "sample_rate": 8_000, "split": "odd", "speaker_id": "2"}])
    files_ = spark.createDataFrame([("u1",)], "utterance_id string")
    heads = spark.createDataFrame([("u1", 2.0), ("u3", 2.5)], "utterance_id string, duration double")
    told = spark.createDataFrame([("train", 1, 1, 2 / 3600), ("dev", 2, 1, 2 / 3600), ("odd", 1, 1, 2 / 3600), ("total", 3, 5, 1.0)], "split string, utterances long, speakers long, hours double")
    assert failed(mf.integrity(rows, told, files_, heads)) == {
        "utterance ids are unique": 1, "splits share no speaker": 1, "no transcript is empty": 1, "paths are relative": 1, "sample rate is canonical": 1, "split names are known": 1,
        "no speaker in both train and dev": 1, "splits have the stated rows": 1, "speakers are as stated": 1, "hours are as stated": 1, "recordings exist": 1, "durations are those of the headers": 1,
    }
    good = records(spark, [{"row_id": 1}, {"row_id": 2, "split": "dev", "speaker_id": "2"}])
    assert failed(mf.integrity(good, mf.summary(good))) == {}
    empty = records(spark, [])
    assert failed(mf.integrity(empty)) == {}
    t = mf.tally(mf.integrity(rows).unionByName(spark.createDataFrame([("later", None, None)], "name string, ok boolean, detail long"))).first()
    assert (t.passed, t.failed, t.pending) == (3, 7, 1)


def test_enforced_checks_raise(spark):
    rows = records(spark, [{"row_id": 1, "text": "x" * 500}, {"row_id": 2, "text": ""}])
    with pytest.raises(ValueError, match="starved of frames: 1; no row is without labels: 1"):
        mf.enforce(fe.training_guards(rows))
    mf.enforce(fe.training_guards(records(spark, [{"row_id": 1}])))


def test_versions_and_published_ids(spark, tmp_path):
    before = records(spark, [{"row_id": 1, "text": "க" * 400}, {"row_id": 2}, {"row_id": 3, "split": "dev", "speaker_id": "2"}])
    gone, after = fe.corrupt(before), fe.curated(before)
    document = mf.metadata(after, gone, "d", "v002", "v001", kept=spark.createDataFrame([("char", "u2")], "variant string, utterance_id string"), license="public", ratios={"train": 0.9})
    held = json.loads(document.first().json)
    assert held["license"] == "public" and held["ratios"] == {"train": 0.9} and held["speakers"] == {"dev": ["2"], "train": ["0000001"]}
    assert [r["utterance_id"] for r in held["changes"]["removed"]] == ["u1"] and held["changes"]["kept_fast_speech"] == {"char": ["u2"]}
    short = json.loads(mf.metadata(after, gone, "d", "v002", "v001", most=1).first().json)
    assert "speakers" not in short and short["changes"]["removed_utterances"] == 1
    published = after.select("utterance_id").limit(1)
    assert failed(mf.version_checks(before, after, gone, document, "v002", "v001", published=published)) == {}
    wrong = mf.version_checks(before, after.where("row_id <> 3"), gone, document, "v003", "v000", published=before.where("row_id = 1"))
    assert failed(wrong) == {
        "nothing but the named rows is gone": 1, "the document declares the version": 1, "the document names the version before": 1, "the document counts the rows of dev": 1,
        "the document sums the hours of dev": 1, "the document counts the speakers of dev": 1, "published ids are in the version": 1, "published ids were not removed": 1,
    }
    path = mf.write_version(after, str(tmp_path), "v002", document, gone)
    assert spark.read.parquet(f"{path}/rows").count() == 2 and spark.read.parquet(f"{path}/removed").count() == 1 and spark.read.parquet(f"{path}/speakers").count() == 2
    jsonl.write_document(mf.published_checks(published, after, gone), f"{tmp_path}/results.json")
    assert [r["ok"] for r in json.loads((tmp_path / "results.json").read_text())] == [True, True]


def test_budget_of_one_length_that_most_rows_have(spark):
    rows = [{"row_id": i, "duration_seconds": 1.0 if i % 4 else 2.0 + i / 1000} for i in range(400)] + [{"row_id": 900, "duration_seconds": 0.25}]
    for most in (0.1, 0.25, 1.0, 100.0, 299.0, 301.0, 5000.0):
        order, want, run = sorted(rows, key=lambda r: (r["duration_seconds"], r["row_id"])), [], 0
        for r in order:
            if run >= round(most * 1e6):
                break
            run += round(r["duration_seconds"] * 1e6)
            want.append((r["row_id"], run))
        got = mf.budget(records(spark, rows).repartition(5), "row_id", "duration_seconds", most)
        assert sorted((x.row_id, x.until) for x in got.collect()) == sorted(want)
    assert mf.budget(records(spark, []), "row_id", "duration_seconds", 9.0).count() == 0


def test_agreement_of_segments(spark):
    shape = "utt string, start double, end double"
    found = spark.createDataFrame([("a", 0.9, 2.0), ("a", 1.5, 2.2), ("b", 0.0, 1.0), ("d", 3.0, 3.0)], shape)
    truth = spark.createDataFrame([("a", 1.0, 2.0), ("c", 0.0, 1.0)], shape)
    got = {r.utt: (round(r.coverage, 4), round(r.leakage, 4), round(r.beyond, 4)) for r in fr.agreement(found, truth, 0.1, 1000).collect()}
    assert got == {"a": (1.0, round(0.3 / 1.3, 4), round(0.1 / 1.3, 4)), "b": (0.0, 1.0, 1.0), "c": (0.0, 1.0, 1.0), "d": (0.0, 1.0, 1.0)}
    one = spark.createDataFrame([(0.0, 1.0, 1.0, 2.0), (0.0, 1.0, 1.05, 2.0)], "a double, b double, c double, d double")
    assert [tuple(r) for r in one.select(fr.touching(F.col("a"), F.col("b"), F.col("c"), F.col("d")), fr.touching(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0.1)).collect()] == [(True, True), (False, True)]
    assert [round(r[0], 3) for r in spark.range(3).select(fr.frame_times(F.col("id"), 160, 16_000)).collect()] == [0.0, 0.01, 0.02]


def test_vocabularies(spark):
    texts = spark.createDataFrame([(1, "b a b", "train"), (2, "c a", "dev"), (3, None, "dev"), (4, "", "dev")], "row_id long, text string, split string")
    vocab = vo.vocabulary(texts.where("row_id = 1"))
    got = {r.row_id: (r.ids, r.unknown, r.unknown_symbols) for r in vo.encode(texts, vocab).collect()}
    assert got == {1: ([3, 2, 4, 2, 3], 0, []), 2: ([1, 2, 4], 1, ["c"]), 3: (None, None, None), 4: ([], 0, [])}
    back = vo.encode(texts, vocab).select("row_id", vo.decode(F.col("ids"), vocab, "?").alias("t"))
    assert {r.row_id: r.t for r in back.collect()} == {1: "b a b", 2: "? a", 3: None, 4: ""}
    with pytest.raises(Exception, match="no symbol has id 9"):
        spark.createDataFrame([([9],)], "ids array<int>").select(vo.decode(F.col("ids"), vocab)).collect()
    for rows in ([(2, "ab", 1)], [(2, "a", 1), (3, "a", 1)], [(3, "a", 1)]):
        with pytest.raises(ValueError):
            vo.held_symbols(spark.createDataFrame(rows, "id long, symbol string, count long"))
    words = spark.createDataFrame([(1, "z y"), (2, "x y z"), (3, "w")], "row_id long, text string")
    assert [r.word for r in vo.word_ranks(words, "first").orderBy("rank").collect()] == ["z", "y", "x", "w"]
    assert [r.word for r in vo.word_ranks(words).orderBy("rank").collect()] == ["y", "z", "w", "x"]
    assert sorted(tuple(r) for r in vo.word_ids(vo.word_ranks(words)).collect()) == [(1, "y"), (2, "z"), (3, "w"), (4, "x"), (5, "<unk>")]
    assert [r[0] for r in spark.createDataFrame([("\u00e9",), ("e\u0301",), (None,)], "t string").select(vo.is_normalized(F.col("t"))).collect()] == [True, False, None]
    audit = {r.form: r for r in vo.normal_form_audit(spark.createDataFrame([("e\u0301",), ("x",)], "text string")).collect()}
    assert (audit["NFC"].changed, audit["NFC"].distinct_raw, audit["NFC"].distinct_characters, audit["NFD"].already) == (1, 3, 2, True)
    with pytest.raises(ValueError):
        vo.word_ranks(words, "other")


def test_tokenizer_settings_are_kept(spark, tmp_path):
    vocab, path = vo.vocabulary(spark.createDataFrame([("aab",)], "text string")), f"{tmp_path}/t.json"
    jsonl.save_tokenizer(vocab, path, TokenizerConfig("NFKC", False, 3, 40))
    assert jsonl.tokenizer_config(path) == TokenizerConfig("NFKC", False, 3, 40)
    (tmp_path / "t.json").write_text(json.dumps({"config": {"other": 1, "min_frequency": 2}}))
    assert jsonl.tokenizer_config(path) == TokenizerConfig(min_frequency=2)
    jsonl.write_words(spark.createDataFrame([("b", 2), ("a", 1)], "word string, rank long"), str(tmp_path), top=1)
    assert [r.value for r in spark.read.text(f"{tmp_path}/subset_vocab").collect()] == ["a"]


def test_settings_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("rate: 16000\nnames: [x, 'ய']\nnested:\n  deep: true\n", encoding="utf-8")
    (tmp_path / "empty").write_text("")
    (tmp_path / "list").write_text("- 1\n")
    assert settings.read_settings(spark, tmp_path / "a") == {"rate": 16000, "names": ["x", "ய"], "nested": {"deep": True}} == settings.read_settings(spark, f"{tmp_path}/a.yaml")
    assert settings.read_settings(spark, tmp_path / "empty") == {}
    with pytest.raises(TypeError):
        settings.read_settings(spark, tmp_path / "list")
    with pytest.raises(FileNotFoundError, match=str(tmp_path)):
        settings.read_settings(spark, tmp_path / "none")


def test_headers_are_read_without_samples(spark, tmp_path, monkeypatch):
    body = struct.pack("<HHIIHH", 1, 2, 8000, 32_000, 4, 16)
    data = b"RIFF" + struct.pack("<I", 99) + b"WAVE" + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + b"fmt " + struct.pack("<I", 16) + body + b"data" + struct.pack("<I", 4000) + b"\0" * 4000
    (tmp_path / "x/y/z").mkdir(parents=True)
    (tmp_path / "x/y/z/deep.wav").write_bytes(data)
    (tmp_path / "cut.wav").write_bytes(data[:-1000])
    (tmp_path / "note.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[-1]: r for r in wav.read_headers(spark, str(tmp_path)).collect()}
    assert set(got) == {"deep.wav", "cut.wav"}
    assert (got["deep.wav"].frames, got["deep.wav"].duration, got["deep.wav"].format, got["deep.wav"].subtype) == (1000, 0.125, "WAV", "PCM_16") and got["cut.wav"].frames == 750
    assert {r.name for r in files.list_files(spark, [str(tmp_path)], ".wav").collect()} == {"cut.wav"}

    class Counting:
        def __init__(self, raw):
            self.raw, self.at, self.seen = raw, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            held = self.raw[self.at : self.at + n]
            self.at, self.seen = self.at + n, self.seen + len(held)
            return held

    file = Counting(data)
    assert wav.probe(file, len(data))["frames"] == 1000 and file.seen < 60


def test_model_lengths_and_examples(spark):
    made = network.Network(network.Shape(mels=4, classes=3, layers=((5, 3, 2, 1), (5, 3, 2, 1)), hidden=4))
    network.verify_lengths(made, list(range(1, 30)))
    with pytest.raises(network.LengthError, match="no lengths"):
        network.verify_lengths(made, [])
    made.logits = lambda x: np.zeros((len(x), 3))
    with pytest.raises(network.LengthError, match="of 9 frames 3 should be left, the layers leave 9"):
        network.verify_lengths(made, [9])
    features = spark.createDataFrame([(i, [[float(i)] * 2] * n) for i, n in ((1, 3), (2, 1), (3, 2), (4, 0))], "utt long, mels array<array<float>>")
    encoded = spark.createDataFrame([(1, [5]), (2, [6, 7]), (3, [8]), (4, [9])], "utt long, ids array<int>")
    rows = {r.utt: r for r in network.collated(network.examples(features, encoded), 2, 2).collect()}
    assert {k: (r.batch, len(r.mels), r.frames, r.labels, r.label_count) for k, r in rows.items()} == {2: (0, 2, 1, [6, 7], 2), 3: (0, 2, 2, [8, 0], 1), 1: (1, 3, 3, [5], 1)}
    assert rows[2].mels == [[2.0, 2.0], [0.0, 0.0]]
    lengths = spark.createDataFrame([(n,) for n in [*range(1, 31), 5, 5]], "frames int")
    assert sorted(r.frames for r in fe.length_probe(lengths).collect()) == [1, 2, 3, 4, 5, 6, 25, 26, 27, 28, 29, 30]
    assert sorted(r.frames for r in fe.length_probe(lengths.where("frames < 5")).collect()) == [1, 2, 3, 4]


def test_accepted_runs(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.11, 0.5), (0.05, 1.1), (None, 0.5)], "e double, l double")
    assert [r[0] for r in df.select(de.accepted(F.col("e"), F.col("l"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(de.accepted(F.col("e"))).collect()] == [True, False, True, False]
