import hashlib
import json

import numpy as np
import pytest
from corpusloom.operators import vocabulary as vo
from corpusloom.sources import corpus, jsonl, wav
from corpusloom.streaming import windows
from pyspark.sql import functions as F


def make_corpus(root):
    for split, stems in (("train", ["MILE_0000001_0000002", "MILE_0000001_0000001"]), ("test", ["ISTL_0000000_0000001"])):
        for kind in ("audio_files", "trans_files"):
            (root / split / kind).mkdir(parents=True)
        for s in stems:
            (root / split / "audio_files" / f"{s}.wav").write_bytes(wav.encode(np.zeros(8000, np.float32), 16_000))
            (root / split / "trans_files" / f"{s}.txt").write_text("\n  வணக்கம்  \n", encoding="utf-8")


def test_corpus_folder_to_manifest(spark, tmp_path):
    make_corpus(tmp_path / "raw")
    found = corpus.discover(spark, f"{tmp_path}/raw").collect()
    assert [r.utterance_id for r in found] == ["MILE_0000001_0000001", "MILE_0000001_0000002", "ISTL_0000000_0000001"]
    rows = corpus.build_records(spark, f"{tmp_path}/raw", "d", str(tmp_path)).collect()
    assert [(r.utterance_id, r.duration_seconds, r.text, r.speaker_id) for r in rows][0] == ("ISTL_0000000_0000001", 0.5, "வணக்கம்", "0000000")
    assert rows[0].audio_path == "raw/test/audio_files/ISTL_0000000_0000001.wav"
    sums = {r.path.split("/")[-1]: r.sha256 for r in wav.checksums(spark, f"{tmp_path}/raw").collect()}
    assert sums["ISTL_0000000_0000001.wav"] == hashlib.sha256((tmp_path / "raw/test/audio_files/ISTL_0000000_0000001.wav").read_bytes()).hexdigest()
    (tmp_path / "raw/test/trans_files/ISTL_0000000_0000001.txt").write_bytes(b"")
    assert corpus.build_records(spark, f"{tmp_path}/raw", "d", str(tmp_path)).first().text == ""
    (tmp_path / "raw/test/trans_files/ISTL_0000000_0000001.txt").unlink()
    with pytest.raises(Exception, match="no transcript"):
        corpus.discover(spark, f"{tmp_path}/raw").collect()


def test_bad_transcripts_raise(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe\x00\x00")
    with pytest.raises(Exception, match="(?i)utf"):
        corpus.read_transcripts(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("stem", ["", "MILE", "MILE_123", "MILE_abc_0000000", "MILE_0000000_0000001.wav", "0000000_1_2"])
def test_bad_stems(spark, stem):
    df = spark.createDataFrame([(stem,)], "s string")
    assert df.select(corpus.parse_stem(F.col("s"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="no corpus stem"):
        df.select(corpus.parse_stem(F.col("s"))).collect()


@pytest.mark.parametrize(("kind", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_wav_kinds(kind, bits):
    import struct

    x = np.array([0.0, 0.5, -0.5, 0.25])
    if kind == 3:
        raw = x.astype("<f4" if bits == 32 else "<f8").tobytes()
    elif bits == 8:
        raw = (x * 128 + 128).astype(np.uint8).tobytes()
    else:
        raw = b"".join(int(v * 2 ** (bits - 1)).to_bytes(bits // 8, "little", signed=True) for v in x)
    data = b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, 2, 8000, 8000 * bits // 4, bits // 4, bits) + b"data" + struct.pack("<I", len(raw)) + raw
    got, rate = wav.decode(data)
    assert rate == 8000 and got.shape == (2, 2) and np.allclose(got.ravel(), x, atol=0.01)


def test_clips_and_errors(spark, tmp_path):
    (tmp_path / "ok.wav").write_bytes(wav.encode(np.array([[1.0, 0.0], [0.5, 0.5]]), 16_000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF no wave")
    (tmp_path / "empty.wav").write_bytes(b"")
    got = {r.path.split("/")[-1]: r for r in wav.read_clips(spark, str(tmp_path)).collect()}
    assert list(got["ok.wav"].samples) == [0.5, 0.5] and got["bad.wav"].error and got["empty.wav"].error
    heads = {r.path.split("/")[-1]: r for r in wav.read_headers(spark, str(tmp_path)).collect()}
    assert heads["ok.wav"].frames == 2 and heads["ok.wav"].channels == 2 and heads["bad.wav"].duration is None
    assert sorted(wav.read_clips(spark, str(tmp_path), mono=False).where("error is null").first().samples) == [0.0, 0.5, 0.5, 1.0]


def test_manifest_round_trip(spark, tmp_path):
    line = {"utterance_id": "a", "audio_path": "p", "text": "தமிழ்", "speaker_id": "0000001", "prefix": "MILE", "shipped_split": "train", "duration_seconds": 0.242688, "sample_rate": 16000, "dataset_id": "d"}
    (tmp_path / "in.jsonl").write_text(json.dumps(line, ensure_ascii=False) + "\n\n" + json.dumps(line | {"utterance_id": "b", "text": ""}) + "\n", encoding="utf-8")
    rows = jsonl.read_manifest(spark, f"{tmp_path}/in.jsonl")
    assert rows.count() == 2 and jsonl.write_manifest(rows.withColumn("split", F.lit("dev")), f"{tmp_path}/out") == 2
    back = jsonl.read_manifest(spark, f"{tmp_path}/out/split=dev")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert "தமிழ்" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out/split=dev").glob("*.json"))
    assert {r.text for r in jsonl.read_texts(spark, f"{tmp_path}/in.jsonl").collect()} == {"தமிழ்", ""}
    assert jsonl.read_texts(spark, f"{tmp_path}/in.jsonl", limit=1).count() == 1
    with pytest.raises(Exception, match="no field"):
        jsonl.read_texts(spark, f"{tmp_path}/in.jsonl", "other").collect()
    (tmp_path / "bad.jsonl").write_text("{not json}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_manifest(spark, f"{tmp_path}/bad.jsonl").collect()
    assert jsonl.read_manifest(spark, f"{tmp_path}/bad.jsonl", strict=False).first()["_corrupt_record"] == "{not json}"


def test_tokenizer_artifact(spark, tmp_path):
    vocab = vo.vocabulary(spark.createDataFrame([("aab",), ("c b",)], "text string"))
    path = f"{tmp_path}/t.json"
    jsonl.save_tokenizer(vocab, path)
    assert sorted(map(tuple, jsonl.load_tokenizer(spark, path).collect())) == sorted(map(tuple, vocab.select("id", "symbol", "count").collect()))
    assert jsonl.read_document(spark, path).first()["kind"] == "character"
    held = json.loads((tmp_path / "t.json").read_text())
    for change in ({"kind": "word"}, {"unk_id": 5}, {"symbols": ["<blank>", "<unk>", "a", "a"]}):
        (tmp_path / "t.json").write_text(json.dumps(held | change))
        with pytest.raises(ValueError):
            jsonl.load_tokenizer(spark, path)


def test_windows_over_a_stream(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 2, "a" if i % 3 else "b", float(i)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/in")
    batch = windows.windowed(spark.read.parquet(f"{tmp_path}/in"))
    stream = windows.windowed(spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect())) and batch.count() > 5
    assert windows.sessions(spark.read.parquet(f"{tmp_path}/in"), "10 minutes").agg(F.sum("events")).first()[0] == 60


def test_settled_tables_are_shared_and_swept(spark):
    from pathlib import Path

    from corpusloom import session

    df = session.settle(spark.range(5), "t")
    folder = Path(session._WRITTEN[-1].removeprefix("file:"))
    assert df.count() == 5 and folder.exists() and session.shared_folder(spark).rstrip("/") in session._WRITTEN[-1]
    assert session.sweep(spark) >= 1 and not folder.exists()
