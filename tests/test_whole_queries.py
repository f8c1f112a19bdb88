import random

from corpusloom.operators.decode import edit_distance
from corpusloom.plans import corpus_queries, text_queries

MANIFEST = "row_id long, utterance_id string, audio_path string, text string, speaker_id string, prefix string, shipped_split string, duration_seconds double, sample_rate int, dataset_id string, delivery int"


def folder_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, MANIFEST).write.parquet(f"{tmp_path}/manifest.parquet")
    return str(tmp_path)


def test_token_error_rate_takes_whole_transcripts(spark, tmp_path):
    r = random.Random(2)
    texts = ["".join(r.choice("கசடத பறய a1") for _ in range(r.randrange(0, 40))) for _ in range(30)]
    rows = [(i, f"AB_1_{i // 3}", None, t, "0000001", "AB", "train", 2.0, 16_000, "d", 1) for i, t in enumerate(texts)]
    pairs = [(texts[i], texts[i + 1]) for i in range(29) if i // 3 == (i + 1) // 3]
    got = text_queries.token_error_rate(spark, folder_of(spark, tmp_path, rows)).collect()
    assert [tuple(x) for x in got] == [(20, sum(edit_distance(list(a), list(b)) for a, b in pairs), sum(len(a) for a, _ in pairs))]


def test_relative_path_of_every_row(spark, tmp_path):
    paths = ["raw/train/a.wav", "raw\\train\\b.wav", "C:\\x\\c.wav", "/abs/d.wav", "raw\\e/f.wav", None]
    rows = [(i, f"AB_1_{i}", p, "x", "1", "AB", "train", 2.0, 16_000, "d", 1) for i, p in enumerate(paths)]
    want = {(i, p and p.replace("\\", "/").removeprefix("raw/"), p and p.replace("\\", "/").split("/")[-1]) for i, p in enumerate(paths)}
    assert {tuple(x) for x in corpus_queries.relative_path(spark, folder_of(spark, tmp_path, rows)).collect()} == want
