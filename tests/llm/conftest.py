import datetime as dt

import pytest

MANIFEST = "row_id long, utterance_id string, audio_path string, text string, speaker_id string, prefix string, shipped_split string, duration_seconds double, sample_rate int, dataset_id string, delivery int, recorded_at timestamp"


@pytest.fixture(scope="session")
def manifest(spark):
    """Makes a manifest from dicts; a column that isn't given is null. ``extra`` adds columns whose names may clash."""

    def make(rows, extra=()):
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MANIFEST)
        for c in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def stamp():
    return dt.datetime(2024, 1, 1)
