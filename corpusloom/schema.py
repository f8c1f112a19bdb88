"""Schemas and constants of the data model."""

from pyspark.sql import types as T

SAMPLE_RATE, HOP, FRAME, N_FFT, N_MELS = 16_000, 160, 400, 512, 80
SPLITS = ("train", "dev", "test")
BLANK, UNKNOWN = 0, 1

MANIFEST = T.StructType(
    [
        T.StructField("utterance_id", T.StringType(), False), T.StructField("audio_path", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("speaker_id", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("shipped_split", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("dataset_id", T.StringType()),
    ]
)
