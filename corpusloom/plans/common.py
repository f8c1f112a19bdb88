"""What several query modules share: logical tables over the driver's folders, and the same tables in SQL."""

from corpusloom.functions import ids
from corpusloom.operators import manifest
from corpusloom.plans.registry import table
from pyspark.sql import functions as F

#: Python's white space, for DuckDB's expressions
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STEM = r"^\s*[A-Za-z]+[^A-Za-z0-9]+"
SPEAKER = rf"""coalesce(try_cast(nullif(regexp_extract(speaker_id, '([0-9]+)', 1), '') as bigint),
  try_cast(nullif(regexp_extract(utterance_id, '{STEM}([0-9]+)[^A-Za-z0-9]+[0-9]+', 1), '') as bigint))"""
RECORDS = rf"""records as (select row_id, utterance_id, coalesce(text, '') as text, lpad(cast({SPEAKER} as varchar), 7, '0') as speaker_id,
  coalesce(prefix, '') as prefix, lower(regexp_replace(shipped_split, '^\s+|\s+$', '', 'g')) as split, duration_seconds, sample_rate, dataset_id, audio_path, delivery
  from manifest where duration_seconds > 0 and isfinite(duration_seconds) and regexp_replace(shipped_split, '\s', '', 'g') <> '' and {SPEAKER} is not null)"""
WORDS = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')"
CHARS = "regexp_extract_all(text, '(?s).')"
UNSPACED = f"regexp_replace(text, '{SPACE}', '', 'g')"
PREPARED = f"trim(regexp_replace(nfc_normalize(text), '{SPACE}+', ' ', 'g'))"


def records(spark, folder):
    return manifest.records(table(spark, folder, "manifest"))


def clips(spark, folder):
    """Embeddings as clips of 64 samples."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("utt"), F.col("embedding").alias("samples"), F.lit(16_000).alias("sample_rate"))


def speech(spark, folder):
    """Events as frames: a user's events in order of time, their values as energies."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(F.col("user_id").alias("utt"), (F.row_number().over(w) - 1).alias("frame"), F.col("value").alias("energy"))


FRAMES = "frames as (select user_id as utt, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame, value as energy from events)"


def parts(spark, folder):
    """VAD segments in whole milliseconds, ends in order, repeated rows once; segments without an end are left out."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = table(spark, folder, "vad_segments").where("seg_start is not null and seg_end is not null")
    rows = rows.select(ids.utterance_key(F.col("utterance_id")).alias("utt"), F.least(ms("seg_start"), ms("seg_end")).alias("start"), F.greatest(ms("seg_start"), ms("seg_end")).alias("end"))
    return rows.where("utt is not null").distinct()


PARTS = r"""parts as (select distinct utt, least(a, b) as s, greatest(a, b) as e from (select utterance_id as utt,
  cast(round(seg_start * 1000) as bigint) as a, cast(round(seg_end * 1000) as bigint) as b from vad_segments) where a is not null and b is not null)"""
