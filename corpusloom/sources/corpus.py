"""Corpus folders: recordings and transcripts of the splits a corpus was shipped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.sources import files

#: prefix, speaker and utterance of a file's stem
STEM = r"^([A-Za-z]+)_([0-9]+)_([0-9]+)$"


def parse_stem(stem: Column, strict: bool = True) -> Column:
    """struct(prefix, speaker_id, utterance) of a stem; another shape raises, or is null with strict=False."""
    part = lambda k: F.regexp_extract(stem, STEM, k)
    made = F.struct(part(1).alias("prefix"), part(2).alias("speaker_id"), part(3).alias("utterance"))
    bad = F.raise_error(F.concat(F.lit("no corpus stem: "), F.coalesce(stem, F.lit("null")))) if strict else F.lit(None)
    return F.when(stem.rlike(STEM), made).otherwise(bad)


def relative(path: Column, root: str) -> Column:
    """The path below root with forward slashes; a path elsewhere as it is."""
    slashed = F.regexp_replace(path, r"\\", "/")
    top = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(top)), F.substring(slashed, len(top) + 1, 1 << 30)).otherwise(slashed)


#: The splits a corpus is shipped in, in the order of the result (fixed values).
SHIPPED = ("train", "test")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(utterance_id, speaker_id, prefix, shipped_split, audio_path, text_path), train before test, then by stem.

    Only names are read. A missing folder, a recording without transcript and a stem of another shape raise; a transcript
    without recording is left out. Both splits must hold recordings, or ValueError is raised.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "").alias("utterance_id")
    split = F.element_at(F.split("path", "/"), -3).alias("shipped_split")
    wav = files.list_files(spark, [f"{root}/{s}/audio_files" for s in SHIPPED], ".wav").select(stem, split, F.col("path").alias("audio_path"))
    txt = files.list_files(spark, [f"{root}/{s}/trans_files" for s in SHIPPED], ".txt").select(stem, split, F.col("path").alias("text_path"))
    missing = set(SHIPPED) - {r[0] for r in wav.select("shipped_split").distinct().collect()}
    if missing:
        raise ValueError(f"no recordings in {sorted(missing)}")
    both = wav.join(txt, ["utterance_id", "shipped_split"], "left")
    fail = F.raise_error(F.concat(F.lit("no transcript of "), "utterance_id"))
    both = both.withColumn("text_path", F.when(F.col("text_path").isNotNull(), F.col("text_path")).otherwise(fail))
    both = both.withColumn("s", parse_stem(F.col("utterance_id")))
    out = both.select("utterance_id", "s.speaker_id", "s.prefix", "shipped_split", "audio_path", "text_path")
    return out.orderBy(F.array_position(F.array(*map(F.lit, SHIPPED)), F.col("shipped_split")), "utterance_id")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files that aren't empty, outer white space removed; bytes that aren't UTF-8 raise."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return raw.select(files.plain(F.col("path")).alias("path"), tx.strip(F.validate_utf8(F.col("content").cast("string"))).alias("text"))


def build_records(spark: SparkSession, root: str, dataset_id: str, data_root: str) -> DataFrame:
    """Manifest records of a corpus folder, by utterance id: headers give durations, files the transcripts."""
    from corpusloom.sources import wav

    found = discover(spark, root)
    heads = wav.read_headers(spark, root).select(F.col("path").alias("audio_path"), "duration", "sample_rate", "error")
    texts = read_transcripts(spark, root).withColumnRenamed("path", "text_path")
    rows = found.join(heads, "audio_path", "left").join(texts, "text_path", "left")
    fail = F.raise_error(F.concat(F.lit("unreadable recording: "), "audio_path", F.lit(": "), F.coalesce("error", F.lit("not found"))))
    seconds = F.when(F.col("duration").isNotNull(), F.round("duration", 6)).otherwise(fail)
    return rows.select(
        "utterance_id", relative(F.col("audio_path"), data_root).alias("audio_path"), F.coalesce("text", F.lit("")).alias("text"), "speaker_id", "prefix", "shipped_split",
        seconds.alias("duration_seconds"), "sample_rate", F.lit(dataset_id).alias("dataset_id"),
    ).orderBy("utterance_id")
