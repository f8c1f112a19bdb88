"""Queries that write tables in the formats of a corpus and read them back, with SQL on what went in."""

import json

from corpusloom.config import TokenizerConfig
from corpusloom.operators import feasibility as fe
from corpusloom.operators import manifest as mf
from corpusloom.operators import vocabulary as vo
from corpusloom.plans.common import RECORDS, UNSPACED, WORDS, clips, records
from corpusloom.plans.registry import Registry, table
from corpusloom.plans.text_queries import VOCAB
from corpusloom.session import working_path
from corpusloom.sources import corpus, files, jsonl, wav
from pyspark.sql import functions as F

REGISTRY = Registry()
add = REGISTRY.add
WITH = f"with {RECORDS}"
#: Embeddings as recordings of speakers of ten, every tenth in the test split
NAME = "EMB_' || lpad(cast(vec_id // 10 as varchar), 7, '0') || '_' || lpad(cast(vec_id as varchar), 7, '0')"


def _corpus(spark, folder):
    """A corpus folder with a recording and a transcript for each embedding."""
    root = working_path(spark, "corpus")
    rows = clips(spark, folder)
    pad = lambda c: F.lpad(c.cast("string"), 7, "0")
    stem = F.concat(F.lit("EMB_"), pad(F.floor(F.col("utt") / 10)), F.lit("_"), pad(F.col("utt")))
    split = F.when(F.col("utt") % 10 == 0, "test").otherwise("train")
    wav.write_clips(rows.select(F.concat(split, F.lit("/audio_files/"), stem, F.lit(".wav")).alias("name"), "samples", "sample_rate"), root)
    texts = F.concat(F.lit(" உரை "), F.col("utt").cast("string"), F.lit("\n")).cast("binary")
    files.write_files(rows.select(F.concat(split, F.lit("/trans_files/"), stem, F.lit(".txt")).alias("name"), texts.alias("content")), root)
    return root.replace("file:", "", 1) if root.startswith("file:/") else root


@add("wav_headers", f"select '{NAME} as stem, 16000 as sample_rate, 1 as channels, cast(len(embedding) as bigint) as frames, len(embedding) / 16000 as duration, 'WAV' as format, 'FLOAT' as subtype from embeddings")
def wav_headers(spark, folder):
    heads = wav.read_headers(spark, _corpus(spark, folder)).where("error is null")
    return heads.select(F.regexp_extract("path", "([^/]+)[.]wav$", 1).alias("stem"), "sample_rate", "channels", "frames", "duration", "format", "subtype")


@add("wav_samples", f"with x as (select '{NAME} as stem, unnest(range(0, len(embedding))) as i, unnest(embedding) as v from embeddings) select stem, cast(i as integer) as i, v::double as sample from x")
def wav_samples(spark, folder):
    held = wav.read_clips(spark, _corpus(spark, folder)).where("error is null")
    return held.select(F.regexp_extract("path", "([^/]+)[.]wav$", 1).alias("stem"), F.posexplode("samples").alias("i", "v")).select("stem", "i", F.col("v").cast("double").alias("sample"))


@add("corpus_discovery", f"select '{NAME} as utterance_id, lpad(cast(vec_id // 10 as varchar), 7, '0') as speaker_id, 'EMB' as prefix, case when vec_id % 10 = 0 then 'test' else 'train' end as shipped_split from embeddings")
def corpus_discovery(spark, folder):
    return corpus.discover(spark, _corpus(spark, folder)).select("utterance_id", "speaker_id", "prefix", "shipped_split")


@add(
    "corpus_records",
    f"""with r as (select '{NAME} as utterance_id, case when vec_id % 10 = 0 then 'test' else 'train' end as shipped_split, vec_id, len(embedding) as n from embeddings)
  select utterance_id, shipped_split || '/audio_files/' || utterance_id || '.wav' as audio_path, 'உரை ' || vec_id as text, lpad(cast(vec_id // 10 as varchar), 7, '0') as speaker_id, 'EMB' as prefix, shipped_split,
  round(n / 16000, 6) as duration_seconds, 16000 as sample_rate, 'emb' as dataset_id from r""",
)
def corpus_records(spark, folder):
    root = _corpus(spark, folder)
    return corpus.build_records(spark, root, "emb", root)


SHAPE = "utterance_id, audio_path, text, speaker_id, prefix, shipped_split, duration_seconds, sample_rate, dataset_id"


def _written(spark, folder):
    path = working_path(spark, "manifest")
    rows = records(spark, folder)
    jsonl.write_manifest(rows.withColumn("shipped_split", F.col("split")).select(*SHAPE.split(", "), "split"), path)
    return path


@add("manifest_round_trip", f"{WITH} select utterance_id, audio_path, text, speaker_id, prefix, split as shipped_split, duration_seconds, sample_rate, dataset_id from records")
def manifest_round_trip(spark, folder):
    return jsonl.read_manifest(spark, _written(spark, folder)).select(*SHAPE.split(", "))


@add("manifest_texts", f"{WITH} select text from records")
def manifest_texts(spark, folder):
    return jsonl.read_texts(spark, _written(spark, folder))


@add("tokenizer_round_trip", f"{WITH}, {VOCAB} select id, symbol, count, 'NFC' as form, true as include_space from vocab where count >= 100")
def tokenizer_round_trip(spark, folder):
    path = f"{working_path(spark, 'tokenizer')}/tokenizer.json"
    config = TokenizerConfig(min_frequency=100)
    jsonl.save_tokenizer(vo.vocabulary(records(spark, folder).where("split = 'train'"), config), path, config)
    kept = jsonl.tokenizer_config(path)
    return jsonl.load_tokenizer(spark, path).withColumns({"form": F.lit(kept.form), "include_space": F.lit(kept.include_space)})


@add(
    "word_files",
    f"{WITH}, w as (select unnest({WORDS}) as word from records where split = 'train') select word, row_number() over (order by count(*) desc, encode(word)) as id from w group by word",
)
def word_files(spark, folder):
    """The words of a vocabulary and their ids as they are read back from files."""
    path = working_path(spark, "words")
    jsonl.write_words(vo.word_ranks(records(spark, folder).where("split = 'train'")), path, top=1000)
    ids = spark.read.schema("word string, id long").json(f"{path}/token2id")
    listed = spark.read.text(f"{path}/word_vocab").withColumnRenamed("value", "word")
    return ids.join(listed, "word", "left_semi")


@add(
    "metadata_round_trip",
    f"""{WITH}, rate as (select row_id, greatest(1, cast(ceil((1 + cast(floor(floor(duration_seconds * 16000 + 0.5) / 160) as bigint)) / 4.0) as bigint)) as have, length({UNSPACED}) as labels, duration_seconds as d from records),
  gone as (select row_id from rate where have < labels and labels / d >= 60), kept as (select * from records where row_id not in (select row_id from gone))
  select split, count(*) as utterances, count(distinct speaker_id) as speakers, count(*) filter (where text = '') as empty_transcripts, min(duration_seconds) as shortest, max(duration_seconds) as longest,
  (select count(*) from gone) as removed from kept group by split""",
)
def metadata_round_trip(spark, folder):
    """The document of a version as it is read back from the version's folder."""
    base, rows = working_path(spark, "versions"), records(spark, folder)
    gone, after = fe.corrupt(rows), fe.curated(rows)
    path = mf.write_version(after, base, "v002", mf.metadata(after, gone, "corpus", "v002", "v001"), gone)
    text = "\n".join(r.value for r in spark.read.text(f"{path}/metadata", wholetext=True).collect())  # one document
    held = json.loads(text)
    made = [(s, v["utterances"], v["speakers"], v["empty_transcripts"], v["duration_seconds"]["min"], v["duration_seconds"]["max"], held["changes"]["removed_utterances"]) for s, v in held["splits"].items()]
    return spark.createDataFrame(made, "split string, utterances long, speakers long, empty_transcripts long, shortest double, longest double, removed long")


@add("version_rows", f"{WITH} select split, speaker_id, count(*) as utterances from records group by all")
def version_rows(spark, folder):
    """Speakers of each split as the tables of a written version have them."""
    base, rows = working_path(spark, "versions"), records(spark, folder)
    path = mf.write_version(rows, base, "v001", removed=fe.corrupt(rows).where("false"))
    return spark.read.parquet(f"{path}/speakers").join(spark.read.parquet(f"{path}/rows").select("split").distinct(), "split", "left_semi")
