"""Manifests as JSON lines, dataset metadata and tokenizer artifacts as JSON documents."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.config import TokenizerConfig
from corpusloom.sources import files


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of one or more JSON-lines files. Blank lines are skipped; a malformed line raises when it is read, or with
    strict=False gives a row whose ``_corrupt_record`` holds it."""
    shape = schema.MANIFEST if strict else schema.MANIFEST.add("_corrupt_record", "string")
    return spark.read.schema(shape).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_manifest(rows: DataFrame, path: str, sort_keys: bool = False) -> int:
    """One folder a split (``split=train`` and so on) of JSON lines with literal characters; gives the number of rows."""
    from pyspark.sql import Observation

    columns = [c for c in rows.columns if c != "split"]
    seen = Observation()
    rows = rows.select(*(sorted(columns) if sort_keys else columns), "split").observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def read_texts(spark: SparkSession, path: str, field: str = "text", limit: int | None = None) -> DataFrame:
    """Only one field of JSON lines, as column ``text``; a line without it raises when it is read."""
    rows = spark.read.schema(f"`{field}` string").option("mode", "FAILFAST").json(path)
    rows = rows if limit is None else rows.limit(limit)
    missing = F.raise_error(F.lit(f"a line has no field {field}"))
    return rows.select(F.when(F.col(field).isNotNull(), F.col(field)).otherwise(missing).alias("text"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def save_tokenizer(vocab: DataFrame, path: str, config: TokenizerConfig = TokenizerConfig()) -> None:
    """A vocabulary (id, symbol, count) with its settings as one JSON document with sorted keys."""
    rows = sorted((r["id"], r["symbol"], r["count"]) for r in vocab.collect())  # a character inventory
    document = {
        "kind": "character", "config": asdict(config), "blank_id": schema.BLANK, "unk_id": schema.UNKNOWN,
        "size": len(rows) + 2, "real_symbols": len(rows), "counts": {s: n for _, s, n in rows}, "symbols": ["<blank>", "<unk>", *[s for _, s, _ in rows]],
    }
    files.write_bytes(path, (json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def load_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary of a saved tokenizer; another kind, other special ids or repeated symbols raise ValueError."""
    held = json.loads(files.read_bytes(path))
    symbols = held.get("symbols", [])
    if held.get("kind") != "character" or held.get("blank_id") != schema.BLANK or held.get("unk_id") != schema.UNKNOWN:
        raise ValueError("not a character tokenizer")
    if len(set(symbols)) != len(symbols):
        raise ValueError("symbols are repeated")
    rows = [(i, s, held.get("counts", {}).get(s, 0)) for i, s in enumerate(symbols) if i > schema.UNKNOWN]
    return spark.createDataFrame(rows, "id long, symbol string, count long")


def tokenizer_config(path: str) -> TokenizerConfig:
    """The settings of a saved tokenizer; absent ones have their defaults, unknown ones are ignored."""
    held, known = json.loads(files.read_bytes(path)), {f.name for f in fields(TokenizerConfig)}
    return TokenizerConfig(**{k: v for k, v in held.get("config", {}).items() if k in known})


def write_document(rows: DataFrame, path: str) -> None:
    """A table of measurements as one JSON document: an array of its rows. For results of a few rows, as reports are."""
    held = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
    files.write_bytes(path, (json.dumps([json.loads(r[0]) for r in held], ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def write_words(ranks: DataFrame, folder: str, top: int | None = None) -> None:
    """Folders word_vocab (one word a line by rank) and token2id (JSON lines of word and id) of (word, rank); with ``top``
    also subset_vocab, the words up to that rank."""
    sorted_ = ranks.orderBy("rank")
    if top is not None:
        sorted_.where(F.col("rank") <= top).select("word").write.mode("overwrite").text(f"{folder}/subset_vocab")
    sorted_.select("word").write.mode("overwrite").text(f"{folder}/word_vocab")
    sorted_.select(F.to_json(F.struct("word", F.col("rank").alias("id"))).alias("value")).write.mode("overwrite").text(f"{folder}/token2id")
