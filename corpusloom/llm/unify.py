"""Texts that look the same made the same string.

Characters are composed and invisible ones dropped for all rows; words written in several scripts are then repaired by
substituting look-alikes so that one script remains. Which script is settled by the collection: of the possible readings
the first that occurs as a word elsewhere is taken, else that of the word's dominant script.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import textform as tf
from corpusloom.session import settle

#: what separates words, for Java's expressions
BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def _fold_rows(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_alike = table.value
        for batch in batches:
            forms, mixed, kept = [], [], []
            for text in batch.column(1).to_pylist():
                found: list[str] = []

                def word(w: str, found: list[str] = found) -> str:
                    w = tf._tamil_signs(w)
                    if tf.readings(w, look_alike):
                        found.append(w)
                    return w

                form = tf.consistent(text, word, every=True)
                forms.append(form)
                mixed.append(found)
                kept.append(text if found else None)
            yield pa.record_batch(
                {
                    "row_id": batch.column(0), "form": pa.array(forms, pa.string()), "mixed": pa.array(mixed, pa.list_(pa.string())),
                    "text": pa.array(kept, pa.string()), "needed": pa.array([f is not None and f != t for f, t in zip(forms, batch.column(1).to_pylist(), strict=True)]),
                }
            )

    return run


def _read_words(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ranks, made = [], [], []
            for w in batch.column(0).to_pylist():
                for rank, reading in enumerate(tf.readings(w, table.value)):
                    words.append(w), ranks.append(rank), made.append(reading)
            yield pa.record_batch({"word": pa.array(words, pa.string()), "rank": pa.array(ranks, pa.int32()), "reading": pa.array(made, pa.string())})

    return run


def _apply_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, needed = [], []
        for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            chosen = {p["word"]: p["reading"] for p in pairs}

            def word(w: str, chosen: dict[str, str] = chosen) -> str:
                w = tf._tamil_signs(w)
                return chosen.get(w, w)

            forms.append(tf.consistent(text, word, every=True))
            needed.append(forms[-1] != text)
        yield pa.record_batch({"row_id": batch.column(0), "form": pa.array(forms, pa.string()), "needed": pa.array(needed), "known": batch.column(3), "repaired": batch.column(4)})


def choose_readings(mixed_words: DataFrame, forms: DataFrame, table: Broadcast) -> DataFrame:
    """(word, reading, known): for each word of several scripts the reading to take, and whether it's in the vocabulary.

    mixed_words: (word); forms: (form), whose words of one script are the vocabulary; table: the look-alikes.
    """
    options = mixed_words.select("word").distinct().mapInArrow(_read_words(table), "word string, rank int, reading string")
    options = settle(options, "readings")
    asked = options.select(F.col("reading").alias("token")).distinct()
    tokens = forms.select(F.explode(F.split("form", BETWEEN_WORDS)).alias("token"))
    vocabulary = tokens.join(asked, "token", "left_semi").distinct().withColumn("known", F.lit(True))
    held = options.join(vocabulary, options["reading"] == vocabulary["token"], "left")
    order = F.struct(F.col("known").isNull(), F.col("rank"))
    return held.groupBy("word").agg(F.min_by("reading", order).alias("reading"), F.coalesce(F.max("known"), F.lit(False)).alias("known"))


def unify_texts(rows: DataFrame, key: str = "row_id", text: str = "text", only_known: bool = False) -> DataFrame:
    """(row_id, form, needed, repaired, known): the consistent form of each text and whether it differs from the text.

    Look-alikes are those of Unicode's security data for all scripts. repaired counts the words of several scripts that
    were rewritten, known those whose reading the vocabulary holds; with ``only_known`` no other is rewritten. A null text
    has a null form and needs nothing; an empty text is its own form. The number of blanks stays.
    """
    spark = rows.sparkSession
    table = spark.sparkContext.broadcast(tf.confusables(spark._jvm))  # some thousand letters
    rows = rows.select(F.col(key).alias("row_id"), F.col(text).alias("text"))
    schema = "row_id long, form string, mixed array<string>, text string, needed boolean"
    folded = settle(rows.mapInArrow(_fold_rows(table), schema), "folded")
    plain = folded.where("size(mixed) = 0").select("row_id", "form", "needed", F.lit(0).alias("repaired"), F.lit(0).alias("known"))
    odd = folded.where("size(mixed) > 0")
    words = odd.select("row_id", F.explode("mixed").alias("word"))
    chosen = choose_readings(words, folded.where("form is not null"), table)
    if only_known:
        chosen = chosen.withColumn("reading", F.when(F.col("known"), F.col("reading")).otherwise(F.col("word")))
    pairs = words.distinct().join(chosen, "word").groupBy("row_id").agg(
        F.collect_list(F.struct("word", "reading")).alias("pairs"), F.sum(F.col("known").cast("int")).cast("int").alias("known"), F.count_if(F.col("reading") != F.col("word")).cast("int").alias("repaired")
    )
    changed = odd.select("row_id", "text").join(pairs, "row_id").select("row_id", "text", "pairs", "known", "repaired")
    changed = changed.mapInArrow(_apply_words, "row_id long, form string, needed boolean, known int, repaired int")
    return plain.unionByName(changed)
