"""Symbol and word inventories, encoding, and what falls outside a vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.config import TokenizerConfig
from corpusloom.functions import text as tx
from corpusloom.operators.grouped import global_rank

#: Vocabulary sizes of the coverage curve (fixed values).
TOP = (100, 250, 500, 1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000, 138_047)


def symbol_counts(texts: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """(symbol, count) over prepared texts (column ``text``)."""
    prepared = texts.select(tx.prepare_text(F.col("text"), config.form, config.include_space).alias("p")).where("p <> ''")
    return prepared.select(F.explode(tx.characters(F.col("p"))).alias("symbol")).groupBy("symbol").count()


def vocabulary(texts: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """(id, symbol, count): kept symbols by falling count, then code point; ids from 2 (0 blank, 1 unknown).

    The order is made in one task over the distinct symbols, which Unicode bounds.
    """
    kept = symbol_counts(texts, config).where(F.col("count") >= config.min_frequency)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("count").desc(), "symbol"))
    ranked = kept.withColumn("id", (rank + schema.UNKNOWN).cast("long"))
    if config.max_symbols is not None:
        ranked = ranked.where(F.col("id") <= config.max_symbols + schema.UNKNOWN)
    return ranked.select("id", "symbol", "count")


def word_counts(texts: DataFrame, normal: bool = False) -> DataFrame:
    text = tx.normalize_text(F.col("text")) if normal else F.col("text")
    return texts.select(F.explode(tx.words(text)).alias("word")).groupBy("word").count()


def word_ranks(texts: DataFrame, ties: str = "word") -> DataFrame:
    """(word, count, rank): words by falling count, ranked from 1; of equal counts in order of code points, or with ties
    ``first`` in that of their first places (row_id, then place in the text)."""
    if ties not in ("word", "first"):
        raise ValueError("ties are broken by word or by first place")
    if ties == "word":
        return global_rank(word_counts(texts), [F.col("count").desc(), F.col("word")])
    placed = texts.select("row_id", F.posexplode(tx.words(F.col("text"))).alias("place", "word"))
    held = placed.groupBy("word").agg(F.count("*").alias("count"), F.min(F.struct("row_id", "place")).alias("first"))
    return global_rank(held, [F.col("count").desc(), F.col("first.row_id"), F.col("first.place")]).select("word", "count", "rank")


def word_ids(ranks: DataFrame) -> DataFrame:
    """(id, word): 0 is the blank, words have their ranks, and the id after the last word is the unknown word ``<unk>``."""
    known = ranks.select(F.col("rank").alias("id"), "word")
    unknown = ranks.agg((F.coalesce(F.max("rank"), F.lit(0)) + 1).alias("id")).select("id", F.lit("<unk>").alias("word"))
    return known.unionByName(unknown)


def held_symbols(vocab: DataFrame) -> dict[int, str]:
    """id -> symbol of a character vocabulary, which Unicode bounds to 1.1 million symbols.

    Symbols are single code points, none twice, with ids from 2 on without gaps; else ValueError is raised.
    """
    rows = {int(r["id"]): r["symbol"] for r in vocab.select("id", "symbol").collect()}
    if any(len(s) != 1 for s in rows.values()) or len(set(rows.values())) != len(rows):
        raise ValueError("symbols must be single code points, each of them once")
    if rows and (min(rows), max(rows)) != (schema.UNKNOWN + 1, schema.UNKNOWN + len(rows)):
        raise ValueError("ids must run from 2 without gaps")
    return rows


def _encoder(symbols: dict[int, str]):
    points = np.array([ord(s) for s in symbols.values()], np.int64)
    numbers = np.array(list(symbols), np.int32)

    @F.arrow_udf("array<int>")
    def run(text: pa.Array) -> pa.Array:
        table = np.full(int(points.max(initial=0)) + 2, schema.UNKNOWN, np.int32)
        table[points] = numbers
        held = text.to_pylist()
        counts = np.cumsum([0, *(len(t) if t else 0 for t in held)])
        codes = np.frombuffer("".join(t for t in held if t).encode("utf-32-le"), np.uint32)
        made = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(table[np.minimum(codes, len(table) - 1)]))
        return pc.if_else(pc.is_valid(text), made, pa.scalar(None, pa.list_(pa.int32())))

    return run


def encode(texts: DataFrame, vocab: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """Adds ids (array of int, one a code point of the prepared text; 1 for unknown), unknown (how many) and
    unknown_symbols (which, each once, in order). A null text has none of them."""
    run = _encoder(held_symbols(vocab))
    held = texts.withColumn("_p", tx.prepare_text(F.col("text"), config.form, config.include_space))
    held = held.withColumn("ids", run("_p")).withColumn("unknown", F.size(F.filter("ids", lambda i: i == schema.UNKNOWN)))
    pairs = F.arrays_zip(tx.characters(F.col("_p")).alias("c"), F.col("ids").alias("i"))
    odd = F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda z: z["i"] == schema.UNKNOWN), lambda z: z["c"])))
    return held.withColumn("unknown_symbols", F.when(F.col("unknown") > 0, odd).when(F.col("unknown") == 0, F.array().cast("array<string>"))).drop("_p")


def decode(ids: Column, vocab: DataFrame, keep_unknown: str | None = None) -> Column:
    """The text of an id array: blanks dropped, unknowns dropped or written as ``keep_unknown``; other ids raise."""
    names = held_symbols(vocab) | {schema.BLANK: "", schema.UNKNOWN: keep_unknown or ""}

    @F.arrow_udf("string")
    def run(held: pa.Array) -> pa.Array:
        try:
            return pa.array([None if r is None else "".join(names[i] for i in r) for r in held.to_pylist()], pa.string())
        except KeyError as error:
            raise ValueError(f"no symbol has id {error}") from None

    return run(ids)


def is_normalized(text: Column, form: str = "NFC") -> Column:
    """Whether a text is its own normal form; null for null."""
    return tx.normalize_text(text, form) == text


def decode_words(text: Column, include_space: bool = True) -> Column:
    """Words of a decoded text; without spaces the whole text is one, an empty text none."""
    whole = F.split(text, " ") if include_space else F.array(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def unseen_words(rows: DataFrame) -> DataFrame:
    """(split, tokens, distinct, unseen, rate): words of each split, and those that the train split doesn't hold."""
    tokens = rows.select("split", F.explode(tx.words(F.col("text"))).alias("word")).groupBy("split", "word").count()
    known = tokens.where("split = 'train'").select("word", F.lit(1).alias("known"))
    held = tokens.join(known, "word", "left")
    return held.groupBy("split").agg(
        F.sum("count").alias("tokens"), F.count("*").alias("distinct_words"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("count"))), F.lit(0)).alias("unseen")
    ).withColumn("rate", F.col("unseen") / F.col("tokens"))


def coverage_curve(rows: DataFrame, tops: tuple[int, ...] = TOP) -> DataFrame:
    """(top, split, tokens, unseen, utterances, unseen_utterances) if only the ``top`` most frequent train words were known.

    One pass serves all sizes: every word carries its rank, every utterance its worst rank.
    """
    ranks = word_ranks(rows.where("split = 'train'")).select("word", "rank")
    tokens = rows.select("row_id", "split", F.explode(tx.words(F.col("text"))).alias("word"))
    held = tokens.join(ranks, "word", "left").withColumn("rank", F.coalesce("rank", F.lit((1 << 62))))
    grid = F.explode(F.array(*map(F.lit, tops))).alias("top")
    level = lambda c: sum((F.when(F.col(c) > t, 1).otherwise(0) for t in tops), F.lit(0))
    edge = F.lit(list(tops))
    words = held.withColumn("level", level("rank")).groupBy("split", "level").count()
    worst = held.groupBy("row_id", "split").agg(F.max("rank").alias("rank")).withColumn("level", level("rank")).groupBy("split", "level").count()
    sized = lambda df: df.withColumn("reach", F.when(F.col("level") > 0, F.element_at(edge, F.col("level").cast("int"))).otherwise(0))
    words, worst = sized(words).select("*", grid), sized(worst).select("*", grid)
    hit = lambda df, name: df.groupBy("top", "split").agg(F.sum(F.when(F.col("reach") >= F.col("top"), F.col("count")).otherwise(0)).alias(name))
    totals = rows.groupBy("split").agg(F.count("*").alias("utterances"), F.coalesce(F.sum(F.size(tx.words(F.col("text")))), F.lit(0)).alias("tokens"))
    return hit(words, "unseen").join(hit(worst, "unseen_utterances"), ["top", "split"]).join(totals, "split")


def unknown_rate(rows: DataFrame, vocab: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """(split, symbols, unknown, utterances, with_unknown, rate)."""
    held = encode(rows, vocab, config)
    return held.groupBy("split").agg(
        F.sum(F.size("ids")).alias("symbols"), F.sum("unknown").alias("unknown"), F.count("*").alias("utterances"), F.count_if(F.col("unknown") > 0).alias("with_unknown")
    ).withColumn("rate", F.coalesce(F.try_divide("unknown", "symbols"), F.lit(0.0)))


def character_stats(rows: DataFrame) -> DataFrame:
    """(split, characters, filled, distinct_characters, unseen, unseen_rate, unseen_characters): code points, those not white
    space, distinct ones, occurrences of characters that the train split doesn't hold, their share, and which they are, in
    order (Unicode bounds the list)."""
    chars = rows.where("text <> ''").select("split", F.explode(tx.characters(F.col("text"))).alias("c")).groupBy("split", "c").count()
    known = chars.where("split = 'train'").select("c", F.lit(1).alias("known"))
    held, new = chars.join(known, "c", "left"), F.col("known").isNull()
    return held.groupBy("split").agg(
        F.sum("count").alias("characters"), F.coalesce(F.sum(F.when(~F.col("c").rlike(f"^{tx.SPACE}$"), F.col("count"))), F.lit(0)).alias("filled"), F.count("*").alias("distinct_characters"),
        F.coalesce(F.sum(F.when(new, F.col("count"))), F.lit(0)).alias("unseen"),
        (F.coalesce(F.sum(F.when(new, F.col("count"))), F.lit(0)) / F.sum("count")).alias("unseen_rate"),
        F.array_join(F.sort_array(F.collect_list(F.when(new, F.col("c")))), "").alias("unseen_characters"),
    )


def script_histogram(rows: DataFrame, form: str = "NFC") -> DataFrame:
    """(script, characters): distinct code points a script; scripts without any have 0."""
    text = tx.normalize_text(F.col("text"), form)
    seen = rows.select(text.alias("t")).where("t <> ''").select(F.explode(tx.characters(F.col("t"))).alias("c")).distinct()
    held = seen.groupBy(tx.script_of(F.col("c")).alias("script")).count()
    names = rows.sparkSession.createDataFrame([(s,) for s in tx.SCRIPTS], "script string")
    return names.join(held, "script", "left").select("script", F.coalesce("count", F.lit(0)).alias("characters"))


def scripts_in_order(text: Column) -> Column:
    """Scripts of a text in order of first appearance."""
    return F.array_distinct(F.transform(tx.characters(tx.normalize_text(text)), tx.script_of))


def normal_form_audit(rows: DataFrame, forms: tuple[str, ...] = ("NFC", "NFD", "NFKC")) -> DataFrame:
    """(form, changed, total, already, distinct_raw, distinct_characters): texts that each normal form changes, whether it
    changes none, and distinct code points before and after."""
    each = [F.struct(F.lit(f).alias("form"), tx.normalize_text(F.col("text"), f).alias("t")) for f in forms]
    held = rows.select("text", F.explode(F.array(*each)).alias("f")).select("text", "f.*")
    counts = held.groupBy("form").agg(F.count_if(F.col("t") != F.col("text")).alias("changed"), F.count("*").alias("total"))
    kinds = lambda df, *by: df.where("t <> ''").select(*by, F.explode(tx.characters(F.col("t"))).alias("c")).distinct()
    after = kinds(held, "form").groupBy("form").agg(F.count("*").alias("distinct_characters"))
    raw = kinds(rows.select(F.col("text").alias("t"))).agg(F.count("*").alias("distinct_raw"))
    raw = raw.select(F.explode(F.array(*map(F.lit, forms))).alias("form"), "distinct_raw")  # a row a form
    out = counts.join(after, "form", "left").join(raw, "form")
    return out.select("form", "changed", "total", (F.col("changed") == 0).alias("already"), "distinct_raw", F.coalesce("distinct_characters", F.lit(0)).alias("distinct_characters"))
