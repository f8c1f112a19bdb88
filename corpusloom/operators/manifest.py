"""Manifests: usable records, summaries, identity and integrity checks, curation of versions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.operators.grouped import global_sum, ranked_values


def seven_digits(number: Column) -> Column:
    return F.when(number < 10_000_000, F.lpad(number.cast("string"), 7, "0")).otherwise(number.cast("string"))


def records(manifest: DataFrame) -> DataFrame:
    """The rows that manifest queries work on: a split is named and the duration is finite and above 0.

    Adds ``split`` (lower case, without outer blanks) and writes speaker_id as a 7-digit number; a null text is empty, a
    null prefix ''. Rows without any speaker number are left out.
    """
    split = F.lower(F.regexp_replace("shipped_split", r"^\s+|\s+$", ""))
    speaker = ids.speaker_number(F.col("speaker_id"), F.col("utterance_id"))
    rows = manifest.where("duration_seconds > 0 and duration_seconds < double('inf')").withColumns({"split": split, "number": speaker})
    return rows.where("split <> '' and number is not null").select(
        "row_id", "utterance_id", F.coalesce("text", F.lit("")).alias("text"), seven_digits(F.col("number")).alias("speaker_id"),
        F.coalesce("prefix", F.lit("")).alias("prefix"), "split", "duration_seconds", "sample_rate", "dataset_id", "audio_path", "delivery",
    )


def split_position(split: Column) -> Column:
    """train, dev, test as 1, 2, 3; 0 for another split."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, schema.SPLITS)), split), F.lit(0))


def summary(rows: DataFrame) -> DataFrame:
    """One row per split and one for all (split ``total``): counts, hours, lengths, sample rates and prefixes.

    The median is the true one. Rows are first counted by speaker, prefix and rate within their split, so the rows of
    ``total`` are made of those counts and not of all rows twice; the median comes from counted logarithmic steps.
    """
    micro = F.round(F.col("duration_seconds") * 1_000_000).cast("decimal(38,0)")
    part = rows.groupBy("split", "speaker_id", "prefix", "sample_rate").agg(
        F.count("*").alias("n"), F.sum(micro).alias("micro"), F.count_if(F.col("text") == "").alias("empty"), F.min("duration_seconds").alias("shortest"), F.max("duration_seconds").alias("longest")
    )
    both = part.withColumn("split", F.explode(F.array("split", F.lit("total"))))
    main = both.groupBy("split").agg(
        F.sum("n").alias("utterances"), F.count_distinct("speaker_id").alias("speakers"), (F.sum("micro").cast("double") / 3.6e9).alias("hours"),
        F.sum("empty").alias("empty_transcripts"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_set("sample_rate")), lambda r: r.cast("string")), ",").alias("sample_rates"),
    )
    halves = {"lo": "(n + 1) div 2", "hi": "n div 2 + 1"}
    middle = ranked_values(rows, ["split"], "duration_seconds", halves).select("split", "lo", "hi")
    whole = ranked_values(rows, [], "duration_seconds", halves).select(F.lit("total").alias("split"), "lo", "hi")
    names = both.groupBy("split", "prefix").agg(F.sum("n").alias("n")).groupBy("split").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "n"))), lambda s: F.concat(s["prefix"], F.lit("="), s["n"].cast("string"))), ",").alias("prefixes")
    )
    middle = middle.unionByName(whole).select("split", ((F.col("lo") + F.col("hi")) / 2).alias("median"))
    return main.join(middle, "split").join(names, "split")


def shared_speakers(rows: DataFrame) -> DataFrame:
    """(split_a, split_b, speakers): how many speakers two splits share; split_a before split_b. Pairs without any are absent."""
    pairs = rows.select("speaker_id", "split").distinct()
    other = pairs.select("speaker_id", F.col("split").alias("split_b"))
    met = pairs.withColumnRenamed("split", "split_a").join(other, "speaker_id").where(split_position(F.col("split_a")) < split_position(F.col("split_b")))
    return met.groupBy("split_a", "split_b").agg(F.count("*").alias("speakers"))


def split_speakers(rows: DataFrame) -> DataFrame:
    """Speakers that are in more than one split, with the number of splits; empty when splits are disjoint."""
    return rows.groupBy("speaker_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(utterance_id, row_id, first_row): every later row of an id that came before. The id may recur without bound: the
    first row is a minimum that is joined back."""
    first = rows.groupBy("utterance_id").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "utterance_id").where("row_id > first_row").select("utterance_id", "row_id", "first_row")


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys in both tables whose columns differ; nulls are equal to each other."""
    left = before.select(key, F.struct(*columns).alias("a"))
    right = after.select(key, F.struct(*columns).alias("b"))
    return left.join(right, key).where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def every_nth(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Every n-th of the distinct keys in order, n such that at most ``most`` are taken (as a check of headers takes them)."""
    from corpusloom.operators.grouped import global_rank

    ranked = global_rank(rows.select(key).distinct(), [F.col(key)])
    n = ranked.count()
    step = max(1, n // most)
    return ranked.where(((F.col("rank") - 1) % step == 0) & (F.col("rank") <= step * most)).select(key, F.col("rank"))


def budget(rows: DataFrame, key: str, seconds: str, most: float) -> DataFrame:
    """The shortest rows whose running length first reaches ``most`` seconds, the one that crosses it included.

    Lengths are added as whole microseconds, in order of (seconds, key), in ``until``. Length classes are counted first, and
    only rows of classes that begin within the budget are sorted, by ranges of (seconds, key): a length that a third of all
    rows have is cut by key.
    """
    micro = F.round(F.col(seconds) * 1_000_000).cast("long")
    step = F.floor(F.ln(F.greatest(F.col(seconds), F.lit(1e-6))) * 1024)
    steps = rows.select(step.alias("_b"), micro.alias("_m")).groupBy("_b").agg(F.sum("_m").alias("_sum"))
    w = Window.partitionBy(F.lit(0)).orderBy("_b")  # a row a length class, of which there are some ten thousand
    limit = round(most * 1_000_000)
    last = steps.withColumn("_to", F.sum("_sum").over(w)).where(F.col("_to") - F.col("_sum") < limit).agg(F.max("_b")).first()[0]
    summed = global_sum(rows.where(step <= F.lit(last)), [F.col(seconds), F.col(key)], micro, "until")
    return summed.where(F.col("until") - micro < limit)


_CHECK = "struct<name:string,detail:bigint>"


def _table(one_row: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(name, ok, detail) of several counts in one row; a check holds if its count is 0."""
    made = F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(c, F.lit(0)).cast("long").alias("detail")) for name, c in named.items()])
    return one_row.select(F.explode(made.cast(f"array<{_CHECK}>")).alias("c")).select("c.name", (F.col("c.detail") == 0).alias("ok"), "c.detail")


def _one(name: str, failed: DataFrame) -> DataFrame:
    return _table(failed.agg(F.count("*").alias("n")), {name: F.col("n")})


def _shared_pairs(rows: DataFrame) -> DataFrame:
    """(name, ok, detail): speakers that each pair of splits shares."""
    held = rows.groupBy("speaker_id").agg(F.collect_set("split").alias("s"))
    pairs = [(a, b) for i, a in enumerate(schema.SPLITS) for b in schema.SPLITS[i + 1 :]]
    both = {f"no speaker in both {a} and {b}": F.count_if(F.array_contains("s", a) & F.array_contains("s", b)) for a, b in pairs}
    return _table(held.agg(*[c.alias(n) for n, c in both.items()]), {n: F.col(f"`{n}`") for n in both})


def integrity(rows: DataFrame, stated: DataFrame | None = None, files: DataFrame | None = None, headers: DataFrame | None = None, sample: int = 2000) -> DataFrame:
    """(name, ok, detail): the checks of a manifest as one table of assertions; detail counts what speaks against one.

    stated (split, utterances, speakers, hours) are the figures to be met, with those of all splits in the row ``total``;
    files (utterance_id) the recordings there are, and headers (utterance_id, duration) what their headers say, which every
    n-th utterance is held against within a sample. Checks whose table isn't given are left out.
    """
    far = F.col("audio_path").isNull() | F.startswith("audio_path", F.lit("/")) | F.col("audio_path").rlike("^[A-Za-z]:")
    each = {
        "no transcript is empty": tx.strip(F.col("text")) == "",
        "no replacement character": F.contains("text", F.lit("�")),
        "paths are relative": far,
        "sample rate is canonical": ~F.col("sample_rate").eqNullSafe(F.lit(schema.SAMPLE_RATE)),
        "split names are known": split_position(F.col("split")) == 0,
    }
    one_pass = rows.agg(*[F.count_if(c).alias(n) for n, c in each.items()])
    out = _one("utterance ids are unique", repeated_ids(rows)).unionByName(_one("splits share no speaker", split_speakers(rows)))
    out = out.unionByName(_table(one_pass, {n: F.col(f"`{n}`") for n in each})).unionByName(_shared_pairs(rows))
    if stated is not None:
        met = compare_stats(rows, stated)
        out = out.unionByName(_table(met.agg(F.count_if(F.expr("split <> 'total' and not same_utterances")).alias("u"), F.count_if(F.expr("split = 'total' and not same_speakers")).alias("s"), F.count_if(F.expr("not same_hours")).alias("h")),
                                     {"splits have the stated rows": F.col("u"), "speakers are as stated": F.col("s"), "hours are as stated": F.col("h")}))
    if files is not None:
        out = out.unionByName(_one("recordings exist", missing_files(rows, files)[0]))
    if headers is not None:
        held = rows.join(every_nth(rows, "utterance_id", sample).select("utterance_id"), "utterance_id", "left_semi").join(headers.select("utterance_id", "duration"), "utterance_id")
        out = out.unionByName(_one("durations are those of the headers", held.where(F.abs(F.col("duration") - F.col("duration_seconds")) > 1 / schema.SAMPLE_RATE)))
    return out


def compare_stats(rows: DataFrame, stated: DataFrame, hours: float = 0.01) -> DataFrame:
    """(split, utterances, stated_utterances, same_utterances, same_speakers, same_hours): figures counted now against stated
    ones (split, utterances, speakers, hours), hours within a tolerance. A split on one side only agrees in nothing."""
    told = stated.select("split", *[F.col(c).alias(f"stated_{c}") for c in ("utterances", "speakers", "hours")])
    met = summary(rows).select("split", "utterances", "speakers", "hours").join(told, "split", "full")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"stated_{c}"), F.lit(False)).alias(f"same_{c}")
    near = F.coalesce(F.abs(F.col("hours") - F.col("stated_hours")) <= hours, F.lit(False)).alias("same_hours")
    return met.select("split", "utterances", "stated_utterances", same("utterances"), same("speakers"), near)


def tally(checks: DataFrame) -> DataFrame:
    """(passed, failed, pending): how many checks hold, do not, and have no verdict yet (ok is null)."""
    return checks.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("pending"))


def enforce(checks: DataFrame) -> None:
    """Raises ValueError with the names and counts of the checks that don't hold."""
    broken = checks.where(~F.coalesce("ok", F.lit(False))).select("name", "detail").collect()  # a row a check
    if broken:
        raise ValueError("; ".join(f"{r['name']}: {r['detail']}" for r in broken))


def published_checks(published: DataFrame, after: DataFrame, removed: DataFrame, key: str = "utterance_id") -> DataFrame:
    """(name, ok, detail): a published list of ids names only rows of the new version and none of the removed ones."""
    ids_ = published.select(key).distinct()
    absent = _one("published ids are in the version", ids_.join(after, key, "left_anti"))
    return absent.unionByName(_one("published ids were not removed", ids_.join(removed, key, "left_semi")))


def latest(rows: DataFrame, key: str = "utterance_id") -> DataFrame:
    """One row per key: the last by delivery, then row_id."""
    return rows.join(rows.groupBy(key).agg(F.max_by("row_id", F.struct("delivery", "row_id")).alias("row_id")).select("row_id"), "row_id", "left_semi")


def missing_files(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without file, files without record) by utterance id."""
    return rows.join(files, "utterance_id", "left_anti"), files.join(rows, "utterance_id", "left_anti")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(split_position(F.col("split")), "utterance_id", "row_id")


def ranks_in(rows: DataFrame, group: str, by: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark limits each group before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("rank") <= most)


def curation_checks(before: DataFrame, after: DataFrame, removed: DataFrame) -> DataFrame:
    """(name, ok, detail): a new version against the one before and the rows meant to be removed (row_id).

    Made from the tables alone, without the code that made them. detail counts what speaks against a check. Rows of both
    versions meet in one join on row_id, in which each carries a hash of its columns.
    """
    columns = [c for c in before.columns if c != "row_id"]
    mark = lambda df, name: df.groupBy("row_id").agg(F.count("*").alias(f"{name}_n"), F.min(F.xxhash64(*columns)).alias(f"{name}_h"), F.max(F.xxhash64(*columns, F.lit(1))).alias(f"{name}_g"))
    named = removed.select("row_id").distinct().withColumn("named", F.lit(1))
    met = mark(before, "old").join(mark(after, "new"), "row_id", "full").join(named, "row_id", "full")
    old, new, gone = F.col("old_n").isNotNull(), F.col("new_n").isNotNull(), F.col("named").isNotNull()
    counts = {
        "nothing but the named rows is gone": old & ~new & ~gone,
        "all named rows are gone": new & gone,
        "named rows were there": gone & ~old,
        "no row is new": new & ~old,
        "kept rows are unchanged": old & new & ~(F.col("old_h").eqNullSafe(F.col("new_h")) & F.col("old_g").eqNullSafe(F.col("new_g"))),
        "no row occurred twice before": F.col("old_n") > 1,
        "no row occurs twice": F.col("new_n") > 1,
    }
    out = _table(met.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]), {n: F.col(f"`{n}`") for n in counts})
    homes = lambda df: df.select("speaker_id", "split").distinct()
    out = out.unionByName(_one("no speaker changed its splits", homes(after).join(homes(before), ["speaker_id", "split"], "left_anti")))
    each = {"no transcript is empty": tx.strip(F.col("text")) == "", "split names are known": split_position(F.col("split")) == 0}
    out = out.unionByName(_table(after.agg(*[F.count_if(c).alias(n) for n, c in each.items()]), {n: F.col(f"`{n}`") for n in each}))
    return out.unionByName(_shared_pairs(after))


def version_checks(before: DataFrame, after: DataFrame, removed: DataFrame, document: DataFrame, version: str, derived_from: str, files: DataFrame | None = None, published: DataFrame | None = None) -> DataFrame:
    """(name, ok, detail): everything that must hold of a new version: curation_checks, that its document (what ``metadata``
    gives) says the same as its rows, that its recordings are there, and that a published list of ids fits it."""
    shape = "dataset_version string, derived_from string, changes struct<removed_utterances:bigint>, splits map<string,struct<utterances:bigint,speakers:bigint,hours:double>>"
    told = document.select(F.from_json("json", shape).alias("d")).select("d.*")
    wrong = lambda ok: F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)
    gone = removed.agg(F.count("*").alias("gone"))  # one row each
    head = told.withColumn("_k", F.lit(0)).join(gone.withColumn("_k", F.lit(0)), "_k")
    out = curation_checks(before, after, removed).unionByName(_table(head, {
        "the document declares the version": wrong(F.col("dataset_version") == version), "the document names the version before": wrong(F.col("derived_from") == derived_from),
        "the document counts what was removed": wrong(F.col("changes.removed_utterances") == F.col("gone")),
    }))
    stated = told.select(F.explode("splits").alias("split", "v")).select("split", "v.*")
    met = compare_stats(after, stated, 1e-6).where("split <> 'total'")
    for s in schema.SPLITS:
        mine = met.where(F.col("split") == s).agg(F.count_if(F.expr("not same_utterances")).alias("u"), F.count_if(F.expr("not same_hours")).alias("h"), F.count_if(F.expr("not same_speakers")).alias("s"))
        out = out.unionByName(_table(mine, {f"the document counts the rows of {s}": F.col("u"), f"the document sums the hours of {s}": F.col("h"), f"the document counts the speakers of {s}": F.col("s")}))
    if files is not None:
        out = out.unionByName(_one("recordings exist", missing_files(after, files)[0]))
    return out if published is None else out.unionByName(published_checks(published, after, removed))


def metadata(rows: DataFrame, removed: DataFrame, dataset_id: str, version: str, derived_from: str | None = None, kept: DataFrame | None = None, most: int = 100_000, **more: object) -> DataFrame:
    """One row ``json``: statistics of each split, its speakers, and what was removed from the version before and why.

    kept (variant, utterance_id) are rows that stay although an encoder can't use them; ``more`` adds fields to the
    document's head (license, source, split_seed, ratios). Lists of speakers, removed rows and kept ids are in the document
    only if they have at most ``most`` entries together; ``write_version`` puts longer ones beside it as tables.
    """
    stats = summary(rows).where("split <> 'total'")
    each = F.struct("utterances", "speakers", "hours", "empty_transcripts", "sample_rates", "prefixes", F.struct(F.col("shortest").alias("min"), "median", F.col("longest").alias("max")).alias("duration_seconds"))
    as_map = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(*value))))
    parts = [stats.agg(as_map(["split", each.alias("v")]).alias("splits"))]
    counts = removed.groupBy("reason").count()
    parts.append(counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("removed_utterances"), as_map(["reason", "count"]).alias("reasons")))
    shared = shared_speakers(rows).select(F.concat_ws("_", "split_a", "split_b").alias("k"), "speakers")
    parts.append(shared.agg(as_map(["k", "speakers"]).alias("speaker_overlap_after")))
    changed, tail = ["removed_utterances", "reasons", "speaker_overlap_after"], ["splits"]
    voices = rows.select("split", "speaker_id").distinct()
    if voices.count() + removed.count() + (kept.count() if kept is not None else 0) <= most:
        parts.append(voices.groupBy("split").agg(F.sort_array(F.collect_list("speaker_id")).alias("v")).agg(as_map(["split", "v"]).alias("speakers")))
        parts.append(removed_rows(removed).agg(F.sort_array(F.collect_list(F.struct(*removed_rows(removed).columns))).alias("removed")))
        changed, tail = [*changed, "removed"], [*tail, "speakers"]
        if kept is not None:
            parts.append(kept.groupBy("variant").agg(F.sort_array(F.collect_list("utterance_id")).alias("v")).agg(as_map(["variant", "v"]).alias("kept_fast_speech")))
            changed.append("kept_fast_speech")
    doc = parts[0].withColumn("_k", F.lit(1))
    for part in parts[1:]:  # one row each
        doc = doc.join(part.withColumn("_k", F.lit(1)), "_k")
    head = [F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("dataset_version"), F.lit(derived_from).alias("derived_from")]
    head += [F.parse_json(F.lit(json.dumps(v, ensure_ascii=False))).alias(k) for k, v in more.items()]
    return doc.select(F.to_json(F.struct(*head, F.struct(*changed).alias("changes"), *tail), {"pretty": "true"}).alias("json"))


def removed_rows(removed: DataFrame) -> DataFrame:
    return removed.select("utterance_id", "speaker_id", "split", "duration_seconds", "reason")


def split_members(rows: DataFrame) -> DataFrame:
    """(split, speaker_id, utterances)."""
    return rows.groupBy("split", "speaker_id").agg(F.count("*").alias("utterances"))


def write_version(rows: DataFrame, base: str, version: str, document: DataFrame | None = None, removed: DataFrame | None = None) -> str:
    """A version as Parquet by split in a folder of its own, with its document and the tables of removed rows and of speakers
    if they are given; a version that exists is never overwritten."""
    path = f"{base.rstrip('/')}/{version}"
    if document is None and removed is None:
        rows.write.mode("errorifexists").partitionBy("split").parquet(path)
        return path
    rows.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/rows")
    split_members(rows).write.mode("errorifexists").parquet(f"{path}/speakers")
    if document is not None:
        document.coalesce(1).write.mode("errorifexists").text(f"{path}/metadata")
    if removed is not None:
        removed_rows(removed).write.mode("errorifexists").parquet(f"{path}/removed")
    return path
