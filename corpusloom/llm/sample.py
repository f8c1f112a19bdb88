"""A sample that is the same on every run and only grows as records are added.

Every record has a key; a counter-based generator (MD5 over key, seed and counter) gives each key one fixed draw in
[0, 1). A key is chosen if its draw is below the rate of the epoch in which it was first seen. That rate is frozen
with the key, so lowering or raising later rates never changes an earlier decision.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default rates by first epoch; later epochs use the last.
RATES = {1: 0.20, 2: 0.16, 3: 0.12, 4: 0.10, 5: 0.08, 6: 0.06}
SEED = 20_24


def draw(key: Column, seed: int = SEED, counter: int = 0) -> Column:
    """The counter-th number in [0, 1) of the generator keyed by ``key``: 52 bits of MD5(key | seed | counter)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}|{counter}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rate_of(epoch: Column, rates: Mapping[int, float]) -> Column:
    out = F.lit(float(rates[max(rates)]))
    for e, rate in sorted(rates.items()):
        out = F.when(epoch == e, F.lit(float(rate))).otherwise(out)
    return out


def first_seen(records: DataFrame, key: str, epoch: str, rates: Mapping[int, float] = RATES) -> DataFrame:
    """(key, first_epoch, rate): a key's first epoch and the rate of that epoch. Null keys and epochs are left out."""
    new = records.where(F.col(key).isNotNull() & F.col(epoch).isNotNull())
    new = new.groupBy(key).agg(F.min(epoch).alias("first_epoch"))
    return new.withColumn("rate", rate_of(F.col("first_epoch"), rates))


def extend_ledger(records: DataFrame, key: str, epoch: str, folder: str, rates: Mapping[int, float] = RATES) -> DataFrame:
    """Adds the keys not yet in the ledger kept as a table in ``folder`` and returns the whole ledger."""
    spark = records.sparkSession
    try:
        known = spark.read.parquet(folder)
    except Exception as error:  # the first epoch: there is no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    new = records if known is None else records.join(known.select(key), key, "left_anti")
    first_seen(new, key, epoch, rates).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def fill_ledger(records: DataFrame, key: str, epoch: str, folder: str, rates: Mapping[int, float] = RATES) -> DataFrame:
    """Takes the epochs of ``records`` into the ledger in ``folder`` one after the other, and returns the whole ledger.

    A key belongs to the first epoch it comes with; what the ledger already says about it is never changed. Rows without
    key or epoch are left out; without any other row the ledger is empty.
    """
    epochs = sorted(r[0] for r in records.where(F.col(epoch).isNotNull()).select(epoch).distinct().collect())  # a row an epoch
    for e in epochs:
        extend_ledger(records.where(F.col(epoch) == e), key, epoch, folder, rates)
    if not epochs:
        extend_ledger(records, key, epoch, folder, rates)
    return records.sparkSession.read.parquet(folder)


def sample_rows(records: DataFrame, key: Column, epoch: str, folder: str, rates: Mapping[int, float] = RATES, seed: int = SEED) -> DataFrame:
    """The rows of all chosen keys, with sample_key, draw, first_epoch and rate added.

    ``folder`` holds the ledger of first epochs and frozen rates; the epochs of ``records`` are taken into it first, in
    order, so Spark jobs run when this is called. Rows without key or epoch are never chosen. Draws depend on the key
    alone: chosen keys are picked from the ledger, and only rows that some rate could choose are shuffled. An empty table
    gives an empty sample; columns of the four names are replaced.
    """
    made = ("sample_key", "draw", "first_epoch", "rate")
    rows = records.withColumn("_sample_key", key).drop(*(c for c in made if c != epoch)).withColumnRenamed("_sample_key", "sample_key")
    ledger = fill_ledger(rows.select("sample_key", epoch), "sample_key", epoch, folder, rates)
    chosen = ledger.withColumn("draw", draw(F.col("sample_key"), seed)).where(F.col("draw") < F.col("rate"))
    most = ledger.agg(F.max("rate")).first()[0] or 0.0
    rows = rows.where(F.col(epoch).isNotNull() & (draw(F.col("sample_key"), seed) < most))
    return rows.join(chosen, "sample_key")
