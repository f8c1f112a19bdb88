"""Error rates of decoded texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements that turn one list of tokens into the other; one row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    codes: dict = {}
    x = np.array([codes.setdefault(t, len(codes)) for t in a], np.int64)
    y = np.array([codes.setdefault(t, len(codes)) for t in b], np.int64)
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, t in enumerate(x, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != t))
        row = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def word_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distance of the pieces between single blanks; an empty side counts as one empty word. Null if either is null."""
    return pd.Series([edit_distance(r.split(" "), h.split(" ")) if isinstance(r, str) and isinstance(h, str) else None for r, h in zip(reference, hypothesis, strict=True)], dtype="Int32")


def error_rates(pairs: DataFrame, by: list[str], include_space: bool = True) -> DataFrame:
    """(by, utterances, token_errors, tokens, token_error_rate, exact, word_error_rate) of (reference, hypothesis).

    The token error rate is 1 without reference tokens; the word error rate is null unless blanks are tokens.
    """
    held = pairs.withColumns({"_e": F.levenshtein("reference", "hypothesis"), "_n": F.length("reference")})
    sums = [F.count("*").alias("utterances"), F.sum("_e").alias("token_errors"), F.sum("_n").alias("tokens"), F.avg(F.when(F.col("_e") == 0, 1.0).otherwise(0.0)).alias("exact")]
    if include_space:
        held = held.withColumns({"_w": word_distance("reference", "hypothesis"), "_m": F.size(F.split("reference", " "))})
        sums.append((F.sum("_w") / F.sum("_m")).alias("word_error_rate"))
    else:
        sums.append(F.lit(None).cast("double").alias("word_error_rate"))
    out = held.groupBy(*by).agg(*sums)
    return out.withColumn("token_error_rate", F.when(F.col("tokens") > 0, F.col("token_errors") / F.col("tokens")).otherwise(1.0))


#: Largest token error rate and loss of an accepted run (fixed values).
ACCEPTED_ERRORS, ACCEPTED_LOSS = 0.10, 1.0


def accepted(error_rate: Column, loss: Column | None = None) -> Column:
    """Whether a run is accepted by its token error rate and, if given, its loss; a null figure is not accepted."""
    ok = F.coalesce(error_rate <= ACCEPTED_ERRORS, F.lit(False))
    return ok if loss is None else ok & F.coalesce(loss <= ACCEPTED_LOSS, F.lit(False))


def argmax(scores: Column) -> Column:
    """Index from 0 of the largest of an array of scores, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
