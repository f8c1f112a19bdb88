"""Identifiers that arrive in several spellings, as numbers and in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: prefix, speaker and number of an utterance id, whatever separates them and whatever follows
UTTERANCE = r"^\s*([A-Za-z]+)[^A-Za-z0-9]+([0-9]+)[^A-Za-z0-9]+([0-9]+)"


def first_number(text: Column) -> Column:
    """The first run of digits as BIGINT (``spk_0001`` and ``1.0`` are 1); null if there is none or it is too long."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("bigint")


def utterance_part(utterance_id: Column, part: int) -> Column:
    """2: speaker, 3: number of the utterance, as BIGINT; null where the id has another shape."""
    return F.regexp_extract(utterance_id, UTTERANCE, part).try_cast("bigint")


def utterance_key(utterance_id: Column) -> Column:
    """One spelling for all spellings of an utterance id: PREFIX_0000001_0000001.

    An id of another shape is kept in upper case without outer white space; null and blank ids have no key.
    """
    prefix = F.upper(F.regexp_extract(utterance_id, UTTERANCE, 1))
    pad = lambda k: F.lpad(utterance_part(utterance_id, k).cast("string"), 7, "0")
    long = lambda k: utterance_part(utterance_id, k) >= 10_000_000
    number = lambda k: F.when(long(k), utterance_part(utterance_id, k).cast("string")).otherwise(pad(k))
    other = F.upper(F.regexp_replace(utterance_id, r"^\s+|\s+$", ""))
    known = utterance_part(utterance_id, 2).isNotNull() & utterance_part(utterance_id, 3).isNotNull()
    return F.when(known, F.concat_ws("_", prefix, number(2), number(3))).otherwise(F.when(other != "", other))


def speaker_number(speaker_id: Column, utterance_id: Column) -> Column:
    """The number in speaker_id, or else the speaker named in utterance_id."""
    return F.coalesce(first_number(speaker_id), utterance_part(utterance_id, 2))
