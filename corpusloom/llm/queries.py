"""Queries of the operators for training data, over whole tables, with SQL where SQL can state them."""

from corpusloom.functions import ids
from corpusloom.llm import components, language, leak, mixture, overlap, packing, sample, terms, unify
from corpusloom.plans.registry import Registry, table
from corpusloom.session import working_path
from pyspark.sql import functions as F

REGISTRY = Registry()

WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
UTTERANCE_SQL = r"""case when regexp_matches(utterance_id, '^\s*[A-Za-z]+[^A-Za-z0-9]+[0-9]+[^A-Za-z0-9]+[0-9]+')
  then upper(regexp_extract(utterance_id, '^\s*([A-Za-z]+)', 1)) || '_'
    || lpad(cast(cast(regexp_extract(utterance_id, '^\s*[A-Za-z]+[^A-Za-z0-9]+([0-9]+)', 1) as bigint) as varchar), 7, '0') || '_'
    || lpad(cast(cast(regexp_extract(utterance_id, '^\s*[A-Za-z]+[^A-Za-z0-9]+[0-9]+[^A-Za-z0-9]+([0-9]+)', 1) as bigint) as varchar), 7, '0')
  else upper(trim(utterance_id)) end"""


@REGISTRY.add(
    "p2_sample",
    f"""with keyed as (select row_id, delivery, {UTTERANCE_SQL} as sample_key from manifest),
  seen as (select sample_key, min(delivery) as first_epoch from keyed group by sample_key),
  rated as (select *, case first_epoch when 1 then 0.2 when 2 then 0.16 when 3 then 0.12 when 4 then 0.1 when 5 then 0.08 else 0.06 end as rate,
    cast(('0x' || substr(md5(sample_key || '|2024|0'), 1, 13)) as bigint) / 4503599627370496.0 as draw from seen)
  select row_id, sample_key, cast(first_epoch as integer) as first_epoch, cast(rate as double) as rate
  from keyed join rated using (sample_key) where draw < rate""",
)
def p2_sample(spark, folder):
    rows = table(spark, folder, "manifest").select("row_id", "utterance_id", "delivery")
    ledger = working_path(spark, "ledger")  # a service would keep one; a query begins with an empty one
    return sample.sample_rows(rows, ids.utterance_key(F.col("utterance_id")), "delivery", ledger).select("row_id", "sample_key", "first_epoch", "rate")


TERMS_SQL = f"""with pieces as (select row_id, unnest(string_split_regex(text, '{WHITE}')) as term from manifest),
  counts as (select term, count(*) as times, count(distinct row_id) as records from pieces where term <> '' group by term),
  filled as (select count(*) as n from manifest where not regexp_full_match(text, '({WHITE})?')),
  marked as (select term, times, records, case when records <= 1 then 'rare' when records >= 0.05 * n then 'common' end as mark from counts, filled)"""


def _counts(spark, folder):
    blocks = terms.count_blocks(table(spark, folder, "manifest"), "text")
    return terms.mark_terms(terms.count_terms(blocks, terms.dictionary(blocks)), terms.with_text(blocks))


@REGISTRY.add("p3_found", f"{TERMS_SQL} select term, mark from marked where mark is not null")
def p3_found(spark, folder):
    return _counts(spark, folder).where("mark is not null").select("term", "mark")


@REGISTRY.add("p3_counts", f"{TERMS_SQL} select term, cast(times as bigint) as times, cast(records as bigint) as records, mark from marked")
def p3_counts(spark, folder):
    return _counts(spark, folder).select("term", "times", "records", "mark")


@REGISTRY.add("p3_dictionary")
def p3_dictionary(spark, folder):
    return _counts(spark, folder).select("term_id", "term", "times", "records")


@REGISTRY.add("p6_found")
def p6_found(spark, folder):
    return unify.unify_texts(table(spark, folder, "manifest")).where("needed").select("row_id")


@REGISTRY.add("p6_unified")
def p6_unified(spark, folder):
    return unify.unify_texts(table(spark, folder, "manifest"))


@REGISTRY.add(
    "p7_found",
    r"""with recursive named as (select try_cast(nullif(regexp_extract(speaker_id, '([0-9]+)', 1), '') as bigint) as a,
    try_cast(nullif(regexp_extract(utterance_id, '^\s*[A-Za-z]+[^A-Za-z0-9]+([0-9]+)[^A-Za-z0-9]+[0-9]+', 1), '') as bigint) as b from manifest),
  edges as (select a, b from named where a <> b union select b, a from named where a <> b),
  reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a)
  select lpad(cast(a as varchar), 7, '0') as speaker_a, lpad(cast(b as varchar), 7, '0') as speaker_b from reach where a < b""",
)
def p7_found(spark, folder):
    return components.tied_speakers(table(spark, folder, "manifest"))


@REGISTRY.add("p7_splits")
def p7_splits(spark, folder):
    return components.split_rows(table(spark, folder, "manifest"), table(spark, folder, "dataset_versions"))


@REGISTRY.add("p8_found")
def p8_found(spark, folder):
    return leak.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@REGISTRY.add("p8_report")
def p8_report(spark, folder):
    return leak.leak_report(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@REGISTRY.add("p10_found")
def p10_found(spark, folder):
    documents = table(spark, folder, "documents")
    return language.relabelled(documents, language.train(documents))


@REGISTRY.add("p10_passages")
def p10_passages(spark, folder):
    documents = table(spark, folder, "documents")
    return language.passages(documents, language.train(documents))


@REGISTRY.add("p5_found")
def p5_found(spark, folder):
    return overlap.overlap_pairs(table(spark, folder, "manifest"))


@REGISTRY.add("p5_members")
def p5_members(spark, folder):
    return overlap.overlap_members(table(spark, folder, "manifest"))


@REGISTRY.add("p5_report")
def p5_report(spark, folder):
    return overlap.overlap_report(table(spark, folder, "manifest"))


@REGISTRY.add("p4_packed")
def p4_packed(spark, folder):
    return packing.pack(packing.utterances(table(spark, folder, "manifest")), table(spark, folder, "pack_plans"))


@REGISTRY.add("p4_report")
def p4_report(spark, folder):
    return packing.fill_report(p4_packed(spark, folder), table(spark, folder, "pack_plans"))


@REGISTRY.add("p9_mix")
def p9_mix(spark, folder):
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


@REGISTRY.add("p9_shares")
def p9_shares(spark, folder):
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]
