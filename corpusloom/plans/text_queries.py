"""Queries on transcripts: normal forms, characters, scripts, vocabularies and what they don't cover."""

from corpusloom.functions import text as tx
from corpusloom.operators import decode as de
from corpusloom.operators import vocabulary as vo
from corpusloom.plans.common import CHARS, PREPARED, RECORDS, SPACE, UNSPACED, WORDS, records
from corpusloom.plans.registry import Registry, table
from pyspark.sql import functions as F

REGISTRY = Registry()
add = REGISTRY.add
WITH = f"with {RECORDS}"
#: Train characters of prepared texts with their ids
VOCAB = f"""prepared as (select row_id, split, {PREPARED} as p from records), symbols as (select unnest(regexp_extract_all(p, '(?s).')) as symbol from prepared where split = 'train'),
  counted as (select symbol, count(*) as count from symbols group by symbol), vocab as (select row_number() over (order by count desc, encode(symbol)) + 1 as id, symbol, count from counted)"""


def _train(spark, folder):
    return records(spark, folder).where("split = 'train'")


def _vocab(spark, folder):
    return vo.vocabulary(_train(spark, folder))


@add("prepare_text", f"select row_id, {PREPARED} as prepared from manifest")
def prepare_text(spark, folder):
    return table(spark, folder, "manifest").select("row_id", tx.prepare_text(F.col("text")).alias("prepared"))


@add(
    "normalization_audit",
    f"""{WITH}, kinds as (select (select count(*) from (select distinct unnest({CHARS}) from records)) as distinct_raw,
    (select count(*) from (select distinct unnest(regexp_extract_all(nfc_normalize(text), '(?s).')) from records)) as distinct_characters)
  select 'NFC' as form, count(*) filter (where nfc_normalize(text) <> text) as changed, count(*) as total, count(*) filter (where nfc_normalize(text) <> text) = 0 as already,
  any_value(distinct_raw) as distinct_raw, any_value(distinct_characters) as distinct_characters from records, kinds""",
)
def normalization_audit(spark, folder):
    return vo.normal_form_audit(records(spark, folder), ("NFC",))


@add("is_normalized", "select row_id, nfc_normalize(text) = text as nfc from manifest")
def is_normalized(spark, folder):
    return table(spark, folder, "manifest").select("row_id", vo.is_normalized(F.col("text")).alias("nfc"))


@add("normalization_audit_all_forms")
def normalization_audit_all_forms(spark, folder):
    return vo.normal_form_audit(records(spark, folder))


@add("char_vocabulary", f"{WITH}, {VOCAB} select id, symbol, count from vocab")
def char_vocabulary(spark, folder):
    return _vocab(spark, folder)


@add("vocab_min_frequency", f"{WITH}, {VOCAB} select row_number() over (order by count desc, encode(symbol)) + 1 as id, symbol, count from counted where count >= 100")
def vocab_min_frequency(spark, folder):
    return vo.vocabulary(_train(spark, folder), vo.TokenizerConfig(min_frequency=100))


@add("vocab_top_n", f"{WITH}, {VOCAB} select id, symbol, count from vocab where id <= 31")
def vocab_top_n(spark, folder):
    return vo.vocabulary(_train(spark, folder), vo.TokenizerConfig(max_symbols=30))


@add(
    "word_vocabulary",
    f"{WITH}, w as (select unnest({WORDS}) as word from records where split = 'train') select word, count(*) as count, row_number() over (order by count(*) desc, encode(word)) as rank from w group by word",
)
def word_vocabulary(spark, folder):
    return vo.word_ranks(_train(spark, folder))


@add(
    "word_vocabulary_first_seen",
    f"""{WITH}, w as (select row_id, unnest({WORDS}) as word, generate_subscripts({WORDS}, 1) as place from records where split = 'train'),
  held as (select word, count(*) as count, min((row_id, place)) as first from w group by word) select word, count, row_number() over (order by count desc, first) as rank from held""",
)
def word_vocabulary_first_seen(spark, folder):
    return vo.word_ranks(_train(spark, folder), ties="first")


@add(
    "word_ids",
    f"""{WITH}, w as (select unnest({WORDS}) as word from records where split = 'train'), ranked as (select word, row_number() over (order by count(*) desc, encode(word)) as id from w group by word)
  select id, word from ranked union all select coalesce(max(id), 0) + 1, '<unk>' from ranked""",
)
def word_ids(spark, folder):
    return vo.word_ids(vo.word_ranks(_train(spark, folder)))


@add(
    "encode_report",
    f"""{WITH}, {VOCAB}, small as (select * from vocab where id <= 31), chars as (select row_id, unnest(regexp_extract_all(p, '(?s).')) as symbol from prepared where p <> ''),
  lost as (select row_id, count(*) as unknown, string_agg(distinct symbol, '' order by symbol) as unknown_symbols from chars where symbol not in (select symbol from small) group by row_id)
  select row_id, cast(coalesce(unknown, 0) as integer) as unknown, coalesce(unknown_symbols, '') as unknown_symbols from prepared left join lost using (row_id)""",
)
def encode_report(spark, folder):
    """Against a vocabulary of 30 symbols, which leaves some characters unknown."""
    held = vo.encode(records(spark, folder), vo.vocabulary(_train(spark, folder), vo.TokenizerConfig(max_symbols=30)))
    return held.select("row_id", "unknown", F.array_join("unknown_symbols", "").alias("unknown_symbols"))


@add(
    "encode_ids",
    f"""{WITH}, {VOCAB}, chars as (select row_id, unnest(regexp_extract_all(p, '(?s).')) as symbol, generate_subscripts(regexp_extract_all(p, '(?s).'), 1) as i from prepared where p <> ''),
  coded as (select row_id, string_agg(coalesce(id, 1)::varchar, ' ' order by i) as ids, count(*) filter (where id is null) as unknown from chars left join vocab using (symbol) group by row_id)
  select row_id, coalesce(ids, '') as ids, cast(coalesce(unknown, 0) as integer) as unknown from prepared left join coded using (row_id)""",
)
def encode_ids(spark, folder):
    held = vo.encode(records(spark, folder), _vocab(spark, folder))
    return held.select("row_id", F.array_join("ids", " ").alias("ids"), "unknown")


@add(
    "decode_text",
    f"""{WITH}, {VOCAB}, chars as (select row_id, unnest(regexp_extract_all(p, '(?s).')) as symbol, generate_subscripts(regexp_extract_all(p, '(?s).'), 1) as i from prepared where p <> ''),
  known as (select row_id, string_agg(symbol, '' order by i) as decoded from chars join vocab using (symbol) group by row_id)
  select row_id, coalesce(decoded, '') as decoded from prepared left join known using (row_id)""",
)
def decode_text(spark, folder):
    vocab = _vocab(spark, folder)
    held = vo.encode(records(spark, folder), vocab)
    return held.select("row_id", vo.decode(F.col("ids"), vocab).alias("decoded"))


@add(
    "decode_words",
    f"""{WITH}, {VOCAB}, chars as (select row_id, unnest(regexp_extract_all(p, '(?s).')) as symbol, generate_subscripts(regexp_extract_all(p, '(?s).'), 1) as i from prepared where p <> ''),
  known as (select row_id, string_agg(symbol, '' order by i) as decoded from chars join vocab using (symbol) group by row_id)
  select row_id, case when coalesce(decoded, '') = '' then 0 else len(string_split(decoded, ' ')) end as words from prepared left join known using (row_id)""",
)
def decode_words(spark, folder):
    """Words of what the encoded texts decode to."""
    vocab = _vocab(spark, folder)
    held = vo.encode(records(spark, folder), vocab)
    return held.select("row_id", F.size(vo.decode_words(vo.decode(F.col("ids"), vocab))).cast("long").alias("words"))


@add(
    "unknown_rate",
    f"""{WITH}, {VOCAB}, chars as (select row_id, split, unnest(regexp_extract_all(p, '(?s).')) as symbol from prepared where p <> ''),
  each as (select split, row_id, count(*) as n, count(*) filter (where symbol not in (select symbol from vocab)) as u from chars group by all),
  rows as (select split, count(*) as utterances from records group by split)
  select split, cast(sum(n) as bigint) as symbols, cast(sum(u) as bigint) as unknown, any_value(utterances) as utterances, count(*) filter (where u > 0) as with_unknown, sum(u) / sum(n) as rate from each join rows using (split) group by split""",
)
def unknown_rate(spark, folder):
    return vo.unknown_rate(records(spark, folder), _vocab(spark, folder))


@add(
    "char_stats_by_split",
    f"""{WITH}, chars as (select split, unnest({CHARS}) as c from records), train as (select distinct c from chars where split = 'train')
  select split, count(*) as characters, count(*) filter (where not regexp_full_match(c, '{SPACE}')) as filled, count(distinct c) as distinct_characters, count(*) filter (where c not in (select c from train)) as unseen,
  count(*) filter (where c not in (select c from train)) / count(*) as unseen_rate, coalesce(string_agg(distinct c, '' order by c) filter (where c not in (select c from train)), '') as unseen_characters from chars group by split""",
)
def char_stats_by_split(spark, folder):
    return vo.character_stats(records(spark, folder))


@add(
    "char_inventory",
    rf"""{WITH}, seen as (select distinct unnest({CHARS}) as c from records where split = 'train')
  select case when ascii(c) between 2944 and 3071 then 'tamil_block' when regexp_full_match(c, '[0-9]') then 'ascii_digit' when regexp_full_match(c, '[A-Za-z]') then 'ascii_latin'
    when ascii(c) < 128 then 'ascii_other' when regexp_full_match(c, '{SPACE}') then 'whitespace' else 'other_non_tamil' end as class, count(*) as characters from seen group by 1""",
)
def char_inventory(spark, folder):
    seen = _train(spark, folder).where("text <> ''").select(F.explode(tx.characters(F.col("text"))).alias("c")).distinct()
    return seen.groupBy(tx.inventory_class(F.col("c")).alias("class")).agg(F.count("*").alias("characters"))


SCRIPT = rf"""case when regexp_full_match(c, '{SPACE}') then 'whitespace' when ascii(c) between 2944 and 3071 then 'tamil'
  when regexp_full_match(c, '[A-Za-z\x{{c0}}-\x{{24f}}\x{{1e00}}-\x{{1eff}}]') then 'latin' when regexp_full_match(c, '\p{{Nd}}') then 'digit'
  when regexp_full_match(c, '\p{{P}}') then 'punctuation' when regexp_full_match(c, '\p{{S}}') then 'symbol' else 'other' end"""


@add(
    "script_histogram",
    f"""{WITH}, seen as (select distinct unnest(regexp_extract_all(nfc_normalize(text), '(?s).')) as c from records), classed as (select {SCRIPT} as script from seen),
  names as (select unnest(['tamil', 'latin', 'digit', 'punctuation', 'symbol', 'whitespace', 'other']) as script)
  select script, (select count(*) from classed k where k.script = names.script) as characters from names""",
)
def script_histogram(spark, folder):
    return vo.script_histogram(records(spark, folder))


@add(
    "scripts_in_order",
    f"""{WITH}, chars as (select row_id, unnest(regexp_extract_all(nfc_normalize(text), '(?s).')) as c, generate_subscripts(regexp_extract_all(nfc_normalize(text), '(?s).'), 1) as i from records where text <> ''),
  firsts as (select row_id, {SCRIPT} as script, min(i) as i from chars group by 1, 2), joined as (select row_id, string_agg(script, ',' order by i) as scripts from firsts group by row_id)
  select row_id, coalesce(scripts, '') as scripts from records left join joined using (row_id)""",
)
def scripts_in_order(spark, folder):
    return records(spark, folder).select("row_id", F.array_join(vo.scripts_in_order(F.col("text")), ",").alias("scripts"))


@add(
    "word_oov_by_split",
    f"""{WITH}, w as (select split, unnest({WORDS}) as word from records), train as (select distinct word from w where split = 'train')
  select split, count(*) as tokens, count(distinct word) as distinct_words, count(*) filter (where word not in (select word from train)) as unseen, count(*) filter (where word not in (select word from train)) / count(*) as rate from w group by split""",
)
def word_oov_by_split(spark, folder):
    return vo.unseen_words(records(spark, folder))


@add(
    "oov_top_n_curve",
    f"""{WITH}, w as (select row_id, split, unnest({WORDS}) as word from records), ranks as (select word, row_number() over (order by count(*) desc, encode(word)) as rank from w where split = 'train' group by word),
  held as (select row_id, split, coalesce(rank, 4611686018427387904) as rank from w left join ranks using (word)), tops as (select unnest({list(vo.TOP)}) as top),
  worst as (select row_id, split, max(rank) as rank from held group by all), u as (select top, split, count(*) filter (where rank > top) as unseen_utterances from worst, tops group by all),
  t as (select top, split, count(*) filter (where rank > top) as unseen, count(*) as tokens from held, tops group by all), n as (select split, count(*) as utterances from records group by split)
  select cast(top as integer) as top, split, unseen, unseen_utterances, utterances, tokens from t join u using (top, split) join n using (split)""",
)
def oov_top_n_curve(spark, folder):
    return vo.coverage_curve(records(spark, folder))


@add(
    "oov_utterances",
    f"""{WITH}, w as (select row_id, split, unnest({WORDS}) as word from records), train as (select distinct word from w where split = 'train')
  select distinct row_id, split from w where word not in (select word from train)""",
)
def oov_utterances(spark, folder):
    tokens = records(spark, folder).select("row_id", "split", F.explode(tx.words(F.col("text"))).alias("word"))
    known = tokens.where("split = 'train'").select("word").distinct()
    return tokens.join(known, "word", "left_anti").select("row_id", "split").distinct()


@add(
    "top_oov_words",
    f"""{WITH}, w as (select split, unnest({WORDS}) as word from records), train as (select distinct word from w where split = 'train')
  select word, count(*) as times from w where split <> 'train' and word not in (select word from train) group by word order by times desc, encode(word) limit 10""",
)
def top_oov_words(spark, folder):
    tokens = records(spark, folder).select("split", F.explode(tx.words(F.col("text"))).alias("word"))
    known = tokens.where("split = 'train'").select("word").distinct()
    lost = tokens.where("split <> 'train'").join(known, "word", "left_anti").groupBy("word").agg(F.count("*").alias("times"))
    return lost.orderBy(F.col("times").desc(), "word").limit(10)


@add(
    "rarest_symbols",
    f"{WITH}, {VOCAB} select symbol, count from vocab order by count, encode(symbol) limit 20",
)
def rarest_symbols(spark, folder):
    return vo.symbol_counts(_train(spark, folder)).orderBy("count", "symbol").limit(20)


def _edits(a: str, b: str) -> str:
    """SQL of the edit distance of two lists of numbers: rows of the table of distances, one after the other."""
    step = f"list_min(list_transform(range(0, j + 1), lambda k: case when k = 0 then r[1] + 1 else least(r[k + 1] + 1, r[k] + ({b}[k] <> x[1])::int) end + (j - k)))"
    return f"list_reduce(list_concat([range(0, len({b}) + 1)], list_transform({a}, lambda x: [x])), lambda r, x: list_transform(range(0, len({b}) + 1), lambda j: {step}))[-1]"


RATED = f"""coded as (select split, list_transform(regexp_extract_all(reference, '(?s).'), lambda c: ascii(c)::bigint) as a, list_transform(regexp_extract_all(hypothesis, '(?s).'), lambda c: ascii(c)::bigint) as b,
    string_split(reference, ' ') as u, string_split(hypothesis, ' ') as v from pairs),
  worded as (select *, list_distinct(list_concat(u, v)) as every from coded),
  numbered as (select *, list_transform(u, lambda w: list_position(every, w)::bigint) as m, list_transform(v, lambda w: list_position(every, w)::bigint) as n from worded),
  rated as (select split, len(a) as tokens, {_edits("a", "b")} as e, len(m) as words, {_edits("m", "n")} as w from numbered),
  rates as (select split, count(*) as utterances, cast(sum(e) as bigint) as token_errors, cast(sum(tokens) as bigint) as tokens, avg((e = 0)::int) as exact, sum(w) / sum(words) as word_error_rate from rated group by split)
  select *, case when tokens > 0 then token_errors / tokens else 1 end as token_error_rate, case when tokens > 0 then token_errors / tokens else 1 end <= 0.1 as accepted from rates"""
#: Each utterance's transcript and that of its next row
NEXT = f"""{WITH}, every_pair as (select split, text as reference, lead(text) over (partition by utterance_id order by row_id) as hypothesis from records where utterance_id is not null),
  pairs as (select * from every_pair where hypothesis is not null)"""
#: Transcripts of utterances that came again and what a vocabulary of 30 symbols leaves of them
ROUND = f"""{WITH}, {VOCAB}, small as (select * from vocab where id <= 31),
  again as (select row_id, split, text from records where utterance_id in (select utterance_id from records group by utterance_id having count(*) > 1)),
  chars as (select row_id, unnest(regexp_extract_all(p, '(?s).')) as symbol, generate_subscripts(regexp_extract_all(p, '(?s).'), 1) as i from prepared where p <> '' and row_id in (select row_id from again)),
  known as (select row_id, string_agg(symbol, '' order by i) as decoded from chars join small using (symbol) group by row_id),
  pairs as (select split, text as reference, coalesce(decoded, '') as hypothesis from again left join known using (row_id))"""


def _next_rows(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("utterance_id").orderBy("row_id")
    rows = records(spark, folder).where("utterance_id is not null").withColumn("hypothesis", F.lead("text").over(w))
    return rows.where("hypothesis is not null").withColumnRenamed("text", "reference")


@add("token_error_rate", f"{NEXT}, figures as (with {RATED}) select cast(sum(utterances) as bigint) as utterances, cast(sum(token_errors) as bigint) as token_errors, cast(sum(tokens) as bigint) as tokens from figures")
def token_error_rate(spark, folder):
    """Each utterance's whole transcript against that of its next row."""
    return de.error_rates(_next_rows(spark, folder).withColumn("g", F.lit(0)), ["g"]).select("utterances", "token_errors", "tokens")


def _accepted(rates):
    return rates.withColumn("accepted", de.accepted(F.col("token_error_rate")))


@add("word_error_rate", f"{NEXT}, {RATED}")
def word_error_rate(spark, folder):
    """The same pairs by split, and whether a split's token error rate is accepted."""
    return _accepted(de.error_rates(_next_rows(spark, folder), ["split"]))


@add("decoded_error_rate", f"{ROUND}, {RATED}")
def decoded_error_rate(spark, folder):
    """What a vocabulary of 30 symbols loses of the transcripts of utterances that came again, by split."""
    vocab = vo.vocabulary(_train(spark, folder), vo.TokenizerConfig(max_symbols=30))
    rows = records(spark, folder)
    again = rows.groupBy("utterance_id").agg(F.count("*").alias("n")).where("n > 1").select("utterance_id")
    held = vo.encode(rows.join(again, "utterance_id", "left_semi"), vocab).withColumn("hypothesis", vo.decode(F.col("ids"), vocab))
    return _accepted(de.error_rates(held.withColumnRenamed("text", "reference"), ["split"]))


@add("char_lengths", f"{WITH} select row_id, length(text) as characters, length({UNSPACED}) as filled, len({WORDS}) as words from records")
def char_lengths(spark, folder):
    t = F.col("text")
    return records(spark, folder).select("row_id", F.length(t).cast("long").alias("characters"), F.length(tx.unspaced(t)).cast("long").alias("filled"), F.size(tx.words(t)).cast("long").alias("words"))
