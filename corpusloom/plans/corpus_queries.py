"""Queries on manifests: summaries, identity, feasibility, curation and splits."""

from corpusloom.model import network
from corpusloom.operators import feasibility as fe
from corpusloom.operators import manifest as mf
from corpusloom.operators import splits
from corpusloom.operators.grouped import global_rank
from corpusloom.plans.common import RECORDS, SPACE, UNSPACED, WORDS, records
from corpusloom.plans.registry import Registry, table
from corpusloom.sources import corpus
from pyspark.sql import functions as F

REGISTRY = Registry()
add = REGISTRY.add
WITH = f"with {RECORDS}"
FRAMES = "(1 + cast(floor(floor(duration_seconds * 16000 + 0.5) / 160) as bigint))"
LABELS = {"word": f"len({WORDS})", "char_no_space": f"length({UNSPACED})", "char_with_space": "length(text)"}
SUMMARY = """select split, count(*) as utterances, count(distinct speaker_id) as speakers, cast(sum(cast(round(duration_seconds * 1000000) as hugeint)) as double) / 3.6e9 as hours,
  count(*) filter (where text = '') as empty_transcripts, min(duration_seconds) as shortest, max(duration_seconds) as longest, median(duration_seconds) as median,
  array_to_string(list_sort(list(distinct sample_rate) filter (where sample_rate is not null)), ',') as sample_rates"""


@add(
    "manifest_summary",
    f"""{WITH}, twice as (select * from records union all by name select * replace ('total' as split) from records),
  main as ({SUMMARY} from twice group by split), named as (select split, prefix, count(*) as n from twice group by all),
  joined as (select split, string_agg(prefix || '=' || n, ',' order by prefix) as prefixes from named group by split)
  select main.*, prefixes from main join joined using (split)""",
)
def manifest_summary(spark, folder):
    return mf.summary(records(spark, folder))


@add("prefix_counts", f"{WITH} select split, prefix, count(*) as utterances from records group by all")
def prefix_counts(spark, folder):
    return records(spark, folder).groupBy("split", "prefix").agg(F.count("*").alias("utterances"))


@add("speaker_counts", f"{WITH} select split, count(*) as utterances, count(distinct speaker_id) as speakers from records group by split")
def speaker_counts(spark, folder):
    return splits.counts(records(spark, folder))


@add(
    "speaker_overlap",
    f"""{WITH}, pairs as (select distinct speaker_id, split, case split when 'train' then 1 when 'dev' then 2 when 'test' then 3 else 0 end as p from records)
  select a.split as split_a, b.split as split_b, count(*) as speakers from pairs a join pairs b using (speaker_id) where a.p < b.p group by all""",
)
def speaker_overlap(spark, folder):
    return mf.shared_speakers(records(spark, folder))


@add("disjoint_check", f"{WITH} select speaker_id, count(distinct split) as splits from records group by speaker_id having count(distinct split) > 1")
def disjoint_check(spark, folder):
    return mf.split_speakers(records(spark, folder))


@add(
    "duplicate_ids",
    f"{WITH}, f as (select *, min(row_id) over (partition by utterance_id) as first_row from records) select utterance_id, row_id, first_row from f where row_id > first_row",
)
def duplicate_ids(spark, folder):
    return mf.repeated_ids(records(spark, folder))


@add("id_set_difference", f"{WITH} select utterance_id from records where delivery <= 4 except select utterance_id from records where delivery <= 2")
def id_set_difference(spark, folder):
    rows = records(spark, folder)
    return rows.where("delivery <= 4").select("utterance_id").subtract(rows.where("delivery <= 2").select("utterance_id"))


@add("id_set_intersection", f"{WITH} select utterance_id from records where delivery <= 2 intersect select utterance_id from records where delivery >= 3")
def id_set_intersection(spark, folder):
    rows = records(spark, folder)
    return rows.where("delivery <= 2").select("utterance_id").intersect(rows.where("delivery >= 3").select("utterance_id"))


@add(
    "row_equality_join",
    """select a.utterance_id from manifest a join corpus_files b on a.utterance_id = b.utterance_id
  where (a.speaker_id, a.prefix, a.shipped_split, a.audio_path) is distinct from (b.speaker_id, b.prefix, b.shipped_split, b.audio_path)""",
)
def row_equality_join(spark, folder):
    return mf.changed_rows(table(spark, folder, "manifest"), table(spark, folder, "corpus_files"), "utterance_id", ["speaker_id", "prefix", "shipped_split", "audio_path"])


@add(
    "systematic_sample",
    f"""{WITH}, ids as (select utterance_id, row_number() over (order by utterance_id) as rank from (select distinct utterance_id from records)),
  n as (select greatest(1, count(*) // 2000) as step from ids) select utterance_id, rank from ids, n where (rank - 1) % step = 0 and rank <= step * 2000""",
)
def systematic_sample(spark, folder):
    return mf.every_nth(records(spark, folder), "utterance_id", 2000)


@add(
    "sampled_rows",
    f"""{WITH}, ids as (select utterance_id, row_number() over (order by utterance_id) as rank from (select distinct utterance_id from records)),
  n as (select greatest(1, count(*) // 2000) as step from ids), kept as (select utterance_id from ids, n where (rank - 1) % step = 0 and rank <= step * 2000)
  select row_id, utterance_id, duration_seconds from records where utterance_id in (select utterance_id from kept)""",
)
def sampled_rows(spark, folder):
    """All rows of the systematically sampled utterances."""
    rows = records(spark, folder)
    return rows.join(mf.every_nth(rows, "utterance_id", 2000).select("utterance_id"), "utterance_id", "left_semi").select("row_id", "utterance_id", "duration_seconds")


@add(
    "subset_budget",
    f"""{WITH}, run as (select row_id, cast(round(duration_seconds * 1000000) as bigint) as d, sum(cast(round(duration_seconds * 1000000) as bigint)) over (order by duration_seconds, row_id rows unbounded preceding) as until
  from records where split = 'train') select row_id, cast(until as bigint) as until from run where until - d < 900000000""",
)
def subset_budget(spark, folder):
    return mf.budget(records(spark, folder).where("split = 'train'"), "row_id", "duration_seconds", 900.0).select("row_id", "until")


@add(
    "subset_stats",
    f"{WITH} select split, count(*) as n, sum(cast(round(duration_seconds * 1000000) as bigint))::bigint as micros, count(distinct speaker_id) as speakers, min(duration_seconds) as shortest, max(duration_seconds) as longest from records where duration_seconds <= 6 group by split",
)
def subset_stats(spark, folder):
    return records(spark, folder).where("duration_seconds <= 6").groupBy("split").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("duration_seconds") * 1_000_000).cast("long")).alias("micros"), F.count_distinct("speaker_id").alias("speakers"),
        F.min("duration_seconds").alias("shortest"), F.max("duration_seconds").alias("longest"),
    )


def _shared(rows):
    """SQL of the speakers that two splits share, a row for each pair of splits."""
    pairs = (("train", "dev"), ("train", "test"), ("dev", "test"))
    one = "select 'no speaker in both {a} and {b}' as name, count(*) as detail from (select speaker_id from {rows} where split in ('{a}', '{b}') group by speaker_id having count(distinct split) = 2)"
    return " union all ".join(one.format(a=a, b=b, rows=rows) for a, b in pairs)


STATED = """told as (select split, count(*) as utterances, count(distinct speaker_id) as speakers, sum(duration_seconds) / 3600 as hours from {told} group by split
    union all select 'total', count(*), count(distinct speaker_id), sum(duration_seconds) / 3600 from {told}),
  real as (select split, count(*) as utterances, count(distinct speaker_id) as speakers, sum(duration_seconds) / 3600 as hours from {real} group by split
    union all select 'total', count(*), count(distinct speaker_id), sum(duration_seconds) / 3600 from {real}),
  compared as (select split, real.utterances, told.utterances as stated_utterances, coalesce(real.utterances = told.utterances, false) as same_utterances, coalesce(real.speakers = told.speakers, false) as same_speakers,
    coalesce(abs(real.hours - told.hours) <= 0.01, false) as same_hours from real full join told using (split))"""
CHECKS = f"""{WITH}, earlier as (select * from records where delivery <= 5), {STATED.format(told="earlier", real="records")},
  speakers as (select speaker_id from records group by 1 having count(distinct split) > 1),
  checks as (select 'utterance ids are unique' as name, count(*) - count(distinct utterance_id) as detail from records
    union all select 'splits share no speaker', count(*) from speakers
    union all select 'no transcript is empty', count(*) from records where regexp_replace(text, '{SPACE}', '', 'g') = ''
    union all select 'no replacement character', count(*) from records where contains(text, chr(65533))
    union all select 'paths are relative', count(*) from records where audio_path is null or starts_with(audio_path, '/') or regexp_matches(audio_path, '^[A-Za-z]:')
    union all select 'sample rate is canonical', count(*) from records where sample_rate is distinct from 16000
    union all select 'split names are known', count(*) from records where split not in ('train', 'dev', 'test')
    union all {_shared("records")}
    union all select 'splits have the stated rows', count(*) from compared where split <> 'total' and not same_utterances
    union all select 'speakers are as stated', count(*) from compared where split = 'total' and not same_speakers
    union all select 'hours are as stated', count(*) from compared where not same_hours
    union all select 'recordings exist', count(*) from records r where not exists (select 1 from corpus_files c where c.utterance_id = r.utterance_id))"""


def _checks(spark, folder):
    """Against the figures of the deliveries before the last and the recordings on disk."""
    rows = records(spark, folder)
    return mf.integrity(rows, mf.summary(rows.where("delivery <= 5")), table(spark, folder, "corpus_files"))


@add("manifest_checks", f"{CHECKS} select name, detail = 0 as ok, cast(detail as bigint) as detail from checks")
def manifest_checks(spark, folder):
    return _checks(spark, folder)


@add("check_tally", f"{CHECKS} select count(*) filter (where detail = 0) as passed, count(*) filter (where detail <> 0) as failed, 0::bigint as pending from checks")
def check_tally(spark, folder):
    return mf.tally(_checks(spark, folder))


@add("stated_figures", f"{WITH}, earlier as (select * from records where delivery <= 5), {STATED.format(told='earlier', real='records')} select * from compared")
def stated_figures(spark, folder):
    """Figures of all deliveries against those stated before the last one."""
    rows = records(spark, folder)
    return mf.compare_stats(rows, mf.summary(rows.where("delivery <= 5")))


@add("utf8_replacement_check", "select row_id from manifest where contains(text, chr(65533))")
def utf8_replacement_check(spark, folder):
    return table(spark, folder, "manifest").where(F.contains("text", F.lit("�"))).select("row_id")


@add("files_without_record", "select utterance_id, audio_path from corpus_files c where not exists (select 1 from manifest m where m.utterance_id = c.utterance_id)")
def files_without_record(spark, folder):
    return mf.missing_files(table(spark, folder, "manifest"), table(spark, folder, "corpus_files"))[1].select("utterance_id", "audio_path")


@add("records_without_file", "select row_id, utterance_id from manifest m where not exists (select 1 from corpus_files c where m.utterance_id = c.utterance_id)")
def records_without_file(spark, folder):
    return mf.missing_files(table(spark, folder, "manifest"), table(spark, folder, "corpus_files"))[0].select("row_id", "utterance_id")


@add(
    "transcript_join",
    r"""with f as (select utterance_id, shipped_split, audio_path, text_path from corpus_files),
  audio as (select shipped_split, regexp_extract(audio_path, '([^/]+)\.[^./]*$', 1) as stem from f where audio_path is not null), texts as (select distinct shipped_split, regexp_extract(text_path, '([^/]+)\.[^./]*$', 1) as stem from f where text_path is not null)
  select a.shipped_split, count(*) as recordings, count(t.stem) as with_transcript from audio a left join texts t on a.stem = t.stem and a.shipped_split is not distinct from t.shipped_split group by a.shipped_split""",
)
def transcript_join(spark, folder):
    """Recordings and transcripts of a split meet on the stems of their file names."""
    files = table(spark, folder, "corpus_files")
    stems = lambda c: files.where(F.col(c).isNotNull()).select("shipped_split", F.regexp_extract(c, r"([^/]+)\.[^./]*$", 1).alias("stem"))
    audio, texts = stems("audio_path"), stems("text_path").distinct().withColumnsRenamed({"shipped_split": "s", "stem": "t"})
    met = audio.join(texts, (audio["stem"] == texts["t"]) & audio["shipped_split"].eqNullSafe(texts["s"]), "left")
    return met.groupBy("shipped_split").agg(F.count("*").alias("recordings"), F.count("t").alias("with_transcript"))


@add(
    "filename_parse",
    r"""select utterance_id, regexp_extract(utterance_id, '^([A-Za-z]+)_([0-9]+)_([0-9]+)$', 1) as prefix, regexp_extract(utterance_id, '^([A-Za-z]+)_([0-9]+)_([0-9]+)$', 2) as speaker_id,
  regexp_extract(utterance_id, '^([A-Za-z]+)_([0-9]+)_([0-9]+)$', 3) as utterance from corpus_files where regexp_full_match(utterance_id, '[A-Za-z]+_[0-9]+_[0-9]+')""",
)
def filename_parse(spark, folder):
    rows = table(spark, folder, "corpus_files").select("utterance_id", corpus.parse_stem(F.col("utterance_id"), strict=False).alias("s"))
    return rows.where("s is not null").select("utterance_id", "s.*")


@add(
    "relative_path",
    r"""with slashed as (select row_id, replace(audio_path, '\', '/') as path from manifest)
  select row_id, case when starts_with(path, 'raw/') then substr(path, 5) else path end as path, list_last(string_split(path, '/')) as filename from slashed""",
)
def relative_path(spark, folder):
    """Of every row; a row without path has neither path nor filename."""
    path = F.col("audio_path")
    name = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    return table(spark, folder, "manifest").select("row_id", corpus.relative(path, "raw").alias("path"), name.alias("filename"))


@add("sha256_text", "select row_id, sha256(text) as sha256 from manifest")
def sha256_text(spark, folder):
    return table(spark, folder, "manifest").select("row_id", F.sha2("text", 256).alias("sha256"))


# Feasibility and curation

GRID = "select row_id, split, speaker_id, duration_seconds, {frames} as frames, {rate} as rate, unit, labels from records, lateral (select unnest(['word', 'char_no_space', 'char_with_space']) as unit, unnest([{word}, {char_no_space}, {char_with_space}]) as labels)".format(
    frames=FRAMES, rate=f"length({UNSPACED}) / duration_seconds", **LABELS
)
HAVE = "greatest(1, cast(ceil(frames / (stride + 0.0)) as bigint))"
VIOLATIONS = f"""{WITH}, grid as ({GRID}), held as (select *, greatest(1, cast(ceil(frames / 4.0) as bigint)) as encoder_frames from grid where unit <> 'word'),
  violators as (select *, case when rate >= 60 then 'corrupt_transcript' else 'fast_speech_below_encoder_resolution' end as reason from held where encoder_frames < labels)"""


@add(
    "ctc_feasibility",
    f"""{WITH}, grid as ({GRID}), strides as (select unnest([4, 8, 16, 32]) as stride), held as (select unit, stride, {HAVE} as have, labels, {HAVE} / labels as ratio from grid, strides where labels > 0),
  ranked as (select *, row_number() over (partition by unit, stride order by ratio) - 1 as i, count(*) over (partition by unit, stride) as n from held)
  select unit, cast(stride as integer) as stride, count(*) as utterances, count(*) filter (where have < labels) as violations, count(*) filter (where have >= labels and ratio < 2) as tight,
  min(ratio) as ratio_min, max(ratio) filter (where i = n // 20) as ratio_p05, max(ratio) filter (where i = n // 2) as ratio_median from ranked group by unit, stride""",
)
def ctc_feasibility(spark, folder):
    return fe.per_stride(records(spark, folder))


def _violations(spark, folder):
    rows = records(spark, folder)
    out = [fe.violations(rows, u).withColumn("variant", F.lit(u)) for u in ("char_no_space", "char_with_space")]
    return out[0].unionByName(out[1])


@add("ctc_violations", f"{VIOLATIONS} select row_id, unit as variant, cast(encoder_frames as integer) as encoder_frames, cast(labels as integer) as labels, rate, reason from violators")
def ctc_violations(spark, folder):
    return _violations(spark, folder).select("row_id", "variant", "encoder_frames", "labels", "rate", "reason")


@add("violation_counts", f"{VIOLATIONS} select unit as variant, reason, count(*) as utterances from violators group by all")
def violation_counts(spark, folder):
    return _violations(spark, folder).groupBy("variant", "reason").agg(F.count("*").alias("utterances"))


@add("ctc_eligible_rows", f"{WITH}, grid as ({GRID}) select split, count(*) as eligible from grid where unit = 'char_with_space' and greatest(1, ceil(frames / 4.0)) >= labels group by split")
def ctc_eligible_rows(spark, folder):
    return fe.labelled(records(spark, folder), "char_with_space").where("reason is null").groupBy("split").agg(F.count("*").alias("eligible"))


@add("ambiguity_check", f"{VIOLATIONS} select unit as variant, count(*) filter (where rate between 50 and 95) as ambiguous, count(*) as violators from violators group by unit")
def ambiguity_check(spark, folder):
    low, high = fe.AMBIGUOUS
    return _violations(spark, folder).groupBy("variant").agg(F.count_if(F.col("rate").between(low, high)).alias("ambiguous"), F.count("*").alias("violators"))


@add(
    "corrupt_set_symmetric_diff",
    f"""{VIOLATIONS}, a as (select row_id from violators where reason = 'corrupt_transcript' and unit = 'char_no_space'), b as (select row_id from violators where reason = 'corrupt_transcript' and unit = 'char_with_space')
  (select row_id from a except select row_id from b) union (select row_id from b except select row_id from a)""",
)
def corrupt_set_symmetric_diff(spark, folder):
    rows = records(spark, folder)
    a, b = (fe.corrupt(rows, u).select("row_id") for u in ("char_no_space", "char_with_space"))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@add("ineligible_ids", f"{VIOLATIONS} select distinct utterance_id from violators join records using (row_id) where reason <> 'corrupt_transcript'")
def ineligible_ids(spark, folder):
    return _violations(spark, folder).where("reason <> 'corrupt_transcript'").select("utterance_id").distinct()


@add(
    "removed_rows_anti",
    f"{VIOLATIONS} select row_id, split from records where row_id not in (select row_id from violators where reason = 'corrupt_transcript' and unit = 'char_no_space')",
)
def removed_rows_anti(spark, folder):
    return fe.curated(records(spark, folder)).select("row_id", "split")


@add(
    "dataset_curation",
    f"""{VIOLATIONS}, gone as (select row_id from violators where reason = 'corrupt_transcript' and unit = 'char_no_space'),
  kept as (select * from records where row_id not in (select row_id from gone)), main as ({SUMMARY} from kept group by split)
  select main.*, (select count(*) from gone join records r using (row_id) where r.split = main.split) as removed from main""",
)
def dataset_curation(spark, folder):
    rows = records(spark, folder)
    gone = fe.corrupt(rows).groupBy("split").agg(F.count("*").alias("removed"))
    return mf.summary(fe.curated(rows)).where("split <> 'total'").drop("prefixes").join(gone, "split", "left").fillna(0, ["removed"])


@add(
    "speaking_rate_percentiles",
    f"""{WITH}, grid as ({GRID}), rated as (select split, labels / duration_seconds as rate from grid where unit = 'char_no_space' and labels > 0),
  ranked as (select *, row_number() over (partition by split order by rate) - 1 as i, count(*) over (partition by split) as n from rated)
  select split, count(*) as utterances, max(rate) filter (where i = floor(n * 0.5::double)) as p50, max(rate) filter (where i = floor(n * 0.95::double)) as p95, max(rate) filter (where i = floor(n * 0.99::double)) as p99,
  max(rate) as fastest, count(*) filter (where rate > 15) as over_15, count(*) filter (where rate > 20) as over_20, count(*) filter (where rate > 25) as over_25, count(*) filter (where rate > 30) as over_30 from ranked group by split""",
)
def speaking_rate_percentiles(spark, folder):
    return fe.rate_audit(records(spark, folder), "char_no_space")


FAST = f"{WITH}, grid as ({GRID}), fast as (select row_id, split, speaker_id, rate from grid where unit = 'char_no_space' and labels > 0 order by rate desc, row_id limit "


def _fastest(spark, folder, n):
    rows = fe.labelled(records(spark, folder), "char_no_space").where("labels > 0")
    return rows.select("row_id", "split", "speaker_id", "rate").orderBy(F.col("rate").desc(), "row_id").limit(n)


@add("worst_20", f"{FAST} 20) select * from fast")
def worst_20(spark, folder):
    return _fastest(spark, folder, 20)


@add("worst_speakers", f"{FAST} 200) select speaker_id, count(*) as utterances from fast group by 1 order by 2 desc, 1 limit 10")
def worst_speakers(spark, folder):
    return _fastest(spark, folder, 200).groupBy("speaker_id").agg(F.count("*").alias("utterances")).orderBy(F.col("utterances").desc(), "speaker_id").limit(10)


@add(
    "sequence_lengths",
    f"""{WITH}, grid as ({GRID}), ranked as (select split, labels, row_number() over (partition by split order by labels) - 1 as i, count(*) over (partition by split) as n from grid where unit = 'char_no_space')
  select split, count(*) as count, cast(sum(labels) as bigint) as total, cast(max(labels) as bigint) as longest, sum(labels) / count(*) as mean, cast(max(labels) filter (where i = n // 2) as bigint) as median from ranked group by split""",
)
def sequence_lengths(spark, folder):
    return fe.length_report(records(spark, folder), "char_no_space")


@add("floor_exact_disagreement", f"{WITH} select count(*) filter (where {FRAMES} // 4 <> greatest(1, ceil({FRAMES} / 4.0))) as disagree, count(*) as utterances from records")
def floor_exact_disagreement(spark, folder):
    frames = fe.stft_frames(F.col("duration_seconds"), half_up=True)
    rows = records(spark, folder).select((F.floor(frames / 4) != fe.encoder_frames(frames, 2)).alias("d"))
    return rows.agg(F.count_if("d").alias("disagree"), F.count("*").alias("utterances"))


@add("length_math", f"{WITH}, f as (select distinct {FRAMES} as frames from records), one as (select frames, greatest(1, (frames + 2 - 3) // 2 + 1) as once from f) select cast(frames as integer) as frames, cast(greatest(1, (once - 1) // 2 + 1) as integer) as exact, cast(greatest(1, ceil(frames / 4.0)) as integer) as ceiling from one")
def length_math(spark, folder):
    frames = records(spark, folder).select(fe.stft_frames(F.col("duration_seconds"), half_up=True).alias("frames")).distinct()
    return frames.select("frames", fe.subsampled(F.col("frames"), [(3, 2, 1), (3, 2, 1)]).alias("exact"), fe.encoder_frames(F.col("frames"), 2).alias("ceiling"))


@add(
    "fc_cost",
    "select cast(n as integer) as symbols, cast(256 * (n + 1) + (n + 1) as bigint) as parameters, (256 * (n + 1) + (n + 1)) * 4 / 1e6 as megabytes, (256 * (n + 1) + (n + 1)) * 4 / 1e6 < 100 as fits from (select unnest([47, 48, 10000, 138047]) as n)",
)
def fc_cost(spark, folder):
    n = F.col("symbols")
    rows = spark.createDataFrame([(k,) for k in (47, 48, 10_000, 138_047)], "symbols int").withColumn("parameters", (256 * (n + 1) + (n + 1)).cast("long"))
    return rows.withColumn("megabytes", F.col("parameters") * 4 / 1e6).withColumn("fits", F.col("megabytes") < 100)


# Splits


@add(
    "speaker_split_greedy",
    f"""with recursive {RECORDS}, sizes as (select speaker_id, count(*) as n, row_number() over (order by md5('1337|' || speaker_id)) as k, sum(count(*)) over () as total from records group by speaker_id),
  fold(k, speaker_id, utterances, split, a, b, c) as (
    select 0, '', 0, '', 0.9 * max(total)::double, 0.05 * max(total)::double, 0.05 * max(total)::double from sizes
    union all select s.k, s.speaker_id, s.n, case when a >= b and a >= c then 'train' when b >= c then 'dev' else 'test' end,
      case when a >= b and a >= c then a - s.n else a end, case when not (a >= b and a >= c) and b >= c then b - s.n else b end, case when not (a >= b and a >= c) and not b >= c then c - s.n else c end
    from fold join sizes s on s.k = fold.k + 1)
  select speaker_id, cast(utterances as bigint) as utterances, split from fold where k > 0""",
)
def speaker_split_greedy(spark, folder):
    return splits.plan(records(spark, folder), hashed=True)


@add("speaker_split_seeded")
def speaker_split_seeded(spark, folder):
    return splits.plan(records(spark, folder))


@add("speaker_split_counts")
def speaker_split_counts(spark, folder):
    rows = records(spark, folder)
    return splits.counts(splits.assign(rows, splits.plan(rows)))


@add("ordered_manifest", f"{WITH} select row_id, row_number() over (order by case split when 'train' then 1 when 'dev' then 2 when 'test' then 3 else 0 end, utterance_id, row_id) as rank from records")
def ordered_manifest(spark, folder):
    rows = records(spark, folder).select("row_id", "utterance_id", mf.split_position(F.col("split")).alias("p"))
    return global_rank(rows, [F.col("p"), F.col("utterance_id"), F.col("row_id")]).select("row_id", "rank")


@add(
    "latest_delivery",
    f"{WITH}, r as (select *, row_number() over (partition by utterance_id order by delivery desc, row_id desc) as k from records) select row_id, utterance_id from r where k = 1",
)
def latest_delivery(spark, folder):
    return mf.latest(records(spark, folder)).select("row_id", "utterance_id")


@add(
    "longest_by_speaker",
    f"{WITH}, r as (select speaker_id, row_id, row_number() over (partition by speaker_id order by duration_seconds desc, row_id) as rank from records) select speaker_id, row_id, cast(rank as integer) as rank from r where rank <= 3",
)
def longest_by_speaker(spark, folder):
    return mf.ranks_in(records(spark, folder), "speaker_id", [F.col("duration_seconds").desc(), F.col("row_id")], 3).select("speaker_id", "row_id", "rank")




CORRUPT = "select row_id from violators where reason = 'corrupt_transcript' and unit = 'char_no_space'"
#: A version made of all deliveries without corrupt rows, held against the deliveries before the last one
CURATION = f"""gone as ({CORRUPT}), old as (select * from records where delivery <= 5), kept as (select * from records where row_id not in (select row_id from gone)),
  marked_old as (select row_id, count(*) as n, min(hash(utterance_id, text, speaker_id, prefix, split, duration_seconds, sample_rate, dataset_id, audio_path, delivery)) as h from old group by row_id),
  marked_new as (select row_id, count(*) as n, min(hash(utterance_id, text, speaker_id, prefix, split, duration_seconds, sample_rate, dataset_id, audio_path, delivery)) as h from kept group by row_id),
  checks as (select 'nothing but the named rows is gone' as name, count(*) as detail from marked_old where row_id not in (select row_id from kept) and row_id not in (select row_id from gone)
    union all select 'all named rows are gone', count(*) from marked_new where row_id in (select row_id from gone)
    union all select 'named rows were there', count(*) from gone where row_id not in (select row_id from old)
    union all select 'no row is new', count(*) from marked_new where row_id not in (select row_id from old)
    union all select 'kept rows are unchanged', count(*) from marked_new k join marked_old o using (row_id) where k.h <> o.h
    union all select 'no row occurred twice before', count(*) from marked_old where n > 1 union all select 'no row occurs twice', count(*) from marked_new where n > 1
    union all select 'no speaker changed its splits', count(*) from (select distinct speaker_id, split from kept except select speaker_id, split from old)
    union all select 'no transcript is empty', count(*) from kept where regexp_replace(text, '{SPACE}', '', 'g') = ''
    union all select 'split names are known', count(*) from kept where split not in ('train', 'dev', 'test')
    union all {_shared("kept")})"""


def _version(spark, folder):
    rows = records(spark, folder)
    return rows.where("delivery <= 5"), fe.curated(rows), fe.corrupt(rows)


@add("curation_checks", f"{VIOLATIONS}, {CURATION} select name, detail = 0 as ok, cast(detail as bigint) as detail from checks")
def curation_checks(spark, folder):
    before, after, gone = _version(spark, folder)
    return mf.curation_checks(before, after, gone.select("row_id"))


@add(
    "version_checks",
    f"""{VIOLATIONS}, {CURATION}, counts as (select split, count(*) as n, count(distinct speaker_id) as k from kept group by split),
  document as (select 'the document declares the version' as name, 0 as detail union all select 'the document names the version before', 0 union all select 'the document counts what was removed', 0
    union all select 'the document ' || what || s, 0 from (select unnest(['counts the rows of ', 'sums the hours of ', 'counts the speakers of ']) as what), (select unnest(['train', 'dev', 'test']) as s)),
  fast as (select distinct utterance_id from violators join records using (row_id) where reason <> 'corrupt_transcript'),
  rest as (select 'recordings exist' as name, count(*) as detail from kept k where not exists (select 1 from corpus_files c where c.utterance_id = k.utterance_id)
    union all select 'published ids are in the version', count(*) from fast where utterance_id not in (select utterance_id from kept)
    union all select 'published ids were not removed', count(*) from fast where utterance_id in (select utterance_id from records where row_id in (select row_id from gone)))
  select name, detail = 0 as ok, cast(detail as bigint) as detail from (select * from checks union all select * from document union all select * from rest)""",
)
def version_checks(spark, folder):
    """All checks of a new version; its document is made by ``metadata`` and read back as JSON."""
    before, after, gone = _version(spark, folder)
    fast = _violations(spark, folder).where("reason <> 'corrupt_transcript'").select("utterance_id")
    document = mf.metadata(after, gone, "corpus", "v002", "v001")
    return mf.version_checks(before, after, gone, document, "v002", "v001", table(spark, folder, "corpus_files"), fast)


@add(
    "training_guards",
    f"""{WITH}, grid as ({GRID}) select 'no row is starved of frames' as name, count(*) filter (where greatest(1, ceil(frames / 4.0)) < labels) = 0 as ok, count(*) filter (where greatest(1, ceil(frames / 4.0)) < labels) as detail from grid where unit = 'char_with_space'
  union all select 'no row is without labels', count(*) filter (where labels = 0) = 0, count(*) filter (where labels = 0) from grid where unit = 'char_with_space'""",
)
def training_guards(spark, folder):
    return fe.training_guards(records(spark, folder))


@add(
    "length_probe",
    f"""{WITH}, f as (select distinct {FRAMES} as frames from records), r as (select frames, row_number() over (order by frames) as k, count(*) over () as n from f)
  select cast(frames as integer) as frames, cast(greatest(1, (greatest(1, (frames - 1) // 2 + 1) - 1) // 2 + 1) as bigint) as encoder_frames from r where k <= 6 or k > n - 6""",
)
def length_probe(spark, folder):
    """The shortest and longest utterances in frames, with what a model's layers leave of them."""
    frames = records(spark, folder).select(fe.stft_frames(F.col("duration_seconds"), half_up=True).alias("frames"))
    shape = network.Shape()
    probe = fe.length_probe(frames)
    return probe.select("frames", fe.subsampled(fe.subsampled(F.col("frames"), [shape.layers[0][1:]]), [shape.layers[1][1:]]).cast("long").alias("encoder_frames"))


@add("dataset_metadata")
def dataset_metadata(spark, folder):
    rows = records(spark, folder)
    return mf.metadata(fe.curated(rows), fe.corrupt(rows), "corpus", "v002", "v001", split_seed=20261003, ratios={"train": 0.9, "dev": 0.05, "test": 0.05})
