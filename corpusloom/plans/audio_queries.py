"""Queries on frames, segments and waveforms."""

import numpy as np
import pyarrow as pa
from corpusloom.config import Grid, SpeechRule, StftConfig
from corpusloom.model import network
from corpusloom.operators import frames as fr
from corpusloom.operators import levels as lv
from corpusloom.operators import spectral as sp
from corpusloom.plans.common import FRAMES, PARTS, clips, parts, speech
from corpusloom.plans.registry import Registry, table
from corpusloom.streaming import windows
from pyspark.sql import functions as F

REGISTRY = Registry()
add = REGISTRY.add

RAW = f"""{FRAMES}, floors as (select utt, quantile_cont(energy, 0.1) as floor from frames group by utt), raw as (select utt, frame, energy > floor + 50 as m from frames join floors using (utt))"""
SMOOTH = f"""{RAW}, voted as (select utt, frame, sum(m::int) over w + greatest(2 - frame, 0) * first(m::int) over p + greatest(2 - (count(*) over a - 1 - frame), 0) * last(m::int) over p > 2 as m from raw
  window w as (partition by utt order by frame rows between 2 preceding and 2 following), p as (partition by utt order by frame rows between unbounded preceding and unbounded following), a as (partition by utt))"""
HELD = f"{SMOOTH}, held as (select utt, frame, m or coalesce(frame - max(case when m then frame end) over (partition by utt order by frame rows unbounded preceding) <= 1, false) as m from voted)"
RUNS = f"""{HELD}, marked as (select *, case when m is distinct from lag(m) over (partition by utt order by frame) then 1 else 0 end as new from held),
  runs as (select *, sum(new) over (partition by utt order by frame rows unbounded preceding) as run from marked), long as (select utt, frame, m and count(*) over (partition by utt, run) >= 3 as m from runs)"""
SEGMENTS = f"""{RUNS}, marked2 as (select *, case when m is distinct from lag(m) over (partition by utt order by frame) then 1 else 0 end as new from long),
  runs2 as (select *, sum(new) over (partition by utt order by frame rows unbounded preceding) as run from marked2),
  segments as (select utt, min(frame) * 10 as s, max(frame) * 10 + 25 as e from runs2 where m group by utt, run)"""


def _merge(source, gap, name):
    return f"""{name}_a as (select *, max(e) over (partition by utt order by s, e rows between unbounded preceding and 1 preceding) as reach from {source}),
  {name}_b as (select *, sum(case when s - reach <= {gap} then 0 else 1 end) over (partition by utt order by s, e rows unbounded preceding) as g from {name}_a),
  {name} as (select utt, min(s) as s, max(e) as e from {name}_b group by utt, g)"""


def _raw(spark, folder):
    return fr.threshold(speech(spark, folder), "energy", 10, 50.0).select("utt", "frame", "is_speech")


def _long(spark, folder):
    return fr.drop_short(fr.hangover(fr.majority(_raw(spark, folder), 5), 1), 3)


def _out(frames):
    return frames.select("utt", F.col("frame").cast("long").alias("frame"), "is_speech")


@add("vad_threshold", f"with {RAW} select utt, frame, m as is_speech from raw")
def vad_threshold(spark, folder):
    return _out(_raw(spark, folder))


@add("vad_smooth", f"with {SMOOTH} select utt, frame, m as is_speech from voted")
def vad_smooth(spark, folder):
    return _out(fr.majority(_raw(spark, folder), 5))


@add("vad_hangover", f"with {HELD} select utt, frame, m as is_speech from held")
def vad_hangover(spark, folder):
    return _out(fr.hangover(fr.majority(_raw(spark, folder), 5), 1))


@add("vad_short_runs", f"with {RUNS} select utt, frame, m as is_speech from long")
def vad_short_runs(spark, folder):
    return _out(_long(spark, folder))


def _spans(df):
    return df.select("utt", F.col("start").cast("long").alias("start_ms"), F.col("end").cast("long").alias("end_ms"))


@add("vad_segments_merged", f"with {SEGMENTS}, {_merge('segments', 20, 'merged')} select utt, s as start_ms, e as end_ms from merged")
def vad_segments_merged(spark, folder):
    return _spans(fr.merge(fr.segments(_long(spark, folder), 10, 25), 20))


@add("vad_frames_to_segments", f"with {SEGMENTS} select utt, s as start_ms, e as end_ms from segments")
def vad_frames_to_segments(spark, folder):
    return _spans(fr.segments(_long(spark, folder), 10, 25))


@add("vad_speech_ratio", f"with {RUNS} select utt, count(*) as frames, count(*) filter (where m) as speech_frames, avg(m::int) as speech_ratio from long group by utt")
def vad_speech_ratio(spark, folder):
    held = _long(spark, folder)
    return held.groupBy("utt").agg(F.count("*").alias("frames"), F.count_if("is_speech").alias("speech_frames"), F.avg(F.col("is_speech").cast("int")).alias("speech_ratio"))


@add("segment_merge", f"with {PARTS}, {_merge('parts', 200, 'merged')} select utt, s as start_ms, e as end_ms from merged")
def segment_merge(spark, folder):
    return _spans(fr.merge(parts(spark, folder), 200))


@add(
    "segment_pad_clamp",
    f"""with {PARTS}, {_merge('parts', 200, 'merged')}, padded as (select utt, greatest(0, s - 50) as s, e + 50 as e from merged), {_merge('padded', 0, 'again')}
  select utt, s as start_ms, e as end_ms from again where e - s >= 100""",
)
def segment_pad_clamp(spark, folder):
    return _spans(fr.long_enough(fr.merge(fr.pad(fr.merge(parts(spark, folder), 200), 50), 0), 100))


@add("segment_short_filter", f"with {PARTS} select utt, s as start_ms, e as end_ms from parts where e - s >= 2000")
def segment_short_filter(spark, folder):
    return _spans(fr.long_enough(parts(spark, folder), 2000))


@add(
    "segment_overlap_coverage",
    f"""with {PARTS}, {_merge('parts', 0, 'left_side')}, {_merge('parts', 600, 'right_side')}
  select a.utt, cast(sum(least(a.e, b.e) - greatest(a.s, b.s)) as bigint) as shared_ms from left_side a join right_side b on a.utt = b.utt and a.s < b.e and b.s < a.e group by a.utt""",
)
def segment_overlap_coverage(spark, folder):
    rows = parts(spark, folder)
    return fr.overlaps(fr.merge(rows, 0), fr.merge(rows, 600), 5000).select("utt", F.col("seconds").cast("long").alias("shared_ms"))


@add("speech_seconds", f"with {PARTS}, {_merge('parts', 0, 'merged')} select utt, count(*) as segments, cast(sum(e - s) as bigint) as speech_ms from merged group by utt")
def speech_seconds(spark, folder):
    return fr.merge(parts(spark, folder), 0).groupBy("utt").agg(F.count("*").alias("segments"), F.sum(F.col("end") - F.col("start")).alias("speech_ms"))


# Waveforms: sums run over the samples in their order on both sides

WAVE = """wave as (select vec_id as utt, list_transform(embedding, lambda x: x::double) as x, embedding as f from embeddings),
  level as (select utt, x, f, list_max(list_transform(x, lambda v: abs(v))) as peak, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) as rms, list_sum(x) / len(x) as dc_offset,
  len(list_filter(x, lambda v: abs(v) >= 0.999::float)) / len(x) as clipping_ratio from wave)"""


@add(
    "loudness_report",
    f"""with {WAVE}, db as (select *, case when peak > 0 then 20 * log10(peak) else '-infinity'::double end as peak_dbfs, case when rms > 0 then 20 * log10(rms) else '-infinity'::double end as rms_dbfs from level)
  select utt, round(peak, 9) as peak, round(rms, 9) as rms, round(case when rms > 0 then peak / rms else 0 end, 6) as crest_factor, round(peak_dbfs, 6) as peak_dbfs, round(rms_dbfs, 6) as rms_dbfs,
  case when clipping_ratio > 0.001 then 'clipped' when rms_dbfs <= -80 then 'silent' when rms_dbfs < -50 then 'too_quiet' when peak_dbfs > -1 then 'too_loud' else 'normal' end as loudness from db""",
)
def loudness_report(spark, folder):
    held = lv.loudness(clips(spark, folder))
    return held.select("utt", F.round("peak", 9).alias("peak"), F.round("rms", 9).alias("rms"), F.round("crest_factor", 6).alias("crest_factor"), F.round("peak_dbfs", 6).alias("peak_dbfs"), F.round("rms_dbfs", 6).alias("rms_dbfs"), "loudness")


@add(
    "validation_issues",
    f"""with {WAVE} select utt, array_to_string(list_filter([case when clipping_ratio > 0.001 then 'clipped(warning)' end, case when rms <= 1e-7 then 'silent(error)' end,
  case when rms > 1e-7 and rms < 1e-5 then 'low_amplitude(warning)' end, case when abs(dc_offset) > 0.02 then 'dc_offset(warning)' end], lambda i: i is not null), '; ') as summary, rms > 1e-7 as ok from level""",
)
def validation_issues(spark, folder):
    held = lv.validate(clips(spark, folder), lv.LevelLimits(dc_offset=0.02))
    text = F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit("("), i["severity"], F.lit(")"))), "; ")
    return held.select("utt", text.alias("summary"), "ok")


@add("zero_crossing", "select vec_id as utt, list_sum(list_transform(range(1, len(embedding)), lambda i: case when (embedding[i] < 0) <> (embedding[i + 1] < 0) then 1 else 0 end)) / len(embedding) as rate from embeddings")
def zero_crossing(spark, folder):
    return clips(spark, folder).select("utt", lv.zero_crossing_rate(F.col("samples")).alias("rate"))


FRAMED = """framed as (select vec_id as utt, unnest(range(0, 4)) as frame, embedding from embeddings), rmss as (select utt, frame,
  sqrt(list_sum(list_transform(embedding[frame * 12 + 1 : frame * 12 + 25], lambda v: v::double * v)) / 25) as r from framed)"""


@add("frame_rms", f"with {FRAMED} select utt, cast(frame as integer) as frame, round(r, 9) as rms from rmss")
def frame_rms(spark, folder):
    framed = clips(spark, folder).select("utt", F.posexplode(lv.frame_rms(F.col("samples"), 25, 12)).alias("frame", "rms"))
    return framed.select("utt", "frame", F.round("rms", 9).alias("rms"))


@add("snr_percentile", f"with {FRAMED} select utt, round(greatest(quantile_cont(20 * log10(r), 0.9) - quantile_cont(20 * log10(r), 0.1), 0), 6) as snr_db from rmss where r > 0 group by utt")
def snr_percentile(spark, folder):
    framed = clips(spark, folder).select("utt", F.explode(lv.frame_rms(F.col("samples"), 25, 12)).alias("r")).where("r > 0")
    held = framed.groupBy("utt").agg(F.percentile(lv.dbfs(F.col("r")), F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    return held.select("utt", F.round(F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(0.0)), 6).alias("snr_db"))


@add("silence_ratio", f"with {FRAMED} select utt, avg((r <= 0 or 20 * log10(nullif(r, 0)) <= -18)::int) as silence_ratio from rmss group by utt")
def silence_ratio(spark, folder):
    framed = clips(spark, folder).select("utt", F.explode(lv.frame_rms(F.col("samples"), 25, 12)).alias("r"))
    return framed.groupBy("utt").agg(F.avg((lv.dbfs(F.col("r")) <= -18).cast("int")).alias("silence_ratio"))


# Gains: doubles become floats on both sides, so all samples agree but for the last bit of a power


def _gained(level, target):
    return f"""with {WAVE}, gained as (select utt, unnest(range(0, len(x))) as i, unnest(list_transform(x, lambda v: (v * pow(10, ({target} - 20 * log10({level})) / 20))::float)) as v from level where {level} > 0)
  select utt, cast(i as integer) as i, round(v::double, 5) + 0.0 as sample from gained"""


def _samples(held):
    return held.select("utt", F.posexplode("s").alias("i", "v")).select("utt", "i", (F.round(F.col("v").cast("double"), 5) + 0.0).alias("sample"))


@add("gain_peak_normalize", _gained("peak", -1))
def gain_peak_normalize(spark, folder):
    return _samples(clips(spark, folder).where(lv.peak(F.col("samples")) > 0).select("utt", lv.normalize_peak(F.col("samples"), -1.0).alias("s")))


@add("gain_rms_normalize", _gained("rms", -20))
def gain_rms_normalize(spark, folder):
    return _samples(clips(spark, folder).where(lv.rms(F.col("samples")) > 0).select("utt", lv.normalize_rms(F.col("samples")).alias("s")))


@add(
    "mel_scale",
    """with s as (select unnest(range(0, 8001, 50))::double as hz), m as (select hz, 2595 * log10(1 + hz / 700) as mel, case when hz < 1000 then hz * 3 / 200 else 15 + ln(hz / 1000) / (ln(6.4) / 27) end as slaney from s)
  select cast(hz as integer) as hz, round(mel, 9) as mel, round(700 * (pow(10, mel / 2595) - 1), 6) as back, round(slaney, 9) as slaney,
  round(case when slaney < 15 then slaney * 200 / 3 else 1000 * exp((slaney - 15) * ln(6.4) / 27) end, 6) as slaney_back from m""",
)
def mel_scale(spark, folder):
    def run(batches):
        for batch in batches:
            hz = batch.column(0).to_numpy().astype(float)
            mel, slaney = sp.hz_to_mel(hz), sp.hz_to_mel(hz, htk=False)
            yield pa.record_batch([pa.array(v) for v in (hz.astype(np.int32), mel, sp.mel_to_hz(mel), slaney, sp.mel_to_hz(slaney, htk=False))], ["hz", "mel", "back", "slaney", "slaney_back"])

    made = spark.range(0, 8001, 50).mapInArrow(run, "hz int, mel double, back double, slaney double, slaney_back double")
    return made.select("hz", *[F.round(c, d).alias(c) for c, d in (("mel", 9), ("back", 6), ("slaney", 9), ("slaney_back", 6))])


#: Rates that the clips are taken to have been recorded at
RATES = (8_000, 11_025, 22_050, 48_000)


@add(
    "resample",
    f"""with x as (select vec_id as utt, unnest(range(0, len(embedding))) as k, unnest(embedding)::double as v, len(embedding) as n from embeddings),
  r as (select unnest({list(RATES)}) as rate), cuts as (select rate, least(1.0::double, 16000 / rate) as cut, cast(ceil(32 / least(1.0::double, 16000 / rate)) as bigint) as reach from r),
  places as (select rate, cut, reach, i, i * rate / 16000 as pos from cuts, (select unnest(range(0, 128)) as i)),
  taps as (select rate, i, k, cut, reach, k - pos as off from places, (select unnest(range(0, 64)) as k) where k between floor(pos) - reach and floor(pos) + reach),
  kernel as (select rate, i, k, cut * (case when off = 0 then 1 else sin(pi() * cut * off) / (pi() * cut * off) end) * (0.5 + 0.5 * cos(pi() * off / (reach + 1))) as w from taps)
  select utt, rate, cast(i as integer) as i, round(cast(sum(v * w) as float)::double, 5) + 0.0 as sample from kernel join x using (k) where i < ceil(n * 16000 / rate) group by utt, rate, i""",
)
def resample(spark, folder):
    rows = clips(spark, folder).drop("sample_rate").withColumn("sample_rate", F.explode(F.lit(list(RATES))))
    made = None
    for rate in RATES:
        one = _samples(sp.resampled(rows.where(F.col("sample_rate") == rate)).withColumnRenamed("samples", "s")).withColumn("rate", F.lit(rate))
        made = one if made is None else made.unionByName(one)
    return made


@add("resample_identity", "select vec_id as utt, list_sum(list_transform(embedding, lambda v: v::double)) as total, len(embedding) as samples from embeddings")
def resample_identity(spark, folder):
    held = sp.resampled(clips(spark, folder))
    return held.select("utt", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), F.size("samples").cast("long").alias("samples"))


# Spectra: five centred frames of 32 samples a clip, in a transform of 64 points, written out in SQL

SMALL = StftConfig(n_fft=64, win_length=32, hop_length=16)
DFT = """x as (select vec_id as utt, unnest(range(0, 64)) as i, unnest(embedding)::double as v from embeddings),
  grid as (select f, t, 0.5 - 0.5 * cos(2 * pi() * t / 32) as w, 16 * f + t - 16 as pos from (select unnest(range(0, 5)) as f), (select unnest(range(0, 32)) as t)),
  mirrored as (select f, t, w, case when pos < 0 then -pos when pos > 63 then 126 - pos else pos end as i from grid),
  turned as (select f, i, k, w * cos(2 * pi() * k * (t + 16) / 64) as c, w * sin(2 * pi() * k * (t + 16) / 64) as s from mirrored, (select unnest(range(0, 33)) as k)),
  parts as (select utt, f, k, sum(v * c) as re, sum(v * s) as im from x join turned using (i) group by utt, f, k), spectrum as (select utt, f, k, re * re + im * im as power, sqrt(re * re + im * im) as size from parts)"""


@add(
    "spectral_stats",
    f"""with {DFT}, grown as (select *, k * 250.0::double as hz, sum(size) over (partition by utt, f order by k) as grown, sum(size) over (partition by utt, f) as total from spectrum),
  centres as (select utt, f, sum(size * hz) / max(greatest(total, 1e-12)) as centre, exp(avg(ln(greatest(size, 1e-12)))) / avg(greatest(size, 1e-12)) as flat, min(case when grown >= 0.85 * total then hz end) as edge from grown group by utt, f),
  spreads as (select g.utt, g.f, sqrt(sum(size * (hz - centre) * (hz - centre)) / max(greatest(total, 1e-12))) as spread from grown g join centres c on g.utt = c.utt and g.f = c.f group by g.utt, g.f)
  select utt, round(avg(centre), 6) as centroid, round(avg(spread), 6) as bandwidth, round(avg(edge), 6) as rolloff, round(avg(flat), 9) as flatness from centres join spreads using (utt, f) group by utt""",
)
def spectral_stats(spark, folder):
    held = sp.quality(clips(spark, folder), SMALL)
    return held.select("utt", *[F.round(c, d).alias(c) for c, d in (("centroid", 6), ("bandwidth", 6), ("rolloff", 6), ("flatness", 9))])


@add(
    "log_mel",
    f"""with {DFT}, edges as (select b, 700 * (pow(10, (2595 * log10(1 + 8000.0::double / 700)) * b / 9 / 2595) - 1) as hz from (select unnest(range(0, 10)) as b)),
  bands as (select l.b as band, l.hz as low, m.hz as mid, h.hz as high from edges l join edges m on m.b = l.b + 1 join edges h on h.b = l.b + 2),
  weights as (select band, k, greatest(0, least((k * 250.0::double - low) / (mid - low), (high - k * 250.0::double) / (high - mid))) as w from bands, (select unnest(range(0, 33)) as k))
  select utt, cast(f as integer) as frame, cast(band as integer) as band, round(cast(ln(sum(power * w) + 1e-6) as float)::double, 4) + 0.0 as level from spectrum join weights using (k) group by utt, f, band""",
)
def log_mel(spark, folder):
    made = sp.log_mel_frames(clips(spark, folder), StftConfig(n_fft=64, win_length=32, hop_length=16, n_mels=8))
    return made.select("utt", "frame", F.posexplode("mel").alias("band", "v")).select("utt", "frame", "band", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("level"))


FRAMED_SPEECH = f"{DFT}, framed as (select utt, f, 10 * log10(sum(power) + 1e-12) as energy, exp(avg(ln(greatest(power, 1e-12)))) / avg(greatest(power, 1e-12)) as flat from spectrum group by utt, f)"
RULE = SpeechRule(grid=Grid(16_000, 32, 16), floor=25.0, above=1.0, flattest=0.6, vote=0, hold=1, shortest=0)


@add("speech_frames", f"with {FRAMED_SPEECH} select utt, cast(f as integer) as frame, f * 0.001::double as second, round(energy, 6) as energy_db, round(flat, 9) as flatness from framed")
def speech_frames(spark, folder):
    held = sp.speech_frames(clips(spark, folder), RULE, points=64)
    second = F.round(fr.frame_times(F.col("frame"), RULE.grid.hop, RULE.grid.rate), 9)
    return held.select("utt", "frame", second.alias("second"), F.round("energy_db", 6).alias("energy_db"), F.round("flatness", 9).alias("flatness"))


@add(
    "detect_speech",
    f"""with {FRAMED_SPEECH}, floors as (select utt, quantile_cont(energy, 0.25) as floor from framed group by utt), raw as (select utt, f, energy > floor + 1 and flat < 0.6 as m from framed join floors using (utt))
  select utt, cast(f as integer) as frame, m or coalesce(lag(m) over (partition by utt order by f), false) as is_speech from raw""",
)
def detect_speech(spark, folder):
    return sp.detect_speech(clips(spark, folder), RULE, points=64).select("utt", "frame", "is_speech")


@add(
    "vad_agreement",
    f"""with {PARTS}, {_merge('parts', 600, 'found')}, {_merge('parts', 0, 'truth')}, wide as (select utt, greatest(s / 1000 - 0.1, 0) as s, e / 1000 + 0.1 as e from truth),
  cut as (select 'found' as side, utt, floor(s / 1000 * 16000) as s, floor(e / 1000 * 16000) as e from found union all select 'truth', utt, floor(s / 1000 * 16000), floor(e / 1000 * 16000) from truth
    union all select 'wide', utt, floor(s * 16000), floor(e * 16000) from wide),
  kept as (select * from cut where e > s), reached as (select *, max(e) over (partition by side, utt order by s, e rows between unbounded preceding and 1 preceding) as reach from kept),
  grouped as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by side, utt order by s, e rows unbounded preceding) as g from reached),
  flat as (select side, utt, min(s) as s, max(e) as e from grouped group by side, utt, g),
  sizes as (select utt, sum(e - s) filter (where side = 'found') as seen, sum(e - s) filter (where side = 'truth') as real from flat group by utt),
  shared as (select a.utt, sum(least(a.e, b.e) - greatest(a.s, b.s)) filter (where b.side = 'truth') as met, sum(least(a.e, b.e) - greatest(a.s, b.s)) filter (where b.side = 'wide') as near
    from flat a join flat b on a.utt = b.utt and a.side = 'found' and b.side <> 'found' and a.s < b.e and b.s < a.e group by a.utt),
  everyone as (select distinct utt from parts)
  select utt, case when coalesce(real, 0) > 0 then coalesce(met, 0) / real else 0.0::double end as coverage, case when coalesce(seen, 0) > 0 then (seen - coalesce(met, 0)) / seen else 1.0::double end as leakage,
    case when coalesce(seen, 0) > 0 then (seen - coalesce(near, 0)) / seen else 1.0::double end as beyond from everyone left join sizes using (utt) left join shared using (utt)""",
)
def vad_agreement(spark, folder):
    """Segments merged over gaps of 0.6 s held against the segments themselves, with a margin of 0.1 s."""
    seconds = lambda df: df.select("utt", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    rows = parts(spark, folder)
    return fr.agreement(seconds(fr.merge(rows, 600)), seconds(fr.merge(rows, 0)), 0.1)


@add(
    "greedy_decode",
    """with steps as (select user_id as utt, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, event_id % 4 as token from events),
  kept as (select *, lag(token, 1, -1) over (partition by utt order by frame) as before from steps)
  select utt, coalesce(string_agg(token::varchar, ' ' order by frame) filter (where token <> before and token <> 0), '') as ids from kept group by utt""",
)
def greedy_decode(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, folder, "events").select(F.col("user_id").alias("utt"), (F.row_number().over(w) - 1).alias("frame"), (F.col("event_id") % 4).cast("int").alias("token"))
    return fr.greedy_decode(steps).select("utt", F.array_join("ids", " ").alias("ids"))


@add("event_windows", "select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as end, event_type, count(*) as events, round(sum(value), 4) as value from events where ts is not null group by all")
def event_windows(spark, folder):
    return windows.windowed(table(spark, folder, "events")).withColumn("value", F.round("value", 4))


@add(
    "event_sessions",
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as new from events where ts is not null),
  s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from e)
  select user_id, min(ts) as start, max(ts) + interval 30 minutes as end, count(*) as events from s group by user_id, g""",
)
def event_sessions(spark, folder):
    return windows.sessions(table(spark, folder, "events"))


@add(
    "quality_report",
    f"""with {WAVE}, {FRAMED}, {DFT}, db as (select *, case when peak > 0 then 20 * log10(peak) else '-infinity'::double end as peak_dbfs, case when rms > 0 then 20 * log10(rms) else '-infinity'::double end as rms_dbfs from level),
  loud as (select utt, peak, rms, dc_offset, clipping_ratio, case when rms > 0 then peak / rms else 0 end as crest_factor, peak_dbfs, rms_dbfs, len(f) as n,
    list_sum(list_transform(range(1, len(f)), lambda i: case when (f[i] < 0) <> (f[i + 1] < 0) then 1 else 0 end)) / len(f) as zero_crossing_rate,
    case when clipping_ratio > 0.001 then 'clipped' when rms_dbfs <= -80 then 'silent' when rms_dbfs < -50 then 'too_quiet' when peak_dbfs > -1 then 'too_loud' else 'normal' end as loudness from db),
  quiet as (select utt, greatest(quantile_cont(case when r > 0 then 20 * log10(r) end, 0.9) - quantile_cont(case when r > 0 then 20 * log10(r) end, 0.1), 0) as snr, avg((r <= 0 or 20 * log10(nullif(r, 0)) <= -18)::int) as silence_ratio from rmss group by utt),
  grown as (select *, k * 250.0::double as hz, sum(size) over (partition by utt, f order by k) as grown, sum(size) over (partition by utt, f) as total from spectrum),
  centres as (select utt, f, sum(size * hz) / max(greatest(total, 1e-12)) as centre, exp(avg(ln(greatest(size, 1e-12)))) / avg(greatest(size, 1e-12)) as flat, min(case when grown >= 0.85 * total then hz end) as edge from grown group by utt, f),
  spreads as (select g.utt, g.f, sqrt(sum(size * (hz - centre) * (hz - centre)) / max(greatest(total, 1e-12))) as spread from grown g join centres c on g.utt = c.utt and g.f = c.f group by g.utt, g.f),
  spectra as (select utt, round(avg(centre), 6) as spectral_centroid_hz, round(avg(spread), 6) as spectral_bandwidth_hz, round(avg(edge), 6) as spectral_rolloff_hz, round(avg(flat), 9) as spectral_flatness from centres join spreads using (utt, f) group by utt)
  select utt, round(peak, 9) as peak, round(rms, 9) as rms, round(dc_offset, 9) + 0.0 as dc_offset, clipping_ratio, round(crest_factor, 6) as crest_factor, round(peak_dbfs, 6) as peak_dbfs, round(rms_dbfs, 6) as rms_dbfs, loudness,
    n / 16000 as duration, cast(n as integer) as num_samples, zero_crossing_rate, round(snr, 6) as estimated_snr_db, silence_ratio, spectral_centroid_hz, spectral_bandwidth_hz, spectral_rolloff_hz, spectral_flatness
  from loud join quiet using (utt) join spectra using (utt)""",
)
def quality_report(spark, folder):
    held = sp.quality_report(clips(spark, folder), frame=25 / 16_000, hop=12 / 16_000, silence=-18.0, config=SMALL).drop("loudness_issues", "sample_rate")
    digits = {"peak": 9, "rms": 9, "dc_offset": 9, "crest_factor": 6, "peak_dbfs": 6, "rms_dbfs": 6, "estimated_snr_db": 6, "spectral_centroid_hz": 6, "spectral_bandwidth_hz": 6, "spectral_rolloff_hz": 6, "spectral_flatness": 9}
    return held.withColumns({c: F.round(c, d) + 0.0 for c, d in digits.items()})


@add("model_tokens")
def model_tokens(spark, folder):
    """Each embedding as eight frames of eight features, scored by a model with fixed random weights."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("utt"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("mels"))
    made = network.Network(network.Shape(mels=8, classes=12, layers=((16, 3, 2, 1), (16, 3, 2, 1)), hidden=16))
    return network.score(rows, made).select("utt", F.array_join("tokens", " ").alias("tokens"))
