import math

import numpy as np
import pytest
from corpusloom import config
from corpusloom.operators import decode as de
from corpusloom.operators import feasibility as fe
from corpusloom.operators import frames as fr
from corpusloom.operators import levels as lv
from corpusloom.operators import manifest as mf
from corpusloom.operators import spectral as sp
from corpusloom.operators import splits
from corpusloom.operators import vocabulary as vo
from pyspark.sql import functions as F


def mask(spark, text, utt=1):
    return spark.createDataFrame([(utt, i, c == "T") for i, c in enumerate(text)], "utt int, frame int, is_speech boolean")


def read(frames):
    return "".join("T" if r.is_speech else "F" for r in frames.orderBy("utt", "frame").collect())


@pytest.mark.parametrize(("text", "out"), [("FFTFF", "FFFFF"), ("FTTTF", "FTTTF"), ("TFFFF", "TFFFF"), ("TTFFF", "TTFFF"), ("TFTFT", "TTFTT"), ("T", "T")])
def test_majority_repeats_the_ends(spark, text, out):
    padded = np.pad(np.array([c == "T" for c in text]), 1, mode="edge")
    assert out == "".join("T" if padded[i : i + 3].sum() > 1 else "F" for i in range(len(text)))
    assert read(fr.majority(mask(spark, text), 3)) == out
    assert read(fr.majority(mask(spark, text), 2)) == out  # an even width is one more


def test_hangover_and_short_runs(spark):
    assert read(fr.hangover(mask(spark, "F" * 5 + "T" + "F" * 14), 3)) == "F" * 5 + "TTTT" + "F" * 11
    assert read(fr.drop_short(mask(spark, "TTFTFTTT"), 3)) == "FFFFFTTT"
    assert read(fr.hangover(mask(spark, "FTF"), 0)) == "FTF" and read(fr.drop_short(mask(spark, "TF"), 1)) == "TF"


def spans(df):
    return [(round(r.start, 6), round(r.end, 6)) for r in df.orderBy("utt", "start").collect()]


def test_segments(spark):
    assert spans(fr.segments(mask(spark, "FFTTTFFTF"), 0.01, 0.025)) == [(0.02, 0.065), (0.07, 0.095)]
    text = "".join("T" if 10 <= i < 20 or 30 <= i < 32 else "F" for i in range(50))
    assert spans(fr.build_segments(mask(spark, text), hop=0.01, frame=0.025, total=F.lit(0.5))) == [(0.05, 0.385)] or spans(fr.build_segments(mask(spark, text), hop=0.01, frame=0.025)) == [(0.05, 0.385)]
    with pytest.raises(ValueError):
        fr.segments(mask(spark, "T"), 0)


def parts(spark, *rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "utt int, start double, end double")


def test_merge_pad_overlap(spark):
    assert spans(fr.merge(parts(spark, (0, 0.5), (0.6, 0.9)), 0.2)) == [(0.0, 0.9)]
    assert spans(fr.merge(parts(spark, (0, 5), (1, 2), (4, 6), (6.5, 7)), 0.5)) == [(0.0, 7.0)]
    assert spans(fr.merge(parts(spark, (0, 1), (1.5, 2)), 0.25)) == [(0.0, 1.0), (1.5, 2.0)]
    assert spans(fr.pad(parts(spark, (0.01, 0.4)), 0.05, F.lit(0.42))) == [(0.0, 0.42)]
    with pytest.raises(Exception, match="ends before"):
        fr.pad(parts(spark, (3, 4)), 0.05, F.lit(1.0)).collect()
    met = fr.overlaps(parts(spark, (0, 12), (20, 21)), parts(spark, (5, 6), (11, 20.5)), 5.0).collect()
    assert round(met[0].seconds, 6) == 2.5
    assert fr.merge(parts(spark), 1).count() == 0


def test_greedy_decode(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 3, 3, 0, 3, 2, 2, 0])] + [(2, 0, 0)]
    got = fr.greedy_decode(spark.createDataFrame(rows, "utt int, frame int, token int"))
    assert {r.utt: list(r.ids) for r in got.collect()} == {1: [3, 3, 2], 2: []}
    assert spark.range(1).select(de.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))).first()[0] == 1


def clip(spark, *clips, rate=16_000):
    return spark.createDataFrame([(i, [float(v) for v in c], rate) for i, c in enumerate(clips)], "utt long, samples array<float>, sample_rate int")


def sine(n=16_000, hz=440.0, amp=0.5, rate=16_000):
    return (amp * np.sin(2 * np.pi * hz * np.arange(n) / rate)).astype(np.float32)


def test_levels_of_a_sine(spark):
    r = lv.loudness(clip(spark, sine())).withColumn("z", lv.zero_crossing_rate(F.col("samples"))).first()
    assert abs(r.peak - 0.5) < 1e-3 and abs(r.rms - 0.35355) < 1e-4 and abs(r.peak_dbfs + 6.02) < 0.02
    assert abs(r.crest_factor - math.sqrt(2)) < 1e-3 and r.loudness == "normal" and abs(r.z - 880 / 16_000) < 2 / 16_000


@pytest.mark.parametrize(("amp", "label"), [(1e-3, "too_quiet"), (0.99, "too_loud"), (1.0, "clipped"), (0.0, "silent"), (0.3, "normal")])
def test_loudness_ladder(spark, amp, label):
    assert lv.loudness(clip(spark, sine(2000, amp=amp))).first().loudness == label


def test_empty_clip_is_silent_without_issue(spark):
    r = lv.loudness(clip(spark, [])).first()
    assert r.loudness == "silent" and r.loudness_issues == [] and r.peak_dbfs == -math.inf


@pytest.mark.parametrize(
    ("samples", "rate", "codes"),
    [
        ([], 16_000, ["empty"]), ([0.1, math.nan], 16_000, ["nan"]), ([0.1, math.inf], 16_000, ["infinite"]), ([0.0] * 9, 16_000, ["silent"]), ([0.5] * 9, 16_000, ["dc_offset"]),
        ([1.1, -1.1] * 9, 16_000, ["clipped"]), ([1e-6, -1e-6] * 9, 16_000, ["low_amplitude"]), ([0.1, -0.1], 7_999, ["unsupported_sample_rate"]), ([0.1, -0.1], 8_000, []), ([0.1, -0.1], 0, ["unsupported_sample_rate"]),
        ([], 0, ["unsupported_sample_rate", "empty"]),
    ],
)
def test_validation(spark, samples, rate, codes):
    r = lv.validate(clip(spark, samples, rate=rate)).first()
    assert [i.code for i in r.issues] == codes
    assert r.ok == (not {"empty", "nan", "infinite", "silent", "unsupported_sample_rate"} & set(codes))


def test_gain(spark):
    df = clip(spark, sine(100))
    assert abs(lv.loudness(df.select(lv.normalize_peak(F.col("samples")).alias("samples"))).first().peak_dbfs + 1) < 1e-4
    assert abs(lv.loudness(df.select(lv.normalize_rms(F.col("samples")).alias("samples"))).first().rms_dbfs + 20) < 1e-4
    for bad in (0.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            lv.normalize_peak(F.col("samples"), bad)
    with pytest.raises(Exception, match="silence"):
        clip(spark, [0.0]).select(lv.normalize_rms(F.col("samples"))).collect()
    assert [round(v, 3) for v in spark.range(1).select(lv.to_mono(F.array(F.array(F.lit(1.0), F.lit(0.0))))).first()[0]] == [0.5]


def test_frame_rms(spark):
    x = np.arange(1000) / 1000
    got = clip(spark, x, x[:10], []).select(lv.frame_rms(F.col("samples"), 400, 160).alias("r")).collect()
    want = [math.sqrt(np.mean(x[i : i + 400] ** 2)) for i in range(0, 601, 160)]
    assert np.allclose(got[0].r, want, atol=1e-6) and len(got[1].r) == 1 and got[2].r == []


def test_spectra():
    x = sine(amp=0.4)
    power = np.abs(sp.stft(x)) ** 2
    assert power.shape == (1 + 16_000 // 160, 257) and abs(power.mean(0).argmax() * 16_000 / 512 - 440) < 32
    assert sp.log_mel(x).shape == (101, 80) and np.isfinite(sp.log_mel(np.zeros(1000, np.float32))).all()
    bank = sp.mel_bank()
    assert bank.shape == (257, 80) and bank.max() <= 1 and bank.min() >= 0
    assert np.allclose(sp.mel_to_hz(sp.hz_to_mel(np.array([0.0, 440, 8000]))), [0, 440, 8000]) and np.allclose(sp.mel_to_hz(sp.hz_to_mel(np.array([500.0, 4000]), False), False), [500, 4000])
    centre, _, edge, flat = sp.spectral_stats(x, 16_000, config.StftConfig())
    noise = np.random.default_rng(0).normal(0, 0.3, 16_000).astype(np.float32)
    assert abs(centre - 440) < 60 and edge < 700 and flat < 0.2 < sp.spectral_stats(noise, 16_000, config.StftConfig())[3]
    with pytest.raises(ValueError):
        sp.window("box", 4)
    with pytest.raises(ValueError):
        sp.stft(np.zeros(10, np.float32))


@pytest.mark.parametrize("rate", [8_000, 22_050, 44_100, 48_000])
def test_resampling_keeps_the_tone(rate):
    got = sp.resample(sine(rate, rate=rate), rate, 16_000)
    assert abs(len(got) - 16_000) <= 1
    assert abs(np.abs(np.fft.rfft(got * np.hanning(len(got)))).argmax() * 16_000 / len(got) - 440) <= 1
    assert np.abs(got[500:-500] - sine(len(got))[500:-500]).max() < 0.01


@pytest.mark.parametrize("rates", [(8_000, 16_000), (22_050, 16_000), (48_000, 16_000), (16_000, 22_050), (11_025, 16_000), (7, 3)])
def test_resampling_in_blocks_is_the_plain_sum(rates):
    """Each new sample as a sum over all filter taps, written out."""
    old, new = rates
    x = np.random.default_rng(3).normal(0, 0.2, 700).astype(np.float32)
    cut = min(1.0, new / old)
    reach = math.ceil(32 / cut)
    want = []
    for k in range(-(-len(x) * new // old)):
        at = k * old / new
        total = 0.0
        for i in range(math.floor(at) - reach, math.floor(at) + reach + 1):
            if 0 <= i < len(x):
                off = i - at
                total += x[i] * cut * np.sinc(cut * off) * (0.5 + 0.5 * math.cos(math.pi * min(1.0, abs(off) / (reach + 1))))
        want.append(total)
    got = sp.resample(x, old, new)
    assert len(got) == len(want) and np.abs(got - np.array(want)).max() < 1e-5
    assert len(sp.resample(x[:0], old, new)) == 0


def test_settings_fill_in_what_is_not_given():
    assert config.StftConfig(sample_rate=8_000).fmax == 4_000 and config.frame_length(0.025, 16_000) == 400 and config.frame_length(2.5, 1) == 2
    assert config.Grid.of(8_000, 0.025, 0.010) == config.Grid(8_000, 200, 80)


def test_speech_is_found_between_silence(spark):
    rng = np.random.default_rng(1)
    noise = lambda n: rng.normal(0, 1e-4, n)
    t = np.arange(8000) / 16_000
    voice = sum(np.sin(2 * np.pi * 180 * k * t) / 6 for k in range(1, 7)) * 0.35
    x = np.concatenate([noise(8000), voice + noise(8000), noise(16_000)])
    marks = sp.detect_speech(clip(spark, x))
    held = [r.frame for r in marks.where("is_speech").collect()]
    assert min(held) in range(46, 53) and 98 <= max(held) <= 120 and len(held) == max(held) - min(held) + 1
    same = sp.resampled(clip(spark, x[:50]))
    assert same.first().sample_rate == 16_000 and len(same.first().samples) == 50


def test_encoder_frames(spark):
    df = spark.createDataFrame([(n,) for n in (1, 3, 5, 7, 9, 101, 0)], "n int")
    want = [max(1, math.ceil(math.ceil(n / 2) / 2)) for n in (1, 3, 5, 7, 9, 101, 0)]
    assert [r[0] for r in df.select(fe.encoder_frames(F.col("n"), 2)).collect()] == want
    for n in range(1, 200):
        once = max(1, (n + 2 - 3) // 2 + 1)
        assert max(1, (once - 1) // 2 + 1) == math.ceil(math.ceil(n / 2) / 2)
    row = spark.createDataFrame([(0.353812,)], "d double").select(fe.encoder_frames(fe.stft_frames(F.col("d")), 2)).first()
    assert row[0] == 9


def rows(spark, *data):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "row_id long, text string, speaker_id string, split string, duration_seconds double")


def test_feasibility_and_curation(spark):
    df = rows(spark, ("க" * 40, "1", "train", 0.353812), ("அ ஆ", "1", "train", 3.0), ("x" * 30, "2", "dev", 1.0), ("", "2", "dev", 1.0))
    assert {r.row_id: r.reason for r in fe.labelled(df, "char_no_space").collect()} == {0: "corrupt_transcript", 1: None, 2: "fast_speech_below_encoder_resolution", 3: None}
    assert sorted(r.row_id for r in fe.curated(df).collect()) == [1, 2, 3]
    four = fe.per_stride(df).where("unit = 'char_no_space' and stride = 4").first()
    assert (four.utterances, four.violations) == (3, 2)
    report = {r.split: (r["count"], r.total, r.median, r.longest) for r in fe.length_report(df, "char_no_space").collect()}
    assert report == {"train": (2, 42, 40, 40), "dev": (2, 30, 30, 30)}  # the upper median


def test_vocabulary_and_encoding(spark):
    texts = rows(spark, *[(t, "1", "train", 1.0) for t in ("வணக்கம்", "வணக்கம்", "தமிழ்", "தமிழ் தமிழ்", "hello", "42", "", None)])
    vocab = vo.vocabulary(texts)
    held = vocab.orderBy("id").collect()
    assert [r.id for r in held] == list(range(2, 2 + len(held)))
    assert [(r["count"], r.symbol) for r in held] == sorted(((r["count"], r.symbol) for r in held), key=lambda x: (-x[0], x[1]))
    got = vo.encode(rows(spark, ("வணக்கம் zq", "1", "dev", 1.0), ("", "1", "dev", 1.0)), vocab).orderBy("row_id").collect()
    assert got[0].unknown == 2 and len(got[0].ids) == len("வணக்கம் zq") and list(got[1].ids) == []
    back = vo.encode(texts.where("text is not null"), vocab).select("text", vo.decode(F.col("ids"), vocab).alias("d")).collect()
    assert all(r.text == r.d for r in back)
    with pytest.raises(Exception, match="no symbol"):
        spark.range(1).select(vo.decode(F.array(F.lit(999)), vocab)).collect()
    rate = vo.unknown_rate(rows(spark, ("வணக்கம்", "1", "a", 1.0), ("zq", "1", "a", 1.0), ("qqq", "1", "a", 1.0)), vocab).first()
    assert (rate.unknown, rate.with_unknown, rate.utterances) == (5, 2, 3)
    scripts = {r.script: r.characters for r in vo.script_histogram(rows(spark, ("க்க்க", "1", "a", 1.0), ("aab", "1", "a", 1.0))).collect()}
    assert scripts == {"tamil": 2, "latin": 2, "digit": 0, "punctuation": 0, "symbol": 0, "whitespace": 0, "other": 0}
    assert spark.range(1).select(vo.scripts_in_order(F.lit("கa1"))).first()[0] == ["tamil", "latin", "digit"]
    assert vo.vocabulary(texts.where("false")).count() == 0


def test_coverage_curve_matches_brute_force(spark):
    from collections import Counter

    data = [("a a b c", "train"), ("a b d", "train"), ("e a", "dev"), ("", "dev"), ("c d", "test")]
    df = rows(spark, *[(t, "1", s, 1.0) for t, s in data])
    words = Counter(w for t, s in data if s == "train" for w in t.split())
    order = sorted(words, key=lambda w: (-words[w], w))
    for r in vo.coverage_curve(df, (1, 2, 3)).collect():
        known = set(order[: r.top])
        mine = [t.split() for t, s in data if s == r.split]
        assert r.unseen == sum(w not in known for t in mine for w in t) and r.unseen_utterances == sum(any(w not in known for w in t) for t in mine)


def test_greedy_splits(spark):
    df = rows(spark, *[("x", f"{s:07d}", "", 1.0) for s in range(100) for _ in range(10)])
    planned = splits.plan(df)
    assert planned.count() == 100 and mf.split_speakers(splits.assign(df, planned)).count() == 0
    share = {r.split: r.utterances / 1000 for r in splits.counts(splits.assign(df, planned)).collect()}
    assert 0.86 <= share["train"] <= 0.94 and sorted(planned.collect()) == sorted(splits.plan(df.repartition(3)).collect())
    with pytest.raises(ValueError):
        splits.plan(df.where("false"))
    assert splits.greedy([("a", 1)], config.SplitRatios()) == [("a", "train")]


def test_error_rates(spark):
    df = spark.createDataFrame([("a b", "a b", "s"), ("abc", "abd x", "s"), ("", "x", "s")], "reference string, hypothesis string, split string")
    r = de.error_rates(df, ["split"]).first()
    assert (r.token_errors, r.tokens, r.utterances) == (4, 6, 3) and abs(r.exact - 1 / 3) < 1e-9 and abs(r.word_error_rate - 3 / 4) < 1e-9
    assert de.error_rates(df, ["split"], include_space=False).first().word_error_rate is None
    assert de.edit_distance(list("kitten"), list("sitting")) == 3 and de.edit_distance([], list("ab")) == 2


@pytest.mark.parametrize(
    "make",
    [
        lambda: config.StftConfig(win_length=600), lambda: config.StftConfig(hop_length=0), lambda: config.StftConfig(window="box"), lambda: config.SpeechRule(floor=101), lambda: config.SpeechRule(flattest=-1.0), lambda: config.SpeechRule(hold=-1), lambda: config.Grid(hop=0), lambda: config.StftConfig(fmax=20_000.0), lambda: config.StftConfig(fmin=-1.0), lambda: config.frame_length(0.0, 16_000), lambda: config.frame_length(1.0, -1), lambda: config.frame_length(1e-9, 16_000),
        lambda: config.SegmentConfig(gap=-1), lambda: config.TokenizerConfig(form="NFX"), lambda: config.TokenizerConfig(min_frequency=0), lambda: config.SplitRatios(0.5, 0.5, 0.5), lambda: config.SplitRatios(1.0, 0.0, 0.0),
    ],
)
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()
