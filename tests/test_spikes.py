import datetime as dt
import math
import random
from statistics import median

import numpy as np
import pytest
from corpusloom.operators import spikes
from corpusloom.operators.grouped import global_rank, grouped_median, positions, ranked_values
from pyspark.sql import functions as F

SCHEMA = "row_id long, utterance_id string, text string, speaker_id string, duration_seconds double, recorded_at timestamp"


def rows_of(seed=0):
    r = random.Random(seed)
    rows, n = [], 0
    for s in range(1, 7):
        for u in range(1, 60 if s > 1 else 400):
            n += 1
            chars = r.randrange(40, 120)
            rows.append([n, f"AB_{s:07d}_{u:07d}", "க" * chars, f"{s:07d}", round(chars / r.uniform(11, 13), 6), dt.datetime(2024, 1, 1 + u % 28, u % 24)])
    for at in range(3, len(rows), 37):
        rows[at][4] *= r.choice([2.2, 0.3, 50])
    for at in (100, 520):
        for k in range(at, at + 5):
            rows[k][4] = 8.0
    for at, bad in zip(range(30, 330, 60), (0.0, -1.0, math.nan, math.inf, None), strict=True):
        rows[at][4] = bad
    rows[11][2], rows[12][2] = None, ""
    rows[40][3] = None
    rows[41][3] = "spk_" + rows[41][3]
    rows.append([n + 1, rows[520][1].lower(), rows[520][2], rows[520][3], 8.0, None])  # an utterance that came again
    rows.append([n + 2, None, "text", None, 3.0, None])
    rows.append([n + 3, None, None, None, -3.0, None])
    return [tuple(x) for x in rows]


def brute(rows):
    by, runs = {}, {}
    for i, u, t, s, d, _ in rows:
        who = int(s.removeprefix("spk_")) if s else int(u.split("_")[1]) if u else None
        if who is None or d is None:
            continue
        if t and math.isfinite(d) and d > 0:
            by.setdefault(who, []).append((i, len(t) / d))
        if u:
            runs.setdefault(who, {}).setdefault(int(u.split("_")[2]), (d, []))[1].append(i)
    out = {i for i, _, _, _, d, _ in rows if d is not None and not (math.isfinite(d) and d > 0)}
    for held in by.values():
        m = median(x for _, x in held)
        out |= {i for i, x in held if x >= 1.8 * m or x <= m / 1.8}
    for held in runs.values():
        order = sorted(held)
        at = 0
        while at < len(order):
            end = at
            while end + 1 < len(order) and held[order[end + 1]][0] == held[order[at]][0]:
                end += 1
            if end - at >= 3:
                out |= {i for k in order[at : end + 1] for i in held[k][1]}
            at = end + 1
    return out


@pytest.mark.parametrize("config", [spikes.SpikeConfig(), spikes.SpikeConfig(span=16, chunk=100)])
def test_spikes_match_brute_force(spark, config):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"level": F.lit("x"), "n": F.lit("y"), "speaker": F.lit(0)})
    got = {r.row_id for r in spikes.found_spikes(df.repartition(5), config).collect()}
    assert got == brute(rows)


def test_scores_are_repeatable_and_set_spikes_apart(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    a = {r.row_id: r for r in spikes.score_durations(df).collect()}
    b = {r.row_id: r.score for r in spikes.score_durations(df.repartition(3)).collect()}
    assert all(a[k].score == b[k] or abs(a[k].score - b[k]) < 1e-9 for k in a if a[k].score is not None)
    usual = [r.score for r in a.values() if r.score is not None and not r.flagged]
    rate = [r.score for r in a.values() if "rate" in r.reasons]
    assert min(rate) > np.quantile(usual, 0.75)
    assert len(a) == df.count() and all((r.score is None) == (r.duration_seconds is None or r.speaker is None) for r in a.values())


def test_the_forest_decides(spark, monkeypatch):
    """Without its scores no rate is held against a speaker's readings and no reading is isolated; the other limits hold."""
    rows = [(q[0], q[1], q[2], f"{int(q[3]):07d}" if q[3] and q[3].isdigit() else q[3], *q[4:]) for q in rows_of()]
    r = np.random.default_rng(0)
    rows += [(5000 + i, f"AB_0000009_{i:07d}", "க" * 60, "0000009", float(5 * np.exp(r.normal(0, 0.02))) * (1.5 if i == 150 else 1), None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {r.row_id: set(r.reasons) for r in spikes.score_durations(df).collect() if r.flagged}
    assert plain[5150] == {"isolated"} and 5150 not in {r.row_id for r in spikes.found_spikes(df).collect()}
    held = [r for r in spikes.score_durations(df).collect() if r.score is not None]
    assert 0.1 < np.mean([r.score > r.cut for r in held]) < 0.4  # what is brought up at all

    def blind(config):
        import pyarrow as pa

        run = scorer(config)

        def none(key, table):
            out = run(key, table)
            return out.set_column(out.schema.get_field_index("score"), "score", pa.array([0.0] * out.num_rows))

        return none

    scorer = spikes._scorer
    monkeypatch.setattr(spikes, "_scorer", blind)
    left = {r.row_id: set(r.reasons) for r in spikes.score_durations(df).collect() if r.flagged}
    assert left == {k: v - {"rate", "isolated"} for k, v in plain.items() if v - {"rate", "isolated"}}
    assert len(left) < len(plain) / 2


def test_a_recorder_of_zeros_is_spread_over_pieces(spark):
    """A source whose readings are all impossible is cut into as many pieces as any other, and so is its pool."""
    rows = [(i, f"AB_0000001_{i:07d}", "x", "1", 0.0, None) for i in range(4000)] + [(5000 + i, f"AB_0000002_{i:07d}", "x y", "2", 1.5 + i / 977, None) for i in range(50)]
    df, config = spark.createDataFrame(rows, SCHEMA), spikes.SpikeConfig(chunk=500, pool=64)
    assert {r.row_id for r in spikes.found_spikes(df, config).collect()} >= set(range(4000))
    numbered = df.selectExpr("row_id", "cast(speaker_id as long) as speaker", "duration_seconds as duration", "cast(null as int) as hour", "cast(null as double) as ratio", "1L as run_length", "0L as n",
                             "count(*) over (partition by speaker_id) as readings", "0D as level", "0D as change", "0D as run")
    sizes = spikes._pieces(numbered, config).groupBy("speaker", "piece").agg(F.count_if("own").alias("own"), F.count_if("grow").alias("grow")).collect()
    first = [r for r in sizes if r.speaker == 1]
    assert len(first) == 8 and max(r.own for r in first) < 700 and sum(r.own for r in first) == 4000 and max(r.grow for r in first) < 120


def test_cuts_are_quantiles_of_all_readings(spark):
    """The cut and what is isolated follow from every reading within the limits, however few of them the trees draw from."""
    r = random.Random(12)
    rows = [(1000 * s + u, f"AB_{s:07d}_{u:07d}", "க" * 60, f"{s:07d}", 60 / (12 * r.lognormvariate(0, 0.2)), None) for s, n in ((1, 700), (2, 90)) for u in range(n)]
    config = spikes.SpikeConfig(pool=64, chunk=150)
    held = spikes.score_durations(spark.createDataFrame(rows, SCHEMA), config).collect()
    for s in (1, 2):
        own = [x for x in held if x.speaker == s]
        normal = sorted(x.score for x in own if abs(math.log(x.ratio)) < math.log(1.8) and x.run_length < 4)
        middle, cut = (normal[int(q * (len(normal) - 1))] for q in (0.5, 0.75))
        assert len(normal) > 64 and {x.cut for x in own} == {cut}
        assert all(("isolated" in x.reasons) == (x.score > cut + 3 * (cut - middle)) for x in own)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spikes.found_spikes(empty).count() == 0
    one = spark.createDataFrame([(1, "AB_1_1", "x", "1", 2.0, None)], SCHEMA)
    assert [(r.row_id, r.flagged) for r in spikes.score_durations(one).collect()] == [(1, False)]


def test_speakers_with_few_readings_match_brute_force(spark):
    r = random.Random(6)
    rows = []
    for s in range(1, 121):
        for u in range(1, 2 + s % 5):
            rows.append((len(rows), f"AB_{s:07d}_{u:07d}", "க" * 60, f"{s:07d}", r.choice([5.0, 4.5]) * (4 if u == 2 else 1) + u / 100, None))
    want = brute(rows)
    assert {x.row_id for x in spikes.found_spikes(spark.createDataFrame(rows, SCHEMA)).collect()} == want and len(want) > 60


def test_grouped_median_and_ranks(spark):
    r = random.Random(4)
    rows = [(k, r.choice([r.uniform(0.1, 50), 7.0])) for k in "aab" for _ in range(101)] + [("c", 1.0), (None, 2.0), ("a", None), ("a", math.nan), ("a", -1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    held = {k: sorted(v for q, v in rows if q == k and v is not None and v > 0) for k in "abc"}
    assert {x.k: (x.n, x.median) for x in grouped_median(df, "k", "v").collect()} == {k: (len(v), median(v)) for k, v in held.items()}
    got = {x.k: x.p for x in ranked_values(df.where("k is not null"), ["k"], "v", {"p": "n div 2 + 1"}).collect()}
    every = {k: sorted(v for q, v in rows if q == k and v is not None and not math.isnan(v)) for k in "abc"}
    assert got == {k: v[len(v) // 2] for k, v in every.items()}


def test_positions_and_ranks(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50) for i in range(60)], "g int, v int").dropDuplicates()
    got = positions(df, ["g"], F.expr("v div 10"), [F.col("v")], "at").collect()
    for g in range(3):
        assert [x.at for x in sorted((x for x in got if x.g == g), key=lambda x: x.v)] == list(range(1, 1 + sum(x.g == g for x in got)))
    ranked = global_rank(df.select("v").distinct(), [F.col("v").desc()]).collect()
    assert [x.rank for x in sorted(ranked, key=lambda x: -x.v)] == list(range(1, len(ranked) + 1))
    assert global_rank(df.where("v < 0"), [F.col("v"), F.col("g")]).count() == 0
