import hashlib
from collections import Counter

import pytest
import regex
from corpusloom.functions import ids
from corpusloom.llm import sample, terms
from pyspark.sql import functions as F



def key():
    return ids.utterance_key(F.col("utterance_id"))



@pytest.fixture
def ledger(tmp_path):
    """Makes folders for ledgers."""
    made = iter(range(1000))
    return lambda: f"{tmp_path}/ledger-{next(made)}"


def rows_of(n, delivery):
    return [{"row_id": i, "utterance_id": f"AB_{i % 17:07d}_{i:07d}", "delivery": delivery(i)} for i in range(n)]


def test_sample_grows_and_never_forgets(manifest, ledger):
    """With a ledger of its own each time, and with one that is kept."""
    kept = ledger()
    rows = rows_of(400, lambda i: 1 + i % 4)
    earlier = None
    for k in (1, 2, 3, 4):
        held = manifest([r for r in rows if r["delivery"] <= k])
        now = {r.sample_key for r in sample.sample_rows(held, key(), "delivery", ledger()).collect()}
        assert now == {r.sample_key for r in sample.sample_rows(held, key(), "delivery", kept).collect()}
        assert earlier is None or earlier <= now
        earlier = now
    assert 0 < len(earlier) < 120


def test_sample_is_the_same_in_any_partitioning_and_by_hand(manifest, ledger):
    rows = rows_of(300, lambda i: 1 + i % 3)
    df = manifest(rows)
    a = {r.row_id for r in sample.sample_rows(df.repartition(7), key(), "delivery", ledger()).collect()}
    b = {r.row_id for r in sample.sample_rows(df.coalesce(1), key(), "delivery", ledger()).collect()}
    draw = lambda k: int(hashlib.md5(f"{k}|{sample.SEED}|0".encode()).hexdigest()[:13], 16) / 2**52
    assert a == b == {r["row_id"] for r in rows if draw(r["utterance_id"]) < sample.RATES[r["delivery"]]}


def test_sample_spellings_go_together_and_odd_rows_stay_out(manifest, ledger):
    spelled = ["AB_0000001_0000005", " ab-0000001-0000005\n", "Ab_0000001_0000005.wav"]
    rows = [{"row_id": i, "utterance_id": u, "delivery": 1} for i, u in enumerate(spelled)]
    rows += [{"row_id": 10, "delivery": 1}, {"row_id": 11, "utterance_id": " ", "delivery": 1}, {"row_id": 12, "utterance_id": "AB_1_1"}]
    got = sample.sample_rows(manifest(rows, extra=["draw", "rate", "sample_key"]), key(), "delivery", ledger(), {1: 1.0})
    assert sorted(r.row_id for r in got.collect()) == [0, 1, 2]
    assert sample.sample_rows(manifest([]), key(), "delivery", ledger()).count() == 0


def test_ledger_freezes_rates(spark, manifest, tmp_path):
    rows = rows_of(200, lambda i: 1 + i // 100)
    path = f"{tmp_path}/ledger"
    keyed = manifest(rows).withColumn("k", key())
    first = sample.extend_ledger(keyed.where("delivery = 1"), "k", "delivery", path, {1: 0.5})
    assert first.count() == 100
    both = sample.extend_ledger(keyed, "k", "delivery", path, {1: 0.1, 2: 0.2})
    assert {(r.first_epoch, r.rate) for r in both.select("first_epoch", "rate").distinct().collect()} == {(1, 0.5), (2, 0.2)}


def test_late_rows_and_changed_rates_change_no_decision(manifest, ledger):
    """Rows of an earlier delivery that come after a later one, and rates that are raised or lowered in between."""
    path, rates = ledger(), {1: 0.5, 2: 0.5}
    early = [r | {"delivery": 2} for r in rows_of(200, lambda i: 1) if r["row_id"] % 2]
    first = {r.sample_key for r in sample.sample_rows(manifest(early), key(), "delivery", path, rates).collect()}
    late = [r | {"row_id": 1000 + r["row_id"]} for r in rows_of(200, lambda i: 1)]  # the same utterances and as many others
    for now in ({1: 1.0, 2: 1.0}, {1: 0.0, 2: 0.0}):
        got = sample.sample_rows(manifest(early + late), key(), "delivery", path, now).collect()
        old = {r["utterance_id"] for r in early}
        assert {r.sample_key for r in got if r.sample_key in old} == first
        assert {r.sample_key for r in got} - old == {r["utterance_id"] for r in late} - old  # first seen at a rate of 1
        assert all(r.first_epoch == (2 if r.sample_key in old else 1) for r in got)


def brute(texts):
    times, records = Counter(), Counter()
    for t in texts:
        pieces = regex.findall(r"[^\p{White_Space}]+", t or "")
        times.update(pieces), records.update(set(pieces))
    return {t: (times[t], records[t]) for t in times}


def test_terms_match_brute_force(spark):
    texts = ["a b a", "b c c", None, "", " 　", "x\u001cy z​", "a " * 5000, "தமிழ் a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    blocks = terms.count_blocks(df, "text")
    numbered = terms.dictionary(blocks)
    counts = terms.count_terms(blocks, numbered)
    assert {r.term: (r.times, r.records) for r in counts.collect()} == brute(texts)
    assert terms.with_text(blocks) == sum(bool(regex.findall(r"[^\p{White_Space}]", t or "")) for t in texts)
    ids_ = sorted((r.term_id, r.term) for r in numbered.collect())
    assert ids_ == sorted((r.term_id, r.term) for r in counts.collect())
    assert [i for i, _ in ids_] == list(range(len(ids_))) and len({t for _, t in ids_}) == len(ids_)


def test_terms_blocks_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_TERMS", 3)
    texts = [f"t{i % 7} t{i % 3}" for i in range(50)]
    got = terms._count_blocks(iter([__import__("pyarrow").record_batch({"t": texts})]))
    total = Counter()
    for batch in got:
        total.update(dict(zip(batch["term"].to_pylist(), batch["times"].to_pylist(), strict=True)))
    assert total.pop(None) == 50
    assert total == Counter(p for t in texts for p in t.split())


def test_marks(spark):
    counts = spark.createDataFrame([("r", 3, 1), ("m", 4, 4), ("c", 9, 5)], "term string, times long, records long")
    assert {r.term: r.mark for r in terms.mark_terms(counts, 100).collect()} == {"r": "rare", "m": None, "c": "common"}
    blocks = terms.count_blocks(spark.createDataFrame([], "text string"), "text")
    assert terms.dictionary(blocks).count() == 0 and terms.with_text(blocks) == 0
    assert terms.count_terms(blocks, terms.dictionary(blocks)).count() == 0


def test_ranges_are_summed_one_after_the_other(spark, monkeypatch):
    """More terms than a range holds, from many blocks."""
    import pyarrow as pa

    monkeypatch.setattr(terms, "RANGE", 4)
    monkeypatch.setattr(terms, "BLOCK_TERMS", 5)
    texts = [f"t{i % 23} t{i % 5} t{i % 5}" for i in range(200)]
    one = [terms._count_blocks(iter([pa.record_batch({"t": texts[i::4]})])) for i in range(4)]
    held = [(t, a, b) for g in one for batch in g for t, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t]
    names = sorted({t for t, _, _ in held})
    coded = sorted((names.index(t), a, b) for t, a, b in held)
    batches = [pa.record_batch({k: pa.array([c[i] for c in coded[at : at + 7]], pa.int64()) for i, k in enumerate(("term_id", "times", "records"))}) for at in range(0, len(coded), 7)]
    out = {names[i]: (a, b) for batch in terms._sum_ranges(iter(batches)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert out == brute(texts)
