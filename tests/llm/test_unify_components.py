import random

import pytest
from corpusloom.llm import components, unify
from pyspark.sql import functions as F


def forms(df):
    return {r.row_id: r for r in unify.unify_texts(df).collect()}


def test_unify_repairs_and_leaves_alone(manifest):
    texts = {
        1: "வணக்கம் office", 2: "வண​க்கம்", 3: "оffiсe", 4: "ｖｉｄｅｏ", 5: "a b", 6: "жизнь ௧௨ 42", 7: "திசிത்தம்", 8: None, 9: "", 10: "  two  blanks ",
        11: "line\nfeed", 12: "இருக்௧ிறது", 13: "café", 14: "മലയാളം", 15: "office " * 2000, 16: "௧௨ம",
    }
    got = forms(manifest([{"row_id": k, "text": t} for k, t in texts.items()], extra=["form", "mixed"]))
    assert {k for k, r in got.items() if r.needed} == {2, 3, 4, 5, 12, 13, 16}
    assert got[3].form == "office" and got[3].known == 1 and got[12].form == "இருக்கிறது" and got[13].form == "café"
    assert got[8].form is None and got[9].form == "" and got[10].form == texts[10]


def test_unify_asks_the_vocabulary(manifest):
    """'саре' with Latin p and e can be Latin or Cyrillic; the word that the collection holds decides."""
    word = "сapе"  # Cyrillic, Latin, Latin, Cyrillic
    latin = forms(manifest([{"row_id": 1, "text": word}, {"row_id": 2, "text": "the cape"}]))
    east = forms(manifest([{"row_id": 1, "text": word}, {"row_id": 2, "text": "сара саре"}]))
    assert latin[1].form == "cape" and latin[1].known == 1
    assert east[1].form == "саре" and east[1].known == 1
    assert unify.unify_texts(manifest([])).count() == 0


def brute_components(edges):
    seen, out = {}, {}
    for a, b in edges:
        seen.setdefault(a, set()).add(b), seen.setdefault(b, set()).add(a)
    for start in sorted(seen):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += seen[n]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 230)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, *edges[:5], (7, 7), (None, 3), (5, None)], "a long, b long")
    assert {x.node: x.component for x in components.components(df).collect()} == brute_components(edges)


def test_tied_speakers(manifest):
    rows = [{"row_id": 1, "utterance_id": "AB_0000002_0000001", "speaker_id": "spk_0001"}, {"row_id": 2, "utterance_id": "ab-0000003-1", "speaker_id": "2.0"}]
    rows += [{"row_id": 3, "utterance_id": "AB_0000009_0000001"}, {"row_id": 4, "utterance_id": "AB_0000009_0000002", "speaker_id": " 0000009"}, {"row_id": 5}]
    got = {(r.speaker_a, r.speaker_b) for r in components.tied_speakers(manifest(rows)).collect()}
    assert got == {("0000001", "0000002"), ("0000001", "0000003"), ("0000002", "0000003")}
    assert components.tied_speakers(manifest([])).count() == 0


def versions(spark):
    rows = [("d", "v1", "train", 0.5), ("d", "v1", "dev", 0.25), ("d", "v1", "test", 0.25), ("d", "v2", "train", 0.8), ("d", "v2", "dev", 0.1), ("d", "v2", "test", 0.1)]
    return spark.createDataFrame(rows, "dataset_id string, dataset_version string, split string, ratio double")


def test_splits_keep_speakers_and_proportions(spark, manifest):
    r = random.Random(3)
    rows = []
    for i in range(3000):
        s = 0 if i % 3 == 0 else r.randrange(1, 200)  # one speaker has a third of all rows
        rows.append({"row_id": i, "utterance_id": f"AB_{s:07d}_{i:07d}", "speaker_id": f"{s:07d}", "dataset_id": "d"})
    rows.append({"row_id": 9000, "utterance_id": "AB_0000005_0009000", "speaker_id": "0000006", "dataset_id": "d"})
    rows += [{"row_id": 9001}, {"row_id": 9002, "dataset_id": "d"}]
    got = components.split_rows(manifest(rows), versions(spark))
    by = got.groupBy("component").agg(F.count_distinct("split").alias("n"))
    assert by.where("n > 1").count() == 0 and got.where("split is null").count() == 0 and got.count() == len(rows)
    share = {x.split: x.n / len(rows) for x in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["dev"] - 0.1) < 0.03
    one = {x.row_id: x.split for x in got.collect()}
    assert one[9000] == next(one[q["row_id"]] for q in rows if q.get("speaker_id") == "0000005")
    assert components.split_rows(manifest([]), versions(spark)).count() == 0


@pytest.mark.parametrize("none", ["train", "dev", "test"])
def test_a_split_of_ratio_0_gets_no_rows_and_no_heavy_components(spark, manifest, none, monkeypatch):
    ratios = {k: 0.0 if k == none else v for k, v in {"train": 0.7, "dev": 0.3, "test": 0.3}.items()}
    given = spark.createDataFrame([("d", "v1", k, v) for k, v in ratios.items()], "dataset_id string, dataset_version string, split string, ratio double")
    rows = [{"row_id": i, "utterance_id": f"AB_{i // 5:07d}_{i:07d}", "speaker_id": f"{i // 5:07d}", "dataset_id": "d"} for i in range(2000)]
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema: made.append((schema, data)) or create(self, data, schema))
    df = manifest(rows)
    got = {x.split: x.n for x in components.split_rows(df, given).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert set(got) == set(ratios) - {none} and sum(got.values()) == 2000
    assert all(abs(n / 2000 - ratios[k] / sum(ratios.values())) < 0.05 for k, n in got.items())
    assert {len(d) for s, d in made if "placed" in s} == {0}  # no component is heavy


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_keep_their_split_as_deliveries_are_added(spark, manifest, seed):
    """Only rows of a component that was joined to another may move; proportions hold after every delivery."""
    r = random.Random(seed)
    rows = []
    for i in range(4000):
        k = 1 + i * 6 // 4000 if r.random() < 0.9 else r.randrange(1, 7)  # some rows come late
        s = 1 if r.random() < 0.15 else r.randrange(2, 40 + 60 * k)
        other = r.randrange(1, 40 + 60 * k) if r.random() < 0.004 else s
        rows.append({"row_id": i, "utterance_id": f"AB_{s:07d}_{i:07d}", "speaker_id": f"{other:07d}", "dataset_id": "d" if s % 3 else "e", "delivery": k})
    rows += [{"row_id": 9000 + i, "dataset_id": "d", "delivery": 1 + i % 3} for i in range(5)]

    def at(k):
        held = [q for q in rows if q["delivery"] <= k]
        got = {x.row_id: x for x in components.split_rows(manifest(held), versions(spark)).collect()}
        assert set(got) == {q["row_id"] for q in held}
        ties = [(int(q["utterance_id"].split("_")[1]), int(q["speaker_id"])) for q in held if "speaker_id" in q]
        whole = brute_components([e for e in ties if e[0] != e[1]])
        of = {q["row_id"]: whole.get(int(q["utterance_id"].split("_")[1]), int(q["utterance_id"].split("_")[1])) for q in held if "utterance_id" in q}
        return {i: x.split for i, x in got.items()}, of

    last, last_of = at(6)
    share = {s: sum(v == s for v in last.values()) / len(last) for s in ("train", "dev", "test")}
    assert all(abs(share[s] - want) < 0.06 for s, want in {"train": 0.85, "dev": 0.075, "test": 0.075}.items())  # of 0.8 and 0.9
    for c in set(last_of.values()):
        assert len({last[i] for i, x in last_of.items() if x == c}) == 1
    for k in (1, 3):
        now, of = at(k)
        merged = {c for c in set(last_of[i] for i in of) if len({of[i] for i in of if last_of[i] == c}) > 1}
        assert all(now[i] == last[i] for i in now if i not in of or last_of[i] not in merged)


def test_plans_only_grow():
    plan = components.SplitPlan()
    want = {"d": {"train": 80.0, "dev": 10.0, "test": 10.0}}
    plan.fit(1, want, {}, [], {("d", c): 1 for c in range(0, 4000, 40)})
    first = dict(plan.ends)
    assert [s for s, _ in first["d", 1]] == ["train", "dev", "test"] and first["d", 1][0][1] == 3200 and first["d", 1][2][1] == components.CELLS
    plan.fit(2, {"d": {k: 2 * v for k, v in want["d"].items()}}, {("d", "train"): 100}, [{"dataset": "d", "head": 7, "n": 12}], {("d", c): 1 for c in range(0, 4000, 40)})
    assert plan.ends["d", 1] == first["d", 1] and plan.placed == {("d", 7): "train"} and plan.ends["d", 2][0][1] < 2900


def test_ratios_that_say_nothing_give_the_plain_ones(spark, manifest):
    given = spark.createDataFrame([("d", "v1", "train", 0.0), ("d", "v1", "dev", None), ("e", "v1", "other", 1.0), (None, "v1", "train", 1.0)], "dataset_id string, dataset_version string, split string, ratio double")
    rows = [{"row_id": i, "utterance_id": f"AB_{i // 4:07d}_{i:07d}", "dataset_id": ("d", "e", None)[i % 12 // 4], "delivery": (1, 2, None)[i % 3]} for i in range(1200)]
    got = components.split_rows(manifest(rows, extra=["split", "node", "component"]), given).collect()
    assert len(got) == 1200 and {x.split for x in got} == {"train", "dev", "test"}
    assert 0.8 < sum(x.split == "train" for x in got) / 1200 < 0.97
