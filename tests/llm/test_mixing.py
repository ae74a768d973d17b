import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.llm.mixing import fit_rates, mix_sources, shares


def tables(spark, docs, targets):
    return spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, source string, cap long"), spark.createDataFrame(targets, "source string, weight double, max_repeats long")


def test_shares_are_met(spark):
    docs = [(i, f"alpha beta {i} " * 5, "a") for i in range(300)] + [(1000 + i, f"gamma delta {i} " * 7, "b") for i in range(40)] + [(2000 + i, "x", "untargeted") for i in range(9)]
    docs += [(3000, None, "a"), (3001, "", "b"), (3002, None, None)]
    d, t = tables(spark, docs, [("a", 0.6, 1), ("b", 0.4, 4)])
    mix = mix_sources(d, t)
    rows = mix.collect()
    assert max(r.repeats for r in rows if r.source == "b") <= 4 and max(r.repeats for r in rows if r.source == "a") == 1
    assert {r.source for r in rows} == {"a", "b"}
    for r in shares(mix, t).collect():
        assert r.share == pytest.approx(r.weight, abs=0.01)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(d, t).collect()))


def test_unlabelled_documents_need_a_sure_classifier(spark):
    docs = [(i, "alpha beta epsilon " * 40, "a") for i in range(30)] + [(100 + i, "гамма дельта " * 40, "b") for i in range(30)] + [(200, "alpha beta epsilon " * 40, None)]
    d, t = tables(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    rows = {r.doc_id: r.source for r in mix_sources(d, t).collect()}
    assert rows.get(200, "a") == "a"
    assert 200 not in {r.doc_id for r in mix_sources(d, t, sure=1.1).collect()}


def test_least_squares_with_soft_members(spark):
    rows = [([1.0, 0.0], 2, 100), ([0.0, 1.0], 2, 50), ([0.7, 0.3], 1, 40)]
    classes = spark.createDataFrame(rows, "member array<double>, cap int, tokens long")
    history = fit_rates(classes, np.array([120.0, 80.0]))
    r = np.zeros(3)
    m = np.array([x[0] for x in rows])
    for g in history:
        r = np.clip(r + m @ np.array(g), 0, [x[1] for x in rows])
    assert (m * np.array([[x[2]] for x in rows]) * r[:, None]).sum(0) == pytest.approx([120, 80], rel=1e-4)


def test_empty(spark):
    d, t = tables(spark, [], [("a", 1.0, 1)])
    assert mix_sources(d, t).count() == 0
    d, t = tables(spark, [(1, "x", "a")], [])
    assert mix_sources(d, t).count() == 0
    d, t = tables(spark, [(1, "x y z", "a"), (2, "x", "b")], [("a", 0.5, 1), ("b", None, 1), ("c", 0.5, 2)])
    assert [r.doc_id for r in mix_sources(d, t).where(F.col("repeats") > 0).collect()] == [1]


def test_calibration_finds_whether_texts_tell_the_source():
    from pricemill.llm.mixing import calibrate

    rnd = np.random.default_rng(2)
    labels = rnd.integers(0, 3, 600)
    telling = rnd.normal(0, 0.1, (600, 3))
    telling[np.arange(600), labels] += 0.5
    prior = np.full(3, 1 / 3)
    assert calibrate(telling, labels, prior) > 5
    assert calibrate(rnd.normal(0, 1, (600, 3)), labels, prior) <= 0.2


def test_soft_members_where_sources_differ(spark):
    """Most documents have no source, and their texts tell it only in part: true shares still come near their targets."""
    rnd = np.random.default_rng(4)
    words = [[f"{s}{i}" for i in range(40)] for s in ("ax", "by", "cz")]
    docs, truth = [], {}
    for i in range(900):
        k = int(rnd.choice(3, p=[0.5, 0.3, 0.2]))
        mixed = [words[k][rnd.integers(40)] if rnd.random() < 0.7 else words[rnd.integers(3)][rnd.integers(40)] for _ in range(60)]
        truth[i] = "abc"[k]
        docs.append((i, " ".join(mixed), "abc"[k] if i % 3 == 0 else None))
    d, t = tables(spark, docs, [("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.3, 2)])
    rows = mix_sources(d, t, sure=0.5).collect()
    assert sum(r.doc_id % 3 > 0 for r in rows) > 200
    total = sum(r.n_tokens * r.repeats for r in rows)
    for s, w in (("a", 0.3), ("b", 0.4), ("c", 0.3)):
        assert sum(r.n_tokens * r.repeats for r in rows if truth[r.doc_id] == s) / total == pytest.approx(w, abs=0.03)


@pytest.mark.parametrize("telling", [0.0, 0.2])
def test_unsure_documents_are_soft_members(spark, telling):
    """Documents of which the classifier is unsure take part by their posterior, within every source's limit of repeats."""
    rnd = np.random.default_rng(7)
    words = [[f"{s}{i}" for i in range(40)] for s in ("ax", "by")]
    docs, truth = [], {}
    for i in range(600):
        k = int(rnd.choice(2, p=[0.6, 0.4]))
        truth[i] = "ab"[k]
        mixed = [words[k][rnd.integers(40)] if rnd.random() < telling else words[rnd.integers(2)][rnd.integers(40)] for _ in range(30)]
        docs.append((i, " ".join(mixed), "ab"[k] if i % 2 else None))
    d, t = tables(spark, docs, [("a", 0.4, 1), ("b", 0.6, 3), ("none", 0.0, 1)])
    mix = mix_sources(d, t)
    rows = mix.collect()
    soft = [r for r in rows if r.doc_id % 2 == 0]
    assert len(soft) > 50 and sum(0.1 < max(r.members.values()) < 0.9 for r in soft) > 20
    assert all(sum(r.members.values()) == pytest.approx(1) for r in rows)
    assert all(r.repeats <= min({"a": 1, "b": 3}[s] for s in r.members) for r in rows)
    assert {r.source: r.share for r in shares(mix, t).collect()} == pytest.approx({"a": 0.4, "b": 0.6, "none": 0.0}, abs=0.003)
    if not telling:  # where texts tell the source in part the true share of a is 0.31, see README
        total = sum(r.n_tokens * r.repeats for r in rows)
        assert sum(r.n_tokens * r.repeats for r in rows if truth[r.doc_id] == "a") / total == pytest.approx(0.4, abs=0.05)
