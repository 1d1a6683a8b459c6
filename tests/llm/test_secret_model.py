"""The secret scanner's model learns from all windows, in shards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import secret_scan as scan

HEX, ALL = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        words = " ".join(r.choice(["river", "IPv6x", "v2beta", "the", "Room101b", "stone"]) for _ in range(6))
        secret = f" token = {''.join(r.choice(ALL) for _ in range(30))} " if i % 3 else f" {''.join(r.choice(HEX) for _ in range(32))} "
        rows.append((i, words + secret + words))
    return scan.stored(scan.findings(spark.createDataFrame(rows + rows[:9], "doc_id long, text string")))


def windows(found, folds):
    of = found.where(F.col("fold").isin(*folds)).select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.finding", "c.start", "c.window")
    return [(r["window"], r["finding"]) for r in of.orderBy(F.desc("finding"), F.xxhash64("doc_id", "start"), "doc_id", "start", "window").collect()]


def test_every_window_is_dealt_once_to_a_shard(found, monkeypatch):
    monkeypatch.setattr(scan, "SHARD", 150)
    rows, n = scan._shards(found)
    for held, folds in ((False, (0, 3)), (True, (1,))):
        got = [(r["window"], r["finding"]) for r in rows.where((F.col("held") == held) & (F.col("extra") == 0)).collect()]
        assert sorted(got) == sorted(windows(found, folds)) and len(got) == n[held, True] + n[held, False]
    assert rows.where("NOT held").select("shard").distinct().count() > 3


def test_one_shard_gives_the_model_of_all_windows_at_once(found):
    got, want = scan.fitted(found), scan.fit(windows(found, (0, 3)), windows(found, (1,)))
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got.net.weights, want.net.weights, strict=True))
    assert np.allclose([got.slope, got.offset, *got.thresholds], [want.slope, want.offset, *want.thresholds], atol=1e-6)


def test_many_shards_tell_findings_from_others(found, monkeypatch):
    monkeypatch.setattr(scan, "SHARD", 200)
    model, held = scan.fitted(found), windows(found, (2,))
    right = [(p >= model.thresholds[scan.shape(w)]) == f for p, (w, f) in zip(model.scores([w for w, _ in held]), held, strict=True)]
    assert len(right) > 100 and np.mean(right) > 0.9


def test_order_statistics_by_digits(spark):
    x = np.r_[np.random.default_rng(1).normal(0, 5, 500).round(2), [0.0, -0.0, 1e300, -1e300, 5e-324, 2.0, 2.0]]
    rows = spark.createDataFrame([(int(o), i % 2) for i, o in enumerate(scan.ordered(x))], "o long, odd int")
    odd = x[1::2]
    ranks = [(F.lit(True), k) for k in (0, 17, len(x) // 2, len(x) - 1)]
    assert scan.order_statistics(rows, ranks) == [np.sort(x)[k] for _, k in ranks]
    assert scan.quantiles(rows, [(F.col("odd") == 1, len(odd), q) for q in (0.01, 0.98, 1.0)]) == pytest.approx([np.quantile(odd, q) for q in (0.01, 0.98, 1.0)])
