"""The parts of the n-gram Jaccard join: components, the forest, adapted prefixes, families of several blocks."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_near

from terraloom.llm import near_join
from terraloom.llm.components import components
from terraloom.llm.common import stored


def roots(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b]
    path = rng.permutation(200).tolist()
    edges += [(1000 + a, 1000 + b) for a, b in zip(path[:-1], path[1:], strict=True)] + [(5000, i) for i in range(5001, 5100)]  # a path and a hub
    df = spark.createDataFrame(edges + edges[:20] + [(7, 7)], "a long, b long")
    assert {r["id"]: r["label"] for r in components(df).collect()} == {k: v for k, v in roots(edges).items()}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows(n=90, words=120):
    """Chains of texts that drift apart, tight groups of several sizes, and texts of their own."""
    rng = np.random.default_rng(3)
    rows, text = [], [f"c{i}" for i in range(words)]
    for i in range(n):
        rows.append((i, " ".join(text)))
        for at in rng.integers(0, words, 1):
            text[at] = f"d{i}"
    base = [f"w{i}" for i in range(60)]
    for i in range(40):
        own = list(base)
        own[int(rng.integers(0, 60))] = f"x{i}"
        rows.append((1000 + i, " ".join(own)))
    return rows + [(2000 + i, " ".join(f"own{i}_{k}" for k in range(30))) for i in range(20)]


def test_families_of_several_blocks(spark, monkeypatch):
    """Blocks of few sets, several size bands, classes that no single block sees whole."""
    monkeypatch.setattr(near_join, "BLOCK_SETS", 7)
    rows = near_rows()
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_near(rows)


@pytest.mark.parametrize("texts, most", [("alike", 8), ("apart", 7)])
def test_prefixes_are_shortened_until_the_target_recall(spark, texts, most):
    """Links of high similarity leave prefixes long until the last pass; those close to the threshold need short ones at once."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        own, step = list(base), 1 if texts == "alike" else 4
        for k in range(step):
            own[(13 * i + 97 * k) % 400] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    lengths = []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near_join.joined(df, lengths=lengths)
    assert lengths[0] == near_join.DEPTH and len(lengths) > 1 and sorted(lengths, reverse=True) == lengths
    assert lengths[-1] == near_join.least_depth(0.8, near_join.RECALL) and (lengths[-2] > most if texts == "alike" else lengths[1] <= most)


def test_a_lone_link_at_the_threshold_is_not_lost_beside_close_ones(spark):
    """Its two sets share no prefix of the lengths that the close links are content with."""
    rng, base = np.random.default_rng(8), [f"w{i}" for i in range(300)]
    close = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"]))]
    minima = lambda text: np.frombuffer(near_join.signature(near_join.grams([text.encode()])[0]), np.uint16).reshape(near_join.TREES, near_join.DEPTH)
    for trial in range(400):
        words = [f"t{trial}_{i}" for i in range(200)]
        other = list(words)
        for at in rng.choice(np.arange(3, 197), 4, replace=False):
            other[at] = f"u{trial}_{at}"
        a, b = " ".join(words), " ".join(other)
        x, y = (near_join.grams([t.encode()])[0] for t in (a, b))
        alike = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        shared = (np.cumprod(minima(a) == minima(b), axis=1)).sum(axis=1).max()
        if 0.8 <= alike < 0.83 and near_join.least_depth(0.8, near_join.RECALL) <= shared < 10:
            break
    else:
        raise AssertionError("no such pair")
    rows = spark.createDataFrame([*close, (3, a), (4, b)], "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_join.classes(rows).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)}


def test_choice_of_prefixes():
    low = near_join.least_depth(0.8, 0.999)
    assert low == 6 and near_join.chance(0.8, 6) >= 0.999 > near_join.chance(0.8, 7)
    shorter = lambda bins, depth, tried: near_join._shorter(bins, depth, low, tried, 0.999)
    assert shorter({80: 1, 99: 1000}, 12, 101) == 6  # the target has to hold at each similarity
    assert shorter({99: 1000}, 12, 101) == 10  # a first look below
    assert shorter({99: 1000}, 10, 99) == 6  # nothing lower came up: the pass that holds for links at the threshold
    assert shorter({84: 1, 99: 1000}, 10, 99) == max(d for d in range(6, 11) if near_join.chance(0.84, d) >= 0.999)
    assert shorter({}, 12, 101) == 10 and shorter({}, 6, 101) == 6


def test_rows_grow_with_the_family_not_its_square(spark, monkeypatch):
    """One row per linked set, and packed rows by pairs of blocks."""
    monkeypatch.setattr(near_join, "BLOCK_SETS", 100)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 120], f"x{i}", *base[i % 120 + 1 :]])) for i in range(1000)]
    docs = near_join._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = stored(near_join.signed(docs).select("sid", "grams", "signature", F.struct("did", "rid").alias("rep"), F.lit(1).cast("long").alias("copies"), F.lit(1).alias("rep_rows")))
    family = sets.select(F.xxhash64("sid").alias("id"), F.lit(1).cast("long").alias("label"))
    links = near_join._links(near_join._parts(docs, sets, family, 0.8, False), 0.8)
    assert links.count() == 1000 and links.select("class").distinct().count() == 1


def test_forest_does_not_depend_on_partitions(spark):
    """Runs that are cut by the seams between partitions come out whole."""
    rows = near_rows()
    docs = near_join._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = stored(near_join.signed(docs).select("sid", "signature"))
    sets = stored(sets.dropDuplicates(["sid"]))
    want = None
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            edges = stored(near_join.forest(sets, [8, 6]))
            found = {d: roots([(r["a"], r["b"]) for r in edges.where(F.col("depth") == d).collect()]) for d in (8, 6)}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        want = want or found
        assert found == want
    assert len(set(want[6].values())) < len(want[6])
