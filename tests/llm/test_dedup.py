"""Substring, line and near deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from terraloom.llm import line_dedup, near_join, substring_dedup

LOW = -(2**63)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key_of(doc_id):
    return LOW if doc_id is None else doc_id


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_substrings(rows, k=13):
    first = {}
    for doc_id, text in rows:
        w = words_of(text)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, key_of(doc_id)), key_of(doc_id))
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < key_of(doc_id):
                gone.update(range(i, i + k))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def test_substrings(mixed):
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert Counter(map(tuple, substring_dedup.digests(mixed).collect())) == brute_substrings(rows)


def test_substrings_with_overlapping_and_nested_copies(spark):
    a = [f"a{i}" for i in range(50)]
    b = [f"b{i}" for i in range(40)]
    rows = [
        (1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[10:40] + b[5:30])), (4, " ".join(b[20:] + a[:20] + a[30:])), (5, " ".join(["r"] * 40)), (6, " ".join(["r"] * 20 + a[3:17])),
        (7, " ".join(a[:12] + b[:13] + a[12:])), (8, " ".join(b * 3)), (9, " ".join(a[25:50] + ["q"] + a[25:50])), (10, " ".join(b * 2 + a)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.digests(df).collect())) == brute_substrings(rows)


def test_substrings_whatever_the_collisions(spark, docs):
    """Keys of few bits hide sources behind those of other windows; the result is the same."""
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(80).collect()]
    rows += [(1000 + i, " ".join(t.split()[i : i + 40])) for i, (_, t) in enumerate(rows[:40]) if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_substrings(rows)
    assert Counter(map(tuple, substring_dedup.digests(df, bits=13).collect())) == want


def test_paths_are_compacted_over_nonbranching_nodes(spark):
    """Two passages that always follow one another become one span, checked as a whole in all but the first copy."""
    a, b, c = ([f"{x}{i}" for i in range(30)] for x in "abc")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b)), (4, " ".join(["x", *a, *b])), (5, " ".join([*a, *b, "y"])), (6, " ".join(c)), (7, " ".join(["z"] + c))]
    docs = substring_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = substring_dedup.compact(substring_dedup.paths(docs))
    made = {(r["did"], r["start"]): (r["len"], len(r["segments"]), r["rep"] and r["rep"]["did"]) for r in spans.collect()}
    assert made[3, 0] == made[3, 30] == (18, 1, None)  # 3 is the first with the windows over the seam
    assert {k: v for k, v in made.items() if k[0] in (4, 5)} == {(4, 1): (48, 3, None), (5, 0): (48, 3, 4)}
    assert made[7, 1] == (18, 1, None)
    assert Counter(map(tuple, substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_substrings(rows)


def test_substring_dedup_keeps_columns_and_first_copies(odd):
    kept = substring_dedup.dedup(odd)
    assert set(kept.columns) == set(odd.columns)
    texts = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert any(i is None for i, _ in texts)  # the null id precedes the others and keeps the passage
    assert all("passage30" not in (t or "") for i, t in texts if i in (4, 5))


def brute_lines(rows, least=20, docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(key_of(doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and max(held[key(x)]) != key_of(doc_id))]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def test_lines(mixed):
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert Counter(map(tuple, line_dedup.digests(mixed).collect())) == brute_lines(rows)


def test_lines_in_several_filter_shards(mixed, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert Counter(map(tuple, line_dedup.digests(mixed).collect())) == brute_lines(rows)


def test_line_index_is_reversible(mixed, docs):
    """Inserting documents and deleting them again gives the drops of the rest alone."""
    distinct = docs.dropDuplicates(["doc_id"])
    old, new = distinct.where("doc_id % 3 <> 0"), distinct.where("doc_id % 3 = 0")
    grown = line_dedup.insert(line_dedup.build(old), new)
    whole = line_dedup.build(distinct)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(grown.refs) == rows(whole.refs)
    assert rows(line_dedup.apply(grown, distinct).select("doc_id", "text")) == rows(line_dedup.apply(whole, distinct).select("doc_id", "text"))
    shrunk = line_dedup.delete(grown, new.select("doc_id"))
    alone = line_dedup.build(old)
    assert rows(shrunk.refs) == rows(alone.refs)
    assert rows(line_dedup.apply(shrunk, old).select("doc_id", "text")) == rows(line_dedup.apply(alone, old).select("doc_id", "text"))


def test_cuckoo_filter_never_misses():
    import numpy as np

    rng = np.random.default_rng(5)
    k1, k2 = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    f = line_dedup.Cuckoo.of(k1, k2)
    assert f.has(k1, k2).all()
    f.delete(k1[:2500], k2[:2500])
    assert f.has(k1[2500:], k2[2500:]).all()
    assert f.has(k1[:2500], k2[:2500]).mean() < 0.05
    assert line_dedup.Cuckoo.from_bytes(f.to_bytes()).has(k1[2500:], k2[2500:]).all()


def brute_near(rows, threshold=0.8):
    def grams(text):
        w = words_of(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[a] = b
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), 2**63), key_of(doc_id))
    return Counter((d, None if low[root(i)] == LOW else low[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_near_copies(mixed):
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    got = near_join.classes(mixed)
    assert got.columns[:2] == ["doc_id", "class_id"]
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_near(rows)


def test_near_copies_of_a_large_family(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :])) for i, j in ((i, 7 * i % 120) for i in range(60))] + [(100 + i, " ".join(base)) for i in range(50)] + [(200, " ".join(reversed(base)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_join.classes(df).collect())
    want = brute_near(rows)
    assert {(d, c) for d, c, _ in got} == {(d, c) for d, c, _ in want}
    assert got == want


def test_near_dedup_keeps_one_of_each_class(mixed):
    rows = [(r["doc_id"], r["text"]) for r in mixed.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    kept = near_join.dedup(mixed.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, c, _ in brute_near(rows)})


@pytest.mark.parametrize("run", [substring_dedup.digests, line_dedup.digests, near_join.classes])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_dedups_keep_columns_whatever_their_names(odd):
    assert line_dedup.dedup(odd).drop("_n_lines", "_n_dropped").columns == odd.columns
    lines = {r["doc_id"]: r for r in line_dedup.dedup(odd).collect()}
    assert lines[6]["text"] == "own words" and lines[6]["_drop"] == "z" and lines[6]["a.b"] == 3
    near = near_join.dedup(odd)
    assert near.columns == odd.columns and near.where("doc_id in (15, 16)").count() == 1 and near.where("doc_id in (4, 5)").count() == 0  # like the null id


def test_near_dedup_keeps_one_of_repeated_rows(odd):
    assert near_join.dedup(odd.where("doc_id in (5, 17)")).count() == 2
