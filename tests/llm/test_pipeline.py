"""The pipeline against its stages by brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_dedup import brute_lines, brute_near, brute_substrings, words_of

from terraloom.llm import language
from terraloom.llm.common import stored


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, sf_dir))
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(outputs):
    for _, before, after in outputs[:-1]:
        assert after.columns == before.columns


def test_language_stage(outputs):
    _, before, after = outputs[0]
    model = language.train(before.where(~language.held_out()))
    kept = Counter((i, t) for i, t in rows(before) if model.predict(t)[0] != "und" and model.predict(t)[1] >= language.LEAST_SCORE)
    assert Counter(rows(after)) == kept


def test_line_stage(outputs):
    _, before, after = outputs[1]
    want = Counter((i, h) for i, _, _, h in brute_lines(rows(before)).elements())
    assert Counter((i, sha(t)) for i, t in rows(after)) == want


def test_near_stage(outputs):
    _, before, after = outputs[2]
    texts = rows(before)
    classes = defaultdict(list)
    for i, c, _ in brute_near(texts).elements():
        classes[c].append(i)
    assert sorted(i for i, _ in rows(after)) == sorted(min(v) for v in classes.values())


def test_substring_stage(outputs):
    _, before, after = outputs[3]
    want = Counter((i, h) for i, n, gone, h in brute_substrings(rows(before)).elements() if not n or gone < n)
    assert Counter((i, sha(" ".join(words_of(t)))) for i, t in rows(after)) == want


def test_packing_stage(outputs):
    _, before, after = outputs[4]
    assert {r["doc_id"] for r in after.collect()} == {i for i, _ in rows(before)}
    ends = defaultdict(int)
    for r in sorted(after.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096


def test_run_is_the_stages(spark, sf_dir, outputs):
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in outputs[4][2].collect())


def test_planted_passages_go(outputs):
    """No passage of over 50 words stays in two documents."""
    seen = {}
    for i, t in rows(outputs[3][2]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 50):
            assert seen.setdefault(tuple(w[k : k + 51]), i) == i


def chained(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def test_stages_take_odd_rows_and_clashing_columns(spark, sf_dir, odd, docs):
    """Null, empty, very long and repeated texts with columns named like the operators' own: all stages but the last keep the
    columns, and what comes out is in the last stage's input."""
    from pyspark.sql import functions as F

    extra = [c for c in odd.columns if c not in docs.columns]
    wide = docs.select(*docs.columns, *(F.lit(None).cast(odd.schema[c].dataType).alias(c) for c in extra)).unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stored(stage(spark, wide, sf_dir))
        assert sorted(made.columns) == sorted(odd.columns)
        wide = made
    last = stored(corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir))
    assert Counter(r["doc_id"] for r in last.where("piece = 0").collect()) == Counter(r["doc_id"] for r in wide.select("doc_id").collect())


def test_stages_take_an_empty_table(spark, sf_dir, empty):
    assert chained(spark, empty, sf_dir).count() == 0


def test_scratch_tables_can_be_cleared(spark, docs):
    import os

    from terraloom.llm import common

    made = stored(docs.limit(3))
    path = made.scratch_path.removeprefix("file://")
    assert os.path.isdir(path)
    before = set(common._WRITTEN)
    common._WRITTEN.intersection_update({made.scratch_path})
    common.clear(spark)
    assert not os.path.exists(path) and not common._WRITTEN
    common._WRITTEN.update(before - {made.scratch_path})
