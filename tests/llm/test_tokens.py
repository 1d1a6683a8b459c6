"""BPE, token counts and packing against the tokenizers library."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terraloom.llm import bpe, packing, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def byte_coder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def word_coder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_round_trip_is_the_library(mixed, byte_coder):
    want = Counter()
    for r in mixed.collect():
        ids = byte_coder.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(byte_coder.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.round_trip(mixed).collect())) == want


def test_encode_then_decode_gives_the_text(odd):
    back = bpe.decode(bpe.encode(odd)).collect()
    assert Counter(r["text"] for r in back) == Counter(r["text"] or "" for r in odd.select("text").collect())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_coded_like_the_library(text):
    from tokenizers import Tokenizer

    global _CODER
    try:
        _CODER
    except NameError:
        _CODER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.loaded(public_tokenizers.path("byte_bpe_50k.json")).encode(text) == _CODER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60) | st.text(alphabet="aZé'ßÀ!-_.1 \n\t́İ", max_size=40))
def test_any_text_is_packed_like_the_library(text):
    from tokenizers import Tokenizer

    global _WORDS
    try:
        _WORDS
    except NameError:
        _WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.ChunkCoder(None, "word_bpe_49k.json")
    library, own = _WORDS
    assert np.frombuffer(own([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_strings_in_other_case_are_packed_like_the_library(word_coder):
    texts = ["<|ENDOFTEXT|>", "Words <|EndOfText|> and <|endoftext|>", "x<|STARTOFTEXT|>Y <|startoftext|>", "<|endoftext|> Plain", "Ä<|Endoftext|>é", "Again <|ENDOFTEXT|> Again", "<|endoftext|><|ENDOFTEXT|>"]
    own = packing.ChunkCoder(None, "word_bpe_49k.json")
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in own(texts)] == [word_coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_are_the_library(mixed, byte_coder):
    want = Counter()
    for r in mixed.collect():
        n = len(byte_coder.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"], len((r["text"] or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, token_counts.token_counts(mixed).collect())) == want


def test_counts_without_frequent_pretokens(odd, byte_coder):
    got = token_counts.token_counts(odd, hot=0).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], len(byte_coder.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.select("doc_id", "text").collect())


def test_counts_of_long_frequent_pretokens(spark, byte_coder):
    """A ruler that many documents share is looked up by its digest and not joined."""
    rows = [(i, f"head {'=' * (300 + i % 2)}\n" * 3 + "z" * (64 + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df).collect()} == {i: len(byte_coder.encode(t, add_special_tokens=False).ids) for i, t in rows}


def check_packing(rows, documents, coder, capacity):
    """Pieces are the documents' ids, cut only where they are longer than a sequence; sequences are gapless."""
    by_piece, by_sequence = Counter(), defaultdict(list)
    for r in rows:
        by_piece[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for doc_id, text in documents:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert by_piece == want
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(n for places in by_sequence.values() for _, n in places)
    return len(by_sequence), -(-total // capacity)


def test_packing_holds_every_token_once(mixed, word_coder):
    documents = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    used, least = check_packing(packing.packed(mixed).collect(), documents, word_coder, 4096)
    assert used <= least * 1.05 + 1


def test_packing_in_shards(mixed, word_coder):
    documents = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    from terraloom.llm.common import stored

    rows = packing.pack(stored(packing.pieces(mixed, 512)), 512, shard_pieces=100).collect()
    used, least = check_packing(rows, documents, word_coder, 512)
    assert used <= least * 1.2 + 5


def brute_sum_of_squares(lengths, capacity):
    """The rule itself: try every open gap, take the smallest sum of squared counts, ties to the smallest gap, then a new bin."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for gap in [*sorted({g for g in gaps if g >= s}), capacity]:
            after = Counter(g for g in gaps if 0 < g < capacity)
            if gap != capacity:
                after[gap] -= 1
            if 0 < gap - s:
                after[gap - s] += 1
            cost = sum(c * c for g, c in after.items() if g)
            if best is None or cost < best[0]:
                best = (cost, gap)
        if best[1] == capacity:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(best[1])] = best[1] - s
        out.append(capacity - best[1])
    return out, len(gaps)


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 33, 60))[::-1]
        bins, offsets = packing.sum_of_squares(lengths, 32)
        want, n = brute_sum_of_squares(lengths.tolist(), 32)
        assert offsets.tolist() == want and len(set(bins.tolist())) == n


@pytest.mark.parametrize("run", [bpe.round_trip, token_counts.token_counts, packing.packed])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
