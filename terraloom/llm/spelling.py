"""Operator 11: spelling variants, found by automata over the halves of words.

Words one edit apart share one half: the edit spares the first half, which then opens both words, or the second, which then
ends both. A pattern of a word is what stays around a free piece of it: at first its first or its second half. Patterns
are dealt by hash to shards; a shard's Aho-Corasick automaton holds the segments of its patterns. Every word goes to
the few shards that can hold a pattern of it, its own length and one less (the pattern's word is never the
longer one), and is scanned once in each. A pattern is met where its segments are found at the very beginning and end, as
its offsets and the lengths of both words ask for; the free pieces of both words are then compared.

Very common halves would make candidates of all pairs that share them. Patterns of more than ``HOT`` words are cut
instead: each half of their free piece becomes the free piece of a pattern with longer segments, again and again down to
free pieces of one letter, where all that is met is near but for equal pieces. Words that look for a cut pattern look for
its two parts. Cutting takes joins with the set of patterns that are too common, whose rows come once each, so no group of
words ever has to be in one task, and candidates stay in proportion to the words.

Forms follow from the near words' frequencies by one aggregate; roots by pointer doubling, as often as the largest frequency
can be divided by ten.

Cases: a null text has no words; a null doc_id counts as an empty string before the colon; repeated rows count each;
very long runs are words as others; ties go to the word that is first in code-point order; extra columns are dropped;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import stored

#: Every how many-th run loses a letter (by its checksum); least length and frequency of a word; how much more frequent a form is.
SLIP, LEAST_CHARS, LEAST_COUNT, FORM = 31, 7, 2, 10
#: Words of one pattern at most; patterns in a shard, about.
HOT, SHARD = 32, 8192
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000

#: ``[A-Za-z\\u00C0-\\u00FF]+`` in lower-cased UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


# --- words ------------------------------------------------------------------------------------------------


def words_of(doc_id: int | None, text: bytes | None) -> Iterator[tuple[str, int]]:
    """Long words of a text and their frequencies."""
    before = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(_RUN.findall((text or b"").lower())).items():
        if len(run) < LEAST_CHARS:
            continue
        h, word = zlib.crc32(run, before), run.decode()
        if h % SLIP == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        if len(word) >= LEAST_CHARS:
            yield word, n


def words(docs: DataFrame) -> DataFrame:
    """word and n, of the words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        given = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py()):
                    held[word] += n
                if len(held) >= HELD:
                    yield given()
                    held.clear()
        yield given()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- patterns ---------------------------------------------------------------------------------------------


def _opening(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``, of the pattern (length, lo, hi) at the word: what is before lo and from hi on, counted in the pattern's word."""
    closing = F.substring("word", F.col("hi") + F.col("longer") + 1, F.col("length"))
    return rows.withColumn("key", F.xxhash64("length", "lo", "hi", _opening(F.col("word"), F.col("lo")), closing))


def _cut(rows: DataFrame) -> DataFrame:
    """The patterns with each half of the free piece of those of ``rows``."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    pieces = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return _keyed(rows.select("word", "length", "longer", F.explode(pieces).alias("p")).select("word", "length", "longer", "p.lo", "p.hi"))


def patterns(found: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(word, length, longer, lo, hi, key): the patterns of words and those that words look for, which may be of words one letter shorter."""
    length = F.length("word").cast("int")
    whole = lambda longer: found.select("word", (length - longer).alias("length"), F.lit(longer).alias("longer"), F.lit(0).alias("lo"), (length - longer).alias("hi"))
    own, looks = _cut(whole(0)), _cut(whole(0).unionByName(whole(1)))
    final, sought = [], []
    while True:
        common = stored(own.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > hot).select("key"))
        if common.isEmpty():
            return _union([*final, own]), _union([*sought, looks])
        final.append(own.join(common, "key", "left_anti").select(own.columns))
        sought.append(looks.join(common, "key", "left_anti").select(looks.columns))
        own, looks = (stored(_cut(x.join(common, "key", "left_semi"))) for x in (own, looks))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- automata ---------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one longer, differs by exactly one letter replaced or inserted."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


class Shard:
    """An automaton over the segments of patterns, and the words of each pattern."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.words: dict[tuple[int, int, int], list[str]] = defaultdict(list)
        self.automaton = None

    def add(self, word: str, lo: int, hi: int) -> None:
        ends = (self.number.setdefault(s, len(self.number)) for s in (word[:lo], word[hi:]))
        self.words[(*ends, len(word))].append(word)

    def ready(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s, i in self.number.items():
            if s:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def near(self, word: str) -> set[str]:
        """Words of the patterns met in ``word`` that are one edit away and not longer; of equally long ones those before it."""
        n, opening, closing, found = len(word), [(0, 0)], [(0, 0)], set()
        for at, (i, size) in self.automaton.iter(word) if len(self.number) > 1 else ():
            if at + 1 == size:
                opening.append((i, size))
            if at + 1 == n:
                closing.append((i, size))
        for i, lo in opening:
            for j, size in closing:
                for length in (n, n - 1):
                    if lo + size < length:
                        for other in self.words.get((i, j, length), ()):
                            if other not in found and (length < n or other < word) and one_edit(other[lo : length - size], word[lo : n - size]):
                                found.add(other)
        return found


def links(found: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(a, b): near words, each pair once."""
    own, looks = patterns(found, hot)
    shards = F.pmod(F.col("key"), F.lit(max(1, -(-2 * found.count() // shard))))
    rows = own.select(shards.alias("shard"), F.lit(0).alias("looks"), "word", "lo", "hi").unionByName(
        looks.select(shards.alias("shard"), F.lit(1).alias("looks"), "word", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, last = None, Shard(), None
        for b in batches:
            left, right = [], []
            for number, look, word, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != at:
                    at, held, last = number, Shard(), None
                if not look:
                    held.add(word, lo, hi)
                    continue
                if word == last:  # it looks for several patterns of this shard
                    continue
                last = word
                if held.automaton is None:
                    held.ready()
                near = held.near(word)
                left += near
                right += [word] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])

    # a shard's patterns come first, so that its automaton is built once and the words stream past it
    return rows.repartition("shard").sortWithinPartitions("shard", "looks", "word").mapInArrow(run, "a string, b string").distinct()


# --- forms ------------------------------------------------------------------------------------------------


def forms(found: DataFrame, near: DataFrame, factor: int = FORM) -> DataFrame:
    """word, n, form, form_n, n_near of every word."""
    to_n = found.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    best = both.join(to_n, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    is_form = -F.col("best.minus") >= factor * F.col("n")
    return found.join(best, "word", "left").select(
        "word", "n", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")
    )


def with_roots(rows: DataFrame, factor: int = FORM) -> DataFrame:
    """Adds ``root``: where following forms ends."""
    moved = rows.where("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n").alias("n")).first()["n"] or 1
    steps = int(math.log(most, factor)) + 1  # longest chain: frequencies grow by the factor in each step
    for _ in range(steps.bit_length()):
        onward = moved.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(moved.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(moved, "word", "left").select(*rows.columns, F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    found = stored(words(docs))
    near = stored(links(found))
    return with_roots(stored(forms(found, near))).select("word", "form", "root", "n", "n_near", "form_n")
