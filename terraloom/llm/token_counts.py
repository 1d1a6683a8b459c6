"""Operator 10: token counts from pre-token frequencies.

1. Every task counts the pre-tokens of its texts; Spark adds the counts up by pre-token.
2. The library counts the pieces of each distinct pre-token, once.
3. Every task turns a text into pre-token frequencies again. The pre-tokens above a frequency that at most
   ``HOT`` of them reach are looked up in a broadcast of that bounded size, long ones by their digest; only the rare rest
   is joined with the counts by shuffle, so that no join key is hot. Sums per document follow; no ids are ever made.

Cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside texts are one token each, as
the library has it; repeated rows each get a row; a null doc_id stays null; extra columns are dropped; an empty
table gives an empty result; a pre-token may be as long as a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import sha256, stored
from terraloom.llm.vocab import BYTE_BPE, PRE_TOKEN, tokenizer

#: Pre-tokens whose counts are broadcast at most, and the longest, in code points, that are known by themselves there.
HOT, HOT_CHARS = 200_000, 64
#: Distinct pre-tokens that a task holds before it passes their frequencies on.
HELD = 200_000


def splitter(folder: str | None, name: str):
    """Function that gives the pre-tokens of a text; special strings are pre-tokens of their own."""
    import regex

    split = regex.compile(PRE_TOKEN).findall
    special = [t.content for t in tokenizer(name, folder).get_added_tokens_decoder().values()]
    if not special:
        return split
    marks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def pieces(text: str) -> list[str]:
        if not any(s in text for s in special):
            return split(text)
        out = []
        for k, part in enumerate(marks.split(text)):
            out += [part] if k % 2 else split(part)
        return out

    return pieces


def frequencies(docs: DataFrame, folder: str | None = None, name: str = BYTE_BPE) -> DataFrame:
    """``piece`` and ``freq`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = splitter(folder, name), Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["piece", "freq"])
            held.clear()
            return out

        for b in batches:
            for text in b.column(0):
                held.update(pieces(text.as_py() or ""))
                if len(held) >= HELD:
                    yield given()
        yield given()

    return docs.select("text").mapInArrow(run, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))


def piece_counts(freqs: DataFrame, folder: str | None = None, name: str = BYTE_BPE) -> DataFrame:
    """``freqs`` with the number of tokens ``n`` of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            coded = t.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(c) for c in coded], pa.int32())], names=["piece", "freq", "n"])

    return freqs.select("piece", "freq").mapInArrow(run, "piece string, freq long, n int")


def _named(piece: str) -> str:
    """A pre-token, or the digest of a long one: what it is called in the broadcast."""
    return piece if len(piece) <= HOT_CHARS else f"sha256 {sha256(piece.encode())}"


def _hot_above(counts: DataFrame, most: int) -> int:
    """The least power of 2^(1/4) such that at most ``most`` pre-tokens are as frequent."""
    steps = counts.groupBy(F.floor(F.log2("freq") * 4).alias("step")).count().collect()
    total = 0
    for step, n in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        total += n
        if total > most:
            return step + 1
    return 0


def token_counts(docs: DataFrame, limit: int = 512, folder: str | None = None, name: str = BYTE_BPE, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    spark = docs.sparkSession
    counts = stored(piece_counts(frequencies(docs, folder, name), folder, name))
    is_hot = F.floor(F.log2("freq") * 4) >= _hot_above(counts, hot)
    named = F.when(F.length("piece") <= HOT_CHARS, F.col("piece")).otherwise(F.concat(F.lit("sha256 "), F.sha2("piece", 256)))
    known = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in counts.where(is_hot).select(named.alias("piece"), "n").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, n_of = splitter(folder, name), known.value
        rare_type = pa.list_(pa.struct([("piece", pa.string()), ("f", pa.int32())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sizes, base, rare, ends = [], [], [], [0]
                for text in part.column(2):
                    text = text.as_py() or ""
                    total = 0
                    for piece, f in Counter(pieces(text)).items():
                        n = n_of.get(piece if len(piece) <= HOT_CHARS else _named(piece))
                        if n is None:
                            rare.append((piece, f))
                        else:
                            total += n * f
                    sizes.append(len(text.encode()))
                    base.append(total)
                    ends.append(len(rare))
                flat = pa.StructArray.from_arrays([pa.array([p for p, _ in rare], pa.string()), pa.array([f for _, f in rare], pa.int32())], fields=list(rare_type.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(base, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=rare_type)],
                    names=["rid", "doc_id", "n_bytes", "base", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    rows = stored(rows.mapInArrow(run, "rid long, doc_id long, n_bytes long, base long, rare array<struct<piece:string,f:int>>"))
    rest = (
        rows.select("rid", F.explode("rare").alias("r"))
        .select("rid", "r.piece", "r.f")
        .join(counts.where(~is_hot).select("piece", "n"), "piece")
        .groupBy("rid")
        .agg(F.sum(F.col("n") * F.col("f")).alias("more"))
    )
    n_tokens = F.col("base") + F.coalesce("more", F.lit(0))
    return rows.drop("rare").join(rest, "rid", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
