"""Operator 5: reversible line deduplication.

Exact state: ``postings`` (line key, document), one row each, and ``refs``, the reference counts (line key,
number of documents, largest document). On top of them, sharded cuckoo filters hold the fingerprints of the keys
that ``refs`` counts in at least ``min_docs`` documents. A filter answers for most lines that they need no look
into the exact table; what passes is joined with ``refs``, so results are exact. Documents can be inserted and
deleted: counts go up and down, keys enter and leave the filters.

A line's key is the 128-bit hash of the line stripped of ASCII white space with A-Z lower-cased; keys of fewer
than ``min_chars`` code points are never dropped. All of a dropped key's lines go, except in the document with
the largest id.

Scale: lines travel as 24-byte rows. A line that a third of all documents share is one key per (line, document)
until its count is pre-aggregated in the map tasks; its shard is salted for the filter probe; the exact join is
left to Spark's skew handling. Filters meet their lines by shard, each shard of bounded size, none broadcast.

Cases: a null text counts as empty, an empty text is one empty line; null ids are one document that precedes
all others; repeated rows of one document count once and each get the same result; rows that share a doc_id but
not the text form one document for counting; extra columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import NULL_ID, quoted, sha256, stored

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys per filter shard on average, parts that a shard's lines are dealt to.
SHARD_KEYS, SALTS = 32_768, 8
SLOTS, KICKS = 4, 500


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16-byte key of a line, or None if it is too short to be dropped."""
    line = line.strip().lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (k1, k2, did): the keys of each document's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = [], []
            for text in b.column(1):
                found = {k for line in (text.as_py() or "").encode().split(b"\n") if (k := line_key(line, min_chars))}
                keys += found
                n.append(len(found))
            k = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            did = np.repeat(b.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(did)], names=["k1", "k2", "did"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), "text")
    return rows.mapInArrow(run, "k1 long, k2 long, did long")


# --- cuckoo filters ---------------------------------------------------------------------------------------


class Cuckoo:
    """Buckets of four 16-bit fingerprints; each key may sit in two buckets, a power of two of them in all."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def places(k1: np.ndarray, k2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, for ``n`` buckets."""
        fp = (k1.view(np.uint64) >> np.uint64(48)).astype(np.uint64)
        fp[fp == 0] = 1
        first = k2.view(np.uint64) & np.uint64(n - 1)
        other = first ^ (fp * np.uint64(0x5BD1E995) & np.uint64(n - 1))
        return fp.astype(np.uint16), first.astype(np.int64), other.astype(np.int64)

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> Cuckoo:
        """A filter of the keys, with as many buckets as it takes."""
        n = 1 << max(2, int(np.ceil(np.log2(max(1, len(k1)) / SLOTS / 0.8))))
        while True:
            made = cls(np.zeros((n, SLOTS), np.uint16))
            if made.insert(k1, k2):
                return made
            n *= 2

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Add keys; False if one found no place (then the filter must be rebuilt from the exact table)."""
        table, n = self.table, len(self.table)
        for f, i, j in zip(*(x.tolist() for x in self.places(k1, k2, n)), strict=True):
            for kick in range(KICKS):
                for at in (i, j):
                    if (free := np.flatnonzero(table[at] == 0)).size:
                        table[at, free[0]] = f
                        break
                else:
                    slot = kick % SLOTS
                    f, table[j, slot] = int(table[j, slot]), f
                    i, j = j, j ^ (f * 0x5BD1E995 & n - 1)
                    continue
                break
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Remove keys that were inserted."""
        for f, i, j in zip(*(x.tolist() for x in self.places(k1, k2, len(self.table))), strict=True):
            for at in (i, j):
                if (hit := np.flatnonzero(self.table[at] == f)).size:
                    self.table[at, hit[0]] = 0
                    break

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """For each key whether it may be in the filter; never False for one that is."""
        fp, i, j = self.places(k1, k2, len(self.table))
        return ((self.table[i] == fp[:, None]) | (self.table[j] == fp[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def _shard(shards: int):
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).cast("int").alias("shard")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) over distinct keys (k1, k2); a shard's keys are few by the number of shards."""

    def make(group: pa.Table) -> pa.Table:
        k1, k2 = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k1", "k2"))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([Cuckoo.of(k1, k2).to_bytes()], pa.binary())})

    return keys.select(_shard(shards), "k1", "k2").groupBy("shard").applyInArrow(make, "shard int, filter binary")


def update_filters(filters: DataFrame, changes: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Filters after ``changes`` (k1, k2, add): keys leave and enter; a filter that has got too full is built
    anew from the exact ``keys``."""

    def change(old: pa.Table, new: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        f = Cuckoo.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else Cuckoo(np.zeros((4, SLOTS), np.uint16))
        k1, k2, add = (new.column(c).to_numpy() for c in ("k1", "k2", "add"))
        add = add.astype(bool)
        f.delete(k1[~add], k2[~add])
        done = f.insert(k1[add], k2[add])
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.to_bytes() if done else None], pa.binary())})

    dealt = changes.select(_shard(shards), "k1", "k2", "add")
    changed = stored(filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(change, "shard int, filter binary"))
    full = changed.where("filter is null").select("shard")
    again = build_filters(keys.select(_shard(shards), "k1", "k2").join(full, "shard", "left_semi"), shards)
    return stored(changed.where("filter is not null").unionByName(again))


def probe(rows: DataFrame, filters: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """The rows (k1, k2, did) whose key may be in the filter of its shard. Filters and rows stream by shard and
    salt, the filter first; nothing but one filter is held."""
    left = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "did")), "filter")
    right = rows.select(_shard(shards), F.pmod(F.xxhash64("did"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "k1", "k2", "did", F.lit(None).cast("binary").alias("filter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            shard, salt, kind, k1, k2, did = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            keep = np.zeros(b.num_rows, bool)
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if kind[lo] == 0:
                    at, held = (shard[lo], salt[lo]), Cuckoo.from_bytes(b.column(6)[lo].as_py())
                elif at == (shard[lo], salt[lo]):
                    keep[lo:hi] = held.has(k1[lo:hi], k2[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k1, k2, did)], names=["k1", "k2", "did"])

    return left.unionByName(right).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, "k1 long, k2 long, did long")


# --- state ------------------------------------------------------------------------------------------------


@dataclass
class LineIndex:
    """The exact tables and the filters over them. All are written tables; a change makes new ones."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int

    def dropped(self) -> DataFrame:
        return self.refs.where(F.col("n_docs") >= self.min_docs)


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("did").alias("max_did"))


def build(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
    postings = stored(lines(docs, min_chars).distinct())
    refs = stored(_count(postings))
    keys = refs.where(F.col("n_docs") >= min_docs).select("k1", "k2")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    return LineIndex(postings, refs, stored(build_filters(keys, shards)), shards, min_docs)


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index for new postings, of which only the ``touched`` keys are counted again."""
    fresh = _count(postings.join(touched, ["k1", "k2"], "left_semi"))
    refs = stored(index.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(fresh))
    was = index.dropped().select("k1", "k2")
    now = refs.where(F.col("n_docs") >= index.min_docs).select("k1", "k2")
    changes = stored(now.join(was, ["k1", "k2"], "left_anti").withColumn("add", F.lit(1)).unionByName(was.join(now, ["k1", "k2"], "left_anti").withColumn("add", F.lit(0))))
    return LineIndex(postings, refs, update_filters(index.filters, changes, now, index.shards), index.shards, index.min_docs)


def insert(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with more documents; what it has already of a document isn't counted twice."""
    new = stored(lines(docs, min_chars).distinct().join(index.postings, ["k1", "k2", "did"], "left_anti"))
    return _changed(index, stored(index.postings.unionByName(new)), new.select("k1", "k2").distinct())


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents whose doc_id ``doc_ids`` lists: as if they had never been inserted."""
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did")).distinct()
    touched = stored(index.postings.join(gone, "did", "left_semi").select("k1", "k2").distinct())
    return _changed(index, stored(index.postings.join(gone, "did", "left_anti")), touched)


def apply(index: LineIndex, docs: DataFrame, rows: DataFrame | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with kept text in ``text`` and the columns ``_n_lines`` and ``_n_dropped``. ``rows``: the keys of
    the documents' lines if they are at hand."""
    rows = lines(docs, min_chars).distinct() if rows is None else rows
    hits = (
        probe(rows, index.filters, index.shards)
        .join(index.dropped().select("k1", "k2", "max_did"), ["k1", "k2"])
        .where("did <> max_did")
        .select(F.col("did").alias("_did"), F.struct("k1", "k2").alias("k"))
        .groupBy("_did")
        .agg(F.collect_list("k").alias("_drop"))
    )
    names = docs.columns
    at = names.index("text")
    schema = docs.select(*map(quoted, names)).schema.add("_n_lines", "long").add("_n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(at), b.column(len(names)), strict=True):
                text, drop = text.as_py() or "", drop.as_py()
                if drop:
                    gone = set(np.array([(d["k1"], d["k2"]) for d in drop], ">i8").tobytes()[i : i + 16] for i in range(0, 16 * len(drop), 16))
                    all_lines = text.encode().split(b"\n")
                    kept = [x for x in all_lines if line_key(x, min_chars) not in gone]
                    texts.append(b"\n".join(kept).decode())
                    n_lines.append(len(all_lines))
                    n_dropped.append(len(all_lines) - len(kept))
                else:
                    texts.append(text)
                    n_lines.append(text.count("\n") + 1)
                    n_dropped.append(0)
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    return (
        docs.select(*(quoted(c).alias(f"_{i}") for i, c in enumerate(names)), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_did"))
        .join(hits.hint("shuffle_hash"), "_did", "left")
        .select(*(f"_{i}" for i in range(len(names))), "_drop")
        .mapInArrow(run, schema)
    )


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` or more of its own documents share, but for the largest id."""
    index = build(docs, min_docs, min_chars)
    return apply(index, docs, index.postings, min_chars)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.array([sha256(t.as_py().encode()) for t in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), kept], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return dedup(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
