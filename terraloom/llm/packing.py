"""Operator 6: sum-of-squares packing of documents into sequences.

Every document becomes its token ids and an end id; only what is longer than a sequence is cut. Tasks turn whole
texts into pieces (lengths and checksums, no ids); pieces are dealt evenly at random into shards of about
``SHARD_PIECES``, more shards for more input, and each shard is packed on its own, longest piece first: a piece
goes where the sum over gaps of (open sequences with that gap) squared becomes smallest, ties to the smallest
gap; a new sequence is one of the choices. What a shard leaves open is a few sequences, so the loss
against one single packing is a few per ``SHARD_PIECES`` pieces. No text is shuffled.

A worker remembers the ids of a bounded number of chunks between white space; the tokenizer drops white space
and none of its patterns spans it, so the ids of a text are those of its chunks.

Cases: a null text counts as empty, which is the end id alone; repeated rows are packed each on its own; a null
doc_id stays null; ties between equal lengths go by doc_id, piece and checksum; extra columns are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import stored
from terraloom.llm.vocab import WORD_BPE, Memory, tokenizer

CAPACITY, END_ID = 4096, 1
#: Pieces that one shard packs, on average.
SHARD_PIECES = 50_000
#: White-space chunks that one worker remembers, and the longest in code points.
REMEMBERED, LONGEST = 1_400_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class ChunkCoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Texts within Latin-1 have ASCII capitals lowered before they are cut, as the tokenizer would do (beyond
    Latin-1, marks could compose differently); the vocabulary's special strings count as they are written, so a text in
    which lowering makes or breaks one is cut as it is. The unknown words of some texts go through the library in one call
    and are told apart by the tokens that end a word."""

    def __init__(self, folder: str | None, name: str):
        import re

        self.coder = tokenizer(name, folder)
        self.memory = Memory(self.code, REMEMBERED, LONGEST)
        vocab = self.coder.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        special = [t.content.encode("latin-1") for t in self.coder.get_added_tokens_decoder().values() if not t.normalized]
        self.special, self.capital = [c for c in special if c == c.lower()], [c for c in special if c != c.lower()]
        self.split = re.compile(r"[^ \t-\r]+").findall
        self.stem = re.compile(rb"([a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def code(self, chunk: bytes | str) -> bytes:
        """Ids of one chunk between white space."""
        text = chunk.decode("latin-1") if isinstance(chunk, bytes) else chunk
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set) -> None:
        """Put the ids of chunks into the memory."""
        words, composed, old, stem_of = set(), [], self.memory.old, self.stem
        known, have, tails = {}, self.memory.get, {}
        for c in chunks:
            if old and (ids := old.get(c)) is not None:
                known[c] = ids
            elif isinstance(c, bytes) and len(c) <= LONGEST and (m := stem_of(c)):
                stem, tail = m.groups()
                if not tail:
                    words.add(stem)
                    continue
                if tail not in tails:
                    tails[tail] = self.memory[tail]
                if (ids := have(stem)) is not None:
                    known[c] = ids + tails[tail]
                else:
                    words.add(stem)
                    composed.append((c, stem, tails[tail]))
        found, words = {}, list(words)
        for lo in range(0, len(words), 2000):
            some = words[lo : lo + 2000]
            ids = np.array(self.coder.encode_batch_fast([b" ".join(some).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            data = ids.tobytes()
            found.update(zip(some, [data[4 * a : 4 * z] for a, z in zip([0, *cuts], cuts)], strict=True))
        known.update([(c, found[stem] + ids) for c, stem, ids in composed])
        known.update(found)
        self.memory.add(known)

    def changed(self, raw: bytes, low: bytes) -> bool:
        """Whether a text has other special strings when lowered."""
        return any(c in low and low.count(c) != raw.count(c) for c in self.special) or any(c in raw for c in self.capital)

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            try:
                raw = t.encode("latin-1")
                low = raw.lower()
                cut.append(self.split(t) if self.changed(raw, low) else low.split())
            except UnicodeEncodeError:
                cut.append(self.split(t))
        unknown, known, have = set(), [], self.memory.get
        for chunks in cut:
            ids = list(map(have, chunks))
            gaps = list(compress(range(len(ids)), map(is_, ids, repeat(None)))) if None in ids else ()
            unknown.update([chunks[j] for j in gaps])
            known.append((ids, gaps))
        if unknown:
            self.learn(unknown)
        out = []
        for chunks, (ids, gaps) in zip(cut, known, strict=True):
            for j in gaps:
                ids[j] = self.memory[chunks[j]]
            out.append(b"".join(ids))
        return out


_LOADED: dict = {}


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, folder: str | None = None, name: str = WORD_BPE) -> DataFrame:
    """The pieces of each document, of at most ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (folder, name) not in _LOADED:
            _LOADED[folder, name] = ChunkCoder(folder, name)
        code, end = _LOADED[folder, name], np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), code([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each of ``lengths``, placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_at: dict[int, list[int]] = {}
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.int64(2**60)
    for k, s in enumerate(lengths.tolist()):
        gaps = count[s:capacity]  # s, s + 1, .. capacity - 1
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        gap = capacity
        if gaps.size:
            change = 2 * (count[: capacity - s] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]  # a perfect fit leaves no gap
            change[gaps == 0] = far
            best = int(change.argmin())
            if change[best] <= fresh:
                gap = s + best
        if gap == capacity:
            at, n = n, n + 1
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = at, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_at.setdefault(gap - s, []).append(at)
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A place for each piece: ``sequence_id`` and ``offset``. ``items`` should be a written table."""
    shards = max(1, -(-items.count() // shard_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(group.column("length").to_numpy(), capacity)
        shard = group.column("shard")[0].as_py() if group.num_rows else 0
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (shard << 32))).append_column("offset", pa.array(offsets))

    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PACKED)


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, folder: str | None = None, name: str = WORD_BPE) -> DataFrame:
    """Each piece of each document with its place."""
    return pack(stored(pieces(docs, capacity, end_id, folder, name)), capacity)
