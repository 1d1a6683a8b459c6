"""Operator 1: byte-level BPE encoding and decoding.

Encoding keeps the symbols of a pre-token in a doubly linked list and the mergeable pairs in a priority
queue ordered by (merge rank, position); an entry whose pair has changed since it was queued is stale and
skipped. Decoding concatenates the vocabulary strings of the ids and maps their characters back to bytes.
Documents are independent, so the operator is one map over the scan: no shuffle, any skew is harmless, and a
lost task repeats alone. Each worker remembers the ids of a bounded number of pre-tokens.

Cases: a null text counts as empty; an empty text has no ids (digest of the empty string); rows are handled
one by one, so repeated rows repeat; a null doc_id stays null; extra columns are dropped; an empty table gives
an empty result; one pre-token may be as long as the text (n log n in its length).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import sha256
from terraloom.llm.vocab import BYTE_BPE, PRE_TOKEN, Memory, file_of

#: Pre-tokens that one worker remembers.
REMEMBERED = 600_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with its merge ranks. ``encode`` gives ids, ``decode`` gives text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.base = [vocab[c] for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.text_strings = {str(i): s for i, s in self.strings.items()}
        self._split = regex.compile(PRE_TOKEN).findall
        self._marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory = Memory(lambda piece: ",".join(map(str, self.merge(piece.encode()))), REMEMBERED)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        sym = [self.base[b] for b in data]
        n = len(sym)
        if n < 2:
            return sym
        pairs = self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if (hit := pairs.get(sym[i] << 32 | sym[i + 1])) is not None:
                queue.append(hit[0] << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if sym[i] < 0 or (j := after[i]) < 0:
                continue
            hit = pairs.get(sym[i] << 32 | sym[j])
            if hit is None or hit[0] != rank:
                continue  # stale: one of its symbols has merged meanwhile
            sym[i], sym[j] = hit[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (hit := pairs.get(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(queue, hit[0] << 32 | i)
            h = before[i]
            if h >= 0 and (hit := pairs.get(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(queue, hit[0] << 32 | h)
        return [s for s in sym if s >= 0]

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by commas; special strings in the text become their ids."""
        if self._marks is None or not any(s in text for s in self.special):
            return ",".join(map(self.memory.__getitem__, self._split(text)))
        parts = []
        for k, piece in enumerate(self._marks.split(text)):
            if k % 2:
                parts.append(str(self.special[piece]))
            elif piece:
                parts += map(self.memory.__getitem__, self._split(piece))
        return ",".join(parts)

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, folder: str | None = None, name: str = BYTE_BPE) -> DataFrame:
    """doc_id and ``ids`` (array of int) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file_of(name, folder))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, folder: str | None = None, name: str = BYTE_BPE) -> DataFrame:
    """doc_id and ``text`` from doc_id and ``ids``; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file_of(name, folder))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [bpe.decode(ids or ()) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, folder: str | None = None, name: str = BYTE_BPE) -> DataFrame:
    """Per document the count and digest of its ids, and the digest of what these ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file_of(name, folder))
        strings = bpe.text_strings
        for b in batches:
            n, coded, back = [], [], []
            for text in b.column(1):
                ids = bpe.encode_text(text.as_py() or "")
                listed = ids.split(",") if ids else []
                n.append(len(listed))
                coded.append(sha256(ids.encode()))
                back.append(sha256(b"".join(map(strings.__getitem__, listed)).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
