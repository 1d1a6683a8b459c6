"""Operator 2: substring deduplication by De Bruijn compaction.

Words are the maximal runs of anything but ASCII white space. The edges of the graph are k-mers of words (k = 13),
its nodes the (k-1)-mers between them. Only edges that start in several documents matter:

1. ``edges``: tasks hash the k-mers of whole texts (numpy, by slices of a few MB). Within a slice each
   k-mer is reduced to its first document, so that a passage of a third of all documents is one edge per slice;
   edges travel in packed blocks to hash buckets, more buckets for more text.
2. A bucket finds the edges that several documents share; each occurrence gets the source coordinate of its
   edge: the first document (and position) that has it. By document, runs of edges whose source coordinates
   run along are straight paths; only these few rows go on.
3. ``compact``: where one path ends and the next begins in a document, the node between is branching unless
   all paths that go on behind it go the same way, and all have come the same way. Spark joins paths over nonbranching nodes into long repeated spans; documents
   that have the same span share its representative, the span in the first of them.
4. ``verified``: source coordinates verify the spans, by 128-bit digests of the words here and there. A representative
   is held against the sources of each of its paths, every other copy as a whole against its representative.
5. Where digests differ, two k-mers share a key and one hides the other's source. The documents concerned and those
   that were claimed as their sources are done again with keys of another hash function, until all claims hold; what
   held before stays. So collisions neither remove nor save a word.

A word goes if a window (k-mer) that covers it also starts in a document with a smaller doc_id.

Cases: a null or empty text has no words; texts shorter than k words lose none; null ids are one document that
precedes all others; repeated rows each get the same result and don't remove one another; rows that share a
doc_id are one document as a source; a window repeated within one document is judged like its first; extra
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import byte_size, forget, quoted, release, sha256, stored, with_id

K = 13
#: Bytes of text that a task hashes at once, and that a bucket stands for on average. Both may grow with the
#: executors; their ratio decides how many edges share a packed block.
SLICE_BYTES, BUCKET_BYTES = 1 << 20, 8 << 20

SPAN = np.dtype([("start", "<u4"), ("len", "<u4"), ("src", "<i8"), ("srid", "<i8"), ("at", "<u4")])
_ROWS = "bucket int, spans binary, docs binary, keys binary"
_FOUND = "bucket int, spans binary"
_SPANS = "did long, rid long, start int, len int, src long, srid long, at int"

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_LETTER = _numbers(256, 1)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        step = np.full(max(n, 64), 0x9E3779B97F4A7C15 | 1, np.uint64)
        step[0] = 1
        _POWERS[0] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0]


def word_hashes(data: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a byte string; ``seed`` names the hash function."""
    b = np.frombuffer(data, np.uint8)
    full = ~_BLANK[b]
    first = full.copy()
    first[1:] &= ~full[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    b, full = b[starts[0] :], full[starts[0] :]
    at = starts - starts[0]
    offset = np.arange(len(b)) - np.repeat(at, np.diff(at, append=len(b)))
    value = (_LETTER if not seed else _numbers(256, 1 + 4 * seed))[b] * _powers(int(offset.max()) + 1)[offset]
    value[~full] = 0
    return starts, _mix(np.add.reduceat(value, at))


def windows(texts: list[bytes], k: int = K, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and word position of each k-mer of the texts."""
    starts, words = word_hashes(b" ".join(texts), seed)
    step = _numbers(k, 2 + 4 * seed) | np.uint64(1)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, edges)
    n = np.diff(bounds)
    if len(words) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = words[: len(words) - k + 1] * step[0]
    for i in range(1, k):
        h = h + words[i : len(words) - k + 1 + i] * step[i]
    text = np.repeat(np.arange(len(texts)), n)[: len(h)]
    pos = np.arange(len(h)) - bounds[text]
    ok = pos + k <= n[text]
    return _mix(h[ok]), text[ok], pos[ok]


def _straight(row: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans ordered by row and start, those that follow one another at their sources too joined."""
    order = np.lexsort((spans["start"], row))
    row, spans = row[order], spans[order]
    if not len(row):
        return row, spans
    cut = np.ones(len(row), bool)
    a, b = spans[:-1], spans[1:]
    cut[1:] = (row[1:] != row[:-1]) | (a["start"] + a["len"] != b["start"]) | (a["src"] != b["src"]) | (a["srid"] != b["srid"]) | (a["at"] + a["len"] != b["at"])
    heads = np.flatnonzero(cut)
    out = spans[heads].copy()
    out["len"] = np.add.reduceat(spans["len"], heads)
    return row[heads], out


def _dealt(did: np.ndarray, rid: np.ndarray, spans: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket of the documents, their spans packed column by column), a row per bucket."""
    mixed = _mix(did.astype(np.int64).view(np.uint64) ^ _mix(rid.astype(np.int64).view(np.uint64)))
    to = (mixed % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((spans["start"], rid, did, to))
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    out = []
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[i] : cuts[i + 1]]
        columns = [did[at].astype("<i8"), rid[at].astype("<i8"), *(spans[c][at] for c in SPAN.names)]
        out.append((i, np.array([len(at)], "<u4").tobytes() + b"".join(c.tobytes() for c in columns)))
    return out


def _undealt(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (did, rid) and spans of packed rows."""
    dids, rids, spans = [], [], []
    for data in parts:
        n, at = int(np.frombuffer(data, "<u4", 1)[0]), 4
        columns = []
        for d in ("<i8", "<i8", *(SPAN[c] for c in SPAN.names)):
            columns.append(np.frombuffer(data, d, n, at))
            at += n * np.dtype(d).itemsize
        s = np.empty(n, SPAN)
        for c, x in zip(SPAN.names, columns[2:], strict=True):
            s[c] = x
        dids.append(columns[0])
        rids.append(columns[1])
        spans.append(s)
    cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
    return cat(dids, np.int64), cat(rids, np.int64), cat(spans, SPAN)


def _spans(start, src, srid, at) -> np.ndarray:
    out = np.empty(len(start), SPAN)
    out["start"], out["len"], out["src"], out["srid"], out["at"] = start, 1, src, srid, at
    return out


_PLANES = (("<u4", 0), ("<u2", 32), ("<u1", 48))


def _packed(key: np.ndarray, did: np.ndarray, rid: np.ndarray, text: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes]:
    """Edges of one bucket in the order of their texts: the documents they start in with the number of each one's edges, then
    56 bits of the keys and steps of the positions, column by column and byte by byte so that they compress."""
    docs, n = np.unique(text, return_counts=True)
    head = did[docs].astype("<i8").tobytes() + rid[docs].astype("<i8").tobytes() + n.astype("<u4").tobytes()
    planes = [(key >> np.uint64(s)).astype(d).tobytes() for d, s in _PLANES]
    step = pos.copy()
    step[1:] -= np.where(text[1:] == text[:-1], pos[:-1], 0)
    return head, b"".join([*planes, *((step >> s).astype("<u1").tobytes() for s in (0, 8, 16, 24))])


def _unpacked(head: bytes, data: bytes) -> tuple[np.ndarray, ...]:
    m, at, parts = len(head) // 20, 0, []
    per_doc = np.frombuffer(head, "<u4", m, 16 * m).astype(np.int64)
    n = int(per_doc.sum())
    for d in (*(d for d, _ in _PLANES), "<u1", "<u1", "<u1", "<u1"):
        parts.append(np.frombuffer(data, d, n, at).astype(np.uint64))
        at += n * np.dtype(d).itemsize
    key = parts[0] | parts[1] << np.uint64(32) | parts[2] << np.uint64(48)
    step = sum((x << np.uint64(8 * i) for i, x in enumerate(parts[3:])), np.zeros(n, np.uint64)).astype(np.int64)
    total, first = np.cumsum(step), np.cumsum(per_doc) - per_doc
    pos = total - np.repeat((total - step)[first], per_doc)
    return key, np.repeat(np.frombuffer(head, "<i8", m), per_doc), np.repeat(np.frombuffer(head, "<i8", m, 8 * m), per_doc), pos


def _slice_rows(texts: list[bytes], did: np.ndarray, rid: np.ndarray, buckets: int, k: int, seed: int, bits: int) -> Iterator[tuple]:
    """Rows for the buckets from some whole texts, and the spans that these texts decide among themselves."""
    order = np.lexsort((rid, did))
    texts, did, rid = [texts[i] for i in order], did[order], rid[order]
    key, text, pos = windows(texts, k, seed)
    if not len(key):
        return
    key = key & np.uint64((1 << bits) - 1)
    order = np.argsort(key, kind="stable")  # then by text, thus by id, and position
    key, text, pos = key[order], text[order], pos[order]
    new = np.r_[True, key[1:] != key[:-1]]
    own = new | np.r_[True, text[1:] != text[:-1]]
    number = np.arange(len(key))
    lead = np.maximum.accumulate(np.where(new, number, 0))
    mine = np.maximum.accumulate(np.where(own, number, 0))
    later = did[text[lead]] < did[text]
    source = np.where(later, lead, mine)
    told = later | ~own
    t, m = text[told], source[told]
    row, spans = _straight(t, _spans(pos[told], did[text[m]], rid[text[m]], pos[m]))
    for i, data in _dealt(did[row], rid[row], spans, buckets):
        yield i, data, None, None
    place, key, text, pos = order[~told], key[~told], text[~told], pos[~told]
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket << 40 | place)
    key, text, pos, bucket = key[order], text[order], pos[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        p = slice(cuts[i], cuts[i + 1])
        yield i, None, *_packed(key[p], did, rid, text[p], pos[p])


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def edges(docs: DataFrame, buckets: int, k: int = K, seed: int = 0, bits: int = 64) -> DataFrame:
    """Packed edges by bucket, and spans decided within slices. ``docs``: did, rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, size = [], [], 0
        for b in batches:
            for did, rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = text.as_py().encode()
                texts.append(data)
                ids.append((did, rid))
                size += len(data) + 1
                if size >= SLICE_BYTES:
                    yield _table(list(_slice_rows(texts, *np.array(ids, np.int64).T, buckets, k, seed, bits)), _ROWS)
                    texts, ids, size = [], [], 0
        if texts:
            yield _table(list(_slice_rows(texts, *np.array(ids, np.int64).T, buckets, k, seed, bits)), _ROWS)

    return docs.select("did", "rid", "text").mapInArrow(run, _ROWS)


def _occurrences(rows: DataFrame, buckets: int) -> DataFrame:
    """What buckets of edges find and what slices had found, dealt by document: (bucket, spans)."""

    def run(group: pa.Table) -> pa.Table:
        spans, heads, data = (group.column(c).to_pylist() for c in ("spans", "docs", "keys"))
        at = group.column("bucket")[0].as_py()
        out = [(at, s) for s in spans if s is not None]
        parts = [_unpacked(h, d) for h, d in zip(heads, data, strict=True) if d is not None]
        if parts:
            key, did, rid, pos = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(key)
            same = np.r_[False, key[order][1:] == key[order][:-1], False]
            order = order[same[1:] | same[:-1]]  # edges that several slices have
            key, did, rid, pos = key[order], did[order], rid[order], pos[order]
            order = np.lexsort((pos, rid, did, key))
            key, did, rid, pos = key[order], did[order], rid[order], pos[order]
            if len(key):
                lead = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
                later = did[lead] < did
                out += _dealt(did[later], rid[later], _spans(pos[later], did[lead][later], rid[lead][later], pos[lead][later]), buckets)
        return pa.Table.from_batches([_table(out, _FOUND)])

    return rows.groupBy("bucket").applyInArrow(run, _FOUND)


def paths(docs: DataFrame, k: int = K, seed: int = 0, bits: int = 64) -> DataFrame:
    """The straight paths of each document: runs of shared edges and where their source has them. Keys are hashes of ``bits``
    bits, by the function that ``seed`` names."""
    buckets = max(1, -(-byte_size(docs) // BUCKET_BYTES))
    names = [c.split()[0] for c in _SPANS.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        did, rid, spans = _undealt(group.column("spans").to_pylist())
        order = np.lexsort((rid, did))
        did, rid, spans = did[order], rid[order], spans[order]
        doc = np.cumsum(np.r_[0, (did[1:] != did[:-1]) | (rid[1:] != rid[:-1])]) if len(did) else did
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(did) else doc
        order = np.lexsort((spans["len"], spans["start"], doc))  # where rows repeat, windows are told more than once
        d, x = doc[order], spans[order]
        one = np.r_[True, (d[1:] != d[:-1]) | (x["start"][1:] != x["start"][:-1]) | (x["len"][1:] != x["len"][:-1])] if len(d) else np.empty(0, bool)
        row, spans = _straight(d[one], x[one])
        columns = [did[first][row], rid[first][row], *(np.ascontiguousarray(spans[c]).astype(t) for c, t in (("start", np.int32), ("len", np.int32), ("src", np.int64), ("srid", np.int64), ("at", np.int32)))]
        return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))

    straight = stored(_occurrences(edges(docs, buckets, k, seed, bits), buckets).groupBy("bucket").applyInArrow(run, _SPANS))
    release(docs.sparkSession)
    return straight


def compact(straight: DataFrame) -> DataFrame:
    """Paths joined over nonbranching nodes: (did, rid, start, len, segments, rep), the segments being the straight
    paths with their source coordinates. ``rep``: where the first document with the same span has it, null for that
    span itself, for spans of one path and for those with a source in the representative's own document."""
    by_doc = Window.partitionBy("did", "rid").orderBy("start")
    edge = lambda src, srid, at: F.struct(src.alias("src"), srid.alias("srid"), at.alias("at"))
    c = F.col
    here = straight.select(
        "*",
        edge(c("src"), c("srid"), c("at")).alias("first"),
        edge(c("src"), c("srid"), (c("at") + c("len") - 1)).alias("last"),
        F.lag(F.struct((c("start") + c("len")).alias("end"), edge(c("src"), c("srid"), c("at") + c("len") - 1).alias("last"))).over(by_doc).alias("before"),
        F.lead(F.struct("start", edge(c("src"), c("srid"), c("at")).alias("first"))).over(by_doc).alias("after"),
    ).select(
        "*",
        F.when(c("before.end") == c("start"), c("before.last")).alias("came_from"),
        F.when(c("after.start") == c("start") + c("len"), c("after.first")).alias("goes_to"),
    )
    # an edge has one way out (in) if all paths that go on behind it (have come to it) do so the same way
    out = here.where(c("goes_to").isNotNull()).groupBy("last").agg(F.min("goes_to").alias("to"), F.max("goes_to").alias("to_too"))
    into = here.where(c("came_from").isNotNull()).groupBy("first").agg(F.min("came_from").alias("of"), F.max("came_from").alias("of_too"))
    simple = (
        out.where(c("to") == c("to_too"))
        .select("last", c("to").alias("first"))
        .join(into.where(c("of") == c("of_too")).select("first", c("of").alias("of")), "first")
        .where(c("last") == c("of"))
        .select(F.xxhash64("last", "first").alias("node"), c("last").alias("came"), c("first").alias("went"), F.lit(True).alias("joined"))
    )
    own = F.xxhash64("did", "rid", "start")  # deals rows that have no partner to many tasks
    keyed = here.withColumn("node", F.when(c("came_from").isNotNull(), F.xxhash64("came_from", "first")).otherwise(own))
    marked = keyed.join(simple, (keyed["node"] == simple["node"]) & (c("came_from") == c("came")) & (c("first") == c("went")), "left")
    numbered = marked.withColumn("path", F.sum(F.when(c("joined"), 0).otherwise(1)).over(by_doc))
    spans = numbered.groupBy("did", "rid", "path").agg(
        F.min("start").alias("start"), F.sum("len").cast("int").alias("len"), F.array_sort(F.collect_list(F.struct("start", "len", "src", "srid", "at"))).alias("segments")
    )
    coordinates = F.transform("segments", lambda x: F.struct(x["src"], x["srid"], x["at"], x["len"]))
    long = (F.size("segments") > 1) & F.forall("segments", lambda x: x["src"] < c("did"))
    spans = stored(spans.select("did", "rid", "start", "len", "segments", F.when(long, F.xxhash64(coordinates)).otherwise(own).alias("name"), long.alias("long")))
    rep = F.struct("did", "rid", "start")
    shared = spans.where("long").groupBy("name").agg(F.min(rep).alias("rep"), F.count("*").alias("n")).where("n > 1").select("name", "rep")
    other = spans.join(shared, "name", "left").withColumn("rep", F.when(c("long") & (c("rep") != rep), c("rep")))
    made = stored(other.select("did", "rid", "start", "len", "segments", "rep"))
    forget(straight.sparkSession, spans)
    return made


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _remove(text: str, did: int, rid: int, spans: list[dict], k: int) -> tuple[list[bytes], np.ndarray, list[dict]]:
    """Words of a text, which of them go, and what is claimed of other documents: their words at (src, srid, at)."""
    words = text.encode().split()
    covered = np.zeros(max(0, len(words) - k + 1), bool)
    claims, own = [], []
    digest = lambda start, n: _digest(words[start : start + n + k - 1])
    for span in spans:
        rep = span["rep"]
        if rep is not None:
            claims.append({"src": rep["did"], "srid": rep["rid"], "at": rep["start"], "len": span["len"], "digest": digest(span["start"], span["len"])})
        for s in span["segments"]:
            if s["src"] < did:
                covered[s["start"] : s["start"] + s["len"]] = True
                if rep is None:
                    claims.append({"src": s["src"], "srid": s["srid"], "at": s["at"], "len": s["len"], "digest": digest(s["start"], s["len"])})
            elif s["src"] == did and s["srid"] == rid:
                own.append(s)
    for s in own:
        n = k - 1 + s["len"]
        if words[s["start"] : s["start"] + n] == words[s["at"] : s["at"] + n]:
            covered[s["start"] : s["start"] + s["len"]] |= covered[s["at"] : s["at"] + s["len"]]
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(covered)
    edge[at] += 1
    edge[at + k] -= 1
    return words, np.cumsum(edge)[:-1] > 0, claims


def _kept_text(text: str, gone: np.ndarray) -> str:
    """The text without the words that go and the white space before each."""
    if not gone.any():
        return text
    data = text.encode()
    return b"".join(c for c, g in zip(_CHUNK.findall(data), gone.tolist(), strict=True) if not g).strip().decode()


_CLAIMS = "array<struct<src:long,srid:long,at:int,len:int,digest:binary>>"
_KEYS, _AT = ["did", "rid"], ["src", "srid", "at", "len"]


def _by_document(spans: DataFrame) -> DataFrame:
    """(did, rid, spans, asked): each document's spans, and what others claim of it."""
    flat = spans.select(*_KEYS, "len", "rep", F.explode("segments").alias("s"))
    by_path = flat.where("rep is null and s.src < did").select(F.col("s.src").alias("did"), F.col("s.srid").alias("rid"), F.struct("s.at", "s.len").alias("q"))
    as_whole = spans.where("rep is not null").select("rep.did", "rep.rid", F.struct(F.col("rep.start").alias("at"), "len").alias("q"))
    asked = by_path.unionByName(as_whole).distinct().groupBy(*_KEYS).agg(F.collect_list("q").alias("asked"))
    return spans.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "len", "segments", "rep")).alias("spans")).join(asked, _KEYS, "full_outer")


def _told(docs: DataFrame, wanted: DataFrame, whole_text: bool, k: int, how: str, claims: bool) -> DataFrame:
    """``docs`` with n_words, n_removed, kept and, if asked for, what they claim (``own``) and know of claims (``told``)."""
    names = [c for c in docs.columns if c not in ("did", "rid", "text")]
    out = docs.select(*_KEYS, *names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    if claims:
        out = out.add("own", _type(_CLAIMS)).add("told", _type(_CLAIMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("src", pa.int64()), ("srid", pa.int64()), ("at", pa.int32()), ("len", pa.int32()), ("digest", pa.binary())]))
        n = len(names)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = []
                for did, rid, text, spans, asks in zip(*(part.column(i).to_pylist() for i in (0, 1, n + 2, n + 3, n + 4)), strict=True):
                    words, gone, own = _remove(text, did, rid, spans or [], k)
                    kept = _kept_text(text, gone) if whole_text else sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words))
                    told = [{"src": did, "srid": rid, "at": q["at"], "len": q["len"], "digest": _digest(words[q["at"] : q["at"] + q["len"] + k - 1])} for q in asks or []]
                    rows.append((len(words), int(gone.sum()), kept, own, told))
                c = list(zip(*rows, strict=True)) or [()] * 5
                made = [pa.array(list(x), t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.string(), shape, shape), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: n + 2], *made[: 5 if claims else 3]], names=out.names)

    return docs.join(wanted.hint("shuffle_hash"), _KEYS, how).select(*_KEYS, *names, "text", "spans", "asked").mapInArrow(run, out)


def _unfounded(told: DataFrame) -> DataFrame:
    """The claims (src, srid, at, len) that some claimant's words contradict."""
    claims, facts = (told.select(F.explode(c).alias("o")).select("o.*").distinct() for c in ("own", "told"))
    return stored(claims.join(facts, [*_AT, "digest"], "left_anti").select(*_AT).distinct())


def _by_paths(spans: DataFrame) -> DataFrame:
    """Every segment as a span of its own."""
    one = spans.select(*_KEYS, F.explode("segments").alias("s"))
    return one.select(*_KEYS, F.col("s.start").alias("start"), F.col("s.len").alias("len"), F.array("s").alias("segments"), F.lit(None).cast("struct<did:long,rid:long,start:int>").alias("rep"))


def _claimed(spans: DataFrame) -> DataFrame:
    """Spans of one segment with the coordinates that they claim."""
    s = F.col("segments")[0]
    return spans.select("*", s["src"].alias("src"), s["srid"].alias("srid"), s["at"].alias("at"))


def verified(docs: DataFrame, spans: DataFrame, whole_text: bool, k: int = K, bits: int = 64) -> DataFrame:
    """Each row of ``docs`` (did, rid, text and more) with n_words, n_removed and what is kept of it, from spans
    that the words at their source coordinates have confirmed. ``kept``: the text with its own white space if
    ``whole_text``, else the digest of the kept words."""
    spark = docs.sparkSession
    release(spark, 3)  # texts travel next
    first = stored(_told(docs, _by_document(spans), whole_text, k, "left", True))
    wrong = _unfounded(first)
    result = first.drop("own", "told")
    if wrong.isEmpty():
        forget(spark, wrong)
        return result
    # a representative that is wrong itself is wrong for all that are like it
    by_path = _claimed(_by_paths(spans.where("rep is null"))).join(wrong, _AT, "left_semi").select(*_KEYS, F.col("start").alias("s"))
    bad = spans.where("rep is null").join(by_path, _KEYS).where("s >= start and s < start + len").select(F.col("did").alias("src"), F.col("rid").alias("srid"), F.col("start").alias("at"), "len")
    wrong = stored(wrong.unionByName(bad).distinct())
    like = spans.where("rep is not null").select(*_KEYS, F.col("rep.did").alias("src"), F.col("rep.rid").alias("srid"), F.col("rep.start").alias("at"), "len")
    again = stored(by_path.select(*_KEYS).unionByName(like.join(wrong, _AT, "left_semi").select(*_KEYS)).distinct())
    tried, sound, seed = _by_paths(spans.join(again, _KEYS, "left_semi")), None, 0
    while True:
        tried = stored(tried)
        told = stored(_told(docs.select(*_KEYS, "text"), _by_document(tried), False, k, "inner", True))
        wrong = _unfounded(told)
        claimed = _claimed(tried)
        good = claimed.join(wrong, _AT, "left_anti").select(tried.columns)
        sound = good if sound is None else sound.unionByName(good)
        if wrong.isEmpty():
            break
        seed, bits = seed + 1, min(64, bits + 8)
        redo = claimed.join(wrong, _AT, "left_semi").select(*_KEYS).unionByName(wrong.select(F.col("src").alias("did"), F.col("srid").alias("rid"))).distinct()
        tried = _by_paths(compact(paths(docs.select(*_KEYS, "text").join(redo, _KEYS, "left_semi"), k, seed, bits)))
    held = sound.join(again, _KEYS, "left_semi").groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "len", "segments", "rep")).alias("spans"))
    wanted = again.join(held, _KEYS, "left").withColumn("asked", F.lit(None).cast("array<struct<at:int,len:int>>"))
    return result.join(again, _KEYS, "left_anti").unionByName(_told(docs, wanted, whole_text, k, "inner", False))


def _type(ddl: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def _keyed(docs: DataFrame, *keep: str) -> DataFrame:
    return with_id(docs, *keep).withColumn("rid", F.xxhash64("text"))


def digests(docs: DataFrame, k: int = K, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document. ``bits``: the length of the first keys."""
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return verified(rows, compact(paths(rows, k, bits=bits)), False, k, bits).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def dedup(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` without the passages that a document with a smaller doc_id has; what loses all its words goes."""
    rows = _keyed(docs, *(quoted(c).alias(f"_{i}") for i, c in enumerate(docs.columns) if c != "text"))
    done = verified(rows, compact(paths(rows, k)), True, k).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return done.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
