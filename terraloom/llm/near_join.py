"""Operator 3: n-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of word 5-grams (a shorter text: the one gram of all its words); links join documents whose
sets have a Jaccard similarity of at least 0.8.

1. One map over the texts gives the 128-bit name of each set and its signature, ``TREES`` paths of ``DEPTH`` minima.
   Documents with the same set are one class from here on; a third of all documents may be one such class.
2. The forest: all paths are sorted once (range partitions of path and set, so that a path that many sets share is dealt
   over several tasks). In sorted order the sets below a node of a tree's prefix trie are a run. One pass over the
   sorted paths joins the sets of each run to its smallest one, at every depth; seams between partitions are joined
   from their first and last rows. Components of these stars are families.
3. Matched prefixes are ``DEPTH`` minima long at first. Their length is adapted to the links found: at length d a link of
   similarity s is found with probability 1 - (1 - s^d)^trees, and the longest prefixes are taken that reach the target
   recall at every similarity (in steps of 0.01) that links were found with. Links that no length so far could show say nothing
   about links closer to the threshold, so the last pass is always at the length where links at the threshold meet the
   target; where a shortening brings no links of lower similarity than before, that pass is the next one.
4. Families that a shorter prefix has changed are verified on the exact sets. A family of at most ``BLOCK_SETS`` sets
   is verified in one go. Of a larger one, sets of like size form packed blocks of bounded size; each block meets,
   one after another, the blocks whose sets are large and small enough to be similar. Every set comes out as one row:
   its number of links and the smallest sets that it is linked to. No pair ever is a row, nor are sets copied: what is sent
   is one packed row per pair of blocks.
5. Links to smallest sets give classes by components. Where a family of several blocks comes out as several classes,
   the blocks meet again with these as names of their sets, until no link leads from one to another.

In each pass the texts are dealt out once by document, and those of sets in changed families go on to their blocks.

Cases: a null or wordless text has no grams, links with none and is a class of its own; equal sets have
similarity 1; repeated rows are linked documents like any copies; null ids are one id that precedes all others and
its class_id is null; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import NULL_ID, forget, quoted, stored, with_id
from terraloom.llm.components import components
from terraloom.llm.substring_dedup import _mix, _numbers, windows, word_hashes

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 24, 12
#: Sets per block and grams per block, on average; bytes of text hashed at once.
BLOCK_SETS, BLOCK_GRAMS, SLICE_BYTES = 400, 500_000, 1 << 20
#: By how much prefixes are shortened to see whether links of lower similarity come up.
PROBE = 2

_A = (_numbers(TREES * DEPTH, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_numbers(TREES * DEPTH, 12) >> np.uint64(32)).astype(np.uint32)
_SIGNED = "did long, rid long, sid binary, grams int, signature binary"
_FOREST = "depth int, a long, b long, path binary"
_PART = "sid binary, label long, copies long, band int, block int, blocks int, set binary"
_LINKED = "sid binary, name binary, label long, links long, inner binary, outer binary, bins array<long>"


def grams(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit gram hashes of each text."""
    key, text, _ = windows(texts, GRAM)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    out = [np.unique(key[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
    for i, g in enumerate(out):
        if not len(g):
            _, words = word_hashes(texts[i])
            if len(words):
                out[i] = _mix(np.array([words.sum() + np.uint64(len(words))], np.uint64)) if len(words) == 1 else np.array([xxhash.xxh3_64_intdigest(words.tobytes())], np.uint64)
    return out


def signature(g: np.ndarray) -> bytes:
    """16 bits of the least value of each permutation over a set, tree by tree."""
    x = (g >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * _A + _B).min(axis=0), out=least)
    return (_mix(least.astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes()


def _batches(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of bounded size with their texts."""
    lo, size, texts = 0, 0, []
    for i, text in enumerate(b.column(column)):
        texts.append(text.as_py().encode())
        size += len(texts[-1])
        if size >= SLICE_BYTES:
            yield lo, i + 1, texts
            lo, size, texts = i + 1, 0, []
    if texts:
        yield lo, b.num_rows, texts


def signed(docs: DataFrame) -> DataFrame:
    """(did, rid, sid, grams, signature) of each document; sid is null if it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _batches(b, 2):
                sets = grams(texts)
                sid = [xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in sets]
                signs = [signature(g) if len(g) else None for g in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(sid, pa.binary()), pa.array([len(g) for g in sets], pa.int32()), pa.array(signs, pa.binary())],
                    names=["did", "rid", "sid", "grams", "signature"],
                )

    return docs.select("did", "rid", "text").mapInArrow(run, _SIGNED)


# --- the forest -------------------------------------------------------------------------------------------


def chance(s: float, depth: int) -> float:
    """Probability that a link of similarity ``s`` shares a prefix of ``depth`` minima in some tree."""
    return 1 - (1 - min(1.0, s) ** depth) ** TREES


def least_depth(threshold: float, recall: float) -> int:
    """The longest prefixes that find links at the threshold with the target recall: shorter ones are never needed."""
    return next((d for d in range(DEPTH, 1, -1) if chance(threshold, d) >= recall), 1)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefixes, in minima, of paths (rows of bytes, the first of them the tree)."""
    same = np.concatenate([x == y, np.zeros((len(x), 1), bool)], axis=1)
    return np.maximum(same.argmin(axis=1) - 1, -1) // 2


def _stars(depths: list[int]):
    """Function over sorted (path, node) rows: the sets of each run of each depth joined to the least of the run, and the
    partition's first (depth -1) and last (-2) row, with the partition's number as ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, part, ends = None, {}, TaskContext.get().partitionId(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(1).to_numpy()
            path = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(node), -1)
            if last is None:
                ends.append((-1, int(node[0]), part, path[0].tobytes()))
            before = np.concatenate([path[:1] if last is None else last[None], path[:-1]])
            depth_of = _common(path, before)
            if last is None:
                depth_of[0] = -1
            out = []
            for d in depths:
                cut = np.flatnonzero(depth_of < d)
                cut = cut if len(cut) and cut[0] == 0 else np.r_[0, cut]
                least = np.minimum.reduceat(node, cut)
                goes_on = depth_of[0] >= d
                if goes_on and head[d] != least[0]:
                    low = min(head[d], int(least[0]))
                    out.append((d, np.array([head[d] + int(least[0]) - low]), np.array([low])))
                    least[0] = low
                to = np.repeat(least, np.diff(cut, append=len(node)))
                off = node != to
                out.append((d, node[off], to[off]))
                head[d] = int(least[-1])
            last = path[-1]
            final = (-2, int(node[-1]), part, last.tobytes())
            a, b = (np.concatenate([o[k] for o in out]) for k in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([d for d, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int32)), pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names=["depth", "a", "b", "path"]
            )
        if last is not None:
            c = list(zip(*ends, final, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["depth", "a", "b", "path"])

    return run


def forest(sets: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, a, b): edges that join the sets of each run of common prefixes of each depth. A row per set, tree and depth at
    most; the seams are two rows per partition."""
    spark, width = sets.sparkSession, 2 * DEPTH
    paths = F.array(*(F.concat(F.lit(bytearray([t])), F.substring("signature", t * width + 1, width)) for t in range(TREES)))
    rows = sets.select(F.explode(paths).alias("path"), F.xxhash64("sid").alias("node")).repartitionByRange("path", "node").sortWithinPartitions("path", "node")
    made = stored(rows.mapInArrow(_stars(depths), _FOREST))
    ends = sorted(((r["b"], -r["depth"], r["a"], r["path"]) for r in made.where("depth < 0").collect()))
    seams = []
    for (_, _, a, path), (_, _, b, after) in zip(ends[1::2], ends[2::2], strict=False):
        common = int(_common(*(np.frombuffer(bytes(p), np.uint8)[None] for p in (path, after)))[0])
        seams += [(d, a, b) for d in depths if common >= d]
    edges = made.where("depth >= 0").select("depth", "a", "b")
    return edges.unionByName(spark.createDataFrame(seams, "depth int, a long, b long")) if seams else edges


# --- verification -----------------------------------------------------------------------------------------


def _similar(rows: list[np.ndarray], columns: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs and similarities at or above the threshold: within ``rows`` (i < j), or between both lists."""
    both = rows + (columns or [])
    n, size = len(both), np.array([len(g) for g in both])
    value, owner = np.concatenate(both), np.repeat(np.arange(n), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.r_[True, value[1:] != value[:-1]]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # a gram of one set alone is in no intersection
    number, owner = number[shared], owner[shared]
    number = np.cumsum(np.r_[0, number[1:] != number[:-1]]) if len(number) else number
    m = len(rows)
    common = np.zeros((m, n - m if columns is not None else n), np.float32)
    step = 4096
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, z = np.searchsorted(number, [lo, lo + step])
        dense = np.zeros((n, min(step, int(number[-1]) + 1 - lo)), np.float32)
        dense[owner[a:z], number[a:z] - lo] = 1
        common += dense[:m] @ (dense[m:] if columns is not None else dense).T
    right = size[m:] if columns is not None else size
    either = size[:m, None] + right[None, :] - common
    hit = common >= threshold * either - 1e-6
    if columns is None:
        hit &= np.triu(np.ones((m, m), bool), 1)
    i, j = np.nonzero(hit)
    return i, j, common[i, j] / either[i, j]


class _Met:
    """What the sets of a block are linked to: the number of links, the smallest index within the block, the smallest
    name beyond their own, and how many links of each similarity were seen from here."""

    def __init__(self, sid: list[bytes], name: list[bytes], copies: np.ndarray, sets: list[np.ndarray], threshold: float):
        self.sid, self.name, self.copies, self.sets, self.threshold = sid, name, copies, sets, threshold
        self.links, self.outer, self.bins = np.zeros(len(sid), np.int64), [None] * len(sid), np.zeros(101, np.int64)
        a, b, s = _similar(sets, None, threshold)
        np.add.at(self.links, a, copies[b])
        np.add.at(self.links, b, copies[a])
        self._seen(s)
        root = np.arange(len(sid))
        while len(a):
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (before == root).all():
                break
        self.root = root

    def _seen(self, s: np.ndarray) -> None:
        self.bins += np.bincount(np.minimum(100, np.floor(s * 100 + 1e-6)).astype(int), minlength=101)

    def meet(self, other: tuple[list[bytes], np.ndarray, list[np.ndarray]], count: bool) -> None:
        """Links to the sets of another block; ``count``: their similarities are counted from this side."""
        name, copies, sets = other
        a, b, s = _similar(self.sets, sets, self.threshold)
        np.add.at(self.links, a, copies[b])
        if count:
            self._seen(s)
        names = sorted({*self.name, *name})
        place = {n: i for i, n in enumerate(names)}
        mine, theirs = np.array([place[n] for n in self.name]), np.array([place[n] for n in name])
        least, apart = np.full(len(mine), len(names)), mine[a] != theirs[b]
        np.minimum.at(least, a[apart], theirs[b[apart]])
        for i in np.flatnonzero(least < len(names)).tolist():
            self.outer[i] = min(self.outer[i] or names[least[i]], names[least[i]])

    def rows(self, label: int) -> list[tuple]:
        out = [(self.sid[i], self.name[i], label, int(n), self.name[self.root[i]], self.outer[i], None) for i, n in enumerate(self.links.tolist()) if n]
        return [(*out[0][:6], self.bins.tolist()), *out[1:]] if out else out


def _linked_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _LINKED.split(", ")])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Keys and remaining columns of sorted rows, a list of rows per key."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def _in_one_go(parts: DataFrame, threshold: float) -> DataFrame:
    """The links of families of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for (label,), rows in _groups(batches, 1):
            if len(rows) > 1:
                sid, copies, sets = zip(*rows, strict=True)
                made += _Met(list(sid), list(sid), np.array(copies), [np.frombuffer(s, np.uint64) for s in sets], threshold).rows(label)
            if len(made) >= 4096:
                yield _linked_batch(made)
                made = []
        yield _linked_batch(made)

    few = parts.where("blocks = 1").select("label", "sid", "copies", "set")
    return few.repartition("label").sortWithinPartitions("label", "sid").mapInArrow(run, _LINKED)


def _by_blocks(parts: DataFrame, names: DataFrame | None, threshold: float) -> DataFrame:
    """The links of families of several blocks; ``names`` (sid, name): sets of one name need no link to one another."""
    rows = parts.where("blocks > 1")
    rows = rows.withColumn("name", F.col("sid")) if names is None else rows.join(names, "sid", "left").withColumn("name", F.coalesce("name", "sid"))
    kinds = ("label long", "band int", "block int", "sids binary", "names binary", "copies binary", "sizes binary", "sets binary")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
        for key, held in _groups(batches, 3):
            sid, name, copies, sets = zip(*held, strict=True)
            sizes = np.array([len(s) for s in sets], "<i8")
            one = (*key, b"".join(sid), b"".join(name), np.array(copies, "<i8").tobytes(), sizes.tobytes(), b"".join(sets))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types, strict=True)], names=[k.split()[0] for k in kinds])

    blocks = rows.select("label", "band", "block", "sid", "name", "copies", "set").repartition("label", "band", "block").sortWithinPartitions("label", "band", "block", "sid")
    packs = stored(blocks.mapInArrow(packed, ", ".join(kinds)))
    there = rows.groupBy("label", "band").agg(F.max("block").alias("most"))
    to = there.select("label", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("band").alias("to_band"), "most")
    sent = packs.join(to, ["label", "band"]).withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("most"))))
    own = (F.col("band") == F.col("to_band")) & (F.col("block") == F.col("to_block"))
    dealt = sent.select("label", "to_band", "to_block", (~own).cast("int").alias("other"), "band", "block", "sids", "names", "copies", "sizes", "sets")

    def unpacked(sids: bytes, names: bytes, copies: bytes, sizes: bytes, sets: bytes) -> tuple:
        ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
        cut = lambda b: [b[i : i + 16] for i in range(0, len(b), 16)]
        return cut(sids), cut(names), np.frombuffer(copies, "<i8"), [np.frombuffer(sets[a:z], np.uint64) for a, z in zip([0, *ends], ends, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, met = None, None
        for b in batches:
            for i in range(b.num_rows):  # one block at a time
                label, to_band, to_block, other, band, block, *rest = (c[i].as_py() for c in b.columns)
                if key != (label, to_band, to_block):
                    if met is not None:
                        yield _linked_batch(met.rows(key[0]))
                    key, met = (label, to_band, to_block), _Met(*unpacked(*rest), threshold)
                else:
                    met.meet(unpacked(*rest)[1:], (to_band, to_block) < (band, block))
        if met is not None:
            yield _linked_batch(met.rows(key[0]))

    return dealt.repartition("label", "to_band", "to_block").sortWithinPartitions("label", "to_band", "to_block", "other", "band", "block").mapInArrow(run, _LINKED)


def _parts(docs: DataFrame, sets: DataFrame, families: DataFrame, threshold: float, repeated: bool) -> DataFrame:
    """The exact sets of the families' members, with family, size band and block. Similar sets are in the same band or in
    adjacent ones. ``repeated``: some row that stands for its set comes more than once."""
    wide = 1.0001 * math.log(1 / threshold) if threshold < 1 else 1e-4
    members = sets.join(families.select(F.col("id").alias("node"), "label"), F.xxhash64("sid") == F.col("node")).select("sid", "label", "copies", "grams", "rep.did", "rep.rid")
    members = members.withColumn("band", F.floor(F.log("grams") / wide).cast("int"))
    room = F.greatest(F.ceil(F.sum("n") / BLOCK_SETS), F.ceil(F.sum("g") / BLOCK_GRAMS)).cast("int")
    bands = members.groupBy("label", "band").agg(F.count("*").alias("n"), F.sum("grams").alias("g"))
    whole = bands.groupBy("label").agg(room.alias("blocks"))
    each = bands.groupBy("label", "band").agg(room.alias("in_band")).join(whole, "label")
    placed = members.join(each, ["label", "band"])
    alone = F.col("blocks") == 1
    dealt = F.when(alone, 0).otherwise(F.pmod(F.xxhash64("sid", F.lit("block")), F.col("in_band"))).cast("int")
    placed = placed.select("did", "rid", "sid", "label", "copies", F.when(alone, 0).otherwise(F.col("band")).alias("band"), dealt.alias("block"), "blocks")
    texts = docs.select("did", "rid", "text").join(placed.hint("shuffle_hash"), ["did", "rid"]).select("sid", "label", "copies", "band", "block", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, given in _batches(b, 6):
                made = pa.array([g.tobytes() for g in grams(given)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in range(6)), made], names=[c.split()[0] for c in _PART.split(", ")])

    made = texts.mapInArrow(run, _PART)
    return stored(made.dropDuplicates(["sid"]) if repeated else made)


def _links(parts: DataFrame, threshold: float) -> DataFrame:
    """(sid, label, links, class, bins): the number of documents that each linked set is linked to, and a set of its class."""
    spark, c = parts.sparkSession, F.col
    alone = _in_one_go(parts, threshold).select("sid", "label", "links", "bins", c("inner").alias("class"))
    if parts.where("blocks > 1").isEmpty():
        return alone
    first = stored(_by_blocks(parts, None, threshold))
    names = components(first.select(c("sid").alias("a"), F.explode(F.array_compact(F.array("inner", "outer"))).alias("b"))).withColumnRenamed("id", "sid").withColumnRenamed("label", "class")
    known = first.select("sid", "label", "links", "bins").join(names, "sid")
    while True:
        apart = known.groupBy("label").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
        blocks = parts.where("blocks > 1").select("label", "band", "block").distinct().join(apart.select("label"), "label")
        again = parts.join(blocks, ["label", "band", "block"], "left_semi").select(parts.columns)  # dealt by block: a family may be large
        if again.isEmpty():
            break
        more = stored(_by_blocks(again, known.select("sid", c("class").alias("name")), threshold).where("outer is not null"))
        if more.isEmpty():
            break
        joined = components(more.select(c("name").alias("a"), c("outer").alias("b"))).select(c("id").alias("class"), c("label").alias("to"))
        known = stored(known.join(joined, "class", "left").select("sid", "label", "links", "bins", F.coalesce("to", "class").alias("class")))
    return alone.unionByName(known.select("sid", "label", "links", "bins", "class"))


def _shorter(bins: dict[int, int], depth: int, low: int, tried: int, recall: float) -> int:
    """The next length of prefixes, or ``depth`` if it is short enough. ``bins``: links found by similarity in hundredths,
    ``tried``: the lowest such similarity that an earlier length had found (101: none)."""
    now = min(bins, default=101)
    wanted = min(depth, max([d for d in range(low, depth + 1) if all(chance(s / 100, d) >= recall for s in bins)], default=low))
    if wanted < depth:
        return wanted
    return depth if depth == low else low if now >= tried and now < 101 else max(low, depth - PROBE)


def _keyed(docs: DataFrame) -> DataFrame:
    return with_id(docs).withColumn("rid", F.xxhash64("text"))


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, lengths: list[int] | None = None) -> DataFrame:
    """(did, rid, class_did, class_rid, copy_did, n_links) of each row: the first row of its class of linked documents, the
    smallest id with the same set, and the number of documents that it links to. ``lengths`` is given the lengths of
    prefixes that were matched."""
    spark, rows, lengths = docs.sparkSession, _keyed(docs), [] if lengths is None else lengths
    whole = stored(signed(rows))
    here = F.struct("did", "rid")
    once = whole.where("sid is not null").groupBy("sid", "did", "rid").agg(F.count("*").alias("n"), F.first("grams").alias("grams"), F.first("signature").alias("signature"))
    sets = stored(once.groupBy("sid").agg(F.min(here).alias("rep"), F.sum("n").alias("copies"), F.first("grams").alias("grams"), F.first("signature").alias("signature"), F.min_by("n", here).alias("rep_rows")))
    signs = stored(whole.select("did", "rid", "sid"))
    forget(spark, whole)
    low = least_depth(threshold, recall)
    edges = forest(sets.select("sid", "signature"), list(range(DEPTH, low - 1, -1)))
    depth, tried, sizes, links = DEPTH, 101, spark.createDataFrame([], "label long, n long"), None
    repeated = not sets.where("rep_rows > 1").isEmpty()
    while True:
        families = components(edges.where(F.col("depth") == depth).select("a", "b"))
        before, sizes = sizes, stored(families.groupBy("label").agg(F.count("*").alias("n")))
        changed = families.join(sizes.join(before, ["label", "n"], "left_anti").select("label"), "label", "left_semi").select("id", "label")
        parts = _parts(rows, sets, changed, threshold, repeated)
        new = _links(parts, threshold)
        links = stored(new if links is None else links.join(changed.select(F.col("id").alias("label")), "label", "left_anti").unionByName(new))
        forget(spark, parts)
        bins = {r["s"]: r["n"] for r in links.select(F.posexplode("bins").alias("s", "n")).groupBy("s").agg(F.sum("n").alias("n")).where("n > 0").collect()}
        shorter = _shorter(bins, depth, low, tried, recall)
        lengths.append(depth)
        if shorter == depth:
            break
        depth, tried = shorter, min([tried, *bins])
    names = stored(sets.select("sid", "rep", "copies"))
    forget(spark, sets)
    known = names.join(links.select("sid", "links", F.col("class").alias("label")), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    first = known.groupBy("label").agg(F.min("rep").alias("first"))
    told = known.join(first, "label").select("sid", "first", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signs.select("did", "rid", "sid").join(told, "sid", "left").select(
        "did",
        "rid",
        F.coalesce("first.did", "did").alias("class_did"),
        F.coalesce("first.rid", "rid").alias("class_rid"),
        F.coalesce("rep.did", "did").alias("copy_did"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_of (the smallest doc_id with the same grams) and n_links of each document."""
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return joined(docs, threshold, recall).select(real("did").alias("doc_id"), real("class_did").alias("class_id"), real("copy_did").alias("copy_of"), "n_links")


def dedup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; wordless rows all stay."""
    names = docs.columns
    found = stored(joined(docs, threshold, recall).where("did = class_did and rid = class_rid").groupBy("did", "rid").agg(F.count("*").alias("n"), F.max("n_links").alias("links")))
    rows = docs.select(*(quoted(c).alias(f"_{i}") for i, c in enumerate(names)), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"))
    kept = rows.join(found.hint("shuffle_hash"), ["did", "rid"])
    if not found.where("n > 1 and links > 0").isEmpty():  # repeated rows: any one of them
        kept = kept.where("links = 0").unionByName(kept.where("links > 0").dropDuplicates(["did", "rid"]))
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
