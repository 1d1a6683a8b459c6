"""Operator 12: codes of vectors by product quantisation, the codebooks fitted by filtering Lloyd rounds.

Components become integers, vectors are cut into ``PARTS`` equal parts, each part position has a codebook. Every task packs
its vectors into chunks of bounded size and builds a kd-tree per chunk and part position: boxes with the sums and counts of
what is below them. The trees are written once, as a table, and read in every round. A round lets codebook entries sink
down the trees: an entry that some other one beats at the corner of a box that suits it best is out for the whole
box, and a box with one entry left gives it its sum and count at once; only leaves that several entries still
claim look at their points. A tree level is one step of numpy. Tasks return sums per entry, whose number is fixed, and Spark
adds them up; so the driver sees ``PARTS`` x ``ENTRIES`` entries a round, whatever the number of vectors. Sums and
distances are exact integers, hence neither the partitioning nor a task that runs twice changes a result.

Cases: vectors that are null or hold null or non-finite components are dropped; a null vec_id stays, but starts no
entry; of vectors that share an id that starts an entry the least one does; with fewer than ``ENTRIES`` ids codebooks are
shorter; repeated rows each count and each get a row; components beyond +-``LIMIT`` count as that; shorter vectors
count as padded with zeros up to the longest, and all up to a multiple of ``PARTS``; an empty vector is all zeros; null labels are one label;
extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from terraloom.llm.common import forget, sha256, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest size of a component as an integer: up to 512 of them have squared distances that fit into 64 bits.
LIMIT = 1 << 26
#: Numbers in a chunk of vectors, about, and its least number of vectors; points in a leaf at least.
CHUNK, CHUNK_ROWS, LEAF = 1 << 18, 64, 16
#: A label is hot if it has more than this part of all rows.
HOT_PART = 1000


# --- trees ------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A complete kd-tree over n points; level k is the slice ``2**k - 1 : 2**(k + 1) - 1`` of the boxes. Leaves have equally many
    slots, of which some repeat a point with weight 0."""

    points: np.ndarray  # (slots, d)
    row: np.ndarray  # of each slot
    weight: np.ndarray
    low: np.ndarray  # (boxes, d)
    high: np.ndarray
    total: np.ndarray
    count: np.ndarray


def _shape(n: int) -> tuple[int, int]:
    """Depth of the tree over n points and slots in a leaf."""
    depth = max(0, (n // LEAF).bit_length() - 1)
    return depth, -(-n // 2**depth)


def build(points: np.ndarray) -> Tree:
    n, d = points.shape
    depth, leaf = _shape(n)
    slots = leaf << depth
    row = np.minimum(np.arange(slots), n - 1)
    weight = (np.arange(slots) < n).astype(np.int64)
    for level in range(depth):  # all boxes of a level are halved at the median of their widest axis
        boxes = points[row].reshape(2**level, -1, d)
        axis = (boxes.max(axis=1) - boxes.min(axis=1)).argmax(axis=1)
        keys = np.take_along_axis(boxes, axis[:, None, None], 2)[:, :, 0]
        half = np.argpartition(keys, keys.shape[1] // 2, axis=1)
        row, weight = (np.take_along_axis(x.reshape(half.shape), half, 1).ravel() for x in (row, weight))
    slot = points[row]
    boxes = slot.reshape(2**depth, leaf, d)
    levels = [(boxes.min(axis=1), boxes.max(axis=1), (boxes * weight.reshape(-1, leaf, 1)).sum(axis=1), weight.reshape(-1, leaf).sum(axis=1))]
    for _ in range(depth):
        low, high, total, count = levels[0]
        levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2], count[::2] + count[1::2]))
    return Tree(slot, row, weight, *(np.concatenate(x) for x in zip(*levels, strict=True)))


def packed(tree: Tree) -> bytes:
    return b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in (tree.points, tree.row, tree.weight, tree.low, tree.high, tree.total, tree.count))


def unpacked(data: bytes, n: int, d: int) -> Tree:
    depth, leaf = _shape(n)
    slots, boxes = leaf << depth, (2 << depth) - 1
    flat, out, at = np.frombuffer(data, np.int64), [], 0
    for shape in ((slots, d), (slots,), (slots,), (boxes, d), (boxes, d), (boxes, d), (boxes,)):
        out.append(flat[at : at + np.prod(shape)].reshape(shape))
        at += np.prod(shape)
    return Tree(*out)


def sink(tree: Tree, entries: np.ndarray, assign: bool = False, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums and counts of the points nearest to each entry, ties to the first, and with ``assign`` the entry of each row.
    ``seen`` is given the number of points that were looked at one by one."""
    k, d = entries.shape
    largest = int(max(np.abs(entries).max(), np.abs(tree.low[0]).max(), np.abs(tree.high[0]).max()))
    exact = np.float64 if 8 * d * largest * largest < 2**53 else np.int64  # floats are faster and as exact as long as they hold every sum
    entries = entries.astype(exact)
    norms, numbers = (entries * entries).sum(axis=1), np.arange(k)
    sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    depth, leaf = _shape(int(tree.count[0]))
    of_slot = np.zeros(len(tree.row), np.int64) if assign else None
    most = np.inf if exact is np.float64 else np.iinfo(np.int64).max
    nodes, still = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(depth + 1):
        at = nodes + (2**level - 1)
        low, high = tree.low[at].astype(exact), tree.high[at].astype(exact)
        best = np.where(still, norms - (low + high) @ entries.T, most).argmin(axis=1)
        towards = entries[None] - entries[best][:, None]
        corner = np.where(towards > 0, high[:, None], low[:, None])
        farther = norms - norms[best][:, None] - 2 * (corner * towards).sum(axis=2)
        still &= (farther < 0) | ((farther == 0) & (numbers <= best[:, None]))
        sole = still.sum(axis=1) == 1
        if sole.any():
            own = still[sole].argmax(axis=1)
            np.add.at(sums, own, tree.total[at[sole]])
            np.add.at(counts, own, tree.count[at[sole]])
            if assign:
                of_slot.reshape(2**level, -1)[nodes[sole]] = own[:, None]
        nodes, still = nodes[~sole], still[~sole]
        if not len(nodes):
            break
        if level < depth:
            nodes, still = (2 * nodes[:, None] + (0, 1)).ravel(), np.repeat(still, 2, axis=0)
    else:
        points = tree.points.reshape(2**depth, leaf, d)[nodes].astype(exact)
        own = np.where(still[:, None], norms - 2 * (points.reshape(-1, d) @ entries.T).reshape(len(nodes), leaf, k), most).argmin(axis=2)
        slots = (nodes[:, None] * leaf + np.arange(leaf)).ravel()
        real, flat = tree.weight[slots] > 0, own.ravel()
        for j in np.unique(flat[real]):
            mine = slots[real & (flat == j)]
            sums[j] += tree.points[mine].sum(axis=0)
            counts[j] += len(mine)
        if assign:
            of_slot[slots] = flat
        if seen is not None:
            seen.append(int(real.sum()))
    if not assign:
        return sums, counts, None
    of_row = np.zeros(int(tree.count[0]), np.int64)
    real = tree.weight > 0
    of_row[tree.row[real]] = of_slot[real]
    return sums, counts, of_row


# --- the jobs ---------------------------------------------------------------------------------------------


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and ``v``, the components as floor(4096 x), of the vectors that take part."""
    x = F.col("embedding")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(x.isNotNull() & ok)
    scaled = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("long")
    return rows.select("vec_id", "label", F.transform("embedding", scaled).alias("v"))


def trees(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """ids, labels, trees: a row per chunk of vectors, with a tree for each part position."""
    size = max(CHUNK_ROWS, CHUNK // width)
    schema = StructType([StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(rows.schema["label"].dataType)), StructField("trees", ArrayType(BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, labels, v = (t.column(i).combine_chunks() for i in range(3))
            x = v.flatten().to_numpy().reshape(len(ids), parts, -1)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels, pa.array([packed(build(np.ascontiguousarray(x[:, p]))) for p in range(parts)], pa.binary()))]
            return pa.RecordBatch.from_arrays(lists, names=schema.names)

        n = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield chunk()
                    held, n = [], 0
        if n:
            yield chunk()

    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return rows.select("vec_id", "label", padded.alias("v")).mapInArrow(run, schema)


def first_entries(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, d): the parts of the vectors with the smallest ids."""
    ids = [r["vec_id"] for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    drawn = {r["vec_id"]: r["v"] for r in rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()}
    book = np.zeros((max(1, len(ids)), width), np.int64)
    for i, vec_id in enumerate(ids):
        book[i, : len(drawn[vec_id])] = drawn[vec_id]
    return np.ascontiguousarray(book.reshape(len(book), parts, -1).transpose(1, 0, 2))


def _each_tree(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, int, Tree]]:
    """(row of the batch, part, tree)."""
    for i in range(batch.num_rows):
        n = len(batch.column(0)[i])
        for p, data in enumerate(batch.column(2)[i].as_py()):
            yield i, p, unpacked(data, n, d)


def lloyd_round(made: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: means of what is nearest to each entry, rounded down; unused entries stay."""
    d = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for _, p, tree in _each_tree(b, d):
                s, c, _ = sink(tree, books[p])
                sums[p] += s
                counts[p] += c
        part, entry, at = (x.ravel().astype(np.int32) for x in np.indices(books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, at, sums.ravel(), np.repeat(counts.ravel(), d))], names=["part", "entry", "at", "total", "n"])

    added = made.mapInArrow(run, "part int, entry int, at int, total long, n long").where("n > 0").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in added.collect():  # parts x entries x d rows at most
        out[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return out


def assigned(made: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts, _, d = books.shape
    schema = StructType([StructField("vec_id", LongType()), StructField("label", made.schema["labels"].dataType.elementType), *StructType.fromDDL("code string, error long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, np.ndarray] = {}
            errors: dict[int, np.ndarray] = {}
            for i, p, tree in _each_tree(b, d):
                of = sink(tree, books[p], assign=True)[2]
                points = np.empty((len(of), d), np.int64)
                real = tree.weight > 0
                points[tree.row[real]] = tree.points[real]
                own.setdefault(i, np.empty((len(of), parts), np.uint8))[:, p] = of
                errors[i] = errors.get(i, 0) + ((points - books[p][of]) ** 2).sum(axis=1)
            for i, codes in own.items():
                text = codes.tobytes().hex()
                code = pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)])
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, code, pa.array(errors[i])], names=schema.names)

    return made.mapInArrow(run, schema)


def with_label_error(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the sum of ``error`` over equal labels. Labels with more than 1/``HOT_PART`` of the ``n`` rows are fewer than that,
    hence broadcast; the rows of the others meet their label's sum by shuffle."""
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    hot = F.broadcast(sums.where(F.col("n") * HOT_PART > n).select(F.col("label").alias("_label"), "label_error"))
    cold = sums.where(F.col("n") * HOT_PART <= n).select(F.col("label").alias("_label"), "label_error")
    same = rows["label"].eqNullSafe(F.col("_label"))
    return rows.join(hot, same).drop("_label").unionByName(rows.join(hot, same, "left_anti").join(cold, same).drop("_label"))


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every vector that takes part, and the codebooks (parts, entries, components)."""
    spark, rows = embeddings.sparkSession, quantised(embeddings)
    longest = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    width = -(-longest // parts) * parts
    books = first_entries(rows, width, parts, entries)
    made = stored(trees(rows, width, parts))
    for _ in range(rounds):
        books = lloyd_round(made, books)
    out = stored(assigned(made, books))
    forget(spark, made)
    return out, books


def digests(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = codes(embeddings)
    whole = sha256(",".join(map(str, books.ravel().tolist())).encode())
    return with_label_error(rows, rows.count()).select("vec_id", "code", "error", "label_error", F.lit(whole).alias("codebooks_sha256"))
