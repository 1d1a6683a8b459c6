"""Operator 13: secrets by rules, and by a character convolutional network that learns from what the rules found.

One scan of the texts gives every document's rule findings and candidates: the values of findings, and all other runs of
``LEAST_RUN`` and more characters of the alphabet of secrets that mix capitals, small letters and digits; each with a
window of its surroundings, of fixed length. They are written once; texts are not read again.

The network learns from all of these labelled windows of documents whose crc32(doc_id as text) mod 4 is 0 or 3. They are dealt by hash to
shards of about ``SHARD``; each epoch fits every shard with numpy, one shard a group, from the same state, and the means of what
they come to are the next one's. Findings are shown a second time in the surroundings of others, so that it learns what secrets look like and not only the words before them. Others are not
clean by label, only not found by rules: those whose runs a first network can't tell from those of findings are left
out before the second one is fitted. All windows of
documents with remainder 1 calibrate its output (a logistic fit by sums) and give the thresholds (exact order statistics by counts of digits): for each shape of run (hex digits,
capitals and digits, all else) ``RECALL`` of the findings, both ways, must still be found. The threshold is halfway between the
highest one that keeps that and nearly all others below it; where a shape has too few findings, that of all shapes. Remainder 2 is held out and only measured. The fitted model is a few kilobytes; every candidate of every
document is scored by it. Candidates at or above their threshold that don't overlap a rule's span become spans of the kind ``net``.

Cases: a null text counts as empty; a null doc_id stays null and is not learned from; with fewer than ``FEWEST`` findings or others
to learn or to calibrate from there is no network and rule findings are all; repeated rows each get a row; offsets
are code points; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import sha256, stored

#: Fewest findings and others to learn and to calibrate from; windows of a shard, about, and how many of each kind it is dealt at least, about:
#: of a rarer kind windows go to more than one shard.
FEWEST, SHARD, LEAST_OF_KIND = 3, 6000, 64
EPOCHS, BATCH, RATE, DECAY = 8, 128, 3e-3, 1e-4
#: Shards whose states are averaged in one group, before the driver averages those.
AVERAGED = 32
#: Part of the findings, as they are and in other surroundings, that the thresholds have to keep; others are doubtful if their runs look
#: more like findings than this part of the findings' runs do; part of the others that don't count where a threshold is put.
RECALL, DOUBT, ODD = 0.95, 0.01, 0.02
#: Characters before, of and after a run in its window; of longer runs the last ``TAIL`` stand in for the rest.
BEFORE, RUN, AFTER, TAIL = 24, 32, 8, 8
LEAST_RUN = 6
KINDS = ("assign", "access", "hex")

#: The rules, and what a match needs beyond.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST_VALUE = 6

#: Runs that mix two of: a capital that isn't the first letter, a small letter, a digit.
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9]|[A-Za-z+/_.=-]+[A-Z])[A-Za-z0-9+/_.=-]{%d,}" % LEAST_RUN)

FOUND = "doc_id long, fold int, n_assign long, n_access long, n_hex long, spans array<struct<kind: int, start: int, end: int>>, candidates array<struct<finding: boolean, start: int, end: int, window: string>>"
SCORED = "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<kind: int, start: int, end: int>>, net array<struct<start: int, end: int, score: double>>, scores array<struct<finding: boolean, start: int, end: int, score: double>>"


# --- findings ---------------------------------------------------------------------------------------------


def rule_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the rules' findings in order, and the spans of their values."""
    values, spans = [], []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= _LEAST_VALUE:
            spans.append((m.start(), 0, m.end()))
            values.append(m.span(2))
    for kind, rule in ((1, _ACCESS), (2, _HEX)):
        for m in rule.finditer(text):
            spans.append((m.start(), kind, m.end()))
            values.append(m.span())
    return sorted(spans), sorted(set(values))


def mixed_runs(text: str) -> Iterator[tuple[int, int]]:
    for m in _MIXED.finditer(text):
        run = m[0]
        if any(map(str.isdigit, run)) + any(map(str.islower, run)) + any(map(str.isupper, run[1:])) >= 2:
            yield m.span()


def window(text: str, start: int, end: int) -> str:
    run = text[start:end] if end - start <= RUN else text[start : start + RUN - TAIL] + text[end - TAIL : end]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE) + run.ljust(RUN) + text[end : end + AFTER].ljust(AFTER)


def findings(docs: DataFrame) -> DataFrame:
    """Rule spans and candidates with their windows, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), *((f"n_{k}", pa.int64()) for k in KINDS),
            ("spans", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
            ("candidates", pa.list_(pa.struct([("finding", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("window", pa.string())])))])
        for b in batches:
            out = []
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py() or ""
                spans, values = rule_spans(text)
                runs = [(False, s, e) for s, e in mixed_runs(text) if all(e <= lo or hi <= s for lo, _, hi in spans)]
                out.append(
                    {
                        "doc_id": doc_id, "fold": None if doc_id is None else zlib.crc32(b"%d" % doc_id) % 4, **{f"n_{k}": sum(s[1] == i for s in spans) for i, k in enumerate(KINDS)},
                        "spans": [{"kind": k, "start": s, "end": e} for s, k, e in spans],
                        "candidates": [{"finding": f, "start": s, "end": e, "window": window(text, s, e)} for f, s, e in [*((True, *v) for v in values), *runs]],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


# --- the network ------------------------------------------------------------------------------------------

#: Symbols: letters without case, digits, common marks, white space, other characters; capitals are told by a number of their own.
_MARKS = "+/_.=-:;,'\"@()[]{}<>#$%&*!?|\\~^`"
_SYMBOLS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789" + _MARKS)}
_SPACE, _OTHER, N_SYMBOLS = len(_SYMBOLS), len(_SYMBOLS) + 1, len(_SYMBOLS) + 2
_TABLE = np.array([_SYMBOLS.get(chr(i).lower(), _SPACE if chr(i).isspace() else _OTHER) for i in range(128)] + [_OTHER])
_CAPITAL = np.array([float("A" <= chr(i) <= "Z") for i in range(128)] + [0.0])
WIDTH, SIZE, FILTERS, HIDDEN = 5, 8, 24, 16
#: First and last convolution whose middle is before, in and after the run.
_REGIONS = ((0, BEFORE - WIDTH // 2), (BEFORE - WIDTH // 2, BEFORE + RUN - WIDTH // 2), (BEFORE + RUN - WIDTH // 2, BEFORE + RUN + AFTER - WIDTH + 1))
RUN_REGION = 1


def encoded(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and capitals of windows, (n, length) each."""
    codes = np.minimum(np.array([list(map(ord, w)) for w in windows], np.int64).reshape(len(windows), BEFORE + RUN + AFTER), 128)
    return _TABLE[codes], _CAPITAL[codes]


@dataclass
class Network:
    """Embedding, one convolution, the greatest response before, in and after the run and the mean one in it, a hidden layer, a logit."""

    weights: list[np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 13) -> Network:
        r = np.random.default_rng(seed)
        shapes = ((N_SYMBOLS, SIZE - 1), (WIDTH * SIZE, FILTERS), (FILTERS,), (FILTERS * (len(_REGIONS) + 1), HIDDEN), (HIDDEN,), (HIDDEN,), (1,))
        return cls([r.normal(0, 0.5 if i == 0 else (2 / s[0]) ** 0.5, s) if len(s) > 1 or i == 5 else np.zeros(s) for i, s in enumerate(shapes)])

    def forward(self, symbols: np.ndarray, capitals: np.ndarray) -> tuple[np.ndarray, tuple]:
        embed, conv, bias, dense, dense_bias, last, last_bias = self.weights
        x = np.concatenate([embed[symbols], capitals[:, :, None]], axis=2)
        patches = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * SIZE)
        z = np.maximum(patches @ conv + bias, 0)
        tops = [lo + z[:, lo:hi].argmax(axis=1) for lo, hi in _REGIONS]
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)
        lo, hi = _REGIONS[RUN_REGION]
        pooled = np.concatenate([*(z[rows, t, cols] for t in tops), z[:, lo:hi].mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ dense + dense_bias, 0)
        return hidden @ last + last_bias[0], (patches, z, tops, pooled, hidden)

    def gradients(self, symbols: np.ndarray, capitals: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss."""
        embed, conv, _, dense, _, last, _ = self.weights
        logit, (patches, z, tops, pooled, hidden) = self.forward(symbols, capitals)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        d_hidden = np.outer(d, last) * (hidden > 0)
        d_pooled = d_hidden @ dense.T
        d_z = np.zeros_like(z)
        rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)
        for i, t in enumerate(tops):
            np.add.at(d_z, (rows, t, cols), d_pooled[:, i * FILTERS : (i + 1) * FILTERS])
        lo, hi = _REGIONS[RUN_REGION]
        d_z[:, lo:hi] += d_pooled[:, None, len(tops) * FILTERS :] / (hi - lo)
        d_z *= z > 0
        d_patches = (d_z @ conv.T).reshape(len(y), -1, WIDTH, SIZE)
        d_x = np.zeros((*symbols.shape, SIZE))
        for k in range(WIDTH):
            d_x[:, k : k + d_patches.shape[1]] += d_patches[:, :, k]
        d_embed = np.zeros_like(embed)
        np.add.at(d_embed, symbols, d_x[:, :, : SIZE - 1])
        flat = d_z.reshape(-1, FILTERS)
        return [d_embed, patches.reshape(-1, WIDTH * SIZE).T @ flat, flat.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, d.sum(keepdims=True)]

    def logits(self, windows: list[str], batch: int = 512) -> np.ndarray:
        parts = [self.forward(*encoded(windows[i : i + batch]))[0] for i in range(0, len(windows), batch)]
        return np.concatenate(parts) if parts else np.empty(0)


def fresh_state() -> np.ndarray:
    """Weights, Adam's first and second moments and its number of steps, in one array."""
    flat = np.concatenate([w.ravel() for w in Network.fresh().weights])
    return np.concatenate([flat, np.zeros(2 * len(flat) + 1)])


def _parts(state: np.ndarray) -> list[list[np.ndarray]]:
    """Views of weights, first and second moments in ``state``."""
    shapes, at, out = [w.shape for w in Network.fresh().weights], 0, []
    for _ in range(3):
        out.append([])
        for s in shapes:
            out[-1].append(state[at : at + math.prod(s)].reshape(s))
            at += math.prod(s)
    return out


def network(state: np.ndarray) -> Network:
    return Network(_parts(state)[0])


def epoch(state: np.ndarray, windows: list[str], y: np.ndarray, number: int) -> np.ndarray:
    """The state after one pass of Adam on mini-batches; the same windows in the same order give the same one."""
    state, r = state.copy(), np.random.default_rng(7)
    weights, first, second = _parts(state)
    net = Network(weights)
    symbols, capitals = encoded(windows)
    for _ in range(number + 1):
        order = r.permutation(len(y))
    for i in range(0, len(y), BATCH):
        at = order[i : i + BATCH]
        state[-1] += 1
        for w, g, m, v in zip(weights, net.gradients(symbols[at], capitals[at], y[at]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9 ** state[-1]) / (np.sqrt(v / (1 - 0.999 ** state[-1])) + 1e-8) + DECAY * w)
    return state


def fit_network(windows: list[str], y: np.ndarray) -> Network:
    state = fresh_state()
    for number in range(EPOCHS):
        state = epoch(state, windows, y, number)
    return network(state)


def shape(window: str) -> int:
    """0: hex digits, 1: capitals and digits, 2: all else."""
    run = window[BEFORE : BEFORE + RUN].rstrip(" ")
    return 0 if re.fullmatch("[0-9a-fA-F]+", run) else 1 if re.fullmatch("[0-9A-Z]+", run) else 2


@dataclass
class Model:
    net: Network
    slope: float
    offset: float
    thresholds: tuple[float, float, float]

    def scores(self, windows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.net.logits(windows) + self.offset)))


def logistic_newton(sums, n1: float, n0: float, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, offset) of P(y = 1), by damped Newton steps; targets are kept off 0 and 1 by the counts, so the fit exists. ``sums`` gives
    those of q x x, q x, q, e x and e at (slope, offset), q being p (1 - p) and e what p is above the target of 1 or 0."""
    w, targets = np.array([1.0, 0.0]), ((n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(100):
        xx, x, one, ex, e = sums(w, targets)
        step = np.linalg.solve(np.array([[xx, x], [x, one]]) + ridge * np.eye(2), np.array([ex, e]) + ridge * (w - (1, 0)))
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    def sums(w: np.ndarray, targets: tuple[float, float]) -> tuple[float, ...]:
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -60, 60)))
        q, e = p * (1 - p), p - np.where(y > 0, *targets)
        return (q * x * x).sum(), (q * x).sum(), q.sum(), (e * x).sum(), e.sum()

    return logistic_newton(sums, float(y.sum()), float(len(y) - y.sum()))


def alone(windows: list[str]) -> list[str]:
    """Runs without their surroundings."""
    return [" " * BEFORE + w[BEFORE : BEFORE + RUN] + " " * AFTER for w in windows]


def labelled(yes: list[str], no: list[str]) -> tuple[list[str], np.ndarray]:
    return [*yes, *no], np.array([1.0] * len(yes) + [0.0] * len(no))


def in_other_surroundings(found: list[str], others: list[str]) -> list[str]:
    """The runs of ``found`` in surroundings of ``others``, drawn at random."""
    if not others:
        return []
    r = np.random.default_rng(5)
    drawn = [others[i] for i in r.integers(len(others), size=len(found))]
    return [o[:BEFORE] + w[BEFORE : BEFORE + RUN] + o[BEFORE + RUN :] for w, o in zip(found, drawn, strict=True)]


def fit(learned: list[tuple[str, bool]], calibrating: list[tuple[str, bool]]) -> Model | None:
    """From (window, is a finding), as ``fitted`` does with a single shard."""
    parts = [[w for w, f in rows if f == kind] for rows in (learned, calibrating) for kind in (True, False)]
    if min(map(len, parts)) < FEWEST:
        return None
    found, others, held, held_others = parts
    moved, held_moved = in_other_surroundings(found, others), in_other_surroundings(held, held_others)

    # a first network, of runs alone, tells which of the others look like findings: secrets that rules miss, so they teach nothing
    first = fit_network(*labelled(alone(found), alone(others)))
    doubt = float(np.quantile(first.logits(alone(found)), DOUBT))
    sure = lambda rows: [w for w, x in zip(rows, first.logits(alone(rows)), strict=True) if x < doubt] or rows
    net = fit_network(*labelled([*found, *moved], sure(others)))

    windows, y = labelled([*held, *held_moved], sure(held_others))
    logits = net.logits(windows)
    slope, offset = logistic_fit(logits, y)
    calibrated, shapes = slope * logits + offset, np.array([shape(w) for w in windows])

    def threshold(mine: np.ndarray) -> float:
        keep = float(np.sort(calibrated[mine])[int((1 - RECALL) * mine.sum())])
        below = calibrated[(y == 0) & (calibrated < keep)]
        return keep if not len(below) else (keep + float(np.quantile(below, 1 - ODD))) / 2

    of_shape = [(y > 0) & (shapes == s) for s in range(3)]
    return Model(net, slope, offset, tuple(1 / (1 + math.exp(-threshold(m if m.sum() >= FEWEST else y > 0))) for m in of_shape))


# --- the jobs ---------------------------------------------------------------------------------------------


SHARDED = "held boolean, finding boolean, h long, doc_id long, start int, window string, extra int, shard int"


def _shards(found: DataFrame) -> tuple[DataFrame, dict[tuple[bool, bool], int]] | None:
    """All windows of ``findings`` that are learned from and (``held``) that calibrate, dealt to shards, and their numbers by (held,
    finding). ``extra`` is 0 but for further copies of windows of a rare kind. None if there are too few."""
    windows = found.where("fold in (0, 1, 3)").select("doc_id", (F.col("fold") == 1).alias("held"), F.explode("candidates").alias("c")).select("held", "c.finding", "doc_id", "c.start", "c.window")
    n = {(r["held"], r["finding"]): r["n"] for r in windows.groupBy("held", "finding").agg(F.count("*").alias("n")).collect()}
    if min(n.get((held, finding), 0) for held in (False, True) for finding in (False, True)) < FEWEST:
        return None
    shards = {held: -(-(n[held, True] + n[held, False]) // SHARD) for held in (False, True)}
    times = {k: min(shards[k[0]], -(-shards[k[0]] * LEAST_OF_KIND // n[k])) for k in n}
    told = F.create_map(*(x for k, t in times.items() for x in (F.lit(f"{k[0]}{k[1]}".lower()), F.lit(t))))[F.concat(F.col("held").cast("string"), F.col("finding").cast("string"))]
    rows = windows.groupBy(*windows.columns).agg(F.count("*").alias("_n")).select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))
    dealt = rows.select("*", F.xxhash64("doc_id", "start").alias("h"), F.explode(F.sequence(F.lit(0), told - 1)).alias("extra"))
    shard = F.pmod(F.pmod(F.xxhash64("doc_id", "start", "window", "_copy"), F.lit(1 << 30)) + F.col("extra"), F.when(F.col("held"), shards[True]).otherwise(shards[False])).cast("int")
    return dealt.select(*(x.split()[0] for x in SHARDED.split(", ")[:-1]), shard.alias("shard")), n


def _in_order(group: pa.Table) -> pa.Table:
    return group.sort_by([(c, "ascending") for c in ("h", "doc_id", "start", "window", "extra")])


def _of_kind(t: pa.Table, finding: bool, column: str | None = None) -> list[str]:
    """Windows of a kind, those alone where ``column`` is true."""
    keep = np.array(t.column("finding").to_pylist(), bool) == finding
    return t.filter(pa.array(keep & np.array(t.column(column).to_pylist(), bool) if column else keep)).column("window").to_pylist()


def _mean(parts: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    """Number of windows of the states (number, bytes) together, and their mean by these numbers."""
    total, mean = 0, np.zeros(1)
    for n, state in parts:
        x = np.frombuffer(state)
        total += n
        mean = x.copy() if total == n else mean + (x - mean) * (n / total)
    return total, mean


def _learned(rows: DataFrame, given) -> Network:
    """A network of all shards of ``rows``; ``given`` makes (windows, y) of a shard's rows in order."""
    made = "shard int, n long, state binary"

    def one(state: np.ndarray, number: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            windows, y = given(_in_order(group))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(y)], pa.int64()), "state": pa.array([epoch(state, windows, y, number).tobytes()], pa.binary())})

        return run

    def averaged(key: tuple, group: pa.Table) -> pa.Table:
        t = group.sort_by("shard")
        n, mean = _mean(list(zip(t.column("n").to_pylist(), t.column("state").to_pylist(), strict=True)))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "state": pa.array([mean.tobytes()], pa.binary())})

    state = fresh_state()
    for number in range(EPOCHS):
        each = rows.groupBy("shard").applyInArrow(one(state, number), made)
        few = each.groupBy(F.floor(F.col("shard") / AVERAGED).cast("int").alias("part")).applyInArrow(averaged, made)
        state = _mean([(n, bytes(x)) for _, n, x in sorted(map(tuple, few.collect()))])[1]
    return network(state)


def ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as whole ones that are in the same order."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def order_statistics(rows: DataFrame, wanted: list[tuple[Column, int]]) -> list[float]:
    """For each (condition, rank from 0) the value of that rank among the rows' ``o`` (``ordered`` values) that meet the condition: counts by
    the first 12 binary digits, then by the next ones of those that begin like the value, and so on."""
    begun, left = [0] * len(wanted), [k for _, k in wanted]
    for shift in (52, 40, 28, 16, 4, 0):
        same = lambda i: F.shiftright("o", shift + (12 if shift else 4)) == begun[i]  # noqa: B023, E731
        which = F.array_compact(F.array(*(F.when(c if shift == 52 else c & same(i), F.lit(i)) for i, (c, _) in enumerate(wanted))))
        counts = rows.select(F.explode(which).alias("i"), F.shiftright("o", shift).alias("p")).groupBy("i", "p").count().collect()
        for i in range(len(wanted)):
            for p, n in sorted((r[1], r[2]) for r in counts if r[0] == i):
                if left[i] < n:
                    begun[i] = p
                    break
                left[i] -= n
    bits = np.array(begun, np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64).tolist()


def quantiles(rows: DataFrame, wanted: list[tuple[Column, int, float]]) -> list[float]:
    """For each (condition, number of rows that meet it, share) the quantile, between two values in proportion as numpy does."""
    at = [share * (n - 1) for _, n, share in wanted]
    ends = order_statistics(rows, [(c, min(n - 1, int(x) + up)) for (c, n, _), x in zip(wanted, at, strict=True) for up in (0, 1)])
    return [float(np.quantile(ends[2 * i : 2 * i + 2], x - int(x))) for i, x in enumerate(at)]


def fitted(found: DataFrame) -> Model | None:
    """The model of all candidates of ``findings`` outside the held-out documents."""
    if (dealt := _shards(found)) is None:
        return None
    rows, n = stored(dealt[0]), dealt[1]
    first = _learned(rows.where("NOT held"), lambda t: labelled(alone(_of_kind(t, True)), alone(_of_kind(t, False))))

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("o", pa.array(ordered(first.logits(alone(b.column("window").to_pylist())))))

    looked = stored(rows.mapInArrow(looks, SHARDED + ", o long"))
    doubt = int(ordered(np.array(quantiles(looked, [(F.expr("NOT held AND finding AND extra = 0"), n[False, True], DOUBT)])))[0])
    sure = F.col("o") < doubt
    counted = {r["held"]: r["n"] for r in looked.where("NOT finding").groupBy("held").agg(F.count_if(sure).alias("n")).collect()}
    told = looked.withColumn("sure", sure | F.when(F.col("held"), counted[True] == 0).otherwise(counted[False] == 0)).withColumn("once", F.col("extra") == 0)
    net = _learned(told.where("NOT held"), lambda t: labelled([*(own := _of_kind(t, True)), *in_other_surroundings(own, _of_kind(t, False))], _of_kind(t, False, "sure")))

    def calibrating(_: tuple, group: pa.Table) -> pa.Table:
        t = _in_order(group)
        own, once = _of_kind(t, True, "once"), t.filter(t.column("once"))
        windows, y = labelled([*own, *in_other_surroundings(own, _of_kind(t, False))], _of_kind(once, False, "sure"))
        return pa.table({"y": pa.array(y, pa.float64()), "shape": pa.array([shape(w) for w in windows], pa.int32()), "x": pa.array(net.logits(windows), pa.float64())})

    shown = stored(told.where("held").groupBy("shard").applyInArrow(calibrating, "y double, shape int, x double"))
    number = {(r[0], r[1]): r[2] for r in shown.groupBy("y", "shape").count().collect()}
    positive = sum(v for (y, _), v in number.items() if y > 0)

    def sums(w: np.ndarray, targets: tuple[float, float]) -> tuple[float, ...]:
        x = F.col("x")
        p = F.lit(1.0) / (F.exp(-F.least(F.greatest(x * float(w[0]) + float(w[1]), F.lit(-60.0)), F.lit(60.0))) + 1)
        q, e = p * (F.lit(1.0) - p), p - F.when(F.col("y") > 0, targets[0]).otherwise(targets[1])
        return tuple(shown.agg(*(F.sum(c) for c in (q * x * x, q * x, q, e * x, e))).first())

    slope, offset = logistic_newton(sums, positive, sum(number.values()) - positive)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("o", pa.array(ordered(slope * b.column("x").to_numpy() + offset)))

    ranks = stored(shown.mapInArrow(ranked, "y double, shape int, x double, o long"))
    mine = [(F.expr(f"y > 0 AND shape = {s}"), number.get((1.0, s), 0)) if number.get((1.0, s), 0) >= FEWEST else (F.col("y") > 0, positive) for s in range(3)]
    keep = order_statistics(ranks, [(c, int((1 - RECALL) * k)) for c, k in mine])
    below = [(F.col("y") == 0) & (F.col("o") < int(o)) for o in ordered(np.array(keep))]
    lower = ranks.agg(*(F.count_if(c) for c in below)).first()
    some = [i for i in range(3) if lower[i]]
    odd = dict(zip(some, quantiles(ranks, [(below[i], lower[i], 1 - ODD) for i in some]) if some else [], strict=True))
    return Model(net, slope, offset, tuple(1 / (1 + math.exp(-((k + odd[i]) / 2 if i in odd else k))) for i, k in enumerate(keep)))


def scored(found: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``findings`` with the network's spans (``net``) and the scores of all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
        for b in batches:
            rows = b.column(6).to_pylist()
            distinct = sorted({c["window"] for row in rows for c in row}) if model else []
            told = dict(zip(distinct, model.scores(distinct).tolist(), strict=True)) if model else {}
            scores = [[{"finding": c["finding"], "start": c["start"], "end": c["end"], "score": told[c["window"]]} for c in row] if model else [] for row in rows]
            net = [[{"start": c["start"], "end": c["end"], "score": told[c["window"]]} for c in row if model and not c["finding"] and told[c["window"]] >= model.thresholds[shape(c["window"])]] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(b.column(i) for i in range(2, 6)), pa.array(net, pa.list_(pa.struct(span))), pa.array(scores, pa.list_(pa.struct([("finding", pa.bool_()), *span])))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "spans", "net", "scores"],
            )

    return found.mapInArrow(run, SCORED)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, score): a row per span; rules' spans have no score."""
    found = stored(findings(docs))
    rows = scored(found, fitted(found))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1)
    ruled = rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", kind.alias("kind"), "s.start", "s.end", F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(rows.select("doc_id", F.explode("net").alias("s")).select("doc_id", F.lit("net").alias("kind"), "s.start", "s.end", "s.score"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net: a row per document."""
    found = stored(findings(docs))
    kinds = [*KINDS, "net"]
    joined = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [[(s["start"], s["kind"], s["end"]) for s in row] for row in b.column(4).to_pylist()]
            net = [[(s["start"], len(KINDS), s["end"]) for s in row] for row in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array([sha256(joined(x).encode()) for x in base], pa.string()), pa.array([joined([*x, *y]) for x, y in zip(base, net, strict=True)], pa.string()), pa.array([len(x) for x in net], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_net"],
            )

    return scored(found, fitted(found)).drop("scores").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")
