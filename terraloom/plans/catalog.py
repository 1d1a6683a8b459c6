"""Where queries are entered, and the SQL of the table views that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.robust import grubbs_critical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enter a function (spark, sf_dir) as query ``name`` with the SQL that states its result."""

    def enter(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return enter


def steps(x: Column, scale: int = 100) -> Column:
    """A double as a whole number of 1/scale steps, away from ties: what oracles compare fits by."""
    return F.floor(x * scale + 0.37129).cast("long")


def sql_steps(x: str, scale: int = 100) -> str:
    return f"CAST(floor(({x}) * {scale} + 0.37129) AS BIGINT)"


#: px(px, t, value, qual): supplier_series.
PX = """
cell AS (
    SELECT l_suppkey AS px, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 8.0) AS INTEGER) AS epoch,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n
    FROM lineitem GROUP BY 1, 2
), ext AS (SELECT min(epoch) AS lo, max(epoch) AS hi FROM cell),
axis AS (SELECT px, lo, unnest(generate_series(lo, hi)) AS epoch FROM (SELECT DISTINCT px FROM cell), ext),
px AS (
    SELECT a.px, CAST(a.epoch - lo AS INTEGER) AS t, CAST(coalesce(least(round_even(CAST(cents AS DOUBLE) / n / 1000.0, 0), 32767), 32767) AS INTEGER) AS value,
        CASE WHEN n IS NULL THEN 255 WHEN (a.px + a.epoch) % 17 = 0 THEN 4 WHEN (a.px + a.epoch) % 11 = 0 THEN 3
            WHEN n >= 3 THEN 0 WHEN n = 2 THEN 1 ELSE 2 END AS qual
    FROM axis a LEFT JOIN cell c ON c.px = a.px AND c.epoch = a.epoch
)"""

#: ev(px, t, v): event_series.
EV = """
ecell AS (
    SELECT user_id AS px, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, sum(CAST(round(value * 1000) AS BIGINT)) AS s, count(*) AS n
    FROM events GROUP BY 1, 2
), eaxis AS (SELECT px, CAST(unnest(generate_series(0, 29)) AS INTEGER) AS t FROM (SELECT DISTINCT px FROM ecell)),
ev AS (SELECT px, t, round_even(CAST(s AS DOUBLE) / n / 100.0, 0) AS v FROM eaxis LEFT JOIN ecell USING (px, t))"""

#: grid(row, col, value, mask): part_grid.
GRID = """
grid AS (
    SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DOUBLE) AS value,
        CASE WHEN p_partkey % 23 = 0 THEN 0 WHEN p_size = 7 THEN 2 ELSE 1 END AS mask
    FROM part
)"""

#: pair(scene, id, x, y): scene_pairs.
PAIR = """
pair AS (
    SELECT l_returnflag || '-' || CAST(l_linenumber AS VARCHAR) AS scene, l_orderkey AS id, l_quantity AS x,
        CAST(l_quantity * 2 + l_linenumber + (l_orderkey % 13) AS DOUBLE) AS y
    FROM lineitem
)"""

#: poi(fid, x, y): points. til(tile, x0, y0, res, n_rows, n_cols): grids.
#: pl: points with the cells of grids that they are in. lin(fid, x1, y1, x2, y2): lines. bnd(px, epoch, band, value): bands.
POINTS = "poi AS (SELECT c_custkey AS fid, c_acctbal AS x, CAST((c_custkey * 37) % 10000 AS DOUBLE) AS y FROM customer)"
GRIDS = "til AS (SELECT n_name AS tile, CAST(n_nationkey % 5 * 2000 AS DOUBLE) AS x0, CAST(n_nationkey // 5 * 2000 + 2000 AS DOUBLE) AS y0, 50.0::DOUBLE AS res, 40 AS n_rows, 40 AS n_cols FROM nation)"
PLACED = "pl AS (SELECT fid, x, y, tile, CAST(floor((y0 - y) / res) AS INTEGER) AS row, CAST(floor((x - x0) / res) AS INTEGER) AS col FROM poi JOIN til ON x >= x0 AND x < x0 + n_cols * res AND y > y0 - n_rows * res AND y <= y0)"
LINES = """
lin AS (
    SELECT fid, x1, y1, x1 + (fid % 7 - 3) * 41 AS x2, y1 + (fid % 5 - 2) * 63 AS y2
    FROM (SELECT s_suppkey AS fid, CAST(s_suppkey % 50 * 10 + 3 AS DOUBLE) AS x1, CAST(s_suppkey * 17 % 40 * 10 + 7 AS DOUBLE) AS y1 FROM supplier)
), lst AS (
    SELECT *, CAST(greatest(ceil(greatest(abs(x2 - x1), abs(y2 - y1)) / 10.0::DOUBLE * 2), 1) AS INTEGER) AS n FROM lin
), lsx AS (SELECT *, unnest(generate_series(0, n)) AS i FROM lst),
lcl AS (
    SELECT fid, row, col, min(i) AS step FROM (
        SELECT fid, CAST(i AS INTEGER) AS i, CAST(floor((400.0::DOUBLE - (y1 + (y2 - y1) * (CAST(i AS DOUBLE) / n))) / 10.0::DOUBLE) AS INTEGER) AS row,
            CAST(floor((x1 + (x2 - x1) * (CAST(i AS DOUBLE) / n)) / 10.0::DOUBLE) AS INTEGER) AS col FROM lsx
    ) GROUP BY fid, row, col
)"""
BANDS = """
bnd AS (
    SELECT l_suppkey AS px, CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE) AS epoch, l_linenumber AS band, sum(CAST(l_quantity AS BIGINT)) AS value FROM lineitem GROUP BY 1, 2, 3
)"""

SCENES = "scn AS (SELECT o_orderkey AS scene, CAST(o_orderdate AS DATE) AS acq_date FROM orders)"
EPOCHS = """
epo AS (
    SELECT DISTINCT DATE '1992-01-01' + 8 * CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 8.0) AS INTEGER) AS epoch_date FROM lineitem
)"""
NAMES = """
nam AS (
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'MCD43A4' ELSE 'MCD43A2' END || '.A' || strftime(CAST(o_orderdate AS DATE), '%Y%j') || '.h'
        || lpad(CAST(o_custkey % 3 + 17 AS VARCHAR), 2, '0') || 'v04.006.' || CAST(o_orderkey % 5 + 2015000 AS VARCHAR)
        || CASE WHEN o_orderkey % 10 = 3 THEN '.jpg' ELSE '.hdf' END AS name
    FROM orders
)"""


def sql_weight(weights: tuple[float, ...], missing: str = "NULL") -> str:
    cases = " ".join(f"WHEN {c} THEN {w!r}" for c, w in enumerate(weights))
    return f"CASE qual {cases} ELSE CAST({missing} AS DOUBLE) END"


def sql_series(weights: tuple[float, ...], missing: str = "NULL") -> str:
    """sv(px, t, v, w): masked and weighted series."""
    return f"{PX}, sv AS (SELECT px, t, CASE WHEN value <> 32767 THEN CAST(value AS DOUBLE) END AS v, CAST({sql_weight(weights, missing)} AS DOUBLE) AS w FROM px)"


def sql_windows(source: str = "sv", half: int = 7) -> str:
    """win(px, t, k, v, w): the full windows around each (px, t)."""
    return f"""win AS (
        SELECT * FROM (
            SELECT a.px, a.t, CAST(b.t - a.t AS INTEGER) AS k, b.v, b.w, count(*) OVER (PARTITION BY a.px, a.t) AS n_rows
            FROM {source} a JOIN {source} b ON b.px = a.px AND b.t BETWEEN a.t - {half} AND a.t + {half}
        ) WHERE n_rows = {2 * half + 1}
    )"""


def sql_fit(source: str, out: str, degree: int = 2) -> str:
    """out(px, t, a0, a1, a2): the weighted polynomial of every window of ``source``."""
    sums = ", ".join(f"sum(coalesce({term}, 0.0) ORDER BY k) AS {name}" for name, term in (("s0", "w"), ("s1", "w * k"), ("s2", "w * (k * k)"), ("s3", "w * (k * k * k)"), ("s4", "w * (k * k * k * k)"), ("y0", "w * v"), ("y1", "(w * v) * k"), ("y2", "(w * v) * (k * k)")))
    if degree == 1:
        body = "SELECT px, t, (s2 * y0 - s1 * y1) / det AS a0, (s0 * y1 - s1 * y0) / det AS a1, 0.0 AS a2"
        det = "CASE WHEN s0 * s2 - s1 * s1 <> 0 THEN s0 * s2 - s1 * s1 END"
    else:
        body = """SELECT px, t, ((s2 * s4 - s3 * s3) * y0 + (s2 * s3 - s1 * s4) * y1 + (s1 * s3 - s2 * s2) * y2) / det AS a0,
            ((s2 * s3 - s1 * s4) * y0 + (s0 * s4 - s2 * s2) * y1 + (s1 * s2 - s0 * s3) * y2) / det AS a1,
            ((s1 * s3 - s2 * s2) * y0 + (s1 * s2 - s0 * s3) * y1 + (s0 * s2 - s1 * s1) * y2) / det AS a2"""
        d = "s0 * s2 * s4 + 2.0 * s1 * s2 * s3 - s2 * s2 * s2 - s1 * s1 * s4 - s0 * s3 * s3"
        det = f"CASE WHEN abs({d}) > 1e-9 * s0 * s2 * s4 THEN {d} END"
    return f"{out}_m AS (SELECT px, t, {sums} FROM {source} GROUP BY px, t), {out} AS ({body} FROM (SELECT *, {det} AS det FROM {out}_m))"


def sql_reweight(source: str, fit: str, out: str, values: str = "raw") -> str:
    """out(px, t, k, v, w): windows with residual weights."""
    kept = "v" if values == "raw" else "f"
    return f"""{out} AS (
        SELECT px, t, k, {kept} AS v, sum(d) OVER (PARTITION BY px, t ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / d AS w FROM (
            SELECT px, t, k, v, f, CASE WHEN v IS NOT NULL AND f IS NOT NULL THEN greatest(abs(f - v), 1.0) END AS d FROM (
                SELECT px, t, k, v, round_even(a0 + a1 * k + a2 * (k * k), 0) AS f FROM {source} JOIN {fit} USING (px, t)
            )
        )
    )"""


def sql_fill(source: str, out: str, value: str = "v", keys: str = "px", time: str = "t") -> str:
    """out: ``source`` with ``filled``, gaps interpolated."""
    back, ahead = (f"OVER (PARTITION BY {keys} ORDER BY {time} ROWS BETWEEN {r})" for r in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
    return f"""{out} AS (
        SELECT * EXCLUDE (p_, pt_, n_, nt_), coalesce({value}, round_even(p_ + (n_ - p_) * ({time} - pt_) / (nt_ - pt_), 0), p_, n_) AS filled FROM (
            SELECT *, last_value({value} IGNORE NULLS) {back} AS p_, last_value(CASE WHEN {value} IS NOT NULL THEN {time} END IGNORE NULLS) {back} AS pt_,
                first_value({value} IGNORE NULLS) {ahead} AS n_, first_value(CASE WHEN {value} IS NOT NULL THEN {time} END IGNORE NULLS) {ahead} AS nt_
            FROM {source}
        )
    )"""


def sql_low_pass(source: str, out: str, length: int, keys: str = "px, blk", value: str = "filled", limit: str | None = None) -> str:
    """out(keys, k, z): complete blocks of ``source`` (keys, k = 0.., value) low-pass filtered; ``limit``: the least power, that of
    the second strongest frequency halved if not given."""
    limit = limit or f"coalesce(max(pw) FILTER (pw < top * (1 - 1e-12)) OVER (PARTITION BY {keys}), 0) / 2"
    return f"""
    {out}_b AS (SELECT {keys}, b, sum({value} * cos(2 * pi() * b * k / {length})) AS re, -sum({value} * sin(2 * pi() * b * k / {length})) AS im
        FROM {source}, (SELECT unnest(generate_series(0, {length - 1})) AS b) WHERE {value} IS NOT NULL GROUP BY {keys}, b),
    {out}_p AS (SELECT *, (re * re + im * im) / {length} AS pw, max((re * re + im * im) / {length}) OVER (PARTITION BY {keys}) AS top FROM {out}_b),
    {out}_k AS (SELECT * FROM (SELECT *, {limit} AS lim FROM {out}_p) WHERE pw > lim),
    {out} AS (SELECT {keys}, k, sum(re * cos(2 * pi() * b * k / {length}) - im * sin(2 * pi() * b * k / {length})) / {length} AS z
        FROM {out}_k, (SELECT unnest(generate_series(0, {length - 1})) AS k) GROUP BY {keys}, k)"""


#: Days in a series of events.
_DAYS = 30


def sql_grubbs(source: str, out: str, alpha: float, ddof: int, most: int = _DAYS) -> str:
    """out(px, total, low, high): Grubbs' test of the values v of ``source`` by px, an extreme a step; groups of ``most`` values at most."""
    critical = ", ".join(f"({n}, {grubbs_critical(n, alpha)!r}::DOUBLE)" for n in range(3, most + 1))
    step = f"""SELECT s.px, s.total, s.critical, s.step + 1 AS step,
            min(e.v) FILTER (NOT (s.mean - e.v >= s.far)) AS low, max(e.v) FILTER (NOT (e.v - s.mean >= s.far)) AS high
        FROM {out}_s s JOIN {source} e ON e.px = s.px AND e.v BETWEEN s.low AND s.high GROUP BY ALL"""
    measured = lambda rows: f"""SELECT g.px, g.total, g.critical, g.step, g.low, g.high, avg(e.v) AS mean, CASE WHEN count(*) > {ddof} THEN sqrt(var_pop(e.v) * count(*) / (count(*) - {ddof})) END AS sd, greatest(avg(e.v) - min(e.v), max(e.v) - avg(e.v)) AS far
        FROM ({rows}) g JOIN {source} e ON e.px = g.px AND e.v BETWEEN g.low AND g.high GROUP BY ALL"""  # noqa: E731
    return f"""{out}_c(n, critical) AS (VALUES {critical}),
    {out}_s AS (
        {measured(f"SELECT px, count(v) AS total, critical, 0 AS step, min(v) AS low, max(v) AS high FROM {source} LEFT JOIN {out}_c ON n = (SELECT count(v) FROM {source} x WHERE x.px = {source}.px) GROUP BY px, critical")}
        UNION ALL
        {measured(step.replace(f"FROM {out}_s s", f"FROM (SELECT * FROM {out}_s WHERE sd > 0 AND far / sd > critical) s"))}
    ), {out} AS (SELECT px, total, low, high, mean, sd FROM {out}_s QUALIFY row_number() OVER (PARTITION BY px ORDER BY step DESC) = 1)"""
