"""Queries of joins (J), sorts (O), set operations (U), the calendar and the products at a point."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraloom.functions import dates
from terraloom.functions.names import parts
from terraloom.operators import temporal
from terraloom.plans.catalog import BANDS, EPOCHS, EV, GRIDS, NAMES, PLACED, POINTS, PX, SCENES, query, sql_steps, steps
from terraloom.sources import bucketed, tables


@query("j01_data_with_quality", f"WITH {PX} SELECT px, t, a.value, b.qual FROM (SELECT px, t, value FROM px WHERE value <> 32767) a LEFT JOIN (SELECT px, t, qual FROM px WHERE qual < 4) b USING (px, t)")
def j01(spark, d):
    s = tables.supplier_series(spark, d)
    return s.where("value <> 32767").select("px", "t", "value").join(s.where("qual < 4").select("px", "t", "qual"), ["px", "t"], "left")


#: Buckets of the tables that are joined in place.
BUCKETS = 16


@query("j01b_data_with_quality_in_place", f"WITH {PX} SELECT px, t, a.value, b.qual FROM (SELECT px, t, value FROM px WHERE value <> 32767) a LEFT JOIN (SELECT px, t, qual FROM px WHERE qual < 4) b USING (px, t)")
def j01b(spark, d):
    """Data and quality as tables of the same buckets by pixel, joined without an exchange."""
    s = tables.supplier_series(spark, d)
    data = bucketed.write(s.where("value <> 32767").select("px", "t", "value"), BUCKETS, order=("t",))
    quality = bucketed.write(s.where("qual < 4").select("px", "t", "qual"), BUCKETS, order=("t",))
    return bucketed.read(spark, data).join(bucketed.read(spark, quality).hint("merge"), ["px", "t"], "left")


_STACK = ", ".join(f"sum(value) FILTER (band = {b}) AS b{b}" for b in range(1, 8))


@query("j02_k04_f11_stack", f"WITH {BANDS} SELECT px, CAST(epoch AS VARCHAR) AS epoch, {_STACK} FROM bnd GROUP BY px, epoch HAVING count(DISTINCT band) = 7")
def j02(spark, d):
    wide = tables.bands(spark, d).groupBy("px", "epoch").pivot("band", list(range(1, 8))).agg(F.first("value"))
    named = wide.select("px", F.col("epoch").cast("string").alias("epoch"), *(F.col(str(b)).alias(f"b{b}") for b in range(1, 8)))
    return named.na.drop(subset=[f"b{b}" for b in range(1, 8)])


@query("j02b_stack_in_place", f"WITH {BANDS} SELECT px, CAST(epoch AS VARCHAR) AS epoch, {_STACK} FROM bnd GROUP BY px, epoch HAVING count(DISTINCT band) = 7")
def j02b(spark, d):
    """Seven bands as tables of the same buckets by pixel, joined one to the other without an exchange; complete stacks only."""
    bands = tables.bands(spark, d).select("px", F.col("epoch").cast("string").alias("epoch"), "band", "value")
    whole = None
    for b in range(1, 8):
        one = bucketed.read(spark, bucketed.write(bands.where(F.col("band") == b).select("px", "epoch", F.col("value").alias(f"b{b}")), BUCKETS, order=("epoch",)))
        whole = one if whole is None else whole.join(one.hint("merge"), ["px", "epoch"])
    return whole


_NEAREST = """SELECT scene, CAST(acq_date AS VARCHAR) AS acq_date, CAST(epoch_date AS VARCHAR) AS nearest FROM (
    SELECT *, row_number() OVER (PARTITION BY scene ORDER BY abs(date_diff('day', acq_date, epoch_date)), epoch_date DESC) AS r FROM scn, epo) WHERE r = 1"""


@query("j03_a22_asof_nearest", f"WITH {SCENES}, {EPOCHS} {_NEAREST}")
def j03(spark, d):
    near = temporal.nearest(tables.scene_dates(spark, d), tables.epochs(spark, d), "acq_date", "epoch_date")
    return near.select("scene", F.col("acq_date").cast("string").alias("acq_date"), F.col("nearest").cast("string").alias("nearest"))


@query(
    "j03b_asof_by_year_day_numbers",
    f"""WITH {SCENES}, {EPOCHS}, b AS (SELECT scene, acq_date, max(epoch_date) FILTER (epoch_date < acq_date) AS pre, min(epoch_date) FILTER (epoch_date >= acq_date) AS post FROM scn, epo GROUP BY scene, acq_date),
        n AS (SELECT *, abs((year(acq_date) - year(pre)) * 1000 + dayofyear(acq_date) - dayofyear(pre)) AS dpre, abs((year(post) - year(acq_date)) * 1000 + dayofyear(post) - dayofyear(acq_date)) AS dpost FROM b)
        SELECT scene, CAST(CASE WHEN post IS NULL OR dpre < dpost THEN pre ELSE post END AS VARCHAR) AS nearest FROM n""",
)
def j03b(spark, d):
    near = temporal.nearest(tables.scene_dates(spark, d), tables.epochs(spark, d), "acq_date", "epoch_date", difference="yyyyddd")
    return near.select("scene", F.col("nearest").cast("string").alias("nearest"))


def _neighbours_sql(win: int) -> str:
    return f"""WITH {SCENES}, {EPOCHS}, e AS (SELECT epoch_date AS day, row_number() OVER (ORDER BY epoch_date) AS no FROM epo),
        b AS (SELECT acq_date, count(*) FILTER (epoch_date < acq_date) AS n FROM (SELECT DISTINCT acq_date FROM scn), epo GROUP BY acq_date),
        r AS (SELECT scene, n, unnest(generate_series(1, {win})) AS rank FROM scn JOIN b USING (acq_date)),
        s AS (SELECT scene, 'pre' AS side, rank, n - rank + 1 AS no FROM r UNION ALL SELECT scene, 'post', rank, n + rank FROM r)
        SELECT scene, side, CAST(rank AS INTEGER) AS rank, CAST(day AS VARCHAR) AS day FROM s JOIN e USING (no)"""


def _neighbours(spark, d, win):
    n = temporal.neighbours(tables.scene_dates(spark, d), tables.epochs(spark, d), "acq_date", "epoch_date", win, "scene")
    return n.select("scene", "side", "rank", F.col("day").cast("string").alias("day"))


@query("j04_neighbours", _neighbours_sql(3))
def j04(spark, d):
    return _neighbours(spark, d, 3)


@query("j04b_neighbours_of_all_scenes", _neighbours_sql(1))
def j04b(spark, d):
    """One neighbour on either side, as the calibration takes them."""
    return _neighbours(spark, d, 1)


_SPLIT = ", ".join(f"split_part(name, '.', {i}) AS {c}" for i, c in ((1, "product"), (2, "epoch"), (3, "tile"), (5, "version"), (6, "ext")))
_FILES = f"{NAMES}, f AS (SELECT name, {_SPLIT} FROM nam)"


def _files(spark, d):
    n = tables.file_names(spark, d)
    p = parts(F.col("name"))
    return n.select("name", *(p[c].alias(c) for c in ("product", "epoch", "tile", "version", "ext")))


@query("j07_u01_missing_files", f"WITH {_FILES} SELECT DISTINCT name FROM f WHERE product = 'MCD43A4' AND (epoch, tile) NOT IN (SELECT (epoch, tile) FROM f WHERE product = 'MCD43A2')")
def j07(spark, d):
    f = _files(spark, d)
    have = f.where("product = 'MCD43A2'").select("epoch", "tile")
    return f.where("product = 'MCD43A4'").join(have, ["epoch", "tile"], "left_anti").select("name").distinct()


@query("j08_available_epochs", f"WITH {_FILES} SELECT DISTINCT epoch FROM f WHERE product = 'MCD43A4' AND epoch IN (SELECT epoch FROM f WHERE product = 'MCD43A2')")
def j08(spark, d):
    f = _files(spark, d)
    return f.where("product = 'MCD43A4'").select("epoch").distinct().join(f.where("product = 'MCD43A2'").select("epoch"), "epoch", "left_semi")


_PRODUCTS = ", ".join(f"max(name) FILTER (version = '{2015000 + i}') AS {c}" for i, c in enumerate(("abs", "rel", "pif", "rba", "odr")))


@query("j09_p19_products_by_epoch", f"WITH {_FILES} SELECT epoch, {_PRODUCTS} FROM f GROUP BY epoch")
def j09(spark, d):
    names = {str(2015000 + i): c for i, c in enumerate(("abs", "rel", "pif", "rba", "odr"))}
    wide = _files(spark, d).groupBy("epoch").pivot("version", list(names)).agg(F.max("name"))
    return wide.select("epoch", *(F.col(f"`{v}`").alias(c) for v, c in names.items()))


@query(
    "j10_u04_interleaved_sensors",
    f"""WITH {PX}, u AS (SELECT px, t * 2 AS place, 'MOD' AS sensor, value FROM px UNION ALL SELECT px, t * 2 + 1, 'MYD', value + 1 FROM px WHERE value <> 32767)
        SELECT px, sensor, value, CAST(row_number() OVER (PARTITION BY px ORDER BY place) AS INTEGER) AS no FROM u""",
)
def j10(spark, d):
    s = tables.supplier_series(spark, d)
    one = s.select("px", (F.col("t") * 2).alias("place"), F.lit("MOD").alias("sensor"), "value")
    two = s.where("value <> 32767").select("px", (F.col("t") * 2 + 1).alias("place"), F.lit("MYD").alias("sensor"), (F.col("value") + 1).alias("value"))
    return one.unionByName(two).select("px", "sensor", "value", F.row_number().over(Window.partitionBy("px").orderBy("place")).alias("no"))


@query(
    "j11_fit_raw_quality_by_name",
    f"""WITH {_FILES}, fit AS (SELECT DISTINCT replace(name, '.hdf', '.fit.tif') AS fit_name, epoch, tile FROM f WHERE product = 'MCD43A4' AND ext = 'hdf')
        SELECT fit_name, count(DISTINCT r.name) AS raws, count(DISTINCT q.name) AS quals FROM fit LEFT JOIN (SELECT name, epoch, tile FROM f WHERE product = 'MCD43A4') r USING (epoch, tile)
        LEFT JOIN (SELECT name, epoch, tile FROM f WHERE product = 'MCD43A2') q USING (epoch, tile) GROUP BY fit_name""",
)
def j11(spark, d):
    f = _files(spark, d)
    fits = f.where("product = 'MCD43A4' and ext = 'hdf'").select(F.replace("name", F.lit(".hdf"), F.lit(".fit.tif")).alias("fit_name"), "epoch", "tile").distinct()
    held = f.groupBy("epoch", "tile").agg(F.count_distinct(F.when(F.col("product") == "MCD43A4", F.col("name"))).alias("raws"), F.count_distinct(F.when(F.col("product") == "MCD43A2", F.col("name"))).alias("quals"))
    return fits.join(held, ["epoch", "tile"], "left").select("fit_name", "raws", "quals")


@query(
    "j13_basis_times_series",
    f"""WITH {PX}, b AS (SELECT k, {', '.join(f'cos(2 * pi() * {h} * k / 46) AS c{h}, sin(2 * pi() * {h} * k / 46) AS s{h}' for h in (1, 2, 3))} FROM (SELECT unnest(generate_series(1, 46)) AS k))
        SELECT px, CAST(t // 46 AS INTEGER) AS block, {', '.join(f'{sql_steps(f"sum(value * {c}{h})", 10)} AS {c}{h}' for h in (1, 2, 3) for c in ('c', 's'))} FROM px JOIN b ON b.k = t % 46 + 1 WHERE value <> 32767 GROUP BY 1, 2""",
)
def j13(spark, d):
    basis = spark.range(1, 47).select(F.col("id").cast("int").alias("k"), *(fn(F.col("id") * (2 * math.pi * h / 46)).alias(f"{c}{h}") for h in (1, 2, 3) for c, fn in (("c", F.cos), ("s", F.sin))))
    s = tables.supplier_series(spark, d).where("value <> 32767").withColumn("k", F.col("t") % 46 + 1)
    joined = s.join(F.broadcast(basis), "k")  # 46 rows
    return joined.groupBy("px", F.floor(F.col("t") / 46).cast("int").alias("block")).agg(*(steps(F.sum(F.col("value") * F.col(f"{c}{h}")), 10).alias(f"{c}{h}") for h in (1, 2, 3) for c in ("c", "s")))


@query("j14_newest_version", f"WITH {_FILES} SELECT product, epoch, tile, max(version || '/' || name) AS newest FROM f GROUP BY product, epoch, tile")
def j14(spark, d):
    newest = _files(spark, d).groupBy("product", "epoch", "tile").agg(F.max(F.struct("version", "name")).alias("m"))
    return newest.select("product", "epoch", "tile", F.concat_ws("/", "m.version", "m.name").alias("newest"))


@query("j15_window_self_join", f"WITH {EV} SELECT a.px, a.t, count(*) AS n, sum(b.v) AS total FROM ev a JOIN ev b ON b.px = a.px AND b.t BETWEEN a.t - 7 AND a.t + 7 GROUP BY a.px, a.t")
def j15(spark, d):
    w = Window.partitionBy("px").orderBy("t").rowsBetween(-7, 7)
    return tables.event_series(spark, d).select("px", "t", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("total"))


@query("o01_o02_s08_newest_files", f"WITH {_FILES} SELECT name, CAST(row_number() OVER (ORDER BY epoch DESC, name) AS INTEGER) AS place FROM f QUALIFY place <= 100")
def o01(spark, d):
    top = _files(spark, d).orderBy(F.desc("epoch"), "name").limit(100)
    return top.select("name", F.row_number().over(Window.orderBy(F.desc("epoch"), "name")).alias("place"))


@query("o03_latest_days", f"WITH {SCENES} SELECT CAST(d AS VARCHAR) AS day FROM (SELECT DISTINCT acq_date AS d FROM scn WHERE acq_date <= DATE '1998-06-30' AND acq_date >= DATE '1998-01-01' ORDER BY d DESC LIMIT 20)")
def o03(spark, d):
    return temporal.latest_days(tables.scene_dates(spark, d), "acq_date", "1998-06-30", 20, "1998-01-01").select(F.col("acq_date").cast("string").alias("day"))


@query("o04_last_seven", f"WITH {PX} SELECT px, t, value FROM px WHERE value <> 32767 QUALIFY row_number() OVER (PARTITION BY px ORDER BY t DESC) <= 7")
def o04(spark, d):
    w = Window.partitionBy("px").orderBy(F.desc("t"))
    return tables.supplier_series(spark, d).where("value <> 32767").select("px", "t", "value", F.row_number().over(w).alias("r")).where("r <= 7").drop("r")


@query("o07_first_as_master", f"WITH {_FILES} SELECT product, tile, min(epoch || '/' || name) AS master FROM f GROUP BY product, tile")
def o07(spark, d):
    m = _files(spark, d).groupBy("product", "tile").agg(F.min(F.struct("epoch", "name")).alias("m"))
    return m.select("product", "tile", F.concat_ws("/", "m.epoch", "m.name").alias("master"))


@query("u02_common_epochs", f"WITH {_FILES} SELECT epoch FROM f WHERE tile = 'h17v04' INTERSECT SELECT epoch FROM f WHERE tile = 'h18v04'")
def u02(spark, d):
    f = _files(spark, d)
    return f.where("tile = 'h17v04'").select("epoch").intersect(f.where("tile = 'h18v04'").select("epoch"))


@query("u03_union_of_index_sets", f"WITH {PX} SELECT px, t FROM px WHERE qual = 255 UNION SELECT px, t FROM px WHERE value > 2000")
def u03(spark, d):
    cells = tables.supplier_series(spark, d)
    return cells.where("qual = 255").select("px", "t").union(cells.where("value > 2000").select("px", "t")).distinct()


@query("u05_joined_lists", f"WITH {BANDS}, r AS (SELECT px, epoch, list(value ORDER BY band) AS vs FROM bnd GROUP BY px, epoch) SELECT px, list_aggregate(flatten(list(vs ORDER BY epoch)), 'string_agg', ',') AS joined FROM r GROUP BY px")
def u05(spark, d):
    rows = tables.bands(spark, d).groupBy("px", "epoch").agg(F.array_sort(F.collect_list(F.struct("band", "value"))).alias("vs"))
    lists = rows.groupBy("px").agg(F.array_sort(F.collect_list(F.struct("epoch", "vs"))).alias("ls"))
    return lists.select("px", F.concat_ws(",", F.transform(F.flatten("ls.vs"), lambda x: x["value"].cast("string"))).alias("joined"))


@query(
    "fn_calendar",
    f"""WITH {SCENES}, c AS (SELECT CAST(unnest(generate_series(min(acq_date), max(acq_date), INTERVAL 1 DAY)) AS DATE) AS d FROM scn),
        e AS (SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS epoch_seq, d AS epoch_date FROM c WHERE (dayofyear(d) - 1) % 8 = 0),
        n AS (SELECT acq_date - CAST((dayofyear(acq_date) - 1) % 8 AS INTEGER) AS epoch_date, count(*) AS n FROM scn GROUP BY 1)
        SELECT epoch_seq, CAST(epoch_date AS VARCHAR) AS epoch_date, CAST(year(epoch_date) AS INTEGER) AS year, CAST(dayofyear(epoch_date) AS INTEGER) AS doy, coalesce(n, 0) AS n_scenes FROM e LEFT JOIN n USING (epoch_date)""",
)
def fn_calendar(spark, d):
    """The calendar of epochs over the scenes' days, with the number of scenes in each epoch."""
    scenes = tables.scene_dates(spark, d)
    first, last = scenes.agg(F.min("acq_date"), F.max("acq_date")).first()
    start = F.date_sub("acq_date", ((F.dayofyear("acq_date") - 1) % 8).cast("int"))
    n = scenes.groupBy(start.alias("epoch_date")).agg(F.count("*").alias("n"))
    told = temporal.calendar(spark, str(first), str(last)).join(n, "epoch_date", "left")
    return told.select("epoch_seq", F.col("epoch_date").cast("string").alias("epoch_date"), "year", "doy", F.coalesce("n", F.lit(0).cast("long")).alias("n_scenes"))


@query(
    "f13_products_at_points",
    f"""WITH {PX}, {POINTS}, {GRIDS}, {PLACED}, w AS (SELECT px, t, max(value) FILTER (t % 3 = 0) AS a, max(value) FILTER (t % 3 = 1) AS b, max(CASE WHEN qual IN (4, 255) THEN 0 ELSE 1 END) AS m FROM px WHERE value <> 32767 GROUP BY px, t)
        SELECT fid, t, coalesce(a, 0) * m AS abs, coalesce(b, 0) * m AS rel FROM pl JOIN w ON px = row * 40 + col""",
)
def f13(spark, d):
    """At each point the products of an epoch side by side, missing ones 0, all 0 under the mask."""
    at = tables.points_with_pixels(spark, d)
    s = tables.supplier_series(spark, d).where("value <> 32767").join(at.select("px").distinct(), "px", "left_semi")
    product = F.when(F.col("t") % 3 == 0, "abs").when(F.col("t") % 3 == 1, "rel").otherwise("other")
    sound = F.max(F.when(F.col("qual").isin(4, 255), 0).otherwise(1))
    wide = s.groupBy("px", "t").agg(*(F.max(F.when(product == c, F.col("value"))).alias(c) for c in ("abs", "rel")), sound.alias("m"))
    return at.join(wide, "px").select("fid", "t", *((F.coalesce(c, F.lit(0)) * F.col("m")).alias(c) for c in ("abs", "rel")))


@query(
    "k04_incomplete_stacks",
    f"""WITH {BANDS}, h AS (SELECT px, epoch, unnest(generate_series(1, 7)) AS band FROM (SELECT DISTINCT px, epoch FROM bnd))
        SELECT px, CAST(epoch AS VARCHAR) AS epoch, count(value) AS n_bands, string_agg(CAST(band AS VARCHAR), ',' ORDER BY band) FILTER (value IS NULL) AS missing
        FROM h LEFT JOIN bnd USING (px, epoch, band) GROUP BY px, epoch HAVING count(value) < 7""",
)
def k04(spark, d):
    """The epochs that j02 leaves out, and the bands that they miss."""
    held = tables.bands(spark, d).groupBy("px", "epoch").agg(F.collect_set("band").alias("held"))
    missing = F.array_except(F.array(*(F.lit(b) for b in range(1, 8))), F.transform("held", lambda b: b.cast("int")))
    return held.where(F.size("held") < 7).select("px", F.col("epoch").cast("string").alias("epoch"), F.size("held").cast("long").alias("n_bands"), F.array_join(F.transform(missing, lambda b: b.cast("string")), ",").alias("missing"))


@query("fn_date_range", "SELECT o_orderkey AS id, CAST(least(CAST(o_orderdate AS DATE), DATE '1998-01-01') AS VARCHAR) AS first, CAST(greatest(CAST(o_orderdate AS DATE), DATE '1998-01-01') AS VARCHAR) AS last FROM orders")
def fn_date_range(spark, d):
    first, last = dates.ordered(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date"))
    return tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), first.cast("string").alias("first"), last.cast("string").alias("last"))
