"""Grid-bucketed spatial joins.

Every join is an equi-join on grid cells followed by the exact geometric test. The smaller side is spread over
the cells its reach covers; the larger side sits in one cell per row. A cell whose rows would make too many pairs is cut
into tiles on both sides, so the pairs of one tile stay below a constant. Pairs are reduced by an aggregate right after
the test.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrametra.functions import geo
from terrametra.functions.numeric import add_min_max, half_even
from terrametra.operators.ranking import exact_quantile, ordered_positions, top_n_per_group
from terrametra.session import durable, written

KM_PER_DEGREE = geo.EARTH_KM * math.pi / 180.0
PACKED_LIMIT = 64
# Anchors that travel as one value, and anchors folded together beyond that.
PACKED_ANCHORS = 1_000
# At this distance the pull is below 1e-24 of the difference in price.
REACH_SIGMAS = 10.6
# Pairs of rows that meet in one tile of a cell, about; a tile has at most the square root of it on its longer side.
TILE_PAIRS = 1 << 25
# Keys of one place that travel as one list.
PLACE_KEYS = 1 << 8
# Sums over regions: cells get a quarter as wide up to so many times, as long as one holds this many places on average.
DEPTH = 4
CELL_PLACES = 6
# Pairs closer than a distance: the width of a cell in such distances, and pairs of lists in a tile, which are tested at once.
CLOSE_CELL, CLOSE_PAIRS = 1, 1 << 27
# Rays: edges and places of a tile at most, about, and crossings that are tested at a time.
RAY_EDGES, RAY_PLACES, RAY_STRIP = 1 << 18, 1 << 17, 1 << 16
# Dense kernel: entries of a block where there would be many, and rows of the kernel held at a time.
MANY_BLOCKS, DENSE_BLOCK, KERNEL_STRIP = 16, 2_000, 64


def cell(c: Column, step: float) -> Column:
    return F.floor(c / step).cast("bigint")


def in_cells(df: DataFrame, step: float, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """One grid cell per row."""
    return df.withColumn("_cx", cell(F.col(lng), step)).withColumn("_cy", cell(F.col(lat), step))


def cell_join(spread: DataFrame, fixed: DataFrame, on: list[str] | None = None, tile_pairs: int | None = None) -> DataFrame:
    """Join two frames on their cell (and the columns ``on``), with a bounded number of pairs in each tile.

    Rows of both sides are counted by cell in one aggregate. Where the product is above ``tile_pairs`` (``TILE_PAIRS``),
    each side is cut into slices by a hash of the row, and a row is repeated for the slices of the other side, so that
    any two rows of the cell meet in exactly one tile. Other cells are neither cut nor repeated.
    """
    most = tile_pairs or TILE_PAIRS
    cells = ["_cx", "_cy"]
    one, none = F.lit(1).alias("_l"), F.lit(0).alias("_l")
    sizes = spread.select(*cells, one).unionByName(fixed.select(*cells, none)).groupBy(*cells)
    sizes = sizes.agg(F.sum("_l").alias("_nl"), (F.count("*") - F.sum("_l")).alias("_nr")).filter(F.col("_nl").cast("double") * F.col("_nr") > most)
    # written once: both sides must see the same slices even if their input is computed again
    hot = durable(sizes.select(*cells, *tile_counts(F.col("_nl"), F.col("_nr"), most)))
    if hot.isEmpty():
        return spread.join(fixed, [*cells, *(on or [])]).drop(*cells)
    left, right = _tiled(spread, fixed, hot)
    return left.join(right, [*cells, "_i", "_j", *(on or [])]).drop(*cells, "_i", "_j")


def _tiled(spread: DataFrame, fixed: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tile ``_i, _j`` of each row; ``hot(_cx, _cy, _tl, _tr)`` has the slices of the cells that are cut."""

    def cut(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = side.join(hot, ["_cx", "_cy"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_tl", "_tr")})
        # the row's own partition is part of the hash, so that copies of one row spread too
        nth = F.pmod(F.xxhash64(*side.columns, F.spark_partition_id()), F.col(own)).cast("int")
        return placed.withColumn(mine, nth).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_tl", "_tr")

    return cut(spread, "_tl", "_tr", "_i", "_j"), cut(fixed, "_tr", "_tl", "_j", "_i")


def tile_counts(left: Column, right: Column, most: int) -> tuple[Column, Column]:
    """Slices ``_tl`` and ``_tr`` of a cell's two sides, such that two slices make about ``most`` pairs at most.

    A side that fits whole stays whole, and the other is cut; if neither fits, both are cut to the square root.
    """
    edge = math.isqrt(most)
    alone = F.ceil(left.cast("double") * right / most).cast("int")
    square = lambda n: F.ceil(n / edge).cast("int")
    cut_left = F.when(left <= edge, 1).when(right <= edge, alone).otherwise(square(left))
    cut_right = F.when(left <= edge, alone).when(right <= edge, 1).otherwise(square(right))
    return cut_left.alias("_tl"), cut_right.alias("_tr")


def _cover(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, step: float) -> DataFrame:
    """One row per grid cell that the box touches."""
    wide = df.withColumn("_cx", F.explode(F.sequence(cell(x0, step), cell(x1, step))))
    return wide.withColumn("_cy", F.explode(F.sequence(cell(y0, step), cell(y1, step))))


def _cover_segment(df: DataFrame, seg: str, widen: float, step: float) -> DataFrame:
    """One row per grid cell that holds a point at most ``widen`` (in each axis) from the segment.

    Column by column, the part of the segment that is near the column gives the rows, so a segment over n cells is placed
    about 2 n times and not in every cell of its box.
    """
    e, slack = F.col(seg), step * 1e-9
    reach = widen + slack
    x0, x1 = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    wide = df.withColumn("_cx", F.explode(F.sequence(cell(x0 - reach, step), cell(x1 + reach, step))))
    a = F.greatest(x0, F.col("_cx") * step - reach)
    b = F.least(x1, (F.col("_cx") + 1) * step + reach)
    slope = F.try_divide(e["y2"] - e["y1"], e["x2"] - e["x1"])
    at = lambda x: F.coalesce(e["y1"] + (x - e["x1"]) * slope, e["y1"])
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    steep = F.abs(slope) > 1e9  # as good as upright
    upright = slope.isNull() | steep
    y0 = F.when(upright, low).otherwise(F.greatest(low, F.least(at(a), at(b)) - slack))
    y1 = F.when(upright, high).otherwise(F.least(high, F.greatest(at(a), at(b)) + slack))
    return wide.withColumn("_cy", F.explode(F.sequence(cell(y0 - reach, step), cell(y1 + reach, step))))


def _reach_box(lng: Column, lat: Column, km: float) -> tuple[Column, Column, Column, Column]:
    """Longitude/latitude box that contains the haversine circle of radius ``km``."""
    dlat = km / KM_PER_DEGREE * 1.000001
    half = F.lit(math.sin(km / geo.EARTH_KM / 2.0))
    worst = F.least(F.abs(lat) + dlat, F.lit(89.0))
    dlng = F.degrees(2 * F.asin(F.least(half / F.cos(F.radians(worst)), F.lit(1.0)))) * 1.000001
    return lng - dlng, lng + dlng, lat - dlat, lat + dlat


def radius_pairs(centres: DataFrame, points: DataFrame, km: float | None = None, degrees: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Pairs of a centre ``(c_lng, c_lat, ...)`` and a point ``(lng, lat, ...)`` strictly closer than the radius.

    Centres are repeated over the cells in their reach, points stay in one cell: pass the smaller side as centres.
    ``km`` uses haversine distances and gives ``dist_m``; ``degrees`` uses planar distances and gives ``dist``.
    Columns in ``on`` must be equal too and take part in the join key.
    """
    step = (km / KM_PER_DEGREE) if km is not None else degrees
    x, y = F.col("c_lng"), F.col("c_lat")
    if km is not None:
        box = _reach_box(x, y, km)
        dist, name = geo.haversine_m(y, x, F.col("lat"), F.col("lng")), "dist_m"
        limit = km * 1000.0
    else:
        box = (x - degrees, x + degrees, y - degrees, y + degrees)
        dist, name = geo.planar_deg(F.col("lng"), F.col("lat"), x, y), "dist"
        limit = degrees
    pairs = cell_join(_cover(centres, *box, step), in_cells(points, step), on).withColumn(name, dist)
    return pairs.filter(F.col(name) < limit)


def region_sums(
    regions: DataFrame, keys: list[str], points: DataFrame, sums: list[str], step: float, box: tuple, place, hit, on: list[str] | None = None, depth: int | None = None
) -> DataFrame:
    """Parts ``(keys, on, sums)`` of the sums of ``points(lng, lat, on, sums)`` in each region; their totals per key are the region's.

    A region is covered with cells of width ``step``; ``place(x0, x1, y0, y1)`` tells whether a box lies in it (1), across its
    border (0) or apart from it (-1). A cell inside gives its own sums, a cell across the border is cut into sixteen, and
    only in the smallest cells across the border each place is tested with ``hit``. So the work of a region grows with
    its border and not with the points in it. ``depth`` is how often cells are cut; by default as often as the smallest
    ones still hold ``CELL_PLACES`` places on average. Columns in ``on`` must be equal too. Sums of whole numbers are exact.
    """
    on = on or []
    added = [F.sum(c).alias(c) for c in sums]
    places = durable(points.filter("lng is not null and lat is not null").groupBy("lng", "lat", *on).agg(*added))
    width = lambda level: step / 4**level
    at = lambda level: (cell(F.col("lng"), width(level)), cell(F.col("lat"), width(level)))
    if depth is None:
        held = places.agg(F.count("*"), *[F.approx_count_distinct(F.struct(*at(i), *on)) for i in range(1, DEPTH + 1)]).first()
        depth = max([i for i in range(1, DEPTH + 1) if held[0] >= CELL_PLACES * held[i]], default=0)
    spread = _cover(regions, *box, step)
    if depth == 0:
        return cell_join(spread, in_cells(places, step), on).filter(hit).select(*keys, *on, *sums)

    def boxed(level: int) -> Column:
        w = width(level)
        slack = w * 1e-6  # a place may round into the cell beside its own
        x, y = F.col("_cx") * w, F.col("_cy") * w
        return place(x - slack, x + w + slack, y - slack, y + w + slack)

    spread = spread.withColumns({"_lv": F.lit(0), "_in": boxed(0)}).filter("_in >= 0")
    for level in range(1, depth + 1):
        kids = [F.struct(F.lit(level).alias("_lv"), (F.col("_cx") * 4 + i).alias("_cx"), (F.col("_cy") * 4 + j).alias("_cy")) for i in range(4) for j in range(4)]
        itself = F.array(F.struct("_lv", "_cx", "_cy"))
        spread = spread.withColumn("_k", F.explode(F.when(F.col("_in") == 1, itself).otherwise(F.array(*kids))))
        spread = spread.withColumns({c: F.col("_k")[c] for c in ("_lv", "_cx", "_cy")}).drop("_k")
        spread = spread.withColumn("_in", F.when(F.col("_in") == 1, 1).otherwise(boxed(level))).filter("_in >= 0")
    cells = F.array(*[F.struct(F.lit(i).alias("_lv"), at(i)[0].alias("_cx"), at(i)[1].alias("_cy")) for i in range(depth + 1)])
    cells = places.select(*on, *sums, F.explode(cells).alias("_k")).groupBy("_k._lv", "_k._cx", "_k._cy", *on).agg(*added)
    inner = spread.filter("_in = 1").select(*keys, *on, "_lv", "_cx", "_cy").join(cells, ["_lv", "_cx", "_cy", *on])
    border = cell_join(spread.filter("_in = 0").drop("_lv", "_in"), in_cells(places, width(depth)), on).filter(hit)
    return inner.select(*keys, *on, *sums).unionByName(border.select(*keys, *on, *sums))


def close_pairs(df: DataFrame, key: str, metres: float = 600.0) -> DataFrame:
    """Unordered pairs ``(a, b)``, a < b, closer than ``metres``, with the rounded distance.

    Rows at the same place are one row with a list of at most ``PLACE_KEYS`` keys (more rows make more lists). A list
    meets those north of it (east of it on its parallel), so a distance is taken once for all pairs of two lists, behind a
    test by the box around the circle.
    """
    km = metres / 1000.0
    # the copies of a list in the cells of its reach are most of what is written: wide cells take fewer, narrow ones fewer tests
    step = CLOSE_CELL * km / KM_PER_DEGREE
    rows = df.select(F.col(key).alias("_k"), "lng", "lat").filter("_k is not null and lng is not null and lat is not null")
    hot = durable(rows.groupBy("lng", "lat").agg(F.count("*").alias("_n")).filter(F.col("_n") > PLACE_KEYS))
    part = F.lit(0)
    if not hot.isEmpty():
        rows = rows.join(hot, ["lng", "lat"], "left")
        # the row's number is part of the hash, so that copies of one key spread too
        part = F.pmod(F.xxhash64("_k", F.monotonically_increasing_id()), F.coalesce(F.ceil(F.col("_n") / PLACE_KEYS), F.lit(1)))
    lists = rows.withColumn("_part", part.cast("int")).groupBy("lng", "lat", "_part").agg(F.collect_list("_k").alias("_ks"))
    # written once, as both sides must see the same lists
    lists, _ = written(lists, "close-pairs")
    lists = lists.withColumn("_cos", F.cos(F.radians("lat")))
    x, y = F.col("c_lng"), F.col("c_lat")
    west, east, _, north = _reach_box(x, y, km)
    left = lists.select(*[F.col(c).alias(f"c_{c}") for c in lists.columns]).withColumn("_east", east)
    # merged, as a small table of lists still makes many pairs
    pairs = cell_join(_cover(left, west, F.col("_east"), y, north, step).hint("merge"), in_cells(lists, step), None, CLOSE_PAIRS)
    lng, lat = F.col("lng"), F.col("lat")
    ahead = (lat > y) | ((lat == y) & ((lng > x) | ((lng == x) & (F.col("_part") >= F.col("c__part")))))
    square = lambda c: F.pow(F.sin(F.radians(c) / 2), F.lit(2.0))
    h = square(lat - y) + F.col("c__cos") * F.col("_cos") * square(lng - x)
    dist = F.lit(2 * geo.EARTH_KM) * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))) * 1000.0
    # only near the circle the distance itself decides; inside, the test does without the arc
    inside = math.sin(min(km / geo.EARTH_KM / 2.0, math.pi / 2)) ** 2 * (1 - 1e-9)
    pairs = pairs.filter((lat <= north) & lng.between(x - (F.col("_east") - x) * (1 + 1e-9), F.col("_east")) & ahead & ((h < inside) | (dist < metres)))
    same = (lng == x) & (lat == y) & (F.col("_part") == F.col("c__part"))
    # rint is half to even, as half_even(c, 0) is, without a decimal per pair
    pairs = pairs.select("c__ks", "_ks", same.alias("_same"), F.rint(dist).cast("bigint").alias("dist_m"))
    keys = pairs.select(F.explode("c__ks").alias("_a"), "_ks", "_same", "dist_m").select("_a", F.explode("_ks").alias("_b"), "_same", "dist_m")
    keys = keys.filter(F.when(F.col("_same"), F.col("_a") < F.col("_b")).otherwise(F.col("_a") != F.col("_b")))
    return keys.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "dist_m")


def radius_search(queries: DataFrame, points: DataFrame, key: str | None, km: float = 2.0) -> DataFrame:
    """All points within ``km`` of each query point ``(query_id, lng, lat)``.

    Without ``key``, points at the same place are one row with their number ``n``.
    """
    centres = queries.select("query_id", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"))
    if key is None:
        points = points.groupBy("lng", "lat").agg(F.count("*").alias("n"))
    return radius_pairs(centres, points, km=km).select("query_id", key or "n", "dist_m")


def radius_count(anchors: DataFrame, points: DataFrame, year: str, degrees: float = 0.004, depth: int | None = None) -> DataFrame:
    """Openings around each anchor in the two years before and after its own year.

    ``anchors(anchor_id, lng, lat, year)``. The anchor itself (distance zero) does not count. Openings are counted by place
    for each year they come before or after, so an anchor meets a place once; cells wholly in its circle give
    their counts (``region_sums``, also for ``depth``), and anchors at the same place and year are searched once.
    """
    anchors = durable(anchors)  # joined by their coordinates
    lags = F.explode(F.array(*[F.lit(i) for i in (-2, -1, 1, 2)]))
    seen = points.groupBy("lng", "lat", F.col(year).alias("_y")).agg(F.count("*").alias("_c")).withColumn("_lag", lags)
    side = lambda early: F.when(early, F.col("_c")).otherwise(0)
    seen = seen.select("lng", "lat", (F.col("_y") - F.col("_lag")).alias("year"), side(F.col("_lag") < 0).alias("_before"), side(F.col("_lag") > 0).alias("_after"))
    spots = anchors.select(F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"), "year").distinct()
    x, y = F.col("c_lng"), F.col("c_lat")

    def place(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
        near = geo.planar_deg(F.least(F.greatest(x, x0), x1), F.least(F.greatest(y, y0), y1), x, y)
        far = F.sqrt(F.pow(F.greatest(x - x0, x1 - x), F.lit(2.0)) + F.pow(F.greatest(y - y0, y1 - y), F.lit(2.0)))
        return F.when(near > degrees * (1 + 1e-9), -1).when((far < degrees * (1 - 1e-9)) & (near > 1e-8), 1).otherwise(0)

    dist = geo.planar_deg(F.col("lng"), F.col("lat"), x, y)
    box = (x - degrees, x + degrees, y - degrees, y + degrees)
    parts = region_sums(spots, ["c_lng", "c_lat"], seen, ["_before", "_after"], degrees, box, place, (dist < degrees) & (dist > 1e-9), ["year"], depth)
    near = parts.groupBy("c_lng", "c_lat", "year").agg(F.sum("_before").alias("_before"), F.sum("_after").alias("_after"))
    placed = anchors.select("anchor_id", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"), "year").join(near, ["c_lng", "c_lat", "year"])
    counts = placed.groupBy("anchor_id").agg(F.sum("_before").alias("before_near"), F.sum("_after").alias("after_near"))
    return anchors.join(counts, "anchor_id", "left").fillna(0, ["before_near", "after_near"])


def _packed_nearest(points: DataFrame, anchors: DataFrame, key: str, dist) -> DataFrame:
    pack = anchors.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("lng").alias("x"), F.col("lat").alias("y"))).alias("all"))
    out = points.withColumn("_all", pack.scalar())
    best = F.array_min(F.transform("_all", lambda a: F.struct(dist(a).alias("d"), a["k"].alias("k"))))
    return out.withColumn("_best", best).withColumn("near_id", F.col("_best")["k"]).withColumn("near_dist", F.col("_best")["d"]).drop("_all", "_best")


def nearest(points: DataFrame, anchors: DataFrame, key: str, metric: str = "planar", step: float | None = None, limit: int = PACKED_LIMIT, stable: bool = False) -> DataFrame:
    """Nearest anchor of every point: adds ``near_id`` and ``near_dist`` (degrees, or km for ``haversine``).

    Ties go to the smallest key. Up to ``limit`` anchors (checked) travel as one packed value and need no
    join. More anchors use a search over rings of grid cells: level by level the cell grows fourfold, and a
    point leaves as soon as its best distance is inside the searched ring, so dense areas finish at the
    first level and only remote points go on. Without ``step`` the first cell is sized for about four anchors
    on average. Anchors at the same place are reduced to the smallest key. Results return to the points by
    their coordinates; ``stable`` promises that these come out bit-equal when computed again (a scan, not a
    floating sum), otherwise the points are written first.
    """
    anchors = anchors.groupBy("lng", "lat").agg(F.min(key).alias(key))
    if metric == "haversine":

        def dist(a):
            return geo.haversine_km(F.col("lat"), F.col("lng"), a["y"], a["x"])
    else:

        def dist(a):
            return geo.planar_deg(F.col("lng"), F.col("lat"), a["x"], a["y"])

    if anchors.limit(limit + 1).count() <= limit:
        return _packed_nearest(points, anchors, key, dist)

    points = points if stable else durable(points)
    found = _ring_search(points.select("lng", "lat").filter("lng is not null and lat is not null").distinct(), anchors, key, dist, metric, step)
    return points.join(found, ["lng", "lat"], "left").select(*points.columns, "near_id", "near_dist")


def _ring_search(places: DataFrame, anchors: DataFrame, key: str, dist, metric: str, step: float | None) -> DataFrame:
    """Nearest anchor of every distinct place, ring by ring; equal places are searched once."""
    todo = durable(places)
    sites = durable(anchors.select(F.col(key).alias("_k"), F.col("lng").alias("_ax"), F.col("lat").alias("_ay")))
    n_sites = sites.count()
    box = lambda df, x, y: df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    here, there = box(todo, "lng", "lat").first(), box(sites, "_ax", "_ay").first()
    if n_sites == 0 or here["x0"] is None:
        kind = anchors.schema[key].dataType
        return todo.withColumn("near_id", F.lit(None).cast(kind)).withColumn("near_dist", F.lit(None).cast("double"))
    if step is None:
        room = max(there["x1"] - there["x0"], 1e-6) * max(there["y1"] - there["y0"], 1e-6)
        step = max(2.0 * math.sqrt(room / n_sites), 1e-5)
    wide_x = max(here["x1"], there["x1"]) - min(here["x0"], there["x0"])
    wide_y = max(here["y1"], there["y1"]) - min(here["y0"], there["y0"])
    extent = max(wide_x, wide_y) + step
    site = F.struct(F.col("_ax").alias("x"), F.col("_ay").alias("y"))
    blocks = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    done, size = None, step
    while True:
        last = size >= extent
        spots, placed = in_cells(todo, size), in_cells(sites, size, "_ax", "_ay")
        # the smaller side goes to all nine cells of its block
        few_sites = n_sites <= todo.count()
        wide = (placed if few_sites else spots).withColumn("_m", F.explode(blocks))
        wide = wide.withColumn("_cx", F.col("_cx") + F.col("_m")["dx"]).withColumn("_cy", F.col("_cy") + F.col("_m")["dy"]).drop("_m")
        hits = (cell_join(wide, spots) if few_sites else cell_join(wide, placed)).withColumn("_d", dist(site))
        best = hits.groupBy("lng", "lat").agg(F.min(F.struct("_d", "_k")).alias("_best"))
        # inside the block every unseen anchor is at least one cell away
        safe = F.lit(size) if metric != "haversine" else F.lit(size * KM_PER_DEGREE) * F.cos(
            F.radians(F.least(F.abs(F.col("lat")) + 2 * size, F.lit(89.0)))
        )
        near_enough = F.col("_best").isNotNull() & (F.lit(last) | (F.col("_best")["_d"] <= safe))
        seen = durable(todo.join(best, ["lng", "lat"], "left").withColumn("_found", F.coalesce(near_enough, F.lit(False))))
        solved = seen.filter("_found").select("lng", "lat", F.col("_best")["_k"].alias("near_id"), F.col("_best")["_d"].alias("near_dist"))
        done = solved if done is None else done.unionByName(solved)
        todo = seen.filter("not _found").select("lng", "lat")
        if last or todo.isEmpty():
            return done
        size *= 4


def nearest_within(points: DataFrame, anchors: DataFrame, key: str, km: float, metric: str = "haversine", stable: bool = False) -> DataFrame:
    """Nearest anchor only when it is at most ``km`` away; planar uses 111 km per degree, cosine at the point.

    Anchors are repeated over the cells in their reach, so points farther than ``km`` from all of them cost
    nothing, and equal places are searched once. One aggregate keeps the best candidate of each place.
    ``stable`` as in ``nearest``.
    """
    points = points if stable else durable(points)
    sites = anchors.groupBy(F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat")).agg(F.min(key).alias("_k"))
    spots = points.select("lng", "lat").distinct()
    if metric == "haversine":
        pairs = radius_pairs(sites, spots, km=km * (1 + 1e-12)).withColumn("_d", F.col("dist_m") / 1000.0)
    else:
        step = km / 111.0
        # the cosine belongs to the point, whose latitude is at most one step from the anchor's
        reach = F.lit(step) / F.cos(F.radians(F.least(F.abs(F.col("c_lat")) + step, F.lit(89.0))))
        cover = _cover(sites, F.col("c_lng") - reach, F.col("c_lng") + reach, F.col("c_lat") - step, F.col("c_lat") + step, step)
        pairs = cell_join(cover, in_cells(spots, step)).withColumn("_d", geo.planar_km(F.col("c_lng"), F.col("c_lat"), F.col("lng"), F.col("lat")))
    best = pairs.filter(F.col("_d") <= km).groupBy("lng", "lat").agg(F.min(F.struct("_d", "_k")).alias("_best"))
    out = points.join(best, ["lng", "lat"], "left")
    return out.select(*points.columns, F.col("_best")["_k"].alias("near_id"), F.col("_best")["_d"].alias("near_dist"))


def coverage_gaps(cells: DataFrame, branches: DataFrame, km: float = 1.2, n: int = 5) -> DataFrame:
    """Top ``n`` demand cells ``(cell_id, lng, lat, demand)`` farther than ``km`` from every branch.

    A cell is covered when a radius join finds a branch; only the top uncovered cells need their exact
    distance to the network.
    """
    sites = branches.select("lng", "lat").distinct()
    centres = cells.select("cell_id", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"))
    # inclusive radius: a cell at exactly km counts as covered
    covered = radius_pairs(centres, sites, km=km * (1 + 1e-12)).select("cell_id").distinct()
    gaps = cells.join(covered, "cell_id", "left_anti").orderBy(F.col("demand").desc(), "cell_id").limit(n)
    keyed = sites.withColumn("_site", F.concat_ws(",", "lng", "lat"))
    out = nearest(gaps, keyed, "_site", metric="haversine")
    return out.withColumn("network_km", half_even(F.col("near_dist"), 2)).drop("near_id", "near_dist")


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, step: float, sums: list[str] | None = None, on: list[str] | None = None, depth: int | None = None, each: bool = False
) -> DataFrame:
    """Points ``(lng, lat, ...)`` joined with the polygons ``(poly_id, rings)`` that contain them.

    With ``sums``, the pairs are not listed: the rows ``(poly_id, on, sums)`` are parts of the sums of these columns over
    the points in a polygon, a part for each place or whole cell (``region_sums``, also for ``on`` and ``depth``). With
    ``each``, no cell stands for the places in it: the ray is cast for every place and polygon (``_ray_sums``).
    """
    boxed = polygons.select("poly_id", *(on or []), geo.ray_edges(F.col("rings")).alias("_e"), geo.bbox(F.col("rings")).alias("_b"), *([] if sums is None else [_borders()]))
    b = F.col("_b")
    box = (b["x0"], b["x1"], b["y0"], b["y1"])
    in_box = F.col("lng").between(b["x0"], b["x1"]) & F.col("lat").between(b["y0"], b["y1"])
    inside = geo.inside_edges(F.col("_e"), F.col("lng"), F.col("lat"))
    if sums is None:
        pairs = cell_join(_cover(boxed, *box, step), in_cells(points, step), on)
        return pairs.filter(in_box).filter(inside).drop("_b", "_e")
    if each:
        if on:
            raise ValueError("each has no columns on")
        return _ray_sums(_cover(boxed.select("poly_id", "_e", "_b.*"), *[F.col(c) for c in ("x0", "x1", "y0", "y1")], step), points, sums, step)

    def place(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
        away = (x1 < b["x0"]) | (x0 > b["x1"]) | (y1 < b["y0"]) | (y0 > b["y1"])
        crossed = F.exists("_s", lambda e: geo.segment_meets_box(e, x0, x1, y0, y1))
        middle = geo.inside_edges(F.col("_e"), (x0 + x1) / 2, (y0 + y1) / 2)
        # a ring that is not closed or lacks a vertex has no border around it, so each place is tested
        return F.when(away, -1).when(F.coalesce(F.col("_s").isNull() | crossed, F.lit(True)), 0).when(middle, 1).otherwise(-1)

    return region_sums(boxed, ["poly_id"], points, sums, step, box, place, in_box & inside, on, depth)


def _ray_sums(spread: DataFrame, points: DataFrame, sums: list[str], step: float) -> DataFrame:
    """Parts ``(poly_id, sums)`` of the sums over the places in each polygon, one for each polygon and cell that has any.

    ``spread(_cx, _cy, poly_id, _e, x0, x1, y0, y1)`` has the prepared edges of a polygon in each cell of its box. Both sides are
    dealt by cell and sorted, polygons first, so a task holds the polygons of one cell as arrays while the cell's places run
    past them; each place is tested against each of them by its box and the ray's crossings. Cells with more than ``RAY_EDGES``
    edges or ``RAY_PLACES`` places are cut into tiles.
    """
    places = in_cells(points.filter("lng is not null and lat is not null").groupBy("lng", "lat").agg(*[F.sum(c).alias(c) for c in sums]), step)
    cells, none = ["_cx", "_cy"], F.lit(0)
    weights = spread.select(*cells, F.size("_e").alias("_nl"), none.alias("_nr")).unionByName(places.select(*cells, none.alias("_nl"), F.lit(1).alias("_nr")))
    slices = lambda c, most: F.ceil(F.sum(c) / most)
    weights = weights.groupBy(*cells).agg(slices("_nl", RAY_EDGES).alias("_tl"), slices("_nr", RAY_PLACES).alias("_tr"))
    hot = durable(weights.filter("(_tl > 1 or _tr > 1) and _tl > 0 and _tr > 0").select(*cells, *[F.col(c).cast("int").alias(c) for c in ("_tl", "_tr")]))
    if hot.isEmpty():
        left, right = (side.withColumns({"_i": none, "_j": none}) for side in (spread, places))
    else:
        left, right = _tiled(spread, places, hot)
    tile = [*cells, "_i", "_j"]
    rows = left.withColumn("_point", F.lit(False)).unionByName(right.withColumn("_point", F.lit(True)), allowMissingColumns=True)
    # in so many parts, as the work lies in the tests and not in the bytes
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *tile).sortWithinPartitions(*tile, "_point").select(*tile, "_point", "poly_id", "_e", "x0", "x1", "y0", "y1", "lng", "lat", *sums)
    schema = T.StructType([spread.schema["poly_id"], *[places.schema[c] for c in sums]])
    strip = RAY_STRIP

    def read(batches):
        at, shapes, held = None, [], None  # the tile, its polygons' pieces, and those as arrays with their sums
        for batch in batches:
            keys = [batch[c].to_numpy() for c in tile]
            point = batch["_point"].to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
            begin = 0
            for end in ends:
                key = tuple(k[begin].item() for k in keys)
                if key != at:
                    if held is not None:
                        yield from held.parts()
                    at, shapes, held = key, [], None
                middle = begin + int(np.count_nonzero(~point[begin:end]))
                if middle > begin:
                    shapes.append(batch.slice(begin, middle - begin))
                if end > middle and shapes:
                    held = _Rays(shapes, sums) if held is None else held
                    yield from held.add(batch.slice(middle, end - middle), strip)
                begin = end
        if held is not None:
            yield from held.parts()

    return rows.mapInArrow(read, schema)


class _Rays:
    """The polygons of a cell as arrays of edges, and the sums over the places found in each of them."""

    def __init__(self, batches: list, sums: list[str]):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda c: pa.concat_arrays(table[c].chunks)
        self.sums, self.ids, edges = sums, column("poly_id"), column("_e")
        self.box = [column(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1", "y0", "y1")]
        count = np.nan_to_num(edges.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        some = np.flatnonzero(count)  # a geometry without edges holds nothing
        self.ids, self.box, count = self.ids.take(pa.array(some)), [b[some, None] for b in self.box], count[some]
        self.starts = np.cumsum(count) - count
        fields = edges.flatten()
        part = dict(zip([f.name for f in fields.type], fields.flatten()))
        self.x, self.y1, self.y2, self.k = (part[c].cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None] for c in ("x", "y1", "y2", "k"))
        self.clear()

    def clear(self) -> None:
        self.found = np.zeros(len(self.starts), bool)
        self.known = [self.found.copy() for _ in self.sums]
        self.total = [None] * len(self.sums)
        self.size = 0.0  # bound of the whole numbers' sums

    def add(self, places, strip: int):
        """Tests all places; gives parts of the sums before they could leave 64 bits."""
        if not len(self.starts):
            return
        x, y = (places[c].to_numpy() for c in ("lng", "lat"))
        valid = [places[c].is_valid().to_numpy(zero_copy_only=False) for c in self.sums]
        values = [places[c].fill_null(0).to_numpy() for c in self.sums]
        each = max(1, strip // len(self.x))
        for i in range(0, len(x), each):
            to = slice(i, i + each)
            size = max([float(np.abs(v[to].astype(np.float64)).sum()) for v in values if v.dtype.kind == "i"], default=0.0)
            if size > 2.0**62 and len(x[to]) > 1:
                for k in range(i, i + len(x[to])):
                    yield from self.add(places.slice(k, 1), strip)
                continue
            if self.size + size > 2.0**62:
                yield from self.parts()
                self.clear()
            self.size += size
            inside = self.inside(x[to], y[to])
            self.found |= inside.any(axis=1)
            for j, (v, ok) in enumerate(zip(values, valid)):
                got = np.where(inside, v[to], v.dtype.type(0)).sum(axis=1)
                self.total[j] = got if self.total[j] is None else self.total[j] + got
                self.known[j] |= inside.any(axis=1) if ok[to].all() else (inside & ok[to]).any(axis=1)

    def inside(self, x, y):
        """Even-odd rule, as ``geo.inside_edges`` has it, for each polygon and place, and within the polygon's box."""
        crossed = ((self.y1 > y) != (self.y2 > y)) & (x < self.x + (y - self.y1) * self.k)
        odd = np.bitwise_xor.reduceat(crossed, self.starts, axis=0)
        x0, x1, y0, y1 = self.box
        return odd & (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)

    def parts(self):
        if self.found.any():
            some = np.flatnonzero(self.found)
            got = [pa.array(t[some], mask=~ok[some]) for t, ok in zip(self.total, self.known)]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(some)), *got], names=["poly_id", *self.sums])


def _borders() -> Column:
    """All edges of a geometry as ``_s``, null where a ring is not closed or lacks a vertex."""
    whole = lambda p: p.isNotNull() & p["lng"].isNotNull() & p["lat"].isNotNull()
    sound = F.forall("rings", lambda g: F.forall(g, whole) & (F.get(g, F.lit(0)) == F.get(g, F.size(g) - 1)))
    return F.when(sound, F.flatten(F.transform("rings", geo.edges))).alias("_s")


def polygon_adjacency(shapes: DataFrame, tolerance: float, key: str = "cell_id", closed: bool = True, counted: bool = False) -> DataFrame:
    """Directed edges ``(src, dst)`` between shapes at most ``tolerance`` degrees apart.

    Shapes with equal rings are a class; classes are compared (``_class_edges``), and their edges hold for all members, which
    are neighbours of each other too. With ``counted`` neighbours are not listed: the rows ``(src, n)`` are parts of the
    number of a shape's neighbours, one for each adjacent class.
    """
    rows = shapes.filter(F.col(key).isNotNull() & F.col("rings").isNotNull()).select(F.col(key).alias("id"), "rings").distinct()
    classes = durable(rows.groupBy("rings").agg(F.count("*").alias("_n")).withColumn("_g", F.monotonically_increasing_id()))
    members = durable(rows.join(classes, "rings").select("id", "_g", "_n"))
    edges = _class_edges(classes.select("_g", "rings"), tolerance, "_g", closed)
    e = F.flatten(F.transform("rings", geo.edges))
    alone = classes.filter("_n > 1").filter(F.exists(e, lambda s: geo.segment_gap_sq(s, s) <= tolerance * tolerance))
    edges = durable(edges.unionByName(alone.select(F.col("_g").alias("src"), F.col("_g").alias("dst"))))
    mine = members.select(F.col("id").alias("src"), F.col("_g").alias("_a")).join(edges.toDF("_a", "_b"), "_a")
    once_each = members.groupBy("id").count().filter("count > 1").isEmpty()
    if counted and once_each:
        sizes = classes.select(F.col("_g").alias("_b"), "_n")
        return mine.join(sizes, "_b").select("src", (F.col("_n") - (F.col("_a") == F.col("_b")).cast("bigint")).alias("n"))
    pairs = mine.join(members.select(F.col("id").alias("dst"), F.col("_g").alias("_b")), "_b").filter("src <> dst").select("src", "dst")
    pairs = pairs if once_each else pairs.distinct()  # a shape of several rows is in several classes
    return pairs.select("src", F.lit(1).cast("bigint").alias("n")) if counted else pairs


def _class_edges(shapes: DataFrame, tolerance: float, key: str, closed: bool) -> DataFrame:
    """Directed edges between different shapes at most ``tolerance`` degrees apart.

    Shapes are split into edges; an edge is placed in the cells it crosses, on one side widened by the tolerance, and
    candidate edge pairs meet in a cell, boxes before the exact segment distance. With ``closed`` a shape that contains a
    vertex of another one is adjacent too.
    """
    step = max(tolerance * 3, 1e-6)
    segs = shapes.select(F.col(key).alias("id"), F.explode(F.flatten(F.transform("rings", geo.edges))).alias("s"))

    def placed(name: str, seg: str, widen: float) -> DataFrame:
        return _cover_segment(segs.select(F.col("id").alias(name), F.col("s").alias(seg)), seg, widen, step)

    pairs = cell_join(placed("src", "a", tolerance), placed("dst", "b", 0.0))
    a, b = F.col("a"), F.col("b")
    apart = lambda u, v: F.greatest(F.least(a[u], a[v]), F.least(b[u], b[v])) - F.least(F.greatest(a[u], a[v]), F.greatest(b[u], b[v]))
    half = (
        pairs.filter((F.col("src") < F.col("dst")) & (apart("x1", "x2") <= tolerance) & (apart("y1", "y2") <= tolerance))
        .filter(geo.segment_gap_sq(a, b) <= tolerance * tolerance)
        .select("src", "dst")
        .distinct()
    )
    touching = half.withColumn("_p", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).select("_p.*")
    if not closed:
        return touching
    probe = shapes.select(F.col(key).alias("inner_id"), F.col("rings")[0][0]["lng"].alias("lng"), F.col("rings")[0][0]["lat"].alias("lat"))
    held = points_in_polygons(probe, shapes.select(F.col(key).alias("poly_id"), "rings"), step=max(step, 0.25)).filter(
        F.col("inner_id") != F.col("poly_id")
    )
    both = held.select(F.col("inner_id").alias("src"), F.col("poly_id").alias("dst")).unionByName(
        held.select(F.col("poly_id").alias("src"), F.col("inner_id").alias("dst"))
    )
    return touching.unionByName(both).distinct()


def grid_edges(cells: DataFrame, key: str = "cell_id") -> DataFrame:
    """Queen neighbours of cells on integer coordinates ``gx, gy``: directed edges, no self edge."""
    moves = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    probes = cells.select(F.col(key).alias("src"), "gx", "gy", F.explode(moves).alias("m")).select(
        "src", (F.col("gx") + F.col("m")["dx"]).alias("gx"), (F.col("gy") + F.col("m")["dy"]).alias("gy")
    )
    return probes.join(cells.select(F.col(key).alias("dst"), "gx", "gy"), ["gx", "gy"]).select("src", "dst")


def degrees_of(cells: DataFrame, edges: DataFrame, key: str = "cell_id") -> DataFrame:
    """Neighbour count of every cell, at least 1; ``edges`` are listed, or counted in parts ``n``."""
    counts = edges.groupBy(F.col("src").alias(key)).agg((F.sum("n") if "n" in edges.columns else F.count("*")).alias("degree"))
    return cells.select(key).join(counts, key, "left").select(key, F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)).cast("bigint").alias("degree"))


def queen_sum(cells: DataFrame, measures: list[str], include_self: bool = True, suffix: str = "_around") -> DataFrame:
    """Sum of measures over the 3x3 block around every cell ``(gx, gy)``.

    Each cell sends its values to its nine neighbours, so one aggregation with map-side combine and one
    equi-join replace a neighbour scan.
    """
    moves = F.array(
        *[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if include_self or i or j]
    )
    sent = cells.select("gx", "gy", *measures, F.explode(moves).alias("_m")).select(
        (F.col("gx") + F.col("_m")["dx"]).alias("gx"), (F.col("gy") + F.col("_m")["dy"]).alias("gy"), *measures
    )
    around = sent.groupBy("gx", "gy").agg(*[F.sum(m).alias(m + suffix) for m in measures])
    return cells.join(around, ["gx", "gy"], "left").fillna(0, [m + suffix for m in measures])


def inverse_distance_mean(zones: DataFrame, key: str, value: str, floor_km: float = 50.0, block: int = 500, by: list[str] | None = None) -> DataFrame:
    """Mean of the other zones' values, weighted by 1 / max(distance, ``floor_km``), per key (and ``by``).

    The kernel is dense, yet no pair row is produced: zones are packed into blocks of about ``block``
    entries (``DENSE_BLOCK`` if there would be more than ``MANY_BLOCKS``), two blocks meet through an equi-join on the block number,
    and the partial sums of each zone over a block are added. Up to one block the sums are one expression; more are worked out as
    arrays, a strip of the kernel at a time. Memory per row stays at two blocks for any number of zones.
    """
    by = by or []
    n = zones.select(key).distinct().count()
    blocks = max(1, math.ceil(n / block))
    if blocks > MANY_BLOCKS:
        blocks = max(MANY_BLOCKS, math.ceil(n / max(block, DENSE_BLOCK)))
    slot = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    entry = F.struct(F.col(key).alias("k"), "lng", "lat", F.col(value).alias("v"))
    if blocks > 1:
        packed = lambda b, name: zones.groupBy(*by, slot.alias(b)).agg(F.collect_list(entry).alias(name))
        probes = packed("_a", "_ps").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        part = probes.join(packed("_b", "_zs"), [*by, "_b"])
        sums = _kernel_sums(part.repartition(*by, "_a", "_b"), floor_km)
        part = sums.select(*by, F.explode(F.arrays_zip(F.transform("_ps", lambda p: p["k"]).alias("k"), "w", "wv")).alias("_s")).select(*by, F.col("_s.k").alias(key), "_s")
    else:
        part = _block_sums(zones, key, value, floor_km, slot, entry, by)
    return part.groupBy(*by, key).agg((F.sum(F.col("_s")["wv"]) / F.sum(F.col("_s")["w"])).alias(f"{value}_near"))


def _block_sums(zones: DataFrame, key: str, value: str, floor_km: float, slot: Column, entry: Column, by: list[str]) -> DataFrame:
    """Sums over a single block of zones."""
    packs = zones.groupBy(*by, slot.alias("_b")).agg(F.collect_list(entry).alias("_zs"))
    probes = zones.withColumn("_b", F.lit(0))

    def weight(z: Column) -> Column:
        return F.lit(1.0) / F.greatest(geo.haversine_km(F.col("lat"), F.col("lng"), z["lat"], z["lng"]), F.lit(floor_km))

    weighted = F.transform(
        F.filter("_zs", lambda z: z["k"] != F.col(key)), lambda z: F.struct(weight(z).alias("w"), z["v"].alias("v"))
    )
    sums = F.aggregate(
        weighted,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wv")),
        lambda s, z: F.struct((s["w"] + z["w"]).alias("w"), (s["wv"] + z["w"] * z["v"]).alias("wv")),
    )
    return probes.join(packs, [*by, "_b"]).select(*by, key, sums.alias("_s"))


def _kernel_sums(pairs: DataFrame, floor_km: float) -> DataFrame:
    """Per pair of blocks ``(_a, _ps, _b, _zs)`` the sums ``w`` and ``wv`` of the zones in ``_ps`` over those in ``_zs``."""
    radius, strip = 2 * geo.EARTH_KM, KERNEL_STRIP

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one pair of blocks at a time
                row = batch.slice(i, 1)
                w, wv = _kernel(row["_ps"].flatten(), row["_zs"].flatten(), row["_a"][0].as_py() == row["_b"][0].as_py(), floor_km, radius, strip)
                got = [pa.array([x], pa.list_(pa.float64())) for x in (w, wv)]
                yield pa.RecordBatch.from_arrays([*row.columns[: len(keep)], *got], names=[*keep, "w", "wv"])

    keep = [c for c in pairs.columns if c not in ("_a", "_b", "_zs")]
    schema = T.StructType([*[pairs.schema[c] for c in keep], T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("wv", T.ArrayType(T.DoubleType()))])
    return pairs.select(*keep, "_a", "_b", "_zs").mapInArrow(read, schema)


def _kernel(probes, zones, same: bool, floor_km: float, radius: float, strip: int):
    """Sums of weights and of weighted values over ``zones`` for each of ``probes`` (Arrow struct arrays k, lng, lat, v)."""
    column = lambda a, name: a.flatten()[a.type.get_field_index(name)]
    numbers = lambda a, name: column(a, name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    lat1, lng1 = (np.radians(numbers(probes, c)) for c in ("lat", "lng"))
    known = column(zones, "k").is_valid().to_numpy(zero_copy_only=False)  # a zone without a key counts nowhere
    lat2, lng2, v = np.radians(numbers(zones, "lat"))[known], np.radians(numbers(zones, "lng"))[known], numbers(zones, "v")[known]
    if same:  # equal keys have equal hashes, so they are in the same block only
        ids = {}
        own = [ids.setdefault(k, len(ids)) if k is not None else -1 for k in column(probes, "k").to_pylist()]
        own, other = np.array(own), np.array([ids.get(k, -2) for k in column(zones, "k").to_pylist() if k is not None])
    counted = ~np.isnan(v)
    w, wv = np.zeros(len(lat1)), np.zeros(len(lat1))
    unkeyed = ~column(probes, "k").is_valid().to_numpy(zero_copy_only=False)
    for at in range(0, len(lat1), strip):
        to = slice(at, at + strip)
        h = np.sin((lat2 - lat1[to, None]) / 2) ** 2 + np.cos(lat1[to, None]) * np.cos(lat2) * np.sin((lng2 - lng1[to, None]) / 2) ** 2
        km = radius * np.arcsin(np.sqrt(np.clip(np.nan_to_num(h), 0.0, 1.0)))  # without a place: the least distance
        weight = 1.0 / np.maximum(km, floor_km)
        if same:
            weight[own[to, None] == other] = 0.0
        weight[unkeyed[to]] = 0.0
        w[to], wv[to] = weight.sum(axis=1), weight[:, counted] @ v[counted]
    return w, wv


def gravity_flows(units: DataFrame, key: str, mass: str, rate: str, sources: int = 6, targets: int = 20, exponent: float = 1.2, offset: float = 0.1) -> DataFrame:
    """Capital flows: each of the fastest ``targets`` units is fed by the heaviest pull among ``sources``.

    The sources are the ``sources`` largest masses (a fixed small list packed into one value), the targets the
    fastest other units; pull = mass / (distance + offset) ** exponent.
    """
    heavy = units.orderBy(F.col(mass).desc(), key).limit(sources)
    rest = units.join(F.broadcast(heavy.select(key)), key, "left_anti").orderBy(F.col(rate).desc(), key).limit(targets)
    pack = heavy.agg(F.collect_list(F.struct(F.col(key).alias("k"), "lng", "lat", F.col(mass).alias("m"))).alias("s"))
    top = units.agg(F.max(rate)).scalar()
    pull = lambda s: s["m"] / F.pow(geo.planar_deg(F.col("lng"), F.col("lat"), s["lng"], s["lat"]) + offset, F.lit(exponent))
    best = F.array_min(F.transform("_s", lambda s: F.struct((-pull(s)).alias("p"), s["k"].alias("k"))))
    return (
        rest.withColumn("_s", pack.scalar())
        .withColumn("_top", top)
        .select(
            F.col(key).alias("target"),
            best["k"].alias("source"),
            (-best["p"]).alias("pull"),
            (F.col(rate) / (F.col("_top") + 1e-9)).alias("intensity"),
        )
    )


def calibrate_to_anchors(cells: DataFrame, price: str, anchors: DataFrame, reach: float = 0.03, sigma: float = 0.011, pull: float = 0.6) -> DataFrame:
    """Scale modelled prices to observed anchors, then pull each cell towards every anchor in anchor order.

    ``anchors(anchor_no, lng, lat, price_m2)``; the fold over anchors is sequential and its order matters, so
    anchors are applied by ``anchor_no``. Up to ``PACKED_ANCHORS`` anchors travel as one value and are folded in every cell. More
    are joined to the cells within ``REACH_SIGMAS`` sigma, beyond which a pull is below a float's last digit, and folded per
    ``(cell_id, block of anchors)`` and then over the blocks: a pull maps p to m * p + c, and such maps compose.
    """
    centres = anchors.select("anchor_no", "price_m2", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"))
    near = (
        radius_pairs(centres, cells.select("cell_id", "lng", "lat", F.col(price).alias("_p")), degrees=reach)
        .groupBy("anchor_no", "price_m2")
        .agg(F.min(F.struct("dist", "cell_id", "_p")).alias("_b"))
    )
    ratio = durable(near.filter(F.col("_b")["_p"] > 0).select((F.col("price_m2") / F.col("_b")["_p"]).alias("r")))
    factor = exact_quantile(ratio, [], "r", 0.5, "factor").select("factor").scalar()
    out = cells.withColumn("_f", factor)
    scaled = F.col(price) * F.col("_f")
    if anchors.count() <= PACKED_ANCHORS:
        pack = anchors.agg(F.sort_array(F.collect_list(F.struct("anchor_no", "lng", "lat", "price_m2"))).alias("a"))

        def towards(p: Column, a: Column) -> Column:
            w = geo.gaussian(geo.planar_sq(F.col("lng"), F.col("lat"), a["lng"], a["lat"]), sigma) * pull
            return p * (F.lit(1.0) - w) + a["price_m2"] * w

        out = out.withColumn("_a", pack.scalar())
        folded = F.aggregate("_a", scaled, towards)
    else:
        out = out.join(_pulls(cells, anchors, sigma, pull), "cell_id", "left")
        folded = F.coalesce(F.aggregate("_a", scaled, lambda p, z: z["m"] * p + z["c"]), scaled)
    return out.withColumn("calibrated", F.when(F.col("_f").isNotNull(), half_even(folded)).otherwise(F.col(price))).drop("_f", "_a")


def _pulls(cells: DataFrame, anchors: DataFrame, sigma: float, pull: float) -> DataFrame:
    """``cell_id, _a``: the maps ``p -> m * p + c`` of the anchors near a cell, composed per block of anchors, in order."""
    spots = ordered_positions(anchors.select("anchor_no", "lng", "lat", "price_m2"), ["anchor_no", "lng", "lat", "price_m2"])
    block = F.floor(F.col("position") / PACKED_ANCHORS).alias("_k")
    centres = spots.select("position", block, "price_m2", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"))
    pairs = radius_pairs(centres, cells.select("cell_id", "lng", "lat"), degrees=REACH_SIGMAS * sigma)
    w = geo.gaussian(geo.planar_sq(F.col("lng"), F.col("lat"), F.col("c_lng"), F.col("c_lat")), sigma) * pull
    lists = pairs.groupBy("cell_id", "_k").agg(F.sort_array(F.collect_list(F.struct("position", w.alias("w"), "price_m2"))).alias("_l"))
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("c"))

    def then(z: Column, a: Column) -> Column:
        rest = F.lit(1.0) - a["w"]
        return F.struct((z["m"] * rest).alias("m"), (z["c"] * rest + a["price_m2"] * a["w"]).alias("c"))

    maps = lists.select("cell_id", "_k", F.aggregate("_l", start, then).alias("_z"))
    return maps.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("_k", "_z.m", "_z.c"))).alias("_a"))


def k_nearest(centres: DataFrame, points: DataFrame, key: str, k: int, degrees: float) -> DataFrame:
    """The ``k`` nearest points (planar degrees) of each centre ``(anchor_id, c_lng, c_lat)``.

    The search radius grows fourfold until it holds ``k`` points or the whole extent; centres that are done
    leave the search, so no centre is paired with all points.
    """
    box = points.agg(F.min("lng"), F.max("lng"), F.min("lat"), F.max("lat")).first()
    cen = centres.agg(F.min("c_lng"), F.max("c_lng"), F.min("c_lat"), F.max("c_lat")).first()
    if box[0] is None or cen[0] is None:
        near = radius_pairs(centres, points, degrees=degrees)
        return near.select("anchor_id", key, "dist").withColumn("near_rank", F.lit(1))
    reach = math.hypot(max(box[1], cen[1]) - min(box[0], cen[0]), max(box[3], cen[3]) - min(box[2], cen[2]))
    todo, out, radius = centres, None, degrees
    while True:
        last = radius > reach
        pairs = radius_pairs(todo, points, degrees=radius).select("anchor_id", key, "dist")
        ranked = durable(top_n_per_group(pairs, ["anchor_id"], ["dist", key], k, rank="near_rank"))
        full = ranked.groupBy("anchor_id").agg(F.count("*").alias("_n")).filter(F.lit(last) | (F.col("_n") >= k)).select("anchor_id")
        part = ranked.join(full, "anchor_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        if last:
            return out
        todo = todo.join(full, "anchor_id", "left_anti")
        if todo.isEmpty():
            return out
        radius *= 4


def anchor_top3(anchors: DataFrame, units: DataFrame, key: str, rate: str, degrees: float = 0.024, n: int = 3, fallback: int = 8) -> DataFrame:
    """Per anchor ``(anchor_id, lng, lat)`` the ``n`` fastest units nearby, else among the ``fallback`` nearest."""
    centres = anchors.select("anchor_id", F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"))
    spots = units.select(key, rate, "lng", "lat")
    near = durable(radius_pairs(centres, spots, degrees=degrees).select("anchor_id", key, rate))
    lonely = centres.join(near.select("anchor_id").distinct(), "anchor_id", "left_anti")
    far = k_nearest(lonely, spots, key, fallback, degrees).join(units.select(key, rate), key)
    both = near.unionByName(far.select("anchor_id", key, rate))
    return top_n_per_group(both, ["anchor_id"], [F.col(rate).desc(), F.col(key)], n)


def site_scores(cells: DataFrame, minimum: int = 8, weight: float = 1.2) -> DataFrame:
    """Unmet demand per cell with ``n`` businesses: scaled ``ln(1 + demand) / (1 + 1.2 * competitors)``."""
    dense = cells.filter(F.col("n") >= minimum)
    raw = F.log1p(F.col("demand").cast("double")) / (F.lit(1.0) + F.lit(weight) * F.col("competitors"))
    return add_min_max(dense, {"score": raw})
