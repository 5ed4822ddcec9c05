"""Share cuts over a spatial grid: pairs that cannot pass are never made.

A share cut keeps a (store, postal code) pair when its attraction is more than
``min_share`` of the postal code's total.  Full attraction tables make every
pair, sort them and drop nearly all.  Here the stores lie in grid cells:

1. **Totals.**  Blocks of neighbouring postal codes meet blocks of stores
   (position and mass alone) and are summed by array arithmetic; no pair
   becomes a row.  All pairs are counted, but only those close together one
   by one (``operators.nearfar``).
2. **Cells.**  A postal code meets the largest cells of the provinces it is
   reached from, then the parts of those that remain, level by level.
   ``largest mass of the cell / smallest possible distance ** 2`` is an upper
   bound for every store of the cell; a cell whose bound is below the cut is
   left out whole.  The smallest cells are split by octaves of mass as well.
3. **Stores.**  Only stores of the remaining smallest cells are paired and
   checked, so the pairs made follow the pairs kept.

What passes is the strongest end of a postal code's stores, so the running
share of a kept row follows from the kept rows and the total: all that is not
kept is weaker.  At most ``1 / min_share`` rows of a postal code are left for
the windows.

Layout: postal codes are dealt by ranges of province and place, with an
explicit count, for the totals and the first levels of cells;
stores and cells are broadcast after a measured size check.  The cells that
remain are dealt by POSTALCODE before the last level (few rows a code), and
there is no exchange after that.  Beyond the check the same steps join by
shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.geo import EARTH_RADIUS_KM, gravity, haversine_km
from ..plans.layout import broadcast_max_bytes, fits_broadcast, maybe_broadcast, shuffle_partitions
from .adjacency import REACHABLE_PROVINCES, adjacency
from .attraction import RUNNING_TIEBREAK, by_postal, layout_postal
from .nearfar import inverse_haversine_sums

#: Side of a grid cell in degrees; a side of a smallest cell is that over ``2 ** FINE_BITS``.
CELL_DEGREES = 2.0
FINE_BITS = 4
#: Levels of cells, as the power of two of smallest cells a side.
LEVEL_BITS = (5, 3, 0)
#: Level after which the rows are dealt anew.
DEALT_BITS = 3
#: Bounds are widened by this, for the rounding of the bound itself.
MARGIN = 1e-9
#: Postal codes and stores of a block.
CODE_BLOCK, STORE_BLOCK = 4096, 32768
#: Haversine (about 1 km) below which distances are taken from the angles.
NEAR = 1e-8
#: Haversine (an angle of 60 degrees) up to which the pull is split in ``1 / haversine`` and a smooth rest.
SPLIT = 0.25
#: Terms of the rest: the first left out is below 1e-15 at ``SPLIT``.
REST_TERMS = 24


def rest_of_pull() -> list[float]:
    """Coefficients r of ``1 / h - 1 / asin(sqrt(h)) ** 2 = sum(r[k] * h ** k)``,
    from ``asin(sqrt(h)) ** 2 = sum((4 * h) ** n / (2 * n * n * comb(2 * n, n)))``."""
    squares = [4.0**n / (2 * n * n * math.comb(2 * n, n)) for n in range(1, REST_TERMS + 2)]
    inverse = [1.0]
    for k in range(1, REST_TERMS + 1):
        inverse.append(-sum(squares[i] * inverse[k - i] for i in range(1, k + 1)))
    return [-b for b in inverse[1:]]


def with_cells(stores: DataFrame, mass: str = "REVENUE_CY", degrees: float = CELL_DEGREES) -> DataFrame:
    """Stores with a position and a mass, and the smallest cell (two integers)
    and the octave of mass each lies in.  The others have no attraction to
    anything."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(degrees) / (1 << FINE_BITS)))
    placed = stores.filter(
        F.col("STORE_LATITUDE").isNotNull() & F.col("STORE_LONGITUDE").isNotNull() & F.col(mass).isNotNull()
    )
    octave = F.when(F.col(mass) > 0, F.floor(F.log2(mass))).otherwise(F.lit(-(1 << 20)))
    return placed.withColumns({"__cy": cell("STORE_LATITUDE"), "__cx": cell("STORE_LONGITUDE"), "__cm": octave})


def cell_bounds(placed: DataFrame, mass: str = "REVENUE_CY") -> DataFrame:
    """One row per (store province, smallest cell, octave of mass): the box
    its stores lie in and the largest mass."""
    return placed.groupBy("STORE_PROVINCE", "__cy", "__cx", "__cm").agg(
        F.min("STORE_LATITUDE").alias("__lat0"), F.max("STORE_LATITUDE").alias("__lat1"),
        F.min("STORE_LONGITUDE").alias("__lon0"), F.max("STORE_LONGITUDE").alias("__lon1"),
        F.max(mass).alias("__mass"),
    )


def coarser(cells: DataFrame, bits: int) -> DataFrame:
    """``cells`` put together to cells of ``2 ** bits`` smallest ones a side."""
    up = [F.shiftright(c, bits).alias(c) for c in ("__cy", "__cx")]
    return cells.groupBy("STORE_PROVINCE", *up).agg(
        *(F.min(c).alias(c) for c in ("__lat0", "__lon0")), *(F.max(c).alias(c) for c in ("__lat1", "__lon1", "__mass"))
    )


def nearest_haversine(lat: str, lon: str, cosines: Column | None = None) -> Column:
    """A lower bound of the haversine of the distance from a point to any
    point of the box (__lat0..__lat1, __lon0..__lon1); ``cosines`` is the
    smallest product of the cosines of both latitudes, if known.

    The haversine of a distance is ``sin2(dlat / 2) + cos(lat) cos(lat') *
    sin2(dlon / 2)``; each factor is replaced by its smallest value over the
    box.  ``sin2`` of half a longitude difference between two ends of a range
    within 0..360 degrees is smallest at one of the ends."""
    zero = F.lit(0.0)
    gap_lat = F.greatest(F.col("__lat0") - F.col(lat), F.col(lat) - F.col("__lat1"), zero)
    gap_lon = F.greatest(F.col("__lon0") - F.col(lon), F.col(lon) - F.col("__lon1"), zero)
    far_lon = F.least(F.greatest(F.abs(F.col(lon) - F.col("__lon0")), F.abs(F.col(lon) - F.col("__lon1"))), F.lit(360.0))

    def half(x):
        return F.sin(F.radians(x) / 2) * F.sin(F.radians(x) / 2)

    across = F.when(far_lon <= 180, half(gap_lon)).otherwise(F.least(half(gap_lon), half(far_lon)))
    if cosines is None:
        smallest = F.least(F.cos(F.radians(F.col("__lat0"))), F.cos(F.radians(F.col("__lat1"))))
        cosines = F.greatest(F.cos(F.radians(F.col(lat))) * smallest, zero)
    return F.least(half(gap_lat) + cosines * across, F.lit(1.0))


def nearest_km(lat: str, lon: str) -> Column:
    """A lower bound of the distance from a point to any point of the box."""
    return F.lit(2 * EARTH_RADIUS_KM * (1 - MARGIN)) * F.asin(F.sqrt(nearest_haversine(lat, lon)))


def packed(df: DataFrame, key: str, numbers: list[str], keep: list[str], size: int) -> DataFrame:
    """``df`` as blocks of at most ``size`` rows that share ``key``: columns
    key, __block (a number no other block of the table has), and a list per
    column of ``numbers`` (doubles) and ``keep``.  A task packs the rows it
    reads; it holds one open block a key."""
    kinds = {c: df.schema[c].dataType for c in [key, *keep]}
    lists = [*numbers, *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        open_blocks, made = {}, TaskContext.get().partitionId() << 32

        def closed(value, rows):
            nonlocal made
            made += 1
            columns = [pa.array([value], schema.field(key).type), pa.array([made], pa.int64())]
            for c in lists:
                flat = pa.concat_arrays([r[c] for r in rows])
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            return pa.RecordBatch.from_arrays(columns, names=[key, "__block", *lists])

        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            codes = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
            number = np.asarray(codes.indices.fill_null(-1))
            for n in np.unique(number):
                value = codes.dictionary[int(n)].as_py() if n >= 0 else None
                rows = batch.take(pa.array(np.flatnonzero(number == n)))
                while rows.num_rows:
                    held = open_blocks.setdefault(value, [])
                    room = size - sum(len(r) for r in held)
                    held.append(rows.slice(0, room))
                    rows = rows.slice(room)
                    if sum(len(r) for r in held) == size:
                        yield closed(value, open_blocks.pop(value))
        for value, held in open_blocks.items():
            yield closed(value, held)

    fields = [f"`{key}` {kinds[key].simpleString()}", "__block long", *(f"`{c}` array<double>" for c in numbers)]
    fields += [f"`{c}` array<{kinds[c].simpleString()}>" for c in keep]
    picked = df.select(key, *(F.col(c).cast("double").alias(c) for c in numbers), *keep)
    return picked.mapInArrow(work, ", ".join(fields))


def place_order(lat: str, lon: str) -> Column:
    """A number near places mostly share: the bits of latitude and longitude
    (16 each), taken in turn.  Missing places come at an end."""
    def spread(value, degrees):
        held = F.least(F.greatest(F.col(value), F.lit(-degrees)), F.lit(degrees))
        bits = F.floor((held + degrees) / (2 * degrees) * 65535).cast("long")
        for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, by)).bitwiseAND(F.lit(mask))
        return bits

    return F.shiftleft(spread(lat, 90.0), 1).bitwiseOR(spread(lon, 180.0))


def postal_totals(ldu: DataFrame, stores: DataFrame, mass: str = "REVENUE_CY", partitions: int | None = None,
                  small: bool = True) -> DataFrame:
    """``ldu`` (one row per postal code) with TOTAL_POSTALCODE_ATTRACTION, the
    sum over all stores that reach it; codes without one are left out.

    Postal codes and stores are packed in blocks by province, and every block
    of codes meets the blocks of the stores that reach it.  A pair of blocks
    is summed by array arithmetic in its task, a few thousand terms at a time,
    so no pair becomes a row.  Codes are dealt by ranges of province and
    place, so a block's codes are neighbours and most stores are far from all
    of them.  With ``small`` (the caller has measured
    more than these four columns) the stores are packed by one task and
    broadcast, else the blocks meet by a shuffle."""
    n = partitions or shuffle_partitions(ldu)
    spark, names, radius, near = ldu.sparkSession, ldu.columns, EARTH_RADIUS_KM, NEAR
    split, rest, begin = SPLIT, rest_of_pull(), inverse_haversine_sums(NEAR)
    keep = [c for c in names if c != "PROV"]
    placed = ldu.withColumns({"__y": F.col("LATITUDE"), "__x": F.col("LONGITUDE"), "__z": place_order("LATITUDE", "LONGITUDE")})
    dealt = placed.repartitionByRange(n, "PROV", "__z", "POSTALCODE").sortWithinPartitions("PROV", "__z", "POSTALCODE")
    codes = packed(dealt, "PROV", ["__y", "__x"], keep, CODE_BLOCK)
    side = stores.select("STORE_PROVINCE", "STORE_LATITUDE", "STORE_LONGITUDE", F.col(mass).alias("__m"))
    side = packed(side.coalesce(1) if small else side, "STORE_PROVINCE", ["STORE_LATITUDE", "STORE_LONGITUDE", "__m"], [], STORE_BLOCK)
    side = side.withColumnRenamed("__block", "__side")
    reached = codes.join(F.broadcast(adjacency(spark)), codes["PROV"] == F.col("LDU_PROV")).drop("LDU_PROV")
    met = reached.join(F.broadcast(side) if small else side, F.col("STORE_PROV") == F.col("STORE_PROVINCE"))

    def pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def places(lat, lon):
            lat, lon = np.radians(lat), np.radians(lon)
            return np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)

        def points(low, high):
            """Chebyshev points of an interval (radians) and the function that
            gives the weights of every point at a place.  What is smooth up to
            the antipode, and looked at from no more than 60 degrees away, is
            interpolated to the rounding; None if the interval is too long."""
            half, middle = max((high - low) / 2, 1e-3), (low + high) / 2
            if not half <= 0.7:  # also if not a number
                return None
            gap = (np.pi - np.pi / 3) / half
            n = int(np.ceil(35 / np.arccosh(gap))) + 1
            angle = (np.arange(n) + 0.5) * np.pi / n
            signed = np.sin(angle) * (-1.0) ** np.arange(n)

            def weights(x):
                apart = (x[:, None] - middle) / half - np.cos(angle)
                hit = apart == 0
                w = signed / np.where(hit, 1, apart)
                w[hit.any(axis=1)] = 0
                w[hit] = 1
                return w / w.sum(axis=1, keepdims=True)

            return middle + half * np.cos(angle), weights

        def smooth_part(here, lats, lons, mass):
            """The part of every code's sum that the rest of the pull makes:
            the masses are put on few points, as the rest is smooth.  None
            where some code is too far away for that, or where it costs more."""
            if not (np.isfinite(mass).all() and (mass >= 0).all()):
                return None
            rows, cols = (points(float(x.min()), float(x.max())) for x in (np.radians(lats), np.radians(lons)))
            if rows is None or cols is None or 4 * len(rows[0]) * len(cols[0]) > len(lats):
                return None
            heaps = ((rows[1](np.radians(lats)) * mass[:, None]).T @ cols[1](np.radians(lons))).ravel()
            there = places(*(np.degrees(x.ravel()) for x in np.meshgrid(rows[0], cols[0], indexing="ij")))
            parts = []
            for a in range(0, len(here[0]), 256):
                h = sum((p[a : a + 256, None] - q) ** 2 for p, q in zip(here, there, strict=True)) * 0.25
                if (h > split).any():
                    return None
                out = np.full_like(h, rest[-1])
                for r in rest[-2::-1]:
                    np.add(np.multiply(out, h, out=out), r, out=out)
                parts.append(out @ heaps)
            return np.concatenate(parts)

        def pulls(lat, lon, lats, lons, mass, key):
            """Attraction of every code, and how many stores are not at its very place."""
            here, there = places(lat, lon), places(lats, lons)
            smooth = smooth_part(here, lats, lons, mass)
            if smooth is None:
                return summed(lat, lon, lats, lons, mass, here, there)
            found = np.isfinite(lat) & np.isfinite(lon)
            near_far = sums_of(lat[found], lon[found], lats, lons, mass, key)
            if near_far is None:
                total, apart = summed(lat, lon, lats, lons, mass, here, there, smooth)
            else:
                total, apart = np.full(len(lat), np.nan), np.full(len(lat), len(lats), np.int64)
                total[found], apart[found] = near_far
                total = (total - smooth) / (2 * radius) ** 2
            again = np.flatnonzero(apart < len(lats))  # the smooth part has the stores at the code's place
            if len(again):
                total[again] = summed(lat[again], lon[again], lats, lons, mass, [p[again] for p in here], there)[0]
            return total, apart

        def summed(lat, lon, lats, lons, mass, here, there, smooth=None):
            """``pulls`` pair by pair; with ``smooth``, less the rest that it holds."""
            total, apart = np.zeros(len(lat)), np.full(len(lat), len(lats), np.int64)
            step = max(1, 32768 // len(lats))
            room, more = np.empty((step, len(lats))), np.empty((step, len(lats)))  # new arrays cost more than the sums
            close = np.empty((step, len(lats)), bool)
            for a in range(0, len(lat), step):
                rows = slice(a, a + step)
                h, t, c = (x[: len(lat[rows])] for x in (room, more, close))
                for k, (p, q) in enumerate(zip(here, there, strict=True)):
                    np.subtract(p[rows, None], q, out=t)
                    np.multiply(t, t, out=t if k else h)
                    if k:
                        np.add(h, t, out=h)
                np.multiply(h, 0.25, out=h)
                i = ()
                if np.less(h, near, out=c).any():
                    i, j = np.nonzero(c)  # differences of places lose digits there
                    dy, dx = np.radians(lats[j] - lat[rows][i]) / 2, np.radians(lons[j] - lon[rows][i]) / 2
                    h[i, j] = np.sin(dy) ** 2 + np.sin(dx) ** 2 * np.cos(np.radians(lats[j])) * np.cos(np.radians(lat[rows][i]))
                    none = h[i, j] == 0
                    i, j = i[none], j[none]
                    h[i, j] = 1
                    apart[rows] -= np.bincount(i, minlength=len(h))
                if smooth is None:
                    np.sqrt(np.minimum(h, 1, out=h), out=h)
                    np.multiply(np.arcsin(h, out=h), 2 * radius, out=h)
                    np.multiply(h, h, out=h)
                with np.errstate(divide="ignore"):
                    np.divide(1, h, out=h)
                if len(i):
                    h[i, j] = 0
                total[rows] = h @ mass
            return total if smooth is None else (total - smooth) / (2 * radius) ** 2, apart

        def closed(held):
            row, total, apart = held
            number = row["PROV"].as_py()
            flat = {c: row[c].values for c in keep}
            sums = pa.array(total, mask=(apart == 0) | np.isnan(row["y"]) | np.isnan(row["x"]))
            columns = [pa.array([number] * len(total), row["PROV"].type) if c == "PROV" else flat[c] for c in names]
            return pa.RecordBatch.from_arrays([*columns, sums], names=[*names, "__a"])

        numbers = lambda scalar: scalar.values.to_numpy(zero_copy_only=False).astype(float)
        block, held, sums_of = None, None, begin()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                if held is None or row["__block"].as_py() != block:
                    if held is not None:
                        yield closed(held)
                    block = row["__block"].as_py()
                    row["y"], row["x"] = numbers(row["__y"]), numbers(row["__x"])
                    held = (row, np.zeros(len(row["y"])), np.zeros(len(row["y"]), np.int64))
                first, total, apart = held
                side = (numbers(row[c]) for c in ("STORE_LATITUDE", "STORE_LONGITUDE", "__m"))
                more = pulls(first["y"], first["x"], *side, row["__side"].as_py())
                total += more[0]
                apart += more[1]
        if held is not None:
            yield closed(held)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ldu.schema.fields)
    sums = met.mapInArrow(pulled, f"{kinds}, __a double")
    if small:  # a block of codes meets all its stores in one task: the sums are whole
        return sums.withColumnRenamed("__a", "TOTAL_POSTALCODE_ATTRACTION")
    return sums.repartition(n, "POSTALCODE", "PROV").groupBy(*names).agg(F.sum("__a").alias("TOTAL_POSTALCODE_ATTRACTION"))


def candidate_cells(met: DataFrame) -> DataFrame:
    """The (postal code, cell) rows of ``met`` whose upper bound may pass the
    cut (``__cut``: attraction that must be exceeded, times the square of the
    diameter).  With a total of zero or less (negative masses) the bound proves
    nothing and every cell stays.  A distance is at least the chord."""
    near = nearest_haversine("LATITUDE", "LONGITUDE", F.col("__cos") * F.col("__cell_cos"))
    return met.filter((F.col("__cut") <= 0) | (F.col("__mass") > F.col("__cut") * near))


def _pairs_of_cells(
    placed: DataFrame, small: bool, ldu: DataFrame, min_share: float, mass: str, partitions: int | None
) -> DataFrame:
    """``pruned_pairs`` of stores with cells, broadcast if ``small``, else
    joined by cell with shuffles.

    A postal code meets the largest cells of the provinces that reach it, then
    level by level the parts of the cells that may pass, and the stores of the
    smallest cells last.  So the rows made follow the rows that pass, however
    many stores a cell of a level holds."""
    codes = ldu.select("POSTALCODE", "PROV", "LATITUDE", "LONGITUDE")
    side = F.broadcast if small else lambda table: maybe_broadcast(table)[0]
    met = postal_totals(codes, placed, mass, partitions, small)
    cut = F.lit(float(min_share) * (2 * EARTH_RADIUS_KM) ** 2 * (1 - MARGIN)) * F.col("TOTAL_POSTALCODE_ATTRACTION")
    met = met.withColumns({"__cut": cut, "__cos": F.cos(F.radians("LATITUDE"))})
    kept = met.columns
    # stores measured as small enough to broadcast: one task makes their cells without an exchange
    cells = cell_bounds(placed.coalesce(1) if small else placed, mass)
    on = None
    for bits in LEVEL_BITS:
        level = coarser(cells, bits) if bits else cells
        smallest = F.least(*(F.cos(F.radians(c)) for c in ("__lat0", "__lat1")))
        level = level.withColumn("__cell_cos", F.greatest(smallest, F.lit(0.0)))
        if on is None:
            adj = F.broadcast(adjacency(ldu.sparkSession))
            reached = level.join(adj, level["STORE_PROVINCE"] == adj["STORE_PROV"]).drop("STORE_PROV")
            met = met.join(side(reached), F.col("PROV") == F.col("LDU_PROV"))
        else:
            up = on - bits
            parts = side(level)
            parent = (F.shiftright(parts["__cy"], up) == met["__ky"]) & (F.shiftright(parts["__cx"], up) == met["__kx"])
            met = met.join(parts, parent & (parts["STORE_PROVINCE"] == met["__prov"]))
        octave = [] if bits else [F.col("__cm").alias("__km")]
        cell = [F.col("STORE_PROVINCE").alias("__prov"), F.col("__cy").alias("__ky"), F.col("__cx").alias("__kx")]
        met, on = candidate_cells(met).select(*kept, *cell, *octave), bits
        if bits == DEALT_BITS:  # few rows a code by now; joins of two stages compile, all in one do not
            met = layout_postal(met, partitions)
    stores = F.broadcast(placed) if small else placed
    same = [met[k] == stores[c] for k, c in (("__prov", "STORE_PROVINCE"), ("__ky", "__cy"), ("__kx", "__cx"), ("__km", "__cm"))]
    paired = met.join(stores, same).drop("__cut", "__cos", "__prov", "__ky", "__kx", "__km", "__cy", "__cx", "__cm")
    distance = haversine_km("STORE_LATITUDE", "STORE_LONGITUDE", "LATITUDE", "LONGITUDE")
    return paired.withColumn("HAVERSINE_DISTANCE", distance).withColumn("Attraction", gravity(mass, "HAVERSINE_DISTANCE"))


def _placed(stores: DataFrame, mass: str, degrees: float) -> tuple[DataFrame, bool]:
    """The stores that reach some province, with the columns of a share row
    and their cells, and whether they measure as small enough to broadcast."""
    wanted = {*schemas.SHARE_COLUMNS, *RUNNING_TIEBREAK, "STORE_LATITUDE", "STORE_LONGITUDE", mass, "__cy", "__cx", "__cm"}
    placed = with_cells(stores, mass, degrees).filter(F.col("STORE_PROVINCE").isin(*REACHABLE_PROVINCES))
    placed = placed.select(*(c for c in placed.columns if c in wanted))
    return placed, fits_broadcast(placed, 2 * broadcast_max_bytes(placed))


def pruned_pairs(
    stores: DataFrame, ldu: DataFrame, min_share: float, mass: str = "REVENUE_CY",
    degrees: float = CELL_DEGREES, partitions: int | None = None,
) -> DataFrame | None:
    """Candidate pairs with HAVERSINE_DISTANCE, Attraction and the postal
    total: every pair that passes the cut, and few others.  None when the
    stores measure more than the broadcast bound."""
    placed, small = _placed(stores, mass, degrees)
    return _pairs_of_cells(placed, small, ldu, min_share, mass, partitions) if small else None


def pruned_shares(
    stores: DataFrame, ldu: DataFrame, min_share: float, mass: str = "REVENUE_CY",
    degrees: float = CELL_DEGREES, partitions: int | None = None,
) -> DataFrame:
    """The rows of ``shares(full_attraction(...), min_share)``, without making
    the pairs that cannot pass."""
    placed, small = _placed(stores, mass, degrees)
    pairs = _pairs_of_cells(placed, small, ldu, min_share, mass, partitions)
    total = F.col("TOTAL_POSTALCODE_ATTRACTION")
    kept = pairs.filter(F.col("Attraction") > F.lit(float(min_share)) * total)
    order = [F.try_divide(F.col("Attraction"), total).asc(), *(F.col(c).asc() for c in RUNNING_TIEBREAK)]
    running = by_postal().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = kept.select(
        "*", F.sum("Attraction").over(by_postal()).alias("__kept"), F.sum("Attraction").over(running).alias("__run")
    )
    # rows that fail have smaller shares than all that pass; under a negative total, larger ones
    weaker = F.when(total < 0, F.col("__run")).otherwise(total - F.col("__kept") + F.col("__run"))
    return summed.select(
        "*", F.try_divide(weaker, total).alias("CUMULATIVE_PERCENT_ATTRACTION"),
        F.try_divide(F.col("Attraction"), F.col("__kept")).alias("PERCENT_ATTRACTION"),
    ).select(*schemas.SHARE_COLUMNS)
