"""Putting rasters on another grid, as pixel tables.

``images`` carries per image the map from source to target pixels, ``x_out = col * sx + ox`` and
``y_out = row * sy + oy``, and the target size ``out_width``, ``out_height``. Every source pixel names
the target cells it reaches, and the cells add up weights. Partial sums form on the map side and the
shuffle key is the target pixel, so one huge image spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.geodesy import grid_side, ten_metre_side


def grid_for(images: DataFrame, max_size: int = 1024) -> DataFrame:
    """Target grid of each image: its extent with at most ``max_size`` pixels on the long side."""
    sized = images.withColumns({"out_width": grid_side("width", max_size=max_size),
                                "out_height": grid_side("height", max_size=max_size)})
    return sized.selectExpr("*", "out_width / cast(width as double) sx", "0D ox",
                            "out_height / cast(height as double) sy", "0D oy")


#: Target cells a task adds up when an image is enlarged, side of the blocks in which pixels are dealt out, most tasks.
CELLS, BLOCK, TASKS = 500_000, 32, 10_000


def _by_blocks(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels dealt out in blocks of neighbours, to as many tasks as the target grids have ``CELLS``.

    Neighbours add to the same target cells, so partial sums meet in one task, and its share of the target doesn't grow
    with the images. The grids are a small table; their sizes are added up before the pixels are read.
    """
    cells = grid.agg(F.expr("sum(cast(out_width as double) * out_height)")).first()[0] or 0
    tasks = int(min(max(-(-cells // CELLS), 1), TASKS))
    return pixels.repartition(tasks, "image_id", F.expr(f"row div {BLOCK}"), F.expr(f"col div {BLOCK}"))


def regrid(pixels: DataFrame, images: DataFrame, bands: Sequence[str], method: str = "average") -> DataFrame:
    """Resample onto the target grid: area-weighted "average", or "bilinear" for enlarging.

    NULL values carry no weight. A target cell no valid value reaches has NULL or no row.
    """
    grid = images.select("image_id", "sx", "ox", "sy", "oy", "out_width", "out_height")
    rows = pixels.select("image_id", "row", "col", *bands)
    rows = (_by_blocks(rows, grid) if method == "bilinear" else rows).join(grid, "image_id")
    for axis, source, size in (("x", "col", "out_width"), ("y", "row", "out_height")):
        s, o = f"s{axis}", f"o{axis}"
        if method == "average":
            start, end = f"({source} * {s} + {o})", f"(({source} + 1) * {s} + {o})"
            first, last = f"floor({start})", f"ceil({end}) - 1"
            weight = f"least({end}, __{axis} + 1D) - greatest({start}, cast(__{axis} as double))"
        elif method == "bilinear":
            centre = f"(({source} + 0.5D) * {s} + {o})"
            first, last = f"ceil({centre} - {s} - 0.5D)", f"floor({centre} + {s} - 0.5D)"
            weight = f"1D - abs(__{axis} + 0.5D - {centre}) / {s}"
        else:
            raise ValueError("method must be 'average' or 'bilinear'")
        rows = (rows.withColumns({"__first": F.expr(f"greatest(0L, {first})"),
                                  "__last": F.expr(f"least({size} - 1L, {last})")})
                .where("__first <= __last")
                .withColumn(f"__{axis}", F.expr("explode(sequence(__first, __last))"))
                .withColumn(f"__w{axis}", F.expr(weight)).where(f"__w{axis} > 0"))
    rows = rows.withColumn("__w", F.expr("__wx * __wy"))
    sums = [F.expr(f"try_divide(sum(__w * {b}), sum(if({b} is not null, __w, null))) {b}") for b in bands]
    return rows.groupBy("image_id", F.expr("cast(__y as int) row"), F.expr("cast(__x as int) col")).agg(*sums)


def ten_metre_grid(images: DataFrame) -> DataFrame:
    """Target grid of each image at 10 m: ``images`` has width, height, units, res_x, res_y and mid_lat.

    Without a ground scale the grid stays as it is. ``method`` is bilinear where the image gets more rows, else average.
    """
    sized = images.withColumns({"out_width": ten_metre_side("width", "res_x", "units", "mid_lat", True),
                                "out_height": ten_metre_side("height", "res_y", "units", "mid_lat", False)})
    return sized.selectExpr("*", "out_width / cast(width as double) sx", "0D ox", "out_height / cast(height as double) sy", "0D oy",
                            "if(out_height <= height, 'average', 'bilinear') method")


def to_ten_metres(pixels: DataFrame, images: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Every image resampled to 10 m by the method its own size asks for (``ten_metre_grid``)."""
    grid = ten_metre_grid(images)
    parts = [regrid(pixels, grid.where(F.col("method") == method), bands, method) for method in ("average", "bilinear")]
    return parts[0].unionByName(parts[1])


def align(second: DataFrame, first: DataFrame, images: DataFrame, bands: Sequence[str]) -> DataFrame:
    """The second image on the first image's grid; first-grid pixels outside it have NULL bands."""
    moved = regrid(second, images, bands)
    return first.select("image_id", "row", "col").join(moved, ["image_id", "row", "col"], "left")


def resize_nearest(pixels: DataFrame, images: DataFrame, values: Sequence[str]) -> DataFrame:
    """Centre-sampled resize from (height, width) to (out_height, out_width). No shuffle: every source
    pixel names the target pixels whose centre falls into it."""
    rows = pixels.select("image_id", "row", "col", *values).join(
        images.select("image_id", "width", "height", "out_width", "out_height"), "image_id")
    for source, size, out in (("row", "height", "out_height"), ("col", "width", "out_width")):
        first = f"greatest(0L, floor({source} * cast({out} as double) / {size}) - 1L)"
        last = f"least({out} - 1L, ceil(({source} + 1) * cast({out} as double) / {size}) + 1L)"
        hit = f"cast(least((__t + 0.5D) * {size} / {out}, {size} - 1D) as int) = {source}"
        rows = (rows.withColumn("__t", F.expr(f"explode(sequence({first}, {last}))")).where(hit)
                .withColumn(f"__{source}", F.expr("cast(__t as int)")).drop("__t"))
    return rows.select("image_id", F.col("__row").alias("row"), F.col("__col").alias("col"), *values)


def reflect_pad(pixels: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """Images smaller than ``size`` mirrored (without repeating the edge) to ``size``; others unchanged."""
    rows = pixels.join(images.select("image_id", "height", "width"), "image_id")
    for source, n in (("row", "height"), ("col", "width")):
        period = f"greatest(1, 2 * ({n} - 1))"
        folded = f"(case when {n} = 1 then 0 when p % {period} < {n} then p % {period} else {period} - p % {period} end)"
        rows = rows.withColumn(source, F.expr(
            f"explode(if({n} >= {size}, array({source}), filter(sequence(0, {size - 1}), p -> {folded} = {source})))"))
    return rows.drop("height", "width")


def augment(tiles: DataFrame, size: int, seed: int = 0, choice: str | None = None) -> DataFrame:
    """Flips and quarter turns of square tiles.

    ``choice`` is SQL text of a number per tile: bit 0 flips columns, bit 1 rows, bits 2 and 3 are the quarter
    turns. By default it is a hash of tile and seed, so a task that runs again gives the same tile.
    """
    h = choice or f"pmod(xxhash64(image_id, {seed}), 16)"
    rows = tiles.selectExpr("*", f"({h}) & 1 __flip_x", f"shiftright(({h}) & 2, 1) __flip_y", f"shiftright(({h}) & 12, 2) __turns")
    last = size - 1
    rows = rows.withColumns({"col": F.expr(f"if(__flip_x = 1, {last} - col, col)"),
                             "row": F.expr(f"if(__flip_y = 1, {last} - row, row)")})
    turned = {"row": F.expr(f"cast(case __turns when 0 then row when 1 then {last} - col when 2 then {last} - row else col end as int)"),
              "col": F.expr(f"cast(case __turns when 0 then col when 1 then row when 2 then {last} - col else {last} - row end as int)")}
    return rows.withColumns(turned).drop("__flip_x", "__flip_y", "__turns")
