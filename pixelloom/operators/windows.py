"""Sliding windows over images: window lists, pixel gather, scoring, scene scores and score maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions.indices import normalised_channel
from pixelloom.operators.regrid import reflect_pad

# Window side, bands and class names of the patch model.
PATCH = 120
PATCH_BANDS = ("blue", "green", "red", "nir")
PATCH_CLASSES = (
    "agriculture_with_natural_vegetation", "agro_forestry_areas", "arable_land", "beaches_dunes_sands",
    "broad_leaved_forest", "coastal_wetlands", "complex_cultivation_patterns", "coniferous_forest",
    "industrial_commercial_units", "inland_waters", "inland_wetlands", "marine_waters", "mixed_forest",
    "moors_heathland_sclerophyllous_vegetation", "natural_grassland_sparse_vegetation", "pastures",
    "permanent_crops", "transitional_woodland_shrub", "urban_fabric")
BUILT_CLASSES = ("urban_fabric", "industrial_commercial_units")
#: Windows that a scorer gets at a call, and bytes they may take.
BATCH, BATCH_BYTES = 64, 64 << 20


def _starts(n: str, size: int, stride: int) -> str:
    return (f"if({n} <= {size}, array(0), array_distinct(concat(sequence(0, cast({n} as int) - {size}, {stride}), "
            f"array(cast({n} as int) - {size}))))")


def windows(images: DataFrame, size: int = PATCH, stride: int = PATCH // 2) -> DataFrame:
    """Top left corners of the windows of each image; the last row and column are flush with the edge."""
    return (images.withColumn("win_row", F.expr(f"explode({_starts('height', size, stride)})"))
                  .withColumn("win_col", F.expr(f"explode({_starts('width', size, stride)})"))
                  .select("image_id", "win_row", "win_col"))


def window_pixels(pixels: DataFrame, images: DataFrame, size: int = PATCH, stride: int = PATCH // 2) -> DataFrame:
    """Each pixel once per window that covers it. Arithmetic on the image size, so no join with a window list."""
    rows = pixels.join(images.select("image_id", "height", "width"), "image_id")
    for axis, n in (("row", "height"), ("col", "width")):
        first = f"greatest(0L, ceil(({axis} - {size - 1}) / {stride}D))"
        last = f"least(floor({axis} / {stride}D), floor(({n} - {size}) / {stride}D))"
        regular = f"if({n} <= {size}, array(0), if({first} <= {last}, transform(sequence({first}, {last}), k -> cast(k * {stride} as int)), array()))"
        flush = f"if({n} > {size} and {axis} >= {n} - {size}, array(cast({n} as int) - {size}), array())"
        rows = rows.withColumn(f"win_{axis}", F.expr(f"explode(array_distinct(concat({regular}, {flush})))"))
    return rows.drop("height", "width")


def scene_score(window_scores: DataFrame, classes: Sequence[str] = BUILT_CLASSES) -> DataFrame:
    """Mean over the windows of the highest probability among ``classes``."""
    top = F.greatest(*[F.col(c) for c in classes]) if len(classes) > 1 else F.col(classes[0])
    return window_scores.groupBy("image_id").agg(F.avg(top).alias("score"), F.count(F.lit(1)).alias("windows"))


def score_map(window_scores: DataFrame, images: DataFrame, classes: Sequence[str] = BUILT_CLASSES,
              size: int = PATCH, stride: int = PATCH // 2) -> DataFrame:
    """Per pixel the highest score among the windows that cover it.

    Window edges cut each axis into blocks inside which every pixel has the same windows. Windows are
    spread over their few blocks, the maximum is taken per block, and only then do blocks become
    pixels, without a shuffle: the shuffle carries blocks, not pixels.
    """
    top = F.greatest(*[F.col(c) for c in classes]) if len(classes) > 1 else F.col(classes[0])
    rows = window_scores.select("image_id", "win_row", "win_col", top.alias("score")).join(
        images.select("image_id", "height", "width"), "image_id")
    for axis, n in (("row", "height"), ("col", "width")):
        lo, hi = f"win_{axis}", f"(win_{axis} + {size})"
        # Every edge inside the window: where regular windows start and end, and the flush edges.
        near = (f"sequence(greatest(0, cast(floor(({lo} - {size}) / {stride}D) as int)), "
                f"cast(ceil({hi} / {stride}D) as int))")
        edges = (f"array_sort(array_distinct(filter(concat(array({lo}, {hi}, cast({n} as int) - {size}, cast({n} as int)), "
                 f"transform({near}, k -> k * {stride}), transform({near}, k -> k * {stride} + {size})), "
                 f"k -> k >= {lo} and k <= {hi})))")
        rows = (rows.withColumn("__edges", F.expr(edges))
                .withColumn("__i", F.expr("explode(sequence(1, size(__edges) - 1))"))
                .withColumns({f"__{axis}0": F.expr("__edges[__i - 1]"), f"__{axis}1": F.expr("__edges[__i]")})
                .drop("__edges", "__i"))
    blocks = rows.groupBy("image_id", "height", "width", "__row0", "__row1", "__col0", "__col1").agg(F.max("score").alias("score"))
    return (blocks.where("__row0 < height and __col0 < width")
            .withColumn("row", F.expr("explode(sequence(__row0, least(__row1, height) - 1))"))
            .withColumn("col", F.expr("explode(sequence(__col0, least(__col1, width) - 1))"))
            .select("image_id", "row", "col", "score"))


def window_tiles(pixels: DataFrame, images: DataFrame, size: int = PATCH, tile: int | None = None) -> DataFrame:
    """Each pixel once per tile whose windows reach it: ``tile_row``, ``tile_col`` and the image's size are added.

    A tile owns the windows whose corner lies in it, ``tile`` pixels a side (four windows if not given). So a
    pixel goes to its own tile and, within a window of the upper or left edge, to the neighbour's.
    """
    tile = tile or 4 * size
    if tile < size:
        raise ValueError("a tile must not be smaller than a window")
    rows = pixels.join(images.select("image_id", "height", "width"), "image_id")
    for axis, n in (("row", "height"), ("col", "width")):
        first = f"greatest(0L, floor(({axis} - {size - 1}) / {tile}D))"
        last = f"least(floor({axis} / {tile}D), floor(greatest(0, {n} - {size}) / {tile}D))"
        rows = rows.withColumn(f"tile_{axis}", F.expr(f"explode(sequence(cast({first} as int), cast({last} as int)))"))
    return rows


class _Tile:
    """The pixels of one tile and the windows it owns."""

    def __init__(self, key: tuple, bands: int, size: int, stride: int, tile: int):
        self.image, self.row0, self.col0, height, width = key[0], key[1] * tile, key[2] * tile, key[3], key[4]
        self.size = size
        self.shape = (bands, min(tile + size - 1, height - self.row0), min(tile + size - 1, width - self.col0))
        self.values = np.zeros(self.shape, dtype=np.float32)
        self.corners = [(r, c) for r in self._starts(height, self.row0, tile, stride) for c in self._starts(width, self.col0, tile, stride)]

    def _starts(self, n: int, at: int, tile: int, stride: int) -> list[int]:
        every = sorted({*range(0, max(1, n - self.size + 1), stride), max(0, n - self.size)})
        return [x for x in every if at <= x < at + tile]

    def put(self, row: np.ndarray, col: np.ndarray, values: np.ndarray) -> None:
        self.values[:, row - self.row0, col - self.col0] = values

    def patches(self):
        for r, c in self.corners:
            r0, c0 = r - self.row0, c - self.col0
            yield r, c, self.values[:, r0:r0 + self.size, c0:c0 + self.size]


def _scored(scorer, bands: int, names: Sequence[str], size: int, stride: int, tile: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], np.empty((many, bands, size, size), dtype=np.float32)

        def score() -> pa.RecordBatch:
            probs = np.asarray(scorer(held[:len(keys)]), dtype="float64")
            image, row, col = zip(*keys, strict=True)
            keys.clear()
            return pa.RecordBatch.from_arrays([image_type(image), pa.array(row, pa.int32()), pa.array(col, pa.int32()),
                                               *[pa.array(probs[:, i]) for i in range(len(names))]],
                                              names=["image_id", "win_row", "win_col", *names])

        def finished(done: _Tile | None) -> Iterator[pa.RecordBatch]:
            for r, c, patch in done.patches() if done else ():
                held[len(keys)] = patch
                keys.append((done.image, r, c))
                if len(keys) == many:
                    yield score()

        current, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            image_type = lambda values, kind=kind: pa.array(values, kind)
            place = [batch.column(i).to_numpy() for i in range(1, 7)]  # tile_row, tile_col, height, width, row, col
            values = np.stack([batch.column(7 + b).to_numpy(zero_copy_only=False) for b in range(bands)])
            image = batch.column(0).dictionary_encode()
            code = image.indices.to_numpy()
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(place[0]) != 0) | (np.diff(place[1]) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                found = (image.dictionary[int(code[a])].as_py(), *[int(place[i][a]) for i in range(4)])
                if found != key:
                    yield from finished(current)
                    current, key = _Tile(found, bands, size, stride, tile), found
                current.put(place[4][a:b], place[5][a:b], values[:, a:b])
        yield from finished(current)
        if keys:
            yield score()
    return run


def score_windows(pixels: DataFrame, images: DataFrame, scorer: Callable[[np.ndarray], np.ndarray],
                  class_names: Sequence[str] = PATCH_CLASSES, bands: Sequence[str] = PATCH_BANDS,
                  mean: Sequence[float] | None = None, std: Sequence[float] | None = None,
                  size: int = PATCH, stride: int = PATCH // 2, batch: int = BATCH, tile: int | None = None) -> DataFrame:
    """Class probabilities of every window from a user-supplied model.

    ``scorer`` takes a float32 array (n, bands, size, size), normalised with missing values 0, and returns (n, classes).
    Pixels are normalised before the one shuffle, which deals them to tiles (``window_tiles``); a task builds the array of
    one tile at a time and gives the scorer ``batch`` windows at a call, fewer where these would take more than
    ``BATCH_BYTES``, also of different tiles. Images smaller than a window are mirrored first.
    """
    bands, names, tile = list(bands), list(class_names), tile or 4 * size
    many = max(1, min(batch, BATCH_BYTES // (4 * len(bands) * size * size)))
    centre, spread = mean if mean is not None else [0.0] * len(bands), std if std is not None else [1.0] * len(bands)
    padded = reflect_pad(pixels.select("image_id", "row", "col", *bands), images, size)
    large = images.selectExpr("image_id", f"greatest(height, {size}) height", f"greatest(width, {size}) width")
    scaled = [normalised_channel(b, float(m), float(d)).alias(f"__{i}") for i, (b, m, d) in enumerate(zip(bands, centre, spread, strict=True))]
    dealt = window_tiles(padded.select("image_id", "row", "col", *scaled), large, size, tile)
    order = ["image_id", "tile_row", "tile_col"]
    rows = dealt.select(*order, *[F.col(c).cast("int").alias(c) for c in ("height", "width", "row", "col")], *[f"__{i}" for i in range(len(bands))])
    schema = T.StructType([T.StructField("image_id", pixels.schema["image_id"].dataType),
                           T.StructField("win_row", T.IntegerType()), T.StructField("win_col", T.IntegerType()),
                           *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _scored(scorer, len(bands), names, size, stride, tile, many), schema)
