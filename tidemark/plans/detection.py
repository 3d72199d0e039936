"""Detection plans: tiles are gated and segmented, stitched, combined, cleaned and measured.

Scorers are plain functions of DataFrames: a screener turns the cells of eligible tiles (scene_id, y, x, row, col, norm) into
one probability a tile, a segmenter into one probability a cell. Learned models fit in as pandas or batch functions there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, SCREENED, Config
from ..functions.pixels import at_least, below, scaled
from ..operators import components, morphology
from ..operators.regions import mask_area_km2, region_table
from ..operators.stats import infilled, normalised, scene_percentiles, valid_pixels
from ..operators.tiling import TILE, covered, on_tiles, partitioned, scaled_by_tile, stitched
from ..sources.rasters import Raster

CELL = ["scene_id", "row", "col"]
Scorer = Callable[[DataFrame, Config], DataFrame]


def pass_all(cells: DataFrame, cfg: Config) -> DataFrame:
    return cells.select(TILE).distinct().withColumn("p_oil", F.lit(1.0))


def dark_fraction(cells: DataFrame, cfg: Config) -> DataFrame:
    """A deterministic screener: the dark share of a tile."""
    return cells.groupBy(TILE).agg(F.avg(below(F.col("norm"), cfg.dark).cast("double")).alias("p_oil"))


def dark_rule(cells: DataFrame, cfg: Config) -> DataFrame:
    return cells.withColumn("prob", below(F.col("norm"), cfg.dark).cast("float"))


def identity(cells: DataFrame, cfg: Config) -> DataFrame:
    return cells.withColumn("prob", F.col("norm"))


def inverted(cells: DataFrame, cfg: Config) -> DataFrame:
    """A deterministic segmenter with graded output: the darker, the likelier."""
    return cells.withColumn("prob", (F.lit(1.0) - F.col("norm").cast("double")).cast("float"))


def grown(scenes: DataFrame, cfg: Config) -> DataFrame:
    """Scenes with height and width of a tile at least."""
    return scenes.withColumns({"height": F.greatest(F.col("height"), F.lit(cfg.tile).cast("long")), "width": F.greatest(F.col("width"), F.lit(cfg.tile).cast("long"))})


def edges_repeated(cells: DataFrame, scenes: DataFrame, cfg: Config) -> DataFrame:
    """Cells with those of the last row and column repeated up to a tile's size, in scenes that are smaller."""

    def along(axis: str, size: str):
        at, last = F.col(axis), F.col(size) - 1
        return F.explode(F.when(at == last, F.sequence(at, F.greatest(at, F.lit(cfg.tile - 1).cast("long")))).otherwise(F.array(at)))

    sized = cells.join(scenes.select("scene_id", "height", "width"), "scene_id")
    return sized.withColumn("row", along("row", "height")).withColumn("col", along("col", "width")).drop("height", "width")


@dataclass(frozen=True)
class Prepared:
    """What all passes over a raster need, computed and written once. ``cells``: scene_id, row, col, valid, and value (tile scope) or
    norm, infilled where so configured; ``bounds``: each scene's range, in scene scope."""

    cells: DataFrame
    bounds: DataFrame | None


def prepared(raster: Raster, cfg: Config) -> Prepared:
    cells, bounds = infilled(raster) if cfg.infill else valid_pixels(raster).withColumn("valid", F.lit(True)), None
    if cfg.norm_scope == "fixed_db":
        cells = cells.withColumn("norm", scaled(F.col("value"), F.lit(cfg.fixed_lo), F.lit(cfg.fixed_hi)))
    elif cfg.norm_scope == "scene":
        bounds = components.write_shared(scene_percentiles(raster, cfg), "bounds")
        cells = cells.join(bounds, "scene_id").withColumn("norm", scaled(F.col("value"), F.col("lo"), F.col("hi")))
    return Prepared(components.write_shared(cells.select(*CELL, "value" if cfg.norm_scope == "tile" else "norm", "valid"), "cells"), bounds)


def dark_cells(raster: Raster, cfg: Config, ready: Prepared | None = None) -> DataFrame:
    """Valid cells that the classical rule calls dark: ``scene_id, row, col``. Tile scope has no scene to compare with."""
    cells = normalised(raster, cfg) if ready is None or cfg.norm_scope == "tile" else ready.cells.filter("valid")
    return cells.filter(below(F.col("norm"), cfg.dark)).select(CELL)


def model_inputs(raster: Raster, tiles: DataFrame, cfg: Config, ready: Prepared | None = None) -> DataFrame:
    """Cells of the tiles, infilled, with edges repeated where a scene is smaller than a tile, and scaled by the scope's range:
    ``scene_id, y, x, row, col, norm, valid``."""
    cells = (ready or prepared(raster, cfg)).cells
    placed = on_tiles(edges_repeated(cells, raster.scenes, cfg), grown(raster.scenes, cfg), cfg)
    placed = placed.join(tiles.select(TILE), TILE, "left_semi")
    return scaled_by_tile(placed, cfg) if cfg.norm_scope == "tile" else placed


def scores_checked(scores: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``column`` of what a scorer gave; a missing column, a value that isn't a number from 0 to 1 and a key that
    repeats end the job."""
    if missing := {*keys, column} - set(scores.columns):
        raise ValueError(f"a scorer's result lacks {sorted(missing)}")
    p = F.col(column)
    good = F.when(p.between(0.0, 1.0) & ~F.isnan(p), p).otherwise(F.raise_error(F.concat(F.lit(f"{column} must be from 0 to 1, not "), F.coalesce(p.cast("string"), F.lit("null")))).cast("double"))
    once = F.when(F.count(F.lit(1)) == 1, F.max(good)).otherwise(F.raise_error(F.lit(f"a scorer gave {column} twice for one key")).cast("double"))
    return scores.groupBy(*keys).agg(once.alias(column))


def batch_scorer(make: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], what: str = "screener", batch: int = 64) -> Scorer:
    """A scorer from a function of tiles x tile x tile arrays of values and of validity: one probability a tile, or, with
    ``what="segmenter"``, an array of probabilities of the same shape. ``make`` is called once a task and gives that function, so a
    model is loaded once; tiles come ``batch`` at a time (fewer at a task's end), each with its cells in one row of arrays. Every tile
    and every cell gets its own result, so results don't depend on ``batch``."""

    def adapted(cells: DataFrame, cfg: Config) -> DataFrame:
        tile = cfg.tile

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, held = make(), []

            def scored() -> pa.RecordBatch:
                n = len(held)
                values, valid = np.zeros((n, tile, tile), np.float32), np.zeros((n, tile, tile), bool)
                for k, (_, _, _, at, norm, good) in enumerate(held):
                    values[k].reshape(-1)[at], valid[k].reshape(-1)[at] = norm, good
                out = np.asarray(score(values, valid))
                if out.shape != ((n,) if what == "screener" else values.shape):
                    raise ValueError(f"a {what} gave the shape {out.shape} for tiles of the shape {values.shape}")
                keys = [pa.array([h[i] for h in held]) for i in range(3)]
                if what == "screener":
                    return pa.RecordBatch.from_arrays([*keys, pa.array(out.astype(float))], ["scene_id", "y", "x", "p_oil"])
                sizes = [len(h[3]) for h in held]
                place, of = np.concatenate([h[3] for h in held]), np.repeat(np.arange(n), sizes)
                y, x = (np.repeat([h[i] for h in held], sizes) for i in (1, 2))
                columns = [keys[0].take(pa.array(of)), pa.array(y), pa.array(x), pa.array(y + place // tile), pa.array(x + place % tile), pa.array(out.reshape(n, -1)[of, place].astype(np.float32))]
                return pa.RecordBatch.from_arrays(columns, ["scene_id", "y", "x", "row", "col", "prob"])

            for rows in batches:
                for i in range(rows.num_rows):
                    scene, y, x = (rows.column(k)[i].as_py() for k in range(3))
                    whole = rows.column(3)[i].values
                    at, norm, good = (whole.field(whole.type.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("at", "norm", "valid"))
                    held.append((scene, y, x, at.astype(np.int64), norm, good))
                    if len(held) == batch:
                        yield scored()
                        held.clear()
            if held:
                yield scored()

        place = ((F.col("row") - F.col("y")) * tile + F.col("col") - F.col("x")).cast("int")
        packed = cells.groupBy(TILE).agg(F.collect_list(F.struct(place.alias("at"), "norm", "valid")).alias("cells"))  # the cells of one tile
        return packed.mapInArrow(run, "scene_id string, y long, x long, " + ("p_oil double" if what == "screener" else "row long, col long, prob float"))

    return adapted


def tile_scorer(score: Callable[[np.ndarray, np.ndarray], float], what: str = "screener") -> Scorer:
    """A scorer from a function of one tile's values and validity (both tile x tile arrays): a probability, or, with
    ``what="segmenter"``, an array of the same shape."""

    def all_of(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        out = [score(v, ok) for v, ok in zip(values, valid, strict=True)]
        if what == "segmenter" and any(np.shape(o) != values.shape[1:] for o in out):
            raise ValueError(f"a segmenter gave the shapes {sorted({np.shape(o) for o in out})} for tiles of {values.shape[1:]}")
        return np.array(out)

    return batch_scorer(lambda: all_of, what)


@dataclass(frozen=True)
class Detection:
    """``tiles``: the grid with eligibility, scores and gates; ``mosaic``: stitched cells (prob, n_tiles, classical); ``mask``:
    final true cells; ``rejected``: one row a rejected tile; ``ready``: what the passes were made of."""

    tiles: DataFrame
    mosaic: DataFrame
    mask: DataFrame
    rejected: DataFrame
    ready: Prepared | None = None


def expanded_pass_grid(tiles: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``scene_id, gi, gj`` of tiles passed or added by closing and hole filling in the grid, if they are eligible.

    ``tiles``: scene_id, gi, gj, eligible, passed. Neighbourhood is by grid index, so the last, forced tile is an ordinary one.
    """
    grid = tiles.groupBy("scene_id").agg((F.max("gi") + 1).alias("height"), (F.max("gj") + 1).alias("width"))
    mask = tiles.filter("passed").select("scene_id", F.col("gi").alias("row"), F.col("gj").alias("col"))
    grown = morphology.closed(mask, grid) if cfg.closing else mask
    if cfg.fill_grid_holes:
        grown = components.holes_filled(grown, grid)
    either = mask.union(grown).distinct().select("scene_id", F.col("row").alias("gi"), F.col("col").alias("gj"))
    return either.join(tiles.filter("eligible").select("scene_id", "gi", "gj"), ["scene_id", "gi", "gj"], "left_semi")


def screened(raster: Raster, cfg: Config, screener: Scorer, ready: Prepared | None = None) -> DataFrame:
    """The tile grid with ``p_oil``, ``passed`` (by the threshold) and ``final`` (after expansion)."""
    tiles = components.write_shared(partitioned(raster, cfg))
    scores = screener(model_inputs(raster, tiles.filter("eligible"), cfg, ready), cfg)
    scored = tiles.join(scores_checked(scores, "p_oil", TILE), TILE, "left")
    left_out = F.raise_error(F.concat(F.lit("the screener left out the tile at "), F.concat_ws(", ", "scene_id", "y", "x"))).cast("double")
    scored = scored.withColumn("p_oil", F.when(F.col("eligible") & F.col("p_oil").isNull(), left_out).otherwise(F.col("p_oil")))
    gated = components.write_shared(scored.withColumn("passed", F.coalesce(F.col("p_oil") >= cfg.screener_threshold, F.lit(False)) & F.col("eligible")))
    final = expanded_pass_grid(gated, cfg).withColumn("_final", F.lit(True))
    return gated.join(final, ["scene_id", "gi", "gj"], "left").withColumn("final", F.coalesce("_final", F.lit(False))).drop("_final")


def learned(raster: Raster, cfg: Config = DEFAULT, screener: Scorer = dark_fraction, segmenter: Scorer = inverted) -> Detection:
    """Two passes: all eligible tiles are screened, the final set is segmented; the classical rule joins within its footprint."""
    if cfg.norm_scope == "tile":
        raise ValueError("tile scope has no dark cells of a scene")
    ready = prepared(raster, cfg)
    tiles = components.write_shared(screened(raster, cfg, screener, ready))
    predicted = scores_checked(segmenter(model_inputs(raster, tiles.filter("final"), cfg, ready), cfg), "prob", [*TILE, "row", "col"])
    valid = ready.cells.filter("valid").select(*CELL, below(F.col("norm"), cfg.dark).alias("classical"))
    dark = valid.filter("classical").select(CELL)
    mosaic = components.write_shared(stitched(predicted).join(valid, CELL))
    raw = mosaic.filter(at_least(F.col("prob"), cfg.mask)).select(CELL)
    if cfg.classical_union:
        raw = raw.union(mosaic.filter("classical").select(CELL) if cfg.restrict_union else dark).distinct()
    if cfg.fill_pixel_holes:
        raw = components.holes_filled(raw, raster.scenes)
    mask = components.write_shared(cleaned(raw, raster.scenes, cfg))
    return Detection(tiles, mosaic, mask, rejected_tiles(tiles, cfg), ready)


def deterministic(raster: Raster, cfg: Config = DEFAULT, segmenter: Scorer = dark_rule) -> Detection:
    """One pass over all eligible tiles, without grid morphology, union or a validity mask on the result."""
    tiles = components.write_shared(partitioned(raster, cfg).withColumns({"p_oil": F.lit(1.0), "passed": F.col("eligible"), "final": F.col("eligible")}))
    mosaic = components.write_shared(within(stitched(scores_checked(segmenter(model_inputs(raster, tiles.filter("final"), cfg), cfg), "prob", [*TILE, "row", "col"])), raster.scenes).withColumn("classical", F.lit(False)))
    mask = components.write_shared(cleaned(mosaic.filter(at_least(F.col("prob"), cfg.mask)).select(CELL), raster.scenes, cfg))
    return Detection(tiles, mosaic, mask, rejected_tiles(tiles, cfg))


def within(cells: DataFrame, scenes: DataFrame) -> DataFrame:
    """Cells of the scenes themselves, without repeated edges."""
    return cells.join(scenes.select("scene_id", "height", "width"), "scene_id").filter("row < height and col < width").drop("height", "width")


def broken_accounts(universe: DataFrame, detected: DataFrame, dark: DataFrame) -> DataFrame:
    """One row of counts that are 0 if every cell of ``universe`` (all dark, valid cells after cleaning, and the detected ones) is
    either detected or dark and undetected: ``overlap`` (both), ``missing`` (neither), ``extra`` (of neither universe), and
    ``repeated`` (more than one row). Cells: scene_id, row, col."""
    marked = [df.select(*CELL, *[F.lit(int(k == n)).alias(k) for k in "udw"]) for df, n in ((universe, "u"), (detected, "d"), (dark, "w"))]
    each = marked[0].union(marked[1]).union(marked[2]).groupBy(CELL).agg(*[F.sum(k).alias(k) for k in "udw"])
    return each.agg(
        F.count_if((F.col("d") > 0) & (F.col("w") > 0)).alias("overlap"), F.count_if((F.col("u") > 0) & (F.col("d") + F.col("w") == 0)).alias("missing"),
        F.count_if((F.col("u") == 0) & (F.col("d") + F.col("w") > 0)).alias("extra"), F.count_if((F.col("d") > 1) | (F.col("w") > 1)).alias("repeated"),
    )


def broken_parts(layer: DataFrame, screener: DataFrame, detected: DataFrame, parts: DataFrame) -> DataFrame:
    """One row of counts that are 0 if ``parts`` (cells with ``rejected_by_screener``) divide ``layer`` (all undetected dark cells): ``overlap``
    with detected cells, ``missing`` and ``extra`` cells, cells ``repeated`` or in both parts, and cells ``misattributed``, that is not
    of the screener's part just where ``screener`` has them."""
    marked = [df.select(*CELL, *[F.lit(int(k == n)).alias(k) for k in "lsdpy"]) for df, n in ((layer, "l"), (screener, "s"), (detected, "d"), (parts, "p"), (parts.filter("rejected_by_screener"), "y"))]
    both = marked[0]
    for df in marked[1:]:
        both = both.union(df)
    each = both.groupBy(CELL).agg(*[F.sum(k).alias(k) for k in "lsdpy"])
    return each.agg(
        F.count_if((F.col("p") > 0) & (F.col("d") > 0)).alias("overlap"), F.count_if((F.col("l") > 0) & (F.col("p") == 0)).alias("missing"), F.count_if((F.col("l") == 0) & (F.col("p") > 0)).alias("extra"),
        F.count_if(F.col("p") > 1).alias("repeated"), F.count_if((F.col("p") > 0) & ((F.col("s") > 0) != (F.col("y") > 0))).alias("misattributed"),
    )


def cleaned(mask: DataFrame, scenes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Opening, then components of the least size; the order matters for thin shapes."""
    runs = morphology.runs_of(mask)
    if cfg.opening_radius:
        runs = morphology.opened_runs(runs, scenes, morphology.disk(cfg.opening_radius))
    return components.cells(components.at_least(components.joined_runs(runs, cfg.connectivity), cfg.min_blob)).select(CELL)


def rejected_tiles(tiles: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One record a tile that isn't in the final set; the invalid come first, then row-major."""
    gone = tiles.filter("not final").withColumn("reason", F.coalesce("reason", F.lit(SCREENED)))
    screen = F.col("reason") == SCREENED
    return gone.select(
        "scene_id", "x", "y", "reason", F.col("invalid_fraction").alias("invalid_pixel_fraction"), F.when(~screen, F.lit(cfg.max_invalid)).alias("max_invalid_fraction"), "touches_scene_boundary", "adjacent_to_nodata",
        F.when(screen, F.col("p_oil")).alias("oil_probability"), F.when(screen, F.lit(cfg.screener_threshold)).alias("screener_threshold"), F.when(screen, 1).otherwise(0).alias("reason_rank"),
    )


def undetected_dark(raster: Raster, found: Detection, cfg: Config = DEFAULT) -> DataFrame:
    """Dark, valid cells that weren't detected, cleaned: ``scene_id, row, col, rejected_by_screener``.

    A cell belongs to the screener's rejections if a tile that it rejected covers it and no probability above 0 does.
    """
    dark = dark_cells(raster, cfg, found.ready).join(found.mask, CELL, "left_anti")
    rest = components.write_shared(cleaned(dark, raster.scenes, cfg))
    cover = covered(found.rejected.filter(F.col("reason") == SCREENED).select(TILE), cfg)
    attributed = rest.join(cover, CELL, "left_semi").join(found.mosaic.filter("prob > 0").select(CELL), CELL, "left_anti").withColumn("_by", F.lit(True))
    return rest.join(attributed, CELL, "left").select(*CELL, F.coalesce("_by", F.lit(False)).alias("rejected_by_screener"))


def measure(raster: Raster, mask: DataFrame, mosaic: DataFrame | None = None, coast: DataFrame | None = None, cfg: Config = DEFAULT, coast_degrees: DataFrame | None = None) -> DataFrame:
    """The region table of a final mask."""
    labelled = components.write_shared(components.label(mask, cfg.connectivity))
    return region_table(labelled, raster.scenes, mosaic, coast, cfg, coast_degrees)


def dark_categories(dark: DataFrame, scenes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``scene_id, category, area_km2, n_pixels, percentage, region_count`` of all cells of `undetected_dark` (category ``total``) and of those of
    the screener's rejections (``rejected_by_screener``), in every scene; components of a category are its own."""
    kinds = {"total": dark, "rejected_by_screener": dark.filter("rejected_by_screener")}
    rows = []
    for name, cells in kinds.items():
        parts = components.labelled_runs(cells, cfg.connectivity).groupBy("scene_id").agg(F.count_distinct("first_row", "first_col").alias("region_count"))
        rows.append(mask_area_km2(cells, scenes, cfg).join(parts, "scene_id", "left").withColumn("category", F.lit(name)))
    both = rows[0].unionByName(rows[1])
    whole = both.filter("category = 'total'").select("scene_id", F.col("n_pixels").alias("_all"))
    share = F.when(F.col("_all") > 0, F.round(100.0 * F.col("n_pixels") / F.col("_all"), 6)).otherwise(0.0)
    return both.join(whole, "scene_id").select("scene_id", "category", "area_km2", "n_pixels", share.alias("percentage"), F.coalesce("region_count", F.lit(0)).alias("region_count"))


def dark_record(categories: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``scene_id, record``: the totals of `dark_categories`, the categories by name, and the constants that say what they mean."""
    of = F.struct("area_km2", "percentage", "region_count")
    named = F.map_from_entries(F.collect_list(F.when(F.col("category") != "total", F.struct("category", of))))
    total = F.max(F.when(F.col("category") == "total", of))
    rows = categories.groupBy("scene_id").agg(total.alias("t"), named.alias("categories"))
    constants = [F.lit(cfg.dark).alias("baseline_threshold"), F.lit(cfg.opening_radius).alias("opening_radius"), F.lit(cfg.min_blob).alias("minimum_blob_px")]
    return rows.select("scene_id", F.struct(F.col("t.area_km2").alias("total_area_km2"), F.col("t.region_count").alias("region_count"), "categories", *constants).alias("record"))


def diagnostic_summary(dark: DataFrame, scenes: DataFrame) -> DataFrame:
    """Totals of `undetected_dark`, with the share of the screener's rejections (0 where nothing is dark)."""
    total = mask_area_km2(dark, scenes).withColumnsRenamed({"area_km2": "total_area_km2", "n_pixels": "total_pixels"})
    part = mask_area_km2(dark.filter("rejected_by_screener"), scenes).withColumnsRenamed({"area_km2": "rejected_area_km2", "n_pixels": "rejected_pixels"})
    share = F.when(F.col("total_pixels") > 0, 100.0 * F.col("rejected_pixels") / F.col("total_pixels")).otherwise(0.0)
    return total.join(part, "scene_id").withColumn("percentage", F.round(share, 6))
