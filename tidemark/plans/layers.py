"""Image layers as colour columns: a scene in grey with the mask, the segmented footprint, dark areas and rejected tiles over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.pixels import blended, hex_channels, to_byte
from ..operators.stats import dense_cells, normalised
from ..operators.tiling import TILE, covered
from ..sources.rasters import Raster
from .detection import Detection

CELL = ["scene_id", "row", "col"]
LAYERS = ("sar", "mask", "footprint", "undetected")
# Colours and opacities of the layers.
MASK, FOOTPRINT, REJECTED, UNDETECTED = "#d64040", "#27b6a5", "#e5c453", "#e5c453"
FOOTPRINT_ALPHA, UNDETECTED_ALPHA = 0.30, 0.62


def layer_cells(raster: Raster, found: Detection, layer: str, cfg: Config = DEFAULT, dark: DataFrame | None = None, rejected: bool = False) -> DataFrame:
    """``scene_id, row, col, red, green, blue`` of every cell of a layer: ``sar`` (grey alone), ``mask``, ``footprint`` (where a final tile gave
    a probability above 0) or ``undetected`` (what the screener rejected of ``dark``, and the mask). With ``rejected``, all rejected
    tiles are tinted below that, but for the mask where it is shown."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    if layer == "undetected" and dark is None:
        raise ValueError("the undetected layer is made of undetected dark cells")
    yes = F.lit(True)
    cells = dense_cells(raster.scenes).join(normalised(raster, cfg).select(*CELL, "norm"), CELL, "left")
    marks = {"_oil": found.mask.select(CELL)}
    if rejected:
        marks["_gone"] = covered(found.rejected.select(TILE), cfg)
    if layer == "footprint":
        marks["_foot"] = found.mosaic.filter("prob > 0").select(CELL)
    if layer == "undetected":
        marks["_dark"] = dark.filter("rejected_by_screener").select(CELL)
    for name, mask in marks.items():
        cells = cells.join(mask.distinct().withColumn(name, yes), CELL, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    grey = to_byte(F.coalesce("norm", F.lit(0.0)), F.col("norm").isNotNull())
    paints = []
    if rejected:
        paints.append((F.col("_gone") & ~F.col("_oil") if layer in ("mask", "undetected") else F.col("_gone"), REJECTED, cfg.rejected_alpha))
    if layer == "footprint":
        paints.append((F.col("_foot"), FOOTPRINT, FOOTPRINT_ALPHA))
    if layer == "undetected":
        paints.append((F.col("_dark"), UNDETECTED, UNDETECTED_ALPHA))
    if layer in ("mask", "undetected"):
        paints.append((F.col("_oil"), MASK, cfg.overlay_alpha))
    channels = []
    for k, name in enumerate(("red", "green", "blue")):
        value = grey
        for where, colour, alpha in paints:
            value = blended(value, where, hex_channels(colour)[k], alpha)
        channels.append(value.cast("int").alias(name))
    return cells.select(*CELL, *channels)
