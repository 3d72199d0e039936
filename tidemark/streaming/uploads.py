"""Detection on scenes as they arrive: a stream over a folder of uploads, one detection a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators.shared import scratch, write_shared
from ..plans import detection, service
from ..sources.images import read_scenes
from ..sources.rasters import Raster

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def detect_batch(files: DataFrame, cfg: Config = DEFAULT, coast_degrees: DataFrame | None = None) -> DataFrame:
    """Regions of the scenes of a frame (path, content), with the content's identity; distances to a coast (segments in longitude and
    latitude) where one is given, else unknown."""
    scenes = read_scenes(files.sparkSession, files)
    raster = Raster(write_shared(scenes.pixels), write_shared(scenes.scenes))
    found = detection.learned(raster, cfg)
    ids = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("scene_id"), service.content_id(F.col("content")).alias("content_id"))
    return detection.measure(raster, found.mask, found.mosaic, cfg=cfg, coast_degrees=coast_degrees).join(ids, "scene_id")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: Config = DEFAULT, detect: Callable[..., DataFrame] = detect_batch, coast_degrees: DataFrame | None = None) -> StreamingQuery:
    """Append the regions of each new file below ``folder`` to Parquet at ``out``; a batch that is repeated overwrites itself. What a batch
    writes on its way goes when its result is written."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.tif").load(folder)

    def each(batch: DataFrame, number: int) -> None:
        with scratch():
            detect(batch, cfg, coast_degrees).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
