"""Results as tables: analysis responses, identities, caches by recency, region exports, layers."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOUNDARY, CONFIDENCE_ORDER, INVALID, SEVERITY_ORDER, Config
from ..functions.geodesy import to_degrees
from ..functions.labels import inside_validated, json_number, rank, region_label


def config_hash(cfg: Config, files: tuple[str, ...] = ()) -> str:
    """Of all parameters and of the identities (path, size, time of change) of input files such as weights and coast, so that whatever
    can change a result changes it. A missing file has an identity too."""
    known = dataclasses.asdict(cfg)
    if files:
        stats = [(str(Path(f).resolve()), Path(f).stat() if Path(f).exists() else None) for f in files]
        known["files"] = [{"path": p, "size": s and s.st_size, "changed": s and s.st_mtime_ns} for p, s in stats]
    return hashlib.sha256(json.dumps(known, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def content_id(content: Column) -> Column:
    return F.concat(F.lit("upload-"), F.substring(F.sha2(content.cast("binary"), 256), 1, 20))


def display_name(file_name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_", " ")


def scene_list(headers: DataFrame, titles: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """What a list of scenes shows: ``scene_id, title, height, width, crs, path``, bounds in degrees (null where the reference system has
    none), label of the place and whether that is validated. ``titles`` (scene_id, title) name scenes, the others are named by
    their files; ``names`` (scene_id) are the scenes to list, those without a file are passed over."""
    from ..operators.regions import scene_bounds

    if names is not None:
        headers = headers.join(names.select("scene_id").distinct(), "scene_id", "left_semi")
    rows = headers.join(scene_bounds(headers), "scene_id", "left")
    rows = rows.join(titles.select("scene_id", "title"), "scene_id", "left") if titles is not None else rows.withColumn("title", F.lit(None).cast("string"))
    lon, lat = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    label = region_label(lon, lat)
    return rows.select("scene_id", F.coalesce("title", display_name(F.col("scene_id"))).alias("title"), "height", "width", "crs", "path", "west", "south", "east", "north", label.alias("region_label"), inside_validated(label, lon, lat).alias("inside_validated_bounds"))


def newest(entries: DataFrame, key: str, used: str, items: int, size: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """The most recently used entries, at most ``items`` and, by running sum, ``max_bytes``. One row a key is ranked."""
    last = entries.groupBy(key).agg(F.max(used).alias("last_used"), *([F.max_by(size, used).alias("bytes")] if size else []))
    top = last.orderBy(F.desc("last_used"), key).limit(items)
    w = Window.orderBy(F.desc("last_used"), key)
    ranked = top.withColumn("position", F.row_number().over(w).cast("long"))
    if size and max_bytes is not None:
        ranked = ranked.withColumn("running_bytes", F.sum("bytes").over(w)).filter((F.col("running_bytes") <= max_bytes) | (F.col("position") == 1))
    return ranked


def rejection_summary(rejected: DataFrame) -> DataFrame:
    """All rejections but the invalid count as screened out, those at boundaries too."""
    return rejected.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_rejected"), F.count_if(F.col("reason") == INVALID).alias("invalid_tiles_excluded"), F.count_if(F.col("reason") != INVALID).alias("tiles_screened_out"), F.count_if(F.col("reason") == BOUNDARY).alias("at_boundary")
    )


def scene_summary(regions: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row a scene: totals, highest labels, nearest coast; place by the middle of the scene, in degrees where its
    reference system is geographic or UTM (else it is outside all areas)."""
    sums = regions.groupBy("scene_id").agg(
        F.sum("area_km2").alias("_total"), F.max("area_km2").alias("_largest"), F.min("distance_to_coast_km").alias("nearest_coast_km"), F.count(F.lit(1)).alias("_n"),
        F.max_by("severity", rank(F.col("severity"), SEVERITY_ORDER)).alias("_alert"), F.max_by("confidence", rank(F.col("confidence"), CONFIDENCE_ORDER)).alias("_confidence"),
    )
    x, y = F.col("c") + F.col("a") * F.col("width") / 2 + F.col("b") * F.col("height") / 2, F.col("f") + F.col("e") * F.col("height") / 2 + F.col("d") * F.col("width") / 2
    lon, lat = to_degrees(F.col("crs"), x, y)
    rows = scenes.join(sums, "scene_id", "left").withColumns({"centre_x": lon, "centre_y": lat})
    label = region_label(F.col("centre_x"), F.col("centre_y"))
    zero = F.lit(0.0)
    return rows.select(
        "scene_id", F.round(F.coalesce("_total", zero), 6).alias("total_area_km2"), F.coalesce("_n", F.lit(0)).alias("region_count"), F.coalesce("_largest", zero).alias("largest_region_km2"),
        json_number(F.col("nearest_coast_km")).alias("nearest_coast_km"), F.coalesce("_alert", F.lit("Low")).alias("alert_level"), F.coalesce("_confidence", F.lit("Low")).alias("confidence"),
        F.hypot("a", "b").alias("pixel_x"), F.hypot("d", "e").alias("pixel_y"), F.col("width").alias("width_px"), F.col("height").alias("height_px"), label.alias("region_label"),
        inside_validated(label, F.col("centre_x"), F.col("centre_y")).alias("inside_validated_bounds"),
    )


def responses(summary: DataFrame, regions: DataFrame, cfg: Config) -> DataFrame:
    """``scene_id, response``: nested JSON, regions by falling area. A scene's regions make one document, as they must."""
    record = F.struct((-F.col("area_km2")).alias("_order"), *[F.col(c) for c in regions.columns if c != "scene_id"])
    listed = regions.groupBy("scene_id").agg(F.sort_array(F.collect_list(record)).alias("regions"))
    return summary.join(listed, "scene_id", "left").select("scene_id", F.to_json(F.struct(*[F.col(c) for c in summary.columns], F.lit(config_hash(cfg)).alias("config_hash"), F.col("regions"))).alias("response"))


def export_regions(regions: DataFrame, path: str) -> None:
    """CSV by falling area, ties by region."""
    regions.orderBy(F.desc("area_km2"), "scene_id", "region_id").write.mode("overwrite").csv(path, header=True)
