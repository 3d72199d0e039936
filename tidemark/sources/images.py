"""Scenes from and to image files: single-band GeoTIFF in, GeoTIFF scenes and masks and PNG layers out.

A file is read by as many tasks as it has block ranges and encoded by as many as it has blocks; what is left for one task a file is
to put encoded blocks behind each other as they stream by. No scene has to fit in memory.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.shared import write_shared
from . import geotiff
from .geotiff import SceneError
from .rasters import Raster

__all__ = ["GeoTiffSource", "SceneError", "read_header", "read_scenes", "read_strips", "scene_headers", "write_layers", "write_masks", "write_scenes"]

SCENES = "scene_id string, height long, width long, nodata double, crs string, a double, b double, c double, d double, e double, f double"
PIXELS = "scene_id string, row long, col long, value double"
HEADERS = f"{SCENES}, path string, blocks long, block_height long, block_width long, compression long, predictor long, description string, scope string"
#: Cells of a strip at most, rows of one at most, and bytes of a file that a task reads.
STRIP_CELLS, STRIP_ROWS, TASK_BYTES = 1 << 20, 256, 4 << 20
_ROWS_OUT = 1 << 16
#: Tasks that shares smaller than ``TASK_BYTES`` make at most, about.
MOST_SHARES = 1000
#: The last part of a path without its ending.
_STEM = r"([^/]+?)(?:\.[^./]*)?$"


def read_header(data: bytes) -> dict:
    """Dimensions, nodata, reference system and affine coefficients of a file's bytes."""
    h = geotiff.header(geotiff.bytes_reader(data))
    return {"height": h.height, "width": h.width, "nodata": h.nodata, "crs": h.crs, **dict(zip("abcdef", h.affine, strict=True)), "header": h}


def read_strips(data: bytes, header: dict) -> Iterator[tuple[int, np.ndarray]]:
    """First row and values (single precision) of each strip of a file's bytes, or each tile's."""
    h, read = header["header"], geotiff.bytes_reader(data)
    for block, (at, n) in enumerate(geotiff.block_ranges(read, h, 0, h.blocks)):
        yield h.corner(block)[0], geotiff.block_values(read(at, n), h, block)


# --- in --------------------------------------------------------------------------------------------------------------


class _File:
    """Byte ranges of a file; ``taken`` counts bytes."""

    def __init__(self, path: str):
        files, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))
        self.file, self.taken = files.open_input_file(inner), 0

    def read(self, at: int, n: int) -> bytes:
        self.taken += n
        return self.file.read_at(n, at)


def _uri(path: str) -> str:
    """``file:/a`` and ``hdfs:/a`` as the readers of tasks want them."""
    scheme, colon, rest = path.partition(":")
    return f"{scheme}://{rest}" if colon and rest.startswith("/") and not rest.startswith("//") else path


def _cells(scene: str, h: geotiff.Header, read: geotiff.Read, first: int, last: int, rows: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Cells of a range of blocks, small blocks together; blocks beyond the rows asked for are not read."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def taken() -> pa.RecordBatch:
        r, c, v = (np.concatenate(part) for part in zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.repeat(scene, len(v)), pa.array(r), pa.array(c), pa.array(v)], ["scene_id", "row", "col", "value"])

    size = 0
    for k, (at, n) in enumerate(geotiff.block_ranges(read, h, first, last), first):
        top, left = h.corner(k)
        if top > rows[1] or min(top + h.block_height, h.height) <= rows[0]:
            continue
        values = geotiff.block_values(read(at, n), h, k)
        step = max(1, _ROWS_OUT // values.shape[1])
        for i in range(0, len(values), step):
            part = values[i : i + step]
            if held and size + part.size > _ROWS_OUT:
                yield taken()
                size = 0
            r, c = np.indices(part.shape)
            held.append((r.ravel() + top + i, c.ravel() + left, part.ravel().astype(float)))
            size += part.size
    if held:
        yield taken()


def _header_row(scene: str, path: str, h: geotiff.Header) -> tuple:
    return (scene, h.height, h.width, h.nodata, h.crs, *h.affine, path, h.blocks, h.block_height, h.block_width, h.compression, h.predictor, h.description, h.scope)


class _Part(InputPartition):
    """Some files, and which share of their blocks."""

    def __init__(self, files: list[tuple[str, str]], share: int = 0, shares: int = 1):
        self.files, self.share, self.shares = files, share, shares


class _Reader(DataSourceReader):
    """Scenes prune files and rows prune blocks by option, not by Spark's filters: a loaded source keeps the filters that were first
    pushed to it, also for later plans that ask for other rows."""

    def __init__(self, options: dict[str, str]):
        self.headers = options.get("read", "pixels") == "headers"
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.files = [tuple(f) for f in json.loads(options["files"])]
        self.scenes = set(json.loads(options["scenes"])) if options.get("scenes") else None
        self.rows = tuple(json.loads(options["rows"])) if options.get("rows") else (0, 1 << 62)

    def partitions(self) -> list[_Part]:
        """From the listing alone: no file is opened to plan. A file larger than a task's share is parted by its blocks. Shares smaller than
        ``TASK_BYTES`` grow where they would be more than `MOST_SHARES`."""
        known = [(scene, path, size) for scene, path, size in self.files if self.scenes is None or scene in self.scenes]
        share = max(self.task_bytes, min(TASK_BYTES, sum(size for *_, size in known) // MOST_SHARES))
        if self.headers:
            return [_Part([(s, p) for s, p, _ in known[i : i + 64]]) for i in range(0, len(known), 64)]
        parts = []
        for scene, path, size in known:
            n = max(1, -(-size // share))
            parts += [_Part([(scene, path)], k, n) for k in range(n)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        for scene, path in partition.files:
            read = _File(path).read
            h = geotiff.header(read)
            if self.headers:
                yield _header_row(scene, path, h)
            else:
                first, last = (h.blocks * k // partition.shares for k in (partition.share, partition.share + 1))
                yield from _cells(scene, h, read, first, last, self.rows)


class GeoTiffSource(DataSource):
    """``spark.read.format("tidemark_geotiff")`` over a listing of files: ``read`` is ``pixels`` (the default) or ``headers``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_geotiff"

    def schema(self) -> str:
        return HEADERS if self.options.get("read") == "headers" else PIXELS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def _listed(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, str, int]]:
    """Scene, path and size of each file, by Spark's own listing: contents stay unread."""
    rows = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", _STEM, 1), "path", "length").collect()
    return sorted((s, _uri(p), n) for s, p, n in rows)


def _source(spark: SparkSession, files: list[tuple[str, str, int]], **options) -> DataFrame:
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format(GeoTiffSource.name()).options(files=json.dumps(files), **options).load()


def scene_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A catalogue of GeoTIFF files from their headers, some hundred bytes of each: the columns of scenes, then path, layout of blocks,
    description and normalisation scope. The file's name is the scene's id."""
    return _source(spark, _listed(spark, paths), read="headers")


def read_scenes(spark: SparkSession, paths: str | list[str] | DataFrame, task_bytes: int = TASK_BYTES, scenes: list[str] | None = None, rows: tuple[int, int] | None = None) -> Raster:
    """A raster of GeoTIFF files: strips or tiles, plain, LZW, deflated or packed, with any predictor, classic or big.

    Of paths or globs (which tasks must be able to open), each file is read by a task for every ``task_bytes``; files of other than the
    ``scenes`` asked for are left out, and so are blocks without any of the ``rows`` from first to last. A frame ``(path, content)``
    holds the files' bytes already: then a scene is read by one task.
    """
    if not isinstance(paths, DataFrame):
        files = _listed(spark, paths)
        some = {"scenes": json.dumps(scenes)} if scenes is not None else {}
        pixels = _source(spark, files, taskBytes=task_bytes, **some, **({"rows": json.dumps(rows)} if rows else {}))
        wanted = pixels.filter(F.col("row").between(*rows)) if rows else pixels
        return Raster(wanted, _source(spark, files, read="headers", **some).select(*[f.split()[0] for f in SCENES.split(", ")]))
    files = paths.select(F.regexp_extract("path", _STEM, 1).alias("scene_id"), "content")

    def headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCENES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), *[pa.float64()] * 6]
        for batch in batches:
            rows = [_header_row(s.as_py(), "", geotiff.header(geotiff.bytes_reader(c.as_py()))) for s, c in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def pixels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, c in zip(batch.column(0), batch.column(1), strict=True):
                read = geotiff.bytes_reader(c.as_py())
                h = geotiff.header(read)
                yield from _cells(s.as_py(), h, read, 0, h.blocks, (0, 1 << 62))

    return Raster(files.mapInArrow(pixels, PIXELS), files.mapInArrow(headers, SCENES))


# --- out -------------------------------------------------------------------------------------------------------------


def _encoded(cells: DataFrame, scenes: DataFrame, channels: list[str], tile: int | None, fill: float, kind: str, encode) -> DataFrame:
    """Encoded blocks: ``scene_id, block, bytes, size, raw_size, sum``. Cells that are missing have the value ``fill``.

    A row for each block, with its layout, and behind it the block's cells pass a task in order; it holds one block of values.
    """
    per = F.greatest(F.lit(1), F.least(F.lit(STRIP_ROWS), F.floor(F.lit(STRIP_CELLS) / F.col("width")))).cast("long") if tile is None else F.lit(tile).cast("long")
    grid = scenes.select("scene_id", "height", "width", per.alias("_h"), (F.col("width") if tile is None else F.lit(tile)).cast("long").alias("_w"))
    grid = grid.withColumn("_across", F.ceil(F.col("width") / F.col("_w"))).withColumn("_blocks", F.col("_across") * F.ceil(F.col("height") / F.col("_h")))
    number, left = F.col("block"), F.col("block") % F.col("_across") * F.col("_w")
    top = F.floor(number / F.col("_across")) * F.col("_h")
    rows = F.least(F.col("_h"), F.col("height") - top) if tile is None else F.col("_h")
    blank = {c: F.lit(None).cast(cells.schema[c].dataType) for c in channels}
    every = grid.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select("scene_id", "block", F.lit(-1).cast("long").alias("_at"), rows.cast("long").alias("_rows"), F.col("_w").alias("_cols"), *[v.alias(c) for c, v in blank.items()])
    across, down = F.floor(F.col("col") / F.col("_w")), F.floor(F.col("row") / F.col("_h"))
    inside = F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
    placed = cells.select("scene_id", "row", "col", *channels).join(F.broadcast(grid) if grid.limit(100_001).count() <= 100_000 else grid, "scene_id").filter(inside)
    within = (F.col("row") - down * F.col("_h")) * F.col("_w") + F.col("col") - across * F.col("_w")
    none = F.lit(None).cast("long")
    placed = placed.select("scene_id", (down * F.col("_across") + across).alias("block"), within.cast("long").alias("_at"), none.alias("_rows"), none.alias("_cols"), *channels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = out = None
        ready: list[tuple] = []

        def finish() -> None:
            if out is not None:
                data, raw, total = encode(out)
                ready.append((*key, data, len(data), raw, total))

        def taken() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], k) for i, k in enumerate(kinds)], ["scene_id", "block", "bytes", "size", "raw_size", "sum"])
            ready.clear()
            return made

        for batch in batches:
            at = batch.column(2).to_numpy()
            values = np.stack([batch.column(5 + k).fill_null(fill).to_numpy(zero_copy_only=False).astype(np.dtype(kind)) for k in range(len(channels))], axis=1)
            heads = np.flatnonzero(at < 0)
            if out is not None:
                first = heads[0] if len(heads) else len(at)
                out.reshape(-1, len(channels))[at[:first]] = values[:first]
            for n, i in enumerate(heads):
                finish()
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                out = np.full((batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), len(channels)), fill, np.dtype(kind))
                j = heads[n + 1] if n + 1 < len(heads) else len(at)
                out.reshape(-1, len(channels))[at[i + 1 : j]] = values[i + 1 : j]
                if len(ready) >= 1024 or ready and ready[-1][3] > 1 << 18:
                    yield taken()
            if ready:
                yield taken()
        finish()
        if ready:
            yield taken()

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.union(placed).repartition(n, "scene_id", "block").sortWithinPartitions("scene_id", "block", "_at").mapInArrow(run, "scene_id string, block long, bytes binary, size long, raw_size long, sum long")


def _grid(scenes: DataFrame) -> DataFrame:
    """Scenes with all coefficients; a grid without rotation may leave them out."""
    have = set(scenes.columns)
    zero, null = F.lit(0.0), F.lit(None)
    missing = {k: zero for k in ("b", "d") if k not in have} | {k: null.cast(t) for k, t in (("nodata", "double"), ("scope", "string")) if k not in have}
    return scenes.withColumns(missing) if missing else scenes


def _assembled(blocks: DataFrame, scenes: DataFrame, out_dir: str, suffix: str, writer) -> DataFrame:
    """One file a scene of its encoded blocks: ``scene_id, path``. A block's place follows from the sizes before it; the task that writes
    a file holds one block at a time and the sizes. Encoded blocks are written first, as their sizes are asked for on their own."""
    blocks = write_shared(blocks, "blocks")
    sizes = blocks.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("block", "size"))).alias("_sizes"))  # two numbers a block
    first = scenes.select("scene_id", F.lit(-1).cast("long").alias("block"), F.to_json(F.struct(*[c for c in scenes.columns if c != "scene_id"]), {"ignoreNullFields": "false"}).alias("about"))
    first = first.join(sizes.select("scene_id", F.transform("_sizes", lambda x: x["size"]).alias("sizes")), "scene_id").select("scene_id", "block", "about", "sizes", F.lit(None).cast("binary").alias("bytes"), F.lit(0).cast("long").alias("raw_size"), F.lit(0).cast("long").alias("sum"))
    parts = first.unionByName(blocks.select("scene_id", "block", "bytes", "raw_size", "sum"), allowMissingColumns=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(out_dir)
        files.create_dir(base, recursive=True)
        scene = name = out = state = None

        def finished() -> pa.RecordBatch:
            out.write(state.tail())
            out.close()
            files.move(name, f"{base}/{scene}{suffix}")  # a repeated attempt puts the same file in place
            return pa.RecordBatch.from_pydict({"scene_id": [scene], "path": [f"{base}/{scene}{suffix}"]})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("scene_id", "block", "about", "sizes", "bytes", "raw_size", "sum")}
                if row["block"] < 0:
                    if out is not None:
                        yield finished()
                    scene, name = row["scene_id"], f"{base}/.{uuid.uuid4().hex}"
                    out, state = files.open_output_stream(name), writer(json.loads(row["about"]), row["sizes"])
                    out.write(state.head())
                else:
                    out.write(state.block(row["bytes"], row["raw_size"], row["sum"]))
        if out is not None:
            yield finished()

    return parts.repartition("scene_id").sortWithinPartitions("scene_id", "block").mapInArrow(run, "scene_id string, path string")


class _Tiff:
    """A GeoTIFF; a big one where positions would not fit in 32 bits."""

    def __init__(self, about: dict, sizes: list[int], tile: int | None, kind: str, compression: int, predictor: int, description: str, big: bool):
        per = tile or max(1, min(STRIP_ROWS, STRIP_CELLS // about["width"]))
        affine = tuple(about[k] for k in "abcdef")
        big = big or sum(sizes) + 64 * len(sizes) > 4_000_000_000
        self.before, self.after = geotiff.frame(about["height"], about["width"], per, tile, kind, compression, predictor, about["nodata"], about["crs"], affine, sizes, description, about["scope"], big)

    def head(self) -> bytes:
        return self.before

    def block(self, data: bytes, raw: int, total: int) -> bytes:
        return data

    def tail(self) -> bytes:
        return self.after


def _added(one: int, other: int, length: int) -> int:
    """Adler-32 of two strings put together, the second of this length."""
    prime = 65521
    low = (one & 0xFFFF) + (other & 0xFFFF) - 1
    high = (one >> 16) + (other >> 16) + (length % prime) * ((one & 0xFFFF) - 1)
    return high % prime << 16 | low % prime


class _Png:
    """One compressed stream of blocks that tasks deflated each for itself; their checksums add up."""

    def __init__(self, about: dict, sizes: list[int]):
        self.width, self.height, self.sum, self.begun = about["width"], about["height"], 1, False

    @staticmethod
    def _chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def head(self) -> bytes:
        return b"\x89PNG\r\n\x1a\n" + self._chunk(b"IHDR", struct.pack(">IIBBBBB", self.width, self.height, 8, 2, 0, 0, 0)) + self._chunk(b"IDAT", b"\x78\x01")

    def block(self, data: bytes, raw: int, total: int) -> bytes:
        self.sum = _added(self.sum, total, raw)
        return self._chunk(b"IDAT", data)

    def tail(self) -> bytes:
        return self._chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", self.sum)) + self._chunk(b"IEND", b"")


def _tiff_block(compression: int, predictor: int, values: np.ndarray) -> tuple[bytes, int, int]:
    return geotiff.block_bytes(values[:, :, 0], compression, predictor), 0, 0


def _png_block(values: np.ndarray) -> tuple[bytes, int, int]:
    raw = b"".join(b"\0" + line.tobytes() for line in values)
    z = zlib.compressobj(3, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH), len(raw), zlib.adler32(raw)


def write_masks(mask: DataFrame, scenes: DataFrame, out_dir: str) -> DataFrame:
    """One GeoTIFF a scene on the scene's own grid, 1 where the mask holds: ``scene_id, path``. A column ``scope`` of ``scenes`` is kept as
    the file's normalisation scope."""
    scenes = _grid(scenes).withColumn("nodata", F.lit(None).cast("double"))
    blocks = _encoded(mask.withColumn("v", F.lit(1)), scenes, ["v"], None, 0, "u1", partial(_tiff_block, geotiff.DEFLATE, 1))
    return _assembled(blocks, scenes, out_dir, ".tif", partial(_Tiff, tile=None, kind="u1", compression=geotiff.DEFLATE, predictor=1, description="binary detection mask", big=False))


def write_scenes(raster: Raster, out_dir: str, tile: int | None = None, compression: int = geotiff.DEFLATE, predictor: int = 1, big: bool = False) -> DataFrame:
    """One GeoTIFF a scene of single-precision values, in strips or in square tiles of ``tile`` (a multiple of 16): ``scene_id, path``.
    Missing cells and nulls are not-a-number."""
    if tile is not None and tile % 16:
        raise SceneError("tiles have a multiple of 16 cells a side")
    blocks = _encoded(raster.pixels.withColumn("v", F.col("value").cast("float")), raster.scenes, ["v"], tile, np.nan, "f4", partial(_tiff_block, compression, predictor))
    return _assembled(blocks, _grid(raster.scenes), out_dir, ".tif", partial(_Tiff, tile=tile, kind="f4", compression=compression, predictor=predictor, description="scene", big=big))


def write_layers(cells: DataFrame, scenes: DataFrame, out_dir: str) -> DataFrame:
    """One PNG a scene from columns red, green and blue; missing cells are black: ``scene_id, path``."""
    return _assembled(_encoded(cells, scenes, ["red", "green", "blue"], None, 0, "u1", _png_block), scenes, out_dir, ".png", _Png)
