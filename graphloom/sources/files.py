"""File sources and sinks: listings, volumes, graphs, metric files and checksums."""

from __future__ import annotations

import base64
import gzip
import os
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import dealt, written
from ..operators.ordering import with_position
from ..operators.packed import BATCH_VALUES

FOLDERS = ("raw", "seg", "vtp")
VOLUME = "sample_id string, kind string, shape struct<d:int,h:int,w:int>, data array<double>"
METRICS = "run_id string, epoch int, name string, value double"


#: Stores that tasks reach by themselves; Spark lists and reads all others.
DIRECT = ("file", "hdfs", "gs", "s3")
#: Names of a folder, files and bytes that a task handles at a time, files of a task.
NAMES, READ_BYTES, FILES = 10_000, 1 << 24, 2_000


def _direct(path: str | Column) -> bool | Column:
    return path.partition(":")[0] in DIRECT if isinstance(path, str) else F.regexp_extract(path, "^([^:/]*):", 1).isin(*DIRECT)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path with a scheme, and the path in it, which is no URL: its characters stand for themselves."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, inner = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{inner}".removeprefix("/" if scheme in ("gs", "s3") else "")


def _entries(folder: str) -> Iterator[pd.DataFrame]:
    """Files and folders in a folder, some at a time; like Spark's listings without hidden names."""
    system, place = _store(folder)
    if isinstance(system, fs.LocalFileSystem):
        names = ((e.name, e.is_dir()) for e in os.scandir(place))
    else:
        names = ((e.base_name, e.type == fs.FileType.Directory) for e in system.get_file_info(fs.FileSelector(place)))
    names = (x for x in names if not x[0].startswith((".", "_")))
    while some := list(islice(names, NAMES)):
        yield pd.DataFrame({"path": [f"{folder}/{name}" for name, _ in some], "inner": [inner for _, inner in some]})


def _below(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below a folder, level by level: tasks list folders, and the driver gets no names."""
    run = lambda frames: (part for frame in frames for folder in frame["path"] for part in _entries(folder))
    folders, found = spark.createDataFrame([(root,)], "path string"), []
    while folders is not None:
        level = written(folders.mapInPandas(run, "path string, inner boolean"), "listing")
        found.append(level.where("not inner").select("path"))
        inner = level.where("inner").select("path")
        folders = dealt(inner, "path", rows=16, least=1) if inner.limit(1).count() else None
    return reduce(DataFrame.unionByName, found)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder, without contents."""
    root = _qualified(spark, path)
    files = _below(spark, root) if _direct(root) else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"^(.*)/[^/]*/[^/]*$", 1).alias("leaf"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))


#: Ends of image and mask files by layout; a mask has the end of its image.
LAYOUTS = {"mri": (".nii", ".nii.gz"), "plants": (".png",)}
SPLITS = ("train", "val", "test")


def resolve_split(files: DataFrame, root: str, split: str, allow_direct: bool = True) -> str:
    """The folder <root>/<split> if it holds raw, seg and vtp, else with allow_direct the root itself if that does."""
    split = split.strip().lower()
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    root = _qualified(files.sparkSession, root)
    wanted = [f"{root}/{split}", root][: 1 + allow_direct]
    full = files.where(F.col("leaf").isin(wanted) & F.col("folder").isin(*FOLDERS)).groupBy("leaf").agg(F.count_distinct("folder").alias("n"))
    found = {r["leaf"] for r in full.where(F.col("n") == len(FOLDERS)).collect()}  # two folders at most
    for leaf in wanted:
        if leaf in found:
            return leaf
    raise ValueError(f"no folder with {', '.join(FOLDERS)} for {split} below {root}")


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as listings give it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def discover_triplets(spark: SparkSession, path: str, split: str, dataset: str, allow_direct: bool = True, layout: str = "mri") -> DataFrame:
    """(sample_id, dataset, split, image_path, seg_path, graph_path) of one split, ordered by id.

    Every image is a sample, so one stored with both ends of its layout is two; its mask must have the same end.
    An image without both partners raises with its name, and so does a folder without images."""
    files = listing(spark, path)
    leaf = resolve_split(files, path, split, allow_direct)
    end = "|".join(e.replace(".", r"\.") for e in LAYOUTS[layout])
    files = files.where(F.col("leaf") == leaf)
    side = lambda kind, folder, name: files.where((F.col("folder") == folder) & F.col("file").rlike(name)).select(F.regexp_extract("file", name, 1).alias("sample_id"), F.regexp_extract("file", name, 2).alias("end"), F.col("path").alias(f"{kind}_path"))
    image, seg, graph = side("image", "raw", f"^(.+)_data({end})$"), side("seg", "seg", f"^(.+)_seg({end})$"), side("graph", "vtp", r"^(.+)_graph(\.vtp)$").drop("end")
    found = image.join(seg, ["sample_id", "end"], "left").join(graph, "sample_id", "left")
    lost = [r[0] for r in found.where("seg_path is null or graph_path is null").select("sample_id").orderBy("sample_id").limit(20).collect()]
    if lost:
        raise ValueError(f"Incomplete sample: {', '.join(lost)}")
    if not found.limit(1).count():
        raise ValueError(f"no {layout} images in {leaf}/raw")
    return found.select("sample_id", F.lit(dataset).alias("dataset"), F.lit(split.strip().lower()).alias("split"), "image_path", "seg_path", "graph_path").orderBy("sample_id", "image_path")


# NIfTI-1 data types.
_NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def _nifti(content: bytes) -> np.ndarray:
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    dim, kind = struct.unpack_from(order + "8h", raw, 40), struct.unpack_from(order + "h", raw, 70)[0]
    offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    shape = tuple(dim[1:4])
    data = np.frombuffer(raw, order + _NIFTI_TYPES[kind], int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(float)
    return data * slope + inter if slope else data


def encode_nifti(volumes: DataFrame) -> DataFrame:
    """(path, content) of NIfTI-1 files of doubles from (path, shape, data)."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = []
            for shape, data in zip(frame["shape"], frame["data"]):
                sides = [int(shape[a]) for a in "dhw"]
                head = bytearray(352)
                struct.pack_into("<i", head, 0, 348)
                struct.pack_into("<8h", head, 40, 3, *sides, 1, 1, 1, 1)
                struct.pack_into("<2h", head, 70, 64, 64)
                struct.pack_into("<3f", head, 108, 352, 1, 0)
                head[344:348] = b"n+1\0"
                contents.append(bytes(head) + np.asarray(data, "<f8").reshape(sides).tobytes(order="F"))
            yield pd.DataFrame({"path": frame["path"], "content": contents})

    return volumes.select("path", "shape", "data").mapInPandas(encode, "path string, content binary")


def write_files(rows: DataFrame, root: str) -> int:
    """Write (path, content) as files of their own below root, a path or URL that Arrow's file systems reach; returns their number.

    A task that is run again writes the same files again."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        made = set()
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


#: Channels by PNG colour type: grey, RGB, grey and alpha, RGB and alpha.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _png(content: bytes) -> np.ndarray:
    """PNG without interlacing as grey (h, w, 1): 8 bits of any channels, or 16 bits of grey."""
    at, packed, head = 8, b"", None
    while at < len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if name == b"IHDR" else head
        packed += body if name == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if colour not in _CHANNELS or depth not in (8, 16) or depth == 16 and colour or interlace:
        raise ValueError("a PNG file must have 8 bits a channel or 16 bits of grey, and no interlacing")
    unit = _CHANNELS[colour] * depth // 8
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width * unit + 1)
    x = _unfiltered(lines[:, 0], lines[:, 1:].reshape(height, width, unit))
    if depth == 16:
        grey = x[:, :, 0] * 256 + x[:, :, 1]
    elif unit <= 2:
        grey = x[:, :, 0]
    else:  # luma in 16-bit fixed point
        grey = (x[:, :, 0] * 19595 + x[:, :, 1] * 38470 + x[:, :, 2] * 7471 + 32768) >> 16
    return grey.astype(float)[:, :, None]


def _unfiltered(kinds: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Pixels (h, w, bytes) without the filters of their lines, as integers.

    A pixel depends on those to its left and above, so diagonals are computed one after another, each at once."""
    height, width, unit = pixels.shape
    out = np.zeros((height + 1, width + 1, unit), np.int64)  # a border of zeros
    if not kinds.any():
        out[1:, 1:] = pixels
        return out[1:, 1:]
    if kinds.max() <= 2:  # nothing, left or above: a line at a time
        for y, kind in enumerate(kinds):
            out[y + 1, 1:] = pixels[y] if kind == 0 else np.cumsum(pixels[y], 0, np.int64) & 255 if kind == 1 else (pixels[y] + out[y, 1:]) & 255
        return out[1:, 1:]
    kinds = kinds[:, None]
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x, kind = diagonal - y, kinds[y]
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        nearest = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
        guess = np.choose(kind, [np.zeros_like(a), a, b, (a + b) // 2, nearest])
        out[y + 1, x + 1] = (pixels[y, x] + guess) & 255
    return out[1:, 1:]


def encode_png(images: DataFrame) -> DataFrame:
    """(path, content) of 8-bit grey PNG files from (path, shape, data) with one slice and whole values."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = []
            for shape, data in zip(frame["shape"], frame["data"]):
                grey = np.asarray(data).astype(np.uint8).reshape(int(shape["d"]), int(shape["h"]))
                lines = np.zeros((grey.shape[0], grey.shape[1] + 1), np.uint8)
                lines[:, 0], lines[:, 1:] = 2, np.diff(grey, axis=0, prepend=np.zeros((1, grey.shape[1]), np.uint8))
                head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
                contents.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))
            yield pd.DataFrame({"path": frame["path"], "content": contents})

    return images.select("path", "shape", "data").mapInPandas(encode, "path string, content binary")


#: Listings of up to so many files are broadcast to the reading tasks.
SMALL_LISTING = 100_000
#: Folders that are listed by name; of more, all below their common one are listed.
MOST_FOLDERS = 1_000


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of sample_id, path, about READ_BYTES at a time."""
    for frame in frames:
        some, size = [], 0
        for sample, path in zip(frame["sample_id"], frame["path"]):
            system, place = _store(path)
            with system.open_input_stream(place, compression=None) as file:
                some.append((sample, path, file.read()))
            size += len(some[-1][2])
            if size >= READ_BYTES:
                yield pd.DataFrame(some, columns=["sample_id", "path", "content"])
                some, size = [], 0
        if some:
            yield pd.DataFrame(some, columns=["sample_id", "path", "content"])


def _decoded(spark: SparkSession, samples: DataFrame, column: str, decode: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """`decode` applied to frames (sample_id, path, content) of a column of paths; tasks of FILES files read them where they can."""
    wanted = written(samples.select("sample_id", F.col(column).alias("path")), "paths")
    if wanted.where(~_direct(F.col("path"))).limit(1).count():
        return _contents(spark, wanted, "path").mapInPandas(decode, schema)
    return dealt(wanted, "path", rows=FILES, least=100).mapInPandas(lambda frames: decode(_read(frames)), schema)


def _contents(spark: SparkSession, samples: DataFrame, column: str) -> DataFrame:
    """(sample_id, path, content) of a column of paths, read by Spark.

    A counted short listing is broadcast, so contents stay where they are read; a long one is dealt out by
    path, each task then meets its own files only."""
    wanted = samples.select("sample_id", F.col(column).alias("path"))
    folder = wanted.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    folders = [r[0] for r in folder.limit(MOST_FOLDERS + 1).collect()]
    if len(folders) > MOST_FOLDERS:  # a folder a sample, say: all lie below what the first and the last have in common
        folders = [os.path.commonprefix(list(folder.agg(F.min("folder"), F.max("folder")).first())).rpartition("/")[0]]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(len(folders) == 1).lower())
    files = reader.load(folders).select("path", "content") if folders else wanted.select("path", F.lit(None).cast("binary").alias("content"))
    few = wanted.limit(SMALL_LISTING + 1).count() <= SMALL_LISTING
    return files.join(F.broadcast(wanted) if few else wanted, "path")


def load_volumes(spark: SparkSession, samples: DataFrame, column: str = "image_path", kind: str = "image") -> DataFrame:
    """Packed volumes of a column of paths."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made, held = [], 0
            for sample, path, content in zip(frame["sample_id"], frame["path"], frame["content"]):
                x = _png(content) if path.endswith(".png") else _nifti(content)
                made.append((sample, kind, dict(zip("dhw", map(int, x.shape))), x.ravel()))
                held += x.size
                if held >= BATCH_VALUES:
                    yield pd.DataFrame(made, columns=names)
                    made, held = [], 0
            if made:
                yield pd.DataFrame(made, columns=names)

    names = ["sample_id", "kind", "shape", "data"]
    return _decoded(spark, samples, column, decode, VOLUME)


def _vtp(content: bytes) -> tuple[list[float], list[int]]:
    """Flat point coordinates and flat line cells (2, a, b, ...) of a VTP file (ascii or inline base64)."""
    root = ET.fromstring(content)
    wide = "Q" if root.get("header_type") == "UInt64" else "I"
    kinds = {"Float32": "f4", "Float64": "f8", "Int32": "i4", "Int64": "i8"}

    def values(array: ET.Element) -> np.ndarray:
        if array.get("format") == "ascii":
            return np.array((array.text or "").split(), float)
        raw = base64.b64decode((array.text or "").strip())
        return np.frombuffer(raw, "<" + kinds[array.get("type")], offset=struct.calcsize(wide)).astype(float)

    points = values(root.find(".//Points/DataArray"))
    named = {a.get("Name"): values(a) for a in root.findall(".//Lines/DataArray")}
    flat, start = [], 0
    for end in named.get("offsets", np.zeros(0)).astype(int):
        cell = named["connectivity"][start:end].astype(int).tolist()
        flat += [len(cell), *cell]
        start = end
    return points.tolist(), flat


def load_graphs(spark: SparkSession, samples: DataFrame, column: str = "graph_path") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a column of VTP paths."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [_vtp(c) for c in frame["content"]]
            yield pd.DataFrame({"sample_id": frame["sample_id"], "points": [p for p, _ in both], "cells": [c for _, c in both]})

    packed = _decoded(spark, samples, column, decode, "sample_id string, points array<double>, cells array<int>")
    p = F.col("points")
    triple = F.transform(F.sequence(F.lit(0), F.floor(F.size("points") / 3).cast("int") - 1), lambda i: F.struct(i.alias("node_id"), *[F.get(p, i * 3 + k).alias(a) for k, a in enumerate("dhw")]))
    nodes = packed.where(F.size("points") > 0).select("sample_id", F.inline(triple))
    return nodes, decode_line_cells(packed.select("sample_id", "cells"))


def line_cells(cells: Column) -> Column:
    """Array of (src, dst) from flat cells [2, a, b, 2, c, d, ...]; anything else raises."""
    n = F.size(cells)
    heads = F.filter(cells, lambda x, i: i % 3 == 0)
    wrong = (n % 3 != 0) | F.exists(heads, lambda x: x != 2)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1), lambda i: F.struct(F.get(cells, i * 3 + 1).alias("src"), F.get(cells, i * 3 + 2).alias("dst")))
    empty = F.array().cast("array<struct<src:int,dst:int>>")
    return F.when(n == 0, empty).when(wrong, F.raise_error(F.lit("cells must be lines of two points")).cast("array<struct<src:int,dst:int>>")).otherwise(pairs)


def decode_line_cells(flat: DataFrame) -> DataFrame:
    """(sample_id, src, dst) from (sample_id, cells)."""
    return flat.select("sample_id", F.inline(line_cells(F.col("cells"))))


def select_evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at round(i (n - 1) / (k - 1)), half to even; all rows if k >= n, the first if k = 1."""
    if k <= 0:
        raise ValueError("k must be positive")
    placed = with_position(df, order)
    if k == 1:
        return placed.where("position = 0").drop("position", "total")
    # Row p is chosen when some i below k rounds to it: only the two i around p (k - 1) / (n - 1) can.
    steps = F.greatest(F.col("total") - 1, F.lit(1))
    near = F.floor(F.col("position") * (k - 1) / steps)
    hits = [(F.rint(i * (F.col("total") - 1) / (k - 1)) == F.col("position")) & i.between(0, k - 1) for i in (near - 1, near, near + 1, near + 2)]
    chosen = hits[0] | hits[1] | hits[2] | hits[3] | (F.col("total") <= k)
    return placed.where(chosen).drop("position", "total")


def cap_samples(samples: DataFrame, n: int | None) -> DataFrame:
    """The first n samples by id; None keeps all."""
    if n is None:
        return samples
    if n <= 0:
        raise ValueError("the cap must be positive")
    return samples.orderBy("sample_id").limit(n)


def _defined(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c))


def write_predictions(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object per sample: nodes, edges and metrics; compression: a codec of Spark's JSON files."""
    n = nodes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("node_id", *[c for c in nodes.columns if c not in ("sample_id", "node_id")]))).alias("nodes"))
    e = edges.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "score"))).alias("edges"))
    m = metrics.select("sample_id", F.struct(*[_defined(c).alias(c) for c in sorted(metrics.columns) if c != "sample_id"]).alias("metrics"))
    m.join(n, "sample_id", "left").join(e, "sample_id", "left").write.option("ignoreNullFields", "false").option("compression", compression).json(path)


def write_per_sample_metrics(metrics: DataFrame, path: str, ids: tuple[str, ...] = ("sample_id",)) -> None:
    """CSV: id columns, then metrics by name; undefined values are empty."""
    rest = sorted(c for c in metrics.columns if c not in ids)
    metrics.select(*ids, *[_defined(c).alias(c) for c in rest]).write.option("header", "true").csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON object with sorted keys from a one-row table."""
    body = F.to_json(F.struct(*[_defined(c).alias(c) if t == "double" else F.col(c) for c, t in sorted(summary.dtypes)]), {"ignoreNullFields": "false"})
    summary.select(body.alias("value")).coalesce(1).write.text(path)


def append_metric_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_metric_history(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """The rows of a growing folder; as a stream, at most files_per_batch new files a batch."""
    if not stream:
        return spark.read.schema(METRICS).json(path)
    reader = spark.readStream.schema(METRICS)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def checksum_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder, ordered by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")
