"""Layered documents as Spark tables and files.

* ``spark.read.format("psd").option("table", "layers").load(folder)``: a Python data source over any file system that
  the path names (local, or by its URI); files are packed into partitions by size, equality on ``path`` is pushed down to
  the file list. Of each file only the ranges that the table needs are read; ``.option("pixels", "false")`` leaves out
  the data of channels and composites.
* :func:`tables` parses a ``BINARY`` column, such as the ``content`` of ``binaryFile`` on any Hadoop file system;
  :func:`all_tables` parses it once for several tables.
* :func:`assemble` builds the bytes of documents from tables; ``df.write.format("psd").save(folder)`` writes rows of
  (path, content) as files, renamed into place when all tasks are done.

A file that can't be parsed gives a row in ``documents`` with the error, and no rows elsewhere; it never fails the job.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from strata.functions.binio import Ranged, Short
from strata.session import frames, stored
from strata.sources import document

PARTITION_BYTES = 64 << 20
#: Rows and bytes of documents after which rows go on to Spark.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class Psd(DataSource):
    @classmethod
    def name(cls) -> str:
        return "psd"

    def schema(self) -> str:
        return document.SCHEMAS[self.options.get("table", "documents")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PsdReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PsdWriter(self.options)


class PsdReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.only = schema, options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value if self.only in (None, f.value) else ""
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, size = [], PARTITION_BYTES
        for p, n in sorted(_listed(self.options["path"])):
            if self.only is not None and p != self.only:
                continue
            if size + n > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(p)
            size += n
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        names, wanted = self.schema.fieldNames(), self.options.get("table", "documents")
        pixels = str(self.options.get("pixels", "true")).lower() != "false"
        for p in partition.paths:
            with _opened(p) as f:
                rows = document.read(p, Ranged(lambda n, at: f.read_at(n, at), f.size()), {wanted}, pixels)[wanted]
            for r in rows:
                yield _tuple(r, names, self.schema)


def _on(path: str):
    """(file system, path within it) of a path or URI; "memory" of paths is what the URI says before them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _listed(path: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files of a folder, a file or a pattern; hidden ones are left out. URIs keep what is in front of their paths."""
    import fnmatch

    from pyarrow import fs

    path = path.removeprefix("file://")
    magic = next((k for k, c in enumerate(path) if c in "*?["), None)
    top = path if magic is None else path[: path.rfind("/", 0, magic)] or "/"
    on, at = _on(top)
    front = top[: len(top) - len(at)] if "://" in top and top.endswith(at) else ""
    info = on.get_file_info(at)
    found = on.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    for f in found:
        if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (magic is None or fnmatch.fnmatch(front + f.path, path)):
            yield front + f.path, f.size


def _opened(path: str):
    on, at = _on(path)
    return on.open_input_file(at)


def _tuple(row: dict, names: list[str], schema: StructType) -> tuple:
    return tuple(_value(row.get(n), schema[n].dataType) for n in names)


def _value(v, kind):
    if isinstance(v, dict):
        return Row(*[f.name for f in kind.fields])(*[v.get(f.name) for f in kind.fields])
    return v


class PsdWriter(DataSourceWriter):
    """Files under a hidden name per task, renamed at commit; a task that is tried again writes others.

    A file is named after its path with everything but letters, digits and ``. - _`` escaped, so that different paths
    give different files; a path that comes twice fails the write.
    """

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for r in rows:
            name = urllib.parse.quote(r["path"], safe="")
            hidden = os.path.join(self.folder, f".{uuid.uuid4().hex}")
            with open(hidden, "wb") as f:
                f.write(r["content"])
            files.append((hidden, os.path.join(self.folder, name)))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two rows have the same path")
        for hidden, name in files:
            os.replace(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, _ in m.files if m else ():
                if os.path.exists(hidden):
                    os.remove(hidden)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Psd)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _rows_of(table: str) -> StructType:
    return _parse_datatype_string(document.SCHEMAS[table])


def _arrow(schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tables(files: DataFrame, table: str, path: str = "path", content: str = "content", pixels: bool = True) -> DataFrame:
    """One table of the documents in a binary column."""
    schema = _rows_of(table)

    def run(batches):
        import pyarrow as pa

        form = _arrow(schema)
        rows, size = [], 0
        for b in batches:
            for p, c in zip(b["p"].to_pylist(), b["c"]):
                if c.is_valid:
                    rows += document.read(p, memoryview(c.as_buffer()), {table}, pixels)[table]
                    size += len(c.as_buffer())
                if rows and (len(rows) >= BATCH_ROWS or size >= BATCH_BYTES):
                    yield pa.RecordBatch.from_pylist(rows, form)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, form)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, schema)


def parsed(files: DataFrame, names: Iterable[str], path: str = "path", content: str = "content", pixels: bool = True) -> DataFrame:
    """(path, one array of rows per table): each document parsed once."""
    names = list(names)
    schema = StructType([StructField("path", _rows_of("documents")["path"].dataType), *[StructField(t, ArrayType(StructType(_rows_of(t).fields[1:]))) for t in names]])

    def run(batches):
        import pyarrow as pa

        form = _arrow(schema)
        for b in batches:
            for p, c in zip(b["p"].to_pylist(), b["c"]):
                if c.is_valid:
                    rows = document.read(p, memoryview(c.as_buffer()), names, pixels)
                    yield pa.RecordBatch.from_pylist([{"path": p} | {t: rows[t] for t in names}], form)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, schema)


#: What a document is written from, and what belongs to a layer of it.
WHOLE = ("documents", "layers", "channels", "resources", "document_blocks", "info_blocks")


def all_tables(files: DataFrame, names: Iterable[str] = WHOLE, **columns) -> dict[str, DataFrame]:
    """Several tables of the documents in a binary column, which is parsed once and kept in a columnar table: each table
    reads its own column of that."""
    names = list(names)
    held = stored(parsed(files, names, **columns))
    return {t: held.select("path", F.explode(t).alias("_x")).select("path", "_x.*") for t in names}


def rewritten(files: DataFrame, edit: Callable[[str, bytes], bytes], path: str = "path", content: str = "content") -> DataFrame:
    """(path, content): each document passed through ``edit`` (path, content) where it lies, for edits that need nothing but
    their document; what can't be parsed is left out, as :func:`assemble` does."""

    def run(batches):
        import pyarrow as pa

        form = pa.schema([("path", pa.string()), ("content", pa.binary())])
        out, size = [], 0
        for b in batches:
            for p, c in zip(b["p"].to_pylist(), b["c"]):
                if not c.is_valid:
                    continue
                try:
                    new = edit(p, c.as_py())
                except Short:
                    continue
                out.append({"path": p, "content": new})
                size += len(new)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, form)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, form)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, "path string, content binary")


_PARTS = {
    "layers": ["idx", "rect_top", "rect_left", "rect_bottom", "rect_right", "sig", "blend_key", "opacity", "clipping", "flag", "filler", "mask_raw", "ranges_raw", "name_raw", "extra", "dirty", "mask", "layer_type", "layer_id", "name_unicode", "fill_opacity", "sheet_color"],
    "channels": ["idx", "ch_pos", "ch_id", "compression", "data"],
    "resources": ["pos", "sig", "id", "name", "data"],
    "document_blocks": ["pos", "sig", "key", "size", "data", "padding"],
    "info_blocks": ["idx", "pos", "sig", "key", "data"],
}


def _build(batches):
    import pyarrow as pa

    for b in batches:
        for r in b.to_pylist():
            content = document.write(r["documents"], **{t: r[t] or [] for t in _PARTS})
            yield pa.RecordBatch.from_pylist([{"path": r["path"], "content": content}], pa.schema([("path", pa.string()), ("content", pa.binary())]))


def assemble(documents: DataFrame, layers: DataFrame, channels: DataFrame, resources: DataFrame, document_blocks: DataFrame, info_blocks: DataFrame | None = None) -> DataFrame:
    """(path, content): the bytes of each document. A document is one row here; the format bounds its size. The rows of all
    tables meet in one shuffle."""
    schemas = {t: _rows_of(t) for t in _PARTS}
    if info_blocks is None and "dirty" in layers.columns:
        layers = layers.withColumn("dirty", F.when(F.col("dirty"), F.raise_error(F.lit("an edited layer needs its info blocks"))).otherwise(F.col("dirty")))
    d = documents.where("error is null")
    pieces = d.select("path", F.struct(*[c for c in d.columns if c not in ("path", "error")]).alias("documents"))
    for t, df in (("layers", layers), ("channels", channels), ("resources", resources), ("document_blocks", document_blocks), ("info_blocks", info_blocks)):
        if df is not None:
            own = [(F.col(c) if c in df.columns else F.lit(None)).cast(schemas[t][c].dataType).alias(c) for c in _PARTS[t]]
            pieces = pieces.unionByName(df.select("path", F.struct(*own).alias(t)), allowMissingColumns=True)
    given = [t for t in _PARTS if t in pieces.columns]
    whole = pieces.groupBy("path").agg(F.first("documents", ignorenulls=True).alias("documents"), *[F.collect_list(t).alias(t) for t in given]).where("documents is not null")
    for t in set(_PARTS) - set(given):
        whole = whole.withColumn(t, F.lit(None).cast(ArrayType(StructType([schemas[t][c] for c in _PARTS[t]]))))
    return whole.mapInArrow(_build, "path string, content binary")


# --------------------------------------------------------------------------------------------------------------- images

_IMAGE = "path string, idx int, width int, height int, bgra binary"


def _planes(chans, depth: int, mode: int, width: int, height: int, ids) -> dict:
    from strata.functions import codec, image

    return {c["ch_id"]: image.samples(codec.decode_plane(c["compression"], bytes(c["data"]), width, height, depth), width, height, depth, mode == 4) for c in chans if c["ch_id"] in ids and c["compression"] is not None}


def _images(mode: str):
    def run(batches):
        import numpy as np

        from strata.functions import codec, image

        for b in batches:
            out = []
            for r in b.to_dict("records"):
                m = r["mask"]
                t, l, bo, ri = (int(r[f"rect_{k}"]) for k in ("top", "left", "bottom", "right"))
                masks = [c for c in r["chans"] if c["ch_id"] in (-2, -3) and c["compression"] is not None]
                plane = rect = None
                if m is not None and masks:
                    rect = tuple(int(m[f"rect_{k}"]) for k in ("top", "left", "bottom", "right"))
                    c = masks[-1]
                    if rect[2] > rect[0] and rect[3] > rect[1]:
                        plane = image.samples(codec.decode_plane(c["compression"], bytes(c["data"]), rect[3] - rect[1], rect[2] - rect[0], int(r["depth"])), rect[3] - rect[1], rect[2] - rect[0], int(r["depth"]))
                if mode == "mask":
                    if plane is not None:
                        out.append((r["path"], r["idx"], rect[3] - rect[1], rect[2] - rect[0], np.stack([plane] * 3 + [np.full_like(plane, 255)], axis=2).tobytes()))
                    continue
                planes = _planes(r["chans"], int(r["depth"]), int(r["mode"]), ri - l, bo - t, range(-1, 4))
                if not planes:
                    continue
                px = image.to_bgra(planes, int(r["mode"]), _palette_of(int(r["mode"]), r["color_data"]), int(r["depth"]))
                if mode == "masked" and plane is not None and -1 in planes:
                    px = image.masked(px, (t, l, bo, ri), plane, rect, int(m["default_color"]))
                out.append((r["path"], r["idx"], ri - l, bo - t, px.tobytes()))
            yield pd.DataFrame(out, columns=["path", "idx", "width", "height", "bgra"]).astype({"idx": "int32", "width": "int32", "height": "int32"})

    return run


def layer_images(documents: DataFrame, layers: DataFrame, channels: DataFrame, mode: str = "masked") -> DataFrame:
    """(path, idx, width, height, bgra) of each layer with pixels; mode image, mask or masked."""
    if mode not in ("image", "mask", "masked"):
        raise ValueError("mode must be image, mask or masked")
    wanted = {"image": "ch_id >= -1", "mask": "ch_id in (-2, -3)", "masked": "true"}[mode]
    chans = channels.where(wanted).groupBy("path", "idx").agg(F.array_sort(F.collect_list(F.struct("ch_pos", "ch_id", "compression", "data"))).alias("chans"))
    l = layers.where("rect_right > rect_left and rect_bottom > rect_top" if mode != "mask" else "mask is not null").select("path", "idx", "rect_top", "rect_left", "rect_bottom", "rect_right", "mask")
    d = documents.where("error is null").select("path", "depth", "mode", "color_data")
    return l.join(chans, ["path", "idx"]).join(d, "path").transform(frames, _images(mode), _IMAGE)


def layer_images_by_id(documents: DataFrame, layers: DataFrame, channels: DataFrame, ids: DataFrame, mode: str = "masked") -> DataFrame:
    """``ids`` (path, layer_id): the pictures of the lowest layers with these ids; an id that is not there gives none."""
    from strata.operators.layers import first_by_id

    named = first_by_id(layers).join(ids.select("path", "layer_id").distinct(), ["path", "layer_id"])
    return layer_images(documents, layers.join(named.select("path", "idx"), ["path", "idx"], "left_semi"), channels, mode)


def _palette_of(mode: int, raw):
    import numpy as np

    return np.frombuffer(bytes(raw)[:768], dtype=np.uint8).reshape(3, 256).T if mode == 2 and raw is not None and len(raw) >= 768 else None


def _merged(batches):
    from strata.functions import codec, image

    for b in batches:
        out = []
        for r in b.to_dict("records"):
            w, h, depth, mode, n = (int(r[k]) for k in ("width", "height", "depth", "mode", "channels"))
            planes = [image.samples(p, w, h, depth, mode == 4) for p in codec.composite_planes(bytes(r["composite"]), n, w, h, depth)]
            colors = {0: 1, 1: 1, 2: 1, 8: 1, 4: 4}.get(mode, 3)
            named = dict(enumerate(planes[:colors])) | ({-1: planes[colors]} if n > colors else {})
            out.append((r["path"], -1, w, h, image.to_bgra(named, mode, _palette_of(mode, r["color_data"]), depth).tobytes()))
        yield pd.DataFrame(out, columns=["path", "idx", "width", "height", "bgra"]).astype({"idx": "int32", "width": "int32", "height": "int32"})


def merged_images(documents: DataFrame) -> DataFrame:
    """The stored composite of each document."""
    return documents.where("error is null and length(composite) > 2").select("path", "width", "height", "depth", "mode", "channels", "color_data", "composite").transform(frames, _merged, _IMAGE)


def _fold(batches):
    import numpy as np

    from strata.functions import image

    for b in batches:
        out = []
        for r in b.to_dict("records"):
            canvas = np.zeros((int(r["height"]), int(r["width"]), 4))
            for x in sorted(r["parts"], key=lambda x: x["idx"]):
                image.over(canvas, np.frombuffer(bytes(x["bgra"]), dtype=np.uint8).reshape(x["height"], x["width"], 4), x["top"], x["left"], x["opacity"])
            out.append((r["path"], -1, int(r["width"]), int(r["height"]), image.flatten(canvas).tobytes()))
        yield pd.DataFrame(out, columns=["path", "idx", "width", "height", "bgra"]).astype({"idx": "int32", "width": "int32", "height": "int32"})


def composite(documents: DataFrame, layers: DataFrame, images: DataFrame, show: DataFrame | None = None) -> DataFrame:
    """Each document composed of its visible pixel layers, or of those in ``show`` (path, idx), from the lowest up."""
    l = layers.where("layer_type in ('NORMAL', 'TEXT', 'ADJUST', 'FILL')")
    l = l.join(show.select("path", "idx"), ["path", "idx"], "left_semi") if show is not None else l.where("flag & 2 = 0")
    parts = images.join(l.select("path", "idx", F.col("rect_top").alias("top"), F.col("rect_left").alias("left"), "opacity"), ["path", "idx"])
    each = parts.groupBy("path").agg(F.collect_list(F.struct("idx", "top", "left", "opacity", "width", "height", "bgra")).alias("parts"))
    return documents.where("error is null").select("path", "width", "height").join(each, "path").transform(frames, _fold, _IMAGE)


def _channel_rows(batches):
    for b in batches:
        rows = []
        for p, i, w, h, px in zip(b["path"], b["idx"], b["width"], b["height"], b["bgra"]):
            _, chans, _ = document.image_layer(int(i), "", 0, bytes(px), int(w), int(h))
            rows += [{"path": p, "length": len(c["data"]) + 2} | c for c in chans]
        yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in ("path", "idx", "ch_pos", "ch_id", "length", "compression", "data")})


def channel_rows(pictures: DataFrame, schema: StructType) -> DataFrame:
    """Channels of ``pictures`` (path, idx, width, height, bgra): alpha, red, green and blue, packed."""
    return pictures.select("path", "idx", "width", "height", "bgra").transform(frames, _channel_rows, schema)


def set_layer_pixels(layers: DataFrame, channels: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``new`` (path, idx, width, height, bgra): layers and channels with these pictures; mask channels are kept behind
    them, the upper left corner stays."""
    size = new.select("path", "idx", F.col("width").alias("_w"), F.col("height").alias("_h"))
    l = layers.join(size, ["path", "idx"], "left")
    hit = F.col("_w").isNotNull()
    l = l.withColumn("rect_right", F.when(hit, F.col("rect_left") + F.col("_w")).otherwise(F.col("rect_right"))).withColumn("rect_bottom", F.when(hit, F.col("rect_top") + F.col("_h")).otherwise(F.col("rect_bottom")))
    made = channel_rows(new, channels.schema)
    kept = channels.join(size.select("path", "idx"), ["path", "idx"], "left_anti").select(*channels.columns)
    masks = channels.where("ch_id < -1").join(size.select("path", "idx"), ["path", "idx"], "left_semi").withColumn("ch_pos", F.col("ch_pos") + 4).select(*channels.columns)
    return l.select(*layers.columns), kept.unionByName(masks).unionByName(made)


def _mask_rows(batches):
    for b in batches:
        rows = []
        for p, i, w, h, px in zip(b["path"], b["idx"], b["width"], b["height"], b["plane"]):
            c = document.mask_channel(int(i), 99, bytes(px), int(w), int(h))
            rows.append({"path": p, "length": len(c["data"]) + 2} | c)
        yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in ("path", "idx", "ch_pos", "ch_id", "length", "compression", "data")})


def set_mask_pixels(layers: DataFrame, channels: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``new`` (path, idx, top, left, width, height, plane): masks with these pictures and rectangles, made where there
    were none; such layers are written anew."""
    at = new.select("path", "idx", "top", "left", (F.col("top") + F.col("height")).alias("bottom"), (F.col("left") + F.col("width")).alias("right"), F.lit(True).alias("_hit"))
    l = layers.join(at, ["path", "idx"], "left")
    fields = dict(f.split(":") for f in document.SCHEMAS["layers"].split("mask struct<")[1].split(">")[0].split(","))
    rect = {f"rect_{c}": F.col(c) for c in ("top", "left", "bottom", "right")}
    value = F.struct(*[F.coalesce(rect.get(k, F.col(f"mask.{k}")), F.lit(0 if k in ("default_color", "flags") else None)).cast(t).alias(k) for k, t in fields.items()])
    l = l.withColumn("mask", F.when(F.col("_hit"), value).otherwise(F.col("mask"))).withColumn("dirty", F.coalesce("_hit", "dirty", F.lit(False)))
    made = new.select("path", "idx", "width", "height", "plane").transform(frames, _mask_rows, channels.schema)
    old = channels.join(new.select("path", "idx").withColumn("ch_id", F.lit(-2)), ["path", "idx", "ch_id"], "left_anti").select(*channels.columns)
    return l.select(*layers.columns), old.unionByName(made)


def set_composite(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (path, r, g, b): documents whose merged image is one colour."""

    def run(batches):
        from strata.functions import codec

        for b in batches:
            data = [codec.solid_composite([int(x) for x in c], int(w), int(h)) for *c, w, h in zip(b["r"], b["g"], b["b"], b["width"], b["height"])]
            yield pd.DataFrame({"path": b["path"], "_c": data})

    solid = documents.select("path", "width", "height").join(new, "path").transform(frames, run, "path string, _c binary")
    d = documents.join(solid, "path", "left")
    return d.withColumn("composite", F.coalesce("_c", "composite")).withColumn("channels", F.when(F.col("_c").isNotNull(), 3).otherwise(F.col("channels"))).select(*documents.columns)


def set_merged(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (path, bgra): documents whose merged image is this picture, as raw planes: red, green, blue, and alpha where the
    document has a fourth channel. Only 8-bit RGB documents take one, of their own size; others raise."""

    def run(batches):
        for b in batches:
            data = []
            for px, w, h, n, depth, mode in zip(b["bgra"], b["width"], b["height"], b["channels"], b["depth"], b["mode"]):
                px = bytes(px)
                if depth != 8 or mode != 3 or len(px) != 4 * w * h:
                    raise ValueError("the picture does not fit the document")
                data.append(b"\0\0" + b"".join(px[c::4] for c in (2, 1, 0, 3)[: min(4, max(3, n))]))
            yield pd.DataFrame({"path": b["path"], "_c": data})

    made = documents.select("path", "width", "height", "channels", "depth", "mode").join(new.select("path", "bgra"), "path").transform(frames, run, "path string, _c binary")
    d = documents.join(made, "path", "left").withColumn("composite", F.coalesce("_c", "composite"))
    return d.withColumn("channels", F.when(F.col("_c").isNotNull(), F.least(F.greatest("channels", F.lit(3)), F.lit(4))).otherwise(F.col("channels"))).select(*documents.columns)


def export_bmp(images: DataFrame) -> DataFrame:
    """(path, content): images as BMP files, named after their document and layer."""
    return _exported(images, "bmp")


def export_png(images: DataFrame) -> DataFrame:
    """(path, content): images as PNG files, named after their document and layer."""
    return _exported(images, "png")


def _exported(images: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        import numpy as np

        from strata.functions import image

        write = {"png": image.png, "bmp": image.bmp}[kind]
        for b in batches:
            name = [f"{p}.{'merged' if i < 0 else f'{i:04d}'}.{kind}" for p, i in zip(b["path"], b["idx"])]
            data = [write(np.frombuffer(bytes(x), dtype=np.uint8).reshape(h, w, 4)) for x, w, h in zip(b["bgra"], b["width"], b["height"])]
            yield pd.DataFrame({"path": name, "content": data})

    return images.transform(frames, run, "path string, content binary")


def bleed(images: DataFrame, passes: int = 8) -> DataFrame:
    """Images whose transparent pixels took the colours beside them."""

    def run(batches):
        import numpy as np

        from strata.functions import image

        for b in batches:
            yield b.assign(bgra=[image.bleed(np.frombuffer(bytes(x), dtype=np.uint8).reshape(h, w, 4), passes).tobytes() for x, w, h in zip(b["bgra"], b["width"], b["height"])])

    return images.transform(frames, run, _IMAGE)


def manifest(layers: DataFrame) -> DataFrame:
    """(path, json): one line of JSON per document with its layers from the lowest up."""
    item = F.struct("idx", F.coalesce("name_unicode", F.lit("")).alias("name"), "layer_type", "rect_left", "rect_top", "rect_right", "rect_bottom", "opacity", "blend_key")
    return layers.groupBy("path").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("layers"))).alias("json"))
