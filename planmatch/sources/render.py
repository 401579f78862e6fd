"""Images of pages and tiles: drawn by an optional library, one opening of a file for all its images, with a record for each."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.functions.values import render_scale
from planmatch.sources.pdf import parser

RECORD = (
    "doc_id string, page_number int, page_index int, render_kind string, image_path string, dpi int, pixel_width int, pixel_height int, pdf_bbox array<double>, tile_index int, tile_row int, tile_column int, image binary"
)
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_RECORD = pa.schema([(c.split()[0], k) for c, k in zip(RECORD.split(", "), _KINDS)])


def previews(selections: DataFrame, dpi: int = 110) -> DataFrame:
    """What is to be drawn of selected pages (doc_id, page_number, page_index): the whole page."""
    none = F.lit(None).cast("int")
    path = F.format_string("page_%04d_preview.png", "page_number")
    return selections.select("doc_id", "page_number", "page_index", F.lit("preview").alias("render_kind"), path.alias("image_path"), F.lit(dpi).alias("dpi"), F.lit(None).cast("array<double>").alias("pdf_bbox"), *(none.alias(c) for c in ("tile_index", "tile_row", "tile_column")))


def tiles(grid: DataFrame, dpi: int = 225) -> DataFrame:
    """What is to be drawn of the tiles of a grid (doc_id, page_number, page_index, tile_*, pdf_bbox)."""
    path = F.format_string("page_%04d/tile_%04d_r%02d_c%02d.png", "page_number", "tile_index", "tile_row", "tile_column")
    return grid.select("doc_id", "page_number", "page_index", F.lit("tile").alias("render_kind"), path.alias("image_path"), F.lit(dpi).alias("dpi"), "pdf_bbox", "tile_index", "tile_row", "tile_column")


def drawn(wanted: DataFrame, files: DataFrame, load: Callable = parser) -> DataFrame:
    """RECORD for each image of ``wanted``, with its bytes. ``files``: doc_id, content; ``load`` gives the library, once a group.

    A group is one file and what is wanted of it: a file is read and opened once, however many images it gives. All images of a file are one table, 2 GB at most.
    """
    names = ["page_number", "page_index", "render_kind", "image_path", "dpi", "pdf_bbox", "tile_index", "tile_row", "tile_column"]

    def go(boxes: pa.Table, given: pa.Table) -> pa.Table:
        rows = []
        if given.num_rows and boxes.num_rows:
            library = load()
            with library.open(stream=given.column("content")[0].as_py(), filetype="pdf") as document:
                for doc, page_number, index, kind, path, dpi, box, *tile in zip(*(boxes.column(c).to_pylist() for c in ("doc_id", *names))):
                    page = document.load_page(index)
                    scale = render_scale(dpi)
                    clip = {"clip": library.Rect(*box)} if box else {}
                    image = page.get_pixmap(matrix=library.Matrix(scale, scale), colorspace=library.csRGB, alpha=False, annots=True, **clip)
                    area = box or [page.rect.x0, page.rect.y0, page.rect.x1, page.rect.y1]
                    rows.append((doc, page_number, index, kind, path, dpi, image.width, image.height, [round(float(v), 3) for v in area], *tile, image.tobytes("png")))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)] if rows else [pa.array([], t) for t in _KINDS], schema=_RECORD)

    return wanted.groupBy("doc_id").cogroup(files.select("doc_id", "content").groupBy("doc_id")).applyInArrow(go, RECORD)


def summary(selections: DataFrame, images: DataFrame) -> DataFrame:
    """Counts of what was selected and drawn, by document."""
    kind = lambda k: F.count_if(F.col("render_kind") == k)
    own = images.groupBy("doc_id").agg(kind("preview").alias("preview_count"), kind("tile").alias("tile_count"))
    out = selections.groupBy("doc_id").agg(F.count("*").alias("selected_page_count")).join(own, "doc_id", "left")
    return out.select("doc_id", "selected_page_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("preview_count", "tile_count")))
