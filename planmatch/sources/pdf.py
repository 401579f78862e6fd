"""Plan sets as files: checks on bytes in expressions; pages and words by an optional parser, each file parsed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.functions.values import coverage

MAX_MB = 500
WORD = "struct<text:string,x0:double,y0:double,x1:double,y1:double,block_number:int,line_number:int,word_number:int>"
CONTENT = f"doc_id string, page_number int, page_index int, width_points double, height_points double, embedded_word_count int, image_boxes array<array<double>>, words array<{WORD}>"
_WORD = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), *((c, pa.int32()) for c in ("block_number", "line_number", "word_number"))])
_CONTENT = pa.schema(
    [("doc_id", pa.string()), ("page_number", pa.int32()), ("page_index", pa.int32()), ("width_points", pa.float64()), ("height_points", pa.float64()), ("embedded_word_count", pa.int32()), ("image_boxes", pa.list_(pa.list_(pa.float64()))), ("words", pa.list_(_WORD))]
)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of the files below ``path``; ``readStream`` over the same format takes arrivals.

    Spark leaves out files without a byte, so that the check for them is for tables from elsewhere.
    """
    return spark.read.format("binaryFile").load(path)


def validated(rows: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    """``rows`` (path, length, content) with the first check that fails as ``error``. Only the head of the content is looked at."""
    name = F.element_at(F.split("path", "/"), -1)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    error = (
        F.when(~F.lower(name).endswith(".pdf"), F.concat(F.lit("the file must have a .pdf extension: "), name)).when(F.col("length") == 0, F.concat(F.lit("the PDF is empty: "), name))
        .when(F.col("length") > max_mb * 1024 * 1024, F.format_string(f"the PDF is %.2f MB; at most {max_mb} MB are allowed", F.col("length") / (1024.0 * 1024.0)))
        .when(F.instr(head, "%PDF-") == 0, F.concat(F.lit("no valid PDF header: "), name))
    )
    return rows.withColumn("error", error)


def parser():
    """The PDF library, which may be absent."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF content needs the package pymupdf; give pages and words as tables instead") from e
    return pymupdf


def fault(library, content: bytes, name: str) -> str | None:
    """The first check of an opened file that fails."""
    try:
        with library.open(stream=content, filetype="pdf") as document:
            if not document.is_pdf:
                return f"the file isn't recognised as a PDF: {name}"
            if document.needs_pass:
                return f"the PDF is password protected: {name}"
            if document.page_count == 0:
                return f"the PDF has no pages: {name}"
            if document.load_page(0).rect.get_area() <= 0:
                return f"the first page has invalid dimensions: {name}"
    except Exception:  # whatever the library raises means the same to the caller
        return f"the PDF could not be opened or is damaged: {name}"
    return None


def opened(rows: DataFrame, load: Callable = parser) -> DataFrame:
    """Validated ``rows`` with the checks that need a parser added to ``error``; ``load`` gives the library, once a task."""
    schema = rows.schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load()
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            found = [e if e is not None else fault(library, c, p.rsplit("/", 1)[-1]) for e, c, p in zip(*(columns[n].to_pylist() for n in ("error", "content", "path")))]
            columns["error"] = pa.array(found, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(go, schema)


def page_rows(library, path: str, data: bytes) -> Iterator[tuple]:
    """CONTENT of each page of one file."""
    with library.open(stream=data, filetype="pdf") as document:
        for i, page in enumerate(document):
            words = page.get_text("words", sort=False)
            boxes = [list(map(float, x["bbox"])) for x in page.get_image_info() if x.get("bbox") is not None]
            kept = [dict(zip(_WORD.names, (w[4], *map(float, w[:4]), *w[5:8]))) for w in words if len(w) >= 8 and w[4].strip()]
            yield path, i + 1, i, float(page.rect.width), float(page.rect.height), len(words), boxes, kept


def content(rows: DataFrame, load: Callable = parser, faults: bool = False) -> DataFrame:
    """A row for each page of files without an error, with its words and the boxes of its images. ``faults``: what goes wrong in a file is a row of it with an
    ``error`` and without a page, in place of an error of the task; pages before it stay."""
    schema = _CONTENT.append(pa.field("error", pa.string())) if faults else _CONTENT
    row_of = lambda row: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load()
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    for row in page_rows(library, path, data):
                        yield row_of((*row, None) if faults else row)
                except Exception as e:
                    if not faults:
                        raise
                    yield row_of((path, *[None] * (len(schema) - 2), f"Unexpected error: {e}"))

    # a row at a time, as a file may have hundreds of megabytes
    return rows.filter("error is null").select("path", "content").mapInArrow(go, CONTENT + (", error string" if faults else ""))


def pages(content: DataFrame) -> DataFrame:
    """Page rows as ``operators.pages.inspect`` takes them."""
    area = F.col("width_points") * F.col("height_points")
    return content.select(
        "doc_id", "page_number", "page_index", "width_points", "height_points", "embedded_word_count", F.size("image_boxes").alias("image_count"), coverage(F.col("image_boxes"), area).alias("largest_image_coverage")
    )


def words(content: DataFrame) -> DataFrame:
    """Word rows as ``operators.native.words`` takes them."""
    return content.select("doc_id", "page_number", "page_index", F.explode("words").alias("w")).select("doc_id", "page_number", "page_index", "w.*")
