"""Documents to page rasters: images by Spark's decoder, PDF by a pluggable renderer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackendError, DecodeError, PreprocessError
from ..operators.preprocess import rgb_of
from ..options import FORM_MAX_PAGES, PDF_DPI, LoadOptions
from .decode import Decoder, decode_image
from .png import encode_png

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

PNG_PAGE = pa.schema([("path", pa.string()), ("page_index", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("png_data", pa.binary())])

#: A renderer gives (width, height, RGB bytes) for each of the first pages of a PDF.
Renderer = Callable[[bytes, int, float], Iterator[tuple[int, int, bytes]]]


def extension_of(path: Column) -> Column:
    """What follows the last dot of the file name; empty for none or for a leading dot alone."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+\.([^.]*)$", 1)


def is_pdf(path: Column) -> Column:
    return F.lower(extension_of(path)) == "pdf"


def file_kind(name: Column, mime: Column | None = None, strict: bool = False) -> Column:
    """``image``, ``pdf``, or null (an error if ``strict``); the image test comes first."""
    mime = F.lit("") if mime is None else F.coalesce(mime, F.lit(""))
    low = F.lower(name)
    other = F.raise_error(F.lit("unsupported file type")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(mime.startswith("image/") | low.rlike(r"\.(png|jpe?g|webp)$"), "image").when((mime == "application/pdf") | low.endswith(".pdf"), "pdf").otherwise(other)


def no_renderer(content: bytes, max_pages: int, dpi: float) -> Iterator[tuple[int, int, bytes]]:
    raise BackendError("no PDF renderer is installed; pass one to load_pages")


def page_batch(path: str | None, page_index: int, width: int, height: int, rgb: bytes) -> pa.RecordBatch:
    """One page row of RGB bytes, in the layout of Spark's image source (BGR)."""
    kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
    bgr = bytearray(len(rgb))
    bgr[0::3], bgr[1::3], bgr[2::3] = rgb[2::3], rgb[1::3], rgb[0::3]
    image = {"origin": path, "height": height, "width": width, "nChannels": 3, "mode": 16, "data": bytes(bgr)}
    return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([page_index], pa.int32()), pa.array([image], kind)], names=["path", "page_index", "image"])


def render_pdfs(files: DataFrame, options: LoadOptions, renderer: Renderer) -> DataFrame:
    """Pages ``(path, page_index, image)`` of PDF files ``(path, content)``, in order."""
    options.check()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, (w, h, rgb) in enumerate(renderer(content, options.max_pages, options.pdf_dpi)):
                    if at >= options.max_pages:
                        break
                    yield page_batch(path, at, w, h, rgb)

    return files.select("path", "content").mapInArrow(run, f"path string, page_index int, image {IMAGE}")


def render_png_pages(files: DataFrame, renderer: Renderer, max_pages: int = FORM_MAX_PAGES, dpi: float = PDF_DPI) -> DataFrame:
    """Pages ``(path, page_index, width, height, png_data)`` of PDF files ``(path, content)``."""
    if max_pages == 0:
        raise ValueError("max_pages must be greater than 0")
    if dpi <= 0:
        raise ValueError("dpi must be greater than 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(*(c.to_pylist() for c in batch.columns))
            rows = [(path, at, x["width"], x["height"], encode_png(x["width"], x["height"], 3, rgb_of(x["height"], x["width"], 3, x["data"]).tobytes())) for path, at, x in pages]
            yield pa.RecordBatch.from_pylist([dict(zip(PNG_PAGE.names, r)) for r in rows], PNG_PAGE)

    pages = render_pdfs(files, LoadOptions(max_pages, dpi), renderer)
    return pages.mapInArrow(run, "path string, page_index int, width int, height int, png_data binary")


def decode_images(files: DataFrame, decoder: Decoder = decode_image) -> DataFrame:
    """One page of index 0 for each row ``(path, content)`` of image bytes, told apart by content.

    Bytes that no decoder reads, and null ones, are an error that names the path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rgb = decoder(content or b"")
                except DecodeError as error:
                    raise PreprocessError(f"failed to open image {path}: {error}") from error
                yield page_batch(path, 0, rgb.shape[1], rgb.shape[0], rgb.tobytes())

    return files.select("path", "content").mapInArrow(run, f"path string, page_index int, image {IMAGE}")


def form_pages(files: DataFrame, decoder: Decoder = decode_image) -> DataFrame:
    """An image file as the form's only page: ``(page_index, width, height, source)`` of its natural size and file name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return decode_images(files, decoder).select("page_index", F.col("image.width").alias("width"), F.col("image.height").alias("height"), name.alias("source"))


def load_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One page of index 0 for each image file; unreadable files have a null size until used."""
    images = spark.read.format("image").option("dropInvalid", False).load(paths)
    return images.select(F.col("image.origin").alias("path"), F.lit(0).alias("page_index"), "image")


def load_pages(spark: SparkSession, paths: str | list[str], options: LoadOptions = LoadOptions(), renderer: Renderer = no_renderer) -> DataFrame:
    """All pages of files or folders, by file ending: PDF files are rendered, all others are images."""
    options.check()
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise PreprocessError("no input path")
    one = _one_file(spark, paths)
    pdfs = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(paths).where(is_pdf(F.col("path")))
    if one is not None and not one.lower().endswith(".pdf"):
        return load_images(spark, paths)
    rendered = render_pdfs(pdfs, options, renderer)
    return rendered if one is not None else load_images(spark, paths).where(~is_pdf(F.col("path"))).unionByName(rendered)


def _one_file(spark: SparkSession, paths: list[str]) -> str | None:
    """The name of the only file that the paths stand for; null for folders and several files."""
    if len(paths) != 1:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found[0].getPath().getName() if found is not None and len(found) == 1 and found[0].isFile() else None


def limited(pages: DataFrame, max_pages: int, document: str = "doc_id", index: str = "page_index") -> DataFrame:
    """The first pages of each document; a filter on the index, not a sort."""
    if max_pages == 0:
        raise PreprocessError("max_pages must be greater than 0")
    return pages.where(F.col(index) < max_pages)
