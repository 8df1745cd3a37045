import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.errors import DecodeError, PostprocessError
from quire.operators.detector import FakeDetector, OnnxDetector, detect
from quire.operators.preprocess import preprocess
from quire.options import FORM_MAX_PAGES, PreprocessOptions, read_batch_size, read_options, read_unit
from quire.plans.bytes_api import analyze_image_bytes, analyze_image_bytes_batch, observed
from quire.plans.layout import analyze_packed
from quire.sources.decode import decode_image, image_format
from quire.sources.documents import decode_images, form_pages, render_png_pages
from quire.sources.png import encode_png

SMALL = PreprocessOptions(8, 8)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth, color, raw, *more, interlaced=0):
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filtered(lines, step, kinds):
    """Rows of bytes with each row's prediction taken off, pixel by pixel."""
    out, above = b"", [0] * len(lines[0])
    for kind, line in zip(kinds, lines):
        row = [kind]
        for i, x in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            nearest = min((abs(a + b - c - v), k) for k, v in enumerate((a, b, c)))[1]
            row.append((x - (0, a, b, (a + b) // 2, (a, b, c)[nearest])[kind]) % 256)
        out, above = out + bytes(row), line
    return out


@pytest.mark.parametrize("channels, color", [(1, 0), (3, 2), (2, 4), (4, 6)])
def test_png_filters(channels, color):
    pixels = np.random.default_rng(channels).integers(0, 256, (10, 7, channels)).astype("u1")
    raw = filtered([line.ravel().tolist() for line in pixels], channels, [0, 1, 2, 3, 4] * 2)
    expected = np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]
    assert (decode_image(png(7, 10, 8, color, raw)) == expected).all()


def test_png_depths_palettes_and_interlacing():
    assert decode_image(png(3, 1, 1, 0, b"\0\xa0"))[0, :, 0].tolist() == [255, 0, 255]
    assert decode_image(png(3, 1, 4, 0, b"\0\x0f\x30"))[0, :, 0].tolist() == [0, 255, 51]
    assert decode_image(png(3, 1, 16, 0, b"\0\x00\x80\xff\xff\x80\x80"))[0, :, 0].tolist() == [0, 255, 128]
    palette = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert decode_image(png(2, 1, 8, 3, b"\0\x01\x00", palette))[0].tolist() == [[4, 5, 6], [1, 2, 3]]
    # a 2 by 2 image in passes: the first pixel, the second of the first row, the second row
    assert decode_image(png(2, 2, 8, 0, b"\0\x01\0\x02\0\x03\x04", interlaced=1))[:, :, 0].tolist() == [[1, 2], [3, 4]]


def test_formats_and_broken_bytes():
    assert [image_format(x) for x in (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"RIFF1234WEBP", b"GIF89a", b"")] == ["png", "jpeg", "webp", None, None]
    whole = encode_png(2, 2, 3, bytes(range(12)))
    for bad in (b"", b"GIF89a", whole[:20], whole[:-30], whole.replace(b"IDAT", b"IDAX"), png(2, 2, 8, 0, b"\0\1"), png(0, 2, 8, 0, b"")):
        with pytest.raises(DecodeError, match="^failed to decode image bytes: "):
            decode_image(bad)


def test_webp_without_a_decoder_is_told():
    try:
        import PIL  # noqa: F401
    except ImportError:
        with pytest.raises(DecodeError, match="no decoder for webp is installed"):
            decode_image(b"RIFF1234WEBPVP8 ")


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"x/{k}.png", encode_png(k + 1, 2, 3, bytes([9 * k]) * 6 * (k + 1))) for k in range(6)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_images_of_bytes(spark, files):
    assert sorted((r.path, r.image.width) for r in decode_images(files).collect()) == [(f"x/{k}.png", k + 1) for k in range(6)]
    assert sorted(map(tuple, form_pages(files).collect())) == [(0, k + 1, 2, f"{k}.png") for k in range(6)]
    assert decode_images(files.limit(0)).count() == 0
    for content in (None, b"", b"no image"):
        with pytest.raises(Exception, match="failed to open image p: failed to decode image bytes"):
            decode_images(spark.createDataFrame([("p", content)], "path string, content binary")).collect()


def test_bytes_to_json(spark, files):
    done = {r.path: json.loads(r.json) for r in analyze_image_bytes(files, FakeDetector, preprocessing=SMALL).collect()}
    assert [done[f"x/{k}.png"]["width"] for k in range(6)] == [1, 2, 3, 4, 5, 6]
    assert list(done["x/0.png"]) == ["width", "height", "blocks"]
    assert [b["label"] for b in done["x/5.png"]["blocks"]] == ["Table", "Text"]
    high = analyze_image_bytes(files, FakeDetector, 0.8, preprocessing=SMALL)
    assert all(len(json.loads(r.json)["blocks"]) == 1 for r in high.collect())
    with pytest.raises(PostprocessError, match="nms_iou_threshold must be between 0 and 1"):
        analyze_image_bytes(files, FakeDetector, nms_iou_threshold=1.5)


def test_batches_of_bytes_to_json_arrays(spark, files):
    listed = [bytes(r.content) for r in files.orderBy("path").collect()]
    batches = spark.createDataFrame([("b", listed[::-1]), ("a", listed[:1])], "batch_id string, images array<binary>")
    done = {r.batch_id: json.loads(r.json) for r in analyze_image_bytes_batch(batches, FakeDetector, preprocessing=SMALL).collect()}
    assert [p["width"] for p in done["b"]] == [6, 5, 4, 3, 2, 1] and [p["width"] for p in done["a"]] == [1]
    with pytest.raises(Exception, match="input image batch must not be empty"):
        analyze_image_bytes_batch(spark.createDataFrame([("e", [])], batches.schema), FakeDetector).collect()


def test_pdf_pages_as_png(spark):
    pdfs = spark.createDataFrame([("d.pdf", b"%PDF")], "path string, content binary")
    renderer = lambda content, pages, dpi: ((3, 2, bytes(range(k, k + 18))) for k in range(min(4, pages)))
    pages = render_png_pages(pdfs, renderer).orderBy("page_index").collect()
    assert [(r.page_index, r.width, r.height) for r in pages] == [(k, 3, 2) for k in range(4)] and FORM_MAX_PAGES == 1024
    assert decode_image(bytes(pages[1].png_data)).ravel().tolist() == list(range(1, 19))
    with pytest.raises(ValueError, match="^max_pages must be greater than 0"):
        render_png_pages(pdfs, renderer, 0)
    with pytest.raises(ValueError, match="^dpi must be greater than 0"):
        render_png_pages(pdfs, renderer, 1, 0.0)


def test_stage_times(files):
    done, seen = observed(analyze_packed(detect(decode_images(files), FakeDetector, SMALL, timed=True)))
    assert done.count() == 6 and {"preprocess_ms", "inference_ms"} <= set(done.columns)
    assert seen.get["pages"] == 6 and seen.get["blocks"] == 12 and seen.get["preprocess_ms"] > 0


def test_form_texts():
    assert read_unit("threshold", " 0.25px") == 0.25 and read_unit("threshold", "1e-1") == 0.1
    assert read_batch_size("4.9") == 4 and read_batch_size(" 32 ") == 32
    assert read_options({"threshold": ".5"}).threshold == 0.5 and read_options({}).nms_iou_threshold == 0.5
    for name, told in (("threshold", "threshold"), ("nms_iou_threshold", "NMS threshold"), ("cross_label_iou_threshold", "cross label threshold")):
        for bad in ("", "x", "1.01", "-0.1", "NaN"):
            with pytest.raises(ValueError, match=f"^{told} must be between 0 and 1"):
                read_unit(name, bad)
    for bad in ("", "0", "33", "x"):
        with pytest.raises(ValueError, match="batch size must be between 1 and 32"):
            read_batch_size(bad)


def field(number, value):
    """One field of a protocol buffer message: a number, bytes or text."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n % 128 + 128]) + varint(n // 128)
    if isinstance(value, int):
        return varint(number * 8) + varint(value)
    body = value.encode() if isinstance(value, str) else value
    return varint(number * 8 + 2) + varint(len(body)) + body


def onnx_model():
    """Rows (mean red, green, blue, height, width, scales) and one row an image, as a model file."""

    def node(kind, inputs, output, *attributes):
        return field(1, b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, kind) + b"".join(field(5, a) for a in attributes))

    number = lambda name, value: field(1, name) + field(3, value) + field(20, 2)
    numbers = lambda name, values: field(1, name) + b"".join(field(8, v) for v in values) + field(20, 7)

    def tensor(at, name, kind, dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(at, field(1, name) + field(2, field(1, field(1, kind) + field(2, shape))))

    graph = (
        node("ReduceMean", ["image"], "means", numbers("axes", [2, 3]), number("keepdims", 0))
        + node("Concat", ["means", "im_shape", "scale_factor"], "fetch_name_0", number("axis", 1))
        + node("Div", ["im_shape", "im_shape"], "ones")
        + node("ReduceMin", ["ones"], "one", numbers("axes", [1]), number("keepdims", 0))
        + node("Cast", ["one"], "fetch_name_1", number("to", 6))
        + field(2, "g")
        + tensor(11, "image", 1, ["n", 3, "h", "w"])
        + tensor(11, "im_shape", 1, ["n", 2])
        + tensor(11, "scale_factor", 1, ["n", 2])
        + tensor(12, "fetch_name_0", 1, ["n", 7])
        + tensor(12, "fetch_name_1", 6, ["n"])
    )
    return field(1, 7) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_onnx_session(spark, files, tmp_path):
    pytest.importorskip("onnxruntime")
    model = tmp_path / "m.onnx"
    model.write_bytes(onnx_model())
    place = str(model)
    direct = OnnxDetector(place)(preprocess([np.full((2, 4, 3), 51, "u1")] * 2, SMALL))
    assert direct[1].tolist() == [1, 1] and np.allclose(direct[0], [[0.2, 0.2, 0.2, 8, 8, 4, 2]] * 2)
    found = detect(decode_images(files), lambda: OnnxDetector(place), SMALL, batch_size=2)
    rows = {r.path: r for r in found.collect()}
    assert len(rows) == 6 and all(r.columns == 7 for r in rows.values())
    assert np.allclose(rows["x/5.png"]["values"], [45 / 255] * 3 + [8, 8, 4, 8 / 6])
    blocks = analyze_packed(found, options=read_options({"threshold": "0.1"})).select(F.size("blocks").alias("n"), "path").collect()
    assert {r.path: r.n for r in blocks} == {f"x/{k}.png": int(9 * k / 255 >= 0.1) for k in range(6)}
