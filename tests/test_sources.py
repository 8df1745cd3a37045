import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.errors import BackendError, PreprocessError
from quire.functions.labels import color_of, label_of, parse_label
from quire.operators.detector import FakeDetector, OnnxDetector, checked_counts, detect
from quire.operators.preprocess import preprocess, resized
from quire.options import LoadOptions, PreprocessOptions
from quire.plans.layout import analyze_packed
from quire.sources.documents import is_pdf, load_pages
from quire.sources.png import encode_png
from quire.streaming.pages import analyze_stream, read_packed


def test_labels(spark):
    frame = spark.createDataFrame([(i,) for i in (0, 14, 24, 25, 999)], "c long").select(label_of(F.col("c")).alias("l"))
    assert [r.l for r in frame.collect()] == ["Abstract", "Image", "VisionFootnote", "Unknown", "Unknown"]
    names = spark.createDataFrame([("Text",), ("Table",), ("Image",), ("NotALabel",)], "n string")
    assert [r[0] for r in names.select(color_of(F.col("n"))).collect()] == ["#2563eb", "#16a34a", "#ea580c", "#111827"]
    assert [r[0] for r in names.select(parse_label(F.col("n"))).collect()] == ["Text", "Table", "Image", None]
    with pytest.raises(Exception, match="unknown layout label: NotALabel"):
        names.select(parse_label(F.col("n"), strict=True)).collect()


def test_preprocess_shapes():
    batch = preprocess([np.zeros((4, 2, 3), "u1"), np.zeros((2, 4, 3), "u1")], PreprocessOptions(8, 6))
    assert batch.image.shape == (2, 3, 6, 8) and batch.image.dtype == np.float32
    assert batch.im_shape.tolist() == [[6, 8], [6, 8]]
    assert batch.scale_factor.tolist() == [[1.5, 4.0], [3.0, 2.0]] and batch.original_sizes == [(2, 4), (4, 2)]
    with pytest.raises(PreprocessError, match="batch must not be empty"):
        preprocess([])
    with pytest.raises(PreprocessError, match="dimensions must be non-zero"):
        preprocess([np.zeros((0, 2, 3), "u1")])


def test_resize_is_antialiased():
    x = np.zeros((4, 4, 3), "u1")
    x[:, 2:] = 200
    assert resized(x, 4, 4).tolist() == x.tolist()
    half = resized(x, 2, 2)[0, :, 0]
    assert half[0] < half[1] and 0 < half[0] < 60 and int(half[0]) + int(half[1]) == 200


def test_file_endings(spark):
    frame = spark.createDataFrame([(p,) for p in ("a.pdf", "b.PDF", "c.png", ".pdf", "x/y.z/pdf", "d.pdf.txt", "e")], "p string")
    assert [r[0] for r in frame.select(is_pdf(F.col("p"))).collect()] == [True, True, False, False, False, False, False]


def test_images_through_the_pipeline(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(encode_png(4, 2, 3, bytes(range(24))))
    (tmp_path / "b.png").write_bytes(encode_png(3, 3, 1, bytes(range(9))))
    (tmp_path / "c.png").write_bytes(encode_png(2, 2, 4, bytes(range(16))))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    renderer = lambda content, pages, dpi: ((5, 5, bytes(75)) for _ in range(min(3, pages)))
    pages = load_pages(spark, str(tmp_path), LoadOptions(max_pages=2), renderer)
    assert sorted((r.path.rsplit("/", 1)[1], r.page_index) for r in pages.collect()) == [("a.png", 0), ("b.png", 0), ("c.png", 0), ("d.pdf", 0), ("d.pdf", 1)]
    done = analyze_packed(detect(pages, FakeDetector, PreprocessOptions(8, 8))).collect()
    assert all([b.label for b in r.blocks] == ["Table", "Text"] for r in done) and len(done) == 5
    (tmp_path / "e.png").write_bytes(b"broken")
    with pytest.raises(Exception, match="failed to open image"):
        detect(load_pages(spark, str(tmp_path / "e.png")), FakeDetector).collect()
    with pytest.raises(Exception, match="no PDF renderer"):
        load_pages(spark, str(tmp_path / "d.pdf")).collect()


def test_a_folder_with_a_dot_is_a_folder(spark, tmp_path):
    folder = tmp_path / "data.v1"
    folder.mkdir()
    (folder / "a.png").write_bytes(encode_png(4, 2, 3, bytes(range(24))))
    (folder / "b.PDF").write_bytes(b"%PDF")
    renderer = lambda content, pages, dpi: ((5, 5, bytes(75)) for _ in range(pages))
    names = lambda path: sorted((r.path.rsplit("/", 1)[1], r.page_index) for r in load_pages(spark, str(path), LoadOptions(max_pages=2), renderer).collect())
    assert names(folder) == [("a.png", 0), ("b.PDF", 0), ("b.PDF", 1)]
    assert names(folder / "b.PDF") == [("b.PDF", 0), ("b.PDF", 1)] and names(folder / "a.png") == [("a.png", 0)]


def test_load_options(spark):
    with pytest.raises(PreprocessError, match="max_pages must be greater than 0"):
        load_pages(spark, "x.png", LoadOptions(max_pages=0))
    with pytest.raises(PreprocessError, match="pdf_dpi must be greater than 0"):
        LoadOptions(pdf_dpi=0.0).check()
    LoadOptions(pdf_dpi=float("nan")).check()


def test_detector_errors():
    with pytest.raises(BackendError, match="model file does not exist"):
        OnnxDetector("/nowhere/model.onnx")
    with pytest.raises(BackendError, match="invalid row count"):
        checked_counts(np.array([1, -1]))


def test_command_line():
    args = cli.parser().parse_args(["layout", "analyze", "--input", "a", "--model", "m", "--max_page", "3"])
    assert args.max_page == 3 and args.pdf_dpi == 144.0
    for bad in ("0", "-1", "x"):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["layout", "analyze", "--input", "a", "--model", "m", "--max-page", bad])


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(p, 100, 100, 7, [22.0, 0.9, 0.0, 0.0, 50.0, 50.0, 1.0, 22.0, 0.8, 1.0, 1.0, 50.0, 50.0, 0.0]) for p in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, width int, height int, columns int, values array<float>")
    frame.write.parquet(str(tmp_path / "in"))
    analyze_stream(read_packed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, out.collect())) == sorted(map(str, analyze_packed(frame).select(out.columns).collect()))
