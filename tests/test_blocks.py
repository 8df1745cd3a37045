"""Known vectors and random pages, against a plain float32 model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.errors import PostprocessError
from quire.functions.labels import LABELS
from quire.operators.packing import split_batches
from quire.options import PostprocessOptions
from quire.plans.layout import analyze_packed, document_json, page_layout
from quire.sources.detections import packed

ROWS = "page_id long, row_index long, class_value float, score float, x1 float, y1 float, x2 float, y2 float, order_value float, width int, height int"


def layout(spark, rows, size, **options):
    data = [(1, i, *map(float, r[:6]), None if len(r) < 7 or r[6] is None else float(r[6]), *size) for i, r in enumerate(rows)]
    out = page_layout(spark.createDataFrame(data, ROWS), PostprocessOptions(**options)).orderBy("pos").collect()
    return [(r.label, round(r.score, 2)) for r in out], out


# Known pages (class, score, x1, y1, x2, y2, order), their size, options and results.
@pytest.mark.parametrize(
    "rows, size, options, expected",
    [
        ([(22, 0.95, 1, 2, 10, 20, 2), (8, 0.2, 0, 0, 5, 5, 1), (14, 0.9, -1, -2, 30, 40, 1)], (25, 30), {"threshold": 0.5}, [("Image", 0.9), ("Text", 0.95)]),
        ([(22, 0.9, 0, 0, 100, 100, 2), (22, 0.8, 10, 10, 90, 90, 1), (21, 0.7, 30, 10, 110, 90, 0), (22, 0.6, 120, 120, 180, 180, 3)], (200, 200), {"threshold": 0.5}, [("Table", 0.7), ("Text", 0.9), ("Text", 0.6)]),
        ([(1, 0.9, 100, 100, 950, 600, 0), (1, 0.6, 120, 110, 485, 590, 1)], (1000, 700), {"threshold": 0.4}, [("Algorithm", 0.9)]),
        ([(18, 0.93, 100, 100, 900, 900, 0), (19, 0.86, 150, 150, 850, 450, 1), (22, 0.43, 150, 150, 850, 450, 1)], (1000, 1000), {"threshold": 0.4}, [("Reference", 0.93), ("ReferenceContent", 0.86)]),
        ([(17, 0.46, 100, 100, 450, 130, 8), (1, 0.33, 100, 100, 450, 130, 8)], (600, 300), {"threshold": 0.3}, [("ParagraphTitle", 0.46)]),
    ],
)
def test_known_pages(spark, rows, size, options, expected):
    assert layout(spark, rows, size, **options)[0] == expected


def test_clamped_to_page(spark):
    _, out = layout(spark, [(14, 0.9, -10, 5, 120, 80, 1)], (100, 60))
    assert (out[0].x, out[0].y, out[0].w, out[0].h) == (0, 5, 100, 55)


def test_edge_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(-1, 0.2, 5, 5, 5, 5, None), (25, 0.9, 5, 5, 5, 5, -3), (nan, nan, 0, 0, 9, 9, nan), (inf, 0.5, nan, 0, 50, 9, inf), (22, 0.4, 60, 60, 50, 50, 2.9), (22, 0.19, 0, 0, 9, 9, 0)]
    _, out = layout(spark, rows, (100, 100))
    by = {r.row_index: r for r in out}
    assert set(by) == {0, 1, 2, 3, 4}  # a score at the threshold stays, one below goes
    assert by[0].label == "Abstract" and by[0].ord is None and by[1].label == "Unknown" and by[1].ord == -3
    assert by[2].label == "Abstract" and math.isnan(by[2].score) and by[2].ord == 0
    assert by[3].label == "Unknown" and by[3].ord == 2**63 - 1 and math.isnan(by[3].x) and by[3].w == 0
    assert (by[4].w, by[4].h, by[4].ord) == (0, 0, 2)
    assert [r.row_index for r in out[:3]] == [1, 2, 4]


@pytest.mark.parametrize("bad", [float("nan"), -0.1, 1.1, float("inf")])
@pytest.mark.parametrize("name", ["threshold", "nms_iou_threshold", "cross_label_iou_threshold"])
def test_options_are_checked(bad, name):
    with pytest.raises(PostprocessError, match=f"{name} must be between 0 and 1"):
        PostprocessOptions(**{name: bad}).check()


def model(rows, size):
    """The analysis in float32, one step after the other."""
    f = np.float32
    names = [n for n, _ in LABELS]
    blocks = []
    for i, (c, s, x1, y1, x2, y2, o) in enumerate(rows):
        if f(s) < f(0.2):
            continue
        cut = lambda v, m: min(max(f(v), f(0)), f(m))
        l, t, r, b = cut(x1, size[0]), cut(y1, size[1]), cut(x2, size[0]), cut(y2, size[1])
        cls = 0 if c < 0 else int(c)
        blocks.append([i, names[cls] if cls < len(names) else "Unknown", f(s), l, t, max(r - l, f(0)), max(b - t, f(0)), None if o is None else int(o)])

    def parts(a, b):
        w = max(min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), f(0))
        h = max(min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), f(0))
        one, two = a[5] * a[6], b[5] * b[6]
        return w * h, min(one, two), one + two - w * h

    share = lambda p, q: f(0) if q <= 0 else p / q
    iou = lambda a, b: share(parts(a, b)[0], parts(a, b)[2])
    score = lambda a, b: max(iou(a, b), share(*parts(a, b)[:2]))
    refs = [b[:] for b in blocks if b[1] == "Reference"]
    for b in blocks:
        if b[1] == "Text" and any(score(k, b) > f(0.5) for k in refs):
            b[1] = "ReferenceContent"
    kept = []
    for b in sorted(blocks, key=lambda b: (-b[2], b[0])):
        if not any(score(k, b) > f(0.5) if k[1] == b[1] else iou(k, b) > f(0.9) for k in kept):
            kept.append(b)
    kept.sort(key=lambda b: (2**63 - 1 if b[7] is None else b[7], -b[2], b[0]))
    return [(b[0], b[1], float(b[2]), *map(float, b[3:7]), b[7]) for b in kept]


def random_pages(seed, pages=12):
    rng = np.random.default_rng(seed)
    out = {}
    for p in range(pages):
        n = int(rng.integers(0, 40))
        out[p] = [(int(rng.choice([18, 22, 22, 19, 21, -1, 25, 3])), float(np.float32(rng.integers(0, 40) / 40)), *(float(v) for v in np.float32(rng.uniform(-20, 130, 2))), *(float(v) for v in np.float32(rng.uniform(40, 180, 2))), None if p % 4 == 0 else float(rng.integers(-2, 6))) for _ in range(n)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_pages_match_the_model(spark, seed):
    pages = random_pages(seed)
    data = [(p, i, *map(float, r[:6]), r[6], 150, 140) for p, rows in pages.items() for i, r in enumerate(rows)]
    frame = spark.createDataFrame(data, ROWS)
    out = {}
    for r in page_layout(frame).orderBy("page_id", "pos").collect():
        out.setdefault(r.page_id, []).append((r.row_index, r.label, r.score, r.x, r.y, r.w, r.h, r.ord))
    expected = {p: m for p, rows in pages.items() if (m := model(rows, (150, 140)))}
    assert out == expected
    # the packed form gives the same without a shuffle
    done = analyze_packed(packed(frame))
    again = {r.page_id: [(b.row_index, b.label, b.score, b.x, b.y, b.w, b.h, b.ord) for b in r.blocks] for r in done.collect() if r.blocks}
    assert again == expected
    assert "Exchange" not in analyze_packed(spark.createDataFrame([], "page_id long, width int, height int, columns int, values array<float>"))._jdf.queryExecution().executedPlan().toString()


BATCH = "values array<float>, columns int, row_counts array<int>, image_sizes array<struct<width:int,height:int>>"


def test_batches_split_by_counts(spark):
    values = [22, 0.95, 1, 2, 10, 20, 2, 8, 0.9, 0, 0, 5, 5, 1, 14, 0.88, 10, 10, 30, 40, 4]
    frame = spark.createDataFrame([([float(v) for v in values], 7, [2, 0, 1], [(25, 30), (9, 9), (100, 80)])], BATCH)
    out = analyze_packed(split_batches(frame), PostprocessOptions(threshold=0.5)).orderBy("image_index").collect()
    assert [[b.label for b in r.blocks] for r in out] == [["Footer", "Text"], [], ["Image"]]


@pytest.mark.parametrize("counts, columns, message", [([2], 7, "must sum to fetch row count"), ([1, 0], 7, "must match image count"), ([1], 6, "divisible by columns"), ([1], 0, "divisible by columns")])
def test_contradictory_batches_fail(spark, counts, columns, message):
    frame = spark.createDataFrame([([1.0] * 7, columns, counts, [(25, 30)])], BATCH)
    with pytest.raises(Exception, match=message):
        split_batches(frame).collect()


def test_contradictory_pages_fail(spark):
    frame = spark.createDataFrame([(1, 10, 10, 5, [1.0] * 5)], "page_id long, width int, height int, columns int, values array<float>")
    with pytest.raises(Exception, match="at least 6 columns"):
        analyze_packed(frame).collect()


def test_document_json(spark):
    frame = spark.createDataFrame([(0, 25, 30, 6, [22.0, 0.5, 1.0, 2.0, 10.0, 20.0])], "page_index int, width int, height int, columns int, values array<float>")
    text = document_json(analyze_packed(frame))
    assert '"order": null' in text and text.startswith('{\n  "pages": [') and '"label": "Text"' in text
    assert document_json(analyze_packed(frame.where(F.lit(False)))) == '{\n  "pages": []\n}'
