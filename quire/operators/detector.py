"""The detector stage: the one opaque operator, run on Arrow batches of pages."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import BackendError, PreprocessError
from ..options import BATCH_SIZE, PreprocessOptions, check_batch_size
from .preprocess import BatchInput, preprocess, rgb_of

# Tensor names of the model.
INPUTS = ("image", "im_shape", "scale_factor")
OUTPUTS = ("fetch_name_0", "fetch_name_1")
TIMES = ("preprocess_ms", "inference_ms")


class Detector(Protocol):
    """Rows [n, columns] of all images of a batch, and each image's number of rows."""

    def __call__(self, batch: BatchInput) -> tuple[np.ndarray, np.ndarray]: ...


class FakeDetector:
    """Deterministic rows from the tensors, for tests and demonstrations."""

    def __call__(self, batch: BatchInput) -> tuple[np.ndarray, np.ndarray]:
        rows = []
        for planes, (width, height) in zip(batch.image, batch.original_sizes):
            mean = float(planes.mean())
            rows += [[22, 0.9, 0, 0, width * 0.5, height * 0.5, 1], [21, 0.5 + mean / 2, width * 0.5, height * 0.5, width, height, 0]]
        return np.array(rows, "f4").reshape(-1, 7), np.full(len(batch.original_sizes), 2, "i4")


class OnnxDetector:
    """A model file run by onnxruntime."""

    def __init__(self, model_path: str):
        if not os.path.exists(model_path):
            raise BackendError(f"model file does not exist: {model_path}")
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a Spark task has one core
        self.session = onnxruntime.InferenceSession(model_path, options, providers=["CPUExecutionProvider"])

    def __call__(self, batch: BatchInput) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = self.session.run(list(OUTPUTS), dict(zip(INPUTS, (batch.image, batch.im_shape, batch.scale_factor))))
        return rows, counts


@lru_cache(maxsize=1)
def onnx_detector(model_path: str) -> OnnxDetector:
    """One session for each worker process, kept while the path is the same."""
    return OnnxDetector(model_path)


def checked_counts(counts: np.ndarray) -> list[int]:
    if (np.asarray(counts) < 0).any():
        raise BackendError("model output contains an invalid row count")
    return [int(n) for n in counts]


def detect(pages: DataFrame, detector: Callable[[], Detector], options: PreprocessOptions = PreprocessOptions(), batch_size: int = BATCH_SIZE, timed: bool = False) -> DataFrame:
    """Packed detections of pages ``(path, page_index, image)``.

    Adds ``width, height, columns, values``; tensors never leave the worker. With
    ``timed`` also ``preprocess_ms, inference_ms``: a page's share of its batch.
    """
    check_batch_size(batch_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = detector()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                part = whole.slice(at, batch_size)
                images = []
                for path, image in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                    if image is None or image["height"] < 0:
                        raise PreprocessError(f"failed to open image {path}")
                    images.append(rgb_of(image["height"], image["width"], image["nChannels"], image["data"]))
                began = time.perf_counter()
                batch = preprocess(images, options)
                prepared = time.perf_counter()
                rows, counts = model(batch)
                spent = (prepared - began, time.perf_counter() - prepared)
                counts = checked_counts(counts)
                ends = np.cumsum(counts)
                values = [rows[e - n : e].astype("f4").ravel() for n, e in zip(counts, ends)]
                out = {
                    "path": part.column(0),
                    "page_index": part.column(1),
                    "width": pa.array([w for w, _ in batch.original_sizes], pa.int32()),
                    "height": pa.array([h for _, h in batch.original_sizes], pa.int32()),
                    "columns": pa.array([rows.shape[-1]] * len(images), pa.int32()),
                    "values": pa.array(values, pa.list_(pa.float32())),
                }
                if timed:
                    out |= {name: pa.array([1000 * s / len(images)] * len(images)) for name, s in zip(TIMES, spent)}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "path string, page_index int, width int, height int, columns int, values array<float>"
    return pages.select("path", "page_index", "image").mapInArrow(run, schema + "".join(f", {name} double" for name in TIMES if timed))
