"""Page rasters to detector tensors, vectorised over the pixels of a page."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from ..errors import PreprocessError
from ..options import PreprocessOptions


class BatchInput(NamedTuple):
    image: np.ndarray  # float32 [N, 3, H, W], RGB planes in 0..1
    im_shape: np.ndarray  # float32 [N, 2], height first
    scale_factor: np.ndarray  # float32 [N, 2], height first
    original_sizes: list[tuple[int, int]]  # (width, height)


def triangle_weights(size: int, target: int) -> np.ndarray:
    """Resampling matrix [target, size] of a triangle filter whose support grows with the reduction."""
    ratio = size / target
    support = max(ratio, 1.0)
    centers = (np.arange(target) + 0.5) * ratio
    distance = np.abs(np.arange(size)[None, :] + 0.5 - centers[:, None]) / support
    weights = np.maximum(0.0, 1.0 - distance)
    return (weights / weights.sum(axis=1, keepdims=True)).astype("f4")


def resized(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resized uint8 RGB; the aspect ratio is not kept."""
    rows, columns = triangle_weights(rgb.shape[0], height), triangle_weights(rgb.shape[1], width)
    high = (rows @ rgb.astype("f4").reshape(rgb.shape[0], -1)).reshape(height, rgb.shape[1], 3)
    out = columns @ high
    return np.clip(np.floor(out + 0.5), 0, 255).astype("u1")


def preprocess(images: list[np.ndarray], options: PreprocessOptions = PreprocessOptions()) -> BatchInput:
    """Tensors of RGB images [height, width, 3]."""
    if not images:
        raise PreprocessError("input image batch must not be empty")
    if any(not x.shape[0] or not x.shape[1] for x in images):
        raise PreprocessError("input image dimensions must be non-zero")
    w, h = options.target_width, options.target_height
    planes = np.stack([resized(x, w, h).transpose(2, 0, 1).astype("f4") / np.float32(255) for x in images])
    shape = np.tile(np.array([h, w], "f4"), (len(images), 1))
    scale = np.array([[np.float32(h) / np.float32(x.shape[0]), np.float32(w) / np.float32(x.shape[1])] for x in images], "f4")
    return BatchInput(planes, shape, scale, [(x.shape[1], x.shape[0]) for x in images])


def rgb_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB of Spark's image bytes: BGR(A) or gray."""
    x = np.frombuffer(data, "u1").reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]
