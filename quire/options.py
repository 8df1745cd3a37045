"""Options, their defaults and their checks."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from .errors import PostprocessError, PreprocessError

#: Defaults of the analysis.
THRESHOLD, NMS_IOU, CROSS_LABEL_IOU = 0.2, 0.5, 0.9
TARGET_WIDTH = TARGET_HEIGHT = 800
MAX_PAGES, PDF_DPI, BATCH_SIZE, MAX_BATCH_SIZE = 1, 144.0, 4, 32
FORM_MAX_PAGES = 1024  # the form's; the command line's is MAX_PAGES
#: What the form calls its thresholds in messages.
FORM_NAMES = {"threshold": "threshold", "nms_iou_threshold": "NMS threshold", "cross_label_iou_threshold": "cross label threshold"}


def unit_interval(name: str, value: float) -> None:
    if not (math.isfinite(value) and 0.0 <= value <= 1.0):
        raise PostprocessError(f"{name} must be between 0 and 1")


@dataclass(frozen=True)
class PostprocessOptions:
    threshold: float = THRESHOLD
    nms_iou_threshold: float = NMS_IOU
    cross_label_iou_threshold: float = CROSS_LABEL_IOU

    def check(self) -> PostprocessOptions:
        for name in ("threshold", "nms_iou_threshold", "cross_label_iou_threshold"):
            unit_interval(name, getattr(self, name))
        return self


@dataclass(frozen=True)
class PreprocessOptions:
    target_width: int = TARGET_WIDTH
    target_height: int = TARGET_HEIGHT


@dataclass(frozen=True)
class LoadOptions:
    max_pages: int = MAX_PAGES
    pdf_dpi: float = PDF_DPI

    def check(self) -> LoadOptions:
        if self.max_pages == 0:
            raise PreprocessError("max_pages must be greater than 0")
        if self.pdf_dpi <= 0:  # a NaN passes, as in every comparison
            raise PreprocessError("pdf_dpi must be greater than 0")
        return self


def check_batch_size(n: int) -> int:
    if not 1 <= n <= MAX_BATCH_SIZE:
        raise PreprocessError(f"batch size must be between 1 and {MAX_BATCH_SIZE}")
    return n


def _leading(pattern: str, text: str) -> float:
    """The number a text starts with, whatever follows it; NaN for none."""
    found = re.match(rf"\s*({pattern})", text, re.ASCII)
    return float(found[1]) if found else math.nan


def read_unit(name: str, text: str) -> float:
    """A threshold as typed into a form."""
    value = _leading(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text)
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{FORM_NAMES[name]} must be between 0 and 1")
    return value


def read_batch_size(text: str) -> int:
    """A batch size as typed into a form: leading digits, so ``4.9`` is 4."""
    value = _leading(r"[+-]?\d+", text)
    if not 1 <= value <= MAX_BATCH_SIZE:
        raise ValueError(f"batch size must be between 1 and {MAX_BATCH_SIZE}")
    return int(value)


def read_options(texts: dict[str, str]) -> PostprocessOptions:
    """Thresholds of a form's texts; missing ones keep their defaults."""
    return PostprocessOptions(**{name: read_unit(name, text) for name, text in texts.items()})
