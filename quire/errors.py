"""Errors of the three phases; each message starts with its phase."""


class LayoutError(Exception):
    prefix = ""

    def __init__(self, message: str):
        super().__init__(f"{self.prefix}: {message}")


class PreprocessError(LayoutError):
    prefix = "layout preprocessing failed"


class PostprocessError(LayoutError):
    prefix = "layout postprocessing failed"


class BackendError(LayoutError):
    prefix = "layout backend failed"


class DecodeError(ValueError):
    """Image bytes that cannot be read; its message has no phase."""

    def __init__(self, reason: str):
        super().__init__(f"failed to decode image bytes: {reason}")
