"""Collection settings, their validation, and the errors callers see."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

QUANTIZATIONS = ("F32", "INT8", "BIT")
METRICS = ("cosine", "euclidean", "dot", "hamming")


class LodestoneError(Exception):
    """Any error that the library raises on purpose."""


class InvalidConfig(LodestoneError):
    pass


class DimensionMismatch(LodestoneError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"expected {expected} dimensions, found {found}")


class FilterError(LodestoneError):
    pass


class FormatError(LodestoneError):
    pass


@dataclass(frozen=True)
class CollectionConfig:
    """Dimensions, codec and metric are fixed for a collection's life.

    hamming needs BIT codes, and BIT accepts every metric: cosine, dot and euclidean then run on packed bytes.
    """

    dimensions: int
    quantization: str = "F32"
    metric: str = "cosine"
    embedder_id: str | None = None

    def __post_init__(self):
        if isinstance(self.dimensions, bool) or not isinstance(self.dimensions, int) or self.dimensions < 1:
            raise InvalidConfig("dimensions must be a positive integer")
        if self.quantization not in QUANTIZATIONS:
            raise InvalidConfig(f"quantization must be one of {', '.join(QUANTIZATIONS)}")
        if self.metric not in METRICS:
            raise InvalidConfig(f"metric must be one of {', '.join(METRICS)}")
        if self.metric == "hamming" and self.quantization != "BIT":
            raise InvalidConfig("hamming needs BIT codes")

    def check_embedder(self, model: str | None, dimensions: int | None = None) -> None:
        if dimensions is not None and dimensions != self.dimensions:
            raise DimensionMismatch(self.dimensions, dimensions)
        if self.embedder_id and model and self.embedder_id != model:
            warnings.warn(f"collection was embedded with {self.embedder_id}, now used with {model}", stacklevel=3)
