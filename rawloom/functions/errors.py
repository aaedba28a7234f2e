"""Errors of the kernels: a code that stays in data, and a message."""

from __future__ import annotations


class FrameError(ValueError):
    """A frame, stream or path that can't be processed; code names the kind."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


#: Kinds of error by the layer that finds them.
CODEC = ("InvalidComponents", "InvalidPrecision", "InvalidDimensions", "SampleCountMismatch", "SampleOutOfRange", "UnexpectedEof", "InvalidMarker", "UnsupportedMarker", "Unsupported", "Malformed")
CONTAINER = ("Truncated", "BadByteOrder", "BadMagic", "UnknownFieldType", "Inconsistent", "ValueTooLarge", "TooDeep", "Io")
POLICY = ("UnsupportedBitDepth", "InconsistentBitDepth", "UnsupportedPlanarConfig", "MissingTag", "DimensionTooLarge", "UnsupportedComponents", "SegmentTooShort", "UnsupportedRowAlignment", "SegmentGeometry", "RoundTrip", "TagViolations", "NoDestinations", "NotFileOrDir", "NoFrames", "NothingToCompress", "NothingToDecompress", "MarkerCollision", "InPlace")
