"""From a colour-filter mosaic to display pixels, in single precision."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rawloom.functions import samples, tiff
from rawloom.functions.codec import _below_pointer
from rawloom.functions.columns import RGGB, XYZ_TO_SRGB
from rawloom.functions.tiff import Directory, Frame

PHOTOMETRIC, CFA_PATTERN, BLACK, WHITE, MATRIX_1, MATRIX_2, NEUTRAL, EXPOSURE = 262, 33422, 50714, 50717, 50721, 50722, 50728, 50730
MOSAIC = 32803


@dataclass
class Parameters:
    """black: for each place of the 2 x 2 filter; matrix: camera to XYZ, or None."""

    width: int
    height: int
    bits: int
    black: np.ndarray
    white: float
    cfa: tuple[int, ...]
    neutral: np.ndarray
    exposure: float
    matrix: np.ndarray | None


def invert(m: np.ndarray | None) -> np.ndarray | None:
    """The inverse in single precision; None for a matrix whose determinant is below 1e-9."""
    if m is None:
        return None
    m = m.astype(np.float32)
    rows = np.stack([np.cross(m[1], m[2]), np.cross(m[2], m[0]), np.cross(m[0], m[1])], axis=1)
    det = np.float32(m[0] @ rows[:, 0])
    return None if abs(det) < 1e-9 else (rows * (np.float32(1) / det)).astype(np.float32)


def raw_rows(directory: Directory, width: int, height: int, bits: int) -> bytes | None:
    """The packed rows of a strip image without padding; None for tiles, rows of partial bytes and short strips."""
    if directory.layout != "Strips" or width * bits % 8:
        return None
    row, per = width * bits // 8, directory.rows_per_strip or height
    out = []
    for k, data in enumerate(directory.segments):
        if k * per >= height:
            break
        need = min(height - k * per, per) * row
        if len(data) < need:
            return None
        out.append(data[:need])
    packed = b"".join(out)
    return packed if len(packed) == height * row else None


def parameters(directory: Directory, endian: str) -> tuple[Parameters, bytes] | None:
    """What is needed to develop a directory; None if it is no uncompressed mosaic of a known depth."""
    nums = lambda tag: tiff.numbers(directory.get(tag), endian)
    one = lambda tag, default=None: next(iter(nums(tag)), default)
    if one(PHOTOMETRIC) != MOSAIC or int(one(tiff.SAMPLES_PER_PIXEL, 1)) != 1 or int(one(tiff.COMPRESSION, 1)) != 1:
        return None
    bits, width, height = (one(t) for t in (tiff.BITS, tiff.WIDTH, tiff.LENGTH))
    if bits is None or int(bits) not in samples.DEPTHS or not width or not height or directory.segments is None:
        return None
    bits, width, height = int(bits), int(width), int(height)
    packed = raw_rows(directory, width, height, bits)
    if packed is None:
        return None
    black, cfa, neutral = nums(BLACK), nums(CFA_PATTERN), nums(NEUTRAL)
    matrix = next((m for m in (nums(MATRIX_2), nums(MATRIX_1)) if len(m) >= 9), None)
    levels = np.array([black[k % len(black)] if black else 0 for k in range(4)], np.float32)
    white = one(WHITE, float((1 << bits) - 1))
    usable = len(neutral) >= 3 and all(v > 0 for v in neutral)
    ev = one(EXPOSURE)
    made = Parameters(width, height, bits, levels, white, tuple(int(v) for v in cfa[:4]) if len(cfa) >= 4 else RGGB, np.array(neutral[:3] if usable else [1, 1, 1], np.float32), 1.0 if ev is None else float(np.float32(2) ** np.float32(ev)), invert(None if matrix is None else np.array(matrix[:9], np.float32).reshape(3, 3)))
    return made, packed


def largest(frame: Frame) -> tuple[Parameters, bytes] | None:
    """The largest mosaic of a frame, the first among equals."""
    best = None
    for k, d in enumerate(frame.directories):
        found = None if _below_pointer(frame, k) else parameters(d, frame.endian)
        if found and (best is None or found[0].width * found[0].height > best[0].width * best[0].height):
            best = found
    return best


def demosaic(linear: np.ndarray, cfa: tuple[int, ...]) -> np.ndarray:
    """For each colour the mean of its samples in the 3 x 3 neighbourhood, within the image; 0 where there is none."""
    height, width = linear.shape
    colour = np.array(cfa).reshape(2, 2)[np.arange(height)[:, None] & 1, np.arange(width)[None] & 1]
    out = np.zeros((height, width, 3), np.float32)
    for c in range(3):
        here = colour == c
        total, count = np.zeros((height, width), np.float32), np.zeros((height, width), np.float32)
        level, one = (np.pad(x, 1) for x in (np.where(here, linear, 0).astype(np.float32), here.astype(np.float32)))
        for dy in range(3):
            for dx in range(3):
                total += level[dy : dy + height, dx : dx + width]
                count += one[dy : dy + height, dx : dx + width]
        np.divide(total, count, out=out[:, :, c], where=count > 0)
    return out


def curve(value: np.ndarray, name: str) -> np.ndarray:
    c = np.clip(value, 0, 1).astype(np.float32)
    if name == "srgb":
        g = np.where(c <= 0.0031308, 12.92 * c, 1.055 * c ** np.float32(1 / 2.4) - 0.055)
    else:
        g = np.where(c < 0.018, 4.5 * c, 1.099 * c ** np.float32(0.45) - 0.099)
    return np.clip(g * 255 + 0.5, 0, 255).astype(np.uint8)


def develop(levels: np.ndarray, p: Parameters, name: str = "srgb") -> np.ndarray:
    """Display pixels (height, width, 4) of the samples of a mosaic."""
    if name not in ("srgb", "rec709"):
        raise ValueError(f"no transfer curve {name}")
    filled = np.zeros(p.width * p.height, np.float32)
    filled[: len(levels)] = levels[: len(filled)]
    place = (np.arange(p.height)[:, None] & 1) * 2 + (np.arange(p.width)[None] & 1)
    black = p.black[place]
    linear = np.clip((filled.reshape(p.height, p.width) - black) / np.maximum(np.float32(p.white) - black, 1), 0, 1).astype(np.float32)
    camera = demosaic(linear, p.cfa)
    if p.matrix is not None:
        to_rgb = np.array(XYZ_TO_SRGB, np.float32) @ p.matrix
        rgb = camera @ to_rgb.T / np.maximum(to_rgb @ p.neutral, np.float32(1e-4))
    else:
        rgb = camera / p.neutral
    return np.concatenate([curve(rgb * np.float32(p.exposure), name), np.full((p.height, p.width, 1), 255, np.uint8)], axis=2)


def render(frame: Frame, name: str = "srgb") -> tuple[np.ndarray, int, int] | None:
    """Pixels, width and height of the largest mosaic of a frame; None where there is none."""
    found = largest(frame)
    if found is None:
        return None
    p, packed = found
    return develop(samples.unpack(packed, p.bits, frame.endian, p.width * p.height), p, name), p.width, p.height
