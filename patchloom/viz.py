"""Small pictures of results, as numpy arrays and PNG files."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

from .operators.images import resize


def save_png(image: np.ndarray, path: str) -> None:
    """An RGB image as PNG; folders are made."""
    a = np.ascontiguousarray(image[..., :3].astype(np.uint8))
    h, w = a.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(
            b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0),
        ) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def overlay(thumbnail: np.ndarray, mask: np.ndarray, colour=(0, 255, 0), alpha: float = 0.4) -> np.ndarray:
    """The thumbnail with the mask blended over it."""
    m = mask.astype(bool)
    if m.shape != thumbnail.shape[:2]:
        y = np.arange(thumbnail.shape[0]) * m.shape[0] // thumbnail.shape[0]
        x = np.arange(thumbnail.shape[1]) * m.shape[1] // thumbnail.shape[1]
        m = m[np.ix_(y, x)]
    out = thumbnail[..., :3].astype(np.float64)
    out[m] = (1 - alpha) * out[m] + alpha * np.array(colour)
    return out.astype(np.uint8)


def patch_grid(images: list[np.ndarray], columns: int = 8, size: int = 64, gap: int = 2) -> np.ndarray:
    """The images side by side on white."""
    rows = -(-len(images) // columns)
    out = np.full((rows * (size + gap) + gap, columns * (size + gap) + gap, 3), 255, np.uint8)
    for i, a in enumerate(images):
        y, x = gap + i // columns * (size + gap), gap + i % columns * (size + gap)
        out[y : y + size, x : x + size] = resize(a, size, size)[..., :3]
    return out


def compare(image: np.ndarray, transforms: dict, seed: int = 0, size: int = 128) -> np.ndarray:
    """The image and what each transform makes of it."""
    return patch_grid([image, *[t(image.copy(), np.random.default_rng(seed)) for t in transforms.values()]], len(transforms) + 1, size)


def markers(
    thumbnail: np.ndarray, coords: list[tuple[int, int]], slide: tuple[int, int], colour=(255, 0, 0), radius: int = 1,
) -> np.ndarray:
    """Sampled positions (level-0 pixels) as marks on the thumbnail."""
    out = thumbnail[..., :3].copy()
    h, w = out.shape[:2]
    for x, y in coords:
        a, b = int(x * w / slide[0]), int(y * h / slide[1])
        out[max(0, b - radius) : b + radius + 1, max(0, a - radius) : a + radius + 1] = colour
    return out
