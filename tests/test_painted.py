"""The stand-in recogniser against all pixels looked at one by one, and pages cut into tiles."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tablegeo.schema import ITEMS
from tablegeo.sources import pages, painted


def by_pixel(image: np.ndarray) -> list[tuple]:
    found: dict[int, list[tuple[int, int]]] = {}
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            red, green, blue = map(int, image[y, x])
            found.setdefault(red << 16 | green << 8 | blue, []).append((x, y))
    out = []
    for value in sorted(set(found) - {0}):
        if image.shape[1] > painted.COARSE and value % 8 == 4:
            continue
        xs, ys = zip(*found[value], strict=True)
        x0, y0, x1, y1 = min(xs), min(ys), max(xs) + 1, max(ys) + 1
        out.append(([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], str(value), 0.5 + len(xs) / 4000))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_recogniser(seed):
    rng = np.random.default_rng(seed)
    width, height = int(rng.choice([1, 7, 8, 40, 520])), int(rng.integers(1, 20))
    image = np.zeros((height, width, 3), np.uint8)
    for _ in range(int(rng.integers(0, 9))):
        y, x = int(rng.integers(0, height)), int(rng.integers(0, width))
        image[y : y + 6, x : x + 30] = rng.integers(0, 4, 3)
    assert list(painted._recognise("colours", image.tobytes(), width, height)) == by_pixel(image)


def test_large_images_cost_their_lines():
    """Twelve million painted pixels: sorted one by one they took seconds."""
    line = np.repeat(np.arange(1, 9, dtype=np.uint8), 3 * 750)
    image = np.tile(line, (2000, 1)).tobytes()
    start = time.process_time()
    found = list(painted._recognise("colours", image, 6000, 2000))
    assert time.process_time() - start < 0.8
    assert [(c[0], c[2], s) for c, _, s in found] == [((750 * i, 0), (750 * i + 750, 2000), 0.5 + 375.0) for i in range(8) if (0x010101 * (i + 1)) % 8 != 4]


def test_looks_are_cut_where_tiles_begin():
    width, height = 11, 7
    image = np.random.default_rng(0).integers(0, 256, (height, width, 3), np.uint8)
    seen: list = []
    plugin = pages.Plugin(lambda c: c, lambda d: 1, lambda d, p: [], lambda d, p, dpi: (width, height, 1.0, image.tobytes()))
    for _ in pages._scanned(plugin, None, lambda e, part, w, h: seen.append((part, w, h)) or [], None, "k", 1, 72, 4, 1):
        pass
    starts = lambda n: [0, 3, n - 4] if n == 7 else [0, 3, 6, 7]
    looks = [(0, 0, width, height)] + [(x, y, x + 4, y + 4) for y in sorted(set(starts(height))) for x in starts(width)]
    assert seen == [(image[t:b, l:r].tobytes(), r - l, b - t) for l, t, r, b in looks]


def test_corners_of_any_number():
    rows = [("k", 1, 2, 9, 3, "a", 0.5, pages._corners([(1, 2), (4, 8), (0, 3)]), 2.0, 10, 20), ("k", 1, 1, 0, 0, "b", 1.0, pages._corners([(5, 6)]), 1.0, 0, 0)]
    assert [tuple(r.values()) for r in pages._boxes(rows, ITEMS).to_pylist()] == [
        ("k", 1, 3, "a", 0.5, 5.0, 11.0, 7.0, 14.0, [{"x": 5.5, "y": 11.0}, {"x": 7.0, "y": 14.0}, {"x": 5.0, "y": 11.5}]),
        ("k", 1, 0, "b", 1.0, 5.0, 6.0, 5.0, 6.0, [{"x": 5.0, "y": 6.0}]),
    ]
    assert pages._boxes([], ITEMS).num_rows == 0
    with pytest.raises(ValueError):
        pages._corners([])
