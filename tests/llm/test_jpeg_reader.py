"""The JPEG reader on files that another, scalar writer makes: sparse coefficients, odd sizes, several bands and bits."""

import numpy as np
import pytest

from quernstone.llm import jpeg

LENGTHS = {run << 4 | size: 8 for run in range(16) for size in range(11)}
CODES = jpeg.canonical(LENGTHS)
PARTS = {1: (2, 2), 2: (1, 1), 3: (1, 1)}


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(*CODES[s])

    def signed(self, value):
        size = abs(value).bit_length()
        return size, value if value > 0 else value + (1 << size) - 1

    def data(self):
        return jpeg.to_bytes(np.array(self.bits, np.uint8))


def shifted(value, low):
    return abs(value) >> low


def blocks_of(cells, c, width, height):
    across, down = PARTS[c]
    return cells[c][: -(-height * down // 16), : -(-width * across // 16)].reshape(-1, 64)


def write(cells, width, height, bands, low):
    out = [
        jpeg.HEAD,
        jpeg.segment(
            0xC2,
            b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"".join(
                bytes([c, h << 4 | v, 0]) for c, (h, v) in PARTS.items()
            )
        )
    ]
    out.append(jpeg.table_segment(0, 0, LENGTHS) + jpeg.table_segment(1, 0, LENGTHS))
    order = []
    for y in range(cells[2].shape[0]):
        for x in range(cells[2].shape[1]):
            order += [(c, cells[c][y * v + j, x * h + i]) for c, (h, v) in PARTS.items() for j in range(v) for i in range(h)]
    w, before = Writer(), dict.fromkeys(PARTS, 0)
    for c, block in order:
        size, extra = w.signed((int(block[0]) >> low) - before[c])
        before[c] = int(block[0]) >> low
        w.symbol(size)
        w.put(extra, size)
    out += [jpeg.scan_segment(bytes(PARTS), 0, 0, 0, low), w.data()]
    for c in PARTS:
        for first, last in bands:
            w = Writer()
            for block in blocks_of(cells, c, width, height):
                run = 0
                for k in range(first, last + 1):
                    if not (size := shifted(int(block[k]), low)):
                        run += 1
                        continue
                    while run > 15:
                        w.symbol(0xF0)
                        run -= 16
                    size, extra = w.signed(size if block[k] > 0 else -size)
                    w.symbol(run << 4 | size)
                    w.put(extra, size)
                    run = 0
                if run:
                    w.symbol(0)
            out += [jpeg.scan_segment(bytes([c]), first, last, 0, low), w.data()]
    for bit in range(low - 1, -1, -1):
        w = Writer()
        for _, block in order:
            w.put(int(block[0]) >> bit & 1, 1)
        out += [jpeg.scan_segment(bytes(PARTS), 0, 0, bit + 1, bit), w.data()]
        for c in PARTS:
            for first, last in bands:
                w = Writer()
                for block in blocks_of(cells, c, width, height):
                    now = [shifted(int(v), bit) for v in block]
                    end = max((k for k in range(first, last + 1) if now[k] == 1), default=0)
                    run, held = 0, []
                    for k in range(first, last + 1):
                        if not now[k]:
                            run += 1
                            continue
                        while run > 15 and k <= end:
                            w.symbol(0xF0)
                            w.bits += held
                            run, held = run - 16, []
                        if now[k] > 1:
                            held.append(now[k] & 1)
                            continue
                        w.symbol(run << 4 | 1)
                        w.put(int(block[k] > 0), 1)
                        w.bits += held
                        run, held = 0, []
                    if run or held:
                        w.symbol(0)
                        w.bits += held
                out += [jpeg.scan_segment(bytes([c]), first, last, bit + 1, bit), w.data()]
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize(
    ("width", "height", "bands", "low"),
    [(16, 16, ((1, 63),), 0), (35, 21, ((1, 5), (6, 63)), 2), (50, 17, ((1, 63),), 3)],
)
def test_any_progressive_file(width, height, bands, low):
    rng = np.random.default_rng(width)
    across, down = -(-width // 16), -(-height // 16)
    cells = {}
    for c, (h, v) in PARTS.items():
        x = rng.integers(-120, 120, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < 0.15)
        seen = np.zeros(x.shape[:2], bool)  # blocks outside the picture have no AC scans
        seen[: -(-height * v // 16), : -(-width * h // 16)] = True
        x[~seen, 1:] = 0
        cells[c] = x
    image = jpeg.ProgressiveImage(write(cells, width, height, bands, low))
    for c in PARTS:
        assert (image.coefficients[c] == cells[c]).all()
    assert image.rgb().shape == (height, width, 3)


def test_flat_colour():
    cells = {c: np.zeros((2 * v, 2 * h, 64), int) for c, (h, v) in PARTS.items()}
    for c, dc in ((1, 160), (2, -80), (3, 240)):  # 8 times the level
        cells[c][:, :, 0] = dc
    rgb = jpeg.ProgressiveImage(write(cells, 32, 32, ((1, 63),), 1)).rgb()
    assert {tuple(p) for p in rgb.reshape(-1, 3)} == {(148 + 42, 148 + 3 - 21, 148 - 18)}
