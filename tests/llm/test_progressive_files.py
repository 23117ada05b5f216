"""Progressive files that another encoder wrote: real Huffman tables, refinement scans, restart intervals, subsampled chroma; against plain inverse transforms."""

import numpy as np
import pytest

from loamspark.llm import jpeg

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


class Bits:
    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value, n):
        for i in range(n - 1, -1, -1):
            self.held, self.n = self.held << 1 | value >> i & 1, self.n + 1
            if self.n == 8:
                self.out.append(self.held)
                if self.held == 255:
                    self.out.append(0)
                self.held = self.n = 0

    def end(self):
        while self.n:
            self.put(1, 1)
        done, self.out = bytes(self.out), bytearray()
        return done


def segment(marker, body):
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + bytes(body)


def flat_table(kind, symbols):
    """A table in which every symbol has a code of eight bits (so none is all ones)."""
    assert len(symbols) < 255
    return segment(0xC4, [kind, *[0] * 7, len(symbols), *[0] * 8, *symbols]), {s: (i, 8) for i, s in enumerate(symbols)}


def category(v):
    return int(abs(v)).bit_length()


def extra(v):
    n = category(v)
    return (v if v > 0 else v + (1 << n) - 1), n


def write(blocks, width, height, sampling, quant, restart=0):
    """A progressive file of coefficient blocks {component: rows x columns x 64 (natural order)}: first scans without the lowest bit, then refinements."""
    ids = sorted(blocks)
    dc_table, dc = flat_table(0x00, list(range(12)))
    ac_table, ac = flat_table(0x10, [r << 4 | s for r in range(16) for s in range(0, 11)])
    out = [b"\xff\xd8", segment(0xDB, [0, *[quant[i] for i in ZIGZAG]])]
    out.append(segment(0xC2, [8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(ids), *sum(([c, sampling[c][0] << 4 | sampling[c][1], 0] for c in ids), [])]))
    out += [dc_table, ac_table]
    if restart:
        out.append(segment(0xDD, restart.to_bytes(2, "big")))
    hmax, vmax = (max(sampling[c][k] for c in ids) for k in (0, 1))
    mcus_x, mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))

    def scan(components, ss, se, ah, al, units):
        head = segment(0xDA, [len(components), *sum(([c, 0] for c in components), []), ss, se, ah << 4 | al])
        data, bits, since, mark = bytearray(), Bits(), 0, 0
        previous = dict.fromkeys(ids, 0)
        for unit in units:
            if restart and since == restart:
                data += bits.end() + bytes([255, 0xD0 + mark])
                mark, since, previous = (mark + 1) % 8, 0, dict.fromkeys(ids, 0)
            for c, block in unit:
                if ss == 0 and not ah:
                    v = int(block[0]) >> al
                    d, previous[c] = v - previous[c], v
                    bits.put(*dc[category(d)])
                    if d:
                        bits.put(*extra(d))
                elif ss == 0:
                    bits.put(int(block[0]) >> al & 1, 1)
                else:
                    ac_block(bits, [int(block[ZIGZAG[k]]) for k in range(ss, se + 1)], ah, al)
            since += 1
        out.extend([head, bytes(data) + bits.end()])

    def ac_block(bits, values, ah, al):
        now = [(abs(v) >> al) * (1 if v > 0 else -1) for v in values]
        if not ah:
            run = 0
            for v in now:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits.put(*ac[0xF0])
                    run -= 16
                bits.put(*ac[run << 4 | category(v)])
                bits.put(*extra(v))
                run = 0
            if run:
                bits.put(*ac[0])
            return
        last = max((i for i, v in enumerate(now) if abs(v) == 1), default=-1)
        run, later = 0, []
        for i, v in enumerate(now):
            if i > last:
                break
            if abs(v) > 1:
                later.append(abs(v) & 1)
            elif not v:
                run += 1
                if run == 16:
                    bits.put(*ac[0xF0])
                    for b in later:
                        bits.put(b, 1)
                    run, later = 0, []
            else:
                bits.put(*ac[run << 4 | 1])
                bits.put(int(v > 0), 1)
                for b in later:
                    bits.put(b, 1)
                run, later = 0, []
        if last < len(now) - 1:
            bits.put(*ac[0])
            for b in [*later, *(abs(v) & 1 for v in now[last + 1 :] if abs(v) > 1)]:
                bits.put(b, 1)

    def interleaved():
        for my in range(mcus_y):
            for mx in range(mcus_x):
                yield [(c, blocks[c][my * sampling[c][1] + y, mx * sampling[c][0] + x]) for c in ids for y in range(sampling[c][1]) for x in range(sampling[c][0])]

    def single(c):
        columns, lines = -(-(-(-width * sampling[c][0] // hmax)) // 8), -(-(-(-height * sampling[c][1] // vmax)) // 8)
        return ([(c, blocks[c][y, x])] for y in range(lines) for x in range(columns))

    scan(ids, 0, 0, 0, 1, interleaved())
    for c in ids:
        scan([c], 1, 5, 0, 1, single(c))
        scan([c], 6, 63, 0, 1, single(c))
    scan(ids, 0, 0, 1, 0, interleaved())
    for c in ids:
        scan([c], 1, 63, 1, 0, single(c))
    return b"".join(out) + b"\xff\xd9"


def plain(blocks, quant):
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    lines, columns = blocks.shape[:2]
    picture = np.zeros((8 * lines, 8 * columns))
    for y in range(lines):
        for x in range(columns):
            picture[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ (blocks[y, x] * quant).reshape(8, 8) @ basis + 128
    return np.clip(np.rint(picture), 0, 255)


@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize("sampling", [{1: (1, 1), 2: (1, 1), 3: (1, 1)}, {1: (2, 2), 2: (1, 1), 3: (1, 1)}])
def test_files_of_another_encoder(sampling, restart):
    rng = np.random.default_rng(7)
    width, height = 37, 21
    hmax, vmax = max(s[0] for s in sampling.values()), max(s[1] for s in sampling.values())
    quant = np.arange(2, 66)
    blocks = {}
    for c, (h, v) in sampling.items():
        shape = (-(-height // (8 * vmax)) * v, -(-width // (8 * hmax)) * h)
        b = np.zeros((*shape, 64), np.int64)
        b[..., 0] = rng.integers(-300, 300, shape) // 4
        at = rng.random(b.shape) < 0.2
        at[..., 0] = False
        b[at] = rng.integers(-9, 10, at.sum())
        blocks[c] = b
    picture = jpeg.Picture(write(blocks, width, height, sampling, quant, restart))
    assert (picture.width, picture.height) == (width, height)
    rgb = picture.rgb()
    assert rgb.shape == (height, width, 3)
    planes = []
    for c, (h, v) in sampling.items():
        p = plain(blocks[c], quant)
        planes.append(np.repeat(np.repeat(p, vmax // v, 0), hmax // h, 1)[:height, :width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255)
    assert np.abs(rgb.astype(int) - want).max() <= 2
