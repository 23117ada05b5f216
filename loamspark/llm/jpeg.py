"""Progressive JPEG in numpy: a lossless carrier of bytes in its coefficients, and a decoder.

The decoder reads any 8-bit progressive file with Huffman coding: each scan adds a band of coefficients (spectral selection) or one more bit
of them (successive approximation) to coefficient arrays, which are then dequantised and inverse-transformed at once; chroma is upsampled by
its sampling factors and converted to RGB. Scans whose Huffman tables hold a single one-bit code have codes of one width, and are read with
array operations; any other scan is read bit by bit.

The carrier writes such files. A byte b becomes an AC coefficient of sign b >> 7 and magnitude 128 + (b & 127): none is zero, so each has the
same code length and nothing depends on runs. Quantisation is 1, so coefficients come back as they were written. Chroma has half the
resolution, so a unit of 16 x 16 pixels holds six blocks, 378 bytes.
"""

from __future__ import annotations

import re
import struct

import numpy as np

UNIT_BLOCKS = 6
#: Bytes that a block carries.
BLOCK_BYTES = 63
#: Within a scan, a byte 255 begins a marker unless a 0 follows.
MARKER = re.compile(rb"\xff[^\x00]", re.DOTALL)

# Fixed value: the zigzag order of a block's coefficients.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

_u = np.arange(8)
BASIS = (np.where(_u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _u[None] + 1) * _u[:, None] * np.pi / 16)).astype(np.float32)  # frequency x place


# ---- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits.ravel(), np.ones(-bits.size % 8, bits.dtype)])).tobytes()


def encode(payload: np.ndarray) -> bytes:
    """A file that carries payload (uint8)."""
    units = max(1, -(-len(payload) // (BLOCK_BYTES * UNIT_BLOCKS)))
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    held = np.zeros(high * wide * UNIT_BLOCKS * BLOCK_BYTES, np.uint8)
    held[: len(payload)] = payload
    units = held.reshape(high, wide, UNIT_BLOCKS, BLOCK_BYTES)
    luma = np.ascontiguousarray(units[:, :, :4].reshape(high, wide, 2, 2, BLOCK_BYTES).transpose(0, 2, 1, 3, 4)).reshape(-1, BLOCK_BYTES)
    planes = [luma, units[:, :, 4].reshape(-1, BLOCK_BYTES), units[:, :, 5].reshape(-1, BLOCK_BYTES)]
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        # one code, '0', in each table: DC difference 0; run 0 and size 7; end of block
        *[_segment(0xC4, bytes([kind, 1] + [0] * 15 + [symbol])) for kind, symbol in ((0x00, 0), (0x10, 7), (0x11, 0))],
        _scan([(1, 0x00), (2, 0x00), (3, 0x00)], 0, 0, 0, 0, _bits(np.zeros(high * wide * UNIT_BLOCKS, np.uint8))),
    ]
    for c, plane in enumerate(planes, 1):
        half = (128 + (plane & 127)) >> 1
        first = np.where(plane & 128, half ^ 127, half).astype(np.uint8)  # a negative number's bits are inverted
        for begin, end in ((1, 5), (6, 63)) if c == 1 else ((1, 63),):
            out.append(_scan([(c, 0x00)], begin, end, 0, 1, first[:, begin - 1 : end].tobytes()))
    for c, plane in enumerate(planes, 1):
        low = np.zeros((len(plane), 64), np.uint8)  # each block begins with the code of its end of block
        low[:, 1:] = plane & 1
        out.append(_scan([(c, 0x01)], 1, 63, 1, 0, _bits(low)))
    return b"".join([*out, b"\xff\xd9"])


# ---- reading


class Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table = number, h, v, table

    def size(self, width: int, height: int, h_max: int, v_max: int) -> None:
        units_wide, units_high = -(-width // (8 * h_max)), -(-height // (8 * v_max))
        self.stride, self.rows = units_wide * self.h, units_high * self.v  # blocks held
        self.wide = -(-(-(-width * self.h // h_max)) // 8)  # blocks that a scan of its own has
        self.high = -(-(-(-height * self.v // v_max)) // 8)
        self.coefficients = np.zeros((self.rows * self.stride, 64), np.int32)
        self.own = (np.arange(self.high)[:, None] * self.stride + np.arange(self.wide)).ravel()

    def own_order(self) -> np.ndarray:
        return self.own

    def unit_order(self) -> np.ndarray:
        """Blocks in the order of interleaved units: units x blocks of a unit."""
        at = np.arange(self.rows * self.stride).reshape(self.rows // self.v, self.v, self.stride // self.h, self.h)
        return at.transpose(0, 2, 1, 3).reshape(-1, self.v * self.h)


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | (self.data[self.at] if self.at < len(self.data) else 1)
            self.at += 1
        return value

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _plain(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


def _dc_scan(parts: list[bytes], of: list[tuple[Component, Huffman]], interval: int, ah: int, al: int) -> None:
    orders = [c.unit_order() if len(of) > 1 else c.own_order()[:, None] for c, _ in of]
    widths = [o.shape[1] for o in orders]
    n = len(orders[0]) * sum(widths)
    if len(parts) == 1 and (ah or all(t.only == 0 for _, t in of)):  # a bit for each block
        bits = np.unpackbits(np.frombuffer(_plain(parts[0]), np.uint8), count=n) if len(parts[0]) * 8 >= n else None
        if bits is not None and (ah or not bits.any()):
            if ah:
                bits = bits.reshape(len(orders[0]), -1).astype(np.int32)
                for (c, _), order, at in zip(of, orders, np.cumsum([0, *widths]), strict=False):
                    c.coefficients[order, 0] |= bits[:, at : at + order.shape[1]] << al
            return
    unit = 0
    for part in parts:
        bits, last = Bits(_plain(part)), [0] * len(of)
        for unit in range(unit, min(len(orders[0]), unit + interval) if interval else len(orders[0])):  # noqa: B020
            for k, ((c, table), order) in enumerate(zip(of, orders, strict=True)):
                for block in order[unit]:
                    if ah:
                        c.coefficients[block, 0] |= bits.take(1) << al
                    else:
                        last[k] += bits.signed(bits.symbol(table))
                        c.coefficients[block, 0] = last[k] << al
        unit += 1


def _ac_scan(parts: list[bytes], c: Component, table: Huffman, interval: int, ss: int, se: int, ah: int, al: int) -> None:
    order, band = c.own_order(), se - ss + 1
    if len(parts) == 1 and table.only is not None:
        raw = np.frombuffer(_plain(parts[0]), np.uint8)
        if not ah and table.only == 7 and len(raw) >= len(order) * band:  # one byte each: the code's bit and seven of the number
            value = raw[: len(order) * band].astype(np.int32).reshape(-1, band)
            if not (value & 128).any():
                c.coefficients[order, ss : se + 1] = np.where(value < 64, value - 127, value) << al
                return
        held = c.coefficients[order, ss : se + 1]
        if ah and table.only == 0 and held.all() and len(raw) * 8 >= len(order) * (band + 1):  # an end of block, then a bit each
            bits = np.unpackbits(raw, count=len(order) * (band + 1)).reshape(-1, band + 1)
            if not bits[:, 0].any():
                c.coefficients[order, ss : se + 1] = held + np.sign(held) * (bits[:, 1:].astype(np.int32) << al)
                return
    block = 0
    for part in parts:
        bits, run = Bits(_plain(part)), 0
        for at in order[block : block + interval] if interval else order:
            run = (_refine if ah else _first)(bits, table, c.coefficients[at], run, ss, se, al)
        block += interval


def _first(bits: Bits, table: Huffman, to: np.ndarray, run: int, ss: int, se: int, al: int) -> int:
    if run:
        return run - 1
    k = ss
    while k <= se:
        skip, size = divmod(bits.symbol(table), 16)
        if size:
            k += skip
            to[k] = bits.signed(size) * (1 << al)
            k += 1
        elif skip == 15:
            k += 16
        else:
            return (1 << skip) - 1 + bits.take(skip)
    return 0


def _refine(bits: Bits, table: Huffman, to: np.ndarray, run: int, ss: int, se: int, al: int) -> int:
    def correct(k: int) -> None:
        if bits.take(1):
            to[k] += (1 << al) if to[k] > 0 else -(1 << al)

    k = ss
    while k <= se and not run:
        skip, size = divmod(bits.symbol(table), 16)
        new = 0
        if size:
            new = (1 << al) if bits.take(1) else -(1 << al)
        elif skip < 15:
            run = (1 << skip) + bits.take(skip)
            break
        while k <= se:
            if to[k]:
                correct(k)
            elif skip:
                skip -= 1
            else:
                to[k] = new
                k += 1
                break
            k += 1
    if run:
        for j in range(k, se + 1):
            if to[j]:
                correct(j)
        run -= 1
    return run


class Picture:
    """A decoded file: width, height, comment, components with their coefficients."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.comment, self.components, interval = b"", [], 0
        self.quantisation: dict[int, np.ndarray] = {}
        huffman: dict[int, Huffman] = {}
        at = 2
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisation[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    huffman[body[0]] = Huffman(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                _, self.height, self.width, count = struct.unpack_from(">BHHB", body)
                self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
                self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
                for c in self.components:
                    c.size(self.width, self.height, self.h, self.v)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xD0)):
                raise ValueError("only progressive Huffman files are read")
            elif marker == 0xDA:
                parts, at = self._entropy(data, at)
                by_number = {c.number: c for c in self.components}
                of = [(by_number[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
                ss, se, ah, al = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
                if ss == 0:
                    _dc_scan(parts, [(c, huffman.get(t >> 4)) for c, t in of], interval, ah, al)
                else:
                    _ac_scan(parts, of[0][0], huffman[0x10 | of[0][1] & 15], interval, ss, se, ah, al)

    @staticmethod
    def _entropy(data: bytes, at: int) -> tuple[list[bytes], int]:
        """The scan's data, cut at restart markers, and where the next marker is."""
        parts, begin = [], at
        for found in MARKER.finditer(data, at):
            if not 0xD0 <= data[found.start() + 1] <= 0xD7:
                return [*parts, data[begin : found.start()]], found.start()
            parts.append(data[begin : found.start()])
            begin = found.end()
        raise ValueError("the file ends within a scan")

    def plane(self, c: Component) -> np.ndarray:
        """Samples of a component at full resolution, as floats about 0 to 255."""
        x = np.zeros((len(c.coefficients), 64), np.float32)
        x[:, ZIGZAG] = c.coefficients * self.quantisation[c.table]
        x = BASIS.T @ x.reshape(-1, 8, 8) @ BASIS + np.float32(128)
        x = np.clip(np.rint(x), 0, 255).reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
        x = x.repeat(self.v // c.v, 0) if c.v < self.v else x
        x = x.repeat(self.h // c.h, 1) if c.h < self.h else x
        return x[: self.height, : self.width]

    def rgb(self) -> np.ndarray:
        """height x width x 3, uint8."""
        y = self.plane(self.components[0])
        if len(self.components) == 1:
            return np.repeat(y[:, :, None], 3, 2).astype(np.uint8)
        cb, cr = (self.plane(c) - np.float32(128) for c in self.components[1:3])
        # fixed values: the conversion of ITU-R BT.601 as JFIF has it
        out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], 2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that encode() put in."""
        n = int(self.comment.removeprefix(b"payload "))
        luma, cb, cr = (c.coefficients for c in self.components)
        units = np.concatenate([luma[self.components[0].unit_order()], cb[:, None], cr[:, None]], 1).reshape(-1, 64)[:, 1:]
        return (np.abs(units) & 127 | (units < 0) << 7).astype(np.uint8).tobytes()[:n]
