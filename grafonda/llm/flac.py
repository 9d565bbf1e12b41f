"""FLAC media columns: an encoder and a decoder in numpy that work on hundreds of frames at a time.

Scope: one channel, 8 bits a sample (a byte b is the sample b - 128), fixed block size; constant, verbatim, fixed and linear
(LPC) subframes; partitioned Rice residuals with 4-bit parameters and raw partitions. The decoder verifies each frame
header's CRC-8, each frame's CRC-16 and the MD5 of all samples, and raises ValueError on damage or on other streams.
The encoder writes a seek table with a point per frame; frames of streams without one are found by their headers' CRC-8 and
frames' CRC-16. Frames are handled in groups of GROUP, so memory does not grow with a stream beyond its own bytes.

Nulls: a null text is an empty one (64 zero bytes); a null doc_id is kept. Empty streams decode to no blocks, an empty table to an
empty result. Texts of any length are stored whole. Repeated rows are stored each, and equal texts give equal streams. Of the input
only the key and the text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .storage import small_batches, work_table

BLOCK = 4096
RATE = 8000
GROUP = 512
#: Frames that are decoded together.
READ = 3072
#: Fixed predictors that the encoder tries: orders 0 to TRIED - 1; and a linear one of two coefficients, of so many bits and such a shift.
TRIED, PRECISION, SHIFT = 3, 12, 10


def _crc_table(poly: int, bits: int, steps: int) -> np.ndarray:
    """Remainders of all values of the top `steps` bits, run through a CRC of `bits` bits."""
    x = np.arange(1 << steps, dtype=np.uint32) << np.uint32(bits - steps)
    for _ in range(steps):
        x = np.where(x >> np.uint32(bits - 1) & 1, (x << np.uint32(1)) ^ np.uint32(poly), x << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return x


_CRC8 = _crc_table(0x07, 8, 8).astype(np.uint8).tolist()
_CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)
_1, _48 = np.uint64(1), np.uint64(48)
_LEADING_ZEROS = np.array([16 - int(x).bit_length() for x in range(1 << 16)], dtype=np.int64)


def crc8(data: bytes) -> int:
    out = 0
    for x in data:
        out = _CRC8[out ^ x]
    return out


def crc16(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of raw, two bytes of all spans at a time; leading zeros change nothing, so spans are set flush right."""
    out = np.zeros(len(starts), np.uint16)
    order = np.argsort(ends - starts)
    for own in np.array_split(order, max(1, len(order) // 400)):
        if not len(own):
            continue
        size = ends[own] - starts[own]
        wide = int(size.max() + 1) // 2 * 2
        table = np.zeros((len(own), wide), np.uint8)
        at = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        table[np.arange(wide) >= (wide - size)[:, None]] = raw[at]
        pairs = np.ascontiguousarray(table.view(">u2").T).astype(np.uint16)
        crc = np.zeros(len(own), np.uint16)
        for x in pairs:
            crc = _CRC16[crc ^ x]
        out[own] = crc
    return out


def _coded(n: int) -> bytes:
    """A frame number as FLAC spells it: UTF-8 carried on to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFE ^ lead * 2 + 1) & 0xFF & ~lead | n, *reversed(tail)])


def _decoded(data: bytes, i: int) -> tuple[int, int]:
    lead, i = data[i], i + 1
    more = 0
    while more < 7 and lead & (0x80 >> more):
        more += 1
    if more == 0:
        return lead, i
    n = lead & (0x7F >> more)
    for x in data[i : i + more - 1]:
        n = n << 6 | x & 0x3F
    return n, i + more - 1


def _residuals(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, residuals) with the fixed order below TRIED of the least absolute sum per frame; rows are frames (zeros beyond their size),
    the first `order` of a row are not residuals."""
    best, order, out, d = None, np.zeros(len(x), np.int64), x, x
    inside = np.arange(x.shape[1]) < size[:, None]
    for k in range(TRIED):
        if k:
            step = np.zeros_like(d)
            np.subtract(d[:, k:], d[:, k - 1 : -1], out=step[:, k:])
            step *= inside
            d = step
        cost = np.abs(d[:, TRIED:]).sum(axis=1, dtype=np.int64)
        if best is None:
            best = cost
        else:
            win = np.flatnonzero((cost < best) & (size > TRIED))
            if len(win):
                out = out.copy() if out is x else out
                best[win], order[win], out[win] = cost[win], k, d[win]
    return order, out


def lpc_residuals(x: np.ndarray, coefficients: list[int], shift: int) -> np.ndarray:
    """What a linear predictor leaves of one frame, after its warm-up samples."""
    k = len(coefficients)
    windows = np.lib.stride_tricks.sliding_window_view(x[:-1], k)[:, ::-1]
    return x[k:] - (windows @ np.array(coefficients) >> shift)


def _predictors(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each frame the two coefficients, in units of 2**-SHIFT, of the linear predictor that leaves the least squares."""
    y = x.astype(np.float32)
    r0, r1, r2 = ((y[:, k:] * y[:, : y.shape[1] - k]).sum(axis=1, dtype=np.float64) for k in range(3))
    low = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    a, b = (r1 * (r0 - r2)) / low, (r0 * r2 - r1 * r1) / low
    most = (1 << PRECISION - 1) - 1
    return np.where((size > 2 * TRIED)[:, None], np.clip(np.rint(np.stack([a, b], axis=1) * (1 << SHIFT)), -most, most), 0).astype(np.int32)


def _frames(blocks: list[np.ndarray], numbers: list[int], lpc: tuple[list[int], int] | None) -> list[bytes]:
    """One FLAC frame for each block of samples (int16)."""
    size = np.array([len(b) for b in blocks])
    x = np.zeros((len(blocks), int(size.max())), np.int16)
    for i, b in enumerate(blocks):
        x[i, : len(b)] = b
    if lpc:
        order = np.where(size > len(lpc[0]), len(lpc[0]), 0)
        linear, shift, coefficients = order > 0, lpc[1], np.tile(np.array(lpc[0], np.int32), (len(blocks), 1))
        left = x.astype(np.int32)
        for i in np.flatnonzero(order):
            left[i, order[i] : size[i]] = lpc_residuals(x[i, : size[i]], *lpc)
    else:
        order, left = _residuals(x, size)
        shift, coefficients = SHIFT, _predictors(x, size)
        guess = left if x.shape[1] < 3 else x.copy()
        if x.shape[1] > 2:
            guess[:, 2:] -= (x[:, 1:-1] * coefficients[:, :1] + x[:, :-2] * coefficients[:, 1:] >> shift).astype(np.int16)
            guess *= np.arange(x.shape[1]) < size[:, None]
        linear = (np.abs(guess[:, TRIED:]).sum(axis=1, dtype=np.int64) < 0.97 * np.abs(left[:, TRIED:]).sum(axis=1, dtype=np.int64)) & (size > 2 * TRIED)
        if linear.any():
            left = np.where(linear[:, None], guess, left)
            order = np.where(linear, 2, order)
    place = np.arange(x.shape[1])
    used = (place < size[:, None]) & (place >= order[:, None])
    zigzag = (left << 1) ^ (left >> 15 if left.dtype == np.int16 else left >> 31)
    zigzag *= used
    n = size - order
    guess = np.floor(np.log2(np.maximum(zigzag.sum(axis=1, dtype=np.int64) / np.maximum(n, 1), 1))).astype(np.int64)
    bits, rice = None, np.zeros(len(blocks), np.int64)
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, 14)
        need = (zigzag >> k[:, None].astype(zigzag.dtype)).sum(axis=1, dtype=np.int64) + n * (1 + k)
        if bits is None:
            bits, rice = need, k
        else:
            rice = np.where(need < bits, k, rice)
            bits = np.minimum(bits, need)
    # per frame: subframe byte, warm-up samples, [predictor], coding method, partition order, parameter
    wide = PRECISION if not lpc else 8
    head_bits = 8 + 8 * order + np.where(linear, 4 + 5 + wide * order, 0) + 10
    flat = ((x == x[:, :1]) | (place >= size[:, None])).all(axis=1)
    verbatim = ~flat & (head_bits + bits >= 8 + 8 * size)
    body = np.where(flat, 16, np.where(verbatim, 8 + 8 * size, head_bits + bits))
    heads = []
    for number, length in zip(numbers, size.tolist(), strict=True):
        h = bytes([0xFF, 0xF8, (0xC0 if length == BLOCK else 0x70) | 0x04, 0x02]) + _coded(number) + (b"" if length == BLOCK else (length - 1).to_bytes(2, "big"))
        heads.append(h + bytes([crc8(h)]))
    head = np.array([len(h) for h in heads])
    total = head + (body + 7) // 8
    start = np.concatenate(([0], np.cumsum(total + 2)))
    stream = np.zeros(int(start[-1]) * 8, np.uint8)
    fine = np.flatnonzero(~flat & ~verbatim)
    if len(fine):
        value = (zigzag if len(fine) == len(blocks) else zigzag[fine])[used if len(fine) == len(blocks) else used[fine]].astype(np.int32)
        k = np.repeat(rice[fine], n[fine]).astype(np.int32)
        q = value >> k
        length = q + 1 + k
        first = np.concatenate(([0], np.cumsum(n[fine])))
        ahead = np.cumsum(length, dtype=np.int64) - length
        bit = ahead - np.repeat(ahead[np.minimum(first[:-1], max(len(ahead) - 1, 0))], n[fine]) + np.repeat((start[:-1] + head)[fine] * 8 + head_bits[fine], n[fine]) + q
        stream[bit] = 1
        for j in range(int(k.max()) if len(k) else 0):
            some = slice(None) if k.min() > j else np.flatnonzero(k > j)
            stream[bit[some] + 1 + j] = value[some] >> (k[some] - 1 - j) & 1
    packed = np.packbits(stream)
    for i, h in enumerate(heads):
        a = int(start[i])
        packed[a : a + len(h)] = np.frombuffer(h, np.uint8)
        a += len(h)
        if flat[i]:
            packed[a : a + 2] = 0, int(x[i, 0]) & 0xFF
        elif verbatim[i]:
            packed[a] = 2
            packed[a + 1 : a + 1 + size[i]] = x[i, : size[i]].astype(np.int8).view(np.uint8)
        else:
            k = int(order[i])
            packed[a] = (0x40 | (k - 1) << 1) if linear[i] else (0x10 | k << 1)
            packed[a + 1 : a + 1 + k] = x[i, :k].astype(np.int8).view(np.uint8)
            if linear[i]:
                fields = f"{wide - 1:04b}{shift:05b}" + "".join(f"{c & (1 << wide) - 1:0{wide}b}" for c in coefficients[i, :k].tolist()) + f"000000{int(rice[i]):04b}"
            else:
                fields = f"000000{int(rice[i]):04b}"
            at = a + 1 + k
            merged = int(fields, 2) << (-len(fields) % 8)
            some = np.frombuffer(merged.to_bytes((len(fields) + 7) // 8, "big"), np.uint8)
            packed[at : at + len(some)] |= some
    crc = crc16(packed, start[:-1], start[:-1] + total)
    packed[start[1:] - 2], packed[start[1:] - 1] = crc >> 8, crc & 0xFF
    data = packed.tobytes()
    return [data[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def encode(payloads: list[bytes], lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """A FLAC stream for each payload. lpc: (8-bit coefficients, shift) of a linear predictor for all frames; else each frame gets
    the fixed or the fitted linear predictor that leaves least."""
    work = [(d, number, np.frombuffer(p, np.uint8, min(BLOCK, len(p) - a), a).astype(np.int16) - 128) for d, p in enumerate(payloads) for number, a in enumerate(range(0, len(p), BLOCK))]
    work.sort(key=lambda w: len(w[2]))
    frames: list[list] = [[None] * -(-len(p) // BLOCK) for p in payloads]
    for i in range(0, len(work), GROUP):
        own = work[i : i + GROUP]
        for (d, number, _), frame in zip(own, _frames([w[2] for w in own], [w[1] for w in own], lpc), strict=True):
            frames[d][number] = frame
    out = []
    for p, own in zip(payloads, frames, strict=True):
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        sizes = [len(f) for f in own] or [0]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        at, points = 0, []
        for k, f in enumerate(own):
            points.append((k * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(p) - k * BLOCK).to_bytes(2, "big"))
            at += len(f)
        table = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


class Stream:
    """A parsed stream: its samples, MD5 and frames as (sample offset, samples, first byte, end byte)."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        i, last, points = 4, False, []
        while not last:
            last, kind, size = data[i] >> 7, data[i] & 0x7F, int.from_bytes(data[i + 1 : i + 4], "big")
            block, i = data[i + 4 : i + 4 + size], i + 4 + size
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                if (packed >> 41 & 7) != 0 or (packed >> 36 & 31) != 7:
                    raise ValueError("only one channel of 8 bits is read")
                self.block, self.samples, self.md5 = int.from_bytes(block[:2], "big"), packed & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                points = [(int.from_bytes(block[k : k + 8], "big"), int.from_bytes(block[k + 8 : k + 16], "big"), int.from_bytes(block[k + 16 : k + 18], "big")) for k in range(0, size, 18)]
        self.data = data
        if sum(p[2] for p in points) == self.samples and self.samples:
            ends = [p[1] for p in points[1:]] + [len(data) - i]
            self.frames = [(p[0], p[2], i + p[1], i + e) for p, e in zip(points, ends, strict=True)]
        else:
            self.frames = self._found(i)

    def _found(self, i: int) -> list[tuple[int, int, int, int]]:
        """Frames by their headers' CRC-8 and their own CRC-16."""
        out, raw, begin = [], np.frombuffer(self.data, np.uint8), i
        marks = [m for m in range(i, len(self.data) - 6) if self.data[m] == 0xFF and self.data[m + 1] == 0xF8 and self._header(m) is not None]
        for m in [*marks[1:], len(self.data)]:
            if m > begin and crc16(raw, np.array([begin]), np.array([m]))[0] == 0:
                number, size, _ = self._header(begin)
                out.append((number * self.block, size, begin, m))
                begin = m
        if begin < len(self.data):
            raise ValueError("a frame is damaged")
        return out

    def _header(self, a: int) -> tuple[int, int, int] | None:
        """(frame number, samples, end of header), or None if there is no sound header here."""
        data = self.data
        code = data[a + 2] >> 4
        if data[a] != 0xFF or data[a + 1] != 0xF8 or data[a + 3] & 0xF1 or (data[a + 3] >> 1 & 7) not in (0, 1):
            return None
        number, i = _decoded(data, a + 4)
        if code == 6:
            size, i = data[i] + 1, i + 1
        elif code == 7:
            size, i = int.from_bytes(data[i : i + 2], "big") + 1, i + 2
        else:
            size = {1: 192}.get(code) or (576 << code - 2 if code < 6 else 256 << code - 8)
        rate = data[a + 2] & 15
        i += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        return (number, size, i + 1) if i < len(data) and crc8(data[a:i]) == data[i] else None


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8 - at

    def take(self, n: int) -> int:
        self.left -= n
        return self.value >> self.left & (1 << n) - 1


def _decode_group(streams: list[Stream], wanted: list[tuple[int, int]]) -> list[np.ndarray]:
    """Samples (int16) of each (stream, frame)."""
    cuts = [streams[s].frames[f] for s, f in wanted]
    raw = np.frombuffer(b"".join(streams[s].data[c[2] : c[3]] for (s, _), c in zip(wanted, cuts, strict=True)) + bytes(16), np.uint8)
    base = np.concatenate(([0], np.cumsum([c[3] - c[2] for c in cuts])))
    if crc16(raw, base[:-1], base[1:]).any():
        raise ValueError("a frame's CRC-16 is wrong")
    out: list = [None] * len(wanted)
    rice = []
    for i, ((s, f), cut) in enumerate(zip(wanted, cuts, strict=True)):
        head = streams[s]._header(cut[2])
        if head is None or head[1] != cut[1] or head[0] * streams[s].block != cut[0]:
            raise ValueError("a frame header's CRC-8, number or size is wrong")
        a = int(base[i]) + head[2] - cut[2]
        kind = int(raw[a]) >> 1
        if raw[a] & 0x81:
            raise ValueError("wasted bits are not read")
        if kind == 0:
            out[i] = np.full(cut[1], raw[a + 1].view(np.int8), np.int32)
        elif kind == 1:
            out[i] = raw[a + 1 : a + 1 + cut[1]].view(np.int8).astype(np.int32)
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = raw[a + 1 : a + 1 + order].view(np.int8).astype(np.int64)
            bits = _Bits(raw[a + 1 + order : a + 80 + 4 * order].tobytes(), 0)
            full = bits.left
            predictor = None
            if kind >= 32:
                wide, shift = bits.take(4) + 1, bits.take(5)
                predictor = ([(c ^ 1 << wide - 1) - (1 << wide - 1) for c in (bits.take(wide) for _ in range(order))], shift)
            method, parts = bits.take(2), bits.take(4)
            if method:
                raise ValueError("only 4-bit Rice parameters are read")
            rice.append((cut[1], i, order, warm, predictor, parts, (a + 1 + order) * 8 + full - bits.left))
        else:
            raise ValueError("a reserved kind of subframe")
    if rice:
        rice.sort(key=lambda r: -r[0])
        _decode_rice(raw, rice, out)
    return out


def _decode_rice(raw: np.ndarray, rice: list, out: list) -> None:
    """All frames step by step together: each step reads the next residual of every frame that still has one."""
    size = np.array([r[0] for r in rice])
    order = np.array([r[2] for r in rice])
    bit = np.array([r[6] for r in rice], np.int64)
    k = np.zeros(len(rice), np.int64)
    raw_bits = np.full(len(rice), -1)
    words = np.ndarray(len(raw) - 8, np.uint64, raw, strides=(1,))  # the eight bytes from each byte on
    left = np.zeros((int(size.max()), len(rice)), np.int32)
    begin: dict[int, list[int]] = {}  # where partitions begin; a frame's first residual comes after its warm-up
    for f, (n, _, o, _, _, parts, _) in enumerate(rice):
        for p in range(1 << parts):
            at = p * (n >> parts) if p else o
            if p and at <= o:
                raise ValueError("a partition is shorter than the warm-up")
            begin.setdefault(at, []).append(f)
    active = np.searchsorted(-size, -np.arange(int(size.max())), "left")  # frames with size > t come first
    low = int(order.min())
    ready = int(order.max())
    plain = True
    for t in range(low, int(size.max())):
        m = int(active[t])
        if t in begin:
            for f in begin[t]:
                v = int.from_bytes(raw[bit[f] >> 3 : (bit[f] >> 3) + 3].tobytes(), "big")
                got = v >> (20 - (bit[f] & 7)) & 15
                bit[f] += 4
                raw_bits[f] = -1
                if got == 15:
                    raw_bits[f] = v >> (15 - (bit[f] - 4 & 7)) & 31
                    bit[f] += 5
                    plain = False
                k[f] = got
        if t >= ready and plain:
            own, b, kk = slice(0, m), bit[:m], k[:m]
        else:
            own = np.flatnonzero((order[:m] <= t) & (raw_bits[:m] < 0))
            for f in np.flatnonzero((order[:m] <= t) & (raw_bits[:m] >= 0)):
                n = int(raw_bits[f])
                v = int.from_bytes(raw[bit[f] >> 3 : (bit[f] >> 3) + 6].tobytes(), "big") >> (48 - (bit[f] & 7) - n) & (1 << n) - 1
                v = v - (1 << n) if n and v >> n - 1 else v
                left[t, f] = 2 * v if v >= 0 else -2 * v - 1
                bit[f] += n
            b, kk = bit[own], k[own]
        word = words[b >> 3].byteswap() << (b & 7).view(np.uint64)
        q = _LEADING_ZEROS[(word >> _48).view(np.int64)]
        used = q + 1
        value = (q << kk) | (word << used.view(np.uint64) >> _1 >> (63 - kk).view(np.uint64)).view(np.int64)
        used += kk
        for f in np.flatnonzero(q >= 16) if q.max(initial=0) >= 16 else ():  # long runs of zeros, one frame at a time
            at, n = int(b[f]), 0
            while not raw[at + n >> 3] >> (7 - (at + n & 7)) & 1:
                n += 1
                if at + n >= len(raw) * 8 - 64:
                    raise ValueError("a residual runs past its frame")
            z = int(kk[f])
            v = int.from_bytes(raw[(at + n + 1) >> 3 : ((at + n + 1) >> 3) + 4].tobytes(), "big") >> (32 - (at + n + 1 & 7) - z) & (1 << z) - 1
            value[f], used[f] = n << z | v, n + 1 + z
        left[t, own] = value
        bit[own] = b + used
    signed = (left >> 1) ^ -(left & 1)
    linear: dict[int, list[int]] = {}
    for f, (n, i, o, warm, predictor, _, _) in enumerate(rice):
        if predictor is not None:
            linear.setdefault(o, []).append(f)
            continue
        x = signed[:n, f].astype(np.int64)
        # undo the differences one order at a time: each needs its own first value
        firsts = [warm]
        for _ in range(o):
            firsts.append(np.diff(firsts[-1]))
        body = x[o:]
        for j in range(o - 1, -1, -1):
            body = np.cumsum(body) + firsts[j][-1]
        x[:o], x[o:] = warm, body
        out[i] = x.astype(np.int32)
    for o, own in linear.items():
        x = signed[:, own].astype(np.int32 if o <= 2 else np.int64)
        x[:o] = np.array([rice[f][3] for f in own]).T
        c = np.array([rice[f][4][0] for f in own], x.dtype).T
        shift = np.array([rice[f][4][1] for f in own], x.dtype)
        for t in range(o, len(x)):
            guess = c[0] * x[t - 1]
            for k in range(1, o):
                guess += c[k] * x[t - 1 - k]
            x[t] += guess >> shift
        for f, column in zip(own, x.T, strict=True):
            out[rice[f][1]] = column[: rice[f][0]].astype(np.int32)


def decode(medias: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its blocks, as (sample offset, bytes of samples as they were before encoding); all checksums are verified."""
    streams = [Stream(m) for m in medias]
    wanted = sorted(((s, f) for s, x in enumerate(streams) for f in range(len(x.frames))), key=lambda w: streams[w[0]].frames[w[1]][1])
    blocks: list[list] = [[None] * len(x.frames) for x in streams]
    for i in range(0, len(wanted), READ):
        own = wanted[i : i + READ]
        for (s, f), x in zip(own, _decode_group(streams, own), strict=True):
            blocks[s][f] = (streams[s].frames[f][0], (x + 128).astype(np.uint8))
    for x, own in zip(streams, blocks, strict=True):
        check = hashlib.md5()
        for _, b in own:
            check.update((b ^ 0x80).tobytes())
        if x.md5 != bytes(16) and check.digest() != x.md5:
            raise ValueError("the MD5 of the samples is wrong")
    return blocks


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def _runs(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes]]]:
    for i, j, raw, at in tokens.chunks(column, most):
        data = raw.tobytes()
        yield i, j, [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: the padded UTF-8 of each row's text as a FLAC stream."""

    def stored(batches):
        for batch in batches:
            for i, j, texts in _runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([padded(t) for t in texts]), pa.binary())], [key, "n_bytes", "media"])

    return small_batches(docs.select(key, text)).mapInArrow(stored, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def _media(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[bytes]]]:
    column, i, size, own = batch.column(name), 0, 0, []
    for j in range(len(column)):
        own.append(column[j].as_py() or b"")
        size += len(own[-1])
        if size >= 6 << 20 or j + 1 == len(column):
            yield i, j + 1, own
            i, size, own = j + 1, 0, []


def decode_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, block, sample_offset, n_samples, pcm (8-bit unsigned): a row for each PCM block; null media give none."""

    def blocks(batches):
        for batch in batches:
            for i, _, own in _media(batch, column):
                rows = [(i + d, k, at, x) for d, (m, b) in enumerate(zip(own, decode([o for o in own if o]) if all(own) else [decode([o])[0] if o else [] for o in own], strict=True)) for k, (at, x) in enumerate(b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[3].tobytes() for r in rows], pa.binary())], [key, "block", "sample_offset", "n_samples", "pcm"])

    return small_batches(media.select(key, column)).mapInArrow(blocks, f"`{key}` {media.schema[key].dataType.simpleString()}, block int, sample_offset long, n_samples long, pcm binary")


def feature(blocks: list[tuple[int, np.ndarray]]) -> str:
    """samples:lowest:highest:sum:energy:sign changes, of signed samples."""
    x = np.concatenate([b for _, b in blocks]).astype(np.int64) - 128 if blocks else np.zeros(0, np.int64)
    if not len(x):
        return "0:0:0:0:0:0"
    return ":".join(map(str, (len(x), x.min(), x.max(), x.sum(), (x * x).sum(), int(((x[1:] < 0) != (x[:-1] < 0)).sum()))))


def digest(media: DataFrame) -> DataFrame:
    """What op2 returns of encode_text's rows: figures of the stored bytes and of what is read back from them."""

    def figures(batches):
        for batch in batches:
            for i, j, own in _media(batch, "media"):
                rows = []
                for m, blocks in zip(own, decode(own), strict=True):
                    payload = b"".join(x.tobytes() for _, x in blocks)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(blocks)))
                parts = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *parts], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return small_batches(media).mapInArrow(figures, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(docs: DataFrame, name: str = "media") -> DataFrame:
    """encode_text's rows, written to the shared folder as a table of media and read from there: a reader gets the stored bytes."""
    return work_table(encode_text(docs), name)


def op2_flac_media(spark, sf_dir: str) -> DataFrame:
    return digest(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
