"""Media columns: a FLAC reader and writer over whole batches of frames.

The decoder reads Rice (and escaped) residuals, fixed and linear predictors, constant and verbatim subframes of mono
8-bit streams, and verifies CRC-8 of frame headers, CRC-16 of frames and the MD5 of the samples. Many frames advance in
step: sample i of all of them is read at once. Where a seek table names every frame all frames of a batch go together,
otherwise one frame of every stream at a time. Out come PCM blocks with their sample and byte offsets.

The writer stores bytes as 8-bit samples in blocks of 576 with a seek point for each frame, and picks, frame by frame, the
smallest of constant, verbatim, fixed predictors and linear prediction.

Defined results: a null text counts as empty, which is one block of padding; any bytes are stored as they are; rows are
treated each, whatever their doc_id, and equal texts give equal streams; an empty table gives an empty result; other
columns are ignored. A very long text is coded in groups of frames, and its seek table names fewer of them. A damaged
stream raises `FlacError`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_bytes, thrifty

BLOCK = 576
RATE = 8000
PAD = 255
#: Frames that are coded in step.
GROUP = 1024
PARTITION_ORDER = 2
#: Seek points of one table, whose size has 24 bits; a longer stream names every second frame, or every third, and so on.
MOST_POINTS = ((1 << 24) - 1) // 18
#: Fixed predictors that stored texts may use, beside linear prediction.
ORDERS = (0, 1)
_PARAMETERS = range(2, 9)


class FlacError(ValueError):
    """A stream that is not the FLAC that is expected, or fails one of its checksums."""


def _crc_tables(poly: int, bits: int, length: int) -> np.ndarray:
    """Row i: what a byte i places before the end of a message adds (xor) to its checksum."""
    top, full = 1 << (bits - 1), (1 << bits) - 1
    row = np.arange(256, dtype=np.int64) << (bits - 8)
    out = np.empty((length, 256), np.uint16)
    for i in range(length):
        for _ in range(8):
            row = np.where(row & top, (row << 1) ^ poly, row << 1) & full
        out[i] = row
    return out


_TABLES: dict[int, np.ndarray] = {}


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of many byte ranges. A checksum is linear in its message, so it is one gather and one reduction."""
    span = int((ends - starts).max(initial=0))
    table = _TABLES.get(bits)
    if table is None or len(table) < span:
        table = _TABLES[bits] = _crc_tables(0x8005 if bits == 16 else 0x07, bits, max(1024 if bits == 16 else 16, 2 * span))
    at = ends[:, None] - 1 - np.arange(span)
    inside = at >= starts[:, None]
    byte = np.where(inside, data[np.maximum(at, 0)], 0)
    return np.bitwise_xor.reduce(table[np.arange(span), byte], axis=1) if span else np.zeros(len(starts), np.uint16)


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    extra = next(k for k in range(1, 7) if n < 1 << (6 * k + 6 - k)) if n >= 0x80 else 0
    lead = (0xFF << (7 - extra)) & 0xFF
    return bytes([lead | n >> (6 * extra), *(0x80 | n >> (6 * k) & 0x3F for k in range(extra - 1, -1, -1))])


_HEADERS: dict[int, bytes] = {}


def _header(number: int) -> bytes:
    """The header of a fixed-size mono 8-bit frame of 576 samples."""
    if number not in _HEADERS:
        raw = bytes([0xFF, 0xF8, 0x24, 0x02]) + _coded_number(number)
        got = raw + bytes([int(_crc(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 8)[0])])
        if len(_HEADERS) > 65536:
            return got
        _HEADERS[number] = got
    return _HEADERS[number]


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


@dataclass
class _Choice:
    """How frames of one kind are coded. bits: size of the subframe; u, k: residuals and Rice parameters."""

    kind: int
    order: int
    bits: np.ndarray
    u: np.ndarray | None = None
    k: np.ndarray | None = None
    coefs: np.ndarray | None = None


def _rice(residual: np.ndarray, order: int, overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals (0 at the warm-up samples), best parameters by partition, and bits of the subframe."""
    u = _zigzag(residual)
    u[:, :order] = 0
    parts = u.reshape(len(u), 1 << PARTITION_ORDER, -1)
    n = np.full(parts.shape[1], parts.shape[2])
    n[0] -= order
    cost = np.stack([(parts >> k).sum(2) + n * (k + 1) for k in _PARAMETERS], 2)
    best = cost.argmin(2)
    bits = np.take_along_axis(cost, best[:, :, None], 2)[:, :, 0].sum(1) + 8 + 8 * order + 6 + 4 * parts.shape[1] + overhead
    return u, best + _PARAMETERS[0], bits


LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 12, 9


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of each frame, by Levinson and Durbin's recursion over its autocorrelations, and their
    residuals. The sums are whole numbers and the rest is done frame by frame, so equal frames have equal predictors."""
    n, size = LPC_ORDER, x.shape[1]
    r = [np.einsum("fi,fi->f", x[:, k:], x[:, : size - k]).astype(float) for k in range(n + 1)]
    error = r[0] + 1e-3
    coefs: list[np.ndarray] = []
    for i in range(n):
        rest = r[i + 1]
        for j, c in enumerate(coefs):
            rest = rest - c * r[i - j]
        k = rest / error
        coefs = [c - k * coefs[i - 1 - j] for j, c in enumerate(coefs)] + [k]
        error = error * (1 - k * k) + 1e-3
    limit = (1 << (LPC_PRECISION - 1)) - 1
    q = np.clip(np.rint(np.stack(coefs, 1) * (1 << LPC_SHIFT)), -limit, limit).astype(np.int32)
    guess = np.zeros((len(x), size - n), np.int32)  # of 20 bits at most
    for j in range(n):
        guess += q[:, j : j + 1] * x[:, n - 1 - j : size - 1 - j]
    residual = x.copy()
    residual[:, n:] -= guess >> LPC_SHIFT
    return q, residual


def encode_frames(samples: np.ndarray, numbers: list[int], orders: tuple[int, ...] = (0, 1, 2), linear: bool = False) -> list[bytes]:
    """The frames of a (frames, 576) matrix of signed 8-bit samples."""
    x = samples.astype(np.int32)
    choices = [_Choice(0, 0, np.where((x == x[:, :1]).all(1), 16, 1 << 30)), _Choice(1, 0, np.full(len(x), 8 + 8 * BLOCK))]
    residual = x
    for order in range(max(orders, default=-1) + 1):
        if order in orders:
            u, k, bits = _rice(residual.copy(), order, 0)
            choices.append(_Choice(8 + order, order, bits, u, k))
        residual = np.diff(residual, axis=1, prepend=0)
    if linear:
        coefs, residual = _linear(x)
        u, k, bits = _rice(residual, LPC_ORDER, 9 + LPC_ORDER * LPC_PRECISION)
        choices.append(_Choice(32 + LPC_ORDER - 1, LPC_ORDER, bits, u, k, coefs))
    cost = np.stack([c.bits for c in choices], 1)
    chosen = cost.argmin(1)
    heads = [_header(n) for n in numbers]
    head = np.array([len(h) for h in heads])
    size = head + -(-cost[np.arange(len(x)), chosen] // 8) + 2
    starts = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros(int(starts[-1]) * 8, np.uint8)
    for i, c in enumerate(choices):
        f = np.flatnonzero(chosen == i)
        if not len(f):
            continue
        at = (starts[f] + head[f]) * 8
        _put(bits, at, np.full(len(f), c.kind << 1), 8)
        at = at + 8
        plain = 1 if c.kind == 0 else BLOCK if c.kind == 1 else c.order
        if plain:
            _put(bits, (at[:, None] + 8 * np.arange(plain)).ravel(), (x[f, :plain] & 0xFF).ravel(), 8)
            at = at + 8 * plain
        if c.u is None:
            continue
        if c.coefs is not None:
            _put(bits, at, np.full(len(f), LPC_PRECISION - 1), 4)
            _put(bits, at + 4, np.full(len(f), LPC_SHIFT), 5)
            for j in range(LPC_ORDER):
                _put(bits, at + 9 + j * LPC_PRECISION, c.coefs[f, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
            at = at + 9 + LPC_ORDER * LPC_PRECISION
        _put(bits, at, np.full(len(f), PARTITION_ORDER), 6)
        u, k = c.u[f], np.repeat(c.k[f], BLOCK >> PARTITION_ORDER, axis=1)
        q = u >> k
        length = q + 1 + k
        length[:, : c.order] = 0
        part = np.arange(BLOCK) // (BLOCK >> PARTITION_ORDER)
        begin = at[:, None] + 6 + 4 * (part + 1) + np.cumsum(length, axis=1) - length
        first = np.arange(1 << PARTITION_ORDER) * (BLOCK >> PARTITION_ORDER)
        _put(bits, (begin[:, first] - 4).ravel(), c.k[f].ravel(), 4)  # warm-up samples are 0 bits long
        begin, q, k, u = (z[:, c.order :].ravel() for z in (begin, q, k, u))
        stop = begin + q
        bits[stop] = 1
        for value in np.unique(k).tolist():
            own = np.flatnonzero(k == value)
            _put(bits, stop[own] + 1, u[own], value)
    data = np.packbits(bits)
    for start, raw in zip(starts[:-1].tolist(), heads, strict=True):
        data[start : start + len(raw)] = np.frombuffer(raw, np.uint8)
    ends = starts[1:] - 2
    crc = _crc(data, starts[:-1], ends, 16)
    data[ends], data[ends + 1] = crc >> 8, crc & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def encode_streams(payloads: list[bytes], orders: tuple[int, ...] = (0, 1, 2), linear: bool = False, seek: bool = True) -> list[bytes]:
    """One FLAC stream for each payload, whose length is a multiple of 576."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = [i for n in counts for i in range(n)]
    frames: list[bytes] = []
    for a in range(0, len(samples), GROUP):
        frames += encode_frames(samples[a : a + GROUP], numbers[a : a + GROUP], orders, linear)
    out, at = [], 0
    for n in counts:
        own = frames[at : at + n]
        sizes = [len(f) for f in own]
        rate = RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK
        info = BLOCK.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + rate.to_bytes(8) + hashlib.md5(samples[at : at + n].tobytes()).digest()
        points = b""
        if seek:
            named = np.arange(0, n, -(-n // MOST_POINTS))
            table = np.empty((len(named), 18), np.uint8)
            table[:, :8] = (named.astype(np.uint64) * np.uint64(BLOCK)).astype(">u8")[:, None].view(np.uint8)
            table[:, 8:16] = (np.cumsum(sizes) - sizes)[named].astype(">u8")[:, None].view(np.uint8)
            table[:, 16:] = np.frombuffer(BLOCK.to_bytes(2), np.uint8)
            points = b"\x83" + table.size.to_bytes(3) + table.tobytes()
        out.append(b"fLaC" + (b"\x00" if seek else b"\x80") + len(info).to_bytes(3) + info + points + b"".join(own))
        at += n
    return out


@dataclass
class Stream:
    """What the metadata blocks say. points: (sample, byte from the first frame, samples) of each seek point."""

    audio: int
    block: int
    total: int
    md5: bytes
    points: np.ndarray


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, last, info, points = 4, False, b"", np.zeros((0, 3), np.int64)
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            info = body
        elif kind == 3:
            raw = np.frombuffer(body, np.uint8).reshape(-1, 18)
            real = ~(raw[:, :8] == 0xFF).all(1)
            raw = raw[real]
            points = np.stack([np.ascontiguousarray(raw[:, a:b]).view(t)[:, 0].astype(np.int64) for a, b, t in ((0, 8, ">u8"), (8, 16, ">u8"), (16, 18, ">u2"))], 1)
    rate = int.from_bytes(info[10:18])
    if (rate >> 41 & 7, rate >> 36 & 31) != (0, 7):
        raise FlacError("not a mono stream of 8-bit samples")
    return Stream(at, int.from_bytes(info[:2]), rate & (1 << 36) - 1, info[18:34], points)


def _frame_header(data: bytes, at: int) -> tuple[int, int]:
    """(length of the header, block size)."""
    if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise FlacError("no frame where one is expected")
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    lead, n = data[at + 4], at + 5
    while lead & 0x80 and lead & 0x40:
        lead, n = lead << 1, n + 1
    if size_code in (6, 7):
        block = int.from_bytes(data[n : n + size_code - 5]) + 1
        n += size_code - 5
    else:
        block = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    n += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    return n + 1 - at, block


class _Bits:
    """Reads fields of up to 25 bits at many positions, and unary codes, of one byte array."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
        self.words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        ones = np.flatnonzero(np.unpackbits(data)).astype(np.int64)
        self.ones = np.append(ones, 8 * len(data))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(data), dtype=np.int64)))  # ones before each byte
        self.count = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
        self.data = np.append(data, np.uint8(0))

    def read(self, at: np.ndarray, width) -> np.ndarray:
        return ((self.words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(1) >> (31 - width)).astype(np.int64)

    def next_one(self, at: np.ndarray) -> np.ndarray:
        byte = at >> 3
        return self.ones[self.before[byte] + self.count[self.data[byte] >> (8 - (at & 7))]]


def _residuals(bits: _Bits, at: np.ndarray, order: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of frames of one block size, all frames in step, and the bit position after them."""
    out = np.zeros((len(at), block), np.int64)
    method = bits.read(at, 2)
    parts = bits.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("unknown residual coding")
    wide = np.where(method == 1, 5, 4)
    span = block >> parts
    at = at + 6
    k = np.zeros(len(at), np.int64)
    raw = np.full(len(at), -1, np.int64)
    due = order.copy()  # the sample at which the next parameter stands
    for i in range(int(order.min(initial=0)), block):
        new = np.flatnonzero(due == i)
        if len(new):
            k[new] = bits.read(at[new], wide[new])
            at[new] += wide[new]
            escaped = k[new] == (1 << wide[new]) - 1
            raw[new] = -1
            if escaped.any():
                own = new[escaped]
                raw[own] = bits.read(at[own], np.full(len(own), 5))
                at[own] += 5
            due[new] = (i // span[new] + 1) * span[new]
        live = i >= order
        stop = bits.next_one(at)
        low = bits.read(stop + 1, np.minimum(k, 25))
        u = (stop - at) << k | low
        value = (u >> 1) ^ -(u & 1)
        after = stop + 1 + k
        plain = raw >= 0
        if plain.any():
            own = np.flatnonzero(plain)
            got = bits.read(at[own], raw[own])
            value[own] = np.where(raw[own] > 0, got - ((got >> np.maximum(raw[own] - 1, 0)) << raw[own]), 0)
            after[own] = at[own] + raw[own]
        if live.all():
            out[:, i], at = value, after
        else:
            out[live, i] = value[live]
            at = np.where(live, after, at)
    return out, at


def _signed(value: np.ndarray, width: int) -> np.ndarray:
    return value - ((value >> (width - 1)) << width)


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The samples (int8) of the frames that start at these bytes, and the bytes at which they end."""
    raw = data.tobytes()
    heads = np.array([_frame_header(raw, s) for s in starts.tolist()], np.int64).reshape(-1, 2)
    body = starts + heads[:, 0]
    if (_crc(data, starts, body - 1, 8) != data[body - 1]).any():
        raise FlacError("the checksum of a frame header differs")
    bits = _Bits(data)
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(starts)
    ends = np.zeros(len(starts), np.int64)
    kinds = bits.data[body] >> 1 & 0x3F
    if (bits.data[body] & 1).any():
        raise FlacError("wasted bits are not supported")
    for block in np.unique(heads[:, 1]).tolist():
        same = heads[:, 1] == block
        for kind in np.unique(kinds[same]).tolist():
            f = np.flatnonzero(same & (kinds == kind))
            at = body[f] * 8 + 8
            if kind < 2:
                n = 1 if kind == 0 else block
                got = data[(body[f] + 1)[:, None] + np.arange(n)].view(np.int8)
                got, at = np.broadcast_to(got, (len(f), block)), at + 8 * n
            elif 8 <= kind <= 12 or kind >= 32:
                order = kind - 8 if kind < 32 else kind - 31
                warm = _signed(np.stack([bits.read(at + 8 * j, 8) for j in range(order)], 1), 8) if order else np.zeros((len(f), 0), np.int64)
                at = at + 8 * order
                coefs = shift = None
                if kind >= 32:
                    width, shift = bits.read(at, 4) + 1, bits.read(at + 4, 5)
                    at = at + 9
                    coefs = np.empty((len(f), order), np.int64)
                    for j in range(order):
                        value = bits.read(at, width)
                        coefs[:, j] = value - ((value >> (width - 1)) << width)
                        at = at + width
                residual, at = _residuals(bits, at, np.full(len(f), order), block)
                got = _restore(warm, residual, order, coefs, shift)
            else:
                raise FlacError("a reserved kind of subframe")
            ends[f] = -(-at // 8) + 2
            for i, row in zip(f.tolist(), got.astype(np.int8), strict=True):
                out[i] = row
    if (ends > len(data)).any():
        raise FlacError("a frame ends beyond its stream")
    if (_crc(data, starts, ends - 2, 16) != (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])).any():
        raise FlacError("the checksum of a frame differs")
    return out, ends


def _restore(warm: np.ndarray, residual: np.ndarray, order: int, coefs: np.ndarray | None, shift: np.ndarray | None) -> np.ndarray:
    """Samples from warm-up samples and residuals."""
    if coefs is not None:
        out = residual
        out[:, :order] = warm
        for i in range(order, out.shape[1]):
            out[:, i] += (out[:, i - order : i][:, ::-1] * coefs).sum(1) >> shift
        return out
    lines = [warm]
    for _ in range(order):
        lines.append(np.diff(lines[-1], axis=1))
    out = residual[:, order:]
    for line in lines[order - 1 :: -1] if order else []:
        out = line[:, -1:] + np.cumsum(out, axis=1)
    return np.concatenate((warm, out), axis=1)


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Of each stream its samples and, for every block, (first sample, first byte of the frame in the stream, samples)."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
    infos = [read_metadata(s) for s in streams]
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    blocks: list[list[tuple[int, int, int]]] = [[] for _ in streams]
    indexed = [len(i.points) > 0 and int(i.points[:, 2].sum()) == i.total for i in infos]
    known = [(k, int(begins[k]) + i.audio + at) for k, i in enumerate(infos) if indexed[k] for at in i.points[:, 1].tolist()]
    at = {k: int(begins[k]) + i.audio for k, i in enumerate(infos) if not indexed[k] and i.total}
    while known or at:
        if known:
            batch, known = known[:GROUP], known[GROUP:]
        else:
            batch = list(at.items())[:GROUP]
        low, high = min(s for _, s in batch), max(int(begins[k + 1]) for k, _ in batch)
        if known:
            high = min(high, max(low + 1, known[0][1])) if known[0][1] > batch[-1][1] else high
        got, ends = decode_frames(data[low:high], np.array([s for _, s in batch]) - low)
        for (k, start), samples, end in zip(batch, got, ends.tolist(), strict=True):
            blocks[k].append((sum(map(len, parts[k])) if not blocks[k] else blocks[k][-1][0] + blocks[k][-1][2], start - int(begins[k]), len(samples)))
            parts[k].append(samples)
            if k in at:
                at[k] = low + end
                if blocks[k][-1][0] + len(samples) >= infos[k].total:
                    del at[k]
    out = []
    for k, info in enumerate(infos):
        samples = np.concatenate(parts[k]) if parts[k] else np.zeros(0, np.int8)
        if len(samples) != info.total or (any(info.md5) and hashlib.md5(samples.tobytes()).digest() != info.md5):
            raise FlacError("the samples differ from those the stream was made of")
        out.append((samples, blocks[k]))
    return out


def payload(text: bytes | None) -> bytes:
    """The bytes of a text, filled up with 255 to a positive multiple of 576."""
    raw = text or b""
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of about GROUP frames, so that arrays stay small."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= GROUP * BLOCK:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def features(samples: np.ndarray) -> str:
    """Blocks, sum and energy of the samples, zero crossings and total variation, exact integers."""
    x = samples.astype(np.int64)
    return f"{len(x) // BLOCK};{x.sum()};{(x * x).sum()};{np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))};{np.abs(np.diff(x)).sum()}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream (media) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            texts = batch.column(1).to_pylist()
            padded = [payload(t) for t in texts]
            media = [m for a, b in _groups([len(p) for p in padded]) for m in encode_streams(padded[a:b], ORDERS, linear=True)]
            columns = [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[tuple[int, int, int, bytes]]]]:
    """Of each stream of a batch its row, its bytes and its PCM blocks: (first sample, first byte of its frame in the
    stream, samples, unsigned bytes)."""
    media = batch.column("media").to_pylist()
    for a, b in _groups([len(m) for m in media]):
        for i, (samples, blocks) in zip(range(a, b), decode_streams(media[a:b]), strict=True):
            raw = (samples.view(np.uint8) ^ 0x80).tobytes()
            yield i, media[i], [(at, byte, n, raw[at : at + n]) for at, byte, n in blocks]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, byte_offset (of the frame in its stream), samples and pcm (unsigned bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], k, *block) for i, _, blocks in _blocks(batch) for k, block in enumerate(blocks)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "block", "sample_offset", "byte_offset", "samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, byte_offset long, samples int, pcm binary")


def _payload_of(blocks: list[tuple[int, int, int, bytes]]) -> bytes:
    """The bytes that blocks hold together, each at its own sample offset."""
    out = bytearray(sum(n for _, _, n, _ in blocks))
    for at, _, n, pcm in blocks:
        out[at : at + n] = pcm
    return bytes(out)


def media_digest(docs: DataFrame) -> DataFrame:
    """Every text stored as FLAC and read back from its PCM blocks: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256 and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            rows = []
            for _, stream, blocks in _blocks(batch):
                raw = _payload_of(blocks)
                samples = (np.frombuffer(raw, np.uint8) ^ 0x80).view(np.int8)
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), features(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return to_media(docs).mapInArrow(run, schema)
