"""Media columns: FLAC streams written and read as binary columns, many frames at a time.

A stream is mono, 8 bits a sample, in blocks of 4096 samples. The writer picks for each
frame the fixed or linear predictor with the smallest residual, codes residuals with
Rice parameters by partition, and writes a seek point for each frame. The reader parses
headers, verifies the header and frame checksums and the stream's MD5, decodes Rice
residuals, runs the predictors, and gives PCM blocks with their sample offsets.

numpy works on groups of frames side by side: one step handles the same residual of
every frame, so the cost of a step is shared. Groups are bounded in frames, so memory
does not follow the length of a text.

Defined results: null or empty text is stored as 64 zero bytes; equal texts give equal
streams; bytes that are no such stream raise ValueError, and so does a wrong checksum.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, ALIGN, RATE = 4096, 64, 8000
#: The writer's partitions (as a power of two), LPC order and coefficient precision.
PARTITION_ORDER, LPC_ORDER, PRECISION = 3, 4, 10
#: Frames worked on side by side.
GROUP = 384


def _crc_table(poly: int, bits: int) -> np.ndarray:
    """The table of a checksum that takes the highest bit first and begins at zero."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly) & mask if value & top else (value << 1) & mask
        out.append(value)
    return np.array(out, dtype=np.int32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = int(_CRC8[value ^ byte])
    return value


def crc16_many(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of stretches of buffer. Leading zeros leave a zero checksum as it is, so stretches align at their ends."""
    longest = int(lengths.max(initial=0))
    value = np.zeros(len(starts), np.int32)
    order = np.argsort(-lengths, kind="stable")
    begin, own = starts[order], lengths[order]
    active = np.searchsorted(-own, -np.arange(longest, 0, -1), "right")
    for step in range(longest):
        n = active[step]
        byte = buffer[begin[:n] + own[:n] - longest + step]
        now = value[:n]
        value[:n] = _CRC16[(now >> 8) ^ byte] ^ ((now << 8) & 0xFFFF)
    out = np.empty_like(value)
    out[order] = value
    return out


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(ALIGN, -(-len(data) // ALIGN) * ALIGN), b"\0")


def _number(n: int) -> bytes:
    """A frame number in the UTF-8 like form of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room = 6 - len(tail)
        if n < 1 << max(0, room):
            return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    if size == BLOCK:
        head = b"\xff\xf8\xc0\x02" + _number(number)
    else:
        head = b"\xff\xf8\x70\x02" + _number(number) + struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


def _linear_predictors(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, LPC_ORDER) and shifts, by autocorrelation and recursion."""
    f = x.astype(np.float64)
    n = x.shape[1]
    auto = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : n - lag]) for lag in range(LPC_ORDER + 1)], 1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-3
    coef = np.zeros((len(x), LPC_ORDER))
    error = auto[:, 0].copy()
    for i in range(LPC_ORDER):
        reflect = (auto[:, i + 1] - (coef[:, :i] * auto[:, i:0:-1]).sum(1)) / error
        coef[:, :i] -= reflect[:, None] * coef[:, :i][:, ::-1]
        coef[:, i] = reflect
        error = np.maximum(error * (1 - reflect**2), 1e-6)
    largest = np.abs(coef).max(1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(largest, 1e-3) + 1e-9)), 0, 15).astype(np.int32)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(coef * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int32), shift


def _predict_linear(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    total = np.zeros_like(x[:, LPC_ORDER:])
    for j in range(LPC_ORDER):
        total += coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : x.shape[1] - 1 - j]
    return x[:, LPC_ORDER:] - (total >> shift[:, None])


def _encode_group(samples: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """The frames of some blocks of signed samples; each block's size is a multiple of 64."""
    sizes = np.array([len(s) for s in samples])
    x = np.zeros((len(samples), int(sizes.max())), np.int32)
    for row, s in zip(x, samples, strict=True):
        row[: len(s)] = s
    inside = np.arange(x.shape[1]) < sizes[:, None]
    coef, shift = _linear_predictors(x, sizes)
    residuals, costs = [], []
    difference = x
    for order in range(5):
        residuals.append(difference)
        costs.append((np.abs(difference) * inside[:, order:]).sum(1) + 8 * order)
        difference = np.diff(difference, axis=1)
    linear = _predict_linear(x, coef, shift)
    residuals.append(linear)
    costs.append((np.abs(linear) * inside[:, LPC_ORDER:]).sum(1) + 8 * LPC_ORDER + PRECISION * LPC_ORDER)
    kind = np.argmin(np.stack(costs), axis=0)  # 0..4: fixed order; 5: linear
    order = np.where(kind == 5, LPC_ORDER, kind)

    # One matrix of folded residuals; the first `order` places of a row are not residuals.
    r = np.zeros_like(x)
    for k in range(6):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            r[rows, LPC_ORDER if k == 5 else k :] = residuals[k][rows]
    coded = inside & (np.arange(x.shape[1]) >= order[:, None])
    folded = np.where(coded, (r << 1) ^ (r >> 31), 0)
    parts = 1 << PARTITION_ORDER
    part = (np.arange(x.shape[1]) * parts) // sizes[:, None]  # past the end: parts and more
    frame_of, at = np.nonzero(coded)
    u = folded[frame_of, at]
    cell = frame_of * parts + part[frame_of, at]
    count = np.bincount(cell, minlength=len(samples) * parts)
    mean = np.bincount(cell, weights=u, minlength=len(samples) * parts) / np.maximum(count, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931 + 0.5, 1.0))), 0, 14).astype(np.int64)
    k = rice[cell]
    quotient = u >> k
    opens = np.concatenate([[True], cell[1:] != cell[:-1]])
    length = quotient + 1 + k + 4 * opens

    headers = [_frame_header(n, int(s)) for n, s in zip(numbers, sizes, strict=True)]
    out = []
    first = np.searchsorted(frame_of, np.arange(len(samples) + 1))
    ends = np.cumsum(length)
    prelude, prelude_bits = [], np.zeros(len(samples), np.int64)
    for i, (head, o) in enumerate(zip(headers, order.tolist(), strict=True)):
        value, bits = (0b100000 | (LPC_ORDER - 1)) << 1 if kind[i] == 5 else (0b001000 | o) << 1, 8
        for s in x[i, :o].tolist():
            value, bits = value << 8 | (s & 0xFF), bits + 8
        if kind[i] == 5:
            value, bits = value << 9 | (PRECISION - 1) << 5 | int(shift[i]), bits + 9
            for c in coef[i].tolist():
                value, bits = value << PRECISION | (c & ((1 << PRECISION) - 1)), bits + PRECISION
        value, bits = value << 6 | PARTITION_ORDER, bits + 6  # coding method 0
        prelude.append((int.from_bytes(head, "big") << bits) | value)
        prelude_bits[i] = len(head) * 8 + bits
    base = np.concatenate([[0], ends])[first[:-1]]
    body_bits = np.concatenate([[0], ends])[first[1:]] - base
    frame_bytes = (prelude_bits + body_bits + 7) // 8
    starts = np.concatenate([[0], np.cumsum(frame_bytes)])
    # A code's stop bit and low bits are one number of k + 1 bits, spread over three bytes; codes do not overlap, so sums are ors.
    position = ends - length - base[frame_of] + prelude_bits[frame_of] + starts[:-1][frame_of] * 8
    total = int(starts[-1]) + 4
    buffer = np.zeros(total)

    def put(where: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        nonlocal buffer
        byte, word = where >> 3, value << (24 - (where & 7) - bits)
        for j in range(3):
            buffer += np.bincount(byte + j, weights=(word >> (16 - 8 * j)) & 0xFF, minlength=total)

    put(position + 4 * opens + quotient, (1 << k) | (u & ((1 << k) - 1)), k + 1)
    put(position[opens], k[opens], np.full(int(opens.sum()), 4))
    buffer = buffer.astype(np.uint8)
    for i, value in enumerate(prelude):
        bits = int(prelude_bits[i])
        spare = -bits % 8
        whole = np.frombuffer((value << spare).to_bytes((bits + spare) // 8, "big"), np.uint8)
        buffer[starts[i] : starts[i] + len(whole)] |= whole
    check = crc16_many(buffer, starts[:-1], frame_bytes)
    for i in range(len(samples)):
        out.append(buffer[starts[i] : starts[i + 1]].tobytes() + struct.pack(">H", int(check[i])))
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; each is a positive multiple of 64 bytes."""
    blocks, numbers, owner = [], [], []
    for i, data in enumerate(payloads):
        if not data or len(data) % ALIGN:
            raise ValueError("a payload is a positive multiple of 64 bytes")
        signed = (np.frombuffer(data, np.uint8) ^ 0x80).view(np.int8)
        for number, at in enumerate(range(0, len(signed), BLOCK)):
            blocks.append(signed[at : at + BLOCK])
            numbers.append(number)
            owner.append(i)
    frames: list[bytes] = [b""] * len(blocks)
    by_size = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(by_size), GROUP):
        some = by_size[at : at + GROUP]
        for i, frame in zip(some, _encode_group([blocks[i] for i in some], [numbers[i] for i in some]), strict=True):
            frames[i] = frame
    out, at = [], 0
    for data in payloads:
        n = -(-len(data) // BLOCK)
        own, sizes = frames[at : at + n], [len(b) for b in blocks[at : at + n]]
        at += n
        lengths = [len(f) for f in own]
        signed = (np.frombuffer(data, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(data)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, sample, offset = [], 0, 0
        for size, length in zip(sizes, lengths, strict=True):
            points.append(struct.pack(">QQH", sample, offset, size))
            sample, offset = sample + size, offset + length
        table = b"".join(points)
        out.append(
            b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own)
        )
    return out


@dataclass
class Stream:
    samples: int
    md5: bytes
    #: Byte offset of the first frame, and (sample, offset after it, samples) of seek points.
    audio: int
    points: list[tuple[int, int, int]]


def read_metadata(media: bytes) -> Stream:
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last = 4, None, [], False
    while not last:
        last, kind, length = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + length]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + length
    if info is None or len(info) < 34:
        raise ValueError("a stream begins with its STREAMINFO block")
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
        raise ValueError("only mono streams of 8 bits are read")
    return Stream(packed & ((1 << 36) - 1), info[18:34], at, points)


def _read_header(media: bytes, at: int) -> tuple[int, int, int]:
    """(samples, frame number, length of the header) of the frame at a byte offset."""
    if media[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise ValueError("no frame where one should begin")
    code, lead = media[at + 2] >> 4, media[at + 4]
    extra = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    number = lead & (0x7F if lead < 0x80 else (1 << (6 - extra)) - 1)
    for byte in media[at + 5 : at + 5 + extra]:
        number = number << 6 | (byte & 0x3F)
    end = at + 5 + extra
    if code in (6, 7):
        size = int.from_bytes(media[end : end + code - 5], "big") + 1
        end += code - 5
    elif code == 1:
        size = 192
    elif 2 <= code <= 5:
        size = 576 << (code - 2)
    elif code >= 8:
        size = 256 << (code - 8)
    else:
        raise ValueError("reserved block size")
    end += {12: 1, 13: 2, 14: 2}.get(media[at + 2] & 15, 0)
    if crc8(media[at:end]) != media[end]:
        raise ValueError("wrong header checksum")
    return size, number, end + 1 - at


class _Bits:
    """Reads one frame bit by bit: preludes, and the rare forms that groups leave out."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        rest = self.value & ((1 << self.left) - 1)
        zeros = self.left - rest.bit_length()
        self.left -= zeros + 1
        return zeros


def decode_frame(frame: bytes, header: int, size: int) -> np.ndarray:
    """Signed samples of one frame, read bit by bit: every subframe type, escape codes and wasted bits."""
    bits = _Bits(frame[header:])
    kind = bits.take(8)
    wasted = bits.unary() + 1 if kind & 1 else 0
    kind, width = (kind >> 1) & 63, 8 - wasted
    if kind == 0:
        return np.full(size, bits.signed(width) << wasted, np.int64)
    if kind == 1:
        return np.array([bits.signed(width) << wasted for _ in range(size)], np.int64)
    if not (8 <= kind <= 12 or kind >= 32):
        raise ValueError("reserved subframe type")
    order = kind - 31 if kind >= 32 else kind - 8
    x = [bits.signed(width) for _ in range(order)]
    coef, shift = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order] if kind < 32 else None, 0
    if kind >= 32:
        precision, shift = bits.take(4) + 1, bits.signed(5)
        coef = [bits.signed(precision) for _ in range(order)]
    wide = 5 if bits.take(2) == 1 else 4
    parts = 1 << bits.take(4)
    for p in range(parts):
        n = size // parts - (order if p == 0 else 0)
        rice = bits.take(wide)
        raw = bits.take(5) if rice == (1 << wide) - 1 else None
        for _ in range(n):
            if raw is None:
                u = bits.unary() << rice | bits.take(rice)
                r = (u >> 1) ^ -(u & 1)
            else:
                r = bits.signed(raw)
            x.append(r + (sum(c * v for c, v in zip(coef, reversed(x), strict=False)) >> shift))
    return np.array(x, np.int64) << wasted


def _decode_group(frames: list[bytes], heads: list[int], sizes: list[int]) -> list[np.ndarray]:
    """Samples of frames with four-bit Rice parameters side by side; frames come longest first."""
    n = len(frames)
    begins = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    raw = np.frombuffer(b"".join(frames) + b"\0\0\0\0", np.uint8)
    bits = np.unpackbits(raw[:-4])
    if len(bits) >= 1 << 31:
        raise ValueError("a group of frames is too large")
    index = np.arange(len(bits), dtype=np.int32)
    next_one = np.minimum.accumulate(np.where(bits, index, np.int32(len(bits)))[::-1])[::-1]
    del bits, index
    orders, warm, linear, position, parts = [], [], [], np.zeros(n, np.int64), []
    for i, frame in enumerate(frames):
        prelude = _Bits(frame[heads[i] : heads[i] + 160])
        whole = prelude.left
        kind = prelude.take(8) >> 1
        order = kind - 31 if kind >= 32 else kind - 8
        warm.append([prelude.signed(8) for _ in range(order)])
        if kind >= 32:
            precision, shift = prelude.take(4) + 1, prelude.signed(5)
            linear.append((shift, [prelude.signed(precision) for _ in range(order)]))
        else:
            linear.append(None)
        prelude.take(2)
        parts.append(1 << prelude.take(4))
        orders.append(order)
        position[i] = (begins[i] + heads[i]) * 8 + whole - prelude.left
    size, order = np.array(sizes), np.array(orders)
    counts = size - order
    by = np.argsort(-counts, kind="stable")
    pos = position[by]
    steps = int(counts.max())
    active = np.searchsorted(-counts[by], -np.arange(steps), "left")  # frames with more than that many residuals
    opens: dict[int, list[int]] = {}
    for rank, i in enumerate(by.tolist()):
        for p in range(parts[i]):
            opens.setdefault(max(0, size[i] // parts[i] * p - orders[i]), []).append(rank)
    quotient = np.zeros((steps, n), np.int32)
    low_at = np.zeros((steps, n), np.int64)
    rice_of = np.zeros((steps, n), np.int8)
    rice = np.zeros(n, np.int64)
    for step in range(steps):
        if step in opens:
            ranks = np.array(opens[step])
            at = pos[ranks]
            rice[ranks] = ((raw[at >> 3].astype(np.int64) << 8 | raw[(at >> 3) + 1]) >> (12 - (at & 7))) & 15
            pos[ranks] = at + 4
            if (rice[ranks] == 15).any():
                raise ValueError("escape codes are read one frame at a time")
        a = active[step]
        here = pos[:a]
        one = next_one[here]
        quotient[step, :a] = one - here
        low_at[step, :a] = one
        rice_of[step, :a] = rice[:a]
        pos[:a] = one + 1 + rice[:a]
    low_at += 1
    byte = low_at >> 3
    word = raw[byte].astype(np.int64) << 16
    word |= raw[byte + 1].astype(np.int64) << 8
    word |= raw[byte + 2]
    k = rice_of.astype(np.int64)
    u = quotient.astype(np.int64) << k
    u |= (word >> (24 - (low_at & 7) - k)) & ((1 << k) - 1)
    r = ((u >> 1) ^ -(u & 1)).astype(np.int32)  # (step, rank)
    del word, byte, u, k, quotient, low_at
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    for o, is_linear in {(orders[i], linear[i] is not None) for i in range(n)}:
        ranks = [rank for rank, i in enumerate(by.tolist()) if orders[i] == o and (linear[i] is not None) == is_linear]
        own = by[ranks]
        first = np.array([warm[i] for i in own], np.int32).reshape(len(own), o)
        rest = r[:, ranks]
        if is_linear:
            x = np.concatenate([first.T, rest]).astype(np.int64)
            coef = np.array([linear[i][1][::-1] for i in own], np.int64).T
            shift = np.array([linear[i][0] for i in own], np.int64)
            for step in range(o, len(x)):
                x[step] += (coef * x[step - o : step]).sum(0) >> shift
            x = x.T
        else:
            x = rest.T
            for level in range(o - 1, -1, -1):
                begin = np.diff(first, n=level, axis=1)[:, :1]
                x = np.cumsum(np.concatenate([begin, x], 1), axis=1, dtype=np.int32)
        for row, i in zip(x, own, strict=True):
            out[i] = row[: size[i]]
    return out


def _plain(frame: bytes, head: int) -> bool:
    """Whether groups can read it: a fixed or linear subframe without wasted bits, with four-bit parameters."""
    kind = frame[head]
    if kind & 1 or not (8 <= kind >> 1 <= 12 or kind >> 1 >= 32):
        return False
    kind >>= 1
    bits = _Bits(frame[head : head + 160])
    order = kind - 31 if kind >= 32 else kind - 8
    bits.take(8 + 8 * order)
    if kind >= 32:
        bits.take(5 + (bits.take(4) + 1) * order)
    return bits.take(2) == 0


def decode(media: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its PCM blocks (sample offset, signed samples), checked by header, frame and stream sums.

    Streams need a seek point for each frame, as encode writes them.
    """
    jobs, streams = [], []
    for i, data in enumerate(media):
        stream = read_metadata(data)
        streams.append(stream)
        if sum(p[2] for p in stream.points) != stream.samples:
            raise ValueError("the seek points do not cover the stream")
        offsets = [stream.audio + p[1] for p in stream.points] + [len(data)]
        for (sample, _, samples), a, b in zip(stream.points, offsets, offsets[1:], strict=False):
            size, _, head = _read_header(data, a)
            if size != samples:
                raise ValueError("a seek point and its frame disagree")
            jobs.append((i, sample, data[a:b], head, size))
    jobs.sort(key=lambda j: -j[4])
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in media]
    for at in range(0, len(jobs), GROUP):
        some = jobs[at : at + GROUP]
        buffer = np.frombuffer(b"".join(j[2] for j in some), np.uint8)
        lengths = np.array([len(j[2]) for j in some])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sums = crc16_many(buffer, starts, lengths - 2)
        written = buffer[starts + lengths - 2].astype(np.int32) << 8 | buffer[starts + lengths - 1]
        if (sums != written).any():
            raise ValueError("wrong frame checksum")
        together = [j for j in some if _plain(j[2], j[3])]
        blocks = _decode_jobs([j[2:5] for j in together])
        for j, block in zip(together, blocks, strict=True):
            found[j[0]].append((j[1], block.astype(np.int8)))
        for j in some:
            if not _plain(j[2], j[3]):
                found[j[0]].append((j[1], decode_frame(j[2], j[3], j[4]).astype(np.int8)))
    for blocks, stream in zip(found, streams, strict=True):
        blocks.sort(key=lambda b: b[0])
        if hashlib.md5(b"".join(b.tobytes() for _, b in blocks)).digest() != stream.md5:
            raise ValueError("wrong MD5 of the samples")
    return found


def _decode_jobs(jobs: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """The blocks of frames that groups can read; a frame that breaks a group is found by halves and read alone, bit by bit."""
    if not jobs:
        return []
    try:
        return list(_decode_group(*map(list, zip(*jobs, strict=True))))
    except ValueError:
        if len(jobs) == 1:
            return [decode_frame(*jobs[0])]
        half = len(jobs) // 2
        return _decode_jobs(jobs[:half]) + _decode_jobs(jobs[half:])


def read_block(media: bytes, sample: int) -> tuple[int, np.ndarray]:
    """(offset, samples) of the block that holds a sample: the seek table leads to its frame, and no other is read."""
    stream = read_metadata(media)
    if not 0 <= sample < stream.samples:
        raise ValueError("no such sample")
    k = bisect_right([p[0] for p in stream.points], sample) - 1
    first, offset, _ = stream.points[k]
    stop = stream.audio + stream.points[k + 1][1] if k + 1 < len(stream.points) else len(media)
    frame = media[stream.audio + offset : stop]
    size, _, head = _read_header(frame, 0)
    if int(crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame) - 2]))[0]) != int.from_bytes(frame[-2:], "big"):
        raise ValueError("wrong frame checksum")
    return first, _decode_jobs([(frame, head, size)])[0].astype(np.int8) if _plain(frame, head) else decode_frame(frame, head, size).astype(np.int8)


def _pieces(rows: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Rows in runs of about `most` bytes, so a batch of long texts is worked on bit by bit."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_column(text: Column) -> Column:
    """The text's payload as a FLAC stream (binary)."""

    @F.pandas_udf("binary")
    def to_flac(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([m for some in _pieces([payload_of(t) for t in texts]) for m in encode(some)], dtype=object)

    return to_flac(text)


def feature_of(samples: np.ndarray) -> str:
    """Loudness, zero crossings and peak of signed samples."""
    wide = samples.astype(np.int32)
    return f"rms={np.sqrt((wide * wide).mean()):.4f};zc={int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())};peak={int(np.abs(wide).max())}"


def read_column(media: Column) -> Column:
    """What the stored bytes give when read back: sizes, digests, a feature, and the sample offsets of the blocks."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks int, seek_offsets string")
    def from_flac(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for stored in batches:
            rows = []
            for some in _pieces([bytes(m) for m in stored]):
                for data, blocks in zip(some, decode(some), strict=True):
                    samples = np.concatenate([b for _, b in blocks])
                    payload = (samples.view(np.uint8) ^ 0x80).tobytes()
                    rows.append(
                        (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data),
                         hashlib.sha256(data).hexdigest(), feature_of(samples), len(blocks), ",".join(str(at) for at, _ in blocks))
                    )
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks", "seek_offsets"]
            yield pd.DataFrame(rows, columns=names)

    return from_flac(media)


def pcm_blocks(streams: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each block of each stream: key, sample_offset, n_samples, pcm (signed 8-bit samples)."""
    kind = streams.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["k"], frame["m"], strict=True):
                if data is not None:
                    rows += [(name, at, len(b), b.tobytes()) for at, b in decode([bytes(data)])[0]]
            yield pd.DataFrame(rows, columns=[key, "sample_offset", "n_samples", "pcm"])

    return streams.select(F.col(key).alias("k"), F.col(media).alias("m")).mapInPandas(
        run, f"`{key}` {kind}, sample_offset long, n_samples int, pcm binary"
    )
