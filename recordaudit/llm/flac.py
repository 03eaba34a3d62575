"""FLAC streams of 8-bit mono samples: encoding and decoding of many frames side by side in NumPy.

The frames of all streams of a batch are handled as the rows of one matrix, so every step of the bit reader or of a predictor works
on thousands of frames at once. Frames are found by their sync code, header check (CRC-8) and running number; each frame's CRC-16
and each stream's MD5 are verified.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

BLOCK = 192  # samples in a frame
RATE = 8000
ORDER, PRECISION = 4, 8  # of the fitted predictor, and the bits of its coefficients
SPLIT = 0  # the residual is coded in 2^SPLIT partitions
FRAMES = 8192  # handled side by side
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # coefficients of the format's fixed predictors


class Stream(NamedTuple):
    """A decoded stream: its samples as unsigned bytes, and where each frame begins in the stored bytes."""

    pcm: bytes
    offsets: np.ndarray


def _crc_table(bits: int, poly: int) -> np.ndarray:
    value = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, value << 1 ^ poly, value << 1) & ((1 << bits) - 1)
    return value


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc(rows: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of every row; zeros ahead of a row do not count, so rows are aligned at their ends."""
    crc, table = np.zeros(len(rows), dtype=np.uint32), _CRC8 if bits == 8 else _CRC16
    for column in np.ascontiguousarray(rows.T):
        crc = (crc << 8 & ((1 << bits) - 1)) ^ table[(crc >> (bits - 8)) ^ column]
    return crc


def _number(n: int) -> bytes:
    """A frame number as the format writes it: like UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(tail)):
            return bytes([0xFF << (7 - len(tail)) & 0xFF | n, *reversed(tail)])


_HEAD = b"\xff\xf8\x10\x02"  # sync, fixed block size; 192 samples, rate as in the stream's head; one channel, 8 bits
_heads: dict[int, bytes] = {}


def _head(n: int) -> bytes:
    got = _heads.get(n)
    if got is None:
        got = _HEAD + _number(n)
        got += bytes([int(_crc(np.frombuffer(got, dtype=np.uint8)[None, :], 8)[0])])
        if n < 1 << 16:
            _heads[n] = got
    return got


def _predict(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals from sample `order` on: samples less their prediction from those before."""
    order = coefficients.shape[1]
    total = np.zeros((len(x), BLOCK - order), dtype=np.int32)
    for j in range(order):
        total += coefficients[:, j:j + 1] * x[:, order - 1 - j:BLOCK - 1 - j]
    return x[:, order:] - (total >> shift[:, None])


def _fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and shift of a linear predictor for each frame, from its autocorrelation."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, :BLOCK - k]) for k in range(ORDER + 1)], axis=1)
    toeplitz = r[:, np.abs(np.arange(ORDER)[:, None] - np.arange(ORDER)[None, :])]
    toeplitz += (r[:, :1, None] * 1e-4 + 1) * np.eye(ORDER)
    c = np.linalg.solve(toeplitz, r[:, 1:, None])[..., 0]
    limit = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(limit / np.maximum(np.abs(c).max(axis=1), 1e-3))), 0, 15).astype(np.int32)
    return np.clip(np.rint(c * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int32), shift


def _rice(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded residuals, and a parameter for each partition from its mean."""
    u = (r << 1) ^ (r >> 31)
    edges = np.maximum(np.arange(1 << SPLIT) * (BLOCK >> SPLIT) - order, 0)
    mean = np.add.reduceat(u, edges, axis=1) / np.diff(np.append(edges, BLOCK - order))
    return u, np.clip(np.floor(np.log2(np.maximum(0.7 * mean + 0.5, 1)) + 0.15), 0, 14).astype(np.int32)


def _tokens(kind: int, x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fields of the subframes of one kind, as values and their lengths in bits. kind: 0 to 4 fixed, 5 fitted, 6 constant, 7 verbatim."""
    n = len(x)
    column = lambda value, bits: (np.broadcast_to(np.asarray(value).reshape(-1, 1), (n, 1)), np.full((n, 1), bits))
    if kind == 6:
        parts = [column(0, 8), (x[:, :1] & 0xFF, np.full((n, 1), 8))]
    elif kind == 7:
        parts = [column(0b00000010, 8), (x & 0xFF, np.full(x.shape, 8))]
    else:
        order = coefficients.shape[1]
        u, k = _rice(_predict(x, coefficients, shift), order)
        parts = [column((0b100000 | ORDER - 1) << 1 if kind == 5 else (0b001000 | kind) << 1, 8), (x[:, :order] & 0xFF, np.full((n, order), 8))]
        if kind == 5:
            parts += [column(PRECISION - 1, 4), column(shift, 5), (coefficients & ((1 << PRECISION) - 1), np.full((n, order), PRECISION))]
        parts += [column(0, 2), column(SPLIT, 4)]
        for p in range(1 << SPLIT):
            at, to = max(p * (BLOCK >> SPLIT) - order, 0), (p + 1) * (BLOCK >> SPLIT) - order
            part, own = u[:, at:to], k[:, p:p + 1]
            parts += [(own, np.full((n, 1), 4)), ((1 << own) | part & ((1 << own) - 1), (part >> own) + 1 + own)]
    return np.concatenate([v for v, _ in parts], axis=1), np.concatenate([b for _, b in parts], axis=1)


def _encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """One frame for each row of samples (less 128)."""
    fitted, shift = _fit(x)
    none = np.zeros(len(x), dtype=np.int32)
    plans = [(kind, np.broadcast_to(np.array(c, dtype=np.int32), (len(x), len(c))), none) for kind, c in enumerate(FIXED[:2])] + [(5, fitted, shift)]
    # a residual's bits from its mean size; the fitted predictor also pays for its coefficients
    cost = np.stack([np.log2(np.abs(_predict(x, c, s)).mean(axis=1) + 0.6) * BLOCK + (9 + PRECISION * ORDER + 8 * ORDER if kind == 5 else 8 * kind) for kind, c, s in plans], axis=1)
    kind = np.array([p[0] for p in plans])[cost.argmin(axis=1)]
    kind[cost.min(axis=1) >= 5.9 * BLOCK] = 7
    kind[(x == x[:, :1]).all(axis=1)] = 6
    out: list[bytes] = [b""] * len(x)
    for own in np.unique(kind):
        rows = np.flatnonzero(kind == own)
        _, c, s = plans[-1] if own == 5 else plans[own if own < 2 else 0]
        value, bits = _tokens(int(own), x[rows], c[rows], s[rows])
        ends = np.cumsum(bits, axis=1)
        size = (ends[:, -1] + 7) // 8
        base = np.cumsum(size) - size
        stream = np.zeros(int(size.sum()) * 8, dtype=np.uint8)
        last = base[:, None] * 8 + ends - 1
        last, value = last.ravel(), value.ravel()
        for j in range(int(value.max()).bit_length()):  # a field's value is shorter than the field
            stream[last[np.flatnonzero(value & (1 << j))] - j] = 1
        body = np.packbits(stream).tobytes()
        frames = [_head(numbers[i]) + body[b:b + n] for i, b, n in zip(rows.tolist(), base.tolist(), size.tolist())]
        width = max(map(len, frames))
        aligned = np.frombuffer(b"".join(f.rjust(width, b"\0") for f in frames), dtype=np.uint8).reshape(len(frames), width)
        for i, f, crc in zip(rows.tolist(), frames, _crc(aligned, 16).tolist()):
            out[i] = f + crc.to_bytes(2, "big")
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a payload is a positive multiple of 192 unsigned samples."""
    frames: list[bytes] = []
    whole = b"".join(payloads)
    numbers = [i for p in payloads for i in range(len(p) // BLOCK)]
    for at in range(0, len(numbers), FRAMES):
        x = np.frombuffer(whole[at * BLOCK:(at + FRAMES) * BLOCK], dtype=np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
        frames += _encode_frames(x, numbers[at:at + FRAMES])
    out, at = [], 0
    for p in payloads:
        own = frames[at:at + len(p) // BLOCK]
        at += len(own)
        sizes = [len(f) for f in own]
        md5 = hashlib.md5((np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        facts = RATE << 44 | 0 << 41 | 7 << 36 | len(p)
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + facts.to_bytes(8, "big") + md5
        out.append(b"fLaC\x80\x00\x00\x22" + info + b"".join(own))
    return out


def _frames(media: bytes, n: int) -> np.ndarray:
    """Where the n frames of a stream begin: at each sync code with the next number and a right header check; the stream's end follows."""
    at = 4
    while True:  # metadata blocks; the first bit marks the last of them
        last, size = media[at] >> 7, int.from_bytes(media[at + 1:at + 4], "big")
        at += 4 + size
        if last:
            break
    offsets = []
    for k in range(n):
        at = media.find(_head(k), at)
        if at < 0:
            raise ValueError(f"frame {k} is missing")
        offsets.append(at)
        at += 8
    return np.array([*offsets, len(media)], dtype=np.int64)


class _Bits:
    """A bit reader at many places at once."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.int64)
        self.words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        self.at = at.astype(np.int64) * 8

    def peek(self) -> np.ndarray:
        """At least 25 bits from here on, at the top of 32."""
        return (self.words[self.at >> 3] << (self.at & 7)) & 0xFFFFFFFF

    def read(self, bits: int) -> np.ndarray:
        """The next bits, up to 25."""
        got = self.peek() >> (32 - bits)
        self.at += bits
        return got

    def signed(self, bits: int) -> np.ndarray:
        got = self.read(bits)
        return np.where(got >> (bits - 1) & 1, got - (1 << bits), got)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """Zeros up to the next one, times 2^k, plus the k bits behind it."""
        word = self.peek()
        zeros = _ZEROS[word >> 16]
        if int((zeros + k).max()) <= 15:
            self.at += zeros + 1 + k
            return zeros << k | (word << (zeros + 1) & 0xFFFFFFFF) >> (32 - k)
        quotient, more = np.zeros_like(k), np.arange(len(k))
        while len(more):
            place = self.at[more] >> 3
            if (place >= len(self.words)).any():
                raise ValueError("a residual runs past the end")
            zeros = _ZEROS[((self.words[place] << (self.at[more] & 7)) & 0xFFFFFFFF) >> 16]
            quotient[more] += zeros
            self.at[more] += zeros + (zeros < 16)
            more = more[zeros == 16]
        got = self.peek() >> (32 - k)
        self.at += k
        return quotient << k | got


_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], dtype=np.int64)


def _residual(bits: _Bits, order: int) -> np.ndarray:
    """Rice-coded residuals of frames of one order, in the order of their samples."""
    method, split = bits.read(2), bits.read(4)
    if (method > 0).any() or (split != split[0]).any():
        raise ValueError("partitions with wide parameters are not written by this encoder")
    out = np.zeros((BLOCK - order, len(bits.at)), dtype=np.int32)
    size = BLOCK >> int(split[0])
    for t in range(order, BLOCK):
        if t == order or t % size == 0:
            k = bits.read(4)
            if (k == 15).any():
                raise ValueError("escaped partitions are not written by this encoder")
        u = bits.rice(k)
        out[t - order] = (u >> 1) ^ -(u & 1)
    return out


def _decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The samples of each frame, after its CRC-16 is verified. heads: the lengths of the frames' headers."""
    length = end - begin
    width = int(length.max())
    place = end[:, None] + np.arange(-width, 0)[None, :]
    rows = np.where(place >= begin[:, None], data[np.maximum(place, 0)], 0)
    if _crc(rows, 16).any():  # a frame together with its own check gives zero
        raise ValueError("a frame does not have its checksum")
    kinds = data[begin + heads].astype(np.int32) >> 1
    out = np.empty((len(begin), BLOCK), dtype=np.int32)
    for kind in np.unique(kinds):
        lanes = np.flatnonzero(kinds == kind)
        bits = _Bits(data, begin[lanes] + heads[lanes] + 1)
        if kind == 0:
            out[lanes] = bits.signed(8)[:, None]
        elif kind == 1:
            out[lanes] = np.stack([bits.signed(8) for _ in range(BLOCK)], axis=1)
        elif 8 <= kind <= 12 or kind >= 32:
            order = int(kind - 8 if kind < 32 else kind - 31)
            x = np.zeros((BLOCK, len(lanes)), dtype=np.int32)
            for t in range(order):
                x[t] = bits.signed(8)
            shift = np.zeros(len(lanes), dtype=np.int32)
            c = np.broadcast_to(np.array(FIXED[order] if kind < 32 else [], dtype=np.int32)[:, None], (order if kind < 32 else 0, len(lanes)))
            if kind >= 32:
                if (bits.read(4) != PRECISION - 1).any():
                    raise ValueError("coefficients of another precision are not written by this encoder")
                shift = bits.read(5)
                c = np.stack([bits.signed(PRECISION) for _ in range(order)])
            x[order:] = _residual(bits, order)
            back = c[::-1]
            for t in range(order, BLOCK) if order else ():
                x[t] += np.einsum("ij,ij->j", back, x[t - order:t]) >> shift
            out[lanes] = x.T
        else:
            raise ValueError(f"subframes of kind {kind} are reserved")
    return out


def decode(streams: list[bytes]) -> list[Stream]:
    """The samples of each stream, as unsigned bytes. Raises ValueError where a checksum, the MD5 or the structure is wrong."""
    whole = b"".join(streams)
    data = np.frombuffer(whole, dtype=np.uint8)
    tables, base = [], 0
    for s in streams:
        if s[:4] != b"fLaC" or int.from_bytes(s[8:10], "big") != BLOCK or int.from_bytes(s[18:26], "big") >> 36 & 0xFF != 7:
            raise ValueError("not a stream of 8-bit mono frames of 192 samples")
        tables.append(_frames(s, (int.from_bytes(s[18:26], "big") & (1 << 36) - 1) // BLOCK) + base)
        base += len(s)
    begin = np.concatenate([t[:-1] for t in tables]) if tables else np.zeros(0, dtype=np.int64)
    end = np.concatenate([t[1:] for t in tables]) if tables else begin
    heads = np.concatenate([[len(_head(k)) for k in range(len(t) - 1)] for t in tables]).astype(np.int64) if tables else begin
    samples = np.empty((len(begin), BLOCK), dtype=np.uint8)
    for at in range(0, len(begin), FRAMES):
        part = slice(at, at + FRAMES)
        first, last = int(begin[part][0]), int(end[part][-1])
        samples[part] = _decode_frames(data[first:last], begin[part] - first, end[part] - first, heads[part]) + 128
    out, at, base = [], 0, 0
    for s, t in zip(streams, tables):
        pcm = samples[at:at + len(t) - 1].tobytes()
        if hashlib.md5((np.frombuffer(pcm, dtype=np.uint8) ^ 0x80).tobytes()).digest() != s[26:42]:
            raise ValueError("a stream does not have its MD5")
        out.append(Stream(pcm, t[:-1] - base))
        at, base = at + len(t) - 1, base + len(s)
    return out
