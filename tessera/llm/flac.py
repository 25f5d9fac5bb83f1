"""Media columns: FLAC.

Encoder and decoder for mono 8-bit streams of 192-sample frames work on many frames at once: all frames of a batch of documents move
in step, one sample (or byte, for checksums) at a time, so that each step is one array operation. A frame is a fixed or linear
predictor with Rice-coded residuals, or verbatim samples where that is shorter. The decoder verifies every header and frame checksum.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BLOCK = 192
SEEK_EVERY = 16  # frames
RATE = 8000
# Fixed values of the format: predictor coefficients by order, newest sample first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CLZ16 = np.array([16] + [16 - i.bit_length() for i in range(1, 1 << 16)], np.int64)


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each slice of data, all in step; longest first, so that the slices still going are a prefix."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    c = np.zeros(len(s), np.uint32)
    mask = np.uint32((1 << bits) - 1)
    for t in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -t, "left"))
        x = c[:live]
        c[:live] = table[(x >> np.uint32(bits - 8)) ^ data[s[:live] + t]] ^ ((x << np.uint32(8)) & mask)
    out = np.empty_like(c)
    out[order] = c
    return out


def _utf8_numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like coding: bytes (6 columns) and how many count."""
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26], [1, 2, 3, 4, 5], 6)
    out = np.zeros((len(n), 6), np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    for k in range(6):
        shift = 6 * (size - 1 - k)
        v = n >> np.maximum(shift, 0)
        out[:, k] = np.where(k >= size, 0, np.where(k == 0, np.where(size == 1, n, lead[size] | v), 0x80 | v & 0x3F))
    return out, size


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """samples: frames x 192 of -128..127. The frames' bytes in a row, and each frame's length."""
    s = samples.astype(np.int32)
    n = len(s)
    a = s.astype(np.int64)
    r0, r1, r2 = (np.einsum("ij,ij->i", a[:, k:], a[:, : BLOCK - k]) for k in range(3))
    det = np.maximum((r0 * r0 - r1 * r1).astype(float), 1.0)
    coef = np.clip(np.rint(np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1.astype(float) ** 2) / det], 1) * 64), -128, 127).astype(np.int32)
    residuals = [s, np.diff(s, axis=1), np.diff(s, 2, axis=1), s[:, 2:] - ((coef[:, :1] * s[:, 1:-1] + coef[:, 1:] * s[:, :-2]) >> 6)]
    orders, extra = [0, 1, 2, 2], [0, 0, 0, 4 + 5 + 16]
    best = np.full(n, 8 * BLOCK, np.int64)  # bits of verbatim
    kind, param = np.full(n, -1), np.zeros(n, np.int64)
    codes = []
    for m, r in enumerate(residuals):
        u = (r << 1) ^ (r >> 31)
        codes.append(u)
        for k in range(2, 9):
            bits = (u >> k).sum(1, dtype=np.int64) + (k + 1) * u.shape[1] + 8 * orders[m] + extra[m] + 10
            win = bits < best
            best, kind, param = np.where(win, bits, best), np.where(win, m, kind), np.where(win, k, param)
    num, num_size = _utf8_numbers(number)
    head = 4 + num_size + 1
    length = head + (8 + best + 7) // 8 + 2
    at = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, np.uint8)

    def put(pos, value, width):
        value = np.broadcast_to(value, pos.shape)
        for i in range(width):
            bits[pos + i] = (value >> (width - 1 - i)) & 1

    pos = (at + head) * 8
    put(pos, np.choose(kind + 1, [0b000001, 0b001000, 0b001001, 0b001010, 0b100001]) << 1, 8)
    pos = pos + 8
    for m in range(-1, 4):
        f = np.flatnonzero(kind == m)
        if not len(f):
            continue
        p = pos[f]
        for j in range(BLOCK if m < 0 else orders[m]):
            put(p, s[f, j] & 0xFF, 8)
            p = p + 8
        if m < 0:
            continue
        if m == 3:
            put(p, np.full(len(f), 7), 4)  # precision less one
            put(p + 4, np.full(len(f), 6), 5)
            put(p + 9, coef[f, 0] & 0xFF, 8)
            put(p + 17, coef[f, 1] & 0xFF, 8)
            p = p + 25
        k = param[f]
        put(p, k, 10)  # Rice coding, one partition, the parameter
        u = codes[m][f].astype(np.int64)
        q = u >> k[:, None]
        size = q + 1 + k[:, None]
        start = (p + 10)[:, None] + np.cumsum(size, 1) - size + q
        bits[start.ravel()] = 1
        for i in range(int(k.max())):
            rows = np.flatnonzero(k > i)
            bits[(start[rows] + 1 + i).ravel()] = ((u[rows] >> (k[rows, None] - 1 - i)) & 1).ravel()
    out = np.packbits(bits)
    for i, v in enumerate((0xFF, 0xF8, 0x10, 0x02)):  # sync, fixed blocks; 192 samples, rate as in the stream; mono, 8 bits
        out[at + i] = v
    for k in range(6):
        f = num_size > k
        out[at[f] + 4 + k] = num[f, k]
    out[at + head - 1] = checksums(out, at, head - 1, CRC8, 8)
    crc = checksums(out, at, length - 2, CRC16, 16)
    out[at + length - 2], out[at + length - 1] = crc >> 8, crc & 0xFF
    return out, length


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload of unsigned bytes, of a positive multiple of 192 bytes."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    assert all(len(p) and len(p) % BLOCK == 0 for p in payloads)
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    signed = (data ^ 0x80).view(np.int8)
    first = np.cumsum(frames) - frames
    number = np.arange(len(data)) - np.repeat(first, frames)
    parts, lengths = [], []
    for lo in range(0, len(data), 8192):
        b, n = encode_frames(signed[lo : lo + 8192], number[lo : lo + 8192])
        parts.append(b)
        lengths.append(n)
    body, length = np.concatenate(parts), np.concatenate(lengths)
    end = np.r_[0, np.cumsum(length)]
    out = []
    for i, (f, n) in enumerate(zip(first, frames, strict=True)):
        size, at = length[f : f + n], end[f : f + n] - end[f]
        info = BLOCK.to_bytes(2) * 2 + int(size.min()).to_bytes(3) + int(size.max()).to_bytes(3)
        info += (RATE << 44 | 0 << 41 | 7 << 36 | int(n) * BLOCK).to_bytes(8)
        info += hashlib.md5(signed[f : f + n].tobytes(), usedforsecurity=False).digest()
        seek = b"".join(int(k * BLOCK).to_bytes(8) + int(at[k]).to_bytes(8) + BLOCK.to_bytes(2) for k in range(0, n, SEEK_EVERY))
        out.append(b"fLaC\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek + body[end[f] : end[f + n]].tobytes())
    return out


@dataclass
class Stream:
    samples: int
    md5: bytes
    seek: list[tuple[int, int]]  # sample number, byte offset
    frames_at: int


def open_stream(media: bytes) -> Stream:
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, seek = 4, b"", []
    while True:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4])
        block = media[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            info = block
        elif kind & 0x7F == 3:
            seek = [(int.from_bytes(block[i : i + 8]), int.from_bytes(block[i + 8 : i + 16])) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 0x80:
            break
    if info[:4] != BLOCK.to_bytes(2) * 2 or info[12] & 0x0E or (int.from_bytes(info[12:14]) >> 4 & 0x1F) != 7:
        raise ValueError("not mono 8-bit of 192-sample frames")
    return Stream(int.from_bytes(info[10:18]) & (1 << 36) - 1, info[18:34], seek, at)


def find_frames(data: np.ndarray, lo: int, hi: int, count: int) -> np.ndarray:
    """Starts of a stream's frames: sync, a right header checksum and the expected number; doubtful ones by their frame checksum."""
    a = data[lo:hi]
    at = lo + np.flatnonzero((a[:-3] == 0xFF) & (a[1:-2] == 0xF8) & (a[2:-1] == 0x10) & (a[3:] == 0x02))
    want = np.arange(count)
    if len(at) != count:  # a frame's inside looks like a header: take the one whose frame before it checks
        code, size = _utf8_numbers(want)
        chosen, k = [lo], 1
        for x in at[1:].tolist():
            if k < count and bytes(data[x + 4 : x + 4 + size[k]]) == code[k, : size[k]].tobytes() and int(checksums(data, np.array([chosen[-1]]), np.array([x - chosen[-1]]), CRC16, 16)[0]) == 0:
                chosen.append(x)
                k += 1
        at = np.array(chosen)
    if len(at) != count or count and at[0] != lo:
        raise ValueError(f"{len(at)} frames found, {count} expected")
    return at


def decode_frames(data: np.ndarray, at: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Samples of frames (192 each) at these places of data; ValueError where a checksum or a number is wrong."""
    code, size = _utf8_numbers(number)
    head = 4 + size + 1
    for k in range(6):
        f = size > k
        if (data[at[f] + 4 + k] != code[f, k]).any():
            raise ValueError("a frame has another number")
    if checksums(data, at, head, CRC8, 8).any():
        raise ValueError("a header's checksum is wrong")
    if checksums(data, at, length, CRC16, 16).any():
        raise ValueError("a frame's checksum is wrong")
    n, lo, hi = len(at), int(at.min()), int((at + length).max())
    raw = np.concatenate([data[lo:hi], np.zeros(16, np.uint8)]).astype(np.uint64)
    w64 = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        w64 |= raw[k : k + len(w64)] << np.uint64(56 - 8 * k)
    pos = (at + head - lo) * 8

    def peek(p):
        return w64[p >> 3] << (p & 7).astype(np.uint64)  # 57 bits hold

    def take(f, width):
        p = pos[f]
        pos[f] = p + width
        width = np.broadcast_to(np.asarray(width), p.shape)
        return np.where(width > 0, peek(p) >> (64 - np.maximum(width, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)

    every = np.arange(n)
    kind = take(every, 8) >> 1
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    known = (kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32)
    if not known.all():
        raise ValueError("an unknown subframe")
    out = np.zeros((BLOCK, n), np.int64)
    sign = lambda v, b: v - ((v >> (b - 1)) << b)
    f = np.flatnonzero(kind == 0)
    if len(f):
        out[:, f] = sign(take(f, 8), 8)
    f = np.flatnonzero(kind == 1)
    for t in range(BLOCK if len(f) else 0):
        out[t, f] = sign(take(f, 8), 8)
    top = int(order.max(initial=0))
    for t in range(top):
        f = np.flatnonzero(order > t)
        out[t, f] = sign(take(f, 8), 8)
    coef, shift = np.zeros((top, n), np.int64), np.zeros(n, np.int64)
    for o in range(1, min(4, top) + 1):
        for j, c in enumerate(FIXED[o]):
            coef[j, kind == 8 + o] = c
    f = np.flatnonzero(kind >= 32)
    if len(f):
        precision = take(f, 4) + 1
        shift[f] = sign(take(f, 5), 5)
        for j in range(int(order[f].max())):
            g = order[f] > j
            coef[j, f[g]] = sign(take(f[g], precision[g]), precision[g])
    f = np.flatnonzero(kind >= 8)
    if not len(f):
        return out.T
    method = take(f, 2)
    per = BLOCK >> take(f, 4)
    width = 4 + method
    escape = (1 << width) - 1
    k, is_raw = np.zeros(len(f), np.int64), np.zeros(len(f), bool)
    first, hist = order[f], coef[:, f].copy()
    rows, p = out[:, f], pos[f].copy()
    for t in range(BLOCK):
        new = np.flatnonzero((t >= first) & ((t == first) | (t % per == 0)))
        if len(new):
            v = (peek(p[new]) >> (64 - width[new]).astype(np.uint64)).astype(np.int64)
            p[new] += width[new]
            is_raw[new] = v == escape[new]
            e = new[is_raw[new]]
            if len(e):
                v[is_raw[new]] = (peek(p[e]) >> np.uint64(59)).astype(np.int64)
                p[e] += 5
            k[new] = v
        on = t >= first
        window = peek(p)
        q = _CLZ16[(window >> np.uint64(48)).astype(np.int64)]
        long = np.flatnonzero((q == 16) & on & ~is_raw)
        skip = np.zeros(len(f), np.int64)
        while len(long):
            skip[long] += 16
            q[long] = _CLZ16[(peek(p[long] + skip[long]) >> np.uint64(48)).astype(np.int64)]
            long = long[q[long] == 16]
        if skip.any():
            window = peek(p + skip)
        q1 = np.where(is_raw, 0, q + 1)
        low = np.where(k > 0, (window << q1.astype(np.uint64)) >> (64 - np.maximum(k, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        u = ((q + skip) << k) | low
        r = np.where(is_raw, sign(low, np.maximum(k, 1)), (u >> 1) ^ -(u & 1))
        p += np.where(on, skip + q1 + k, 0)
        guess = np.zeros(len(f), np.int64)
        for j in range(min(top, t)):
            guess += hist[j] * rows[t - 1 - j]
        rows[t] = np.where(on, r + (guess >> shift[f]), rows[t])
    out[:, f] = rows
    return out.T


def decode(media: list[bytes]) -> list[bytes]:
    """The payload of unsigned bytes of each stream, all checksums verified."""
    streams = [open_stream(m) for m in media]
    data = np.frombuffer(b"".join(media), np.uint8)
    end = np.cumsum([len(m) for m in media])
    at, stop, number = [], [], []
    for m, s, e in zip(media, streams, end.tolist(), strict=True):
        a = find_frames(data, e - len(m) + s.frames_at, e, s.samples // BLOCK)
        at.append(a)
        stop.append(np.r_[a[1:], e])
        number.append(np.arange(len(a)))
    a, z, k = (np.concatenate(x) for x in (at, stop, number))
    samples = np.concatenate([decode_frames(data, a[i : i + 8192], (z - a)[i : i + 8192], k[i : i + 8192]) for i in range(0, len(a), 8192)]).astype(np.int8)
    out, lo = [], 0
    for s, x in zip(streams, at, strict=True):
        part = samples[lo : lo + len(x)].tobytes()
        if hashlib.md5(part, usedforsecurity=False).digest() != s.md5:
            raise ValueError("the stream's samples differ from its digest")
        out.append((np.frombuffer(part, np.uint8) ^ 0x80).tobytes())
        lo += len(x)
    return out


def decode_from(media: bytes, sample: int, count: int) -> bytes:
    """count samples from one on, by way of the seek table: only the frames that hold them, from the seek point before, are read."""
    s = open_stream(media)
    frame = sample // BLOCK
    last = (min(sample + count, s.samples) - 1) // BLOCK
    point, offset = max(p for p in s.seek if p[0] <= frame * BLOCK)
    after = [p for p in s.seek if p[0] > last * BLOCK]
    stop = s.frames_at + min(after)[1] if after else len(media)
    data = np.frombuffer(media, np.uint8)
    n0 = point // BLOCK
    total = (min(after)[0] if after else s.samples) // BLOCK - n0
    a = data[s.frames_at + offset : stop]
    at = [0]
    for k in range(1, total):
        code, size = _utf8_numbers(np.array([n0 + k]))
        mark = b"\xff\xf8\x10\x02" + code[0, : size[0]].tobytes()
        x = a.tobytes().find(mark, at[-1] + 1)
        while checksums(a, np.array([at[-1]]), np.array([x - at[-1]]), CRC16, 16)[0]:
            x = a.tobytes().find(mark, x + 1)
        at.append(x)
    at = np.array(at)
    pcm = decode_frames(a, at, np.r_[at[1:], len(a)] - at, n0 + np.arange(total)).astype(np.int8).ravel()
    skip = sample - point
    return (pcm[skip : skip + min(count, s.samples - sample)].view(np.uint8) ^ 0x80).tobytes()


def padded(text: str | None) -> bytes:
    """UTF-8 of a whole text (null: empty), with bytes 32 up to a positive multiple of 192."""
    b = common.utf8(text)
    return b + b" " * (max(BLOCK, -(-len(b) // BLOCK) * BLOCK) - len(b))


def feature(payload: bytes) -> str:
    """Peak, mean, energy, zero crossings and mean step of the signed samples, as whole numbers and so alike everywhere."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    step = np.abs(np.diff(x)).sum()
    return f"peak={np.abs(x).max()};mean1e3={int(x.sum()) * 1000 // len(x)};energy1e3={int(x @ x) * 1000 // len(x)};crossings={int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())};step1e3={int(step) * 1000 // len(x)}"


def to_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media) of each row; null and empty texts are one frame of spaces."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def rows(c):
        p = [padded(t) for t in c["text"].to_pylist()]
        return common.batch(doc_id=c["doc_id"], n_bytes=pa.array([len(common.utf8(t)) for t in c["text"].to_pylist()], pa.int64()), media=pa.array(encode(p), pa.binary()))

    return common.map_rows(d, rows, f"doc_id {dict(d.dtypes)['doc_id']}, n_bytes long, media binary")


def blocks_of(payload: bytes) -> list[tuple[int, bytes]]:
    """The PCM blocks between seek points: the number of the first sample, and the samples."""
    step = SEEK_EVERY * BLOCK
    return [(at, payload[at : at + step]) for at in range(0, len(payload), step)]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, pcm) of a table of to_media: PCM blocks that can be sought by their sample offsets.

    A row without media has no blocks; equal rows give their blocks again.
    """

    def rows(c):
        has = [i for i, m in enumerate(c["media"]) if m.is_valid]
        if not has:
            return None
        each = [blocks_of(p) for p in decode([c["media"][i].as_py() for i in has])]
        of = pa.array([i for i, b in zip(has, each, strict=True) for _ in b], pa.int64())
        return common.batch(
            doc_id=c["doc_id"].take(of),
            block=pa.array([k for b in each for k in range(len(b))], pa.int64()),
            first_sample=pa.array([at for b in each for at, _ in b], pa.int64()),
            pcm=pa.array([p for b in each for _, p in b], pa.binary()),
        )

    return common.map_rows(media, rows, f"doc_id {dict(media.dtypes)['doc_id']}, block long, first_sample long, pcm binary")


def from_media(media: DataFrame) -> DataFrame:
    """Decode a table of to_media to its PCM blocks: digests and features of what the stored bytes hold."""

    def rows(c):
        stored = [m.as_py() for m in c["media"]]
        back, digest = [], []
        for blocks in map(blocks_of, decode(stored)):
            sha = hashlib.sha256()
            for _, pcm in blocks:
                sha.update(pcm)
            digest.append(sha.hexdigest())
            back.append(b"".join(pcm for _, pcm in blocks))
        return common.batch(
            doc_id=c["doc_id"],
            n_bytes=c["n_bytes"],
            payload_bytes=pa.array([len(p) for p in back], pa.int64()),
            payload_sha256=pa.array(digest, pa.string()),
            tail_crc32=pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
            media_bytes=pa.array([len(m) for m in stored], pa.int64()),
            media_sha256=pa.array([hashlib.sha256(m).hexdigest() for m in stored], pa.string()),
            feature=pa.array([feature(p) for p in back], pa.string()),
        )

    return common.map_rows(media, rows, f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, payload and media digests, feature) of every row of `documents`, by way of a stored table of media.

    Null and empty texts are one frame of spaces; equal texts have equal media, and repeated rows are given again.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return from_media(common.written(to_media(docs), "media", compression="zstd"))
