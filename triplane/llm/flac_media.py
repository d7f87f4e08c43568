"""Media columns: lossless 8-bit mono FLAC, written and read by Spark tasks.

``encode`` stores bytes as unsigned 8-bit PCM in a FLAC stream: STREAMINFO with the MD5 of the samples, a SEEKTABLE
with one point for each frame, then frames of up to 4096 samples with CONSTANT, VERBATIM, FIXED (order 0 to 4) or LPC
subframes, Rice-coded residuals, a CRC-8 for each header and a CRC-16 for each frame. ``decode`` verifies every
checksum, decodes the Rice residuals and runs the linear predictors, and returns the PCM with the sample and byte
offset of each block, so that any block can be sought.

Frames do not depend on each other, and the seek table says where each begins. So both directions work on the frames of
a run at once: the encoder over flat arrays, the decoder in step, sample by sample over frames of falling length. A run
holds less than twice :data:`SLICE` samples, :data:`DECODE_SLICE` to decode: frames of many short payloads, or some of a
long one, whose MD5 and seek table are put together at its end. So a payload of any length takes a few copies of itself
and one run.

Both are Arrow functions of one column: other columns pass untouched, whatever their names. Null media decode to null;
null payloads encode like empty ones, a stream of no frames. Equal payloads have equal streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
#: Samples of a run: whole blocks.
SLICE = 128 * BLOCK
#: The decoder gains from more frames in step, and needs less for each sample.
DECODE_SLICE = 1 << 20
RATE = 8000
#: Each frame's residuals are coded in 2 ** this many partitions, where its length allows.
PARTITION_ORDER = 2
LPC_ORDER = 4
LPC_BITS = 10

# Fixed values of the format: predictors of order 0 to 4, as coefficients of the latest samples.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@cache
def _crc_tables(poly: int, bits: int, reach: int) -> np.ndarray:
    """Entry [d, b]: what byte b contributes to a CRC when d bytes follow it."""
    kind = np.uint16
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    first = []
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        first.append(r)
    first = np.array(first, dtype=kind)
    out = np.empty((reach, 256), dtype=kind)
    out[0] = first
    for d in range(1, reach):
        p = out[d - 1].astype(np.uint32)
        out[d] = ((p << 8) & mask).astype(kind) ^ first[(p >> (bits - 8)).astype(np.int64)]
    return out


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of ``data``; the CRC is linear, so bytes contribute independently."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, dtype=np.uint16)
    total = np.cumsum(sizes)
    inside = np.arange(total[-1]) - np.repeat(total - sizes, sizes)
    table = _crc_tables(0x8005, 16, max(BLOCK + 64, int(sizes.max())))
    parts = table[np.repeat(sizes, sizes) - 1 - inside, data[np.repeat(starts, sizes) + inside]]
    return np.bitwise_xor.reduceat(parts, total - sizes)


def crc8(data: bytes) -> int:
    table, r = _crc_tables(0x07, 8, 1)[0], 0
    for b in data:
        r = int(table[r ^ b])
    return r


def _utf8_number(n: int) -> bytes:
    """The format's extension of UTF-8 to 36 bits."""
    if n < 0x80:
        return bytes([n])
    extra = 1
    while n >= 1 << (6 * extra + 6 - extra):
        extra += 1
    lead = (0xFF00 >> (extra + 1)) & 0xFF
    return bytes([lead | n >> (6 * extra), *(0x80 | n >> (6 * i) & 0x3F for i in reversed(range(extra)))])


@lru_cache(1 << 16)
def _frame_header(number: int, size: int) -> bytes:
    # sync and fixed block size; size in 16 bits, rate as in STREAMINFO; mono, 8 bits a sample
    head = b"\xff\xf8\x70\x02" + _utf8_number(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _stream_header(samples: bytes, n_frames: int, sizes: np.ndarray, offsets: np.ndarray, n: int) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE. ``samples``: MD5 of the signed samples."""
    big = lambda v, k: int(v).to_bytes(k, "big")
    info = big(BLOCK, 2) * 2 + (big(sizes.min(), 3) + big(sizes.max(), 3) if n_frames else bytes(6))
    info += big(RATE << 44 | 0 << 41 | 7 << 36 | n, 8) + samples
    points = np.zeros(n_frames, dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
    points["sample"] = np.arange(n_frames) * BLOCK
    points["offset"] = offsets
    points["count"] = np.minimum(BLOCK, n - points["sample"].astype(np.int64))
    return b"fLaC" + b"\x00" + big(34, 3) + info + b"\x83" + big(18 * n_frames, 3) + points.tobytes()


def _lpc(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients [frame, order] and shifts, by autocorrelation and the Levinson recursion."""
    frames, at = len(starts), np.arange(len(x)) - np.repeat(starts, lengths)
    xf = x.astype(np.float64)
    r = np.empty((LPC_ORDER + 1, frames))
    for lag in range(LPC_ORDER + 1):
        product = xf[lag:] * xf[: max(0, len(x) - lag)] * (at[lag:] >= lag)
        r[lag] = np.add.reduceat(np.concatenate([np.zeros(lag), product])[: len(x)], starts)
    a, err = np.zeros((LPC_ORDER, frames)), r[0] * (1 + 1e-9) + 1e-9
    for i in range(LPC_ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        err *= np.maximum(1 - k * k, 1e-12)
    most = np.abs(a).max(axis=0)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(np.maximum(most, 1e-9))).astype(np.int64), 0, 15)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a.T * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _frames(pieces: list[bytes], begin: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """The coded frames of each piece, which is not empty and begins with frame ``begin`` of its stream, and their sizes."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    x = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int32) - 128
    counts = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(pieces)), counts)
    first_of = np.cumsum(counts) - counts
    inside = np.arange(len(of)) - first_of[of]
    number = inside + np.array(begin, dtype=np.int64)[of]
    lengths = np.minimum(BLOCK, sizes[of] - inside * BLOCK)
    starts = np.cumsum(lengths) - lengths
    n = len(x)
    at = np.arange(n, dtype=np.int32) - np.repeat(starts, lengths).astype(np.int32)

    # residuals of each predictor; the cheapest by the sum of magnitudes wins
    best, chosen = None, np.zeros(len(of), dtype=np.int64)
    e, kept = x, None
    lpc, shift = _lpc(x, starts, lengths)
    for order in range(6):
        if order == 5:
            q = np.zeros(n, dtype=np.int32)
            for j in range(LPC_ORDER):
                q[j + 1 :] += np.repeat(lpc[:, j].astype(np.int32), lengths)[j + 1 :] * x[: max(0, n - j - 1)]
            e = x - (q >> np.repeat(shift.astype(np.int32), lengths))
        elif order:
            e = np.concatenate([e[:1], np.diff(e)])
        warm = LPC_ORDER if order == 5 else order
        cost = np.add.reduceat(np.abs(e) * (at >= warm), starts) + (64 if order == 5 else 0)
        if best is None:
            best, kept = cost, e.copy()
            continue
        better = cost < best
        chosen[better], best = order, np.minimum(best, cost)
        take = np.repeat(better, lengths)
        kept[take] = e[take]
    warm = np.where(chosen == 5, LPC_ORDER, chosen)
    lowest, highest = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    parts = np.where((lengths % (1 << PARTITION_ORDER) == 0) & (lengths >> PARTITION_ORDER > LPC_ORDER), PARTITION_ORDER, 0)
    raw = lengths <= 2 * LPC_ORDER  # too short to predict
    u = (kept << 1) ^ (kept >> 31)
    coded = at >= np.repeat(warm, lengths)

    # one Rice parameter for each partition, from its mean
    part_sizes = np.repeat(lengths >> parts, 1 << parts)
    part_starts = np.cumsum(part_sizes) - part_sizes
    own = np.add.reduceat(u * coded, part_starts, dtype=np.int64)
    many = np.maximum(1, np.add.reduceat(coded, part_starts, dtype=np.int64))
    k_part = np.clip(np.floor(np.log2(np.maximum(own / many * 0.7, 1))).astype(np.int64), 0, 14)
    k = np.repeat(k_part, part_sizes).astype(np.int32)
    q = u >> k
    bits = np.where(coded, q + 1 + k, 8)
    before = np.zeros(n, dtype=np.int32)
    before[part_starts] = 4
    in_first = starts + np.minimum(warm, lengths - 1)
    before[starts] = 0
    extra = np.where(chosen == 5, 9 + LPC_ORDER * LPC_BITS, 0)
    before[in_first] = 10 + extra
    body = np.add.reduceat(bits + before, starts, dtype=np.int64)
    constant = lowest == highest
    raw |= (body >= 8 * lengths) & ~constant
    plain = np.repeat(raw | constant, lengths)
    coded &= ~plain
    bits[plain], before[plain] = 8, 0
    rest = np.repeat(constant, lengths) & (at > 0)
    bits[rest] = 0

    # where all goes: whole bytes for each frame
    heads = [_frame_header(int(a), int(b)) for a, b in zip(number, lengths, strict=True)]
    head_size = np.array([len(h) for h in heads])
    body = np.add.reduceat(bits + before, starts, dtype=np.int64)
    frame_size = head_size + (8 + body + 7) // 8 + 2
    frame_start = np.cumsum(frame_size) - frame_size
    run = np.cumsum(bits + before, dtype=np.int64) - bits
    base = (frame_start + head_size) * 8 + 8 - (run - before)[starts]
    pos = run + np.repeat(base, lengths)
    out = np.zeros(int(frame_size.sum()) * 8, dtype=np.uint8)

    def put(where: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            out[where + j] = values >> (width - 1 - j) & 1

    kind = np.where(constant, 0, np.where(raw, 1, np.where(chosen == 5, 32 + LPC_ORDER - 1, 8 + chosen)))
    put((frame_start + head_size) * 8, kind << 1, 8)
    predicted = ~(raw | constant)
    by_lpc = predicted & (chosen == 5)
    here = pos[in_first] - before[in_first]
    put(here[by_lpc], np.full(by_lpc.sum(), LPC_BITS - 1), 4)
    put(here[by_lpc] + 4, shift[by_lpc], 5)
    for j in range(LPC_ORDER):
        put(here[by_lpc] + 9 + j * LPC_BITS, lpc[by_lpc, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    put((here + extra)[predicted], parts[predicted], 6)
    head_at = part_starts.copy()
    head_at[np.cumsum(1 << parts) - (1 << parts)] = in_first
    shown = np.repeat(predicted, 1 << parts)
    put(pos[head_at[shown]] - 4, k_part[shown], 4)
    c = np.flatnonzero(coded)
    stop = pos[c] + q[c]
    out[stop] = 1
    k, u = k[c], u[c]
    for j in range(int(k.max(initial=0))):
        has = k > j
        out[(stop + k - j)[has]] = u[has] >> j & 1
    p = np.flatnonzero(~coded & (bits > 0))
    put(pos[p], x[p], 8)
    data = np.packbits(out)
    head_flat = np.frombuffer(b"".join(heads), dtype=np.uint8)
    data[np.repeat(frame_start - (np.cumsum(head_size) - head_size), head_size) + np.arange(len(head_flat))] = head_flat
    check = crc16(data, frame_start, frame_start + frame_size - 2)
    data[frame_start + frame_size - 2], data[frame_start + frame_size - 1] = check >> 8, check & 0xFF

    ends = np.append(frame_start, len(data))[first_of + counts]
    return [(data[frame_start[i] : j].tobytes(), frame_size[i : i + c]) for i, j, c in zip(first_of, ends, counts, strict=True)]


def _encode_slice(payloads: list[bytes]) -> list[bytes]:
    """The stream of each payload; pieces of :data:`SLICE` samples at most are coded, in runs."""
    coded: list[list[tuple[bytes, np.ndarray]]] = [[] for _ in payloads]
    pieces = ((i, at) for i, p in enumerate(payloads) for at in range(0, len(p), SLICE))
    for run in _slices(pieces, lambda piece: min(SLICE, len(payloads[piece[0]]) - piece[1]), SLICE):
        own = [payloads[i][at : at + SLICE] for i, at in run]
        for (i, _), frames in zip(run, _frames(own, [at // BLOCK for _, at in run]), strict=True):
            coded[i].append(frames)
    streams = []
    for p, frames in zip(payloads, coded, strict=True):
        md5 = hashlib.md5()
        for at in range(0, len(p), SLICE):
            md5.update(np.frombuffer(p, dtype=np.uint8, count=min(SLICE, len(p) - at), offset=at) ^ 128)
        sizes = np.concatenate([np.zeros(0, np.int64), *(size for _, size in frames)])
        head = _stream_header(md5.digest(), len(sizes), sizes, np.cumsum(sizes) - sizes, len(p))
        streams.append(b"".join([head, *(data for data, _ in frames)]))
    return streams


class CorruptMedia(ValueError):
    """A checksum, marker or count in a stream is wrong."""


#: Zeros before the first one of 16 bits.
_LEADING = np.array([16 - i.bit_length() for i in range(1 << 16)], dtype=np.int64)


class _Bits:
    """Reads of up to 32 bits at many places of one buffer; ``words``: the 64 bits from each byte on."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        n = len(padded) - 8
        self.words = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            self.words <<= np.uint64(8)
            self.words |= padded[j : j + n]

    def window(self, pos: np.ndarray) -> np.ndarray:
        """64 bits from each place; at least the first 57 are its own."""
        return self.words[pos >> 3] << (pos & 7).view(np.uint64)

    def read(self, pos: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        return ((self.window(pos) >> np.uint64(1)) >> (np.uint64(63) - np.asarray(width, dtype=np.uint64))).astype(np.int64)

    def signed(self, pos: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        v = self.read(pos, width)
        return np.where(v >> (np.asarray(width) - 1) & 1, v - (1 << np.asarray(width, dtype=np.int64)), v)


def _need(good: bool | np.bool_, what: str) -> None:
    if not good:
        raise CorruptMedia(what)


def _predicted(bits: _Bits, pos: np.ndarray, kind: np.ndarray, length: np.ndarray, limit: int) -> np.ndarray:
    """Samples [sample, frame] of FIXED and LPC subframes of falling length, whose bodies begin at ``pos``."""
    n, longest = len(length), int(length[0])
    depth = np.where(kind >= 32, kind - 31, kind - 8)
    reach = max(1, int(depth.max()))
    warm = np.zeros((reach, n), dtype=np.int32)
    for i in range(reach):
        w = np.flatnonzero(depth > i)
        warm[i, w] = bits.signed(pos[w], 8)
        pos[w] += 8
    coef, shift = np.zeros((reach, n), dtype=np.int32), np.zeros(n, dtype=np.int32)
    for f in np.flatnonzero(kind <= 12):
        coef[: depth[f], f] = FIXED[depth[f]]
    if (w := np.flatnonzero(kind >= 32)).size:
        width = bits.read(pos[w], 4) + 1
        shift[w] = bits.signed(pos[w] + 4, 5)
        _need((shift[w] >= 0).all(), "a negative shift")
        pos[w] += 9
        for j in range(int(depth[w].max())):
            has = depth[w] > j
            coef[j, w[has]] = bits.signed(pos[w[has]], width[has])
            pos[w[has]] += width[has]
    _need((bits.read(pos, 2) == 0).all(), "only 4-bit Rice parameters are supported")
    parts = 1 << bits.read(pos + 2, 4)
    pos += 6

    # partitions by the sample that they begin with
    frame = np.repeat(np.arange(n), parts)
    inside = np.arange(len(frame)) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = np.where(inside == 0, depth[frame], inside * (length // parts)[frame])
    by_begin = np.argsort(begins, kind="stable")
    at, first = np.unique(begins[by_begin], return_index=True)
    due = dict(zip(at.tolist(), np.split(frame[by_begin], first[1:]), strict=True))

    # Rice codes, all frames in step: falling lengths leave a prefix of frames in play
    live = np.searchsorted(-length, -np.arange(longest), side="left").tolist()
    late = np.flatnonzero(depth)
    e = np.zeros((longest, n), dtype=np.int32)
    k, rest = np.zeros(n, dtype=np.int64), np.full(n, 63, dtype=np.uint64)
    one, u48 = np.uint64(1), np.uint64(48)
    words, deepest = bits.words, int(depth.max())
    for i in range(longest):
        m = live[i]
        if i in due:
            now = due[i]
            k[now] = bits.read(pos[now], 4)
            _need((k[now] < 15).all(), "escaped partitions are not supported")
            rest[now] = 63 - k[now]
            pos[now] += 4
        here = pos[:m]
        w = words[here >> 3]
        w <<= (here & 7).view(np.uint64)
        z = _LEADING[(w >> u48).view(np.int64)]
        if z.max() == 16:
            far = np.flatnonzero(z == 16)
            while far.size:
                _need((here[far] + z[far] < limit).all(), "a residual runs past the end")
                more = _LEADING[bits.read(here[far] + z[far], 16)]
                z[far] += more
                far = far[more == 16]
            w = bits.window(here + z) << one
        else:
            w <<= (z + 1).view(np.uint64)
        w >>= one
        w >>= rest[:m]
        e[i, :m] = (z << k[:m]) | w.view(np.int64)
        z += k[:m]
        z += 1
        if i < deepest:  # warm-up samples have no code
            wait = late[(depth[late] > i) & (late < m)]
            e[i, wait] = 0
            z[wait] = 0
        here += z
        if i & 255 == 0:
            _need(int(here.max()) <= limit, "residuals run past the end")
    _need(int(pos.max()) <= limit, "residuals run past the end")
    odd = e & 1
    e >>= 1
    e ^= np.negative(odd, out=odd)
    del odd

    s = np.zeros((reach + longest, n), dtype=np.int32)
    coef = coef[::-1].copy()  # the oldest sample first, as rows stand in s
    for i in range(longest):
        m = live[i]
        now = (coef[:, :m] * s[i : i + reach, :m]).sum(axis=0, dtype=np.int32)
        now >>= shift[:m]
        now += e[i, :m]
        if i < deepest:
            wait = late[(depth[late] > i) & (late < m)]
            now[wait] = warm[i, wait]
        s[reach + i, :m] = now
    return s[reach:]


def _opened(s: bytes) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Seek points (first sample, byte offset from the first frame, samples) and MD5 of a stream, and where its frames begin and the last ends."""
    _need(s[:4] == b"fLaC" and len(s) >= 42, "no FLAC marker")
    at, last, table, info = 4, False, np.zeros((0, 3), dtype=np.int64), None
    while not last:
        _need(at + 4 <= len(s), "a metadata block is cut short")
        last, kind, size = s[at] >> 7, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        part = s[at + 4 : at + 4 + size]
        _need(len(part) == size, "a metadata block is cut short")
        if kind == 0:
            info = part
        elif kind == 3:
            t = np.frombuffer(part, dtype=[("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
            table = np.stack([t["s"], t["o"], t["n"]], axis=1).astype(np.int64)
        at += 4 + size
    _need(info is not None, "no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    _need(packed >> 41 & 7 == 0 and packed >> 36 & 31 == 7, "only 8-bit mono is supported")
    _need(table[:, 2].sum() == packed & (1 << 36) - 1, "the seek table doesn't cover all samples")
    bounds = np.append(at + table[:, 1], len(s))
    _need(not len(table) or (bounds[0] >= at and (np.diff(bounds) > 2).all()), "seek points are out of order")
    return table, info[18:34], bounds


def _decode_slice(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """PCM and the seek points of each stream; pieces of about :data:`DECODE_SLICE` samples are decoded, in runs."""
    opened = [_opened(s) for s in streams]
    pieces = []
    for i, (table, _, _) in enumerate(opened):
        part = (np.cumsum(table[:, 2]) - table[:, 2]) // DECODE_SLICE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(table)]
        pieces += [(i, lo, hi) for lo, hi in zip(edges, edges[1:], strict=False) if lo < hi]
    read: list[list[bytes]] = [[] for _ in streams]
    for run in _slices(pieces, lambda p: int(opened[p[0]][0][p[1] : p[2], 2].sum()), DECODE_SLICE):
        cut = [(streams[i], opened[i][2][lo : hi + 1], lo, opened[i][0][lo:hi, 2]) for i, lo, hi in run]
        for (i, _, _), pcm in zip(run, _samples_of(cut), strict=True):
            read[i].append(pcm)
    result = []
    for (table, given, _), parts in zip(opened, read, strict=True):
        md5 = hashlib.md5()
        for part in parts:
            md5.update(np.frombuffer(part, dtype=np.uint8) ^ 128)
        _need(md5.digest() == given, "MD5 of the samples")
        result.append((b"".join(parts), table))
    return result


def _samples_of(pieces: list[tuple[bytes, np.ndarray, int, np.ndarray]]) -> list[bytes]:
    """PCM of each piece: its stream, the bounds of its frames there, the number of the first one, and their samples."""
    data = np.frombuffer(b"".join(s[bounds[0] : bounds[-1]] for s, bounds, _, _ in pieces), dtype=np.uint8)
    begun = np.cumsum([0, *(b[-1] - b[0] for _, b, _, _ in pieces[:-1])])
    start = np.concatenate([b[:-1] - b[0] + at for (_, b, _, _), at in zip(pieces, begun, strict=True)])
    end = np.concatenate([b[1:] - b[0] + at for (_, b, _, _), at in zip(pieces, begun, strict=True)])
    number = np.concatenate([first + np.arange(len(own)) for _, _, first, own in pieces])
    length = np.concatenate([own for _, _, _, own in pieces])
    given = data[end - 2].astype(np.uint16) << 8 | data[end - 1]
    _need((crc16(data, start, end - 2) == given).all(), "CRC-16 of a frame")
    head_size = np.empty(len(start), dtype=np.int64)
    for i, (a, no, size) in enumerate(zip(start.tolist(), number.tolist(), length.tolist(), strict=True)):
        head = _frame_header(no, size)
        _need(data[a : a + len(head)].tobytes() == head, "a frame's header or its CRC-8")
        head_size[i] = len(head)

    order = np.argsort(-length, kind="stable")
    length, pos = length[order], (start + head_size)[order] * 8
    bits = _Bits(data)
    kind = bits.read(pos, 8) >> 1
    pos = pos + 8
    n = len(length)
    pcm = np.zeros((n, int(length[0])), dtype=np.uint8)
    _need(((kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32)).all(), "an unknown subframe")
    for f in np.flatnonzero(kind == 1):
        a = pos[f] >> 3
        pcm[f, : length[f]] = data[a : a + length[f]] ^ 128
    for f in np.flatnonzero(kind == 0):
        pcm[f] = data[pos[f] >> 3] ^ 128
    if (p := np.flatnonzero(kind >= 8)).size:
        samples = _predicted(bits, pos[p], kind[p], length[p], 8 * len(data))
        pcm[p, : samples.shape[0]] = (samples.T + 128).astype(np.uint8)
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    result, f = [], 0
    for _, _, _, own in pieces:
        rows = back[f : f + len(own)]
        f += len(own)
        result.append(b"".join(pcm[r, :size].tobytes() for r, size in zip(rows, own, strict=True)))
    return result


def _slices(values: Iterable, weight, most: int) -> Iterator[list]:
    """Runs of values of about ``most`` samples."""
    own, size = [], 0
    for v in values:
        own.append(v)
        size += weight(v)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def encode(payload: Column) -> Column:
    """The FLAC stream of a binary column."""

    @F.arrow_udf("binary")
    def flac(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = (v.as_py() or b"" for v in batch)
            parts = [pa.array(_encode_slice(own), type=pa.binary()) for own in _slices(values, lambda v: len(v) + 64, SLICE)]
            yield pa.concat_arrays(parts or [pa.array([], type=pa.binary())])

    return flac(payload)


DECODED = pa.struct(
    [
        ("pcm", pa.binary()),
        ("blocks", pa.list_(pa.struct([("first_sample", pa.int64()), ("byte_offset", pa.int64()), ("samples", pa.int32())]))),
        ("feature", pa.string()),
    ]
)


def feature(pcm: bytes) -> str:
    """Samples, mean and mean square around the middle of the range, and crossings of it, exact up to six digits."""
    total = squares = crossings = 0
    for at in range(0, len(pcm), SLICE):
        # a crossing belongs to the part that its first sample is in
        x = np.frombuffer(pcm, dtype=np.uint8, count=min(SLICE + 1, len(pcm) - at), offset=at).astype(np.int64) - 128
        total += int(x[:SLICE].sum())
        squares += int((x[:SLICE] * x[:SLICE]).sum())
        crossings += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    n = max(1, len(pcm))
    return f"n={len(pcm)};mean={total / n:.6f};power={squares / n:.6f};crossings={crossings}"


def _samples(stream: bytes | None) -> int:
    """What a stream announces."""
    return 64 if stream is None else 64 + (int.from_bytes(stream[21:26], "big") & (1 << 36) - 1)


def _read(streams: list[bytes | None]) -> pa.Array:
    read = iter(_decode_slice([v for v in streams if v is not None]))
    out = []
    for v in streams:
        if v is None:
            out.append(None)
            continue
        raw, table = next(read)
        blocks = [{"first_sample": a, "byte_offset": b, "samples": c} for a, b, c in table.tolist()]
        out.append({"pcm": raw, "blocks": blocks, "feature": feature(raw)})
    return pa.array(out, type=DECODED)


def decode(media: Column) -> Column:
    """Struct of ``pcm`` (unsigned bytes), ``blocks`` (seek points) and ``feature``; raises on any wrong checksum."""

    @F.arrow_udf("struct<pcm:binary,blocks:array<struct<first_sample:bigint,byte_offset:bigint,samples:int>>,feature:string>")
    def pcm(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = (v.as_py() for v in batch)
            parts = [_read(own) for own in _slices(values, _samples, DECODE_SLICE)]
            yield pa.concat_arrays(parts or [pa.array([], type=DECODED)])

    return pcm(media)


def pcm_blocks(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per PCM block of each stream: key, first_sample, byte_offset, samples, pcm. Each block is cut from the payload before rows are made."""
    read = decode(F.col(media))
    cut = lambda all_: F.transform(all_["blocks"], lambda b: F.struct(b["first_sample"].alias("first_sample"), b["byte_offset"].alias("byte_offset"), b["samples"].alias("samples"), F.substring(all_["pcm"], b["first_sample"].cast("int") + 1, b["samples"]).alias("pcm")))
    each = df.select(F.col(key), read.alias("read")).select(F.col(key), cut(F.col("read")).alias("blocks"))
    return each.select(F.col(key), F.inline("blocks"))


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none), with zeros up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(64), (F.ceil(F.length(raw) / 64) * 64).cast("int"))
    return F.rpad(raw, size, F.lit(b"\0"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: what was stored for its text and what was read back."""
    text = F.col("text")
    stored = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), encode(payload(text)).alias("media"))
    read = stored.withColumn("read", decode(F.col("media")))
    pcm = F.col("read.pcm")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length(pcm).cast("long").alias("payload_bytes"),
        F.sha2(pcm, 256).alias("payload_sha256"),
        F.crc32(F.substring(pcm, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("read.feature").alias("feature"),
    )
