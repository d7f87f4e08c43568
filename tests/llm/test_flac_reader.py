"""The stored form against a second, bit by bit reader of the format (RFC 9639)."""

import hashlib
import random

from triplane.llm import flac_media as M


class Bits:
    def __init__(self, data):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)
        self.size = self.left

    def take(self, n):
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        n = 0
        while not self.take(1):
            n += 1
        return n

    def at(self):
        return (self.size - self.left) // 8


def residuals(bits, size, order):
    width = {0: 4, 1: 5}[bits.take(2)]
    parts, out = 1 << bits.take(4), []
    for p in range(parts):
        rice = bits.take(width)
        n = size // parts - (order if p == 0 else 0)
        if rice == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                v = bits.unary() << rice | bits.take(rice)
                out.append(v >> 1 ^ -(v & 1))
    return out


def predicted(warm, rest, coefficients, shift):
    x = list(warm)
    for r in rest:
        x.append(r + (sum(c * x[-1 - i] for i, c in enumerate(coefficients)) >> shift))
    return x


def subframe(bits, size, kinds):
    assert bits.take(1) == 0
    kind, wasted, depth = bits.take(6), 0, 8
    if bits.take(1):
        wasted = bits.unary() + 1
        depth -= wasted
    if kind == 0:
        kinds.add("constant")
        x = [bits.signed(depth)] * size
    elif kind == 1:
        kinds.add("verbatim")
        x = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12:
        order = kind - 8
        kinds.add(f"fixed {order}")
        warm = [bits.signed(depth) for _ in range(order)]
        x = predicted(warm, residuals(bits, size, order), [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order], 0)
    else:
        order = kind - 31
        assert kind >= 32
        kinds.add("lpc")
        warm = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        coefficients = [bits.signed(precision) for _ in range(order)]
        x = predicted(warm, residuals(bits, size, order), coefficients, shift)
    return [v << wasted for v in x]


def crc(data, poly, width):
    r = 0
    for b in data:
        r ^= b << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ (poly if r >> (width - 1) else 0)) & (1 << width) - 1
    return r


def read(stream):
    """Unsigned samples, seek points and the kinds of subframes."""
    assert stream[:4] == b"fLaC"
    at, last, info, points = 4, 0, None, []
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, n, 18)]
        at += 4 + n
    packed = int.from_bytes(info[10:18], "big")
    assert packed >> 41 & 7 == 0 and packed >> 36 & 31 == 7  # mono, 8 bits
    total, first, samples, kinds, seen = packed & (1 << 36) - 1, at, [], set(), []
    while at < len(stream):
        bits = Bits(stream[at:])
        assert bits.take(14) == 0x3FFE and bits.take(1) == 0
        fixed = bits.take(1) == 0
        code, rate = bits.take(4), bits.take(4)
        assert fixed and bits.take(4) == 0 and bits.take(3) in (0, 1) and bits.take(1) == 0 and rate in (0, *range(1, 12))
        lead = bits.take(8)
        more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
        number = lead if not more else lead & (1 << (6 - more)) - 1
        for _ in range(more):
            number = number << 6 | bits.take(8) & 63
        size = {6: lambda: bits.take(8) + 1, 7: lambda: bits.take(16) + 1}[code]() if code in (6, 7) else 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
        assert number == len(seen) and bits.take(8) == crc(stream[at : at + bits.at() - 1], 0x07, 8)
        seen.append((len(samples), at - first, size))
        samples += subframe(bits, size, kinds)
        bits.left -= bits.left % 8
        end = at + bits.at()
        assert int.from_bytes(stream[end : end + 2], "big") == crc(stream[at:end], 0x8005, 16)
        at = end + 2
    raw = bytes(v & 255 for v in samples)
    assert len(samples) == total and hashlib.md5(raw).digest() == info[18:34] and seen == points
    return bytes(v + 128 for v in samples), kinds


def test_a_second_reader_reads_the_same():
    r = random.Random(4)
    smooth, x = [], 128
    for i in range(9000):
        x = max(0, min(255, x + r.choice((-1, 0, 1)) + (1 if i % 200 < 100 else -1)))
        smooth.append(x)
    wave = bytes(int(128 + 100 * __import__("math").sin(i / 9) + r.random() * 3) for i in range(6000))
    payloads = [b"", b"\0" * 64, b"a", bytes(range(256)) * 20, r.randbytes(5000), bytes(smooth), wave, "Some text, which goes on; ünd so weiter. ".encode() * 300, b"ab" * 2048, bytes(4096) + b"x"]
    kinds = set()
    for stream, payload in zip(M._encode_slice(payloads), payloads, strict=True):
        got, own = read(bytes(stream))
        assert got == payload
        kinds |= own
    assert {"constant", "verbatim", "lpc"} <= kinds and any(k.startswith("fixed") for k in kinds)


def test_digest_of_the_given_table(spark):
    """The whole query against the second reader, and features by plain sums."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    media = {r.doc_id: bytes(r.media) for r in docs.select("doc_id", M.encode(M.payload(docs.text)).alias("media")).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for row in M.digest(docs).collect():
        raw = (text[row.doc_id] or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        got, _ = read(media[row.doc_id])
        x = [b - 128 for b in want]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert got == want and row.payload_sha256 == hashlib.sha256(want).hexdigest() and row.media_sha256 == hashlib.sha256(media[row.doc_id]).hexdigest()
        assert row.feature == f"n={len(x)};mean={sum(x) / len(x):.6f};power={sum(v * v for v in x) / len(x):.6f};crossings={crossings}"
