"""Compressed pictures, decoded one by one: TIFF strips and tiles (LZW, PackBits,
deflate, differences along rows), and baseline JPEG as in Motion-JPEG video."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the TIFF format: compression schemes.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpack_bits(raw: bytes) -> bytes:
    """Runs of literal and of repeated bytes."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, 256 to begin anew, 257 to end;
    codes grow one entry early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, bits, held, last = list(first), [], 9, 0, 0, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            now = table[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
        out.append(now)
        last = now
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def unpack(raw: bytes, scheme: int) -> bytes:
    if scheme == PLAIN:
        return raw
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if scheme == PACKBITS:
        return unpack_bits(raw)
    if scheme == LZW:
        return unpack_lzw(raw)
    raise ValueError(f"compression scheme {scheme}")


def block(raw: bytes, scheme: int, differences: bool, h: int, w: int, kind: str) -> np.ndarray:
    """A strip or tile of h x w grey values of a type like ">u2"."""
    im = np.frombuffer(unpack(raw, scheme), dtype=kind)[: h * w].reshape(h, w)
    return np.cumsum(im, axis=1, dtype=im.dtype.newbyteorder("=")) if differences else im


# Fixed values of the JPEG standard: the order of a block's coefficients, and the Huffman tables
# that Motion-JPEG files may leave out (numbers of codes of 1 to 16 bits, and what they stand for).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_ROWS = lambda first, spans: bytes(first) + bytes(r << 4 | c for r, (a, b) in spans for c in range(a, b + 1))
_TAIL = [(r, (3, 10)) for r in range(4, 8)]
COMMON = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    (1, 0): (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        _ROWS(
            bytes.fromhex("0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a".replace(" ", "")),
            [*_TAIL, (8, (3, 10)), *[(r, (2, 10)) for r in range(9, 14)], (14, (1, 10)), (15, (1, 10))],
        ),
    ),
    (1, 1): (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        _ROWS(
            bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a".replace(" ", "")),
            [*_TAIL, *[(r, (2, 10)) for r in range(8, 16)]],
        ),
    ),
}


def _codes(counts: bytes, values: bytes) -> dict[int, int]:
    """For each 16 bits that may come next: code length << 8 | value."""
    out, code, at = np.zeros(1 << 16, dtype=np.int32), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    c = 0.5 * np.cos((2 * x + 1) * k * np.pi / 16)
    c[0] = np.sqrt(1 / 8)
    return c


COSINES = _cosines()
_COMMON_CODES = {}


def jpeg_grey(raw: bytes) -> np.ndarray:
    """The grey picture, or the brightness of a colour one, of a baseline JPEG, as bytes.

    Restart markers, any sampling factors and missing Huffman tables are as they may
    be; progressive, arithmetic and 12-bit pictures raise ValueError, damaged ones too.
    """
    try:
        return _decoded(raw)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("a damaged picture") from e


def _decoded(raw: bytes) -> np.ndarray:
    at, tables, codes, restart, parts, shape = 2, {}, {}, 0, [], None
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        mark = raw[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            bits, h, w, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8 bits a sample")
            shape, parts = (h, w), [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline pictures")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            if shape is None:
                raise ValueError("a scan without a frame")
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            return _scan(raw[at + 2 + size :], shape, [(*p, chosen[p[0]]) for p in parts if p[0] in chosen], tables, codes, restart)
        at += 2 + size
    raise ValueError("no picture")


def _scan(raw: bytes, shape: tuple[int, int], parts: list[tuple], tables: dict, codes: dict, restart: int) -> np.ndarray:
    """The first component of an interleaved scan."""
    h, w = shape
    alone = len(parts) == 1
    hs, vs = (1, 1) if alone else (parts[0][1], parts[0][2])
    most_h, most_v = (1, 1) if alone else (max(p[1] for p in parts), max(p[2] for p in parts))
    across, down = -(-w // (8 * most_h)), -(-h // (8 * most_v))

    def table(kind: int, k: int) -> list:
        if (kind, k) not in codes:
            codes[kind, k] = _COMMON_CODES.setdefault((kind, min(k, 1)), _codes(*COMMON[kind, min(k, 1)]))
        return codes[kind, k]

    plan = []  # for each block of a unit: component, its tables, its place
    for c, (_, ph, pv, _, chosen) in enumerate(parts):
        for y in range(1 if alone else pv):
            for x in range(1 if alone else ph):
                plan.append((c, table(0, chosen >> 4), table(1, chosen & 15), y, x))
    out = np.zeros((down * vs, across * hs, 64), dtype=np.float64)
    # entropy-coded bytes between restart markers, stuffing removed
    segments, start, at = [], 0, raw.find(b"\xff")
    while 0 <= at < len(raw) - 1:
        if 0xD0 <= raw[at + 1] <= 0xD7:
            segments.append(raw[start:at])
            start = at + 2
        elif raw[at + 1] not in (0, 0xFF):
            break
        at = raw.find(b"\xff", at + 1 + (raw[at + 1] != 0xFF))
    segments.append(raw[start : at if at >= 0 else len(raw)])
    units, per = across * down, restart or across * down
    if len(segments) < -(-units // per):
        raise ValueError("the picture ends early")
    for s in range(-(-units // per)):
        data = segments[s].replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        last, held, bits, pos = [0] * len(parts), 0, 0, 0
        for unit in range(s * per, min((s + 1) * per, units)):
            for c, dc, ac, y, x in plan:
                k, found = 0, []
                while k < 64:
                    if bits < 32:
                        held = (held & ((1 << bits) - 1)) << 32 | int.from_bytes(data[pos : pos + 4].ljust(4, b"\xff"), "big")
                        bits, pos = bits + 32, pos + 4
                    entry = (dc if k == 0 else ac)[held >> (bits - 16) & 0xFFFF]
                    if not entry:
                        raise ValueError("a code that the tables don't have")
                    bits -= entry >> 8
                    skip, n = entry >> 4 & 15, entry & 15
                    if k:
                        if not n and skip < 15:
                            break
                        k += skip
                        if k > 63:
                            raise ValueError("too many coefficients")
                    if n:
                        bits -= n
                        v = held >> bits & ((1 << n) - 1)
                        v -= 0 if v >> (n - 1) else (1 << n) - 1
                    else:
                        v = 0
                    if k == 0:
                        last[c] = v = last[c] + v
                    if c == 0 and v:
                        found.append((k, v))
                    k += 1
                if c == 0 and found:
                    row = out[unit // across * vs + y, unit % across * hs + x]
                    for k, v in found:
                        row[k] = v
        if pos - bits // 8 > len(data) - 7:
            raise ValueError("the picture ends early")
    coefficients = np.zeros_like(out)
    coefficients[..., ZIGZAG] = out * tables[parts[0][3]]
    blocks = COSINES.T @ coefficients.reshape(*out.shape[:2], 8, 8) @ COSINES
    plane = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(out.shape[0] * 8, -1)
    if (hs, vs) != (most_h, most_v):
        plane = plane.repeat(most_v // vs, axis=0).repeat(most_h // hs, axis=1)
    return plane[:h, :w]
