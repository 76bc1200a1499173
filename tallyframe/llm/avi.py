"""Media columns: AVI files with motion JPEG frames.

A reader parses the RIFF index, a decoder for baseline JPEG decodes the intra frames
(all restart intervals side by side), and a detector cuts shots where the histogram
difference stands out from those around it. A writer stores bytes losslessly: one
sample for each flat 8 x 8 block, so any decoder gives the samples back exactly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, slices, table, tidy, with_results

#: Samples of a frame, as blocks across and down, and frames a second.
ACROSS, DOWN, RATE = 16, 12, 10
FRAME = ACROSS * DOWN

#: Fixed values of the JPEG standard: the zigzag order of a block's coefficients.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]

# Lengths of the writer's codes for the magnitude classes 0 to 8 of a sample: with the class's own bits and the end of
# block (one bit), every sample fills 9 to 16 bits, so each is two bytes before its restart marker.
_CODE_BITS = {0: 8, 1: 8, 2: 7, 3: 6, 4: 5, 5: 4, 6: 3, 7: 2, 8: 3}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, bits)."""
    out, code, bits = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - bits
        out[symbol], bits = (code, n), n
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind]) + bytes(sum(lengths[s] == n for s in symbols) for n in range(1, 17)) + bytes(symbols)


def _head(across: int = ACROSS, down: int = DOWN) -> bytes:
    quant = bytes([0]) + bytes([8] * 64)  # 8: the mean of a flat block is its one coefficient
    frame = struct.pack(">BHHB", 8, down * 8, across * 8, 1) + bytes([1, 0x11, 0])
    scan = bytes([1, 1, 0x00, 0, 63, 0])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, _table(0x00, _CODE_BITS)) + _segment(0xC4, _table(0x10, {0: 1})) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, scan)


def _sample_codes() -> np.ndarray:
    """The two bytes of each sample value: class, difference from the middle, end of block, ones."""
    codes = _codes(_CODE_BITS)
    out = np.zeros((256, 2), np.uint8)
    for value in range(256):
        v = value - 128
        size = abs(v).bit_length()
        code, n = codes[size]
        bits = format(code, f"0{n}b") + (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "") + "0"
        if not 9 <= len(bits) <= 16:
            raise AssertionError(bits)
        out[value] = list(int(bits.ljust(16, "1"), 2).to_bytes(2, "big"))
    if (out == 255).any():
        raise AssertionError("a byte would need stuffing")
    return out


_HEAD, _SAMPLES = _head(), _sample_codes()
_JPEG = len(_HEAD) + 4 * FRAME  # the last sample has the end of the image for its marker


def _pad(n: int) -> int:
    return n + n % 2


def write_avi(payload: bytes) -> bytes:
    """An AVI file of motion JPEG frames that hold `payload`, a multiple of FRAME bytes, one sample a byte."""
    n = len(payload) // FRAME
    size = _pad(_JPEG)
    frames = np.zeros((n, 8 + size), np.uint8)
    frames[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", _JPEG), np.uint8)
    frames[:, 8 : 8 + len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
    body = np.empty((n, FRAME, 4), np.uint8)
    body[:, :, :2] = _SAMPLES[np.frombuffer(payload, np.uint8)].reshape(n, FRAME, 2)
    body[:, :, 2] = 0xFF
    body[:, :, 3] = 0xD0 + np.arange(FRAME) % 8
    body[:, -1, 3] = 0xD9
    frames[:, 8 + len(_HEAD) : 8 + _JPEG] = body.reshape(n, -1)
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # key frame
    index[:, 2] = 4 + np.arange(n) * (8 + size)
    index[:, 3] = _JPEG
    width, height = ACROSS * 8, DOWN * 8
    main = struct.pack("<14I", 1_000_000 // RATE, _JPEG * RATE, 0, 0x10, n, 0, 1, _JPEG, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, _JPEG, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    part = lambda name, data: chunk(b"LIST", name + data)
    header = part(b"hdrl", chunk(b"avih", main) + part(b"strl", chunk(b"strh", stream) + chunk(b"strf", form)))
    return chunk(b"RIFF", b"AVI " + header + part(b"movi", frames.tobytes()) + chunk(b"idx1", index.tobytes()))


@dataclass
class Video:
    rate: float
    frames: list[bytes]


def read_avi(data: bytes) -> Video:
    """Frames of all RIFF chunks (AVI and AVIX) in the order of the indexes (indx and ix##, else idx1 for the first movi
    list), or of the movi lists where there is none. A frame without bytes repeats the one before it. Raises ValueError
    for other files, and for those that end before their frames do.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    scale, rate, codec, lists, index, supers = 1, 0, b"", [], None, {}
    video, streams = 0, 0

    def walk(at: int, end: int) -> None:
        nonlocal scale, rate, codec, index, video, streams
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    if body + size > len(data):
                        raise ValueError("the file ends inside its frames")
                    lists.append((body, stop))
                else:
                    walk(body + 4, stop)
            elif name == b"strh":
                if data[body : body + 4] == b"vids" and not rate:
                    codec, video = data[body + 4 : body + 8], streams
                    scale, rate = struct.unpack_from("<II", data, body + 20)
                streams += 1
            elif name == b"indx":
                supers[streams - 1] = body, stop
            elif name == b"idx1" and index is None:
                index = np.frombuffer(data[body : body + (stop - body) // 16 * 16], "<u4").reshape(-1, 4)
            at = body + size + size % 2

    at = 0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        walk(at + 12, min(len(data), at + 8 + size))
        at += 8 + size + size % 2
    if not lists or not rate or codec.upper() != b"MJPG":
        raise ValueError("no motion JPEG stream")
    wanted = {int.from_bytes(b"%02d" % video + x, "little") for x in (b"dc", b"db")}

    def scan(at: int, end: int) -> Iterator[tuple[int, int]]:
        while at + 8 <= end:
            name, size = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"LIST":
                yield from scan(at + 12, min(at + 8 + size, end))
            elif name in wanted:
                yield at + 8, size
            at += 8 + size + size % 2

    def listed(body: int, stop: int, inner: bool = False) -> Iterator[tuple[int, int]]:
        """Places and sizes by an index of chunks, or by an index of such."""
        kind, n = data[body + 3], int.from_bytes(data[body + 4 : body + 8], "little")
        if body + 24 + n * (16 if kind == 0 else 8) > stop:
            raise ValueError("an index is too short")
        if kind == 0 and not inner:
            for at, size, _ in struct.iter_unpack("<QII", data[body + 24 : body + 24 + 16 * n]):
                if data[at : at + 2] != b"ix":
                    raise ValueError("the file ends before an index")
                yield from listed(at + 8, min(at + size, len(data)) if size else len(data), True)
        else:
            longs, base = int.from_bytes(data[body : body + 2], "little"), int.from_bytes(data[body + 12 : body + 20], "little")
            if kind != 1 or longs != 2:
                raise ValueError("an index of an unknown kind")
            for at, size in struct.iter_unpack("<II", data[body + 24 : body + 24 + 8 * n]):
                yield base + at, size & 0x7FFFFFFF  # the highest bit: no key frame

    places: list[tuple[int, int]] = []
    if video in supers:
        places = list(listed(*supers[video]))
    if not places:
        rows = index[np.isin(index[:, 0], list(wanted))] if index is not None else np.zeros((0, 4), "<u4")
        if len(rows):
            # Offsets count from the list's name, or from the start of the file.
            first = int(rows[0, 2])
            base = lists[0][0] if data[lists[0][0] + first : lists[0][0] + first + 4] == int(rows[0, 0]).to_bytes(4, "little") else 0
            places = [(base + o + 8, n) for o, n in zip(rows[:, 2].tolist(), rows[:, 3].tolist(), strict=True)]
        for body, stop in lists[1 if len(rows) else 0 :]:
            places += scan(body + 4, stop)
    if any(at + n > len(data) for at, n in places):
        raise ValueError("the file ends inside its frames")
    frames: list[bytes] = []
    early = 0  # frames without bytes before the first one that has some
    for at, n in places:
        if n:
            frames.append(data[at : at + n])
            frames += frames[:1] * early
            early = 0
        elif frames:
            frames.append(frames[-1])
        else:
            early += 1
    if early:
        raise ValueError("no frame has bytes")
    return Video(rate / scale, frames)


@dataclass
class _Header:
    width: int
    height: int
    parts: list  # (id, across, down, quantizer, dc table, ac table) of each component, in scan order
    quant: dict
    tables: dict
    restart: int
    scan: int  # where the coded data begin


_headers: dict[bytes, _Header] = {}


def _runs(text: str) -> bytes:
    """Bytes in hexadecimal, a-b for all from a to b."""
    return bytes(x for part in text.split() for x in range(int(part[:2], 16), int(part[-2:], 16) + 1))


#: The Huffman tables of the JPEG standard (counts of the lengths 1 to 16, symbols), which motion JPEG may leave out.
STANDARD_TABLES = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00-0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00-0b"),
    0x10: (
        "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
        "01-03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09-0a 16-1a 25-2a 34-3a 43-4a 53-5a 63-6a 73-7a 83-8a 92-9a a2-aa b2-ba c2-ca d2-da e1-ea f1-fa",
    ),
    0x11: (
        "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
        "00-03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17-1a 26-2a 35-3a 43-4a 53-5a 63-6a 73-7a 82-8a 92-9a a2-aa b2-ba c2-ca d2-da e2-ea f2-fa",
    ),
}


def _lookup(lengths: list[int], symbols: bytes) -> np.ndarray:
    """For each 16 bits that may follow: symbol * 32 + length of the code, 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    code = at = 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[code << (16 - n) : (code + 1) << (16 - n)] = symbols[at] * 32 + n
            code += 1
            at += 1
        code <<= 1
    return out


def parse_header(jpeg: bytes) -> _Header:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quant, tables, restart, width, height, shape = 2, {}, {}, 0, 0, 0, {}
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = list(body[1:17])
                tables[body[0]] = _lookup(n, body[17 : 17 + sum(n)])
                body = body[17 + sum(n) :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            shape = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline JPEG is decoded")
        elif marker == 0xDA:
            tables = tables or {k: _lookup(list(_runs(n)), _runs(symbols)) for k, (n, symbols) in STANDARD_TABLES.items()}
            parts = [(body[1 + 2 * i], *shape[body[1 + 2 * i]], tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])]
            return _Header(width, height, parts, quant, tables, restart, at + 2 + size)
        at += 2 + size
    raise ValueError("no scan")


def _intervals(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The frames' coded bytes without stuffing and markers; where each restart interval begins and ends; intervals of each frame."""
    border = np.cumsum([len(p) + 1 for p in pieces]) - 1  # a zero byte after each frame
    zero = np.zeros(1, np.uint8)
    data = np.concatenate([x for p in pieces for x in (p, zero)])
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[marks] = keep[marks + 1] = False
    keep[ff[after == 0] + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    ends = np.sort(np.concatenate([marks, border]))
    is_mark = data[ends] == 0xFF
    begin = np.concatenate([[0], np.where(is_mark, ends + 2, ends + 1)[:-1]])
    return data[keep], place[begin], place[ends], np.diff(np.searchsorted(ends, border, "right"), prepend=0)


def decode_frames(frames: list[bytes]) -> list[list[np.ndarray]]:
    """For each frame its components, each an array (blocks, 64) of dequantized coefficients in zigzag order, or
    (blocks, 1) if all blocks are flat.

    Blocks are in the order of the scan. Frames with equal headers are decoded together, each of their restart intervals
    in a lane of its own: a step decodes one symbol of every lane.
    """
    out: list = [None] * len(frames)
    groups: dict[bytes, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault(_head_of(f), []).append(i)
    for head, members in groups.items():
        for lo in range(0, len(members), 512):
            part = members[lo : lo + 512]
            for i, blocks in zip(part, _decode(_header(head), [frames[i] for i in part]), strict=True):
                out[i] = blocks
    return out


def _head_of(frame: bytes) -> bytes:
    at = frame.find(b"\xff\xda")
    return frame[: at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")] if at >= 0 else frame


def _header(head: bytes) -> _Header:
    """The parsed header, of the last 64 different ones without parsing it again."""
    if head not in _headers:
        if len(_headers) > 64:
            _headers.clear()
        _headers[head] = parse_header(head)
    return _headers[head]


def _decode(h: _Header, frames: list[bytes]) -> list[list[np.ndarray]]:
    single = len(h.parts) == 1
    across, down = max(p[1] for p in h.parts), max(p[2] for p in h.parts)
    if single:
        units = -(-h.width // 8) * -(-h.height // 8)
        layout = [0]
    else:
        units = -(-h.width // (8 * across)) * -(-h.height // (8 * down))
        layout = [i for i, p in enumerate(h.parts) for _ in range(p[1] * p[2])]
    per = h.restart or units
    lanes = -(-units // per)
    pieces = []
    for f in frames:
        end = f.rfind(b"\xff\xd9")
        pieces.append(np.frombuffer(f, np.uint8)[h.scan : end if end >= h.scan else len(f)])
    data, begin, ends, found = _intervals(pieces)
    if (found != lanes).any():
        raise ValueError("restart markers are missing")
    data = np.concatenate([data, np.full(8, 255, np.uint8)])
    words = data[:-4].astype(np.uint32) << 24 | data[1:-3].astype(np.uint32) << 16 | data[2:-2].astype(np.uint32) << 8 | data[3:-1]
    bit, limit = begin * 8, ends * 8
    n = len(bit)
    left = np.tile(np.minimum(per, units - np.arange(lanes) * per), len(frames))
    flat = [np.zeros((n, per * layout.count(c)), np.int32) for c in range(len(h.parts))]
    full: list = [None] * len(h.parts)  # only of components that have more than means
    if len(frames) > 1 and n * per * len(layout) > 1 << 20:
        half = len(frames) // 2
        return _decode(h, frames[:half]) + _decode(h, frames[half:])
    last = np.zeros((len(h.parts), n), np.int64)

    def take(lane: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The next `size` (0 to 16) bits of the lanes, as a signed value of that class."""
        v = _peek(words, bit[lane]) >> (16 - size)
        bit[lane] += size
        return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)

    seen = [0] * len(h.parts)
    for unit in range(per):
        active = np.flatnonzero(left > unit)
        for c in layout:
            _, _, _, q, dc, ac = h.parts[c]
            k = seen[c]
            seen[c] += 1
            symbol = dc[_peek(words, bit[active])]
            bit[active] += symbol & 31
            last[c, active] += take(active, symbol >> 5)
            quant = h.quant[q]
            flat[c][active, k] = last[c, active] * quant[0]
            lane, at = active, np.ones(len(active), np.int64)
            while len(lane):
                symbol = ac[_peek(words, bit[lane])]
                bit[lane] += symbol & 31
                run, size = symbol >> 9, (symbol >> 5) & 15
                on = (size > 0) | (run == 15)
                lane, at, run, size = lane[on], at[on] + run[on], run[on], size[on]
                if (at > 63).any():
                    raise ValueError("too many coefficients")
                value = take(lane, size)
                if len(lane):
                    if full[c] is None:
                        full[c] = np.zeros((*flat[c].shape, 64), np.int32)
                    full[c][lane, k, at] = value * quant[at]
                at = at + 1
                more = at < 64
                lane, at = lane[more], at[more]
    if (bit > limit).any():
        raise ValueError("an interval is too short")
    out = []
    for c, means in enumerate(flat):
        if full[c] is None:
            blocks = means[:, :, None]
        else:
            blocks = full[c]
            blocks[:, :, 0] = means
        out.append(blocks.reshape(len(frames), lanes * means.shape[1], -1)[:, : units * layout.count(c)])
    return [list(x) for x in zip(*out, strict=True)]


def _peek(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 16 bits at each bit position."""
    at = np.minimum(bit >> 3, len(words) - 1)
    return ((words[at] >> (16 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)).astype(np.int64)


_cosines: list[np.ndarray] = []


def luma_samples(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 64) pixels of the first component. Flat blocks need no transform."""
    if not _cosines:
        x = np.arange(8)
        basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
        full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)  # natural order of coefficients, then pixels
        _cosines.append(full[ZIGZAG].astype(np.float64))
    if blocks.shape[1] == 1 or not blocks[:, 1:].any():
        flat = np.floor(blocks[:, :1] / 8 + 128.5)
        return np.clip(flat, 0, 255).astype(np.uint8) * np.ones((1, 64), np.uint8)
    return np.clip(np.floor(blocks @ _cosines[0] + 128.5), 0, 255).astype(np.uint8)


def histograms(frames: list[np.ndarray], bins: int = 16) -> np.ndarray:
    """Shares of the pixels of each frame by brightness. Each argument is a frame's first component."""
    out = np.zeros((len(frames), bins))
    flat = [i for i, b in enumerate(frames) if b.shape[1] == 1]
    if flat:
        n = len(frames[flat[0]])
        same = [i for i in flat if len(frames[i]) == n]
        value = np.clip(np.floor(np.stack([frames[i][:, 0] for i in same]) / 8 + 128.5), 0, 255).astype(np.int64)
        place = value * bins // 256 + np.arange(len(same))[:, None] * bins
        out[same] = np.bincount(place.ravel(), minlength=len(same) * bins).reshape(-1, bins) / n
        flat = same
    for i in set(range(len(frames))) - set(flat):
        pixels = luma_samples(frames[i]).astype(np.int64)
        out[i] = np.bincount((pixels * bins // 256).ravel(), minlength=bins) / pixels.size
    return out


def shots(hist: np.ndarray, reach: int = 8, factor: float = 2.0, least: float = 0.12) -> list[tuple[int, int]]:
    """(first frame, end) of each shot: a cut is where half the sum of differences between two histograms is at least
    `least` and over the mean of the `reach` differences at either side by `factor` times their standard deviation."""
    n = len(hist)
    if n < 2:
        return [(0, n)] if n else []
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff**2)])
    i = np.arange(len(diff))
    lo, hi = np.maximum(0, i - reach), np.minimum(len(diff), i + reach + 1)
    count = np.maximum(1, hi - lo - 1)
    mean = (sums[hi] - sums[lo] - diff) / count
    var = np.maximum(0, (squares[hi] - squares[lo] - diff**2) / count - mean**2)
    cuts = (np.flatnonzero((diff >= least) & (diff > mean + factor * np.sqrt(var) + 1e-9)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def video_histograms(frames: list[bytes], blocks: int = 1 << 17) -> np.ndarray:
    """Histograms of all frames, decoded in windows of about `blocks` 8 x 8 blocks (one frame at least), so memory does not
    grow with the length of a video."""
    out = []
    lo = 0
    while lo < len(frames):
        h = _header(_head_of(frames[lo]))
        each = max(1, (-(-h.width // 8) + 4) * (-(-h.height // 8) + 4) * len(h.parts))
        hi = lo + max(1, blocks // each)
        out.append(histograms([c[0] for c in decode_frames(frames[lo:hi])]))
        lo = hi
    return np.concatenate(out) if out else np.zeros((0, 16))


def timed_clips(hist: np.ndarray, rate: float, reach: int = 8, factor: float = 2.0, least: float = 0.12) -> list[tuple]:
    """(clip, first frame, end frame, start and end in seconds, mean brightness) of each shot."""
    middle = (np.arange(hist.shape[1]) + 0.5) * 256 / hist.shape[1]
    return [(k, a, z, a / rate, z / rate, float((hist[a:z] @ middle).mean())) for k, (a, z) in enumerate(shots(hist, reach, factor, least))]


CLIP = "clip int, first_frame int, end_frame int, start_s double, end_s double, brightness double"


def payload_of(text: bytes) -> bytes:
    """The text's bytes and blanks up to a positive multiple of FRAME."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, b" ")


def read_back(blocks: list[np.ndarray]) -> bytes:
    """The samples that write_avi stored in the frames with these blocks."""
    return np.clip(np.concatenate([b[:, 0] for b in blocks]) // 8 + 128, 0, 255).astype(np.uint8).tobytes()


def clips(df: DataFrame, media: str = "media", *, keep: list[str] | None = None, reach: int = 8, factor: float = 2.0, least: float = 0.12) -> DataFrame:
    """One row for each shot of each AVI file in the binary column: clip, first_frame, end_frame, start_s, end_s, brightness.

    Files are read by their index, frames decoded, shots cut by adaptive histogram differences. A null, an empty video or
    a file that is no motion JPEG AVI gives one row with null values and `error` (null for a null or an empty video). A
    long video is decoded window by window; what is held of all its frames is one histogram each. Other columns are repeated for each clip, but for those named as results; repeated rows give repeated clips.
    """
    results = T.StructType.fromDDL(CLIP + ", error string")
    names = {f.name for f in results}
    kept = [f for f in df.schema if f.name.lower() not in names and f.name != media and (keep is None or f.name in keep)]
    body = free_name(df, "__media")
    source = df.select(F.col(f"`{media}`").alias(body), *[F.col(f"`{f.name}`") for f in kept])
    types = [pa.int32()] * 3 + [pa.float64()] * 3 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in slices(batches, body, 16 << 20):
            rows, origin = [], []
            for i, data in enumerate(files):
                found = []
                error = None
                if data:
                    try:
                        video = read_avi(data)
                        found = [(*c, None) for c in timed_clips(video_histograms(video.frames), video.rate, reach, factor, least)]
                    except (ValueError, KeyError, IndexError, struct.error) as e:
                        error = str(e)
                found = found or [(None,) * 6 + (error,)]
                rows += found
                origin += [i] * len(found)
            old = batch.take(pa.array(origin))
            yield pa.RecordBatch.from_arrays([*old.columns[1:], *map(pa.array, zip(*rows, strict=True), types)], [f.name for f in kept] + results.names)

    return source.mapInArrow(tidy(run), T.StructType([*kept, *results]))


def store_texts(df: DataFrame, text: str = "text", *, media_column: str | None = "media", keep: list[str] | None = None) -> DataFrame:
    """Store each text losslessly as an AVI file, read the stored bytes back and describe what they hold.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the payload as read back; the last 16 bytes), media_bytes,
    media_sha256, feature (`<frames>:<ends of the shots, comma-joined>`), clips (an array of the timed clips) and, in
    `media_column`, the file. A null text counts as empty: one frame of blanks. Equal texts get equal values. Other columns are kept, equal names replaced.
    """
    results = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    results += f", clips array<struct<{CLIP}>>"
    results += f", `{media_column}` binary" if media_column else ""

    names = [x.split()[0] for x in CLIP.split(", ")]

    def compute(texts: list[bytes]) -> list[list]:
        rows = []
        files = [write_avi(payload_of(t)) for t in texts]
        videos = [read_avi(f) for f in files]
        blocks = [c[0] for c in decode_frames([f for v in videos for f in v.frames])]
        hist = histograms(blocks)
        at = 0
        for t, media, video in zip(texts, files, videos, strict=True):
            to = at + len(video.frames)
            back = read_back(blocks[at:to])
            found = timed_clips(hist[at:to], video.rate)
            ends = ",".join(str(c[2]) for c in found)
            row = [len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{to - at}:{ends}", [dict(zip(names, c, strict=True)) for c in found]]
            rows.append([*row, media] if media_column else row)
            at = to
        return [list(c) for c in zip(*rows, strict=True)]

    return with_results(df, text, results, compute, keep)


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of the documents' media: each file is stored, then read by its index, decoded and cut."""
    return clips(store_texts(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "media"))


def op2_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"), media_column=None, keep=["doc_id"])
