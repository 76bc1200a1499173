import hashlib
import struct
import zlib

import numpy as np
import pytest

from tallyframe.llm import avi as A


def huffman(lengths):
    return A._codes(lengths)


def encode_blocks(components, width, height, sampling, restart, quant):
    """A plain baseline encoder with long tables: a brute-force counterpart of the decoder. components: lists of quantized zigzag blocks in scan order by unit."""
    dc_len = {s: 4 for s in range(12)}
    ac_symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    ac_len = {s: 9 for s in ac_symbols}
    dc, ac = huffman(dc_len), huffman(ac_len)
    n = len(components)
    out = b"\xff\xd8" + A._segment(0xDB, bytes([0]) + bytes(quant))
    out += A._segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling)))
    out += A._segment(0xC4, A._table(0, dc_len) + A._table(0x10, ac_len)) + (A._segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    out += A._segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0]))
    per = [a * d if n > 1 else 1 for a, d in sampling]
    units = len(components[0]) // per[0]
    bits, last, mark = "", [0] * n, 0

    def put(v):
        size = abs(v).bit_length()
        return size, (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "")

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    for u in range(units):
        if restart and u and u % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + mark % 8])
            mark, last = mark + 1, [0] * n
        for c in range(n):
            for b in components[c][u * per[c] : (u + 1) * per[c]]:
                size, extra = put(int(b[0]) - last[c])
                last[c] = int(b[0])
                code, k = dc[size]
                bits += format(code, f"0{k}b") + extra
                run = 0
                for v in b[1:]:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        bits += format(ac[0xF0][0], f"0{ac[0xF0][1]}b")
                        run -= 16
                    size, extra = put(int(v))
                    code, k = ac[run << 4 | size]
                    bits += format(code, f"0{k}b") + extra
                    run = 0
                if run:
                    bits += format(ac[0][0], f"0{ac[0][1]}b")
    flush()
    return out + b"\xff\xd9"


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_decoder_equals_encoder(sampling, restart):
    rng = np.random.default_rng(3)
    quant = rng.integers(1, 20, 64).tolist()
    units = 6  # 3 x 2
    width = 3 * 8 * max(a for a, _ in sampling)
    height = 2 * 8 * max(d for _, d in sampling)
    per = [a * d if len(sampling) > 1 else 1 for a, d in sampling]
    frames, want = [], []
    for _ in range(3):
        comps = []
        for p in per:
            b = np.where(rng.random((units * p, 64)) < 0.2, rng.integers(-400, 400, (units * p, 64)), 0)
            b[:, 0] = rng.integers(-900, 900, units * p)
            comps.append(b)
        frames.append(encode_blocks(comps, width, height, sampling, restart, quant))
        want.append(comps)
    for got, comps in zip(A.decode_frames(frames), want, strict=True):
        for g, c in zip(got, comps, strict=True):
            assert (g == c * np.array(quant)).all()


def test_transform_equals_formula():
    rng = np.random.default_rng(5)
    b = np.zeros((4, 64))
    b[:, :10] = rng.integers(-60, 60, (4, 10))
    c = lambda k: np.sqrt(0.5) if k == 0 else 1
    for i in range(4):
        natural = np.zeros(64)
        natural[A.ZIGZAG] = b[i]
        f = natural.reshape(8, 8)
        want = [[sum(c(u) * c(v) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
        want = np.clip(np.floor(np.array(want) + 128.5), 0, 255)
        assert np.abs(A.luma_samples(b[i : i + 1])[0].reshape(8, 8) - want).max() <= 1


def test_round_trip_and_contract(spark, edge, empty):
    for r in A.store_texts(edge.withColumnRenamed("spans", "feature")).collect():
        data = (r.text or "").encode()
        payload = data + b" " * (192 * max(1, -(-len(data) // 192)) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert A.read_back([c[0] for c in A.decode_frames(A.read_avi(bytes(r.media)).frames)]) == payload
    assert A.store_texts(empty).count() == 0
    assert A.read_back([c[0] for c in A.decode_frames(A.read_avi(A.write_avi(bytes(range(192)) + bytes(range(64, 256)))).frames)]) == bytes(range(192)) + bytes(range(64, 256))


def test_clips(spark):
    rng = np.random.default_rng(1)
    scenes = [np.clip(rng.normal(m, 6, (n, 192)), 0, 255).astype(np.uint8) for m, n in ((40, 12), (200, 9), (110, 15))]
    film = A.write_avi(np.concatenate(scenes).tobytes())
    no_index = film[: film.rindex(b"idx1")]
    assert A.read_avi(no_index).frames == A.read_avi(film).frames
    rows = [("film", film), ("film", film), ("null", None), ("bad", b"RIFFxxxxWAVE"), ("cut", film[:400]), ("empty", b"")]
    out = A.clips(spark.createDataFrame(rows, "name string, media binary").repartition(2)).collect()
    assert sorted((r.first_frame, r.end_frame, r.start_s, r.end_s) for r in out if r.name == "film") == sorted([(0, 12, 0.0, 1.2), (12, 21, 1.2, 2.1), (21, 36, 2.1, 3.6)] * 2)
    assert {r.name: r.error for r in out if r.clip is None and r.name in ("null", "bad", "empty")} == {"null": None, "bad": "no AVI file", "empty": None}
    assert len([r for r in out if r.name == "cut"]) == 1
    assert A.shots(np.ones((1, 4))) == [(0, 1)] and A.shots(np.zeros((0, 4))) == []


def test_query(spark):
    from .conftest import SF

    rows = A.op2_avi_media(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r.payload_sha256 == hashlib.sha256(A.payload_of(texts[r.doc_id])).hexdigest()


def _chunk(name, data):
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _film(movis, indx=False, idx1=False):
    """An AVI file with one RIFF chunk for each list of frames, the frames of each in two `rec ` lists."""
    stream = _chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, 10, 0, 0, 0, 0, 0, 0, 0, 0, 0))
    hdrl = lambda entries: _chunk(b"LIST", b"hdrl" + _chunk(b"LIST", b"strl" + stream + (_chunk(b"indx", struct.pack("<HBBI4s3I", 4, 0, 0, len(entries), b"00dc", 0, 0, 0) + b"".join(struct.pack("<QII", *e) for e in entries)) if indx else b"")))
    head = len(hdrl([(0, 0, 0)] * len(movis)))
    out, entries = b"", []
    for i, frames in enumerate(movis):
        start = len(out) + 12 + (0 if i else head) + 12
        body, at = b"", []
        for half in (frames[: len(frames) // 2], frames[len(frames) // 2 :]):
            rec = b"rec "
            for f in half:
                at.append((len(body) + 8 + len(rec) + 8, len(f)))
                rec += _chunk(b"00dc", f)
            body += _chunk(b"LIST", rec)
        if indx:
            ix = _chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(at), b"00dc", start, 0) + b"".join(struct.pack("<II", o, n | 1 << 31) for o, n in at))
            entries.append((start + len(body), len(ix), len(at)))
            body += ix
        rows = b"".join(b"00dc" + struct.pack("<III", 16, o - 8 + 4, n) for o, n in at)
        movi = _chunk(b"LIST", b"movi" + body) + (_chunk(b"idx1", rows) if idx1 and not i else b"")
        out += _chunk(b"RIFF", b"AVIX" + movi) if i else _chunk(b"RIFF", b"AVI " + b"\0" * head + movi)
    return out[:12] + hdrl(entries or [(0, 0, 0)] * len(movis)) + out[12 + head :]


@pytest.mark.parametrize("indexes", [{}, {"indx": True}, {"idx1": True}, {"indx": True, "idx1": True}])
def test_all_frames_of_all_chunks(indexes):
    a, b, c, d = (A.read_avi(A.write_avi(bytes([v]) * A.FRAME)).frames[0] for v in (10, 60, 130, 200))
    film = _film([[b"", a, b, b""], [c], [b"", d]], **indexes)
    assert A.read_avi(film).frames == [a, a, b, b, c, c, d]
    with pytest.raises(ValueError):
        A.read_avi(film[:-300])
    with pytest.raises(ValueError):
        A.read_avi(_film([[b"", b""]], **indexes))


def test_standard_tables():
    counts = {k: (A._runs(n), A._runs(s)) for k, (n, s) in A.STANDARD_TABLES.items()}
    assert all(sum(n) == len(s) == len(set(s)) and sum(c << (16 - i) for i, c in enumerate(n, 1)) < 1 << 16 for n, s in counts.values())
    # One block: a difference of 3 (class 2, code 011) and the end of the block (1010), filled up with ones.
    jpeg = b"\xff\xd8" + A._segment(0xDB, bytes([0]) + bytes([8] * 64)) + A._segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + bytes([1, 0x11, 0])) + A._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = ("011" + "11" + "1010").ljust(16, "1")
    assert A.decode_frames([jpeg + int(bits, 2).to_bytes(2, "big") + b"\xff\xd9"])[0][0].tolist() == [[24]]


def test_windows_do_not_matter():
    rng = np.random.default_rng(2)
    frames = A.read_avi(A.write_avi(rng.integers(0, 256, 192 * 37).astype(np.uint8).tobytes())).frames
    whole = A.histograms([c[0] for c in A.decode_frames(frames)])
    assert all((A.video_histograms(frames, blocks) == whole).all() for blocks in (1, 1500, 1 << 17))
    assert A.video_histograms([]).shape == (0, 16)


def test_timed_clips_of_the_documents(spark):
    from .conftest import SF

    rows = A.media_clips(spark, SF).collect()
    nested = {r.doc_id: r.clips for r in A.op2_avi_media(spark, SF).collect()}
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.clip)):
        assert r.error is None and r.start_s == r.first_frame / A.RATE and r.end_s == r.end_frame / A.RATE
        found.setdefault(r.doc_id, []).append(tuple(r)[1:7])
    assert found == {i: [tuple(c) for c in cs] for i, cs in nested.items()}
    for cs in found.values():
        assert [c[0] for c in cs] == list(range(len(cs))) and cs[0][1] == 0 and all(a[2] == b[1] for a, b in zip(cs, cs[1:], strict=False))
