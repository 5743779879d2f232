import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import progressive_jpeg as J


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    assert J.payload_of(J.coefficients(J.store(data))) == data


class Writer:
    """A plain encoder of sparse coefficients, for the symbol-by-symbol paths."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n - 1, -1, -1)]

    def done(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(np.packbits(b)).replace(b"\xff", b"\xff\x00")


SYMBOLS = bytes([*range(0, 255)])  # 8-bit codes would need all ones: 255 codes of 8 bits


def _mag(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


def _sparse(blocks, across, comps=1, restart=0):
    """A gray progressive file: DC, AC 1-63 at Al=1, DC refined, AC refined."""
    h, w = len(blocks) // across * 8, across * 8
    head = [b"\xff\xd8", J._segment(0xDB, bytes([0]) + bytes([2]) * 64), J._segment(0xC2, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))]
    table = bytes([0] * 7 + [255] + [0] * 8) + SYMBOLS
    head += [J._segment(0xC4, bytes([0]) + table + bytes([0x10]) + table)]
    if restart:
        head.append(J._segment(0xDD, restart.to_bytes(2, "big")))
    scan = lambda lo, hi, high, low: J._segment(0xDA, bytes([1, 1, 0, lo, hi, high << 4 | low]))

    def parts(write):
        step = restart or len(blocks)
        out = []
        for k, at in enumerate(range(0, len(blocks), step)):
            out.append((bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + write(blocks[at:at + step]))
        return b"".join(out)

    def dc(part):
        o, last = Writer(), 0
        for b in part:
            d, last = (b[0] >> 1) - last, b[0] >> 1
            n, m = _mag(d) if d else (0, 0)
            o.put(n, 8)
            o.put(m, n)
        return o.done()

    half = lambda v: (abs(v) >> 1) * (1 if v > 0 else -1)

    def ac(part):
        o, eob = Writer(), 0

        def flush():
            nonlocal eob
            if eob:
                r = eob.bit_length() - 1
                o.put(r << 4, 8)
                o.put(eob - (1 << r), r)
                eob = 0

        for b in part:
            run = 0
            for k in range(1, 64):
                v = half(b[k])
                if not v:
                    run += 1
                    continue
                flush()
                while run > 15:
                    o.put(0xF0, 8)
                    run -= 16
                n, m = _mag(v)
                o.put(run << 4 | n, 8)
                o.put(m, n)
                run = 0
            if run:
                eob += 1
        flush()
        return o.done()

    def refine_dc(part):
        o = Writer()
        for b in part:
            o.put(b[0] & 1, 1)
        return o.done()

    def refine_ac(part):
        o, eob, held = Writer(), 0, []

        def flush():
            nonlocal eob, held
            if eob:
                r = eob.bit_length() - 1
                o.put(r << 4, 8)
                o.put(eob - (1 << r), r)
                for x in held:
                    o.put(x, 1)
                eob, held = 0, []

        for b in part:
            last = max([k for k in range(1, 64) if abs(b[k]) == 1], default=0)
            run, fixes = 0, []
            for k in range(1, 64):
                v = abs(b[k])
                if v > 1:
                    fixes.append(v & 1)
                    continue
                if not v:
                    run += 1
                    if run > 15 and k <= last:
                        flush()
                        # 16 zeros before a later new coefficient
                        o.put(0xF0, 8)
                        for x in fixes:
                            o.put(x, 1)
                        run, fixes = 0, []
                    continue
                flush()
                o.put(run << 4 | 1, 8)
                o.put(1 if b[k] > 0 else 0, 1)
                for x in fixes:
                    o.put(x, 1)
                run, fixes = 0, []
            if run or fixes:
                eob += 1
                held += fixes
        flush()
        return o.done()

    return b"".join([*head, scan(0, 0, 0, 1), parts(dc), scan(1, 63, 0, 1), parts(ac), scan(0, 0, 1, 0), parts(refine_dc), scan(1, 63, 1, 0), parts(refine_ac), b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 5])
@pytest.mark.parametrize("density", [0.0, 0.03, 0.3])
def test_sparse_scans(density, restart):
    rng = np.random.default_rng(int(density * 100) + restart)
    blocks = np.zeros((24, 64), int)
    blocks[:, 0] = rng.integers(-300, 300, 24)
    mask = rng.random((24, 63)) < density
    blocks[:, 1:][mask] = rng.integers(-40, 41, mask.sum())
    blocks[rng.random(24) < 0.3, 1:] = 0
    image = J.coefficients(_sparse([list(map(int, b)) for b in blocks], 6, restart=restart))
    assert (image.comps[1].coefs.reshape(-1, 64) == blocks).all()


def test_pixels_of_flat_and_wave():
    block = [0] * 64
    block[0] = 128
    rgb = J.pixels(J.coefficients(_sparse([block] * 4, 2)))
    assert rgb.shape == (16, 16, 3) and (rgb == 128 + 2 * 128 // 8).all()
    block[1] = 50  # one horizontal wave
    x = np.arange(8)
    want = np.rint(128 + (256 / 8) + 100 / 8 * np.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16))
    assert abs(J.pixels(J.coefficients(_sparse([block], 1)))[0, :, 0].astype(int) - want).max() <= 1


def test_zigzag():
    assert J.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(J.ZIGZAG) == list(range(64))


def test_frames(spark):
    good = J.store(b"some text")
    rows = [(1, good), (2, None), (3, b""), (4, good[:len(good) // 2]), (5, b"\xff\xd8\xff\xc0\x00\x0b" + b"\x00" * 20), (6, good)]
    out = {r["id"]: r for r in J.decode(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert out[1]["rgb"] == out[6]["rgb"] and len(out[1]["rgb"]) == out[1]["height"] * out[1]["width"] * 3
    assert out[2]["media_error"] is None and all(out[k]["media_error"] for k in (3, 4, 5))
    assert J.decode(spark.createDataFrame([], "id int, media binary")).count() == 0


def test_query(spark):
    rows = J.op7_progressive(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        p = t.ljust(max(192, -(-len(t) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(t), len(p), hashlib.sha256(p).hexdigest())
