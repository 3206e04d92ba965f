import hashlib
import struct
import zlib

import numpy as np

from concordia.llm import media
from tests.llm.corpus import EDGES, SMALL, edge_documents, small


def walk(f):
    """Coefficients by a plain bit-by-bit reader."""
    words = {k: {} for k in f.tables}
    for k, (counts, symbols) in f.tables.items():
        code = at = 0
        for n, c in enumerate(counts, 1):
            for s in symbols[at : at + c]:
                words[k][n, code] = s
                code += 1
            at += c
            code <<= 1
    out = []
    ends = [*f.starts[1:], len(f.scan)]
    total = f.across * f.down
    step = f.restart or total
    for i, (a, b) in enumerate(zip(f.starts, ends)):
        bits = "".join(f"{x:08b}" for x in f.scan[a:b])
        p, before = 0, {}

        def symbol(k):
            nonlocal p
            n = 1
            while (n, int(bits[p : p + n], 2)) not in words[k]:
                n += 1
            s = words[k][n, int(bits[p : p + n], 2)]
            p += n
            return s

        def number(n):
            nonlocal p
            if not n:
                return 0
            v = int(bits[p : p + n], 2)
            p += n
            return v if v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(step, total - i * step)):
            for c in f.pattern:
                block = [0] * 64
                before[c] = before.get(c, 0) + number(symbol(f.uses[c][0]))
                block[0], k = before[c], 1
                while k < 64:
                    s = symbol(16 + f.uses[c][1])
                    if s == 0:
                        break
                    k += s >> 4
                    v = number(s & 15)
                    if s & 15:
                        block[k] = v
                    k += 1
                out.append(block)
    return np.array(out)


def encode(blocks, restart, pattern):
    """A baseline scan with runs, long runs and ends of blocks, by a plain writer."""
    dc, ac = ((0,) * 3 + (12,) + (0,) * 12, tuple(range(12))), ((0,) * 7 + (0xA2,) + (0,) * 8, (*(r << 4 | s for r in range(16) for s in range(1, 11)), 0x00, 0xF0))
    out, bits, before = bytearray(), "", {}
    (dcode, dlen), (acode, alen) = media.huffman(dc), media.huffman(ac)

    def put(v, n):
        return f"{v:0{n}b}" if n else ""

    def value(v):
        n = int(abs(v)).bit_length()
        return n, put(v if v > 0 else v + (1 << n) - 1, n)

    mcus = len(blocks) // len(pattern)
    for m in range(mcus):
        if restart and m and m % restart == 0:
            bits += "1" * (-len(bits) % 8)
            out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, before = "", {}
        for j, c in enumerate(pattern):
            b = blocks[m * len(pattern) + j].tolist()
            n, v = value(b[0] - before.get(c, 0))
            before[c] = b[0]
            bits += put(int(dcode[n]), int(dlen[n])) + v
            run = 0
            for k in range(1, 64):
                if not b[k]:
                    run += 1
                    continue
                while run > 15:
                    bits += put(int(acode[0xF0]), int(alen[0xF0]))
                    run -= 16
                n, v = value(b[k])
                bits += put(int(acode[run << 4 | n]), int(alen[run << 4 | n])) + v
                run = 0
            if run:
                bits += put(int(acode[0]), int(alen[0]))
    bits += "1" * (-len(bits) % 8)
    out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + media._dht(0, dc) + media._dht(0x10, ac)
    if len(pattern) > 1:  # first component twice as fine both ways
        head += media._segment(0xC0, struct.pack(">BHHB", 8, 16, 16 * mcus, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        sos = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    else:
        head += media._segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * mcus, 1) + bytes([1, 0x11, 0]))
        sos = bytes([1, 1, 0, 0, 63, 0])
    return head + media._segment(0xDD, struct.pack(">H", restart)) + media._segment(0xDA, sos) + bytes(out) + b"\xff\xd9"


def test_foreign_baseline_files():
    rng = np.random.default_rng(3)
    for pattern in ((0,), (0, 0, 0, 0, 1, 2)):
        files, want = [], []
        for restart in (0, 1, 3):
            blocks = rng.integers(-300, 300, (10 * len(pattern), 64)) * (rng.random((10 * len(pattern), 64)) < rng.choice([0.02, 0.5], (10 * len(pattern), 1)))
            blocks[:, 0] = rng.integers(-900, 900, len(blocks))
            files.append(media.Jpeg(encode(blocks, restart, pattern)))
            want.append(blocks)
        for f, got, w in zip(files, media.decode(files), want):
            assert (got.reshape(-1, 64) == w).all() and (walk(f) == w).all()
            side = 2 if len(pattern) > 1 else 1
            assert media.thumbnail(f, got).shape == (side, 10 * side)
            assert media.thumbnail(f, got)[0, 0] == min(255, max(0, 128 + (w[0, 0] >> 3)))


def test_own_files_by_the_plain_reader():
    for t in ["", "a", "é ü" * 100, "\x7f\x80\xff" * 70]:
        f = media.Jpeg(media.write_jpegs([t])[0])
        flat = walk(f).ravel()
        assert bytes(np.where(flat < 0, flat + 128, flat + 127).astype(np.uint8))[: len(media.payload(t))] == media.payload(t)


def check(rows, texts):
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_edges_and_small_table(spark):
    docs = edge_documents(spark).where("doc_id IS NOT NULL")
    rows = media.media_features(media.with_media(docs)).collect()
    assert len(rows) == docs.count()
    check(rows, dict(enumerate(EDGES)))
    assert len({r.media_sha256 for r in rows if r.doc_id in (5, 6)}) == 1
    check(media.op3_media(spark, SMALL).collect(), {r.doc_id: r.text for r in small(spark).collect()})
    assert media.media_features(media.with_media(docs.limit(0))).collect() == []


def test_runs_change_nothing(spark, monkeypatch):
    texts = ["é" * 3000 + "\xff", "", "a" * 10_000, "".join(chr(i % 250 + 1) for i in range(5000))]
    whole = media.write_jpegs(texts)
    want = media.read_features(whole)
    for run in (1, 3, 8):
        monkeypatch.setattr(media, "RUN", run)
        assert media.write_jpegs(texts) == whole and media.read_features(whole) == want


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (3, None), (3, "y" * 200_000)], "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS feature", "3 AS n_bytes")
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes) for r in media.media_features(media.with_media(df)).collect()), key=str)
    assert got == sorted([(None, 1, 192), (None, 1, 192), (3, 0, 192), (3, 200_000, 200_064)], key=str)
    assert media.media_features(media.with_media(df.limit(0))).count() == 0
