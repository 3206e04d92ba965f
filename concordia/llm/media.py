"""Operator 3: media columns.  Payloads stored losslessly in baseline JPEG files, read back without an image library.

Writing: the unit of the format that keeps every bit is the quantised coefficient.  A payload of 192 bytes is one MCU
of three 8 x 8 blocks (Y, Cb, Cr, none subsampled); byte b is the coefficient b - 128 below 128 and b - 127 from there
on, so none is zero.  Each MCU is a restart interval.  The quantisation tables hold ones; a comment segment holds the
payload's size and the text's.  The files are ordinary baseline JPEG.

Reading: markers are parsed, scans are Huffman-decoded, all restart intervals of a batch of files in step in numpy, and
the DC coefficients of the first component give a luminance thumbnail of one pixel a block.  The features are the
dimensions and two hashes of the thumbnail (means of an 8 x 8 grid against their median, and against the right
neighbour).

Null text is the empty text: its payload is 192 blanks.  Equal texts give equal files.  Rows are kept as they are, null
and repeated ids included; columns but the id and the text are not read, whatever their names; an empty table gives none.
A text of any length is written and read whole, by runs of RUN intervals; a worker takes about twelve bytes for each of
the longest text's.  A file has at most 65,535 pixels down, which hold 1.6 GB of text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from concordia.llm.common import table, whole_text

UNIT = 192
#: Codes of each length 1..16, and the symbols in the order of their codes.  DC: sizes of differences; AC: (run, size).
DC_TABLE = ((0, 1, 2, 2, 2, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0), (5, 7, 6, 4, 3, 8, 2, 1, 0, 9))
AC_TABLE = ((0, 2, 2, 1, 1, 1, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0), (0x05, 0x07, 0x04, 0x06, 0x08, 0x03, 0x02, 0x01, 0x00, 0xF0))
WIDE = 1024  # MCUs in a row at most
#: MCUs that are written, or restart intervals that are read, at once: what a text takes beside itself and its file.
RUN = 8192


def huffman(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = at = 0
    for size, count in enumerate(table[0], 1):
        for s in table[1][at : at + count]:
            codes[s], lengths[s] = code, size
            code += 1
        at += count
        code <<= 1
    return codes, lengths


def lookup(table: tuple) -> np.ndarray:
    """For each 16 bits that can lie ahead: length << 8 | symbol of the code they begin with, 0 if none."""
    out = np.zeros(1 << 16, np.int32)
    codes, lengths = huffman(table)
    for s in table[1]:
        n = int(lengths[s])
        out[int(codes[s]) << (16 - n) : (int(codes[s]) + 1) << (16 - n)] = n << 8 | s
    return out


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def shape(mcus: int) -> tuple[int, int]:
    """MCUs across and down."""
    across = min(mcus, WIDE)
    return across, -(-mcus // across)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _dht(kind: int, table: tuple) -> bytes:
    return _segment(0xC4, bytes([kind, *table[0], *table[1]]))


TABLES = _segment(0xDB, bytes([0] + [1] * 64)) + _dht(0x00, DC_TABLE) + _dht(0x10, AC_TABLE)
SCAN = _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
_CODES = tuple(huffman(t) for t in (DC_TABLE, AC_TABLE))


def _entropy(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes, stuffed, of MCUs of 192 payload bytes, and where each MCU's bytes end; by runs of MCUs."""
    runs = [_run(units[i : i + RUN]) for i in range(0, len(units), RUN)]
    before = np.cumsum([0, *(len(data) for data, _ in runs)])
    return np.concatenate([data for data, _ in runs]), np.concatenate([ends + b for (_, ends), b in zip(runs, before)])


def _run(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(units)
    value = units.astype(np.int16).reshape(n * 3, 64)
    value = np.where(value < 128, value - 128, value - 127)
    size = np.frexp(np.abs(value).astype(np.float32))[1].astype(np.int64)
    value = np.where(value < 0, value + (1 << size) - 1, value).astype(np.int64)
    code, length = np.empty_like(value), np.empty_like(value)
    for cols, (codes, lengths) in ((slice(0, 1), _CODES[0]), (slice(1, 64), _CODES[1])):
        s = size[:, cols]
        code[:, cols] = codes[s] << s | value[:, cols]
        length[:, cols] = lengths[s] + s
    code, length = code.reshape(n, UNIT), length.reshape(n, UNIT)
    fill = -length.sum(1) % 8
    code = np.concatenate([code, ((1 << fill) - 1)[:, None]], 1).astype(np.uint32).ravel()
    length = np.concatenate([length, fill[:, None]], 1)
    ends = np.cumsum(length.sum(1) // 8)
    length = length.ravel()
    widest = int(length.max())
    left = (code << (widest - length).astype(np.uint32)).astype(np.uint32)
    bits = np.empty((len(code), widest), np.uint8)
    for k in range(widest):
        bits[:, k] = (left >> np.uint32(widest - 1 - k)) & np.uint32(1)
    data = np.packbits(bits[np.arange(widest)[None, :] < length[:, None]])
    full = np.flatnonzero(data == 0xFF)
    return np.insert(data, full + 1, 0), ends + np.searchsorted(full, ends)


def write_jpegs(texts: list[str]) -> list[bytes]:
    """One file for each text."""
    payloads = [payload(t) for t in texts]
    counts = [len(p) // UNIT for p in payloads]
    blocks = []
    for p, n in zip(payloads, counts):
        across, down = shape(n)
        blocks.append(p + b" " * (UNIT * (across * down - n)))
    units = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, UNIT)
    out, data, ends = [], np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data, ends = _entropy(units)
    ends = np.concatenate([[0], ends])
    at = 0
    for t, p, n in zip(texts, payloads, counts):
        across, down = shape(n)
        own = across * down
        e = ends[at : at + own + 1]
        scan = data[e[0] : e[-1]]
        marks = np.empty(2 * (own - 1), np.uint8)
        marks[0::2] = 0xFF
        marks[1::2] = 0xD0 + np.arange(own - 1) % 8
        scan = np.insert(scan, np.repeat(e[1:-1] - e[0], 2), marks)
        at += own
        frame = struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
        note = struct.pack(">8sQQ", b"payload ", len(p), len(t.encode("utf-8", "surrogatepass")))
        out.append(b"\xff\xd8" + _segment(0xFE, note) + TABLES + _segment(0xC0, frame) + SCAN + scan.tobytes() + b"\xff\xd9")
    return out


class Jpeg:
    """Headers and scan of one baseline file with one interleaved or single-component scan."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.note, self.restart, self.tables = b"", 0, {}
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.note = body
            elif marker == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    n = sum(counts)
                    self.tables[body[0]] = (counts, tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only baseline files are read")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.uses = [(chosen[i] >> 4, chosen[i] & 15) for i, _, _ in self.parts]
                break
        raw = np.frombuffer(data, np.uint8, offset=at)
        nxt = np.append(raw[1:], 0)
        marks = np.flatnonzero((raw == 0xFF) & (nxt != 0))
        resets = marks[(nxt[marks] >= 0xD0) & (nxt[marks] <= 0xD7)]
        end = marks[(nxt[marks] < 0xD0) | (nxt[marks] > 0xD7)][0]
        resets = resets[resets < end]
        drop = np.concatenate([np.flatnonzero((raw[:end] == 0xFF) & (nxt[:end] == 0)) + 1, resets, resets + 1])
        keep = np.ones(end, bool)
        keep[drop] = False
        drop.sort()
        self.scan, self.starts = raw[:end][keep], np.concatenate([[0], resets - np.searchsorted(drop, resets)])
        top_h, top_v = max(h for _, h, _ in self.parts), max(v for _, _, v in self.parts)
        if len(self.parts) == 1:
            self.parts, top_h, top_v = [(self.parts[0][0], 1, 1)], 1, 1
        self.across, self.down = -(-self.width // (8 * top_h)), -(-self.height // (8 * top_v))
        #: Component of each block of an MCU.
        self.pattern = tuple(c for c, (_, h, v) in enumerate(self.parts) for _ in range(h * v))

    def layout(self) -> tuple:
        """Files of one layout can be decoded together."""
        return self.pattern, tuple(self.uses), tuple(sorted(self.tables.items()))


def decode(files: list[Jpeg]) -> list[np.ndarray]:
    """Quantised coefficients (MCU, block, 64 in zigzag order) of files of one layout; every restart interval of all
    files is a lane, and the lanes go forward together, one code each."""
    first = files[0]
    luts = [lookup(t) if (t := first.tables.get(k)) else None for k in range(32)]
    blocks = len(first.pattern)
    scans, starts, sizes, total, mcus = [], [], [], 0, 0
    for f in files:
        n = f.across * f.down
        step = f.restart or n
        own = [min(step, n - i) for i in range(0, n, step)]
        if len(own) != len(f.starts):
            raise ValueError("restart intervals are missing")
        scans += [f.scan, np.full(8, 0xFF, np.uint8)]
        starts.append(f.starts + total)
        total += len(f.scan) + 8
        sizes.append(np.array(own))
        mcus += n
    data, sizes, starts = np.concatenate(scans), np.concatenate(sizes), np.concatenate(starts).astype(np.int64)
    out = np.zeros((mcus * blocks, 64), np.int16)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for i in range(0, len(sizes), RUN):
        end = starts[i + RUN] + 8 if i + RUN < len(starts) else len(data)
        _lanes(first, luts, data[starts[i] : end], starts[i : i + RUN] - starts[i], sizes[i : i + RUN], base[i : i + RUN], out)
    ends = np.cumsum([f.across * f.down for f in files])
    return np.split(out.reshape(mcus, blocks, 64), ends[:-1])


def _lanes(first: Jpeg, luts: list, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: np.ndarray, out: np.ndarray) -> None:
    """Decodes a run of restart intervals, which start there in the data, to the rows of out that begin at base."""
    window = np.zeros(len(data) - 7, np.uint64)
    for k in range(5):
        window |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * (4 - k))
    window = window.astype(np.int64)
    bit, blocks = starts * 8, len(first.pattern)
    parts = max(first.pattern) + 1
    before = np.zeros((len(sizes), parts), np.int64)

    def take(lanes: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and value that follow in each lane."""
        p = bit[lanes]
        ahead = window[np.minimum(p >> 3, len(window) - 1)] << (p & 7)
        found = lut[(ahead >> 24) & 0xFFFF]
        if not found.all():
            raise ValueError("a code that no table has")
        length, symbol = found >> 8, found & 0xFF
        size = (symbol & 15).astype(np.int64)
        value = ((ahead << length) >> (40 - size)) & ((1 << size) - 1)
        value = np.where((value >> np.maximum(size - 1, 0) == 0) & (size > 0), value - (1 << size) + 1, value)
        bit[lanes] = p + length + size
        return symbol, value

    for m in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > m)
        for b, c in enumerate(first.pattern):
            dc, ac = luts[first.uses[c][0]], luts[16 + first.uses[c][1]]
            row = (base[live] + m) * blocks + b
            _, diff = take(live, dc)
            before[live, c] += diff
            out[row, 0] = before[live, c]
            lanes, rows, k = live, row, np.ones(len(live), np.int64)
            while len(lanes):
                symbol, value = take(lanes, ac)
                run, size = symbol >> 4, symbol & 15
                k = k + run
                put = size > 0
                if put.all():
                    out[rows, k] = value
                else:
                    out[rows[put], k[put]] = value[put]
                k = k + 1
                on = (k < 64) & (put | (run == 15))
                if not on.all():
                    lanes, rows, k = lanes[on], rows[on], k[on]


def thumbnail(f: Jpeg, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each block of the first component, from its DC alone."""
    _, h, v = f.parts[0]
    dc = coefficients[:, : h * v, 0].astype(np.int32).reshape(f.down, f.across, v, h)
    return np.clip(128 + (dc >> 3), 0, 255).transpose(0, 2, 1, 3).reshape(f.down * v, f.across * h)


def hashes(thumb: np.ndarray) -> tuple[int, int]:
    """Of the means of an 8 x 9 grid: each against the median, and each against its right neighbour."""
    rows, cols = (np.arange(8) * thumb.shape[0] // 8, np.arange(9) * thumb.shape[1] // 9)
    grid = np.stack([t[:, None] if t.ndim == 1 else t for t in (thumb[a : max(a + 1, b)].mean(0) for a, b in zip(rows, [*rows[1:], thumb.shape[0]]))]).reshape(8, -1)
    grid = np.stack([grid[:, a : max(a + 1, b)].mean(1) for a, b in zip(cols, [*cols[1:], thumb.shape[1]])], 1)
    number = lambda bits: int("".join("1" if x else "0" for x in bits.ravel()), 2)
    return number(grid[:, :8] > np.median(grid[:, :8])), number(grid[:, :8] > grid[:, 1:])


def read_features(media: list[bytes]) -> list[tuple]:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of files of write_jpegs."""
    files = [Jpeg(m) for m in media]
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        groups.setdefault(f.layout(), []).append(i)
    out: list = [None] * len(media)
    for own in groups.values():
        for i, c in zip(own, decode([files[i] for i in own])):
            f = files[i]
            _, size, n_bytes = struct.unpack(">8sQQ", f.note)
            flat = c.ravel()
            stored = (flat + np.where(flat < 0, np.int16(128), np.int16(127))).astype(np.uint8).tobytes()[:size]
            a, b = hashes(thumbnail(f, c))
            feature = f"{f.width}x{f.height}:{a:016x}:{b:016x}"
            out[i] = (n_bytes, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature)
    return out


def with_media(docs: DataFrame, text_col: str = "text", batch_chars: int = 1_000_000) -> DataFrame:
    """id and media, the JPEG file of each whole text."""
    import pyarrow as pa

    from concordia.llm.pretokens import slices

    rows = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs, text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in slices(texts, batch_chars):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), pa.array(write_jpegs(texts[a:z]), pa.binary())], ["doc_id", "media"])

    return rows.mapInArrow(write, f"doc_id {kind}, media binary")


def media_features(media: DataFrame, batch_bytes: int = 1_000_000) -> DataFrame:
    """The features of each row's media column, read from the stored bytes."""
    import pyarrow as pa

    from concordia.llm.pretokens import slices

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kind = media.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media").to_pylist()
            for a, z in slices(files, batch_bytes):
                cols = zip(*read_features(files[a:z]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", *names])

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, kinds))
    return media.select("doc_id", "media").mapInArrow(read, f"doc_id {kind}, {schema}")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(with_media(table(spark, sf_dir, "documents")))
