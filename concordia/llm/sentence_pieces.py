"""Operator 9: encoding and decoding with SentencePiece model files by a forward pass over shared prefixes.

Texts are cut at blanks into marked words.  The distinct words that a worker doesn't know are sorted, so that they form
the paths of a trie in depth-first order; the forward states of a prefix are kept while words share it, and each word
pays only for what is new in it.

For a unigram model the state of a prefix is the best sum of scores of its segmentations, and its last piece (Viterbi).
A model made of merges has no sum to maximise: its segmentation is what the merges leave.  The segmentation of a prefix
by merges is again a prefix's segmentation and one more piece, and that piece is the only one that the merges leave
apart from the last piece before it.  So the state is the last piece alone, and a piece that ends the prefix is
accepted if the merges keep the two apart.  Words with runs of blanks, whose merges can tie, are merged outright.

Characters without a piece become bytes where the model has them.  Null text is empty: no ids, decoded as empty text.
Rows are kept as they are, repeated ones and null ids included.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from concordia.llm.common import table, tokenizer_path, whole_text
from concordia.llm.pretokens import ChunkCache, slices

MARK = "▁"
UNIGRAM, BPE = 1, 2


class Pieces:
    """The pieces of a model file, and segmentation with them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.kind = proto.trainer_spec.model_type
        spec = proto.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only unigram and merge models that leave the text as it is are read")
        self.text: list[str] = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        #: What each id adds to a decoded text.
        self.raw = [p.piece.encode() for p in proto.pieces]
        for i in self.silent:
            self.raw[i] = b""
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        if any(p.type not in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in proto.pieces) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that cross words or are set by hand aren't read")
        self.longest = max(map(len, self.ids), default=1)
        #: By the last three characters of a prefix (fewer where no piece ends so), the lengths of pieces that can end it, longest first.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for p in self.ids:
            self.lengths[p[-3:]] = (*self.lengths.get(p[-3:], ()), len(p))
        for end, sizes in self.lengths.items():
            self.lengths[end] = tuple(sorted({*sizes, *(n for n in range(1, len(end)) if end[-n:] in self.ids)}, reverse=True))
        self.bad_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self._apart: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    # Merges.

    def merged(self, text: str) -> list[str]:
        """The pieces that merges leave: always the adjacent pair whose joint piece has the best score, the leftmost among equals."""
        parts: list = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def alone(self, piece: int) -> bool:
        """Whether the merges make this piece of its own text."""
        if (known := self._alone.get(piece)) is None:
            known = self._alone[piece] = self.merged(self.text[piece]) == [self.text[piece]]
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges of the joint text leave these two pieces; a piece below 0 is a character without one."""
        if a < 0 or b < 0:
            return (a < 0 or self.alone(a)) and (b < 0 or self.alone(b))
        if (known := self._apart.get((a, b))) is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            x, y = self.text[a], self.text[b]
            known = self._apart[a, b] = self.merged(x + y) == [x, y]
        return known

    # The forward pass.

    def segment(self, words: list[str]) -> list[array]:
        """Ids of each marked word."""
        out: list = [None] * len(words)
        scores, lasts, starts = [0.0], [-1], [0]  # of each prefix: score, last piece, where that starts
        path = ""
        merges = self.kind == BPE
        for n in sorted(range(len(words)), key=words.__getitem__):
            w = words[n]
            if merges and "▁▁" in w:
                out[n] = array("I", [i for p in self.merged(w) for i in self._plain(p)])
                continue
            shared = 0
            for x, y in zip(path, w):
                if x != y:
                    break
                shared += 1
            del scores[shared + 1 :], lasts[shared + 1 :], starts[shared + 1 :]
            path = w
            if merges:
                self._merge_steps(w, lasts, starts)
            else:
                self._score_steps(w, scores, lasts, starts)
            ids, at = [], len(w)
            while at:
                ids.append(lasts[at])
                at = starts[at]
            ids.reverse()
            out[n] = array("I", ids if min(ids, default=0) >= 0 else [x for p in ids for x in ([p] if p >= 0 else self._spelt(chr(-p)))])
        return out

    def _merge_steps(self, w: str, lasts: list[int], starts: list[int]) -> None:
        get, lengths, known, apart, alone = self.ids.get, self.lengths.get, self._apart, self.apart, self._alone.get
        for i in range(len(lasts), len(w) + 1):
            last, start = -ord(w[i - 1]), i - 1
            for n in lengths(w[i - 3 : i] if i > 2 else w[:i]) or lengths(w[max(0, i - 2) : i]) or lengths(w[start]) or ():
                if (j := i - n) >= 0 and (piece := get(w[j:i])) is not None:
                    if not j:
                        if (ok := alone(piece)) is None:
                            ok = self.alone(piece)
                    elif (ok := known.get((lasts[j], piece))) is None:
                        ok = apart(lasts[j], piece)
                    if ok:
                        last, start = piece, j
                        break
            lasts.append(last)
            starts.append(start)

    def _score_steps(self, w: str, scores: list[float], lasts: list[int], starts: list[int]) -> None:
        get = self.ids.get
        for i in range(len(lasts), len(w) + 1):
            best = None
            for j in range(max(0, i - self.longest), i):
                if (piece := get(w[j:i])) is not None and (best is None or scores[j] + self.scores[piece] > best[0]):
                    best = (scores[j] + self.scores[piece], piece, j)
            if get(w[i - 1]) is None and (best is None or scores[i - 1] + self.bad_score > best[0]):
                best = (scores[i - 1] + self.bad_score, -ord(w[i - 1]), i - 1)
            scores.append(best[0])
            lasts.append(best[1])
            starts.append(best[2])

    def _plain(self, piece: str) -> list[int]:
        return [i] if (i := self.ids.get(piece)) is not None else self._spelt(piece)

    def _spelt(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def decode(self, ids) -> str:
        """The text of ids: bytes joined, marks as blanks, without the blank that the encoding put first."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return (text[1:] if text[:1] == MARK else text).replace(MARK, " ")


_LOADED: dict[str, tuple[Pieces, ChunkCache]] = {}


def loaded(path: str) -> tuple[Pieces, ChunkCache]:
    """This worker's model, and its cache of chunks."""
    if path not in _LOADED:
        model = Pieces(path)
        _LOADED[path] = (model, ChunkCache(lambda s: [x.tobytes() for x in model.segment([x.replace(" ", MARK) for x in s])], limit=400_000))
    return _LOADED[path]


def encode_texts(path: str, texts: list[str]) -> Iterator[array]:
    """Ids of each whole text."""
    _, cache = loaded(path)
    marked = [" " + t.replace(MARK, " ") if t else "" for t in texts]  # a mark in a text is a blank to the model
    for a, b in slices(marked, 6_000_000):
        for parts in cache.batch(marked[a:b]):
            out = array("I")
            out.frombytes(b"".join(parts))
            yield out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text (null as empty) and piece_ids, an array of ids, of each row."""
    import pyarrow as pa

    rows = docs.select(docs["doc_id"], whole_text(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.slice(at, 2000)
                ids = [memoryview(x) for x in encode_texts(path, b.column("text").to_pylist())]
                ends = [0]
                for x in ids:
                    ends.append(ends[-1] + len(x))
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "text", "piece_ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, piece_ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The rows' digest: sizes, crc32 of the ids, of the decoded text, and whether it is the text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = loaded(path)
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                out = []
                for t, x in zip(b.column("text").to_pylist(), b.column("piece_ids")):
                    ids = x.values.to_numpy()
                    back = model.decode(ids.tolist())
                    raw = t.encode()
                    out.append((len(raw), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == t.replace(MARK, " ")))
                cols = list(zip(*out)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"]
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
