"""Worker caches over a BPE file of the tokenizers library, byte-level or with word ends.

The byte-level split always starts a new pre-token at a blank that follows a character which is no white space, and at a
single line feed between such characters.  The split into words drops white space.  A text cut there can therefore be
encoded chunk by chunk: the ids of the chunks, joined, are the ids of the text.  Chunks that a worker doesn't know go to
the library, many at once in one string; those met again stay in a bounded cache.  Neither changes a result: tests
compare whole texts with the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np

from concordia.llm.common import holds, release, single_threaded

#: Blanks that start a chunk: those after a character that isn't white space.
CUT = re.compile(r"(?<!\s) ")
#: White space before a blank; only texts that hold it need CUT, others are cut at each blank.
RUN = re.compile(r"\s ")
#: Texts with white space other than single blanks and line feeds between other characters.
ODD = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x{0b}-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Letters that fold by themselves and are letters to every version of the character database.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Ends of words that are a run of their own; a quote isn't among them, as it may open a run with what follows.
STOPS = ".,;:!?"


def chunks(text: str) -> list[str]:
    """The text cut before each blank that follows no white space; those blanks are left out."""
    return text.split(" ") if text[:1] != " " and RUN.search(text) is None else CUT.split(text)


class ChunkCache(dict):
    """Chunk, without the blank that leads it, to its encoding; encode maps a list of strings to their encodings.

    known: fixed first tier, looked up before anything is encoded.  A chunk enters the cache the second time that it
    is met, so that words met once don't fill it; limit bounds both the cache and what remembers a first meeting.
    """

    def __init__(self, encode: Callable[[list[str]], list], known: dict | None = None, limit: int = 500_000, longest: int = 48):
        super().__init__(known or {})
        self.encode, self.known, self.limit, self.longest = encode, known or {}, limit + len(known or {}), longest
        self.met: set[int] = set()
        self.once: dict = {}
        self.lookups = self.misses = 0

    def __missing__(self, chunk: str):
        return self.once[chunk]

    def _ready(self, found: set[str]) -> None:
        if len(self) > self.limit:
            self.clear()
            self.update(self.known)
        new = list(found.difference(self))
        self.once = dict(zip(new, self.encode([" " + c for c in new])))
        self.keep(self.once)

    def keep(self, once: dict) -> None:
        """Takes those of the encodings whose chunk was met before."""
        if len(self) > self.limit:
            self.clear()
            self.update(self.known)
        if len(self.met) > self.limit:
            self.met.clear()
        self.misses += len(once)
        met = self.met
        for c, v in once.items():
            if (h := hash(c)) not in met:
                met.add(h)
            elif len(c) <= self.longest:
                self[c] = v

    def batch(self, texts: list[str]) -> list[list]:
        """For each text the list of its chunks' encodings."""
        cut, heads, found = [], [], set()
        for t in texts:
            c = chunks(t) if t else [""]
            heads.append(c[0])
            del c[:1]
            found.update(c)
            cut.append(c)
            self.lookups += len(c)
        self._ready(found)
        u = list(dict.fromkeys(heads))
        first = dict(zip(u, self.encode(u)))
        get = self.__getitem__
        return [[first[h], *map(get, c)] for h, c in zip(heads, cut)]


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about so many characters, a longer text alone."""
    at = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield at, i
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)


def library(path: str):
    """The library's tokenizer of that file, without padding or truncation, in one thread."""
    single_threaded()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class Stems:
    """Ids of chunks from those of their stems, words of plain letters without the stops after them, so that a word is
    encoded once whatever follows it.  Stems that aren't held are encoded as one string; what isn't such a chunk goes to
    the library as it is.  The cache starts afresh when it is full.

    lead: what stands before a chunk (a blank, or nothing).  fold: whether words are lower-cased.  cut: from the ids of
    the stems in one string to the places, in ids, at which each of them ends, and the end of all.
    """

    def __init__(self, tok, stems_tok, lead: str, fold: bool, cut: Callable[[np.ndarray], np.ndarray], limit: int = 500_000):
        self.tok, self.stems_tok, self.lead, self.fold, self.cut, self.limit = tok, stems_tok, lead, fold, cut, limit
        self.held: dict[str, bytes] = {}

    def whole(self, strings: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, stems: list[str]) -> None:
        text = self.lead + " ".join(stems)
        ids = np.array(self.stems_tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * self.cut(ids)).tolist()
        if len(ends) != len(stems):
            made = self.whole([self.lead + s for s in stems])
        else:
            data = ids.tobytes()
            made = map(data.__getitem__, map(slice, [0, *ends], ends))
        self.held.update(zip(stems, made))

    def __call__(self, chunks: list[str]) -> list[bytes]:
        if len(self.held) > self.limit:
            self.held.clear()
        stems = [c.rstrip(STOPS) for c in chunks]
        fine = [w.isalpha() and (w.isascii() or LETTERS.fullmatch(w) is not None) for w in stems]
        tails = [c[len(w) :] if f else c for c, w, f in zip(chunks, stems, fine)]
        if self.fold:
            stems = [w.lower() for w in stems]
        if new := [w for w in dict.fromkeys(compress(stems, fine)) if w not in self.held]:
            self._learn(new)
        rest = set(compress(tails, fine))
        other = [t for t, f in zip(tails, fine) if not f]
        stops = dict(zip(rest, self.whole(list(rest))))
        led = iter(self.whole([t if t[:1] == "\n" else self.lead + t for t in other]))
        held = self.held
        return [held[w] + stops[t] if f else next(led) for w, t, f in zip(stems, tails, fine)]


def byte_level(tok, path: str) -> Stems:
    """Encoder of chunks, each without the blank that leads it, or with the line feed that does."""
    from tokenizers import pre_tokenizers

    stems = library(path)
    stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    opens = np.zeros(tok.get_vocab_size(), bool)
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        opens[i] = token[0] == "Ġ"
    return Stems(tok, stems, " ", False, lambda ids: np.append(np.flatnonzero(opens[ids])[1:], len(ids)))


def word_level(tok, path: str) -> Stems:
    """Encoder of chunks without white space for a file with word ends; words of plain letters need no normaliser but
    lower case."""
    from tokenizers import pre_tokenizers

    stems = library(path)
    stems.normalizer = None
    stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    closes = np.zeros(tok.get_vocab_size(), bool)
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        closes[i] = token.endswith("</w>")
    return Stems(tok, stems, "", True, lambda ids: np.flatnonzero(closes[ids]) + 1)


class Encoder:
    """Ids of whole texts, a batch at a time: the batch's distinct chunks are looked up once each."""

    def __init__(self, path: str):
        self.tok = library(path)
        self.by_words = getattr(self.tok.model, "end_of_word_suffix", None) is not None
        self.cache = ChunkCache(word_level(self.tok, path) if self.by_words else byte_level(self.tok, path))
        # Chunks of texts with odd white space may hold some, so they are others.
        self.odd = ChunkCache(lambda s: [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(s, add_special_tokens=False)])

    def _distinct(self, chunks: list[str]) -> list[bytes]:
        cache = self.cache
        out = list(map(cache.get, chunks))
        new = [c for c, v in zip(chunks, out) if v is None]
        if new:
            once = dict(zip(new, cache.encode(new)))
            cache.keep(once)
            out = [once[c] if v is None else v for c, v in zip(chunks, out)]
        return out

    def _runs(self, lists) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks of a list array, and the place at which each list starts, and the end."""
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        found = self._distinct(words.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        blob, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = blob[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.array(texts, pa.string())
        if self.by_words:
            ids, ends = self._runs(pc.ascii_split_whitespace(t))
            data, ends = memoryview(ids.tobytes()), (4 * ends).tolist()
            return (bytes(data[a:b]) for a, b in zip(ends, ends[1:]))
        odd = pc.match_substring_regex(t, ODD)
        plain = t.filter(pc.invert(odd))
        # Every line's first chunk is led by its line feed; the one put before the text is left out again.
        lined = pc.binary_join_element_wise("\n", pc.replace_substring(plain, "\n", " \n"), "")
        ids, ends = self._runs(pc.split_pattern(lined, " "))
        data, ends = memoryview(ids.tobytes()), (4 * ends).tolist()
        simple = (bytes(data[a + 4 : b]) for a, b in zip(ends, ends[1:]))
        other = map(b"".join, self.odd.batch(t.filter(odd).to_pylist()))
        return (next(other) if o else next(simple) for o in odd.to_pylist())


_ENCODERS: dict[str, Encoder] = {}


def ids_of(path: str, texts: list[str]) -> Iterator[bytes]:
    """Each whole text's ids as little-endian unsigned 32-bit integers, through this worker's cache."""
    if path not in _ENCODERS:
        release("encoders")
        _ENCODERS[path] = Encoder(path)
        holds("encoders", _ENCODERS.clear)
    for a, b in slices(texts):
        yield from _ENCODERS[path].ids(texts[a:b])
