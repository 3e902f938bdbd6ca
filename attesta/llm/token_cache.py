"""Encoding of whole texts with the tokenizers library, a distinct chunk once.

The pre-tokenizers of the vocabularies used here end a token wherever white
space begins (but for one space before a word) and between a letter and an
ASCII character that is none, so ids of a text are those of its chunks in a
row.  A worker keeps the ids of the chunks it has met lately, in two generations
of bounded size, until a task of another operator runs in it; the library
encodes the others in batches.  ``Encoder`` cuts and joins text by text,
``ByteEncoder`` a block of texts at a time, with numpy and Arrow.

Texts that hold the string of an added token are encoded as they are: the
library takes that string for the token, wherever it stands.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

from attesta.llm.common import forgets

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space of Unicode, fixed values (property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text that are encoded together: each distinct chunk of them is looked at once.
ENCODE_BYTES = 4 << 20
#: The same for ``ByteEncoder``.
BLOCK_BYTES = 8 << 20
#: Chunks of a generation (about 200 bytes each), and those of a task that has one Python worker and no second one behind it.
CACHE_CHUNKS, WIDE_CACHE = 350_000, 600_000
#: Longest chunk, in code points, that is remembered.
CACHE_CHARS = 64

#: Latin letters (all in property L, also when lower-cased and composed), and what may follow them at the end of a chunk.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af"
_STOP = f"(?![^{WHITE}!-@\\[-`{{-~])"

#: Latin letters with the single space before them; a run of white space up to its last character before a word; the rest of a word; other white space.
BYTE_CHUNKS = re.compile(f" ?[{LETTERS}]+{_STOP}|[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]+")
WORD_CHUNKS = re.compile(f"[{LETTERS}]+{_STOP}|[^{WHITE}]+")

_encoders: dict = {}


#: Kind of the caches that hold vocabularies and known chunks.
VOCABULARY = "vocabulary"
forgets(_encoders.clear, VOCABULARY)


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as the library encodes them with ``add_special_tokens=False``."""

    def __init__(self, tokenizer, chunks: re.Pattern, most: int = CACHE_CHUNKS):
        self.most = most
        self.tokenizer, self.chunks, self.known, self.older = tokenizer, chunks, {}, {}
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if self.added.search(t)} if self.added else set()
        parts = [() if i in whole else self.chunks.findall(t) for i, t in enumerate(texts)]
        wanted = set().union(*parts)
        if len(self.known) + len(wanted) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for c in wanted.difference(known):
            if c in older:
                known[c] = older[c]
            else:
                new.append(c)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[c] = array("I", e.ids).tobytes()
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for i in whole:
            out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        for c in new:
            if len(c) > CACHE_CHARS:
                del known[c]
        return out


#: Classes of characters by their first byte; the further bytes of a character have its class plus 8. No boundary is put at a character that may be white space or not (UNSURE), and none but at white space next to others beyond Latin letters (WIDE).
LETTER, DIGIT, OTHER, QUOTE, SPACE, BLANK, WIDE, UNSURE = range(8)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = LETTER
_CLASS[0x30:0x3A], _CLASS[0x27], _CLASS[0x20], _CLASS[0x09:0x0E] = DIGIT, QUOTE, SPACE, BLANK
_CLASS[0xCA:] = WIDE
_CLASS[[*range(0x1C, 0x20), *range(0x80, 0xC3), 0xE1, 0xE2, 0xE3]] = UNSURE


@cache
def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _pairs(rule) -> np.ndarray:
    return np.array([b < 8 and rule(a & 7, b) for a in range(16) for b in range(16)])


def _between(a: int, b: int) -> bool:
    """Whether a token always ends between a character of class a and one of class b."""
    if b in (SPACE, BLANK):
        return a not in (SPACE, BLANK, UNSURE)
    if a in (SPACE, BLANK):
        return a == BLANK and b != UNSURE
    known = (LETTER, DIGIT, OTHER, QUOTE)
    return a in known and b in known and a != b and (a, b) not in ((QUOTE, LETTER), (QUOTE, OTHER), (OTHER, QUOTE))


_BETWEEN = _pairs(_between)
#: A white character that something else follows begins a token, whatever is before it.
_BEFORE = _pairs(lambda a, b: a in (SPACE, BLANK) and b not in (SPACE, BLANK, UNSURE))


def byte_chunks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks of the rows of a UTF-8 buffer: everywhere a token of the byte-level pre-tokenizer is known to begin, with white space, digits and Latin letters told by their bytes."""
    n = len(data)
    edge = np.zeros(n, bool)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    far = np.flatnonzero(data >= 0x80)
    if len(far):
        lead = data[far] >= 0xC0
        first = far[lead]
        own = kind[first]
        own[(data[first] == 0xC3) & np.isin(data[np.minimum(first + 1, n - 1)], (0x97, 0xB7))] = WIDE  # the signs of multiplication and division
        kind[far] = own[np.cumsum(lead) - 1] + np.where(lead, 0, 8).astype(np.uint8) if len(own) else UNSURE
    pair = (kind[:-1] << 4) | kind[1:]
    edge[1:] = _BETWEEN[pair]
    edge[:-1] |= _BEFORE[pair]
    start, end = offsets[:-1], offsets[1:]
    last = end[end - start > 1] - 1  # what follows it is another row
    edge[last] = _BETWEEN[pair[last - 1]]
    edge[start[end > start]] = True
    return np.flatnonzero(edge)


class ByteEncoder:
    """Ids of blocks of texts by a byte-level vocabulary without a normalizer, as the library encodes them with ``add_special_tokens=False``.

    Chunks of a block are a dictionary-encoded Arrow array over its bytes, so
    Python sees each distinct one once; ids of all of them are one gather.
    """

    #: Words that the library's model encodes together.
    TOGETHER = 2_000
    #: What the pre-tokenizer takes as one token.
    _WORD = re.compile(f" ?(?:[{LETTERS}]+|[0-9]+)")
    #: The characters that stand for bytes in Latin-1, but the line end, which here separates words.
    _TABLE = {i: c for i, c in enumerate(byte_table()) if i != 10}

    def __init__(self, tokenizer, most: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.known, self.older = tokenizer, most, {}, {}
        self.words = Tokenizer(tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # a character of a byte-level token is a byte

    @staticmethod
    def fits(tokenizer) -> bool:
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        pre, model = tokenizer.pre_tokenizer, tokenizer.model
        if tokenizer.normalizer is not None or not isinstance(model, BPE) or not isinstance(pre, ByteLevel) or not pre.use_regex or pre.add_prefix_space:
            return False
        plain = not (model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix)
        return plain and all(model.token_to_id(c) is not None for c in byte_table())

    def _apart(self, chunks: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, of which each is one token of the pre-tokenizer; where a word ends is told by the bytes of its tokens."""
        text = b"\n".join(words).decode("latin-1").translate(self._TABLE)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        upto, wanted = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.searchsorted(upto, wanted)
        if at[-1] != len(upto) - 1 or not np.array_equal(upto[at], wanted):
            return self._apart(words)
        out, ends = ids.astype(self.dtype).tobytes(), ((at + 1) * self.dtype.itemsize).tolist()
        return [out[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _values(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks; those that are not too long are known from then on, as far as there is room."""
        values = list(map(self.known.get, chunks))
        missing = [i for i, v in enumerate(values) if v is None]
        if len(self.known) + len(missing) > self.most:
            self.known, self.older = {}, self.known
        known, words, others = self.known, [], []
        for i in missing:
            c = chunks[i]
            v = self.older.get(c)
            if v is not None:
                values[i] = v
                if len(known) < self.most:
                    known[c] = v
            else:
                (words if self._WORD.fullmatch(c.decode()) else others).append(i)
        if self.added:  # a word may be the string of an added token, or hold it
            whole = [i for i in words if self.added.search(chunks[i])]
            words, others = (sorted({*words}.difference(whole)), others + whole) if whole else (words, others)
        for new, encode in ((words, self._together), (others, self._apart)):
            for k in range(0, len(new), self.TOGETHER):
                some = new[k : k + self.TOGETHER]
                for i, v in zip(some, encode([chunks[i] for i in some]), strict=True):
                    values[i] = v
                    if len(chunks[i]) <= CACHE_CHARS and len(known) < self.most:
                        known[chunks[i]] = v
        return values

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> pa.Array:
        """Ids of each row of a UTF-8 buffer (of one row or more) and the end id after them, little-endian, of the width of ``dtype``."""
        starts, ends = byte_chunks(data, offsets), offsets[1:]
        if self.added and (found := [m.span() for m in self.added.finditer(data)]):
            whole = np.zeros(len(ends), bool)
            for first, last in (np.searchsorted(offsets, np.array(found) - (0, 1), "right")).tolist():
                whole[first - 1 : last] = True
            row = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[~whole[row] | (starts == offsets[row])]  # a row with such a string is one chunk
        last = np.searchsorted(starts, ends)
        cuts = np.concatenate((np.insert(starts, last, ends), [len(data)])).astype(np.int32)  # an empty chunk at the end of each row
        chunks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        own = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        end = own.index(b"")
        values = self._values(own[:end] + own[end + 1 :])
        values.insert(end, np.array([end_id], self.dtype).tobytes())
        flat, n = np.frombuffer(b"".join(values), self.dtype), np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        at = chunks.indices.to_numpy()
        count = n[at]
        upto = np.cumsum(count)
        place = np.repeat((np.cumsum(n) - n)[at] - (upto - count), count)
        place += np.arange(len(place))
        bounds = pa.array(np.concatenate(([0], upto[last + np.arange(len(last))] * self.dtype.itemsize))).cast(pa.int32())  # an error beyond 2 GB
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, bounds.buffers()[1], pa.py_buffer(flat[place])])


def byte_encoder(path: str) -> ByteEncoder | None:
    """The worker's encoder of blocks for a vocabulary file, None if it is not of the kind that ``ByteEncoder`` takes."""
    from tokenizers import Tokenizer

    def make():
        tokenizer = Tokenizer.from_file(path)
        return ByteEncoder(tokenizer, WIDE_CACHE) if ByteEncoder.fits(tokenizer) else None

    return kept_encoder((path, "blocks"), make)


def encoder(path: str, chunks: re.Pattern = BYTE_CHUNKS) -> Encoder:
    """The worker's encoder of a vocabulary file of the tokenizers library."""
    from tokenizers import Tokenizer

    return kept_encoder((path, chunks.pattern), lambda: Encoder(Tokenizer.from_file(path), chunks, WIDE_CACHE))


def kept_encoder(key, make) -> Encoder:
    """One encoder a worker for each key, until a task of another operator runs in it."""
    if key not in _encoders:
        _encoders[key] = make()
    return _encoders[key]
