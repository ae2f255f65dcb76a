"""Token ids of texts, by a public tokenizer whose pre-tokenizer never joins what white space parts.

For such a tokenizer the ids of a text are the ids of its white-space-separated chunks in turn. The pre-tokenizer
lower-cases chunks of Latin letters with punctuation behind them, and parts them there. So texts are cut into such
parts and other chunks by arrays, and a worker encodes each distinct one once and looks it up afterwards. Texts are
cut at ASCII white space alone; the tokenizer handles the rest.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from inkveil.llm.common import REMEMBERED, SPACES

#: Appended to each document.
END_ID = 1
#: Parts and other chunks that a worker remembers in one generation, and the bytes of the longest one it remembers: about 200 MB of short words in all.
MAX_CACHED, MAX_CHUNK = 600_000, 64
#: Bytes of texts that are encoded together; a longer text is encoded in pieces.
GROUP_BYTES = 1 << 21

#: Kinds of bytes; an upper-case letter is a letter too.
_LETTER, _MARK, _OTHER, _UPPER = 1, 2, 4, 9
_KIND = bytes(0 if b in SPACES else _UPPER if 65 <= b <= 90 else _LETTER if 97 <= b <= 122 else _MARK if 33 <= b <= 126 and not 48 <= b <= 57 else _OTHER for b in range(256))

#: The byte before the second ones of the letters À to ÿ, whose lower-casing and composition don't hang on their neighbours, and the second bytes there of × and ÷.
_LEAD, _TIMES, _DIVIDED = 0xC3, 0x97, 0xB7

_SPACE = re.compile(b"[" + SPACES + b"]")
#: Lower-case words of these letters pass the normaliser and the pre-tokenizer unchanged, but for the byte alphabet:
#: it writes the bytes that aren't printable in Latin-1 as the code points from 256 on.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

_ENCODERS: dict[int, ChunkEncoder] = {}
REMEMBERED.append(_ENCODERS)


class _Memory:
    """A dict of what was used last, in two generations, the older of which goes when the younger is full."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def absent(self, keys) -> list:
        """The keys that neither generation has; what the older has moves to the younger."""
        old, out = self.old, []
        for x in keys:
            if (found := old.get(x)) is None:
                out.append(x)
            else:
                self.young[x] = found
        return out

    def age(self) -> None:
        self.old, self.young = self.young, {}


def cut_chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """For a text that ends in white space: the place of the last byte of each chunk, the number of keys up to the end of each, and the keys.

    A chunk of letters with marks behind them has the lower-case letters and the marks as keys, any other is its own key."""
    kinds = bytearray(text).translate(_KIND)
    data, kind = np.frombuffer(text, np.uint8), np.frombuffer(kinds, np.uint8)
    if len(lead := np.flatnonzero(data == _LEAD)):
        second = data[lead + 1]
        letter = ((second & 0xC0) == 0x80) & (second != _TIMES) & (second != _DIVIDED)
        kind[lead[letter]] = _LETTER
        kind[lead[letter] + 1] = np.where(second[letter] < 0x9F, _UPPER, _LETTER)
    inside = kind != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if inside[0]:
        edges = np.concatenate([[-1], edges])
    last = edges[1::2]
    sizes = last - edges[::2]
    chars, kind = np.frombuffer(bytearray(text).translate(None, SPACES), np.uint8), np.frombuffer(kinds.translate(None, b"\0"), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes

    odd = kind == _OTHER
    letter, mark = (kind & _LETTER) != 0, kind == _MARK
    odd[1:] |= letter[1:] & mark[:-1]
    odd[starts] = ~letter[starts]
    plain = np.ones(len(ends), bool)
    plain[np.searchsorted(ends, np.flatnonzero(odd), "right")] = False
    upper = np.flatnonzero(kind == _UPPER)
    chars[upper[plain[np.searchsorted(ends, upper, "right")]]] += 32
    tails = np.flatnonzero(letter[:-1] & mark[1:]) + 1
    owner = np.searchsorted(ends, tails, "right")
    own = plain[owner]
    begins = np.zeros(len(chars), bool)
    begins[starts] = True
    begins[tails[own]] = True
    keys_of = np.ones(len(ends), np.int64)
    keys_of[owner[own]] = 2
    offsets = np.append(np.flatnonzero(begins), len(chars)).astype(np.int32)
    keys = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars)])
    return last, np.cumsum(keys_of), keys


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        #: Words of letters; everything else.
        self.parts, self.chunks = _Memory(), _Memory()

    def chunk_ids(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a text that ends in white space: its ids, the place of the last byte of each chunk, and the number of ids up to the end of each."""
        found, at, before = [], 0, 0
        while at < len(text):
            to = _SPACE.search(text, min(at + GROUP_BYTES, len(text)) - 1).end()
            last, upto, keys = cut_chunks(text[at:to])
            if len(last):
                coded = keys.dictionary_encode()
                _, ends, ids = pa.array(self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices).buffers()
                ends = np.frombuffer(ends, np.int32)[upto] >> 2
                found.append((np.frombuffer(ids or b"", "<u4", int(ends[-1])), last + at, ends + np.int64(before)))
                before += int(ends[-1])
            at = to
        if not found:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*found, strict=True))

    def _values(self, keys: list[bytes]) -> list[bytes]:
        """The ids of each key."""
        parts, chunks = self.parts, self.chunks
        values = list(map(parts.young.get, keys))
        new = [x for x, v in zip(keys, values, strict=True) if v is None]
        if new:
            self._learn(new)
            find, other = parts.young.get, chunks.young
            values = [v if v is not None else find(x) or other[x] for x, v in zip(keys, values, strict=True)]
            for x in new:
                if len(x) > MAX_CHUNK:
                    del other[x]
        if len(parts.young) + len(chunks.young) > MAX_CACHED:
            parts.age()
            chunks.age()
        return values

    def _learn(self, keys: list[bytes]) -> None:
        """Puts all keys into the younger generations."""
        words, other = [], []
        for x in keys:
            (words if len(x) <= MAX_CHUNK and (x.isalpha() or _LETTERS.fullmatch(x)) else other).append(x)
        known, model, four = self.parts.young, self.model.tokenize, self.four
        for x in self.parts.absent(words):
            text = x.decode("latin-1")
            known[x] = b"".join([four[t.id] for t in model(text if x.isascii() else text.translate(_BYTES))])
        missing = self.chunks.absent([x for x in other if x not in self.chunks.young])
        found = self.tokenizer.encode_batch_fast([x.decode() for x in missing], add_special_tokens=False)
        self.chunks.young.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(missing, found, strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (in UTF-8) and END_ID."""
        end, out = END_ID.to_bytes(4, "little"), []
        for group in grouped(texts):
            ids, last, ends = self.chunk_ids(b"\n".join([*group, b""]))
            whole, at = ids.tobytes(), 0
            for to in (4 * up_to_texts(group, last, ends)).tolist():
                out.append(whole[at:to] + end)
                at = to
        return out


def grouped(texts: Iterable[bytes], size: Callable = len) -> Iterator[list]:
    """The texts, or rows of which size() tells the bytes of text, in lists of about GROUP_BYTES."""
    group, held = [], 0
    for x in texts:
        group.append(x)
        held += size(x) + 1
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def up_to_texts(texts: list[bytes], last: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of ids up to the end of each text, from what chunk_ids() gives for the texts with one space behind each."""
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.concatenate([[0], ends])[np.searchsorted(last, text_ends)]


def encoder(vocabulary: str) -> ChunkEncoder:
    """This process's encoder for the contents of a tokenizer file."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(vocabulary)
    return _ENCODERS[key]


def vocabulary_file(name: str) -> str:
    """Contents of one of the public tokenizers; the driver sends them to the executors (a few MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()
