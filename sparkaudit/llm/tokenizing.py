"""Token ids of whole texts by public tokenizers, inside Python workers.

Tokenizers of the byte-level kind first cut a text by a pattern none of whose pieces has white
space behind anything else; so a text may be cut before each run of white space, and the parts' ids joined are
the text's ids.  A batch is cut in arrays, each distinct part of it is looked up once, and a worker remembers
parts up to ``MEMO``.  Parts begin at spaces and line ends.  Texts in which one of these follows white space that is not
ASCII or special tokens that count as such, and all texts of other kinds of tokenizers are encoded whole.  The vocabularies' places are
parameters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, and what is so to some libraries only, besides the six ASCII blanks; a regular expression of RE2 and of Python.
ODD_WHITE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ODD_END = re.compile(ODD_WHITE + r"\Z|[ \t-\r]\Z")
#: Marks that may follow a word.
CLOSING = ",.;:!?*#)]}\""
MEMO = 1_000_000
#: Ids remembered for each part that may be: parts can be long.
IDS_EACH = 16
#: Parts encoded in one call, bytes of text cut in one go.
LINES, CHUNK = 5000, 4 << 20

_encoders: dict = {}


def text_array(texts: list[str] | pa.Array) -> pa.Array:
    """Texts as an array with 64-bit offsets; null ones are empty."""
    array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    return pc.fill_null(array.cast(pa.large_string()), "")


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``CHUNK`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        yield texts.slice(at, end - at)
        at = end


def parts_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Parts as places among the distinct ones, those, and how many parts stand before each text and after the last."""
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return np.empty(0, dtype=np.int64), [], np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    cut = (data == 32) | (data == 10)
    cut[1:] &= ~((data[:-1] == 32) | (data[:-1] - np.uint8(9) < 5))
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data))
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(starts, offsets)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    if not len(size):
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1])


class Slots:
    """Sequences of numbers by place, one after the other in one array that grows."""

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.values, self.used = np.empty(1 << 16, dtype=self.kind), 0
        self.sizes, self.starts, self.count = np.empty(1 << 12, dtype=np.int64), np.empty(1 << 12, dtype=np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        return array if used + more <= len(array) else np.append(array, np.empty(used + more, dtype=array.dtype))

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = self._room(self.values, self.used, len(values))
        self.sizes, self.starts = (self._room(x, self.count, len(sizes)) for x in (self.sizes, self.starts))
        own = slice(self.count, self.count + len(sizes))
        self.values[self.used : self.used + len(values)] = values
        self.sizes[own] = sizes
        self.starts[own] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(values), self.count + len(sizes)

    def get(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of some places joined, and their sizes."""
        sizes = self.sizes[places]
        return self.values[ranges(self.starts[places], sizes)], sizes


class ByteLevelEncoder:
    """ids of texts as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, special_as_text: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (special_as_text and t.special)]
        cut = self.tokenizer.pre_tokenizer
        self.in_parts = (
            self.tokenizer.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        )
        self.vocab = self.tokenizer.get_vocab_size()
        self.most = memo
        self.memo: dict[str, int] = {}
        self.known = Slots(np.uint32)
        # A word of Latin letters is one piece to the pattern: its byte letters go to the vocabulary's model at once.
        self.model = Tokenizer(self.tokenizer.model)
        self.line_end = self._ids(["\n"])[0]
        self.letters = {c: self._byte_letters(chr(c)) for c in range(0x80, 0x100) if chr(c).isalpha()}
        self.space = self._byte_letters(" ")
        # Pieces of parts: words in byte letters, marks, others.
        self.pool = Slots(np.uint32)
        self._forget_pieces()
        # Bytes of each token: a letter stands for one.
        self.size = np.zeros(self.vocab, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)

    @staticmethod
    def _byte_letters(text: str) -> str:
        from tokenizers import pre_tokenizers

        return "".join(p for p, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, dtype=np.uint32) for f in found]

    def _sizes(self, ids: np.ndarray, sizes: list[int]) -> np.ndarray:
        """How many of the ids of texts joined each text has; sizes: bytes of each."""
        return np.diff(np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes)) + 1, prepend=0)

    def _pooled(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> dict[str, int]:
        first = self.pool.count
        self.pool.add(ids, sizes)
        return dict(zip(names, range(first, first + len(names))))

    def _forget_pieces(self) -> None:
        self.pool.clear()
        self.words, self.marks = {}, {"": 0}
        # Nothing, a line end.
        self.pool.add(np.array([self.line_end[0]], dtype=np.uint32), np.array([0, 1]))

    def _learn_words(self, pieces: list[str]) -> None:
        """Pieces in byte letters by the vocabulary's model alone."""
        for at in range(0, len(pieces), LINES):
            some = pieces[at : at + LINES]
            ids = self.model.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype=np.uint32)
            self.words |= self._pooled(some, ids, self._sizes(ids, list(map(len, some))))

    def _others(self, parts: list[str]) -> dict[str, int]:
        """Parts through the pattern: joined, if each begins with white space and ends otherwise."""
        alone = [p for p in parts if p[0] not in " \n" or ODD_END.search(p)]
        found = self._ids(alone) if alone else []
        out = self._pooled(alone, np.concatenate(found), np.array(list(map(len, found)))) if alone else {}
        rest = [p for p in parts if p not in out]
        for at in range(0, len(rest), LINES):
            some = rest[at : at + LINES]
            ids = self._ids(["".join(some)])[0]
            out |= self._pooled(some, ids, self._sizes(ids, [len(p.encode()) for p in some]))
        return out

    def part_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, joined, and how many each has; words apart from the marks that follow them, which are a piece of their own."""
        if self.pool.count > self.most or self.pool.used > IDS_EACH * self.most:
            self._forget_pieces()
        space, letters = self.space, self.letters
        lines, pieces, marks, others = [], [], [], []
        for p in parts:
            lead = p[0]
            word = p.rstrip(CLOSING)
            bare = word[1:] if lead == " " or lead == "\n" else word
            if bare.isalpha():
                if not bare.isascii():
                    bare = bare.translate(letters) if max(bare) < "\u0100" else ""
                if bare:
                    lines.append(lead == "\n")
                    pieces.append(space + bare if lead == " " else bare)
                    marks.append(p[len(word) :])
                    continue
            lines.append(False)
            pieces.append(None)
            marks.append("")
            others.append(p)
        self._learn_words([p for p in dict.fromkeys(pieces) if p is not None and p not in self.words])
        new = [m for m in dict.fromkeys(marks) if m not in self.marks]
        if new:
            found = self._ids(new)
            self.marks |= self._pooled(new, np.concatenate(found), np.array(list(map(len, found))))
        if others:
            own = self._others(others)
            other = iter(others)
            words = [self.words[p] if p is not None else own[next(other)] for p in pieces]
        else:
            words = list(map(self.words.__getitem__, pieces))
        ids, sizes = self.pool.get(np.column_stack([lines, words, list(map(self.marks.__getitem__, marks))]).ravel())
        return ids, sizes.reshape(-1, 3).sum(axis=1)

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts cannot be cut into parts."""
        if not self.in_parts:
            return np.ones(len(texts), dtype=bool)
        found = pc.match_substring_regex(texts, ODD_WHITE + "[ \n]").to_numpy(zero_copy_only=False)
        for token in self.added:
            found = found | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = text_array(texts)
        whole = self.whole(texts)
        out: list = [None] * len(texts)
        at = np.flatnonzero(whole)
        for i, ids in zip(at.tolist(), self._ids(texts.take(at).to_pylist()) if len(at) else []):
            out[i] = ids.tobytes()
        i = iter(np.flatnonzero(~whole).tolist())
        for chunk in chunks(texts.filter(~whole) if len(at) else texts):
            for ids in self._chunk(chunk):
                out[next(i)] = ids
        return out

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        codes, distinct, ends = parts_of(texts)
        if len(self.memo) > self.most or self.known.used > IDS_EACH * self.most:
            self.memo.clear()
            self.known.clear()
        new = [p for p in distinct if p not in self.memo]
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
            self.known.add(*self.part_ids(new))
        places = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        ids, sizes = self.known.get(places[codes])
        cuts = np.append(0, np.cumsum(sizes))[ends] * 4
        raw = ids.astype("<u4").tobytes()
        return [raw[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]


def byte_level(path: str, special_as_text: bool = False, memo: int = MEMO) -> ByteLevelEncoder:
    """The worker's encoder for a tokenizer file; made once."""
    key = (path, special_as_text, memo)
    if key not in _encoders:
        _encoders[key] = ByteLevelEncoder(path, special_as_text, memo)
    return _encoders[key]
