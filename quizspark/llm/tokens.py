"""Token ids of whole texts, word by word.

The tokenizers library spends most of its time on words it has met before. Both kinds of vocabulary used here cut a
text before any merge, always where white space follows something else, so the ids of a text are the ids of its words,
each with the white space before it, one after the other. A batch is cut by Arrow, its distinct words are looked
up among those the worker knows, new ones are encoded, and numpy gathers the ids. Texts in which white space meets
white space are encoded whole. ``tests/llm`` compares with encoding whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from tokenizers import Tokenizer

#: White space of the tokenizers' patterns, the Unicode property.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks the first word of a text, and signs cut off a word: no space stands before them. A text that holds a mark is encoded whole.
_FIRST, _SIGN = "\x02", "\x03"
#: No merge crosses from a letter or digit to one of these signs; cutting there leaves fewer different words.
_BEFORE_SIGN = "([0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])([.,;:!?|&%$#*])"

#: Bytes of text worked on at a time; the arrays made on the way take some thirty times as much.
SLICE_BYTES = 1_000_000


def _packed(ids: list[int]) -> np.ndarray:
    return np.array(ids, "<u4")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class KnownWords:
    """Ids of words by the words' 64-bit hashes, in sorted arrays: some 30 bytes a word."""

    def __init__(self) -> None:
        self.hashes, self.flat = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, and which of them are known."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.starts = np.insert(self.starts, at, (len(self.flat) + np.cumsum(sizes) - sizes)[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.flat = np.concatenate([self.flat, ids])


class WordIds:
    """Ids of texts under one vocabulary; ``known`` holds the words met so far, at most ``LIMIT`` of them."""

    LIMIT = 2_000_000
    _loaded: dict[str, "WordIds"] = {}

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.known = KnownWords()
        self.drops_space = self._whole("a b") == self._whole("a  b")
        self.lowers = self._whole("AZ") == self._whole("az")
        self.mark = " ~ " if self.drops_space else "\n"
        self.mark_id, = self._whole(self.mark)
        self.whole = "<\\|" if self.drops_space else f"<\\||[{_WS}][{_WS}]|[{_FIRST}{_SIGN}]"

    @classmethod
    def load(cls, path: str) -> "WordIds":
        """One per worker process and vocabulary."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if self.drops_space:
            lower = pc.ascii_lower(texts) if self.lowers else texts
            return pc.ascii_split_whitespace(pc.replace_substring_regex(lower, _BEFORE_SIGN, r"\1 \2"))
        marked = pc.replace_substring(texts, "\n", " \n")
        marked = pc.replace_substring_regex(marked, _BEFORE_SIGN, rf"\1 {_SIGN}\2")
        return pc.split_pattern(pc.binary_join_element_wise(_FIRST, marked, ""), " ")

    def _word(self, piece: str) -> str:
        """The text a piece stands for."""
        if self.drops_space:
            return piece
        return piece[1:] if piece.startswith((_FIRST, _SIGN)) else piece if piece.startswith("\n") else " " + piece

    def _apart(self, word: str) -> bool:
        """Words that hold the parting sign or would run together with it."""
        if self.drops_space:
            return "~" in word or word.strip() == ""
        return word[1:] != word[1:].strip() or word[:1] == "\n" or len(word.split()) != 1 or not word[0].isascii()

    def _encoded(self, pieces: list[str], at_once: int = 5000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pieces, their ids one after the other, and how many each has.

        Many are encoded at a time, parted by a sign that has one id of its own wherever it stands.
        """
        places, ids, sizes = [], [], []
        words = list(map(self._word, pieces))
        apart = np.fromiter(map(self._apart, words), bool, len(words))
        for i in np.flatnonzero(apart).tolist():
            own = _packed(self._whole(words[i]))
            places.append([i])
            ids.append(own)
            sizes.append([len(own)])
        some = np.flatnonzero(~apart)
        for i in range(0, len(some), at_once):
            part = some[i:i + at_once]
            joined = _packed(self.tokenizer.encode_batch_fast(
                [self.mark.join([words[k] for k in part.tolist()])], add_special_tokens=False)[0].ids)
            marks = np.flatnonzero(joined == self.mark_id)
            if len(marks) != len(part) - 1:
                raise ValueError("the parting sign did not part all words")
            places.append(part)
            ids.append(joined[joined != self.mark_id])
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(joined)]])) - 1)
        return np.concatenate(places).astype(np.int64), np.concatenate(ids), np.concatenate(sizes).astype(np.int32)

    def _learned(self, pieces: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places of the words among the known ones, after new ones have been encoded."""
        at, known = self.known.find(hashes)
        if known.all():
            return at
        new = np.flatnonzero(~known)
        if len(self.known.hashes) + len(new) > self.LIMIT:
            self.known = KnownWords()
            new = np.arange(len(hashes))
        places, ids, sizes = self._encoded(pieces[new].tolist())
        self.known.add(hashes[new[places]], ids, sizes)
        return self.known.find(hashes)[0]

    def ids(self, texts: list[str], terms: bool = False) -> tuple[np.ndarray, ...]:
        """Ids of all texts after each other, and where each text starts, with the total at the end.

        With ``terms`` also a 32-bit hash of each word of all texts, and where each text's words start.
        """
        texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, self.whole)
        n_odd = pc.sum(odd).as_py() or 0
        cut = self._cut(texts)
        words = cut.flatten().dictionary_encode()
        each = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each))
        at = self._learned(words.dictionary.to_numpy(zero_copy_only=False), hashes)
        codes = words.indices.to_numpy(zero_copy_only=False)
        of_word = self.known.sizes[at][codes].astype(np.int64)
        ids = self.known.flat[ranges(self.known.starts[at][codes], of_word)]
        starts = np.concatenate([[0], np.cumsum(of_word)])[cut.offsets.to_numpy()]
        if n_odd:
            whole = {i: _packed(self._whole(texts[i].as_py())) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
            ids = np.concatenate([whole.get(i, ids[starts[i]:starts[i + 1]]) for i in range(len(texts))])
            lengths = np.diff(starts)
            lengths[list(whole)] = [len(x) for x in whole.values()]
            starts = np.concatenate([[0], np.cumsum(lengths)])
        if not terms:
            return ids, starts
        return ids, starts, hashes.astype(np.uint32)[codes], cut.offsets.to_numpy()


def chunks(texts: list[str | None], chars: int = 4_000_000):
    """Slices of a batch with about ``chars`` characters each, a longer text alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Slices of a batch's texts with about ``size`` bytes each, a longer text alone; null counts as empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield first, last, [t or "" for t in texts.slice(first, last - first).to_numpy(zero_copy_only=False).tolist()]
        first = last
