"""Token ids of texts by a tokenizer file, computed once per distinct word and gathered with numpy.

The tokenizer drops white space and never merges over it, and neither its normalisation nor its lower-casing joins characters over ASCII
white space, so the ids of a text are those of its words in turn. Each distinct word (A-Z lower-cased, as the tokenizer does too) is
encoded by the tokenizers library when a worker first meets it. A text that holds one of the tokenizer's special strings, which are matched
before all that and in their own case, is encoded by the library as a whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import text_slices, word_hashes

#: Words a worker remembers before it starts anew; one text may have more.
MAX_WORDS = 1_000_000
#: The table of words has two to the power of so many places, or more where one text needs them.
TABLE_BITS = 21


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self, words: int = 0) -> None:
        """Forget all words; there will be room for so many at least."""
        self.bits = max(TABLE_BITS, (2 * words).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)  # an open-addressing table: hash and the word's number
        self.number = np.full(1 << self.bits, -1, np.int32)
        self.at = np.zeros(0, np.int64)  # by number: where the word's ids start, and how many there are
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 where it is not known."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        number = self.number[slot]
        again = np.flatnonzero((number >= 0) & (self.key[slot] != hashes))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            number[again] = self.number[slot[again]]
            again = again[(number[again] >= 0) & (self.key[slot[again]] != hashes[again])]
        return number

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        number = np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.number[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)  # one word for each free slot
            put = free[one]
            self.key[slot[put]], self.number[slot[put]] = hashes[put], number[put]
            left = left[self.key[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and how many each text has."""
        parts = [self._encode(*texts) for texts in text_slices(data, starts)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, counts = np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])
        whole = self._with_special(data, starts)
        return self._replaced(ids, counts, whole, data, starts) if len(whole) else (ids, counts)

    def _with_special(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The texts that hold a special string."""
        raw, found = data.tobytes(), set()
        for string in self.special:
            at = raw.find(string)
            while at >= 0:
                text = int(np.searchsorted(starts, at, "right")) - 1
                if at + len(string) <= starts[text + 1]:
                    found.add(text)
                    at = raw.find(string, int(starts[text + 1]))
                else:
                    at = raw.find(string, at + 1)
        return np.array(sorted(found), np.int64)

    def _replaced(self, ids: np.ndarray, counts: np.ndarray, whole: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts with those of the given texts as the library has them for the whole text."""
        ends, counts, parts, at = np.cumsum(counts), counts.copy(), [], 0
        for text in whole.tolist():
            own = self.tokenizer.encode(data[starts[text] : starts[text + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
            parts += [ids[at : ends[text] - counts[text]], np.array(own, np.uint32)]
            at, counts[text] = ends[text], len(own)
        return np.concatenate([*parts, ids[at:]]), counts

    def _encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = word_hashes(data, starts)
        if not len(hashes):
            return np.zeros(0, np.uint32), counts
        number = self._find(hashes)
        if (number < 0).any():
            missing = np.flatnonzero(number < 0)
            new, first = np.unique(hashes[missing], return_index=True)
            if len(self.size) + len(new) > max(MAX_WORDS, (1 << self.bits) // 2):
                self.clear(len(hashes))
                missing = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
            begin, end = _word_spans(data, starts)
            raw, at = data.tobytes(), missing[first]
            for i in range(0, len(new), 100_000):
                part = at[i : i + 100_000]
                self._learn(new[i : i + 100_000], [raw[b:e].decode("utf-8", "replace") for b, e in zip(begin[part].tolist(), end[part].tolist(), strict=True)])
            number[missing] = self._find(hashes[missing])
        size = self.size[number]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[number] - ends + size, size) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])
        words_before = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(before[words_before])


def _word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, as in word_hashes."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1 : len(data)]
    end[:-1] &= ~inside[1:] | edge[1 : len(data)]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One per worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]
