"""Token ids of whole texts by a tokenizers vocabulary, with a memory of words.

The library's word splitting never joins what stands on either side of a space
or a newline that follows a visible character, so a text made of words with
single separators is the concatenation of its words' ids.  Nor does it join a
letter or digit and the marks after it.  Such texts look up each word once per
batch, its marks apart; every other text (runs of white space, unusual spaces)
goes to the library as a whole.  Both ways give the same ids.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers before it forgets those that came once; bounds its memory, never its results.
MEMORY_WORDS = 800_000
#: Characters of text that are encoded at once; bounds memory, a longer text goes alone.
BATCH_CHARS = 4_000_000
#: Words that the library gets as one text.
JOINED = 250

#: What Python takes for white space.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Marks that end a word; an apostrophe may belong to the letter after it, so it is none.
_MARKS = ".,;:!?#*$%&|<>"
#: The marks follow a letter or digit that lower-casing and composing leave a single one.
_MARKED = "[0-9A-Za-zÀ-ÖØ-öø-ÿ][" + _MARKS + "]+$"
#: A character that may be composed, or take other bytes in lower case.
_BEYOND = r"[^\x00-\x{ff}]"

Ids = tuple[np.ndarray, np.ndarray]


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Memory:
    """Ids of words by number; words whose text is encoded whole have number 0 and no ids."""

    def __init__(self, most: int, learn: Callable[[list[str]], Ids]):
        self.most, self.learn = most, learn
        self.number: dict[str, int] = {"": 0}
        self.bounds = np.zeros(2, np.int64)
        self.flat = np.zeros(0, "<u4")
        self.uses = np.zeros(1, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of different words, which hold until the next call; unknown words are learnt."""
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(found < 0)
        if len(self.number) + len(unseen) > self.most:
            found = self._forget(found)
        if len(unseen):
            found[unseen] = self._add([words[i] for i in unseen.tolist()])
        self.uses[found] += 1
        return found

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.bounds[numbers + 1] - self.bounds[numbers]

    def _forget(self, found: np.ndarray) -> np.ndarray:
        """Keeps the words found, and those that came more than once if they take no more than half the room."""
        now = np.zeros(len(self.uses), bool)
        now[found[found >= 0]] = True
        again = now | (self.uses > 1)
        kept = again if again.sum() <= self.most // 2 else now
        kept[0] = False
        rows = np.flatnonzero(kept)
        new = np.zeros(len(kept) + 1, np.int64)  # the last one stands for -1
        new[rows], new[-1] = np.arange(1, len(rows) + 1), -1
        listed = new.tolist()
        self.number = {"": 0} | {w: listed[k] for w, k in self.number.items() if listed[k]}
        sizes = self.sizes(rows)
        self.flat = _runs(self.flat, self.bounds[rows], sizes)
        self.bounds = np.concatenate(([0, 0], np.cumsum(sizes)))
        self.uses = np.zeros(len(rows) + 1, np.int64)
        return new[found]

    def _add(self, words: list[str]) -> np.ndarray:
        body = pc.replace_substring_regex(pa.array(words, pa.large_string()), r"\A\n", "")
        whole = pc.or_(pc.equal(body, ""), pc.match_substring_regex(body, _SPACE)).to_numpy(zero_copy_only=False)
        numbers = np.where(whole, 0, len(self.uses) - 1 + np.cumsum(~whole))
        ids, sizes = self.learn([w for w, out in zip(words, whole.tolist()) if not out] if whole.any() else words)
        self.number.update(zip(words, numbers.tolist()))
        self.flat = np.concatenate((self.flat, ids))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
        self.uses = np.concatenate((self.uses, np.zeros(len(sizes), np.int64)))
        return numbers


class WordEncoder:
    """Encodes arrays of texts.

    ``spaced``: whether the vocabulary sees the space before a word and the case of
    letters (byte-level vocabularies do; those with word ends, which lower-case
    texts and drop white space, do not).
    """

    def __init__(self, vocabulary: bytes, spaced: bool, memory_words: int = MEMORY_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced = spaced
        self.words = _Memory(memory_words, self._many)
        self.heads = _Memory(memory_words, self._each)  # first words of texts, without a space before, and marks
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.removesuffix("</w>"))  # one character stands for one byte

    def _each(self, texts: list[str]) -> Ids:
        """Ids of the texts one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.zeros(0, "<u4"), *(np.array(f, "<u4") for f in found)]), sizes

    def _many(self, words: list[str]) -> Ids:
        """As _each, for single words: many in one call, cut where their bytes end."""
        if self.spaced:
            words = [w if w[0] == "\n" else " " + w for w in words]
        texts = pa.array(words, pa.large_string())
        n_bytes = pc.binary_length(texts).to_numpy().copy()
        if not self.spaced:
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, _BEYOND)).to_pylist():
                n_bytes[i] = len(unicodedata.normalize("NFC", words[i]).lower().encode())
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            flat, _ = self._each([("" if self.spaced else " ").join(some)])
            ends, want = np.cumsum(self.n_bytes[flat]), np.cumsum(n_bytes[i : i + JOINED])
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                counts = np.diff(at, prepend=-1)
            else:
                flat, counts = self._each(some)
            ids.append(flat)
            sizes.append(counts)
        return np.concatenate(ids), np.concatenate(sizes)

    def _split(self, texts: pa.Array) -> pa.Array:
        """The words of each text; in a spaced vocabulary a newline stays with the word after it."""
        if self.spaced:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        # small and capital letters have the same ids where nothing can be composed
        texts = pc.replace_substring(texts, "\n", " ")  # also a copy: ascii_lower misreads an array whose first text is not at byte 0
        plain = pc.invert(pc.match_substring_regex(texts, _BEYOND))
        return pc.split_pattern(pc.if_else(plain, pc.ascii_lower(texts), texts), " ")

    def encode(self, texts: pa.Array) -> Ids:
        """Ids of all texts one after the other, and the n + 1 places where texts start and end.

        A null or empty text has no ids.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        split = self._split(texts)
        units = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        index = units.indices.to_numpy()
        names = units.dictionary

        # every word and its marks, which are empty for most words, in turn
        marked = pc.match_substring_regex(names, _MARKED)
        shorter = pc.binary_length(pc.if_else(marked, pc.utf8_rtrim(names, _MARKS), names)).to_numpy()
        places = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        cuts = np.append(np.stack((places[:-1], places[:-1] + shorter), axis=1).reshape(-1), places[-1])
        parts = pa.Array.from_buffers(pa.large_string(), 2 * len(names), [None, pa.py_buffer(cuts), names.buffers()[2]]).dictionary_encode()
        base, marks = parts.indices.to_numpy().reshape(-1, 2).T
        parts = parts.dictionary
        is_base = np.zeros(len(parts), bool)
        is_base[base] = True
        number = np.zeros(len(parts), np.int64)
        number[is_base] = self.words.numbers(parts.filter(pa.array(is_base)).to_numpy(zero_copy_only=False).tolist())

        # the first word of a text has no space before it, and marks never have
        first = np.unique(index[bounds[:-1]]) if self.spaced else np.zeros(0, np.int64)
        used = np.unique(marks)
        heads = pa.concat_arrays([names.take(pa.array(first)), parts.take(pa.array(used))]).dictionary_encode()
        head = self.heads.numbers(heads.dictionary.to_pylist())[heads.indices.to_numpy()]
        mark = np.zeros(len(parts), np.int64)
        mark[used] = head[len(first) :]

        # ids of the different words, then of first words
        flat = np.concatenate((self.words.flat, self.heads.flat))
        numbers = np.stack((number[base], mark[marks]), axis=1)
        starts = np.stack((self.words.bounds[numbers[:, 0]], self.heads.bounds[numbers[:, 1]] + len(self.words.flat)), axis=1)
        each = np.stack((self.words.sizes(numbers[:, 0]), self.heads.sizes(numbers[:, 1])), axis=1)
        flat = np.concatenate((_runs(flat, starts.reshape(-1), each.reshape(-1)), self.heads.flat))
        each = each.sum(1)
        starts = np.cumsum(each) - each
        own = self.heads.sizes(head[: len(first)])
        sizes, odd = each[index], (number[base] == 0)[index]
        starts = starts[index]
        if self.spaced:
            at = np.searchsorted(first, index[bounds[:-1]])
            starts[bounds[:-1]] = self.heads.bounds[head[at]] + len(flat) - len(self.heads.flat)
            sizes[bounds[:-1]] = own[at]
            odd[bounds[:-1]] = head[at] == 0

        whole = np.logical_or.reduceat(odd, bounds[:-1])
        if whole.any():
            rows = np.flatnonzero(whole)
            more, n = self._each(texts.take(pa.array(rows)).to_pylist())
            sizes[np.repeat(whole, np.diff(bounds))] = 0
            starts[bounds[:-1][rows]] = np.cumsum(n) - n + len(flat)
            sizes[bounds[:-1][rows]] = n
            flat = np.concatenate((flat, more))
        counts = np.add.reduceat(sizes, bounds[:-1])
        return _runs(flat, starts, sizes), np.concatenate(([0], np.cumsum(counts)))


_ENCODERS: dict[tuple, WordEncoder] = {}


def worker_encoder(vocabulary: bytes, spaced: bool, memory_words: int = MEMORY_WORDS) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    key = (hash(vocabulary), len(vocabulary), spaced, memory_words)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(vocabulary, spaced, memory_words)
    return _ENCODERS[key]


def slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with a bounded number of bytes in ``text``; a longer text goes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
