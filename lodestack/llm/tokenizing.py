"""Token ids of whole Arrow columns by a public word tokenizer, each distinct word encoded once.

The tokenizer lower-cases, drops white space and never lets a token cross it, so the ids of a text
are the ids of its white-space words in order. Arrow splits and dictionary-encodes a batch; only words
not met before go through the tokenizer. Texts with characters for which its normaliser could look
beyond one character (control characters, anything from U+0300 on but common punctuation, or the
opening of a special token) are encoded as they are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in a worker's memory, some 50 bytes each and twice that while it grows; when full it starts anew.
CACHED_WORDS = 500_000
#: Bytes of text that are encoded at once (a longer text alone); working memory is some 20 times that.
PART_BYTES = 1_000_000
_STOPS = ".,;:!?"
_UNSAFE = "[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x{84}\\x{86}-\\x{9f}\\x{130}\\x{300}-\\x{200f}\\x{2028}-\\x{10ffff}]|<\\|"


class BatchTokenizer:
    """``path`` names a tokenizer file of the word kind described above."""

    def __init__(self, path: str):
        # a task has one core: a pool of threads for each worker would take others' cores, and memory for each thread
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that end a run of letters
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.hashes, self.order = np.zeros(0, np.int64), np.zeros(0, np.int64)  # hashes sorted; which word each is of
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _places(self, names: pa.Array) -> np.ndarray:
        """Where each distinct word's ids are, after encoding those not known yet."""
        hashes = np.fromiter(map(hash, names.to_numpy(zero_copy_only=False)), np.int64, len(names))
        place = np.zeros(len(names), np.int64)
        met = np.zeros(len(names), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            place = self.order[at]
            met = (self.hashes[at] == hashes) & pc.equal(self.known.take(pa.array(place)), names).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(~met)
        if len(new):
            if len(self.known) and len(self.known) + len(new) > CACHED_WORDS:
                self._reset()
                return self._places(names)
            place[new] = len(self.known) + np.arange(len(new))
            self._learn(names.take(pa.array(new)))
            new = new[np.argsort(hashes[new])]
            between = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.order = np.insert(self.hashes, between, hashes[new]), np.insert(self.order, between, place[new])
        return place

    def _learn(self, new: pa.Array) -> None:
        letters = pc.match_substring_regex(new, r"^\pL+$").to_numpy(zero_copy_only=False)
        names = new.to_numpy(zero_copy_only=False)
        lens = np.zeros(len(names), np.int64)
        # words of letters alone go through as one text: each has one token that ends it
        flat = np.array(self.tokenizer.encode(" ".join(names[letters]), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != letters.sum():
            raise ValueError("the tokenizer does not end each word with a token of its own")
        lens[letters] = np.diff(ends, prepend=0)
        other = [e.ids for e in self.tokenizer.encode_batch_fast(names[~letters].tolist(), add_special_tokens=False)]
        lens[~letters] = [len(x) for x in other]
        ids = np.zeros(int(lens.sum()), np.uint32)
        of_letters = np.repeat(letters, lens)
        ids[of_letters], ids[~of_letters] = flat, np.fromiter(chain.from_iterable(other), np.uint32)
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lens)])
        self.flat = np.concatenate([self.flat, ids])

    def _word_ids(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row and where each one's begin. Stops after a letter or digit are words of their own."""
        stems = pc.utf8_rtrim(names, characters=_STOPS)
        cut = pc.match_substring_regex(stems, r"[\pL\pN]$")
        stops = pc.if_else(cut, pc.replace_substring_regex(names, f"(?s)^.*[^{_STOPS}]", ""), "")
        coded = pa.concat_arrays([pc.if_else(cut, stems, names), stops]).dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()].reshape(2, -1).T.ravel()
        flat, starts = _gather(self.flat, self.starts[at], self.starts[at + 1] - self.starts[at])
        return flat, starts[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's begin (one more at the end); null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(odd), "", texts)))
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        # strings of no word (the ends of a text that begins or ends with white space) have no ids
        flat, starts = self._word_ids(coded.dictionary)
        at = coded.indices.to_numpy()
        flat, starts = _gather(flat, starts[at], starts[at + 1] - starts[at])
        starts = starts[ends - ends[0]]
        if odd.any():
            own = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
            for i in np.flatnonzero(odd):
                own[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            flat = np.concatenate(own)
        return flat, starts


def _gather(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat`` in a row and where each begins."""
    first = np.concatenate([[0], np.cumsum(lens)])
    return flat[np.repeat(begin - first[:-1], lens) + np.arange(first[-1])], first


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cuts a column into runs of rows, from and to, of about PART_BYTES of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART_BYTES, "right")))
        yield at, end
        at = end


@lru_cache(maxsize=2)
def batch_tokenizer(path: str) -> BatchTokenizer:
    """One for each worker process, so that words stay known from task to task."""
    return BatchTokenizer(path)


def default_path() -> str:
    """The word tokenizer that the queries use; a path parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
