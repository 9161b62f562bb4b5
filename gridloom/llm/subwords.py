"""Token ids of whole texts by a public byte-level vocabulary, with each distinct unit encoded once.

The pre-tokenizer of such vocabularies never joins what stands before a space
with the space, so a text may be cut in front of every space that follows a
character which is not white space.  The units between cuts repeat a lot: they
are gathered with Arrow's dictionary encoding, unknown ones are encoded
together by the library, and ids are put together by array gathers.  A text
with white space in front of a space, or with the string of an added token, is
encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that some definition of white space holds, as a class body of a regular expression.
_BLANKS = r"\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Marks that the pre-tokenizer always parts from a letter before them.
_MARKS = ".,;:!?*%#&$|)"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[s:s+n] for each start and length, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return pool[at]


class SubwordEncoder:
    """Ids as the library gives them with add_special_tokens=False; the strings of special tokens give their ids, or (special_as_text) are ordinary text."""

    def __init__(self, path: str, cache_units: int = 500_000, chunk_words: int = 1 << 14, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values() if t.content and not (special_as_text and t.special)]
        self.cache_units, self.chunk_words = cache_units, chunk_words
        vocab = self.model.get_vocab()
        self.width = np.ones(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a character stands for a byte
            self.width[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.pool, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.marks = {"": 0}

    def _shrink(self, words: list[str]) -> None:
        """Forget all units but these."""
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[at]
        ids = gather(self.pool, self.starts[at], lengths)
        self._reset()
        self._store(self.slots, words, ids, lengths)

    def _encode_each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode " " + word for each; words that end in white space go alone, the others joined."""
        alone = [w for w in words if not w or w[-1].isspace()]
        joined = [w for w in words if w and not w[-1].isspace()] if alone else words
        self._keep(self.slots, alone, self._encode_each([" " + w for w in alone]))
        for at in range(0, len(joined), self.chunk_words):
            part = joined[at : at + self.chunk_words]
            got = np.array(self.model.encode(" " + " ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy() + 1)
            cuts = np.searchsorted(np.cumsum(self.width[got]), ends) + 1
            self._store(self.slots, part, got, np.diff(cuts, prepend=0))

    def _keep(self, places: dict, words: list[str], got: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        self._store(places, words, np.fromiter((i for g in got for i in g), np.uint32, int(lengths.sum())), lengths)

    def _store(self, places: dict, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, at = len(self.starts), len(self.pool)
        self.starts = np.concatenate([self.starts, at + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])
        places.update(zip(words, range(n, n + len(words))))

    def _slots(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of each word's stem and of the punctuation behind it; a word without is all stem and has place 0 there."""
        slots, stems, tails = self.slots, [], []
        for w in words:
            stem = w.rstrip(_MARKS)
            if len(stem) < len(w) and stem and stem[-1].isalpha():
                stems.append(stem)
                tails.append(w[len(stem) :])
            else:
                stems.append(w)
                tails.append("")
        if len(slots) + len(self.marks) + len(words) > self.cache_units:
            self._shrink(list(dict.fromkeys(w for w in stems if w in slots)))
            slots = self.slots
        new = [w for w in dict.fromkeys(stems) if w not in slots]
        if new:
            self._learn(new)
        marks = [t for t in dict.fromkeys(tails) if t not in self.marks]
        self._keep(self.marks, marks, self._encode_each(marks))
        return np.fromiter(map(slots.__getitem__, stems), np.int64, len(words)), np.fromiter(map(self.marks.__getitem__, tails), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids[offsets[i]:offsets[i + 1]] are those of text i; null: empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = pc.match_substring_regex(texts, f"[{_BLANKS}] ")
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        cuts = np.asarray(parts.offsets, np.int64)
        cuts, flat = cuts - cuts[0], parts.flatten()
        head = cuts[:-1]
        coded = flat.dictionary_encode()
        stem, tail = self._slots(coded.dictionary.to_pylist())
        # Ids of each distinct word, then of all words by its place.
        both = np.stack([stem, tail], 1).ravel()
        lengths = self.lengths[both]
        pool = gather(self.pool, self.starts[both], lengths)
        lengths = lengths.reshape(-1, 2).sum(1)
        at = np.asarray(coded.indices)
        starts, lengths = (np.cumsum(lengths) - lengths)[at], lengths[at]
        # What stands first has no space before it, and some texts are encoded whole.
        heads = pc.if_else(whole, texts, flat.take(pa.array(head))).to_pylist()
        got = self._encode_each(heads)
        lens = np.fromiter(map(len, got), np.int64, n)
        starts[head], lengths[head] = len(pool) + np.cumsum(lens) - lens, lens
        pool = np.concatenate([pool, np.fromiter((i for g in got for i in g), np.uint32, int(lens.sum()))])
        ids = gather(pool, starts, lengths)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[cuts]


_encoders: dict[tuple[str, int], SubwordEncoder] = {}


def encoder(path: str, cache_units: int = 500_000) -> SubwordEncoder:
    """The process's encoder: the units it knows serve all tasks that a worker runs."""
    if (path, cache_units) not in _encoders:
        _encoders[path, cache_units] = SubwordEncoder(path, cache_units)
    return _encoders[path, cache_units]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20, rows: int = 16_384):
    """Parts of a batch with at most ``limit`` bytes of text (or one row) and ``rows`` rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + rows]), limit, side="right")))
        yield batch.slice(at, n)
        at += n
