"""Public tokenizers with a cache of words: ids equal to encoding the whole text.

Both vocabularies first cut a text into pieces (letters, digits, signs, white
space) and then merge inside each piece only. No piece holds a blank but as its
first character, so the ids of a text are the ids of its words (what lies between
blanks, for the byte-level vocabulary with the blank before), one after the
other. Words are told apart by Arrow; the ids of a distinct word come from the
tokenizer once and are kept for up to CACHE words, those seen last. New words are
encoded many together, as one text: an id stands for a fixed number of bytes, so
that the ids of each word are told by their lengths.

A text goes to the tokenizer whole if that rule could fail for it: if a word has
a character outside SAFE or the string of an added token (<|endoftext|>), or, for
the byte-level vocabulary, begins or ends in white space (runs of white space are
cut by what follows them).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids are kept (some 40 bytes each).
CACHE = 1_000_000
#: Words that the tokenizer gets in one text.
CALL = 128
#: Characters on which Python's \s and lower() agree with the Unicode classes that the vocabularies use.
SAFE = re.compile("[\t\n\r\x20-\x7E\xA1-\xB1\xB4-\xB8\xBA\xBB\xBF-įı-ɏ]*")
#: Bytes that are no white space of SAFE.
INK = ~np.isin(np.arange(256), (9, 10, 13, 32))
_EDGES = re.compile(r"\s\s|^\s|\s$")


class _Words:
    """Ids of words: those of words[k] are ids[start[k] : start[k] + size[k]]; size -1: the word's text goes to the tokenizer whole."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.size, self.seen = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.step = 0

    def add(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        held = np.maximum(size, 0)
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(held) - held])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.seen = np.concatenate([self.seen, np.full(len(size), self.step, np.int32)])

    def trim(self) -> None:
        """Keeps CACHE // 2 words, those seen last."""
        on = np.sort(np.argsort(-self.seen, kind="stable")[: CACHE // 2])
        words, size, seen = self.words.take(pa.array(on)), self.size[on], self.seen[on]
        ids = self.ids[spread(self.start[on], np.maximum(size, 0))]
        step = self.step
        self.__init__()
        self.add(words, ids, size)
        self.seen, self.step = seen, step


def spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (many[0] of them), start[1], start[1] + 1, ..."""
    on = np.flatnonzero(many)
    start, many = start[on], many[on]
    step = np.ones(int(many.sum()), np.int64)
    if len(on):
        step[0] = start[0]
        step[np.cumsum(many[:-1])] = start[1:] - start[:-1] - many[:-1] + 1
    return np.cumsum(step, out=step)


class CachedTokenizer:
    """encode(texts) gives one uint32 array of ids for each text. file: a byte-level or a lower-case word vocabulary."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = not any(" " in a for a in added)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.firsts = {a[0] for a in added}
        self.lower = self.tokenizer.normalizer is not None
        self.known = _Words()
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():  # both vocabularies spell a byte as one character
            self.bytes[k] = len(token.removesuffix(suffix))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _adds(self, text: str) -> bool:
        """Whether a text has the string of an added token, in any case."""
        return any(c.isalpha() or c in text for c in self.firsts) and bool(self.added.search(text))

    def _plain(self, words: list[str]) -> np.ndarray:
        """Whether the ids of a word stand in those of any text that has it."""
        every = " ".join(words)
        if SAFE.fullmatch(every) and not self._adds(every) and (self.lower or not _EDGES.search(every)):
            return np.ones(len(words), bool)
        fits = lambda w: SAFE.fullmatch(w) and not self._adds(w) and (self.lower or w and not w[0].isspace() and not w[-1].isspace())
        return np.array([bool(fits(w)) for w in words], bool)

    def _together(self, text: str, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the plain words between the blanks of a text, and how many each has; word by word if one does not end where an id does."""
        ids = np.array(self.tokenizer.encode_batch_fast([lead + text], add_special_tokens=False)[0].ids, "<u4")
        raw = np.frombuffer((text.lower() if self.lower else text).encode() + b" ", np.uint8)
        after = np.flatnonzero(raw == 32)
        ends = np.cumsum(INK[raw])[after] if self.lower else after + len(lead)
        reach = np.cumsum(self.bytes[ids])
        upto = np.searchsorted(reach, ends, side="right")
        if (np.append(0, reach)[upto] == ends).all() and upto[-1] == len(ids):
            return ids, np.diff(upto, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([lead + w for w in text.split(" ")], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.array([len(x) for x in found], np.int64)

    def _encode_words(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has (-1 if it is not plain)."""
        cuts = pa.array(np.append(np.arange(0, len(words), CALL), len(words)), pa.int32())
        ids, size = [], []
        for text in pc.binary_join(pa.ListArray.from_arrays(cuts, words), " ").to_pylist():
            part = text.split(" ")
            ok = self._plain(part)
            many = np.full(len(part), -1, np.int64)
            if ok.any():
                found, many[ok] = self._together(text if ok.all() else " ".join(w for w, k in zip(part, ok.tolist(), strict=True) if k), lead)
                ids.append(found)
            size.append(many)
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.concatenate(size)

    def _look_up(self, words: pa.Array, lead: str) -> np.ndarray:
        """Number of each word in known; those that are new are learnt."""
        known = self.known
        known.step += 1
        at = pc.index_in(words, value_set=known.words)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            at[new] = len(known.size) + np.arange(len(new))
            fresh = words.take(pa.array(new))
            known.add(fresh, *self._encode_words(fresh, lead))
        known.seen[at] = known.step
        return at

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the len + 1 places where those of each text begin; end_id, if given, follows each text. Null: empty."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count
        coded = parts.flatten().dictionary_encode()
        of = self._look_up(coded.dictionary, "" if self.lower else " ")
        start, size = self.known.start[of], self.known.size[of]
        word = coded.indices.to_numpy(zero_copy_only=False)
        start, many = start[word], size[word]
        more: list[list[int]] = []
        if not self.lower:  # the first word of a text has no blank before it
            heads = coded.dictionary.take(coded.indices.take(pa.array(first))).to_pylist()
            more = [self._whole(w) if k else [] for w, k in zip(heads, self._plain([*heads, "x"])[:-1].tolist(), strict=True)]
            empty = np.array([not w for w in heads])
            many[first] = np.where((many[first] < 0) & ~empty, -1, [len(x) for x in more])
        odd = np.flatnonzero(np.logical_or.reduceat(many < 0, first)) if self.by_words else np.arange(len(texts))
        extra = len(self.known.ids) + np.cumsum([0, *map(len, more)])
        if not self.lower:
            start[first] = extra[:-1]
        tail = int(extra[-1])
        for d in odd.tolist():
            many[first[d] : first[d] + count[d]] = 0
            more.append(self._whole(texts[d].as_py()))
            start[first[d]], many[first[d]] = tail, len(more[-1])
            tail += len(more[-1])
        if end_id is not None:
            more.append([end_id])
            start, many = np.insert(start, first + count, tail), np.insert(many, first + count, 1)
            count = count + 1
        values = np.concatenate([self.known.ids, np.fromiter(chain.from_iterable(more), "<u4")])
        ids = values[spread(start, many)]
        ends = np.append(0, np.cumsum(many))[np.append(0, np.cumsum(count))]
        if len(self.known.size) > CACHE:
            self.known.trim()
        return ids, ends

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_column(pa.array(list(texts), pa.string()))
        return [ids[s:t] for s, t in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def cached_tokenizer(file: str) -> CachedTokenizer:
    """One for each worker process: its later tasks find the words of earlier ones."""
    return CachedTokenizer(file)
