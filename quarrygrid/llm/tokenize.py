"""Fast, exact use of a ``tokenizers`` file over many texts.

The library spends most of its time on words it has met before.  `MemoEncoder` cuts a text at
places where the library's own pre-tokenizer is certain to cut as well, looks the parts up in a
bounded memo, and hands only parts not met yet to the library.  What it returns equals
``Tokenizer.encode(text, add_special_tokens=False).ids``; special-token strings inside a text
are ordinary text (``encode_special_tokens``).

* byte-level files: a single space between two non-blank characters is a sure cut, because every
  pattern that may start with a space takes it together with what follows;
* word-level files that drop white space: every space is a sure cut.

New parts go to the library side by side in one string, and the ids are dealt back by the bytes
that each token stands for; wherever that count does not come out, each part goes in alone.  A
word-level file's parts are first cut into its pattern's tokens, which are fewer; that is done
for Latin-1 characters, whose classes are listed here, and other parts go in alone.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Every character that Python or Unicode takes for white space, but the space.
_BLANKS = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Letters, numbers and white space of Latin-1, as Unicode classes them, and the
#: word-level pattern over them; the space stands for the end of a part.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \u0085\u00a0"
_LATIN_WORD = re.compile(rf" |'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Latin-1 letters, then ASCII marks that do not begin with an apostrophe: two tokens of the byte-level pattern.
_WORD_AND_MARKS = re.compile(rf"([{_L}]+)([!-&(-/:-@\[-`{{-~][!-/:-@\[-`{{-~]*)").fullmatch
_SURE = re.compile(r"(?<=\S) (?=\S)")


class _Memo(dict):
    """Gives every new key the next number and remembers it in `new`."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.new: list[str] = []
        self.next = first

    def __missing__(self, key):
        self[key] = n = self.next
        self.next = n + 1
        self.new.append(key)
        return n


class _Flat:
    """Token ids of numbered parts, one after another in a single array."""

    def __init__(self):
        self.ids = np.empty(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n = np.zeros(1 << 14, np.int64)
        self.parts = self.used = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, numbers: np.ndarray | None = None) -> None:
        """Parts with these ids; they take the next numbers, or those given."""
        m = len(ids)
        numbers = np.arange(self.parts, self.parts + len(lengths)) if numbers is None else numbers
        top = int(numbers.max()) + 1 if len(numbers) else 0
        while self.used + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while top > len(self.n):
            self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n))
        self.ids[self.used : self.used + m] = ids
        self.n[numbers] = lengths
        self.at[numbers] = self.used + np.cumsum(lengths) - lengths
        self.parts, self.used = max(self.parts, top), self.used + m

    def take(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[parts]
        ends = np.cumsum(n)
        if not len(parts) or not ends[-1]:
            return np.empty(0, np.uint32), n
        return self.ids[np.repeat(self.at[parts] - ends + n, n) + np.arange(ends[-1])], n


def load(path: str):
    """The tokenizer of the file, run in the calling thread alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class MemoEncoder:
    """Encodes texts with the tokenizer file at `path`.

    max_parts and max_chars (of parts new to it) bound the memo; a full memo is emptied, so memory does not
    grow with the texts.  Empty texts have no ids.
    """

    def __init__(self, path: str, max_parts: int = 600_000, max_chars: int = 1 << 26):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.tokenizer, self.max_parts, self.max_chars = load(path), max_parts, max_chars
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token) - 4 * (not self.byte_level and token.endswith("</w>") and token != "</w>")
        self.clear()

    def clear(self) -> None:
        self.chars = 0
        self.parts, self.part_ids = _Memo(), _Flat()
        self.tokens, self.token_ids = _Memo(1), _Flat()
        self.tokens[" "] = 0
        self.token_ids.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        if self.parts.next > self.max_parts or self.chars > self.max_chars:
            self.clear()
        keys, counts = [], []
        for text in texts:
            part = self.cut(text)
            keys.extend(map(self.parts.__getitem__, part))
            counts.append(len(part))
        self.learn()
        parts = np.array(keys, np.int64)
        ids, n = self.part_ids.take(parts)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)] if counts else []
        return np.split(ids, ends[:-1]) if len(ends) else []

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.byte_level:
            return text.split(" ")
        if text[0] == " " or text[-1] == " " or "  " in text or any(b in text and (f" {b}" in text or f"{b} " in text) for b in _BLANKS):
            first, *rest = _SURE.split(text)
        else:
            first, *rest = text.split(" ")
        # What starts a text has no space before it: marked by one more space, which no part starts with.
        return ["  " + first, *rest]

    def learn(self) -> None:
        self.chars += sum(map(len, self.parts.new))
        if self.byte_level:
            self.learn_bytes()
            return
        new, self.parts.new = self.parts.new, []
        for k in range(0, len(new), 4000):
            self.part_ids.add(*self.together(new[k : k + 4000]))

    def learn_bytes(self) -> None:
        """A word with marks behind it is put together from the word's ids and the marks' ids."""
        new, first = self.parts.new, self.parts.next - len(self.parts.new)
        whole, made, pairs = [], [], []
        for k, part in enumerate(new):  # new grows as words and marks are looked up, which are whole
            if m := _WORD_AND_MARKS(part):
                made.append(first + k)
                pairs += (self.parts[m[1]], self.parts["  " + m[2]])
            else:
                whole.append(k)
        self.parts.new = []
        for k in range(0, len(whole), 4000):
            numbers = whole[k : k + 4000]
            ids, lengths = self.together([part[2:] if (part := new[n]).startswith("  ") else " " + part for n in numbers])
            self.part_ids.add(ids, lengths, first + np.array(numbers))
        if made:
            ids, lengths = self.part_ids.take(np.array(pairs))
            self.part_ids.add(ids, lengths.reshape(-1, 2).sum(axis=1), np.array(made))

    def together(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, and how many each has."""
        joint = [not part.startswith(" ") for part in some] if self.byte_level else [not (part.isascii() or max(part) <= "ÿ") for part in some]
        alone = [k for k, x in enumerate(joint) if x]
        with_others = [part for part, x in zip(some, joint, strict=True) if not x] if alone else some
        ids, lengths = self.side_by_side(with_others) if self.byte_level else self.by_words(with_others)
        if not alone:
            return ids, lengths
        others, single = iter(np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []), iter(self.library([some[k] for k in alone]))
        each = [next(single) if x else next(others) for x in joint]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def side_by_side(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts that the library surely cuts apart, in one call."""
        ids = self.library([("" if self.byte_level else " ").join(some)])[0]
        want = np.cumsum(np.array([len(part.encode()) for part in some], np.int64))
        have = np.concatenate([[0], np.cumsum(self.size[ids])])
        ends = np.searchsorted(have, want)
        if len(want) and (have[-1] != want[-1] or (have[ends] != want).any()):
            each = self.library(some)
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(np.concatenate([[0], ends]))

    def by_words(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Latin-1 parts by way of the pattern's own tokens, which far fewer parts share out."""
        if not some:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        tokens = np.array(list(map(self.tokens.__getitem__, _LATIN_WORD.findall(" ".join(some).lower()))), np.int64)
        new, self.tokens.new = self.tokens.new, []
        for k in range(0, len(new), 4000):
            self.token_ids.add(*self.side_by_side(new[k : k + 4000]))
        ids, n = self.token_ids.take(tokens)
        ends = np.append(np.cumsum(n)[tokens == 0], len(ids))
        return ids, np.diff(np.concatenate([[0], ends]))

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
