"""Splitting text into pre-tokens of the byte-level vocabulary, and tables of what each becomes, one for a worker process.

Strings of special tokens are cut out first. A piece whose characters all lie below U+0250 takes a short pattern with explicit
letter and number ranges; other pieces are split by the library's pre-tokenizer, whose Unicode tables they need. Either way each
pre-token is looked up, and only one that the table lacks is encoded, so ids are the library's. Columns of such texts are split by
the classes of neighbouring bytes instead, and only their pre-tokens that are new to a task's worker become Python strings.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters, numbers and white space below U+0250 by Unicode general category and White_Space.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
SPACES = "\t-\r \x85\xa0"

#: The vocabulary's own splitting pattern, restated for that range, with the commonest pre-tokens first.
SPLIT = re.compile(
    rf"(?: |)[{LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]++| ?[^{SPACES}{LETTERS}{NUMBERS}]++|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]++"
)
BEYOND = re.compile("[^\x00-ɏ]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else U+0100 and on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, extra = dict.fromkeys(plain), iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


SHOWN = dict(enumerate(byte_characters()))


def shown(word: str) -> str:
    """A word's UTF-8 bytes as the vocabulary spells them."""
    return word.encode("utf-8").decode("latin-1").translate(SHOWN)


def library(path: str):
    """The tokenizers library's tokenizer of a vocabulary file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class TwoAges(dict):
    """A table filled on a miss by ``make(key)``. Once it holds ``limit`` entries they become the old age; what is used again comes
    back from there, the rest goes when the next age ends. So frequent entries stay, and 2 * ``limit`` are held at most."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def make(self, key: str) -> object:
        raise NotImplementedError

    def __missing__(self, key: str) -> object:
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class PretokenTable(TwoAges):
    """Pre-token -> ``value(ids)``; ``first`` holds values that stay."""

    def __init__(self, path: str, value: Callable[[list[int]], object], limit: int = 600_000, first: dict | None = None):
        super().__init__(limit)
        self.first, self.value = first or {}, value
        self.library = library(path)
        self.model, self.splitter = self.library.model, self.library.pre_tokenizer
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {s: value([i]) for s, i in special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else re.compile("((?!))")

    def make(self, word: str) -> object:
        found = self.first.get(word)
        return self.value([t.id for t in self.model.tokenize(shown(word))]) if found is None else found

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if BEYOND.search(piece):
            return [piece[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(piece)]
        return SPLIT.findall(piece)

    def values_of(self, text: str) -> Iterator:
        """The values of a text's pre-tokens in order."""
        self.turn()
        if not self.at_special.search(text):
            return map(self.__getitem__, self.words(text))
        pieces = enumerate(self.at_special.split(text))
        return chain.from_iterable([self.special[p]] if k % 2 else map(self.__getitem__, self.words(p)) for k, p in pieces)


#: White space 0, letters 1, numbers 2, others 3, by code point below U+0250; white space from U+0080 on is left to the pattern.
CLASSES = np.full(0x250, 3, np.uint8)
for _class, _members in enumerate((SPACES, LETTERS, NUMBERS)):
    CLASSES[[c for c in range(0x250) if re.match(f"[{_members}]", chr(c))]] = _class


def pretoken_lists(column: pa.StringArray) -> pa.ListArray:
    """The pre-tokens of each text of a column without nulls, of characters below U+0250 but U+0085 and U+00A0.

    A pre-token starts where the class changes, but not behind a space, which belongs to what follows it. Of white space before
    something else the last character starts one too. An apostrophe that starts one takes the endings of contractions along.
    """
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    size = int(ends[-1] - ends[0])
    # zeros behind the last text stand for no character
    raw = np.zeros(size + 3, np.uint8)
    if size:
        raw[:size] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    edge = np.zeros(size + 3, bool)
    edge[ends] = True

    kind = CLASSES[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    kind[lead] = kind[lead + 1] = CLASSES[(raw[lead].astype(np.int32) & 0x1F) << 6 | raw[lead + 1] & 0x3F]
    start = edge.copy()
    change = kind[1:] != kind[:-1]
    start[1:] |= change & (raw[:-1] != 0x20)
    start[:-1] |= change & (kind[:-1] == 0) & ~edge[1:]

    quote = np.flatnonzero(start[:size] & (raw[:size] == 0x27))
    one, two = raw[quote + 1], raw[quote + 2]
    short = np.isin(one, list(b"stmd")) & ~edge[quote + 1]
    long = (np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~edge[quote + 1] & ~edge[quote + 2]
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[np.minimum(quote[long] + 3, size)] = True

    at = np.flatnonzero(start[:size])
    bounds = np.append(at, size).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(raw))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), words)


class ColumnTable:
    """Pre-token -> ``value(ids)`` for whole columns, as Arrow arrays: the library encodes a pre-token at its first sight.

    Beyond ``limit`` pre-tokens the half used most stays; those of one column come on top. Texts with special strings or with
    characters that ``pretoken_lists`` does not split go through a PretokenTable one by one.
    """

    def __init__(self, path: str, value: Callable[[list[int]], bytes], limit: int = 1_000_000):
        self.table, self.limit = PretokenTable(path, value), limit
        self.odd = "|".join([BEYOND.pattern, "[\x85\xa0]", *map(re.escape, self.table.special)])
        self.known, self.values, self.uses = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.int64)

    def trim(self) -> None:
        """To be called between columns."""
        if len(self.known) > self.limit:
            kept = np.argpartition(-self.uses, self.limit // 2)[: self.limit // 2]
            self.known, self.values, self.uses = self.known.take(pa.array(kept)), self.values.take(pa.array(kept)), self.uses[kept] // 2

    def values_of(self, words: pa.StringArray) -> pa.BinaryArray:
        """The value of each word."""
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(found.is_null())
        place = found.fill_null(-1).to_numpy().copy()
        place[place < 0] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.values = pa.concat_arrays([self.values, pa.array(map(self.table.make, new.to_pylist()), pa.binary())])
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        self.uses[place] += np.bincount(coded.indices.to_numpy(), minlength=len(place))
        return self.values.take(pa.array(place)).take(coded.indices)

    def joined(self, column: pa.StringArray) -> pa.BinaryArray:
        """The joined values of each text's pre-tokens, null as the empty text."""
        self.trim()
        column = column.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(column, self.odd)
        lists = pretoken_lists(pc.if_else(odd, "", column))
        found = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.values_of(lists.values)), pa.scalar(b"", pa.binary()))
        apart = [b"".join(self.table.values_of(t)) for t in column.filter(odd).to_pylist()]
        return pc.replace_with_mask(found, odd, pa.array(apart, pa.binary()))


_TABLES: dict = {}


def worker_table(kind: Callable, *key: object, **more: object) -> object:
    """``kind(*key, **more)``, made once for each Python worker process and kept for its later tasks; ``key`` tells tables apart."""
    name = (kind, *key)
    if name not in _TABLES:
        # a worker serves one operator at a time: what others left behind would only take memory
        _TABLES.clear()
        _TABLES[name] = kind(*key, **more)
    return _TABLES[name]
