"""BPE over lower-cased words with an end-of-word mark: encoding by a contiguous rank array, and decoding.

A short word keeps two arrays: the boundaries of its parts and the rank of every adjacent pair. Each step scans the ranks
for the minimum (leftmost on ties), deletes the boundary between those two parts and refreshes the ranks beside it. Words
of more than ``LONG`` symbols take the same steps from a heap, as a scan for each merge would cost their length squared.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playwatch.llm.common import slices, texts
from playwatch.llm.pretokens import BEYOND, LETTERS, NUMBERS, SPACES, TwoAges, library, shown, worker_table

LONG = 256
NEVER = 1 << 60

# Fixed value: the vocabulary's splitting pattern, for characters below U+0250.
SPLIT_LATIN = re.compile(rf"[{LETTERS}]++|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]++")


class Spelled(TwoAges):
    """Words in the vocabulary's spelling of bytes -> ids."""

    def __init__(self, codec: WordCodec, limit: int):
        super().__init__(limit)
        self.make = codec.parts


class WordCodec(TwoAges):
    """Encoder and decoder for one vocabulary file: a table from words to their ids.

    Texts of characters below U+0250 are lower-cased and split here; of others the library normalises and splits each piece, whose
    Unicode tables they need. Words are encoded by the rank array either way.
    """

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__(limit)
        tables = library(path)
        self.normalizer, self.splitter = tables.normalizer, tables.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.at_added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        names = {i: t for t, i in (self.ids | added).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.spelled = Spelled(self, limit)

    def parts(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given in the vocabulary's spelling of bytes."""
        spelled = word + self.suffix
        bounds = [*range(len(word)), len(spelled)]
        if len(word) > LONG:
            bounds = self.merge_long(spelled, bounds)
        else:
            rank = self.ranks.get
            # of each part with the next; the last has none
            ranks = [rank((spelled[a:b], spelled[b:c]), NEVER) for a, b, c in zip(bounds, bounds[1:], bounds[2:], strict=False)] + [NEVER]
            while (least := min(ranks)) != NEVER:
                i = ranks.index(least)
                del bounds[i + 1], ranks[i + 1]
                start, end = bounds[i], bounds[i + 1]
                ranks[i] = rank((spelled[start:end], spelled[end : bounds[i + 2]]), NEVER) if i + 2 < len(bounds) else NEVER
                if i:
                    ranks[i - 1] = rank((spelled[bounds[i - 1] : start], spelled[start:end]), NEVER)
        return tuple([self.ids[spelled[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)])

    def merge_long(self, spelled: str, bounds: list[int]) -> list[int]:
        """The same merges with a heap of (rank, position) and links between the boundaries that are left."""
        ends = len(bounds) - 1
        after, before = list(range(1, ends + 2)), list(range(-1, ends))

        def pair(i: int) -> int:
            j = after[i]
            return NEVER if j >= ends else self.ranks.get((spelled[bounds[i] : bounds[j]], spelled[bounds[j] : bounds[after[j]]]), NEVER)

        now = [pair(i) for i in range(ends)]
        heap = [(r, i) for i, r in enumerate(now) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            gone = after[i]
            now[gone] = -1
            after[i] = after[gone]
            before[after[gone]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = pair(k)
                    if now[k] != NEVER:
                        heapq.heappush(heap, (now[k], k))
        left, i = [0], 0
        while i < ends:
            i = after[i]
            left.append(bounds[i])
        return left

    def make(self, word: str) -> tuple[int, ...]:
        return self.parts(shown(word))

    def ids_of(self, piece: str) -> Iterator[tuple[int, ...]]:
        """The ids of each word of a text without special strings."""
        if not BEYOND.search(piece):  # below U+0300 every text is composed already
            low = piece.lower()
            if not BEYOND.search(low):
                return map(self.__getitem__, SPLIT_LATIN.findall(low))
        return map(self.spelled.__getitem__, [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))])

    def encode(self, text: str) -> list[int]:
        self.turn()
        self.spelled.turn()
        pieces = self.at_added.split(text) if self.at_added else [text]
        out: list[int] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(self.added[piece])
            else:
                out.extend(chain.from_iterable(self.ids_of(piece)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space: the vocabulary's file names no decoder, so byte spelling and word ends stay."""
        return " ".join(map(self.names.__getitem__, ids))


def word_bpe(docs: DataFrame, path: str, digests: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns doc_id, n_tokens and, with ``digests``, the SHA-256 of the ids and of the decoded text; without, ``ids`` and
    ``decoded`` themselves. Null and empty texts have no ids and decode to the empty text; a very long text is encoded whole, and a
    very long word by a heap. A null doc_id and repeated rows pass through, a row each. An empty table gives no rows. Other columns
    are not read. ``path`` is the vocabulary's file on every machine.
    """
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_table(WordCodec, path)
        numbers = [str(i) for i in range(len(codec.names))]
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for part in slices(batch):
                counts, first, second = [], [], []
                for text in texts(part["text"]):
                    ids = codec.encode(text)
                    decoded = codec.decode(ids)
                    counts.append(len(ids))
                    first.append(sha(" ".join(map(numbers.__getitem__, ids))) if digests else ids)
                    second.append(sha(decoded) if digests else decoded)
                kind = pa.string() if digests else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())],
                    ["doc_id", "n_tokens", *(x.split()[0] for x in kinds.split(", "))],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
