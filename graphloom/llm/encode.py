"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: corpus-level merge replay. Texts are cut into words by the vocabulary's
pattern, and each distinct word of a block of the corpus is encoded once: the bytes of all
new words lie in one array of linked symbols, an inverted index holds the
positions of every pair that some merge joins, and the merges are applied to the whole block in
rank order; a merge touches only the symbols beside it, and puts their new pairs
into the index. No word is scanned again, so a word of a million bytes costs about
as much as many short words of the same length.

A block is a part of a partition's texts, of about ``BLOCK_CHARS`` characters; words
don't depend on each other, so the blocks give what one block of the whole corpus
would give, and no text and no vocabulary of the corpus is ever shuffled. Words
encoded once stay in a bounded table of the worker process for all blocks and tasks after.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrow import pieces

#: Where the public vocabulary files lie, unless given.
TOKENIZERS = "/opt/tokenizers"
BLOCK_CHARS = 4_000_000
#: Characters of words in each of the two generations of a worker's table of encoded words.
KEPT_CHARS = 8_000_000
#: Fixed value: the pattern that cuts text into words for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Byte ids and merges of a byte-level BPE file (JSON of the tokenizers library)."""

    def __init__(self, model: str) -> None:
        said = json.loads(model)["model"]
        ids = said["vocab"]
        self.byte_id = [ids[x] for x in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(said["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word: all merges in rank order over all words at once."""
        merges, byte_id = self.merges, self.byte_id
        symbols: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(symbols))
            symbols.extend([byte_id[b] for b in w.encode("utf-8", "replace")])
        starts.append(len(symbols))
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        for i in range(len(words)):
            if starts[i + 1] > starts[i]:
                after[starts[i + 1] - 1] = -1
                before[starts[i]] = -1
        # Positions by the rank of the pair that begins there.
        index: dict[int, list[int]] = {}
        rule: dict[int, tuple[int, int, int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (hit := merges.get((symbols[i], symbols[j]))):
                if hit[0] in index:
                    index[hit[0]].append(i)
                else:
                    index[hit[0]] = [i]
                    rule[hit[0]] = (symbols[i], symbols[j], hit[1])
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            places = index.pop(rank)
            left, right, new = rule.pop(rank)
            places.sort()
            for i in places:
                j = after[i]
                if symbols[i] != left or j < 0 or symbols[j] != right:
                    continue
                symbols[i], symbols[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if hit := merges.get((new, symbols[k])):
                        if hit[0] in index:
                            index[hit[0]].append(i)
                        else:
                            index[hit[0]] = [i]
                            rule[hit[0]] = (new, symbols[k], hit[1])
                            heapq.heappush(ranks, hit[0])
                h = before[i]
                if h >= 0 and (hit := merges.get((symbols[h], new))):
                    if hit[0] in index:
                        index[hit[0]].append(h)
                    else:
                        index[hit[0]] = [h]
                        rule[hit[0]] = (symbols[h], new, hit[1])
                        heapq.heappush(ranks, hit[0])
        out = []
        for a, b in zip(starts, starts[1:], strict=False):
            out.append(tuple([s for s in symbols[a:b] if s >= 0]))
        return out


class Known:
    """Words encoded already, in two generations of bounded size: when the new one is full it becomes the old one.

    Words that are met again move to the new generation, so frequent words stay.
    """

    def __init__(self, chars: int) -> None:
        self.chars, self.held, self.new, self.old = chars, 0, {}, {}

    def keep(self, word: str, ids: tuple[int, ...]) -> None:
        if self.held > self.chars:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[word] = ids
        self.held += len(word) + 8

    def recall(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of those of ``words`` that are known."""
        out = {}
        for w in words:
            ids = self.new.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is None:
                    continue
                self.keep(w, ids)
            out[w] = ids
        return out


def _encode(model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        # The broadcast variable lives as long as the worker: the vocabulary is read, and words are remembered, once for all its tasks.
        if not hasattr(model, "_tables"):
            model._tables = Vocabulary(model.value), Known(KEPT_CHARS), regex.compile(PATTERN).findall
        vocabulary, known, cut = model._tables
        for batch in batches:
            for part in pieces(batch, 1, BLOCK_CHARS):
                texts = [cut(text) if text else () for text in part.column(1).to_pylist()]
                every = set().union(*texts)
                table = known.recall(every)
                fresh = sorted(every.difference(table))
                for word, ids in zip(fresh, vocabulary.replay(fresh), strict=True):
                    table[word] = ids
                    known.keep(word, ids)
                ids, ends = array("i"), array("i", [0])
                for words in texts:
                    for w in words:
                        ids.extend(table[w])
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary_file: str | None = None) -> DataFrame:
    """``id, ids``: the token ids of each text, without special tokens.

    An empty or null text has the empty list. The strings of special tokens are
    ordinary text. Repeated rows and ids are kept, other columns ignored, texts taken
    whole whatever their length. ``vocabulary_file``: a byte-level BPE file with the
    pattern above (the default is byte_bpe_50k).
    """
    path = vocabulary_file or f"{TOKENIZERS}/byte_bpe_50k.json"
    with open(path, encoding="utf-8") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode(model), f"id {kind}, ids array<int>")
