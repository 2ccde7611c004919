"""Operator 3: token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a linked list of symbols; a heap holds the adjacent pairs that have a merge. The pair of the
lowest rank, leftmost first, is popped again and again; the count is the number of initial symbols less the merges
done, and no identifier is made. Pre-tokens never cross white space, so the counts of white-space-separated chunks add
up, and each worker remembers those it meets most. Normalisation and pre-token splitting of an unseen chunk are the
library's own components, read from the same file.

Defined cases: a null or empty text has 0 tokens and 0 bytes; the special strings of the file count as one token each
wherever they occur; whole texts are counted, however long; a null doc_id is kept as null; repeated rows are counted
each; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches

LIMIT = 2048
#: Chunks remembered by each Python worker (about 150 MB), and the longest remembered.
MEMORY, LONGEST = 1_000_000, 64
#: Letters and marks without an apostrophe, or a `<` or `|` that a special string might begin with.
_PLAIN = re.compile(r"([A-Za-z]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)")
_BLANKS = str.maketrans("\n\t\r", "   ")


class WordBPE(dict):
    """Chunk → number of tokens; a dictionary that counts what it misses and remembers a bounded part of it."""

    def __init__(self, data: str):
        super().__init__()
        spec, library = json.loads(data), Tokenizer.from_str(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("unk_token") or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("a BPE model without unknown token, subword prefix or byte fallback, and with plain special tokens, is needed")
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = {x: i for x, i in vocabulary.items() if len(x) == 1}
        self.last = {x[: len(x) - len(end)]: i for x, i in vocabulary.items() if x.endswith(end) and len(x) == 1 + len(end)}
        #: Pairs are keyed by both ids in one integer; a pair's rank is its place in the merges.
        self.bits = max(vocabulary.values()).bit_length()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocabulary[x] << self.bits | vocabulary[y]: i for i, (x, y) in enumerate(merges)}
        self.product = [vocabulary[x + y] for x, y in merges]
        self.marks: dict[str, int] = {}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        s = [*map(self.inner.get, word[:-1]), self.last.get(word[-1])]
        if None in s:  # symbols that the vocabulary lacks are left out
            s = [x for x in s if x is not None]
        n, bits, product, rank = len(s), self.bits, self.product, self.rank.get
        alive, shift = n, n.bit_length()
        heap = [r << shift | i for i, r in enumerate(map(rank, [x << bits | y for x, y in zip(s, s[1:])])) if r is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        s.append(-1)  # stands past both ends, and where a symbol was: no pair has it
        before, after = list(range(-1, n)), list(range(1, n + 1))
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> shift, top & ((1 << shift) - 1)
            j = after[i]
            if s[i] < 0 or rank(s[i] << bits | s[j]) != r:
                continue  # an older state of these two
            s[i], s[j], alive = product[r], -1, alive - 1
            after[i] = k = after[j]
            before[k], h = i, before[i]
            if (r := rank(s[h] << bits | s[i])) is not None:
                heapq.heappush(heap, r << shift | h)
            if (r := rank(s[i] << bits | s[k])) is not None:
                heapq.heappush(heap, r << shift | i)
        return alive

    def chunk(self, text: str) -> int:
        if text.isascii():
            if text.isalpha():  # one pre-token, whose bytes stand for themselves
                return self.merged(text.lower())
            if plain := _PLAIN.fullmatch(text):  # letters, then marks: two pre-tokens
                got = self.marks.get(plain[2])
                if got is None:
                    if len(self.marks) >= MEMORY:
                        self.marks.clear()
                    got = self.merged(plain[2])
                    if len(plain[2]) <= LONGEST:
                        self.marks[plain[2]] = got
                return self[plain[1]] + got
        total = len(self.special.findall(text))
        for part in self.special.split(text):
            total += sum(self.merged(w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)) if w) if part else 0
        return total

    def __missing__(self, text: str) -> int:
        got = self.chunk(text) if text else 0
        if len(text) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[text] = got
        return got

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, text.translate(_BLANKS).split(" "))) if text else 0


_MODELS: dict[int, WordBPE] = {}


def _counts(batches, data):
    if (key := hash(data.value)) not in _MODELS:
        _MODELS[key] = WordBPE(data.value)
    model = _MODELS[key]
    for batch in batches:
        got = pa.array([model.count(t.as_py()) for t in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), got], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``."""
    with open(vocabulary_path, encoding="utf-8") as f:  # a vocabulary file of the installation, a few MB
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    got = rows.mapInArrow(partial(_counts, data=data), "doc_id long, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
