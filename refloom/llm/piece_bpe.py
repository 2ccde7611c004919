"""Operator 2: sentencepiece BPE by a merge-type prefix table.

In BPE every prefix of a string has exactly one last token. The table stores it for each prefix: an automaton lists the
pieces that end there, and the last token is the piece that is compatible with the last token of the prefix before it,
that is, the pair, joined, is encoded as just that pair. The ids are then recovered backwards. No piece crosses from a
letter to a following space mark or to a punctuation mark that follows such a letter in no piece, nor over a line end that is
no piece, so a text is encoded unit by unit (space marks and what follows up to the next such place) and the units met most are remembered. Runs of spaces, whose pieces share one score and merge from the left, and characters
outside the vocabulary, which fall back to bytes, bound the table.

Defined cases: a null or empty text has no ids and decodes to the empty text; whole texts are encoded, however long; a
null doc_id is kept as null; repeated rows are encoded each; other columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import struct
from array import array
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Units, and pairs of tokens, remembered during a task (about 100 MB in all), and the longest unit remembered.
MEMORY, LONGEST = 250_000, 64
#: Units remembered as packed integers: these are made quickly, so only the most common ones are worth the memory.
PACKED = 100_000


def _fields(data: bytes):
    """Fields of a protocol buffer message: (number, int or bytes)."""

    def number(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = {1: (8, i), 5: (4, i)}.get(kind) or number(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id. Only what this encoder does is accepted: BPE, identity normalisation, byte fallback."""
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            d = dict(_fields(value))
            pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            rules = dict(_fields(value))
    if trainer.get(3) != 2 or not trainer.get(35) or rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
        raise ValueError("a BPE model with byte fallback, identity normalisation and a dummy prefix is needed")
    return pieces


class PieceBPE:
    """Encoder and decoder of one model; equal to the library's encode() and decode() without options."""

    def __init__(self, model: bytes):
        self.pieces = read_model(model)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind not in (UNKNOWN, 3, BYTE)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == 3 else " ⁇ ".encode() if kind == UNKNOWN else p.encode() for p, _, kind in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if p == SPACE or p.strip(SPACE):
                if SPACE in p[1:]:
                    raise ValueError(f"piece {p!r} crosses a space mark")
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.names = {p: str(i) for p, i in self.ids.items()}
        self.alphabet = {p for p in self.ids if len(p) == 1}
        lines = "" if "\n" in self.alphabet else "\n"
        joined = {(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1) if p[i + 1] in string.punctuation and re.match(r"[^\W\d_]", p[i])}
        free = [c for c in string.punctuation if not any(b == c and a.isalpha() for a, b in joined)]
        marks, signs = ("".join(map(re.escape, sorted(x))) for x in (free, {a for a, b in joined if b in free}))  # signs like ² are letters to the regex, and some pieces join them to a mark
        last = f"(?<![{signs}])" if signs else ""
        word = f"{SPACE}*[^\\W\\d_]++{last}(?=[{marks}])|" if marks else ""
        self.cut = re.compile(word + f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+" + f"|{lines}" * bool(lines))
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.units = _Units(self)

    def merges(self, text: str) -> list[str]:
        """Plain BPE of a short string: best score first, then leftmost."""
        s = list(text)
        heap = [(-self.score[a + b], i, a, b, i + 1) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.score]
        heapq.heapify(heap)
        nxt, prv = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        while heap:
            _, i, a, b, j = heapq.heappop(heap)
            if s[i] != a or j >= len(s) or nxt[i] != j or s[j] != b:
                continue
            s[i], s[j], nxt[i] = a + b, "", nxt[j]
            if nxt[i] < len(s):
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < len(s) and s[x] + s[y] in self.score:
                    heapq.heappush(heap, (-self.score[s[x] + s[y]], x, s[x], s[y], y))
        return [x for x in s if x]

    def compatible(self, before: str | None, token: str) -> bool:
        """Whether BPE encodes the two tokens, joined, as just these two (or the first token of a text as itself)."""
        got = self.pairs.get((before, token))
        if got is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            got = self.pairs[before, token] = self.merges((before or "") + token) == ([token] if before is None else [before, token])
        return got

    def table(self, text: str) -> list[str]:
        """The prefix table of a string over the alphabet without runs of space marks, read backwards."""
        if text in self.score and self.compatible(None, text):
            return [text]
        last: list[str | None] = [None] * (len(text) + 1)
        known = self.pairs.get
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - len(token)]
                good = known((before, token))
                if self.compatible(before, token) if good is None else good:
                    last[end] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def unit(self, unit: str) -> list[int]:
        """Ids of a run of space marks (perhaps none) and the characters up to the next one."""
        body = unit.lstrip(SPACE)
        marks, out = len(unit) - len(body), []
        body = SPACE + body if marks else body
        marks, at = max(0, marks - 1), 0
        for i in range(len(body) + 1):
            if i == len(body) or body[i] not in self.alphabet:
                tokens = self.table(body[at:i]) if i > at else []
                if at == 0 and marks:
                    alone = tokens[:1] == [SPACE]
                    tokens = self.merges(SPACE * (marks + alone)) + tokens[alone:]
                out += [self.ids[t] for t in tokens]
                if i < len(body):
                    out += [self.byte_ids[b] for b in body[i].encode()]
                at = i + 1
        return out

    def keys(self, text: str | None) -> list[str]:
        """Comma-joined ids of each unit of a text."""
        if not text:
            return []
        return list(map(self.units.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))

    def forget(self) -> None:
        """Free what was remembered: an idle worker shares its executor's memory with later stages."""
        self.units.clear()
        self.pairs.clear()

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for key in self.keys(text) for x in key.split(",")]

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, space marks to spaces, one leading space dropped, bytes to UTF-8 with replacements."""
        out, seen, held = [], False, bytearray()
        for i in [*ids, None]:
            if i is not None and self.pieces[i][2] == BYTE:
                held += self.raw[i]
                continue
            if held:
                out += _each_byte(bytes(held))
                held.clear()
            if i is not None:
                piece = self.raw[i].decode()
                first = not seen and not any(out)
                if first and piece.startswith(SPACE):
                    piece, seen = piece[1:], True
                out.append(piece.replace(SPACE, " "))
        return "".join(out)


def _each_byte(data: bytes) -> list[str]:
    """UTF-8 with one replacement character for each byte that belongs to no whole character."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return out


class _Units(dict):
    """Unit → comma-joined ids; bounded."""

    def __init__(self, owner: PieceBPE):
        super().__init__()
        self.owner = owner

    def __missing__(self, unit: str) -> str:
        own = self.owner
        if own.alphabet.issuperset(unit) and not unit.startswith(SPACE * 2):
            got = ",".join(map(own.names.__getitem__, own.table(unit)))
        else:
            got = ",".join(map(str, own.unit(unit)))
        if len(unit) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = got
        return got


_MODELS: dict[bytes, PieceBPE] = {}


def encoder(model: bytes) -> PieceBPE:
    key = hashlib.sha256(model).digest()
    if key not in _MODELS:
        _MODELS[key] = PieceBPE(model)
    return _MODELS[key]


def _slices(batches, rows: int = 500):
    """The same rows in smaller batches, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _encode(batches, model):
    bpe = encoder(model.value)
    packed = _Packed()
    for batch in _slices(batches):
        data = [b"".join(map(packed.__getitem__, bpe.keys(t.as_py()))) for t in batch.column(batch.num_columns - 1)]
        ends = np.cumsum([0, *map(len, data)]) // 4
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends)), ids], [*batch.schema.names[:-1], "n_tokens", "ids"])
    bpe.forget()


def _digest(batches, model):
    bpe = encoder(model.value)
    back = _Decoded(bpe)
    for batch in _slices(batches):
        out = []
        for t in batch.column(1):
            keys = bpe.keys(t.as_py())
            ids = ",".join(keys)
            text = b"".join(map(back.__getitem__, keys)).removeprefix(b" ") if keys else b""
            out.append((ids.count(",") + 1 if keys else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    bpe.forget()


class _Packed(dict):
    """Comma-joined ids → the same as 32-bit integers."""

    def __missing__(self, key: str) -> bytes:
        got = array("i", map(int, key.split(","))).tobytes()
        if len(key) <= 4 * LONGEST:
            if len(self) >= PACKED:
                self.clear()
            self[key] = got
        return got


class _Decoded(dict):
    """Comma-joined ids of a whole unit → its text in UTF-8. Encoded units hold whole characters, so units decode apart."""

    def __init__(self, owner: PieceBPE):
        super().__init__()
        self.owner = owner

    def __missing__(self, key: str) -> bytes:
        got = b"".join(self.owner.raw[int(x)] for x in key.split(",")).replace(SPACE.encode(), b" ")
        if len(key) <= 4 * LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[key] = got
        return got


def _broadcast(spark, model_path: str):
    with open(model_path, "rb") as f:  # a vocabulary file of the installation, under a few MB
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>)``, one row per row of ``docs``."""
    model = _broadcast(docs.sparkSession, model_path)
    return small_batches(docs).select("doc_id", "text").mapInArrow(partial(_encode, model=model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, and decoded again from its ids."""
    model = _broadcast(docs.sparkSession, model_path)
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_digest, model=model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
