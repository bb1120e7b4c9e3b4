"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

A model file is compiled into the parts of a transducer: the normaliser (the model's
rewriting rules, a trie whose accepting states emit the replacement of the longest
match; white space is squeezed, a space becomes the meta symbol, and one more goes in
front), the lexicon of pieces (a trie whose accepting states emit a piece at its weight;
pieces that the model's user defined come whole and unchanged), and the byte fallback (a
character outside the lexicon emits the pieces of its UTF-8 bytes). An input is
composed with it state by state, and the path of least weight in the tropical
semiring (min, +) gives the pieces.

* Unigram models: a piece weighs minus its score.
* BPE models: piece weights alone cannot give merge order, so the transducer also
  has the states of a bigram acceptor: two pieces may follow each other if merging
  their joined text gives back just the two, else the weight is infinite. A
  sequence of pieces is the BPE segmentation of its text exactly if each adjacent
  pair passes, so one path of finite weight is left, and one piece can end at any
  position of it.

No piece has the meta symbol after another character or contains a line feed, so
paths fall apart there and the weights add up: each such part is solved once and
kept in a bounded memory.

Defined results: a null or empty text has no pieces and decodes to the empty
text; text that the normaliser changes decodes to the changed text. A meta symbol in a text decodes to a space, as in the model's own library.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pointloom.llm._util import batches_of, column, in_small_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Parts of texts whose shortest path a Python worker keeps.
MEMORY_PARTS = 400_000

# Fixed values of the model file format.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
_UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + n]
        at += n


class _Memory(dict):
    """Solved parts in two generations of half the limit each; parts that are met again move to the young one."""

    def __init__(self, solve, limit: int):
        super().__init__()
        self.solve, self.half, self.old = solve, max(1, limit // 2), {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        found = self.old.get(part)
        if found is None:
            found = self.solve(part)
        self[part] = found
        return found


class Rewriter:
    """The model's rules as a transducer from text to text: at each place the longest rule that matches, or the character.

    The rules come as a double array over UTF-8 bytes and a table of replacements that end in a zero byte.
    """

    def __init__(self, charsmap: bytes):
        size = int.from_bytes(charsmap[:4], "little")
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist()
        self.table = charsmap[4 + size :]
        self.begins: dict[str, bool] = {}
        self.found: dict[int, str] = {}

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _walk(self, raw: bytes, at: int) -> tuple[int, int, bool]:
        """Length and table entry of the longest rule from ``at``, and whether the bytes ran out first."""
        units, length, entry = self.units, 0, -1
        node = self._step(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != raw[k]:
                return length, entry, False
            node ^= self._step(unit)
            if unit >> 8 & 1:
                length, entry = k + 1 - at, units[node] & 0x7FFFFFFF
        return length, entry, True

    def _begins(self, c: str) -> None:
        """Note whether a rule may start with this character."""
        length, _, more = self._walk(c.encode("utf-8", "replace"), 0)
        self.begins[c] = length > 0 or more

    def _entry(self, at: int) -> str:
        out = self.found[at] = self.table[at : self.table.index(b"\0", at)].decode()
        return out

    def __call__(self, text: str) -> str:
        begins = self.begins
        chars = set(text)
        for c in chars - begins.keys():
            self._begins(c)
        if not any(begins[c] for c in chars):
            return text
        out, plain, k, n = [], 0, 0, len(text)
        while k < n:
            if not begins[text[k]]:
                k += 1
                continue
            raw = text[k : k + 32].encode("utf-8", "replace")
            length, entry, _ = self._walk(raw, 0)
            if not length:
                k += 1
                continue
            out += [text[plain:k], self.found.get(entry) or self._entry(entry)]
            k += len(raw[:length].decode())
            plain = k
        out.append(text[plain:])
        return "".join(out)


class PieceTransducer:
    def __init__(self, model: bytes, memory_parts: int = MEMORY_PARTS):
        self.pieces, self.scores, self.kinds = [], [], []
        self.model_type, trainer, spec = _UNIGRAM, {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
            elif field == 2:
                trainer |= dict(_fields(value))
            elif field == 3:
                spec |= dict(_fields(value))
        self.model_type = trainer.get(3, _UNIGRAM)
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.rewrite = Rewriter(spec[2]) if spec.get(2) else None
        if _UNUSED in self.kinds or (_USER in self.kinds and self.model_type != _BPE) or self.model_type not in (_UNIGRAM, _BPE) or trainer.get(24, 0) or not self.escape:
            raise NotImplementedError("only BPE models, and unigram ones without users' pieces, whose pieces are all in use and whose white space is a prefix of words")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        self.bpe = self.model_type == _BPE
        lexicon = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _NORMAL}
        self.user = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _USER}
        whole = "|".join(map(re.escape, sorted(self.user, key=len, reverse=True)))  # the longest one that matches
        self.user_pattern = re.compile(f"({whole})") if whole else None
        if any("\n" in p or META in p.lstrip(META) for p in lexicon):
            self.part = re.compile(r"(?s).+")  # paths don't fall apart
        else:
            self.part = re.compile(f"\n|{META}+[^{META}\n]*|[^{META}\n]+")
        self.lexicon = lexicon
        self.trie: dict = {}
        for p, i in lexicon.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        low = min((self.scores[i] for i in lexicon.values()), default=0.0)
        self.unknown_weight = _UNKNOWN_PENALTY - low
        self.follows: dict[int, dict[int, bool]] = {-1: {}}
        self.n_follows = 0
        self.memory = _Memory(self._solve, memory_parts)
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(META, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    # normaliser
    def normalise(self, text: str) -> str:
        if self.rewrite is not None:
            if self.user_pattern is None:
                text = self.rewrite(text)
            else:  # every other part is a user's piece
                parts = self.user_pattern.split(text)
                text = "".join(p if k % 2 else self.rewrite(p) for k, p in enumerate(parts))
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (META if self.prefix else "") + text.replace(" ", META)
        return text.rstrip(META) if self.squeeze else text  # written meta symbols at the end go too

    # bigram acceptor of BPE models
    def _label(self, i: int) -> str:
        return self.pieces[i] if i < len(self.pieces) else chr(i - len(self.pieces))

    def merge(self, text: str) -> list[str]:
        """Merge best-scored neighbours, leftmost first, until none are left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = self.lexicon.get(parts[k] + parts[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        x, y = self._label(a), self._label(b)
        if self.n_follows > MEMORY_PARTS:
            self.follows, self.n_follows = {-1: {}}, 0
        self.n_follows += 1
        found = self.follows.setdefault(a, {})[b] = self.merge(x + y) == [x, y]
        return found

    # composition and shortest path
    def _solve(self, part: str) -> bytes:
        """The piece ids of a part, as packed int32."""
        n, size = len(part), len(self.pieces)
        cost = [math.inf] * (n + 1)
        back = [0] * (n + 1)
        last = [-1] * (n + 1)
        cost[0] = 0.0
        bpe, scores, trie, may_follow = self.bpe, self.scores, self.trie, self._may_follow
        for i in range(n):
            here = cost[i]
            if here == math.inf:
                continue
            before, node, j = last[i], trie, i
            known = self.follows.get(before, {})
            while j < n:
                node = node.get(part[j])
                if node is None:
                    break
                j += 1
                piece = node.get("")
                if piece is None:
                    continue
                weight = here + 1.0 if bpe else here - scores[piece]
                if weight < cost[j]:
                    if bpe and before >= 0:
                        ok = known.get(piece)
                        if not (may_follow(before, piece) if ok is None else ok):
                            continue
                    cost[j], back[j], last[j] = weight, i, piece
            c = part[i]
            if c not in trie or "" not in trie[c]:  # fall back to bytes
                weight = here + (1.0 if bpe else self.unknown_weight)
                piece = size + ord(c)
                if weight < cost[i + 1] and not (bpe and before >= 0 and not may_follow(before, piece)):
                    cost[i + 1], back[i + 1], last[i + 1] = weight, i, piece
        out: list[int] = []
        j = n
        while j:
            piece = last[j]
            if piece < size:
                out.append(piece)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(chr(piece - size).encode("utf-8", "replace")))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            j = back[j]
        return np.array(out[::-1], np.int32).tobytes()

    def encode_packed(self, text: str) -> bytes:
        text = self.normalise(text)
        if self.user_pattern is None:
            return b"".join(map(self.memory.__getitem__, self.part.findall(text)))
        out = []
        for k, p in enumerate(self.user_pattern.split(text)):
            out += [np.int32(self.user[p]).tobytes()] if k % 2 else map(self.memory.__getitem__, self.part.findall(p))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(model: bytes) -> PieceTransducer:
    return PieceTransducer(model)


def model_bytes(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns ``keep`` (all but text, if None), n_pieces, piece_ids, and whether they decode to the text.

    The model's bytes (a file of fixed size) go to the executors by broadcast.
    Columns of the added names in the input are replaced.
    """
    added = ("n_pieces", "piece_ids", "decodes")
    names = [x for x in (docs.columns if keep is None else keep) if x != "text" and x not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            packed, same = [], []
            for t in column(batch, "text"):
                text = t.as_py() or ""
                raw = machine.encode_packed(text)
                packed.append(raw)
                same.append(machine.decode(np.frombuffer(raw, np.int32).tolist()) == text)
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield batches_of({x: column(batch, x) for x in names} | {"n_pieces": pa.array(counts), "piece_ids": ids, "decodes": pa.array(same, pa.bool_())})

    schema = T.StructType(
        [docs.schema[x] for x in names]
        + [T.StructField("n_pieces", T.LongType()), T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decodes", T.BooleanType())]
    )
    return in_small_batches(docs).select(*names, "text").mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: bytes) -> DataFrame:
    """``rows`` with a column ``text`` decoded from ``piece_ids`` (null ids: the empty text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [x for x in rows.columns if x != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            texts = [machine.decode(x.as_py() or []) for x in column(batch, "piece_ids")]
            yield batches_of({x: column(batch, x) for x in names} | {"text": pa.array(texts, pa.string())})

    return in_small_batches(rows).select(*names).mapInArrow(run, T.StructType([rows.schema[x] for x in names] + [T.StructField("text", T.StringType())]))
