"""Order-preserving packing of documents into token sequences of bounded length.

The documents of a partition form one token stream in input order. Where the stream may be cut is chosen by dynamic
programming over the candidate positions (document ends, sentence ends, and a coarse grid inside long sentences):

    best(j) = penalty(j) + min over i with c_j - c_i <= L of best(i) + L - (c_j - c_i)

Padding plus truncation penalties are minimal over all such cuts. best(i) + c_i does not depend on j, so the minimum
over the sliding window is kept in a monotone queue, and a stream of m candidates costs O(m).

Only a bounded part of the stream is held: when enough tokens are there, the plan is solved, all but its last
sequence are emitted, and the rest goes on with what follows. What remains at the end of a partition is cut at powers
of two, which need no padding. There is no shuffle; sequence ids carry the partition's number.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_CUT, SENTENCE_CUT, HARD_CUT = 0.0, 4.0, 16.0
CACHE_WORDS = 900_000
SOLVE_TOKENS = 1 << 19
GRID = 16
STOPS, CLOSING = (".", "!", "?", "\u2026", "\u3002"), "\"')]\u00bb\u201d"


def resolve_tokenizer(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers of the machine it runs on."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Growing(dict):
    """Numbers keys in the order in which they are first looked up; `fresh` has those not yet taken in."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n

    def take(self) -> list[str]:
        out, self.fresh = self.fresh, []
        return out


class Ragged:
    """Lists of ids one after another; item k is ids[offsets[k] : offsets[k] + lens[k]]."""

    def __init__(self) -> None:
        self.ids, self.offsets, self.lens = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.n_ids = self.n_items = 0

    def extend(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """Append items; capacity doubles, so growing costs the same per item at any size."""
        to_ids, to_items = self.n_ids + len(flat), self.n_items + len(lens)
        if to_ids > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(to_ids, 2 * len(self.ids)) - len(self.ids), np.uint32)))
        if to_items > len(self.lens):
            more = np.zeros(max(to_items, 2 * len(self.lens)) - len(self.lens), np.int64)
            self.offsets, self.lens = np.concatenate((self.offsets, more)), np.concatenate((self.lens, more))
        self.ids[self.n_ids : to_ids] = flat
        self.offsets[self.n_items : to_items] = self.n_ids + np.cumsum(lens) - lens
        self.lens[self.n_items : to_items] = lens
        self.n_ids, self.n_items = to_ids, to_items

    def gather(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all items in order, and the number of them per item."""
        lens = self.lens[items]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.offsets[items] - (ends - lens), lens) + np.arange(total)], lens


#: The vocabulary's own split rule over lower-case text, for the characters of PLAIN, where NFC changes nothing.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256, 257, ..."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordEncoder:
    """Token ids of whole texts from a cache of words.

    The vocabulary's pre-tokenizer drops white space and never joins what white space separates, so a text's ids are
    those of its blank- or line-feed-separated words in order. A word of plain Latin letters, digits and marks is split
    by the vocabulary's rule, and each new piece goes through the tokenizer's model once; any other word goes through
    the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces_only = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.letters = byte_letters()
        self.pieces, self.piece_ids = Growing(), Ragged()
        self._new_words()

    def _new_words(self) -> None:
        self.words, self.word_ids, self.stops = Growing(), Ragged(), np.zeros(0, bool)

    def _plain(self, word: str) -> bool:
        return PLAIN.fullmatch(word) is not None and not ("<|" in word and any(s in word for s in self.special))

    def _learn(self, fresh: list[str]) -> None:
        plain = list(map(self._plain, fresh))
        if len(self.pieces) > CACHE_WORDS:
            self.pieces, self.piece_ids = Growing(), Ragged()
        look = self.pieces.__getitem__
        split = [list(map(look, SPLIT.findall(w.lower()))) if p else None for w, p in zip(fresh, plain, strict=True)]
        if new := self.pieces.take():
            made = [e.ids for e in self.pieces_only.encode_batch_fast([p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in new], add_special_tokens=False)]
            lens = np.fromiter(map(len, made), np.int64, len(made))
            self.piece_ids.extend(np.fromiter(chain.from_iterable(made), np.uint32, int(lens.sum())), lens)
        other = iter([e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(fresh, plain, strict=True) if not p], add_special_tokens=False)] if not all(plain) else [])
        counts = np.fromiter((len(s) if s is not None else 0 for s in split), np.int64, len(split))
        flat, per = self.piece_ids.gather(np.fromiter(chain.from_iterable(s for s in split if s), np.int64, int(counts.sum())))
        upto = np.concatenate(([0], np.cumsum(per)))
        ends = np.cumsum(counts)
        a, b = upto[ends - counts], upto[ends]
        if all(plain):
            self.word_ids.extend(flat, b - a)
        else:
            whole = [flat[x:y].tolist() if p else next(other) for x, y, p in zip(a.tolist(), b.tolist(), plain, strict=True)]
            lens = np.fromiter(map(len, whole), np.int64, len(whole))
            self.word_ids.extend(np.fromiter(chain.from_iterable(whole), np.uint32, int(lens.sum())), lens)
        self.stops = np.concatenate((self.stops, np.fromiter((w.rstrip(CLOSING).endswith(STOPS) for w in fresh), bool, len(fresh))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of them per text, and a flag for each id that ends a sentence."""
        if len(self.words) > CACHE_WORDS:
            self._new_words()
        look = self.words.__getitem__
        parts = [list(map(look, t.replace("\n", " ").split(" "))) for t in texts]
        if fresh := self.words.take():
            self._learn(fresh)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        words = np.fromiter(chain.from_iterable(parts), np.int64, int(counts.sum()))
        out, lens = self.word_ids.gather(words)
        ends = np.cumsum(lens)
        stop = np.zeros(len(out), bool)
        stop[ends[self.stops[words] & (lens > 0)] - 1] = True
        upto = np.concatenate(([0], ends))
        per = np.diff(upto[np.concatenate(([0], np.cumsum(counts)))])
        return out, per, stop


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; it keeps its caches from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def plan_cuts(positions: list[int], penalties: list[float], length: int) -> list[int]:
    """Positions (first 0, last the stream's end) at which the cheapest plan cuts. Neighbours are at most `length` apart."""
    m = len(positions)
    best, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    pop, last, left, push = queue.pop, -1, queue.popleft, queue.append
    for j in range(1, m):
        c = positions[j]
        least = c - length
        while queue[0][2] < least:
            left()
        g, i, _ = queue[0]
        f = penalties[j] + length - c + g
        best[j], back[j] = f, i
        key = f + c
        while queue and queue[last][0] > key:
            pop()
        push((key, j, c))
    cuts, j = [], m - 1
    while j:
        cuts.append(positions[j])
        j = back[j]
    cuts.append(0)
    return cuts[::-1]


class Packer:
    """Collects documents of one partition and emits pieces."""

    def __init__(self, length: int, first_sequence: int, cut_costs: tuple[float, float, float]):
        self.length, self.sequence, self.costs = length, first_sequence, cut_costs
        self.ids: list[np.ndarray] = []
        self.stops: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int, int]] = []  # id, first id of it that is here, ids here, ids in all
        self.held = 0

    def add(self, doc: object, ids: np.ndarray, stops: np.ndarray) -> None:
        self.ids.append(ids)
        self.stops.append(stops)
        self.docs.append((doc, 0, len(ids), len(ids)))
        self.held += len(ids)

    def solve(self, final: bool) -> list[tuple]:
        if not self.held:
            return []
        ids, stops = np.concatenate(self.ids), np.concatenate(self.stops)
        n, length = len(ids), self.length
        lens = np.fromiter((d[2] for d in self.docs), np.int64, len(self.docs))
        doc_ends = np.cumsum(lens)
        cost = np.full(n + 1, -1.0)
        cost[np.flatnonzero(stops) + 1] = self.costs[1]
        cost[doc_ends] = self.costs[0]
        cost[[0, n]] = 0.0
        marks = np.flatnonzero(cost >= 0)
        gaps = np.diff(marks)
        step = min(GRID, length)
        for a, g in zip(marks[:-1][gaps > step].tolist(), gaps[gaps > step].tolist(), strict=True):
            cost[np.arange(a + step, a + g, step)] = self.costs[2]
        where = np.flatnonzero(cost >= 0)
        cuts = plan_cuts(where.tolist(), cost[where].tolist(), length)
        tail = cuts[-2]
        if final:
            cuts, rest = cuts[:-1], n - tail
            while rest:
                part = length if rest >= length else 1 << (rest.bit_length() - 1)
                cuts.append(cuts[-1] + part)
                rest -= part
            tail = n
        else:
            cuts = cuts[:-1]
        rows = self._pieces(ids, np.asarray(cuts, np.int64), doc_ends, lens)
        self._keep(ids, stops, tail, doc_ends)
        return rows

    def _pieces(self, ids: np.ndarray, cuts: np.ndarray, doc_ends: np.ndarray, lens: np.ndarray) -> list[tuple]:
        end = int(cuts[-1])
        edges = np.unique(np.concatenate((cuts, doc_ends[doc_ends < end])))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, a, "right")
        seq = np.searchsorted(cuts, a, "right") - 1
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        first = self.sequence
        self.sequence += len(cuts) - 1
        begins = doc_ends - lens
        rows = []
        for x, y, d, s, o in zip(a.tolist(), b.tolist(), doc.tolist(), seq.tolist(), (a - cuts[seq]).tolist(), strict=True):
            key, before, _, total = self.docs[d]
            rows.append((key, before + x - int(begins[d]), y - x, zlib.crc32(raw[4 * x : 4 * y]), total, first + s, o))
        return rows

    def _keep(self, ids: np.ndarray, stops: np.ndarray, tail: int, doc_ends: np.ndarray) -> None:
        kept, at = [], 0
        for (key, before, here, total), end in zip(self.docs, doc_ends.tolist(), strict=True):
            if end > tail:
                skip = max(0, tail - at)
                kept.append((key, before + skip, here - skip, total))
            at = end
        self.docs, self.held = kept, len(ids) - tail
        self.ids, self.stops = ([ids[tail:].copy()], [stops[tail:].copy()]) if self.held else ([], [])


def pack(
    docs: DataFrame,
    *,
    tokenizer: str = "word_bpe_49k.json",
    length: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    cut_costs: tuple[float, float, float] = (DOCUMENT_CUT, SENTENCE_CUT, HARD_CUT),
) -> DataFrame:
    """Pack all documents into sequences of at most `length` tokens; one row per piece of a document.

    Columns: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids.
    Null or empty text: one piece with the end id alone. A null id stays null. Repeated rows are packed as often as
    they occur, rows that share an id one by one. Ties between equally cheap plans go to the longer sequence. A long text
    is cut into as many pieces as it needs. An empty table gives no rows. Other columns are not read, so their names cannot
    clash. cut_costs: what a cut at a document's end, at a sentence's end and inside
    a sentence costs, in tokens of padding.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_encoder(resolve_tokenizer(tokenizer))
        packer = Packer(length, TaskContext.get().partitionId() << 36, cut_costs)
        sent: dict[int, np.ndarray] = {}  # by row, as ids may repeat
        number = 0

        def out(rows: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            made = [pa.array([k[1] for k in columns[0]], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])]
            names = schema.names[:7]
            if with_ids:
                made.append(pa.array([sent[k[0]][s : s + n].tolist() for k, s, n, *_ in rows], pa.list_(pa.int64())))
                live = {d[0][0] for d in packer.docs}
                for k in [k for k in sent if k not in live]:
                    del sent[k]
                names = schema.names
            return pa.RecordBatch.from_arrays(made, names)

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            at, n = 0, batch.num_rows
            while at < n:
                group, size = [], 0
                while at + len(group) < n and size < 2 << 20:
                    t = texts[at + len(group)].as_py() or ""
                    group.append(t)
                    size += len(t)
                ids, per, stops = encoder.encode(group)
                ends = np.cumsum(per)
                for key, a, b in zip(keys[at : at + len(group)], (ends - per).tolist(), ends.tolist(), strict=True):
                    full = np.append(ids[a:b], np.uint32(end_id))
                    if with_ids:
                        sent[number] = full
                    packer.add((number, key), full, np.append(stops[a:b], False))
                    number += 1
                at += len(group)
                if packer.held >= SOLVE_TOKENS:
                    if rows := packer.solve(False):
                        yield out(rows, arrow)
        if rows := packer.solve(True):
            yield out(rows, arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
