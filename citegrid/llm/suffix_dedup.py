"""Removal of repeated byte strings, by suffix arrays of content-chosen shards.

A byte goes if a string of WIDTH = 50 bytes that covers it also starts in a document with a smaller id.

1.  Every 50-byte string is assigned to the least hash of its 20-byte substrings. Equal strings have equal least hashes,
    and neighbours mostly share theirs, so a text falls into runs of strings with one least hash. One message per block of
    documents and shard carries the hashes; those that occur in one document only are done.
2.  The documents' other runs, each as one piece of text with its places, are sent to shards by that hash, so equal
    strings meet in one shard, whatever documents they are in. Equal pieces are stored once.
3.  Each shard's pieces get a suffix array by induced sorting: suffixes are classified, leftmost-smaller substrings are
    sorted and named, the string of their names is sorted in the same way, and its order induces that of all suffixes in
    two passes, which place buckets as soon as all they depend on is placed.
4.  Permuted common prefixes (in text order, with the predecessor in the suffix array) are computed byte for byte up to 50,
    as longer ones change nothing; they split the array into groups of equal strings, whose least document id decides.
5.  The removed intervals go back to the documents. Texts are exchanged by id once, for steps 2 and 5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm.shared import mix, text_blocks

WIDTH, GRAM = 50, 20
WINDOW = WIDTH - GRAM + 1
#: Bytes of pieces that one suffix array covers at most, unless a single least hash has more.
ARRAY_BYTES = 1 << 19
BLOCK = 8 << 20


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; the end is padded with zeros."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf),), "<u8", buffer=padded.data, strides=(1,)).copy()


def least_hashes(buf: np.ndarray) -> np.ndarray:
    """For each position the least hash of the 20-byte strings that start in the WINDOW positions from it on."""
    w = words8(buf)
    n = len(w)
    h = w.copy()
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h[: n - 8] ^= w[8:]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h[: n - 12] ^= w[12:]
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    size = 1
    while size * 2 <= WINDOW:
        h[: n - size] = np.minimum(h[: n - size], h[size:])
        size *= 2
    rest = WINDOW - size
    h[: n - rest] = np.minimum(h[: n - rest], h[rest:])
    return h


def runs_of(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 50-byte strings with one least hash: hash, first position in the block, number of strings, document."""
    lens = block.ends - block.starts
    long = np.flatnonzero(lens >= WIDTH)
    if not len(long):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    low = least_hashes(block.buf)
    change = np.concatenate(([True], low[1:] != low[:-1]))
    valid = np.zeros(len(low) + 1, np.int8)
    np.add.at(valid, block.starts[long], 1)
    np.add.at(valid, block.ends[long] - WIDTH + 1, -1)
    inside = np.cumsum(valid[:-1], dtype=np.int8) > 0
    change[block.starts[long]] = True
    first = np.flatnonzero(change & inside)
    doc = np.searchsorted(block.ends, first, "right")
    stop = block.ends[doc] - WIDTH + 1
    until = np.minimum(np.concatenate((first[1:], [len(low)])), stop)
    return low[first], first, until - first, doc


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of numbers in 0..letters-1 by induced sorting; the empty suffix is least and left out."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    edge = np.concatenate((np.flatnonzero(text[:-1] != text[1:]), [n - 1])).astype(np.int32)
    run = np.diff(np.concatenate((np.array([-1], np.int32), edge)))
    small = np.repeat(np.concatenate((text[edge[:-1]] < text[edge[:-1] + 1], [False])), run)  # S-type
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms):
        order, name = _named(text, lms, letters)
        if int(name[-1]) + 1 < len(lms):
            by_place = np.empty(len(lms), np.int32)
            by_place[order] = name
            order = suffix_array(by_place, int(name[-1]) + 1)
        lms = lms[order]
    return _induce(text, letters, small, lms, np.repeat(edge + np.int32(1), run))


def _named(text: np.ndarray, lms: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """The leftmost-smaller substrings in order (as indexes into lms), and their names: equal ones get one name.

    They are compared some letters at a time, as one number; only those that are equal so far and go on are looked at
    again. Where one ends, the other can only go on with letters of the larger type, so the one that ends is greater.
    """
    n, m = len(text), len(lms)
    bits = int(letters + 1).bit_length()
    per, pad = 63 // bits, (1 << bits) - 1
    letter = np.zeros(n + 1, np.int64)  # 0: the end of the text
    letter[:n] = text
    letter[:n] += 1
    stop = np.concatenate((lms[1:] + 1, [n + 1]))

    def word(which: np.ndarray | slice, skip: int) -> np.ndarray:
        at, end = lms[which] + skip, stop[which]
        out = np.zeros(len(at), np.int64)
        for k in range(per):
            out = (out << bits) | np.where(at + k < end, letter[np.minimum(at + k, n)], pad)
        return out

    key = word(slice(None), 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    size, skip = (stop - lms)[order], per
    while True:
        tied = ~new | ~np.concatenate((new[1:], [True]))
        open_ = np.flatnonzero(tied & (size >= skip))  # one that ends just here may be tied with one that goes on
        if not len(open_):
            return order, np.cumsum(new) - 1
        group = np.cumsum(new)[open_]
        key = word(order[open_], skip)
        by = np.lexsort((key, group))
        order[open_] = order[open_][by]
        key = key[by]
        new[open_[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        size[open_] = size[open_][by]
        skip += per


def _induce(text: np.ndarray, letters: int, small: np.ndarray, lms: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the leftmost-smaller ones: first the larger type, then the smaller one.

    In a bucket (one first letter, one type) suffixes are ordered by the place of what follows their run of that letter.
    That is in a bucket to the left for the larger type and to the right for the smaller one. A bucket is placed as soon as
    all it depends on is, so a pass takes as many rounds as the longest dependency has buckets, not one for each bucket.
    after: where each position's run of one letter ends.
    """
    n = len(text)
    tail = np.cumsum(np.bincount(text, minlength=letters))
    place = np.full(n + 1, -1, np.int32)  # the empty suffix, at n, is least
    out = np.empty(n + 1, np.int32)  # suffixes by place, one further on
    out[0] = n
    if len(lms):
        chars = text[lms]
        count = np.bincount(chars, minlength=letters)
        place[lms] = (tail - np.cumsum(count))[chars] + np.arange(len(lms))
        out[place[lms] + 1] = lms
    starts = np.concatenate((np.zeros(1, np.int32), after[:-1])) != after  # first of a run
    for kind in (False, True):
        members = np.flatnonzero(small == kind).astype(np.int32)
        size = np.bincount(text[members], minlength=letters)
        if len(members):
            # a place wakes the bucket of what stands before it, if that is the last of a run of the same type
            wakes = np.full(n + 1, -1, np.int32)
            wakes[1:n][starts[1:] & (small[:-1] == kind)] = text[:-1][starts[1:] & (small[:-1] == kind)]
            first = tail - size if kind else tail - np.bincount(text, minlength=letters)
            _place_type(text, members, size, after, first, place, out, wakes, small, kind)
    return out[1:]


def _place_type(text: np.ndarray, members: np.ndarray, size: np.ndarray, after: np.ndarray, first: np.ndarray, place: np.ndarray, out: np.ndarray, wakes: np.ndarray, small: np.ndarray, kind: bool) -> None:
    """Places of all suffixes of one type, and the suffixes by place; first: where each letter's bucket of that type begins."""
    n, letters = len(text), len(first)
    key = text[members]
    members = members[np.argsort(key.astype(np.uint16) if letters <= 1 << 16 else key, kind="stable")]
    begin = np.cumsum(size) - size
    same = np.flatnonzero(small == kind)
    waiting = wakes[same[wakes[same] >= 0]]  # others that could wake a bucket have their place already
    pending = np.bincount(waiting, minlength=letters)
    ready = np.flatnonzero((size > 0) & (pending == 0))
    bits = int(n + 1).bit_length()
    mask, narrow = (1 << bits) - 1, 3 * bits <= 63
    while len(ready):
        if len(ready) == 1:
            c = int(ready[0])
            m = int(size[c])
            j, at = members[begin[c] : begin[c] + m], np.arange(first[c], first[c] + m)
            bucket: np.ndarray | int = 0
        else:
            many = size[ready]
            ends = np.cumsum(many)
            rank = np.arange(int(ends[-1])) - np.repeat(ends - many, many)
            j, at = members[np.repeat(begin[ready], many) + rank], np.repeat(first[ready], many) + rank
            bucket = np.repeat(np.arange(len(ready)), many)
        follows = after[j]
        run = n - (follows - j) if kind else follows - j  # a longer run is less in the smaller type
        then = place[follows] + 1
        if narrow:  # sorting numbers is much faster than sorting places, and the suffix follows from its number
            packed = np.sort((run.astype(np.int64) << bits) | then | (bucket << (bits + bits)))
            run = (packed >> bits) & mask
            j = out[packed & mask] - ((n - run) if kind else run)
        else:
            j = j[np.lexsort((then, run, np.broadcast_to(bucket, len(j))))]
        place[j] = at
        out[at + 1] = j
        hits = wakes[j]
        hits = hits[hits >= 0]
        if 16 * len(hits) < letters:
            np.subtract.at(pending, hits, 1)
            hit = np.unique(hits)
            ready = hit[pending[hit] == 0]
        else:
            hit = np.bincount(hits, minlength=letters)
            pending -= hit
            ready = np.flatnonzero((hit > 0) & (pending == 0))


def common_prefixes(text: np.ndarray, at: np.ndarray, other: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Lengths of the common prefixes of text[at:] and text[other:], up to `most`."""
    w, n = words8(np.concatenate((text, np.zeros(most + 8, np.uint8)))), len(text)
    out, going = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(0, most, 8):
        if not len(going):
            break
        differ = w[at[going] + k] ^ w[other[going] + k]
        low = differ & (~differ + np.uint64(1))  # its least bit that is set
        out[going] = np.where(differ == 0, k + 8, k + np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        going = going[differ == 0]
    return np.minimum(out, np.minimum(most, n - np.maximum(at, other)))


def group_minima(pieces: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 50-byte string of the pieces, in order, the least id among pieces that hold it; and where each piece begins.

    least: the least id of each piece.
    """
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)
    begins = np.cumsum(lens + 1) - lens - 1
    array = suffix_array(text, 256)
    number = lens - WIDTH + 1
    upto = np.cumsum(number)
    starts = np.repeat(begins - (upto - number), number) + np.arange(int(upto[-1]))
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    owner = np.zeros(len(text), np.int64)
    owner[starts] = np.repeat(np.arange(len(pieces)), number)
    array = array[valid[array]]  # equal strings are neighbours: only they share 50 bytes without a separator
    before = np.full(len(text), -1, np.int64)
    before[array[1:]] = array[:-1]
    at = starts[before[starts] >= 0]
    permuted = np.zeros(len(text), np.int64)  # common prefixes with the predecessor in the array, in text order
    permuted[at] = common_prefixes(text, at, before[at])
    full = permuted >= WIDTH
    first = np.flatnonzero(~full[array])
    minima = np.minimum.reduceat(least[owner[array]], first)
    out = np.zeros(len(text), np.int64)
    out[array] = np.repeat(minima, np.diff(np.concatenate((first, [len(array)]))))
    return out[starts], upto - number


def _five(raw: bytes) -> np.ndarray:
    """Numbers of five bytes each."""
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8")


def _lows_body(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, low: np.ndarray, known: bool) -> bytes:
    """Documents and their hashes, packed; `known` ones (marked by a negative number) are shared for certain."""
    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    many = np.diff(np.concatenate((at, [len(doc)])))
    low5 = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits; the whole hash chose the shard
    return np.array([-len(at) if known else len(at), len(low)], "<i8").tobytes() + ids[doc[at]].astype("<i8").tobytes() + tags[doc[at]].astype("<u4").tobytes() + many.astype("<u4").tobytes() + np.ascontiguousarray(low5).tobytes()


def _shares(docs: DataFrame, shards: int) -> DataFrame:
    """id, tag, lows: least hashes that each document shares with another one (packed), several rows per document.

    A hash that many documents have leaves a block of documents twice at most, so no task gathers all of them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 2, BLOCK):
            low, _, _, doc = runs_of(block)
            if not len(low):
                continue
            ids, tags = np.asarray(block.rows.column(0)), np.asarray(block.rows.column(1)).astype(np.int64)
            order = np.lexsort((doc, low))
            low, doc = low[order], doc[order]
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])))
            low, doc = low[new], doc[new]
            # what documents of one block share is known here; for the others its least and greatest id will do
            first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            size = np.diff(np.concatenate((first, [len(low)])))
            least, most = (np.repeat(f.reduceat(ids[doc], first), size) for f in (np.minimum, np.maximum))
            common = least != most
            if common.any():
                by = np.lexsort((low[common], doc[common]))
                yield pa.RecordBatch.from_arrays([pa.array([int(mix(low[:1].copy())[0] % np.uint64(shards))], pa.int32()), pa.array([_lows_body(ids, tags, doc[common][by], low[common][by], True)], pa.binary())], ["shard", "body"])
            told = ~common | (ids[doc] == least) | (ids[doc] == most)
            low, doc = low[told], doc[told]
            to = (mix(low.copy()) % np.uint64(shards)).astype(np.uint32)
            order = np.lexsort((low, doc, to))
            low, doc, to = low[order], doc[order], to[order]
            edges = np.searchsorted(to, np.arange(shards + 1))
            which = np.flatnonzero(np.diff(edges))
            bodies = [_lows_body(ids, tags, doc[edges[s] : edges[s + 1]], low[edges[s] : edges[s + 1]], False) for s in which.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bodies, pa.binary())], ["shard", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies = None, []

        def out():
            ids, tags, many, values = [], [], [], []
            for raw in bodies:
                d, n = np.frombuffer(raw, "<i8", 2).tolist()
                ids.append(np.frombuffer(raw, "<i8", d, 16))
                tags.append(np.frombuffer(raw, "<u4", d, 16 + 8 * d))
                many.append(np.frombuffer(raw, "<u4", d, 16 + 12 * d))
                values.append(np.frombuffer(raw, np.uint8, 5 * n, 16 + 16 * d))
            ids, tags, many = np.concatenate(ids), np.concatenate(tags), np.concatenate(many).astype(np.int64)
            wide = np.zeros((int(many.sum()), 8), np.uint8)
            wide[:, :5] = np.concatenate(values).reshape(-1, 5)
            value = wide.reshape(-1).view("<u8")
            # values of one document are distinct, so a value with two entries of different ids is shared
            row = np.repeat(np.arange(len(ids)), many)
            order = np.argsort(value, kind="stable")
            v, i = value[order], ids[row[order]]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            mixed = np.minimum.reduceat(i, first) != np.maximum.reduceat(i, first)
            shared = np.zeros(len(value), bool)
            shared[order] = np.repeat(mixed, np.diff(np.concatenate((first, [len(v)]))))
            value, row = value[shared], row[shared]
            at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
            stop = np.concatenate((at[1:], [len(row)]))
            raw5 = np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            packed = [raw5[5 * a : 5 * b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids[row[at]]), pa.array(tags[row[at]].astype(np.int64)), pa.array(packed, pa.binary())], ["id", "tag", "lows"])

        def certain(raw: bytes) -> pa.RecordBatch:
            d, n = np.frombuffer(raw, "<i8", 2).tolist()
            d = -d
            ends = 5 * np.cumsum(np.frombuffer(raw, "<u4", d, 16 + 12 * d).astype(np.int64)) + 16 + 16 * d
            packed = [raw[a:b] for a, b in zip([16 + 16 * d, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8", d, 16)), pa.array(np.frombuffer(raw, "<u4", d, 16 + 8 * d).astype(np.int64)), pa.array(packed, pa.binary())], ["id", "tag", "lows"])

        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body[7] & 0x80:
                    yield certain(body)
                    continue
                if shard != now:
                    if bodies:
                        yield out()
                    now, bodies = shard, []
                bodies.append(body)
        if bodies:
            yield out()

    sent = docs.mapInArrow(send, "shard int, body binary")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, "id bigint, tag bigint, lows binary")


def _intervals(with_lows: DataFrame, shards: int) -> DataFrame:
    """id, tag, spans (packed pairs of u4: first byte, end): what goes, several rows per document. Rows: id, tag, t, lows.

    A piece that documents of one block share is asked about for that with the least id only; the others lose it whole.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for block in text_blocks(batches, 2, BLOCK):
            low, first, number, doc = runs_of(block)
            if not len(low):
                continue
            ids, tags = np.asarray(block.rows.column(0)), np.asarray(block.rows.column(1)).astype(np.int64)
            wanted = [_five(b"".join(x)) if x else None for x in block.rows.column(3).to_pylist()]
            edges = np.searchsorted(doc, np.arange(len(block) + 1))
            keep = np.zeros(len(low), bool)
            for d, want in enumerate(wanted):
                if want is not None:
                    keep[edges[d] : edges[d + 1]] = np.isin(low[edges[d] : edges[d + 1]] & np.uint64(0xFFFFFFFFFF), want)
            low, first, number, doc = low[keep], first[keep], number[keep], doc[keep]
            to = (mix(low) % np.uint64(shards)).astype(np.int64)
            raw = block.buf.tobytes()
            places = first - block.starts[doc]
            by: dict[int, dict[bytes, list[int]]] = {}
            for r, (s, a, m) in enumerate(zip(to.tolist(), first.tolist(), number.tolist(), strict=True)):
                by.setdefault(s, {}).setdefault(raw[a : a + m + WIDTH - 1], []).append(r)
            bodies, gone = [], []
            for pieces in by.values():
                rows = np.array([r for rs in pieces.values() for r in rs])
                heads = np.array([rs[0] for rs in pieces.values()])
                size = np.fromiter(map(len, pieces), np.int64, len(pieces))
                many = np.fromiter(map(len, pieces.values()), np.int64, len(pieces))
                at = np.cumsum(many) - many
                least = np.minimum.reduceat(ids[doc[rows]], at)
                asks = ids[doc[rows]] == np.repeat(least, many)  # the others lose the piece to a document of this block
                lost = rows[~asks]
                gone.append((ids[doc[lost]], tags[doc[lost]], places[lost], places[lost] + np.repeat(size, many)[~asks]))
                rows, many = rows[asks], np.add.reduceat(asks, at, dtype=np.int64)
                parts = [
                    np.array([len(pieces), len(rows)], "<i8"),
                    low[heads].astype("<u8"),
                    ids[doc[rows]].astype("<i8"),
                    size.astype("<u4"),
                    many.astype("<u4"),
                    tags[doc[rows]].astype("<u4"),
                    places[rows].astype("<u4"),
                ]
                bodies.append(b"".join([*(p.tobytes() for p in parts), packer.compress(b"".join(pieces))]))
            lost = [np.concatenate(x) for x in zip(*gone, strict=True)] if gone else []
            if gone and len(lost[0]):
                body = b"".join([np.array([-1, len(lost[0])], "<i8").tobytes(), *(x.astype(t).tobytes() for x, t in zip(lost, ("<i8", "<u4", "<u4", "<u4"), strict=True))])
                yield pa.RecordBatch.from_arrays([pa.array([next(iter(by))], pa.int32()), pa.array([body], pa.binary())], ["shard", "body"])
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(bodies, pa.binary())], ["shard", "body"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        now, table, unpacker = None, {}, zstandard.ZstdDecompressor()

        def take(raw: bytes) -> None:
            p, n = np.frombuffer(raw, "<i8", 2).tolist()
            low = np.frombuffer(raw, "<u8", p, 16).tolist()
            at = 16 + 8 * p
            ids = np.frombuffer(raw, "<i8", n, at)
            at += 8 * n
            lens, many = np.frombuffer(raw, "<u4", p, at).tolist(), np.frombuffer(raw, "<u4", p, at + 4 * p)
            at += 8 * p
            tags, places = np.frombuffer(raw, "<u4", n, at), np.frombuffer(raw, "<u4", n, at + 4 * n)
            text, at = unpacker.decompress(raw[at + 8 * n :]), 0
            ends = np.cumsum(many).tolist()
            begin = 0
            for v, m, end in zip(low, lens, ends, strict=True):
                table.setdefault((v, text[at : at + m]), []).append((ids[begin:end], tags[begin:end], places[begin:end]))
                at += m
                begin = end

        def settle() -> Iterator[pa.RecordBatch]:
            keys = sorted(table)
            a = 0
            while a < len(keys):  # one array for whole least hashes, up to ARRAY_BYTES
                b, size = a, 0
                while b < len(keys) and (size < ARRAY_BYTES or keys[b][0] == keys[b - 1][0]):
                    size += len(keys[b][1])
                    b += 1
                yield from decide(keys[a:b])
                a = b

        def decide(keys: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            own = [table[k] for k in keys]
            ids = [np.concatenate([x[0] for x in o]) for o in own]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            least = np.array([x.min() for x in ids])
            minima, begins = group_minima([k[1] for k in keys], least)
            number = np.diff(np.concatenate((begins, [len(minima)])))
            top, bottom = np.maximum.reduceat(minima, begins), np.minimum.reduceat(minima, begins)
            piece = np.repeat(np.arange(len(keys)), count)
            doc = np.concatenate(ids)
            tag = np.concatenate([x[1] for o in own for x in o])
            place = np.concatenate([x[2] for o in own for x in o]).astype(np.int64)
            whole = np.flatnonzero(top[piece] < doc)
            part = np.flatnonzero((top[piece] >= doc) & (bottom[piece] < doc))
            d, t, s, e = [doc[whole]], [tag[whole]], [place[whole]], [place[whole] + number[piece[whole]] + WIDTH - 1]
            for r in part.tolist():
                k = piece[r]
                goes = np.concatenate(([False], minima[begins[k] : begins[k] + number[k]] < doc[r], [False])).view(np.int8)
                edge = np.flatnonzero(np.diff(goes))
                d.append(np.full(len(edge) // 2, doc[r]))
                t.append(np.full(len(edge) // 2, tag[r]))
                s.append(place[r] + edge[0::2])
                e.append(place[r] + edge[1::2] + WIDTH - 1)
            d, t, s, e = map(np.concatenate, (d, t, s, e))
            if len(d):
                yield packed_spans(d, t, s, e)

        def packed_spans(d: np.ndarray, t: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((s, t, d))
            d, t, s, e = d[order], t[order], s[order], e[order]
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
            spans = np.stack((s, e), axis=1).astype("<u4")
            packed = [spans[a:b].tobytes() for a, b in zip(new.tolist(), [*new[1:].tolist(), len(d)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(t[new].astype(np.int64)), pa.array(packed, pa.binary())], ["id", "tag", "spans"])

        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body[7] & 0x80:  # decided where it was sent
                    n = int(np.frombuffer(body, "<i8", 2)[1])
                    yield packed_spans(np.frombuffer(body, "<i8", n, 16), *(np.frombuffer(body, "<u4", n, 16 + (8 + 4 * k) * n) for k in range(3)))
                    continue
                if shard != now:
                    if table:
                        yield from settle()
                    now, table = shard, {}
                take(body)
        if table:
            yield from settle()

    sent = with_lows.mapInArrow(send, "shard int, body binary")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(judge, "id bigint, tag bigint, spans binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (array of struct<start, end>, bytes, disjoint and sorted), kept (binary); one row per input row.

    Null text counts as empty; texts under 50 bytes lose nothing. Rows with a null id neither lose anything nor take part.
    Rows that share an id do not remove each other; if their texts differ, each is judged by its own; repeated rows come
    out as often as they came in. Cuts may fall inside a character, so what is kept is binary. A text of many megabytes is a
    block of its own and goes to many shards. An empty table gives no rows. Ids are cast to bigint; other columns are not
    read, so their names cannot clash.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.crc32(t.cast("binary")).alias("tag"), t.alias("t"))
    if shards is None:  # in proportion to the table, so that a shard does not grow with it
        shards = max(rows.rdd.getNumPartitions(), 12)
    named = rows.filter(F.col("id").isNotNull())
    lows = _shares(named, shards).groupBy("id", "tag").agg(F.collect_list("lows").alias("lows"))
    # both joins are outer ones over the same rows, so the texts are exchanged once for the two of them
    candidates = rows.join(lows.hint("shuffle_hash"), ["id", "tag"], "left").select("id", "tag", F.when(F.col("lows").isNotNull(), F.col("t")).alias("t"), "lows")
    gone = _intervals(candidates, 8 * shards).groupBy("id", "tag").agg(F.collect_list("spans").alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for block in text_blocks(batches, 1, BLOCK):
            raw, sizes, spans, kept = block.buf.tobytes(), [], [], []
            for a, b, packed in zip(block.starts.tolist(), block.ends.tolist(), block.rows.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                if packed:
                    for s, e in sorted(map(tuple, np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2).tolist())):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                at, parts = a, []
                for s, e in merged:
                    parts.append(raw[at : a + s])
                    at = a + e
                parts.append(raw[at:b])
                sizes.append(b - a)
                kept.append(b"".join(parts))
                spans.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(gone.hint("shuffle_hash"), ["id", "tag"], "left").select("id", "t", "spans")
    return joined.mapInArrow(apply, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    """The contract's columns from remove_repeats()."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
