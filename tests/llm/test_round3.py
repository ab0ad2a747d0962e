"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citegrid.llm import fill_middle, fingerprints, resampling
from citegrid.llm.shared import text_blocks
from tests.llm.conftest import text


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


# fill in the middle


def plain_fim(doc_id, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, "<S>" + suf + "<P>" + pre + "<M>" + mid)
    return (doc_id, n, "psm", a, b - a, "<P>" + pre + "<S>" + suf + "<M>" + mid)


def by_text(x):
    return tuple("" if v is None else str(v) for v in x)


def test_fill_middle_against_plain(spark, docs, corpus):
    extra = [(1000 + i, t) for i, t in enumerate(["a <P> b", "<", "<P", "x<S>", "<M", "👩‍👩‍👧 é", "\u0000nul", "S>P>M>" * 30])]
    rows = [(r[0], r[1]) for r in corpus] + extra
    made = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    out = made.collect()
    assert sorted(map(tuple, out), key=by_text) == sorted((plain_fim(*r) for r in rows), key=by_text)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    digest = fill_middle.digest(made).collect()
    assert sorted((str(r.doc_id), r.restored_sha256) for r in digest) == sorted((str(d), sha(t or "")) for d, t in rows)


def test_fill_middle_long_text_and_no_rows(spark, no_docs):
    assert fill_middle.digest(fill_middle.transform(no_docs)).count() == 0
    t = ("é漢a b\n" * 700_000) + "end"  # 10 MB of bytes
    one = fill_middle.rearrange(t.encode(), "1:7")
    assert one == (*plain_fim(7, t)[1:5], plain_fim(7, t)[5].encode())


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units(unit):
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab é漢\n \t") for _ in range(rng.randint(0, 40)))
        raw = t.encode()
        pattern = {"char": r"(?s).", "word": r"^[ \t\n]+|[^ \t\n]+[ \t\n]*", "line": r"[^\n]*\n|[^\n]+$"}[unit]
        cuts, at = [], 0
        for m in re.finditer(pattern, t):
            at += len(m.group().encode())
            cuts.append(at)
        ends = fill_middle.unit_ends(raw, unit)
        assert ends.bit_count() == len(cuts)
        assert [fill_middle.nth_bit(ends, k, len(raw)) + 1 for k in range(len(cuts))] == cuts


# importance resampling


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_resample(rows, target, share=5, least=20, buckets=10_000):
    def found(t):
        w = words_of(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in rows:
        np.add.at(s, found(x), 1)
    for x in target:
        np.add.at(t, found(x), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        f = found(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, len(words_of(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[: share * len(enough) // 100]):
        r[5] = i + 1
    return [tuple(r) for r in out]


def test_resample_against_plain(spark, docs, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    target = [corpus[5][1], "one two three", None, corpus[8][1][:60], "Ünï ß 7 ñ"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for share in (5, 60, 100):
        got = sorted(map(tuple, resampling.resample(docs, bench, share=share).collect()), key=by_text)
        want = plain_resample(rows, target, share)
        ranks = lambda xs: sorted((r[5], r[4]) for r in xs if r[5])  # noqa: E731  equal rows: which has which rank is open
        assert ranks(got) == ranks(want)
        unique = lambda xs: sorted((r for r in xs if sum(q[:5] == r[:5] for q in xs) == 1), key=by_text)
        assert unique(got) == unique(want)
        assert [r[:5] for r in got] == sorted((r[:5] for r in want), key=by_text)


def test_resample_without_rows_or_target(spark, docs, no_docs, corpus):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, none).count() == 0
    got = sorted(map(tuple, resampling.resample(docs, none).collect()), key=by_text)
    assert [r[:5] for r in got] == sorted((r[:5] for r in plain_resample([(r[0], r[1]) for r in corpus], [])), key=by_text)


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(8)
    long_ = text(rng, 4000)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([long_, None, text(rng, 3)])], ["d", "t"])

    def buckets_of(most):
        monkeypatch.setattr(resampling, "MOST_WORDS", most)
        out = np.zeros(10_000, np.int64)
        for block in text_blocks(iter([batch]), 1):
            for _, _, of, found in resampling.runs(*resampling.words_of(block), 10_000):
                np.add.at(out, found[of][found[of] >= 0], 1)
        return out

    assert (buckets_of(1000) == buckets_of(1 << 20)).all()


def test_suffix_order_of_many_words():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 4, 500) for _ in range(3))
    packed, sorted_ = resampling.suffix_array(a, b, c, 4), resampling.suffix_array(a, b, c, 1 << 40)
    keys = lambda o: list(zip(a[o], b[o], c[o], strict=True))
    assert keys(packed[0]) == keys(sorted_[0]) == sorted(zip(a, b, c, strict=True))
    assert (packed[1] == sorted_[1]).all()


# fingerprints


def plain_follow(rows):
    """doc_id, n_chars, hash of the edited text, the text and the next one; the order is that of the docstring."""
    keys = sorted({(d is not None, d or 0, tie, t or "") for d, tie, t in rows}, key=lambda k: k[:3])
    after = {k: keys[(i + 1) % len(keys)][3] for i, k in enumerate(keys)}
    out = []
    for d, tie, t in rows:
        t = t or ""
        nxt, n = after[d is not None, d or 0, tie, t], len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        out.append((d, n, sha(edited), t, edited, nxt))
    return out


def plain_paragraphs(t):
    batch = pa.RecordBatch.from_arrays([pa.array([t])], ["t"])
    block = next(text_blocks(iter([batch]), 0))
    a, b, _ = fingerprints.paragraphs(block)
    raw = t.encode()
    return sorted(raw[i:j] for i, j in zip(a, b, strict=True))


def plain_likeness(a, b):
    from collections import Counter

    x, y = Counter(plain_paragraphs(a)), Counter(plain_paragraphs(b))
    return (x & y).total() / (x | y).total() if x or y else 1.0


def check_follow(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    keyed = [tuple(r) for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect()]
    got = sorted(map(tuple, fingerprints.follow(docs).collect()), key=by_text)
    want = sorted(plain_follow(keyed), key=by_text)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    prints = {}
    for g, w in zip(got, want, strict=True):
        assert abs(g[5] - plain_likeness(w[3], w[4])) < 1e-12
        assert abs(g[6] - plain_likeness(w[3], w[5])) < 1e-12
        for t, p in ((w[3], g[3]), (w[4], g[4])):
            assert prints.setdefault(t, p) == p
    assert len(set(prints.values())) == len(prints)


def test_follow_against_plain(spark, corpus):
    check_follow(spark, [(r[0], r[1]) for r in corpus])


def test_follow_few_rows(spark, corpus):
    check_follow(spark, [(4, corpus[0][1])], 1)
    check_follow(spark, [(4, corpus[0][1]), (9, corpus[1][1])], 2)
    check_follow(spark, [(None, None), (1, "")], 1)
    check_follow(spark, [(5, corpus[0][1])] * 40 + [(5, corpus[2][1])] * 3 + [(7, corpus[3][1])] + [(i, corpus[i][1]) for i in range(20, 40)], 4)


def test_follow_has_no_rows_of_none(no_docs):
    assert fingerprints.follow(no_docs).count() == 0
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_next_documents_across_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 10**12), text(rng, rng.randint(1, 4))) for _ in range(400)]
    rows += [(d, t + " more") for d, t in rows[:30]]
    check_follow(spark, rows, 7)


def test_string_ids(spark):
    rows = [(f"d{i}é", f"text number {i} " * 5) for i in range(30)]
    got = fingerprints.follow(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    order = sorted(rows, key=lambda r: r[0].encode())
    after = {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    for r in got:
        t = dict(rows)[r.doc_id]
        assert r.edited_sha256 == sha(t[: len(t) - len(t) // 2] + after[r.doc_id][: len(t) // 2])


def test_compare_recovers_paragraphs(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(60):
        lines = text(rng, rng.randint(0, 60)).split("\n")
        other = [x for x in lines if rng.random() < 0.9] + text(rng, rng.randint(0, 5)).split("\n") + lines[: i % 3]
        pairs.append((i, "\n".join(lines), "\n".join(other)))
    pairs += [(100, None, ""), (101, "x" * 5000, "x" * 4000 + "y" * 1000), (102, "same words", "same words")]
    got = {r.doc_id: r for r in fingerprints.compare(spark.createDataFrame(pairs, "doc_id long, old string, new string")).collect()}
    for d, a, b in pairs:
        from collections import Counter

        x, y = Counter(plain_paragraphs(a or "")), Counter(plain_paragraphs(b or ""))
        assert (len(got[d].removed), len(got[d].added)) == ((x - y).total(), (y - x).total())
        assert abs(got[d].likeness - plain_likeness(a or "", b or "")) < 1e-12


def test_peeling_grows_until_it_succeeds():
    rng = np.random.default_rng(5)
    a = fingerprints.Digests(rng.integers(1, 2**63, 6000, dtype=np.uint64), np.array([1000, 0, 5000]))
    b = fingerprints.Digests(np.concatenate((a.keys[10:900], rng.integers(1, 2**63, 3, dtype=np.uint64), a.keys[1000:])), np.array([890, 3, 5000]))
    keys, of, sign = fingerprints.difference(a, b)
    want = [(0, 1)] * 110 + [(1, -1)] * 3
    assert sorted(zip(of.tolist(), sign.tolist(), strict=True)) == sorted(want)
    assert set(keys[of == 0].tolist()) == set(a.keys[:10].tolist()) | set(a.keys[900:1000].tolist())


def test_fingerprints_are_those_of_follow(spark, corpus):
    docs = spark.createDataFrame([(i, r[1]) for i, r in enumerate(corpus)], "doc_id long, text string").repartition(2)
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert alone == {r.doc_id: r.fingerprint for r in fingerprints.follow(docs).collect()}


def test_long_text(spark):
    rng = random.Random(6)
    t = "\n".join(" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(12)) for _ in range(150_000))
    assert len(t) > 8_000_000
    rows = fingerprints.follow(spark.createDataFrame([(1, t), (2, "short text")], "doc_id long, text string")).collect()
    one = next(r for r in rows if r.doc_id == 1)
    assert one.edited_sha256 == sha(t[: len(t) - len(t) // 2] + "short text"[: len(t) // 2])
    assert 0.4 < one.near_edited < 0.6
