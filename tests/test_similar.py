"""Similarity joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from citegrid.functions.similarity import lcs_length
from citegrid.operators import mapping as M
from citegrid.operators import similar


def ratio(a, b):
    return 100.0 if a == b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def changed(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        i, kind = rng.randint(0, max(len(s) - 1, 0)), rng.random()
        if kind < 0.4 and s:
            s.pop(i)
        elif kind < 0.8:
            s.insert(i, rng.choice("abcdef "))
        elif s:
            s[i] = rng.choice("abcdef")
    return "".join(s)


def strings(rng, n):
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 25))) for _ in range(n // 4)]
    return sorted({changed(rng, rng.choice(base)) for _ in range(n)} | {"", "a", "b", "aa", "ab", "a" * 40, "a" * 43})


@pytest.mark.parametrize("threshold", [40.0, 71.0, 86.0, 94.0, 100.0])
def test_same_pairs_as_all(spark, threshold):
    rng = random.Random(int(threshold))
    rows = [(s, [b for b in ("x", "y", "z", "hot") if rng.random() < 0.4 or b == "hot" and rng.random() < 0.8]) for s in strings(rng, 160)]
    df = spark.createDataFrame(rows, "key string, blocks array<string>").repartition(3)
    got = sorted((r.a, r.b, round(r.ratio, 6)) for r in similar.similar_pairs(df, threshold, text="key").collect())
    want = sorted((min(a, b), max(a, b), round(ratio(a, b), 6)) for i, (a, p) in enumerate(rows) for b, q in rows[:i] if set(p) & set(q) and ratio(a, b) >= threshold)
    assert got == want
    assert want or threshold == 100.0


def test_common_grams_bound():
    """No two strings have fewer common q-grams than the bound says."""
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        b = changed(rng, a)
        if not b:
            continue
        t = ratio(a, b)
        for q in (1, 2, 3):
            common = len(set(similar.grams(a, q)) & set(similar.grams(b, q)))
            assert common >= similar.least_common(len(a) + len(b), t, q), (a, b, q)


def test_a_hot_block(spark):
    """30,000 different names with one first word: pairs are found without comparing all of them."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = {"wang " + "".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(30_000)}
    planted = [(n, n + "x") for n in sorted(names)[:300]]
    names |= {b for _, b in planted}
    df = spark.createDataFrame([(n, ["wang"]) for n in sorted(names)], "key string, blocks array<string>").repartition(4)
    got = {(r.a, r.b) for r in similar.similar_pairs(df, 90.0, text="key").collect()}
    assert got >= set(planted)
    assert all(ratio(a, b) >= 90.0 for a, b in got)


def plain_author_candidates(mentions, threshold):
    """Fuzzy part only: pairs of names with a common first or last word, components, the best name of each."""
    from collections import Counter, defaultdict

    n = Counter(mentions)
    key = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    sort = lambda s: " ".join(sorted(key(s).split()))
    ends = lambda s: {key(s).split()[0], key(s).split()[-1]}
    rank = lambda s: (n[s], len(key(s).split()), -sum(len(w) == 1 for w in key(s).split()), len(s), s.lower())
    names, near = sorted(n), defaultdict(dict)
    for i, a in enumerate(names):
        for b in names[:i]:
            score = round(ratio(sort(a), sort(b)), 2)
            if ends(a) & ends(b) and score >= threshold:
                near[a][b] = near[b][a] = score
    out, seen = [], set()
    for a in names:
        if a in near and a not in seen:
            group, open_ = {a}, [a]
            while open_:
                for b in near[open_.pop()]:
                    if b not in group:
                        group.add(b)
                        open_.append(b)
            seen |= group
            top = max(group, key=rank)
            out += [(v, top, near[v].get(top, max(near[v].values())), "similar_name") for v in group if v != top]
    return sorted(out)


def test_author_candidates_against_plain(spark):
    rng = random.Random(5)
    first, last = ["wang", "li", "smith", "smyth"], ["jun", "juan", "maria", "mario", "m", "xiaoming", "xiao ming"]
    mentions = [f"{rng.choice(first)}{rng.choice((', ', ' '))}{rng.choice(last)}" for _ in range(120)]
    mentions = [m.title() if rng.random() < 0.4 else m for m in mentions]
    df = spark.createDataFrame([(m, "") for m in mentions], "name string, aid string")
    got = sorted(map(tuple, M.author_candidates(df, 85.0).collect()))
    assert got == plain_author_candidates(mentions, 85.0)


def test_empty_and_blank(spark):
    none = spark.createDataFrame([], "key string, blocks array<string>")
    assert similar.similar_pairs(none, 90.0, text="key").count() == 0
    alone = spark.createDataFrame([("a", []), ("a ", None)], "key string, blocks array<string>")
    assert similar.similar_pairs(alone, 90.0, text="key").count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(none, 0.0)
    got = spark.createDataFrame([("a b",), ("",), ("a",)], "k string").select(similar.word_blocks(F.filter(F.split("k", " "), lambda w: w != "")).alias("b")).collect()
    assert [r.b for r in got] == [["a", "b"], [], ["a"]]
