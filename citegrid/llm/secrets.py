"""Secret scans: three fixed patterns, and spans of high entropy.

Entropy: in each candidate string (a run of token characters) a window slides over the characters; counts per character
change by one in and one out, and with them the sum of c*log2(c), so each step costs the same whatever the window's
width. The counts are five bits each in six numbers, so a step adds to two numbers and copies nothing else. A string
whose densest window exceeds the limit of its character class, and that no allow rule suppresses, is reported. Of a
candidate that spans of the fixed patterns touch, the parts beside them are candidates. Texts without any candidate
are passed over by one regular expression; with many matches the work stays far under their square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.llm.native import let, positions, running
from citegrid.llm.shared import free_name

#: Fixed patterns of the contract; lengths are checked after the scan where that changes what a scan finds.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}$"
ASSIGN_START = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates, window, and the least entropy in bits per character of the densest window, by class.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
LIMITS = {"hex": 3.0, "upper": 3.6, "mixed": 3.7}
#: Suppressed: words without digits (_wordlike), digits alone (numbers), paths of words with at most a few digits at the
#: end, UUIDs, one repeated unit.
ALLOWED = (r"^[0-9_=-]+$", r"^/?([a-z]+[/_-])+[a-z]*[0-9]{0,4}$", r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"^(.{1,4}?)\1+$")


#: Characters of candidates. Each has a place of five bits in one of six numbers.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PER_NUMBER = 12


def densest_window(text: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, over all windows of `width` characters of candidates (31 at most).

    The state has the counts and s, the sum of c*log2(c); the entropy is log2(width) - s / width.
    """
    if width > 31:
        raise ValueError("a count has five bits")
    table = F.array(*[F.lit(float(c) * math.log2(c) if c else 0.0) for c in range(width + 2)])
    place = F.array(*[F.lit(max(ALPHABET.find(chr(k)), 0)) for k in range(128)])
    numbers = -(-len(ALPHABET) // PER_NUMBER)

    def run(codes: Column) -> Column:
        zero = F.struct(F.array(*[F.lit(0).cast("bigint")] * numbers).alias("c"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))
        number = lambda p: F.floor(p / PER_NUMBER).cast("int")
        bits = lambda p: (p % PER_NUMBER) * 5
        times = lambda c, p: F.call_function("shiftright", F.get(c, number(p)), bits(p)).bitwiseAND(F.lit(31)).cast("int")

        def moved(b: Column, p: Column, by: int) -> Column:
            one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits(p))
            counts = F.transform(b["c"], lambda v, k: F.when(k == number(p), v + one * by).otherwise(v))
            return let(times(b["c"], p), lambda n: F.struct(counts.alias("c"), (b["s"] - F.get(table, n) + F.get(table, n + by)).alias("s")))

        def step(a: Column, x: Column) -> Column:
            left = F.when(x["out"] >= 0, moved(a, x["out"], -1)).otherwise(F.struct(a["c"].alias("c"), a["s"].alias("s")))
            seen = lambda d: F.struct(d["c"].alias("c"), d["s"].alias("s"), F.when(x["i"] >= width - 1, F.least(a["least"], d["s"])).otherwise(a["least"]).alias("least"))
            return let(let(left, lambda b: moved(b, x["in"], 1)), seen)

        moves = F.transform(codes, lambda v, i: F.struct(v.alias("in"), F.when(i >= width, F.get(codes, i - width)).otherwise(F.lit(-1)).alias("out"), i.alias("i")))
        return F.aggregate(moves, zero, step, lambda a: F.log2(F.lit(float(width))) - a["least"] / width)

    return let(F.transform(F.split(text, ""), lambda ch: F.get(place, F.ascii(ch) % 128)), run)


def _wordlike(m: Column) -> Column:
    """No digit, and each part between separators in one case or with at most a third of capitals, as camel case has."""
    capitals = lambda p: F.length(F.regexp_replace(p, "[^A-Z]", ""))
    part = lambda p: (capitals(p) == 0) | (capitals(p) == F.length(p)) | (3 * capitals(p) <= F.length(p))
    return ~m.rlike("[0-9]") & F.forall(F.split(m, "[/_+=-]+"), part)


def _dense(m: Column) -> Column:
    limit = F.when(m.rlike("^[0-9a-fA-F]+$"), LIMITS["hex"]).when(~m.rlike("[a-z]"), LIMITS["upper"]).otherwise(LIMITS["mixed"])
    allowed = _wordlike(m)
    for rule in ALLOWED:
        allowed = allowed | m.rlike(rule)
    return F.when(allowed, F.lit(False)).otherwise(densest_window(m) >= limit)


def beside(df: DataFrame, candidates: str, fixed: str, out: str, least: int) -> DataFrame:
    """df with `out`: parts of the candidates outside the fixed spans that have `least` characters, as array<struct<s, e, m>>.

    Candidates are disjoint and in order; fixed spans may overlap. Candidates and the gaps between fixed spans are walked
    through by their starts, each with the last candidate and the last gap that begins before it: what they share begins
    there. Step by step, as Spark resolves nested lambdas one level a round.
    """
    later = lambda a, b: F.greatest(a, b)
    fx, reach, events, own, free = (free_name(df.columns, x) for x in ("fx", "reach", "events", "own", "free"))
    df = df.withColumn(fx, F.sort_array(F.transform(fixed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))
    df = df.withColumn(reach, running(F.transform(fx, lambda x: x["e"]), later, F.lit(0)))
    gap = lambda s, e: F.struct(s.alias("s"), e.alias("e"), F.lit(None).cast("int").alias("k"))
    until = lambda f, k: F.coalesce(F.get(f, k)["s"], F.lit(2**31 - 1))
    gaps = lambda f, r: F.concat(F.array(gap(F.lit(0), until(f, F.lit(0)))), F.transform(f, lambda x, k: gap(F.get(r, k), until(f, k + 1))))
    whole = F.transform(candidates, lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), k.alias("k")))
    # what a lambda names is bound by let: else the optimizer may put its whole computation into each step
    between = let(F.col(fx), lambda f: let(F.col(reach), lambda r: gaps(f, r)))
    df = df.withColumn(events, F.sort_array(F.concat(whole, F.filter(between, lambda g: g["s"] < g["e"]))))
    df = df.withColumn(own, running(F.transform(events, lambda v: F.coalesce(v["k"], F.lit(-1))), later, F.lit(-1)))
    df = df.withColumn(free, running(F.transform(events, lambda v: F.when(v["k"].isNull(), v["e"]).otherwise(F.lit(0))), later, F.lit(0)))

    def shared(ev: Column, cs: Column, o: Column, f: Column) -> Column:
        def part(v: Column, i: Column) -> Column:
            c = F.get(cs, F.nullif(F.get(o, i), F.lit(-1)))
            e = F.least(c["e"], F.get(f, i))
            return F.struct(v["s"].alias("s"), e.alias("e"), F.substr(c["m"], v["s"] - c["s"] + 1, F.greatest(e - v["s"], F.lit(0))).alias("m"))

        twice = lambda p, i: F.coalesce(F.get(ev, i + 1)["s"] == p["s"], F.lit(False))  # noqa: E731  of two that begin at one place the second sees both
        return F.filter(F.transform(ev, part), lambda p, i: (p["e"] - p["s"] >= least) & ~twice(p, i))

    parts = let(F.col(events), lambda ev: let(F.col(candidates), lambda cs: let(F.col(own), lambda o: let(F.col(free), lambda f: shared(ev, cs, o, f)))))
    return df.withColumn(out, F.when((F.size(fixed) == 0) | (F.size(candidates) == 0), F.col(candidates)).otherwise(parts)).drop(fx, reach, events, own, free)


def _listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind in the order of KINDS, joined by commas."""
    def tagged(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.transform(spans[kind], lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), F.lit(kind).alias("k")))

    rows = F.concat(*[tagged(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(rows), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found, struct<assign, access, hex, entropy> of arrays of struct<s, e, m>: code points, end exclusive.

    One row per input row. Null text counts as empty and has no spans. Ids may be null or repeat; rows do not affect each
    other, so neither ties nor repeated rows matter, and an empty table gives no rows. Other columns are not read, so their
    names cannot clash. A long text is scanned whole, in one row; thousands of matches in it are in order.
    """
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    suspect = t.rlike(f"(?:{CANDIDATE}|{HEX}|AKIA[A-Z0-9]{{14}}|{ASSIGN_START})")
    # all that follows is null, and costs nothing, where the text is not suspect
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(suspect, t).alias("t"))
    some = lambda p, keep=None: F.when(F.col("t").rlike(p), positions(F.col("t"), p, keep)).when(F.col("t").isNotNull(), none)
    rows = rows.withColumns({"assign": some(ASSIGN, lambda m: m.rlike(ASSIGN_VALUE)), "access": some(ACCESS), "hex": some(HEX), "candidates": some(CANDIDATE)})
    rows = rows.withColumn("fixed", F.concat("assign", "access", "hex")).drop("t")
    rows = beside(rows, "candidates", "fixed", "parts", WINDOW).withColumn("entropy", F.filter("parts", lambda x: _dense(x["m"])))
    return rows.select("doc_id", F.struct(*[F.coalesce(k, none).alias(k) for k in KINDS]).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s result."""
    s = F.col("found")
    return found.select(
        "doc_id",
        *[F.size(s[k]).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(s, KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _listed(s, KINDS).alias("spans"),
        F.size(s["entropy"]).cast("bigint").alias("n_entropy"),
    )
