"""Quality rules: statistics of whole texts, fixed base limits, and robust multivariate outliers per language and source.

The statistics come from array expressions on each row; nothing is shuffled for them. Outliers are judged by minimum
covariance determinant estimates per group. Four starts are deterministic: medians with absolute deviations, the scatter
of tanh scores, the spatial sign scatter, and plain moments. From each, concentration steps keep the share of the group
with the least Mahalanobis distances and estimate location and scatter from it alone; the start with the least
determinant goes on until no determinant falls any more. The scatter is regularised by a small diagonal, as most texts
have no symbols and no repeats, where a plain determinant would be zero.

Everything after the statistics works on one narrow row per document. What is exchanged are partial sums and counts of
buckets of fixed width, so results do not depend on how rows are dealt. Estimates are joined by broadcast while their
groups are at most HOT_GROUPS, beyond that only for the largest groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import shared
from citegrid.llm.native import NOT_BLANK, let, words_of
from citegrid.llm.shared import cut

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics and the least standard deviation that each is given.
FEATURES = {"f_symbols": 0.10, "f_length": 0.05, "f_lines": 0.10, "f_repeats": 0.08}
#: Share of a group that the estimates use, and the factor that makes the scatter of that share consistent for four normal
#: features (0.75 / P(chi2_6 <= q), q the 0.75 quantile of chi2_4).
SHARE, CONSISTENCY = 0.75, 1.486
#: Squared distance beyond which a document is an outlier. For four normal features its probability is 4e-9; the statistics
#: of real texts have longer tails than that, and what is far out only by the 0.99 quantile (13.3) is often clean.
CUTOFF = 45.0
#: Steps from every start; steps at most from the best one; fall of a log determinant that is none. Weight of the moments of
#: all groups, in documents.
FIRST_STEPS, MOST_STEPS, SETTLED, PRIOR = 2, 20, 1e-3, 20.0
#: Buckets per unit of a feature, and per unit of the logarithm of a distance.
FEATURE_BUCKETS, DISTANCE_BUCKETS = 1000, 200


def repeated_words(window_hashes: Column, width: int) -> Column:
    """How many words lie in windows that occur twice or more. Most texts have none; only the others are sorted."""

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-width).cast("int").alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).cast("bigint").alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def places(s: Column) -> Column:
        twin = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    tagged = F.sort_array(F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    slow = let(let(tagged, places), covered)
    return F.when(F.size(F.array_distinct(window_hashes)) == F.size(window_hashes), F.lit(0).cast("bigint")).otherwise(slow)


def text_statistics(text: Column, width: int = 5) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines>, all bigint."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def of_hashes(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) > width, let(windows, lambda v: repeated_words(v, width))).otherwise(F.lit(0).cast("bigint"))

    def of_words(w: Column) -> Column:
        repeats = let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeats.alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    words = let(words_of(t), of_words)
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_BLANK)), of_lines)
    symbols = (F.size(F.split(t, "[#*$%&|<>]", -1)) - 1).cast("bigint")
    return F.struct(words.alias("w"), lines.alias("l"), symbols.alias("n_symbols"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One narrow row per document: doc_id, g (its group), the base statistics, base_failed, and the features."""
    group = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in groups]) if groups else F.lit("")
    one = docs.select(F.col(id_col).alias("doc_id"), group.alias("g"), text_statistics(F.col(text_col)).alias("s"))
    flat = one.select("doc_id", "g", "s.w.n_words", "s.w.word_chars", "s.n_symbols", "s.l.n_dup_lines", "s.w.n_repeat_words", "s.l.n_lines")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return flat.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.sqrt(F.col("n_symbols") / n).alias("f_symbols"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("f_length"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")).alias("f_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f_repeats"),
    )


_N = range(len(FEATURES))
_PAIRS = [(i, j) for i in _N for j in range(i + 1)]


def _edges(rows: DataFrame, keys: list[str], bucket: Column, share: float) -> DataFrame:
    """keys and edge: the first bucket up to which at least `share` of a key's rows lie. The buckets of a key are bounded."""
    counts = rows.select(*keys, bucket.cast("bigint").alias("b")).groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("b"))
    seen = counts.select(*keys, "b", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return seen.filter(F.col("upto") >= F.lit(share) * F.col("all")).groupBy(*keys).agg(F.min("b").alias("edge"))


def _with_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """rows joined with one row per group (g, n, ...); few: there are at most HOT_GROUPS of them."""
    return rows.join(F.broadcast(groups.drop("n")), "g") if few else shared.join_counted(rows, groups, ["g"], "n").drop("n")


def _medians(clean: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """g, n, m0.. (medians) and s0.. (absolute deviations as standard deviations, at least the features' own least)."""

    def middle(values: DataFrame, name: str) -> DataFrame:
        each = values.select("g", F.posexplode(F.array(*[f"v{i}" for i in _N])).alias("k", "v"))
        edges = _edges(each, ["g", "k"], F.floor(F.col("v") * FEATURE_BUCKETS), 0.5)
        return edges.groupBy("g").agg(*[F.max(F.when(F.col("k") == i, F.col("edge") / FEATURE_BUCKETS)).alias(f"{name}{i}") for i in _N])

    first = clean.select("g", *[F.col(x).alias(f"v{i}") for i, x in enumerate(FEATURES)])
    centre = cut(groups.join(middle(first, "m"), "g"), "medians")
    around = _with_groups(clean, centre, few).select("g", *[F.abs(F.col(x) - F.col(f"m{i}")).alias(f"v{i}") for i, x in enumerate(FEATURES)])
    spread = middle(around, "s").select("g", *[F.greatest(F.col(f"s{i}") * 1.4826, F.lit(x)).alias(f"s{i}") for i, x in enumerate(FEATURES.values())])
    return cut(centre.join(spread, "g"), "medians")


def _second(values: list[Column], name: str) -> list[Column]:
    return [F.avg(v).alias(f"{name}{i}") for i, v in enumerate(values)] + [F.avg(values[i] * values[j]).alias(f"{name}{i}{j}") for i, j in _PAIRS]


def _factored(estimates: DataFrame) -> DataFrame:
    """g, st, n, m0.., the inverse of the scatter's Cholesky factor w00.., and the scatter's log determinant; from g, st, n, m0..,
    c00.. (scatter, to which the diagonal is added)."""
    out = estimates
    for i, j in _PAIRS:
        v = F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) + list(FEATURES.values())[i] ** 2 if i == j else F.col(f"c{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-6))) if i == j else v / F.col(f"l{j}{j}"))
    for i, j in _PAIRS:
        v = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
        out = out.withColumn(f"w{i}{j}", v / F.col(f"l{i}{i}"))
    det = sum((F.log(F.col(f"l{i}{i}")) for i in _N), F.lit(0.0)) * 2
    return out.select("g", "st", "n", *[f"m{i}" for i in _N], *[f"w{i}{j}" for i, j in _PAIRS], det.alias("det"))


def _starts(clean: DataFrame, middle: DataFrame, few: bool) -> DataFrame:
    """The four estimates of each group from which concentration starts."""
    x = [F.col(name) for name in FEATURES]
    rows = _with_groups(clean, middle, few)
    z = rows.select("g", *x, *[((x[i] - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in _N])
    norm = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in _N), F.lit(0.0)))
    u = z.withColumn("norm", F.greatest(norm, F.lit(1e-9)))
    sums = u.groupBy("g").agg(*_second(x, "a"), *_second([F.tanh(F.col(f"z{i}")) for i in _N], "t"), *_second([F.col(f"z{i}") / F.col("norm") for i in _N], "u"))
    all_ = cut(middle.join(sums, "g"), "starts")
    scale = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    kinds = {
        "median": ("m", lambda i, j: scale(i, i) if i == j else F.lit(0.0)),
        "tanh": ("m", lambda i, j: scale(i, j) * (F.col(f"t{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}"))),
        "sign": ("m", lambda i, j: scale(i, j) * F.col(f"u{i}{j}") * len(FEATURES)),
        "moments": ("a", lambda i, j: F.col(f"a{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")),
    }
    made = [all_.select("g", F.lit(k).alias("st"), "n", *[F.col(f"{m}{i}").alias(f"m{i}") for i in _N], *[c(i, j).cast("double").alias(f"c{i}{j}") for i, j in _PAIRS]) for k, (m, c) in kinds.items()]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return cut(_factored(out), "models")


def _distances(rows: DataFrame, models: DataFrame, few: bool) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, once for each estimate of their group, and the estimate's st and edge."""
    extra = [c for c in ("edge",) if c in models.columns]
    packed = models.groupBy("g").agg(F.first("n").alias("n"), F.collect_list(F.struct("st", *extra, *[f"m{i}" for i in _N], *[f"w{i}{j}" for i, j in _PAIRS])).alias("q"))
    packed = packed if few else cut(packed, "models")
    each = _with_groups(rows, packed, few).withColumn("q", F.explode("q"))
    gap = [F.col(x) - F.col(f"q.m{i}") for i, x in enumerate(FEATURES)]
    z = [sum((F.col(f"q.w{i}{k}") * gap[k] for k in range(i + 1)), F.lit(0.0)) for i in _N]
    return each.select(*rows.columns, "q.st", *[f"q.{c}" for c in extra], sum((v * v for v in z), F.lit(0.0)).alias("d2"))


def _concentrated(clean: DataFrame, models: DataFrame, few: bool) -> DataFrame:
    """One concentration step from each estimate."""
    bucket = F.floor(F.log1p("d2") * DISTANCE_BUCKETS)
    edges = _edges(_distances(clean, models, few), ["g", "st"], bucket, SHARE)
    known = cut(models.join(edges, ["g", "st"]), "models")
    inside = _distances(clean, known, few).filter(bucket <= F.col("edge"))
    sums = cut(inside.groupBy("g", "st").agg(F.count(F.lit(1)).cast("double").alias("h"), *_second([F.col(x) for x in FEATURES], "a")), "moments")
    names = [c for c in sums.columns if c.startswith("a")]
    whole = sums.groupBy("st").agg(*[(F.sum(F.col(c) * F.col("h")) / F.sum("h")).alias(f"w{c}") for c in names])  # one row per start
    w = F.col("h") / (F.col("h") + PRIOR)
    mixed = sums.join(F.broadcast(whole), "st").select("g", "st", *[(w * F.col(c) + (1 - w) * F.col(f"w{c}")).alias(c) for c in names])
    scatter = [((F.col(f"a{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) * CONSISTENCY).alias(f"c{i}{j}") for i, j in _PAIRS]
    estimates = mixed.select("g", "st", *[F.col(f"a{i}").alias(f"m{i}") for i in _N], *scatter)
    return cut(_factored(estimates.join(models.select("g", "st", "n"), ["g", "st"])), "models")


def outlier_distances(narrow: DataFrame) -> DataFrame:
    """narrow (one row per document, already materialised) with d2; the estimates see only rows that pass the base rules."""
    clean = narrow.filter(~F.col("base_failed")).select("g", *FEATURES)
    groups = cut(clean.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "groups")
    few = groups.count() <= shared.HOT_GROUPS
    models = _starts(clean, _medians(clean, groups, few), few)
    for _ in range(FIRST_STEPS):
        models = _concentrated(clean, models, few)
    order = Window.partitionBy("g").orderBy("det", "st")
    models = cut(models.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k"), "models")
    for _ in range(MOST_STEPS):
        new = _concentrated(clean, models, few)
        both = models.join(new.select("g", F.col("det").alias("new")), "g")
        falls = cut(both.filter(F.col("new") < F.col("det") - SETTLED).select("g"), "falls")
        if not falls.limit(1).count():
            break
        models = cut(new.join(falls, "g").unionByName(models.join(falls, "g", "left_anti")), "models")
    far = _distances(narrow, models, few).select("doc_id", *BASE_COLUMNS, "base_failed", "d2")
    none = narrow.join(F.broadcast(groups.select("g")) if few else groups.select("g"), "g", "left_anti")  # every row failed
    return far.unionByName(none.select("doc_id", *BASE_COLUMNS, "base_failed", F.lit(None).cast("double").alias("d2")))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance, kept; one row per input row.

    Null or empty text: no words, base_failed. A null group value is a group of its own. Repeated rows count as often as
    they occur; equal statistics get equal verdicts. A group without rows that pass the base rules has no estimate: its
    documents already failed. A long text is one row; its work is in proportion to its words. An empty table gives no rows.
    Columns other than the id, the text and the groups are not read, so their names cannot clash.
    """
    narrow = cut(statistics(docs, id_col, text_col, groups), "statistics")
    far = F.coalesce(F.col("d2") > cutoff, F.lit(False))
    return outlier_distances(narrow).select("doc_id", *BASE_COLUMNS, "base_failed", F.round("d2", 6).alias("distance"), (~F.col("base_failed") & ~far).alias("kept"))
