"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1.  Two logistic models (quality, toxicity) on hashed words, word stems and text statistics are fitted with NumPy on the
    driver, on a sample of labelled documents bounded by SAMPLE rows.
2.  Every document gets the log odds of both models, in one pass without a shuffle.
3.  Per path (host and a second level) and per host, grouped aggregation sums the expected counts of good and of toxic
    documents. Beta priors are fitted by the method of moments: the global rate is the prior of hosts, each host's posterior
    mean is the prior of its paths. Sparse sites are drawn to what is above them; the strength comes from the spread of the
    sites. Host and path come from a URL where the table has one, else from two columns.
4.  Both of a document's verdicts add its own evidence to the log odds of its path relative to the global rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.llm.shared import _SPACE, cut, join_counted, mix, span_hashes, text_blocks, without_ids, word_spans

#: Labelled rows that a fit may see, and their features in all (40 bytes each on the driver); those with the least hash of
#: their id.
SAMPLE, SAMPLE_FEATURES = 8_000, 6_000_000
BUCKETS = 1 << 18
STEMS = (5, 6)
STATS = 10
#: A document goes when its posterior for good is under GOOD or that for toxic is over TOXIC.
GOOD, TOXIC = 0.5, 0.5
#: Likelihood-ratio statistic from which a feature marks toxicity.
MARK_G2 = 20.0
#: Weight of a site's log odds beside the document's own evidence.
SITE_WEIGHT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in "#*$%&|<>.,;:!?\"'()[]{}"]] = True


def features(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per block: feature buckets and documents of the distinct (document, feature) pairs, statistics, words per document.

    Features: lower-cased words without marks at their ends, and their first 5 and 6 bytes.
    """
    buf = block.buf
    starts, ends, per = word_spans(block)
    n = len(block)
    doc = np.repeat(np.arange(n), per)
    a, b = starts.copy(), ends.copy()
    for _ in range(3):  # marks at either end
        left = (a < b) & _STRIP[buf[np.minimum(a, len(buf) - 1)]]
        a[left] += 1
        right = (a < b) & _STRIP[buf[np.maximum(b - 1, 0)]]
        b[right] -= 1
    some = a < b
    a, b, d = a[some], b[some], doc[some]
    codes, docs = [], []
    whole = span_hashes(buf, a, b, True) if len(a) else np.zeros(0, np.uint64)
    codes.append(whole)
    docs.append(d)
    for k in STEMS:
        long = b - a > k
        if long.any():
            codes.append(mix(span_hashes(buf, a[long], a[long] + k, True) + np.uint64(k)))
            docs.append(d[long])
    code = np.concatenate(codes) >> np.uint64(64 - 18) if len(whole) else np.zeros(0, np.uint64)
    pair = np.unique((np.concatenate(docs).astype(np.int64) << 18) | code.astype(np.int64)) if len(whole) else np.zeros(0, np.int64)
    lens = (block.ends - block.starts).astype(float)
    at = np.minimum(block.starts, max(len(buf) - 1, 0))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(mask[buf].astype(np.int64), at).astype(float) if n else np.zeros(0)
        return np.where(lens > 0, total / np.maximum(lens, 1), 0.0)

    words = per.astype(float)
    repeat = np.zeros(n)
    if len(whole):
        same = np.concatenate(([False], (whole[1:] == whole[:-1]) & (d[1:] == d[:-1])))
        repeat = np.bincount(d[same], minlength=n) / np.maximum(words, 1)
    kinds = np.bincount(pair >> 18, minlength=n).astype(float) if len(pair) else np.zeros(n)
    upper, letter = share(_UPPER), share(_LETTER)
    blank = share(_SPACE)
    stats = np.stack(
        [
            np.sqrt(share(_SYMBOL)),
            np.where(letter > 0, upper / np.maximum(letter, 1e-9), 0.0),
            np.sqrt(share(_DIGIT)),
            np.sqrt(repeat),
            np.log1p(words) / 10,
            (np.log1p(lens) - np.log1p(words)) / 3,
            kinds / np.maximum(words, 1) / 3,
            blank,
            (words < 10).astype(float),
            1.0 - letter - blank,
        ],
        axis=1,
    )
    return pair & (BUCKETS - 1), pair >> 18, stats, per


class Model:
    """Quality: logistic in average word evidence and statistics. Toxicity: logistic in a document's marked features."""

    def __init__(self, weights: np.ndarray, stats: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray, marks: np.ndarray, toxic: np.ndarray):
        self.weights, self.stats, self.bias, self.mean, self.scale, self.marks, self.toxic = weights, stats, bias, mean, scale, marks, toxic

    def parts(self) -> tuple:
        return self.weights, self.stats, self.bias, self.mean, self.scale, self.marks, self.toxic

    def log_odds(self, bucket: np.ndarray, doc: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(stats)
        norm = np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
        good = ((stats - self.mean) / self.scale) @ self.stats + self.bias + np.bincount(doc, self.weights[bucket], minlength=n) / norm
        bad = mark_evidence(self.marks, bucket, doc, n) @ self.toxic
        return np.clip(np.stack((good, bad), axis=1), -30, 30)


def mark_evidence(marks: np.ndarray, bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: 1, number and summed weight of its marked features (as logarithms), their largest weight, its length."""
    w = marks[bucket]
    hit = w > 0
    number = np.bincount(doc[hit], minlength=n).astype(float)
    total = np.bincount(doc[hit], w[hit], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc[hit], w[hit])
    length = np.log1p(np.bincount(doc, minlength=n).astype(float)) / 10
    return np.stack((np.ones(n), np.log1p(number), np.log1p(total), most / 5, length), axis=1)


def marked_features(bucket: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log ratio of each feature that is significantly more frequent in documents with y = 1; 0 for all others."""
    k1, k0 = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    c1 = np.bincount(bucket[y[doc] == 1], minlength=BUCKETS).astype(float)
    c0 = np.bincount(bucket[y[doc] == 0], minlength=BUCKETS).astype(float)
    e1 = (c1 + c0) * k1 / (k1 + k0)
    e0 = (c1 + c0) - e1
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(c1 > 0, c1 * np.log(c1 / e1), 0.0) + np.where(c0 > 0, c0 * np.log(c0 / e0), 0.0))
    ratio = np.log((c1 + 0.25) / (k1 + 0.5)) - np.log((c0 + 0.25) / (k0 + 0.5))
    return np.where((g2 >= MARK_G2) & (ratio > 1.0), ratio, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        d = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + d
        if np.abs(d).max() < 1e-6:
            break
    return w


def fit(bucket: np.ndarray, doc: np.ndarray, stats: np.ndarray, labels: np.ndarray, rounds: int = 160) -> Model:
    """labels: (n, 2) of 0 and 1, NaN where unknown: quality, toxicity.

    Quality: full-batch gradient descent with per-weight step sizes over the average word evidence and the statistics;
    features in fewer than three documents get no weight. Toxicity: features are marked by a likelihood-ratio test; how a
    document's marks add up is fitted on folds whose marks come from the other fold.
    """
    n = len(stats)
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    known = ~np.isnan(labels[:, 1])
    toxic_label = np.where(known, labels[:, 1], -1.0)
    marks, toxic = np.zeros(BUCKETS), np.array([-4.0, 0, 0, 0, 0])
    if (toxic_label == 1).any():
        marks = marked_features(bucket, doc, toxic_label)
        fold = np.arange(n) % 2
        crossed = [mark_evidence(marked_features(bucket, doc, np.where(fold == f, -1.0, toxic_label)), bucket, doc, n)[(fold == f) & known] for f in (0, 1)]
        toxic = logistic(np.concatenate(crossed), np.concatenate([toxic_label[(fold == f) & known] for f in (0, 1)]))
    z = (stats - mean) / scale
    keep = np.bincount(bucket, minlength=BUCKETS)[bucket] >= 3
    bucket, doc = bucket[keep], doc[keep]
    used, local = np.unique(bucket, return_inverse=True)
    norm = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    known = ~np.isnan(labels[:, 0])
    y = np.where(known, labels[:, 0], 0.0)
    rate = float(np.clip(y[known].mean() if known.any() else 0.5, 1e-3, 1 - 1e-3))
    w, s, c = np.zeros(len(used)), np.zeros(STATS), 0.0
    gw, gs, gc = np.full(len(used), 1e-6), np.full(STATS, 1e-6), 1e-6
    weight = np.where(known, np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)), 0.0)
    total = max(weight.sum(), 1.0)
    for _ in range(rounds):
        t = np.bincount(doc, w[local], minlength=n) * norm + z @ s + c
        e = (1 / (1 + np.exp(-np.clip(t, -30, 30))) - y) * weight / total
        dw = np.bincount(local, (e * norm)[doc], minlength=len(used)) + 1e-5 * w
        ds, dc = z.T @ e + 1e-4 * s, e.sum()
        gw, gs, gc = gw + dw**2, gs + ds**2, gc + dc**2
        w, s, c = w - 0.1 * dw / np.sqrt(gw), s - 0.3 * ds / np.sqrt(gs), c - 0.3 * dc / np.sqrt(gc)
    # the classes were balanced; shift back to the sample's rate, so that the output is a log odds there
    c += np.log(rate / (1 - rate))
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, s, float(c), mean, scale, marks, toxic)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on at most `sample` labelled documents with `most_features` features, those with the least hashes of their ids; the
    bound makes their ids a safe broadcast."""
    known = labels.filter(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    part = known.select(F.col(id_col).alias("label_id"), F.xxhash64(id_col).alias("h"), F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("x")).orderBy("h", "label_id", "q", "x").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    joined = texts.join(F.broadcast(part), F.col("doc_id") == F.col("label_id")).select("t", "h", "q", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            bucket, doc, stats, _ = features(block)
            upto = np.searchsorted(doc, np.arange(len(block) + 1))
            lists = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), pa.array(np.diff(upto), pa.int64()), pa.array(list(stats), pa.list_(pa.float64())), *(block.rows.column(k) for k in (1, 2, 3))], ["f", "n", "s", "h", "q", "x"])

    found = cut(joined.mapInArrow(run, "f binary, n bigint, s array<double>, h bigint, q double, x double"), "sample")
    sizes = found.select("h", "n").toArrow()  # at most `sample` rows, or as often as they repeat
    by = np.argsort(np.asarray(sizes["h"]), kind="stable")
    hashes, upto = np.asarray(sizes["h"])[by], np.cumsum(np.asarray(sizes["n"])[by])
    inside = int(np.searchsorted(upto, most_features, "right"))
    if inside < len(hashes):
        found = found.filter(F.col("h") < F.lit(int(hashes[inside])))
    rows = found.orderBy("h", "f").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(BUCKETS), np.zeros(STATS), 4.0, np.zeros(STATS), np.ones(STATS), np.zeros(BUCKETS), np.array([-4.0, 0, 0, 0, 0]))
    sizes = np.asarray(rows["n"])
    bucket = np.frombuffer(b"".join(rows["f"].to_pylist()), "<i4")
    target = np.stack([np.array(rows[c].to_pylist(), float) for c in ("q", "x")], axis=1)
    stats = np.array(rows["s"].to_pylist())
    del rows
    return fit(bucket, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), stats, target)


def evidence(docs: DataFrame, model: Model, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, good and toxic (log odds); one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*shared.value)
        for block in text_blocks(batches, 3):
            bucket, doc, stats, _ = features(block)
            odds = judge.log_odds(bucket, doc, stats)
            yield pa.RecordBatch.from_arrays([*(block.rows.column(k) for k in range(3)), pa.array(odds[:, 0]), pa.array(odds[:, 1])], ["doc_id", "host", "path", "good", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"doc_id {kind}, host string, path string, good double, toxic double")


def site_of(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and first part of the path of a URL; null and what is no URL: empty."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return host, F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def _strength(sites: DataFrame, of: str, rate: Column, least: float = 2.0, most: float = 200.0) -> float:
    """Prior strength by moments: rate * (1 - rate) / spread of the sites beyond sampling noise, less one."""
    wide = sites.filter("n >= 5").agg(F.count(F.lit(1)).alias("k"), F.avg((F.col(of) / F.col("n") - rate) ** 2).alias("v"), F.avg(rate * (1 - rate) / F.col("n")).alias("noise"), F.avg(rate * (1 - rate)).alias("top")).first()
    if not wide["k"] or wide["k"] < 2 or wide["v"] is None:
        return 20.0
    extra = max(wide["v"] - wide["noise"], 1e-6)
    return float(np.clip(wide["top"] / extra - 1, least, most))


def site_posteriors(seen: DataFrame, kinds: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """host, path, n and for each kind of log odds its posterior rate per path and the global rate (good_rate, good_all, ...)."""
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = cut(seen.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(p(k)).alias(k) for k in kinds]), "sites")
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in kinds]).first()
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths"), *[F.sum(k).alias(k) for k in kinds]), "hosts")
    rates = {k: float(np.clip((total[k] + 1) / (total["n"] + 2), 1e-3, 1 - 1e-3)) if total["n"] else 0.5 for k in kinds}
    above = {k: _strength(hosts, k, F.lit(r)) for k, r in rates.items()}
    known = hosts.select("host", "paths", *[((F.col(k) + above[k] * r) / (F.col("n") + above[k])).alias(f"{k}_host") for k, r in rates.items()])
    under = cut(join_counted(paths, known, ["host"], "paths"), "sites")
    strength = {k: _strength(under, k, F.col(f"{k}_host")) for k in kinds}
    own = [((F.col(k) + strength[k] * F.col(f"{k}_host")) / (F.col("n") + strength[k])).alias(f"{k}_rate") for k in kinds]
    return under.select("host", "path", "n", *own, *[F.lit(r).alias(f"{k}_all") for k, r in rates.items()])


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", url_col: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality and toxic (posterior probabilities), site_rate (of good documents), kept; one row per input row.

    url_col: where the table has URLs, host and path come from them. Null or empty text has no word evidence and is judged by
    its statistics and its site. Null hosts or paths are a site of their own. Null ids stay null. Rows that repeat count as
    often as they occur; equal rows get equal verdicts. Without labels only the priors speak and everything is kept. A long
    text is a block of its own. An empty table gives no rows. Columns other than those named are not read, so their names
    cannot clash.
    """
    host, path = site_of(F.col(f"`{url_col}`")) if url_col else (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in (host_col, path_col))
    model = train(docs, labels, id_col, text_col, sample)
    seen = cut(evidence(docs, model, id_col, text_col, host, path), "evidence")
    odds = lambda p: F.log(p / (1 - p))
    joined = join_counted(seen, site_posteriors(seen), ["host", "path"], "n")
    posterior = lambda k: 1 / (1 + F.exp(-(F.col(k) + SITE_WEIGHT * (odds(F.col(f"{k}_rate")) - odds(F.col(f"{k}_all"))))))
    out = joined.select("doc_id", posterior("good").alias("quality"), posterior("toxic").alias("toxic"), F.col("good_rate").alias("site_rate"))
    return out.withColumn("kept", (F.col("quality") >= GOOD) & (F.col("toxic") <= TOXIC))


def keep_good(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """docs without the documents that the classifier rejects, with all columns, whatever their names.

    Rows with a null id stay. Of rows that share an id all go if one is rejected. Without labels everything stays.
    """
    gone = classify(docs, labels, **columns).filter("not kept").select("doc_id")
    return without_ids(docs, gone, columns.get("id_col", "doc_id"))
