"""Line dedup by rolling windows of two line hashes, which grow to runs.

Chunks between boundaries that single hashes choose were tried first and found 22 of 127 repeated passages: a passage of
a few lines rarely holds a whole chunk. So every window is looked at, and the boundaries of a chunk are where the windows
stop being repeated; they depend on the content of the chunk alone and do not shift with what stands around it.

Every two neighbouring lines that hold a word are a window, known by two hashes of each line. A window that stands anywhere
before (least document id, then least line) is repeated, and every line of it goes; so each passage of two or more lines
that occurs again is found whole, whatever lines stand around it. Windows that follow each other both here and at their
first place join into one span, the maximal equal run. Equality is of bytes: lines are grouped by hashes and bytes, and
hashes that stand for more than one line count for nothing. Partial aggregation on the map side folds frequent lines
and windows before anything is sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.llm.native import NOT_BLANK, let
from citegrid.llm.shared import cut, free_name, join_counted

WINDOW = ("a1", "a2", "b1", "b2")


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def windows_of(text: Column) -> Column:
    """array<struct<a1, a2, b1, b2, start>> of each two neighbouring lines of a text of two or more that hold a word."""

    def known(line: Column) -> Column:
        h1, h2 = _hashes(line)
        return F.struct(h1.alias("h1"), h2.alias("h2"), line.rlike(NOT_BLANK).alias("word"))

    def pairs(h: Column) -> Column:
        one = lambda a, k: let(F.get(h, k + 1), lambda b: F.struct(a["h1"].alias("a1"), a["h2"].alias("a2"), b["h1"].alias("b1"), b["h2"].alias("b2"), k.alias("start"), (a["word"] | b["word"]).alias("word")))
        return F.filter(F.transform(F.slice(h, 1, F.size(h) - 1), one), lambda w: w["word"])

    return let(F.transform(F.split(text, "\n", -1), known), pairs)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__text"))


def _runs(windows: Column) -> Column:
    """Spans (start, lines) of sorted windows (start, first): a window that follows the one before here and there continues it."""

    def follows(k: Column) -> Column:
        w, v = F.get(windows, k), F.get(windows, k - 1)
        same = (w["first"]["id"] == v["first"]["id"]) & (w["first"]["hash"] == v["first"]["hash"]) & (w["first"]["start"] == v["first"]["start"] + 1)
        return (k > 0) & (w["start"] == v["start"] + 1) & same

    def spans(begins: Column) -> Column:
        last = lambda k: F.get(windows, F.coalesce(F.get(begins, k + 1), F.size(windows)) - 1)["start"]
        return F.transform(begins, lambda b, k: F.struct(F.get(windows, b)["start"].alias("start"), (last(k) + 2 - F.get(windows, b)["start"]).alias("lines")))

    return let(F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda k: ~follows(k)), spans)


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text hash, spans): the line spans that go, one row per document that loses any."""
    keyed = _keyed(docs, id_col, text_col).filter(F.col("__id").isNotNull() & F.contains(F.col("__text"), F.lit("\n")))
    hashed = keyed.select(F.col("__id").alias("id"), F.xxhash64("__text").alias("hash"), "__text")  # once a text, not once a window
    places = hashed.select("id", "hash", F.explode(windows_of(F.col("__text"))).alias("w")).select("id", "hash", *[f"w.{c}" for c in WINDOW], "w.start")
    place = F.struct("id", "hash", "start")
    repeated = places.groupBy(*WINDOW).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).filter("first != last")
    lines = keyed.select(F.explode(F.split("__text", "\n", -1)).alias("line"))
    h1, h2 = _hashes(F.col("line"))
    unequal = F.broadcast(lines.select(h1.alias("h1"), h2.alias("h2"), "line").distinct().groupBy("h1", "h2").count().filter("count > 1"))
    for x in "ab":
        repeated = repeated.join(unequal, (F.col(f"{x}1") == F.col("h1")) & (F.col(f"{x}2") == F.col("h2")), "left_anti")
    again = (F.col("id") != F.col("first.id")) | (F.col("hash") != F.col("first.hash")) | (F.col("start") > F.col("first.start") + 1)
    # a window of many places is joined apart, so that no task gathers all of them
    gone = join_counted(places, cut(repeated.select(*WINDOW, "first", "n"), "windows"), list(WINDOW), "n").filter(again)
    found = gone.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.sort_array(F.collect_set(F.struct("start", "first"))).alias("w"))
    return found.select("__id", "__hash", _runs(F.col("w")).alias("spans"))


def _without(text: Column, spans: Column) -> Column:
    """The text without the lines of sorted spans, of which neighbours may share a line."""

    def rest(lines: Column) -> Column:
        stops = F.concat(spans, F.array(F.struct(F.size(lines).alias("start"), F.lit(0).alias("lines"))))

        def pieces(st: Column) -> Column:
            before = lambda k: F.coalesce(F.get(st, k - 1)["start"] + F.get(st, k - 1)["lines"], F.lit(0))
            return F.array_join(F.flatten(F.transform(st, lambda x, k: F.slice(lines, before(k) + 1, F.greatest(x["start"] - before(k), F.lit(0))))), "\n")

        return let(stops, pieces)

    return F.when(spans.isNull(), text).otherwise(let(F.split(text, "\n", -1), rest))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated runs of lines taken out of the text, and a last column removed_spans (array of first line and line count).

    Every input row comes out once, with all its columns, whatever their names; where the input has a column removed_spans,
    the last one has underscores in front. A text that loses everything is empty. Null text stays null. Rows with a null id
    neither lose lines nor count as copies. Rows that repeat an id with the same text are one document; with other texts
    each is judged by its own. Ties: the first place has the least id, then the least line (of texts with one id, those of
    the least hash). Spans whose first places are apart may share a line; a window that shares a line with its own first
    place stays. A long text is one row of lines; the work is in proportion to its lines. An empty table gives no rows.
    """
    own_id, own_hash, gone_id, gone_hash, spans = (free_name(docs.columns, x) for x in ("own_id", "own_hash", "gone_id", "gone_hash", "removed_spans"))
    gone = repeated_runs(docs, id_col=id_col, text_col=text_col).toDF(gone_id, gone_hash, spans)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    left = docs.withColumns({own_id: F.col(f"`{id_col}`"), own_hash: F.xxhash64(text)})
    joined = left.join(gone.hint("shuffle_hash"), (F.col(own_id) == F.col(gone_id)) & (F.col(own_hash) == F.col(gone_hash)), "left")
    columns = [_without(F.col(f"`{c}`"), F.col(spans)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, spans)


def digest(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: runs and lines removed, characters left, and the hash of the text that is left."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.coalesce(F.col(cleaned.columns[-1]), F.array().cast("array<struct<start:int,lines:int>>"))
    end = lambda x: x["start"] + x["lines"]
    own = F.transform(spans, lambda x, k: end(x) - F.greatest(x["start"], F.coalesce(end(F.get(spans, k - 1)), F.lit(0))))
    lines = F.aggregate(own, F.lit(0), lambda a, x: a + x)
    return cleaned.select(F.col(id_col).alias("doc_id"), F.size(spans).cast("bigint").alias("n_chunks_removed"), lines.cast("bigint").alias("n_lines_removed"), F.length(t).cast("bigint").alias("kept_chars"), F.sha2(t.cast("binary"), 256).alias("kept_sha256"))
