"""Author lists from an external service: what to ask, asking it, and keeping the answers.

Only identifiers that a run needs and the cache does not answer are asked. They are dealt to a few lanes; each lane asks one
after the other with a pause, so the rate is bounded by lanes / delay whatever the number of executors. Answers are written
before they are used. A new cache is written beside the old one and takes its place by renaming.
"""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.functions import text as T
from citegrid.operators.lineage import checkpointed
from citegrid.sources import files
from citegrid.sources.records import FINAL_STATUS, read_author_cache

#: Records that list fewer authors are not looked up.
LEAST_LISTED = 10
#: Status of an answer, with or without authors.
ANSWERED = "found_no_authors"
SERVICE = "https://api.crossref.org/works/"
CACHE = "doi string, authors array<string>, status string"


def work_list(records: DataFrame, cache: DataFrame, least: int = LEAST_LISTED) -> DataFrame:
    """doi: the distinct identifiers of records with at least `least` listed authors that the cache does not hold.

    records: doi, listed (array). Blank identifiers are not asked.
    """
    wanted = records.filter(F.size("listed") >= least).select(T.doi_key("doi").alias("doi")).filter("doi != ''").distinct()
    return wanted.join(cache.select("doi"), "doi", "left_anti")


def http_fetch(base: str = SERVICE, mailto: str = "", timeout: float = 20.0) -> Callable[[str], tuple[list[str] | None, str]]:
    """A look-up of one identifier over HTTP: (authors or None, status)."""
    agent = "citegrid/1.0" + (f" (mailto:{mailto})" if mailto else "")
    clean = lambda s: " ".join(str(s or "").split())

    def fetch(doi: str) -> tuple[list[str] | None, str]:
        request = urllib.request.Request(base + urllib.parse.quote(doi, safe=""), headers={"User-Agent": agent})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                people = json.load(answer).get("message", {}).get("author", [])
            names = [", ".join(x for x in (clean(p.get("family")), clean(p.get("given"))) if x) for p in people]
            return [n for n in names if n] or None, ANSWERED
        except urllib.error.HTTPError as e:
            return None, f"http_{e.code}"
        except (TimeoutError, socket.timeout):
            return None, "timeout"
        except urllib.error.URLError as e:
            return None, "timeout" if isinstance(e.reason, TimeoutError) else "connection_error"
        except (ValueError, TypeError, AttributeError):
            return None, "invalid_response"
        except OSError:
            return None, "connection_error"

    return fetch


def fetch_authors(work: DataFrame, fetch: Callable[[str], tuple[list[str] | None, str]], *, lanes: int = 4, retries: int = 2, delay: float = 0.2) -> DataFrame:
    """doi, authors, status for each identifier of work, written before it is returned. Answers and final statuses are not
    asked again; other failures are, `retries` times, after a pause that grows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doi in batch["doi"]:
                for k in range(retries + 1):
                    try:
                        authors, status = fetch(doi)
                    except OSError as e:
                        authors, status = None, f"error_{type(e).__name__}"
                    done = authors is not None or status == ANSWERED or status in FINAL_STATUS
                    time.sleep(delay * (1 if done else k + 1))
                    if done:
                        break
                rows.append((doi, authors, status))
            yield pd.DataFrame(rows, columns=["doi", "authors", "status"])

    dealt = work.select("doi").distinct().repartition(lanes, "doi")
    return checkpointed(dealt.mapInPandas(run, CACHE))


def merge_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """One entry per identifier: one with authors before one without, then a final status before others, then the newer."""
    authors, final = F.coalesce(F.size("authors"), F.lit(0)) > 0, F.col("status").isin(*FINAL_STATUS)
    both = old.select("doi", "authors", "status", F.lit(0).alias("age")).union(new.select("doi", "authors", "status", F.lit(1)))
    best = both.groupBy("doi").agg(F.max_by(F.struct("authors", "status"), F.struct(authors.alias("a"), F.coalesce(final, F.lit(False)).alias("f"), "age")).alias("e"))
    return best.select("doi", "e.authors", "e.status")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a cache that can be used again: a JSON file, or a folder that save_cache() wrote. None if there is no such path."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], CACHE)
    if files.is_file(spark, path):
        return read_author_cache(spark, path)
    return spark.read.schema(CACHE).parquet(path).filter((F.coalesce(F.size("authors"), F.lit(0)) > 0) | F.col("status").isin(*FINAL_STATUS))


def save_cache(spark: SparkSession, cache: DataFrame, path: str) -> None:
    files.swap(spark, path, lambda p: cache.write.parquet(p))


def look_up(spark: SparkSession, records: DataFrame, path: str, fetch: Callable | None, **options) -> DataFrame:
    """All entries for a run: those of the cache at path, and those asked now, which are saved. Without fetch nothing is asked."""
    known = read_cache(spark, path)
    if fetch is None:
        return known
    asked = fetch_authors(work_list(records, known), fetch, **options)
    merged = checkpointed(merge_cache(known, asked))
    if asked.limit(1).count():
        save_cache(spark, merged, path)
    return merged
