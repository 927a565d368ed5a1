"""Operator 4: a weighted URL vocabulary, matched by Aho-Corasick.

Terms are sought in the lower-case URL, and count where neither neighbour is an ASCII letter or
digit. A URL is rejected on one strict term, or on SOFT_LIMIT distinct soft ones. The automaton finds
all terms in one pass over the URL, however many they are; it is built once a task.

A null or empty URL has no term and isn't rejected; a very long one is read whole. Terms that overlap or
are listed as both count as each; two of the same term are one. Repeated rows are judged alike; an empty table
gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRICT = ("adult", "casino", "escort", "escorts", "hentai", "milf", "nsfw", "porn", "porno", "pornhub", "spam", "sex", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cam", "cheap", "click", "crack", "dating", "farm", "free", "gambling", "girls", "hot", "loan", "loans", "nude", "pharmacy", "pills", "poker", "promo", "slots", "torrent", "track", "win", "winner")
SOFT_LIMIT = 2
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in strict, term in soft))
    found.make_automaton()
    return found


def hits(machine, url: str) -> tuple[set[str], set[str]]:
    """The distinct strict and soft terms of a URL in lower case."""
    strict, soft = set(), set()
    for end, (term, is_strict, is_soft) in machine.iter(url):
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in _ALNUM) and (end + 1 == len(url) or url[end + 1] not in _ALNUM):
            if is_strict:
                strict.add(term)
            if is_soft:
                soft.add(term)
    return strict, soft


def _count(strict: tuple[str, ...], soft: tuple[str, ...], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(strict, soft) if strict or soft else None
        for batch in batches:
            n_strict, n_soft = [], []
            for url in batch.column("low").to_pylist():
                a, b = hits(machine, url) if machine and url else ((), ())
                n_strict.append(len(a))
                n_soft.append(len(b))
            reject = [a > 0 or b >= limit for a, b in zip(n_strict, n_soft)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64()), pa.array(reject, pa.bool_())], names=["page_id", "url", "n_strict", "n_soft", "reject"])

    return run


def url_verdicts(pages: DataFrame, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, url, n_strict and n_soft (distinct terms) and reject, for every row of pages."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("low", F.lower("url"))
    return urls.mapInArrow(_count(strict, soft, limit), "page_id long, url string, n_strict long, n_soft long, reject boolean")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _terms(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT" for t in terms)


ORACLE_SQL = f"""
WITH a AS (SELECT page_id, url, coalesce(lower(url), '') AS u FROM pages),
b AS (SELECT page_id, url, {_terms(STRICT)} AS n_strict, {_terms(SOFT)} AS n_soft FROM a)
SELECT page_id, url, n_strict, n_soft, n_strict > 0 OR n_soft >= {SOFT_LIMIT} AS reject FROM b
"""
