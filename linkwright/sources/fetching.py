"""Asking providers: each product's queries, page by page, with a function that the caller gives.

The function stands for a client: nothing here opens a connection. It is made once in each worker and may
hold one. A provider that is not available when the run is planned is not asked; one that fails
for a query gives no more pages of it and says why, and no failure ends the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, text
from .providers import TIERS

#: The body of a page of results; None, or one that ``is_empty`` says is empty, ends a query.
Fetch = Callable[[str, str, int], str | None]
ANSWERS = "catalog_idx long, provider string, query_no int, query string, page int, body string, reason string"


class Unavailable(Exception):
    """What a function may raise for a provider that blocks or does not answer; its text is the reason."""


@dataclass(frozen=True)
class Provider:
    """``connect`` makes a worker's function of (query, market, page)."""

    name: str
    connect: Callable[[], Fetch]
    is_available: Callable[[], bool] = lambda: True
    most_pages: int = 1
    is_empty: Callable[[str], bool] = lambda body: not body


def search_queries(sku: Column, brand: Column, title: Column, ean: Column, gtin: Column) -> Column:
    """The queries for a product, the most specific first, each once: brand and quoted SKU, a valid barcode quoted, brand and title."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.trim(F.coalesce(brand, F.lit("")))
    by_sku = F.when(F.coalesce(sku, F.lit("")) != "", F.trim(F.concat(name, F.lit(" "), quoted(sku))))
    code = F.coalesce(identifiers.ean(ean), identifiers.gtin(gtin))
    asked = F.array(by_sku, quoted(code), text.search_query(brand, title))
    return F.array_distinct(F.filter(asked, lambda q: q.isNotNull() & (q != "")))


def queries_of(catalog: DataFrame) -> DataFrame:
    """catalog_idx, query_no, query of each product."""
    asked = search_queries(*(F.col(c) for c in ("sku", "brand", "title", "ean", "gtin")))
    return catalog.select(F.col("row_idx").alias("catalog_idx"), F.posexplode(asked).alias("query_no", "query"))


def answers_of(queries: DataFrame, provider: Provider, market: str = "IT", tasks: int | None = None) -> DataFrame:
    """ANSWERS: a row for each page of a query until the first empty one, and one with a reason where a page failed.

    Queries are dealt to ``tasks`` tasks, by default as they are partitioned, and rows leave as their pages are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = None
        for batch in batches:
            for idx, no, query in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = []
                for page in range(1, provider.most_pages + 1):
                    try:
                        fetch = fetch or provider.connect()
                        body = fetch(query, market, page)
                        if body is None or provider.is_empty(body):
                            break
                        rows.append((page, body, None))
                    except Exception as e:
                        rows.append((page, None, str(e) if isinstance(e, Unavailable) else f"{type(e).__name__}: {e}"))
                        break
                n = len(rows)
                columns = [[idx] * n, [provider.name] * n, [no] * n, [query] * n, *([r[k] for r in rows] for k in range(3))]
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in ANSWERS.split(", ")])

    asked = queries.select(F.col("catalog_idx").cast("long"), F.col("query_no").cast("int"), "query")
    return (asked.repartition(tasks, "catalog_idx", "query_no") if tasks else asked).mapInArrow(run, ANSWERS)


def fetched(queries: DataFrame, asked: Sequence[Provider], market: str = "IT", tasks: int | None = None) -> DataFrame:
    """The answers of all available providers, the free ones first; without any, none."""
    active = sorted((p for p in asked if p.is_available()), key=lambda p: TIERS.get(p.name, 0))
    if not active:
        return queries.sparkSession.createDataFrame([], ANSWERS)
    return reduce(DataFrame.unionByName, [answers_of(queries, p, market, tasks) for p in active])


def bodies(answers: DataFrame, provider: str) -> DataFrame:
    """catalog_idx, body, place: a provider's pages in the order in which they were asked for, as its reader takes them."""
    place = F.col("query_no").cast("long") * 1024 + F.col("page")
    return answers.where((F.col("provider") == provider) & F.col("reason").isNull()).select("catalog_idx", "body", place.alias("place"))


def failures(answers: DataFrame) -> DataFrame:
    """provider, reason, n_queries: why queries ended without their further pages."""
    return answers.where("reason is not null").groupBy("provider", "reason").agg(F.count("*").alias("n_queries"))
