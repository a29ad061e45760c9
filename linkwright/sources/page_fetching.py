"""Product pages read from their sites, by functions that the caller gives, each site at its pace.

Nothing here opens a connection, and no run reads pages unless it is asked to: the result is a table as ``pages``
takes it. A site's addresses are dealt to slices of bounded size, and time to slots of the site's pace. A slice of
m fetches only in every m-th slot, so the slices of a large site run in tasks of their own and still keep
the pace together, with no word between them; a slice that was slow, or whose task is run again, takes its next slot.
"""

from __future__ import annotations

import heapq
import math
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import offers as offer_functions
from ..operators.pages import LEAST_CHARS
from ..operators.shared import stored

#: Status and text of the page of an address, for a market.
Get = Callable[[str, str], tuple[int, str]]
PAGES = "url string, html string, status_code int, fetched_by string, ok boolean, reason string"


@dataclass(frozen=True)
class Tier:
    """A way to read pages; ``connect`` makes a worker's function. ``template`` is another address to ask, in which {url} stands for the page's."""

    name: str
    connect: Callable[[], Get]
    template: str | None = None

    def asked(self, url: str) -> str:
        return self.template.replace("{url}", quote(url, safe="")) if self.template else url


@dataclass(frozen=True)
class Pace:
    """At least ``seconds`` between a site's pages, 0 for none; a slice has about ``share`` of its addresses."""

    seconds: float = 1.0
    share: int = 1000
    now: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep

    def next_slot(self, number: int, slices: int, last: int) -> int:
        """The first slot of a slice that begins now or later, and after ``last``."""
        first = max(math.ceil(self.now() / self.seconds), last + 1)
        return first + (number - first) % slices


def sliced(urls: DataFrame, share: int) -> DataFrame:
    """url, each once and none empty, with site, slices (of its site) and slice (its own)."""
    rows = urls.where("url is not null and url <> ''").select("url").distinct().withColumn("site", offer_functions.domain(F.col("url")))
    sites = rows.groupBy("site").agg(F.ceil(F.count("*") / F.lit(share)).cast("int").alias("slices"))
    return rows.join(sites, "site").withColumn("slice", F.pmod(F.xxhash64("url"), F.col("slices")).cast("int"))


def read_by(tiers: Sequence[Tier], gets: dict[str, Get], url: str, market: str) -> tuple:
    """What the first way that gives a usable page gives, else the last one; a failure is a reason and no error."""
    row: tuple = (url, None, None, None, False, None)
    for tier in tiers:
        try:
            get = gets.get(tier.name) or gets.setdefault(tier.name, tier.connect())
            status, html = get(tier.asked(url), market)
            row = (url, html, status, tier.name, status == 200 and len(html or "") >= LEAST_CHARS, None)
        except Exception as e:
            row = (url, None, None, tier.name, False, f"{type(e).__name__}: {e}")
        if row[4]:
            break
    return row


def in_turn(batch: pa.RecordBatch, pace: Pace, last: dict[tuple[str, int], int]) -> Iterator[str]:
    """The addresses of a batch, each when its site's slice has a slot; other sites' go on while one waits."""
    waiting: dict[tuple[str, int], deque] = {}
    for url, site, slices, number in zip(*(batch.column(c).to_pylist() for c in ("url", "site", "slices", "slice")), strict=True):
        waiting.setdefault((site, number), deque()).append((url, slices))
    if pace.seconds <= 0:
        for urls in waiting.values():
            yield from (url for url, _ in urls)
        return
    slot_of = lambda key: pace.next_slot(key[1], waiting[key][0][1], last.get(key, -1))
    turns = [(slot_of(key), key) for key in waiting]
    heapq.heapify(turns)
    while turns:
        slot, key = heapq.heappop(turns)
        if slot * pace.seconds < pace.now() - pace.seconds / 10:  # missed: another may be fetching in the slot after it
            heapq.heappush(turns, (slot_of(key), key))
            continue
        pace.sleep(max(slot * pace.seconds - pace.now(), 0.0))
        last[key] = slot
        yield waiting[key].popleft()[0]
        if waiting[key]:
            heapq.heappush(turns, (slot_of(key), key))


def in_batches(rows: Iterator[tuple], most_rows: int = 1000, most_chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of PAGES as batches, each of as many rows as stay within both bounds, or of one."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string())
    names = [f.split()[0] for f in PAGES.split(", ")]
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    held: list[tuple] = []
    chars = 0
    for row in rows:
        size = len(row[0]) + len(row[1] or "")
        if held and (len(held) >= most_rows or chars + size > most_chars):
            yield made(held)
            held, chars = [], 0
        held.append(row)
        chars += size
    if held:
        yield made(held)


def fetched(urls: DataFrame, tiers: Sequence[Tier], market: str = "IT", pace: Pace = Pace(), tasks: int | None = None) -> DataFrame:
    """PAGES: a row for each address of ``urls`` (url), stored once, so that later steps do not fetch again.

    A way that gives no usable page (status 200 and 1,024 characters) is followed by the next. Slices are dealt to
    ``tasks``, by default as many as shuffles have; a lost task's slices are fetched again. Rows
    leave in batches of bounded size, so a task holds a batch of addresses and few pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gets: dict[str, Get] = {}
        last: dict[tuple[str, int], int] = {}
        return in_batches(read_by(tiers, gets, url, market) for batch in batches for url in in_turn(batch, pace, last))

    rows = sliced(urls, pace.share)
    n = tasks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartition(n, "site", "slice").mapInArrow(run, PAGES))


def failures(fetched_pages: DataFrame) -> DataFrame:
    """site, reason, n_pages: why pages could not be used; a page without a reason of its own is told by its status."""
    why = F.coalesce("reason", F.concat(F.lit("status "), F.col("status_code").cast("string")))
    return fetched_pages.where("not ok").groupBy(offer_functions.domain(F.col("url")).alias("site"), why.alias("reason")).agg(F.count("*").alias("n_pages"))
