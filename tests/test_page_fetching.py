"""Pages fetched at each site's pace, by made functions and clocks."""

import pyarrow as pa
import pytest

from linkwright.operators import pages
from linkwright.sources import page_fetching
from linkwright.sources.page_fetching import Pace, Tier

LONG = "x" * 1200


class Clock:
    """Seconds that pass only by sleeping, or by what a fetch takes."""

    def __init__(self, at=100.3):
        self.at = at

    def now(self):
        return self.at

    def sleep(self, seconds):
        self.at += seconds


def batch(*rows):
    url, site, slices, number = zip(*rows, strict=True)
    return pa.record_batch({"url": list(url), "site": list(site), "slices": list(slices), "slice": list(number)})


def times(rows, clock, takes=0.0, seconds=1.0):
    found = []
    for url in page_fetching.in_turn(batch(*rows), Pace(seconds, now=clock.now, sleep=clock.sleep), {}):
        found.append((url, clock.at))
        clock.at += takes
    return found


def test_a_site_keeps_its_pace_and_sites_do_not_wait_for_each_other():
    found = times([(f"a{i}", "a", 1, 0) for i in range(4)] + [(f"b{i}", "b", 1, 0) for i in range(4)], Clock())
    for site in "ab":
        own = [t for url, t in found if url[0] == site]
        assert [round(y - x, 6) for x, y in zip(own, own[1:])] == [1.0] * 3
    assert max(t for _, t in found) < 105


@pytest.mark.parametrize("takes", [0.0, 0.4, 2.7])
def test_slices_of_a_site_share_its_pace_without_a_word(takes):
    found = sorted(t for number in range(3) for _, t in times([(f"{number}-{i}", "hot", 3, number) for i in range(5)], Clock(100.0 + number * 0.37), takes))
    assert all(y - x >= 0.999 for x, y in zip(found, found[1:]))


def test_no_pace():
    clock = Clock()
    assert len(times([(f"a{i}", "a", 1, 0) for i in range(50)], clock, seconds=0)) == 50 and clock.at == 100.3


def plain():
    def get(url, market):
        if "down" in url:
            raise TimeoutError("no answer")
        return (404, "") if "gone" in url else (200, "short" if "thin" in url else f"{market} {LONG}")

    return get


def browser():
    return lambda url, market: (200, f"drawn {LONG}") if "thin" in url else (403, "blocked")


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_ways_follow_each_other_and_failures_are_reasons(spark):
    asked = urls(spark, "https://a.it/1", "https://a.it/1", "https://a.it/thin", "https://b.it/gone", "https://b.it/down", "", None)
    got = {r.url: (r.status_code, r.fetched_by, r.ok, r.reason) for r in page_fetching.fetched(asked, [Tier("plain", plain)], pace=Pace(0)).collect()}
    assert got == {"https://a.it/1": (200, "plain", True, None), "https://a.it/thin": (200, "plain", False, None), "https://b.it/gone": (404, "plain", False, None), "https://b.it/down": (None, "plain", False, "TimeoutError: no answer")}
    both = page_fetching.fetched(asked, [Tier("plain", plain), Tier("browser", browser)], "DE", pace=Pace(0))
    got = {r.url: (r.fetched_by, r.ok) for r in both.collect()}
    assert got == {"https://a.it/1": ("plain", True), "https://a.it/thin": ("browser", True), "https://b.it/gone": ("browser", False), "https://b.it/down": ("browser", False)}
    assert {(r.url, r.html[:5]) for r in pages.good_pages(both).collect()} == {("https://a.it/1", "DE xx"), ("https://a.it/thin", "drawn")}
    assert {(r.site, r.reason, r.n_pages) for r in page_fetching.failures(both).collect()} == {("b.it", "status 403", 2)}


def test_template_asks_another_address(spark):
    tier = Tier("by", lambda: lambda url, market: (200, url + LONG), "https://un.example/?key=1&url={url}")
    rows = page_fetching.fetched(urls(spark, "https://a.it/p?q=1&r=2"), [tier], pace=Pace(0)).collect()
    assert [(r.url, r.html.split("x" * 9)[0]) for r in rows] == [("https://a.it/p?q=1&r=2", "https://un.example/?key=1&url=https%3A%2F%2Fa.it%2Fp%3Fq%3D1%26r%3D2")]


def test_a_large_site_is_several_slices(spark):
    asked = urls(spark, *(f"https://hot.it/{i}" for i in range(900)), *(f"https://s{i}.it/" for i in range(60)))
    rows = page_fetching.sliced(asked, 100).collect()
    assert {r.slices for r in rows if r.site != "hot.it"} == {1}
    sizes = [sum(r.slice == k for r in rows if r.site == "hot.it") for k in range(9)]
    assert {r.slices for r in rows if r.site == "hot.it"} == {9} and sum(sizes) == 900 and max(sizes) <= 200


def test_real_time_over_tasks(spark):
    import time

    tier = Tier("clock", lambda: lambda url, market: (200, f"{time.time():.6f} {LONG}"))
    rows = page_fetching.fetched(urls(spark, *(f"https://hot.it/{i}" for i in range(12))), [tier], pace=Pace(0.2, share=4), tasks=3).collect()
    at = sorted(float(r.html.split()[0]) for r in rows)
    assert len(at) == 12 and all(y - x > 0.1 for x, y in zip(at, at[1:]))


def test_no_addresses(spark):
    assert page_fetching.fetched(spark.createDataFrame([], "url string"), [Tier("plain", plain)]).collect() == []


def test_rows_leave_in_batches_of_bounded_size():
    """Small pages many at once, large ones alone; all in order."""
    row = lambda i, n: (f"u{i}", "x" * n if n else None, 200, "plain", True, None)
    sizes = [10] * 2500 + [600, 600, 5000, 0, 0]
    got = list(page_fetching.in_batches((row(i, n) for i, n in enumerate(sizes)), most_rows=1000, most_chars=20_000))
    assert max(b.num_rows for b in got) == 1000 and len(got) < 6
    assert [u for b in got for u in b.column("url").to_pylist()] == [f"u{i}" for i in range(len(sizes))]
    large = list(page_fetching.in_batches((row(i, n) for i, n in enumerate([9, 50, 9, 9])), most_rows=10, most_chars=30))
    assert [b.column("html").to_pylist() for b in large] == [["x" * 9], ["x" * 50], ["x" * 9, "x" * 9]]
    assert list(page_fetching.in_batches(iter(()))) == []
