"""Providers asked page by page, with functions that stand for clients."""

from linkwright.sources import fetching, providers

CATALOG = "row_idx long, sku string, brand string, title string, ean string, gtin string"


def catalog(spark):
    return spark.createDataFrame([(1, "A-1", " Sony ", "Sony lamp", "4006381333931", None), (2, "", None, "Chair", "123", None), (3, None, "", "", None, None)], CATALOG)


def page(*names):
    return '{"results":[' + ",".join(f'{{"title":"{n}","url":"https://{n}.it/"}}' for n in names) + "]}"


def answering(pages):
    """A client with the given pages for every query."""
    return lambda: lambda query, market, n: pages[n - 1] if n <= len(pages) else page()


def nothing(body):
    return '"results":[]' in body


def failing():
    def fetch(query, market, n):
        if n == 2:
            raise ValueError("bad answer")
        if "Chair" in query:
            raise fetching.Unavailable("blocked")
        return page("a")

    return fetch


def unconnected():
    raise OSError("no route")


def test_queries_go_from_the_most_specific_on(spark):
    rows = fetching.queries_of(catalog(spark)).orderBy("catalog_idx", "query_no").collect()
    assert [(r.catalog_idx, r.query_no, r.query) for r in rows] == [(1, 0, 'Sony "A-1"'), (1, 1, '"4006381333931"'), (1, 2, "Sony lamp"), (2, 0, "Chair")]


def test_pages_are_read_until_an_empty_one(spark):
    asked = [fetching.Provider("searxng", answering([page("a", "b"), page("b"), page(), page("never")]), most_pages=9, is_empty=nothing)]
    answers = fetching.fetched(fetching.queries_of(catalog(spark)), asked, tasks=3)
    assert sorted((r.catalog_idx, r.query_no, r.page) for r in answers.collect()) == [(i, q, p) for i, q in ((1, 0), (1, 1), (1, 2), (2, 0)) for p in (1, 2)]
    hits = providers.searxng(fetching.bodies(answers, "searxng")).collect()
    assert sorted((r.catalog_idx, r.title) for r in hits) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert sorted(r.hit_idx >> 20 for r in hits if r.catalog_idx == 2) == [1, 1]


def test_most_pages_bound_a_query(spark):
    asked = [fetching.Provider("searxng", answering([page("a")] * 5), most_pages=3)]
    assert fetching.fetched(fetching.queries_of(catalog(spark)), asked).count() == 12


def test_a_failing_provider_gives_reasons_and_the_others_their_pages(spark):
    asked = [fetching.Provider("serper", failing, most_pages=2), fetching.Provider("ebay", unconnected), fetching.Provider("searxng", answering([page("ok")]))]
    answers = fetching.fetched(fetching.queries_of(catalog(spark)), asked).collect()
    assert [r.provider for r in answers][:1] != ["serper"] and [r.provider for r in answers][-1] == "serper"
    assert {r.reason for r in answers if r.provider == "ebay"} == {"OSError: no route"}
    assert sum(r.provider == "searxng" and r.reason is None for r in answers) == 4
    assert sorted((r.page, r.reason) for r in answers if r.provider == "serper" and r.reason) == [(1, "blocked")] + [(2, "ValueError: bad answer")] * 3
    frame = spark.createDataFrame(answers, fetching.ANSWERS)
    assert {(r.provider, r.reason, r.n_queries) for r in fetching.failures(frame).collect()} == {("serper", "blocked", 1), ("serper", "ValueError: bad answer", 3), ("ebay", "OSError: no route", 4)}
    assert fetching.bodies(frame, "serper").count() == 3


def test_only_available_providers_are_asked(spark):
    queries = fetching.queries_of(catalog(spark))
    off = fetching.Provider("searxng", unconnected, lambda: False)
    assert fetching.fetched(queries, [off]).count() == fetching.fetched(queries, []).count() == 0
    assert {r.provider for r in fetching.fetched(queries, [off, fetching.Provider("csv", answering([page("x")]))]).collect()} == {"csv"}
