"""What the landscape writes on its way."""

from linkwright import queries
from linkwright.operators import ordering


def test_only_what_orders_the_rows_is_written(spark, sf, monkeypatch):
    """Addresses, shops and prices of a row come after its place, as far as they are asked for; before, all of them were written."""
    written = []
    stored = ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda df: written.append(df.columns) or stored(df))
    assert queries.landscape_rows(spark, sf).count()
    (columns,) = written
    assert {"catalog_idx", "landed", "cand_rank"} <= set(columns)
    assert not {"url", "seller", "source_id", "ex_vat", "incl_vat", "shipping_cost", "details"} & set(columns)
