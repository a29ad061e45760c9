"""Results as ordered CSV files that take their place when all are written."""

import csv

import pytest
from pyspark.sql import functions as F

from linkwright.sources import files


def parts(folder):
    """The rows of a folder's files, in the order of their names, headers once."""
    out = []
    for path in sorted(folder.glob("part-*.csv")):
        with open(path, newline="") as f:
            head, *rows = csv.reader(f)
            out += rows if out else [head, *rows]
    return out


def tables(spark, n):
    rows = spark.range(n).select((F.col("id") % 50).alias("catalog_idx"), F.floor(F.col("id") / 50).alias("place"), F.lit('a "b", c').alias("t")).repartition(7)
    return rows, rows.groupBy("catalog_idx").agg(F.count("*").alias("n")), spark.createDataFrame([("b", 2.0), ("a", 1.0)], "metric string, value double")


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_files_in_order_of_their_names_hold_the_order(spark, tmp_path, many_parts):
    rows, summary, stats = tables(spark, 5000)
    place = tmp_path / "run"
    files.write_landscape(str(place), rows, summary, stats)
    found = parts(place / "landscape")
    assert found[0] == ["catalog_idx", "place", "t"] and len(found) == 5001 and len(list((place / "landscape").glob("part-*.csv"))) > 1
    assert [(int(a), int(b)) for a, b, _ in found[1:]] == [(i, j) for i in range(50) for j in range(100)] and {t for *_, t in found[1:]} == {'a "b", c'}
    assert [r[0] for r in parts(place / "summary")[1:]] == [str(i) for i in range(50)] and parts(place / "stats")[1:] == [["a", "1.0"], ["b", "2.0"]]
    files.write_matches(str(place), summary, stats)
    assert {p.name for p in place.iterdir()} == {"matches", "stats"} and [p.name for p in tmp_path.iterdir()] == ["run"]


def test_a_run_that_fails_leaves_what_stood(spark, tmp_path):
    rows, _, stats = tables(spark, 100)
    place = tmp_path / "run"
    files.write_matches(str(place), rows, stats)
    before = parts(place / "matches")
    with pytest.raises(Exception):
        files.write_matches(str(place), rows, stats.select("metric", F.raise_error(F.lit("no")).alias("value")))
    assert parts(place / "matches") == before and (place / "stats").exists()


def test_one_table(spark, tmp_path):
    rows, _, _ = tables(spark, 100)
    files.write_csv(rows, str(tmp_path / "one"), ["catalog_idx", "place"])
    assert [r[:2] for r in parts(tmp_path / "one")[1:4]] == [["0", "0"], ["0", "1"], ["1", "0"]]
    files.write_csv(rows.limit(0), str(tmp_path / "one"))
    assert len(parts(tmp_path / "one")) <= 1
