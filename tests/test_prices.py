from __future__ import annotations

from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmetrics.functions.prices import bin_label, bin_number, price_bucket, value_slice
from shelfmetrics.operators.ranks import COARSE, FINE

EDGES = [-1.0, 0.0, 4.99, 5.0, 10.0, 19.99, 20.0, 35.0, 54.99, 55.0, 64.99, 65.0, None]


def test_bucket_and_bin_edges(frame):
    price = F.col("price")
    found = frame([(p,) for p in EDGES], "price double").select(
        price_bucket(price), bin_label(bin_number(price))
    )
    assert rows(found) == [
        ("A: <10 (entry)", None),
        ("A: <10 (entry)", "$0–5"),
        ("A: <10 (entry)", "$0–5"),
        ("A: <10 (entry)", "$5–10"),
        ("B: 10–20 (mass)", "$10–15"),
        ("B: 10–20 (mass)", "$15–20"),
        ("C: 20–35 (mid)", "$20–25"),
        ("D: 35–55 (premium)", "$35–40"),
        ("D: 35–55 (premium)", "$50–55"),
        ("E: 55+ (luxury)", "$55–65"),
        ("E: 55+ (luxury)", "$55–65"),
        ("E: 55+ (luxury)", "$65+"),
        (None, None),
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1))
def test_slices_never_decrease_and_nest(frame, values):
    price = F.col("price")
    found = rows(
        frame([(v,) for v in values], "price double")
        .select(price, value_slice(price, COARSE), value_slice(price, FINE))
        .orderBy("price")
    )
    for (_, low, low_fine), (_, high, high_fine) in zip(found, found[1:]):
        assert low <= high and low_fine <= high_fine
    assert all(fine // (FINE // COARSE) == coarse for _, coarse, fine in found)
