from __future__ import annotations

import datetime as dt
from decimal import Decimal

from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmetrics.operators.cleaning import (
    clean_competitor_pricing,
    clean_consumer_insights,
    clean_geography,
    clean_product_metadata,
    dedup_transactions,
)
from shelfmetrics.sources.tables import SCHEMAS


def test_product_spelling_blanks_and_nulls(frame):
    source = frame(
        [
            ("p1", "Proten Shake", "vegan", " whey ", "Single"),
            ("p2", "Protein bar ", "vegan", "", "Single"),
            ("p3", "", "vegan", "   ", "Single"),
            ("p4", " Healthy Snack", "vegan", None, "Single"),
            ("p5", None, None, "soy", "Single"),
        ],
        SCHEMAS["product_metadata"],
    )
    assert [(r[1], r[3]) for r in rows(clean_product_metadata(source))] == [
        ("Protein Shake", "whey"),
        ("Protein Bar", None),
        ("Unknown", None),
        ("Healthy Snack", None),
        (None, "soy"),
    ]


def test_consumer_persona(frame):
    source = frame(
        [(str(n), p, "a", "b", "c", "d", "e") for n, p in enumerate(["", " ", " budget ", None])],
        SCHEMAS["consumer_insights"],
    )
    cleaned = clean_consumer_insights(source)
    assert [r[1] for r in rows(cleaned)] == ["unknown", "unknown", "budget", None]
    assert cleaned.columns == SCHEMAS["consumer_insights"].names


def test_geography_names_and_unknown_tier(frame):
    source = frame(
        [
            ("o1", "NY", "Tier 1", "gym"),
            ("o2", "Calfornia", "Unknown", "gym"),
            ("o3", "Texas", None, "gym"),
            ("o4", None, "Tier 2", None),
        ],
        SCHEMAS["geography_occasion"],
    )
    assert rows(clean_geography(source)) == [
        ("o1", "New York", "Tier 1", "gym"),
        ("o2", "California", None, "gym"),
        ("o3", "Texas", None, "gym"),
        ("o4", None, "Tier 2", None),
    ]


def test_competitor_prices_drop_blanks_and_keep_repeated_days(frame):
    source = frame(
        [
            ("c1", "12.66", "2025-06-09 20:07:07.233252"),
            ("c1", "12.66", "2025-06-09 08:00:00.000000"),
            ("c1", "", "2025-06-10 20:07:07.233252"),
            ("c1", "  ", "2025-06-11 20:07:07.233252"),
            ("c1", None, "2025-06-12 20:07:07.233252"),
            ("c2", "13.375", "2026-01-14 00:00:00"),
        ],
        SCHEMAS["competitor_pricing"],
    )
    assert rows(clean_competitor_pricing(source)) == [
        ("c1", Decimal("12.66"), dt.date(2025, 6, 9)),
        ("c1", Decimal("12.66"), dt.date(2025, 6, 9)),
        ("c2", Decimal("13.38"), dt.date(2026, 1, 14)),
    ]


def test_dedup_keeps_the_earliest_row_and_breaks_ties(frame):
    day = dt.datetime
    source = frame(
        [
            ("o1", "u1", "p2", 5.0, 1, day(2025, 1, 2), "App"),
            ("o1", "u1", "p9", 6.0, 1, day(2025, 1, 1), "App"),
            ("o1", "u1", "p1", 7.0, 1, day(2025, 1, 1), "App"),
            ("o2", "u2", "p1", 8.0, 1, day(2025, 1, 3), "App"),
            ("o3", "u2", "p1", 8.0, 1, day(2025, 1, 3), "App"),
            ("o3", "u2", "p1", None, 1, None, "App"),
            (None, "u2", "p1", 8.0, 1, day(2025, 1, 3), "App"),
            (None, "u2", "p2", 8.0, 1, day(2025, 1, 2), "App"),
        ],
        SCHEMAS["transactions"],
    )

    def kept(*tie_break):
        found = dedup_transactions(source, tie_break)
        assert found.columns == SCHEMAS["transactions"].names
        return sorted(((r[0] or "", r[2], r[3]) for r in rows(found)), key=str)

    others = [("o2", "p1", 8.0), ("o3", "p1", None)]
    assert kept("product_id") == [("", "p2", 8.0), ("o1", "p1", 7.0), *others]
    assert kept("price") == [("", "p2", 8.0), ("o1", "p9", 6.0), *others]
    assert kept() == kept("user_id", "product_id")


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["o1", "o2", "o3"]),
            st.integers(1, 3),
            st.sampled_from([-1.0, 2.0, 3.5]),
        ),
        min_size=1,
        max_size=30,
    )
)
def test_dedup_matches_the_plain_minimum(frame, sales):
    lines = [
        (order, "u", "p", price, 1, dt.datetime(2025, 1, day), "App") for order, day, price in sales
    ]
    kept = dedup_transactions(frame(lines, SCHEMAS["transactions"]).repartition(3), ("price",))
    expected = [
        min((r for r in lines if r[0] == order), key=lambda r: (r[5], r[3]))
        for order in sorted({r[0] for r in lines})
    ]
    assert sorted(rows(kept)) == expected


def test_price_by_numeric_prefix(frame):
    """The number a text begins with, as MySQL reads it, and what data_quality says of it."""
    from shelfmetrics import Settings
    from shelfmetrics.operators.quality import data_quality
    from shelfmetrics.sources.tables import SourceTables

    given = {
        "12.5x": "12.50", " 7": "7.00", "-3.005 each": "-3.01", "+.5": "0.50", "1e2 or so": "100.00", "5.": "5.00",
        "$4": "0.00", "abc": "0.00", ".": "0.00", "1e99": "99999999.99", "-123456789012": "-99999999.99",
        "1e-99999999999": "0.00", "9.994999999999": "9.99", "12,5": "12.00", "1e": "1.00", "0x1F": "0.00",
    }
    rows_given = [(f"c{k}", text, "2025-01-01 00:00:00") for k, text in enumerate([*given, None, " "])]
    prices = frame(rows_given, "competitor_product_id string, price string, timestamp string")
    option = Settings(numeric_prefix=True)
    found = {r[0]: str(r[1]) for r in rows(clean_competitor_pricing(prices, option))}
    assert found == {f"c{k}": value for k, value in enumerate(given.values())}
    plain = {r[0]: r[1] for r in rows(clean_competitor_pricing(prices))}
    assert str(plain["c1"]) == "7.00" and plain["c0"] is None and len(plain) == len(found)

    sold = frame([], "price double, quantity int")
    tables = SourceTables(sold, sold, sold, sold, prices)
    counts = {(r[0], r[1]): r[2] for r in rows(data_quality(tables, option))}
    assert counts["competitor_pricing", "price unreadable"] == 3
    cut = counts["competitor_pricing", "price cut short"]
    unread = {(r[0], r[1]): r[2] for r in rows(data_quality(tables))}["competitor_pricing", "price unreadable"]
    assert unread == cut + 3 == sum(value is None for value in plain.values())
