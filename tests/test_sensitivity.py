"""Reports replayed from published counts, and their edge cases."""

from __future__ import annotations

import pytest
from helpers import rows
from pyspark.sql import functions as F

from shelfmetrics.operators import sensitivity
from shelfmetrics.settings import PRICE_BIN_EDGES, PRICE_BUCKETS, PRICE_THRESHOLDS

LABELS = [label for _, label in PRICE_BUCKETS]

# Published results.
BIN_RESULT = [
    ("$0–5", 314, 0.8, None, ""),
    ("$5–10", 9076, 22.0, -2790.4, ""),
    ("$10–15", 10668, 25.8, -17.5, ""),
    ("$15–20", 6152, 14.9, 42.3, "◄ THRESHOLD"),
    ("$20–25", 3635, 8.8, 40.9, "◄ THRESHOLD"),
    ("$25–30", 2115, 5.1, 41.8, "◄ THRESHOLD"),
    ("$30–35", 2053, 5.0, 2.9, ""),
    ("$35–40", 1202, 2.9, 41.5, "◄ THRESHOLD"),
    ("$40–45", 1511, 3.7, -25.7, ""),
    ("$45–50", 989, 2.4, 34.5, ""),
    ("$50–55", 872, 2.1, 11.8, ""),
    ("$55–65", 1052, 2.5, -20.6, ""),
    ("$65+", 1633, 4.0, -55.2, ""),
]
CLIFF_RESULT = [
    ("B: 10–20 (mass)", 16820, 9390, -79.1, "Gradual decline"),
    ("C: 20–35 (mid)", 7803, 16820, 53.6, "HARD CLIFF — avoid crossing"),
    ("D: 35–55 (premium)", 4574, 7803, 41.4, "CLIFF — price with caution"),
    ("E: 55+ (luxury)", 2685, 4574, 41.3, "CLIFF — price with caution"),
]
BUCKET_RESULT = [
    ("A: <10 (entry)", 9390, 22.8, 7.77, 7.79, 163248.0, 8.1, 17.39, 0.36),
    ("B: 10–20 (mass)", 16820, 40.8, 14.28, 14.07, 487298.0, 24.2, 28.97, 0.59),
    ("C: 20–35 (mid)", 7803, 18.9, 26.24, 25.58, 423791.0, 21.0, 54.31, 1.11),
    ("D: 35–55 (premium)", 4574, 11.1, 44.34, 43.93, 442935.0, 22.0, 96.84, 1.98),
    ("E: 55+ (luxury)", 2685, 6.5, 79.11, 71.64, 497424.0, 24.7, 185.26, 3.8),
]
PERSONA_COUNTS = {
    "budget": (2182, 3906, 1871, 1070, 608),
    "casual": (2167, 4035, 1840, 1026, 646),
    "fitness": (2337, 3907, 1914, 1119, 656),
    "premium": (2181, 3993, 1768, 1096, 618),
}
PERSONA_RESULT = [
    ("casual", 9714, 22.3, 41.5, 18.9, 10.6, 6.7, 3.71, 17.2),
    ("budget", 9637, 22.6, 40.5, 19.4, 11.1, 6.3, 3.63, 17.4),
    ("premium", 9656, 22.6, 41.4, 18.3, 11.4, 6.4, 3.6, 17.8),
    ("fitness", 9933, 23.5, 39.3, 19.3, 11.3, 6.6, 3.52, 17.9),
]
PERSONA_DROPS = {
    "budget": ((-79.0, "Gradual"), (52.1, "HARD CLIFF"), (42.8, "CLIFF"), (43.2, "CLIFF")),
    "casual": ((-86.2, "Gradual"), (54.4, "HARD CLIFF"), (44.2, "CLIFF"), (37.0, "CLIFF")),
    "fitness": ((-67.2, "Gradual"), (51.0, "HARD CLIFF"), (41.5, "CLIFF"), (41.4, "CLIFF")),
    "premium": ((-83.1, "Gradual"), (55.7, "HARD CLIFF"), (38.0, "CLIFF"), (43.6, "CLIFF")),
}


@pytest.fixture(scope="module")
def sold(spark):
    """One row per published transaction, priced at the lower edge of its bin."""
    per_bin = [(edge, n) for edge, (_, n, *_) in zip(PRICE_BIN_EDGES, BIN_RESULT)]
    bins = spark.createDataFrame(per_bin, "edge int, n int")
    priced = bins.select(
        F.col("edge").cast("double").alias("price"), F.explode(F.sequence(F.lit(1), F.col("n")))
    ).select("price")
    from shelfmetrics.functions.prices import price_bucket

    return priced.withColumn("price_bucket", price_bucket(F.col("price")))


def test_bins(sold):
    assert rows(sensitivity.demand_by_bin(sensitivity.bin_counts(sold))) == BIN_RESULT


def test_bucket_cliffs(sold):
    assert rows(sensitivity.demand_cliffs(sensitivity.bucket_counts(sold))) == CLIFF_RESULT


def test_threshold_advice_measures_the_published_drops(spark, sold):
    measured = rows(sensitivity.threshold_decisions(sold))
    assert measured == list(PRICE_THRESHOLDS)
    assert rows(sensitivity.published_thresholds(spark)) == measured


def test_bucket_shares_start_from_the_printed_revenue(frame):
    profile = frame(
        [
            (label, n, avg * n, n, median, revenue)
            for label, n, _, avg, median, revenue, *_ in BUCKET_RESULT
        ],
        "price_bucket string, n_transactions long, price_sum double, priced_rows long,"
        "median_price double, revenue_sum double",
    )
    assert rows(sensitivity.bucket_report(profile)) == BUCKET_RESULT


@pytest.fixture
def persona_counts(frame):
    return frame(
        [
            (persona, label, n)
            for persona, counts in PERSONA_COUNTS.items()
            for label, n in zip(LABELS, counts)
        ],
        "persona string, price_bucket string, n_transactions long",
    )


def test_persona_mix(persona_counts):
    assert rows(sensitivity.persona_sensitivity(persona_counts)) == PERSONA_RESULT


def test_persona_cliffs(persona_counts):
    expected = [
        (persona, LABELS[at + 1], counts[at + 1], counts[at], *PERSONA_DROPS[persona][at])
        for persona, counts in PERSONA_COUNTS.items()
        for at in range(4)
    ]
    assert rows(sensitivity.persona_cliffs(persona_counts)) == expected


def test_persona_without_dear_purchases_has_no_score(frame):
    counts = frame(
        [("budget", LABELS[0], 4)], "persona string, price_bucket string, n_transactions long"
    )
    assert rows(sensitivity.persona_sensitivity(counts)) == [
        ("budget", 4, 100.0, 0.0, 0.0, 0.0, 0.0, None, 0.0)
    ]


def test_unknown_and_missing_personas_are_left_out(frame):
    clean = frame(
        [("budget", "A"), ("unknown", "A"), (None, "A")], "persona string, price_bucket string"
    )
    assert rows(sensitivity.persona_bucket_counts(clean)) == [("budget", "A", 1)]


def test_cliff_classes_need_more_than_the_cut(frame):
    counts = frame(
        [("A", 1000), ("B", 500), ("C", 325), ("D", 210), ("E", 104)],
        "price_bucket string, n_transactions long",
    )
    assert [r[3:] for r in rows(sensitivity.demand_cliffs(counts))] == [
        (50.0, "CLIFF — price with caution"),
        (35.0, "Gradual decline"),
        (35.4, "CLIFF — price with caution"),
        (50.5, "HARD CLIFF — avoid crossing"),
    ]


def test_bin_flag_needs_more_than_forty(frame):
    counts = frame([(1, 100), (2, 60), (3, 35)], "bin_order int, n long")
    assert [r[3:] for r in rows(sensitivity.demand_by_bin(counts))] == [
        (None, ""),
        (40.0, ""),
        (41.7, "◄ THRESHOLD"),
    ]


def test_missing_bucket_takes_part_in_cliffs_but_not_in_the_profile(frame, profiler):
    clean = frame(
        [(None, None, None)] * 2 + [("A: <10 (entry)", 5.0, 5.0)],
        "price_bucket string, price double, revenue double",
    )
    assert rows(sensitivity.demand_cliffs(sensitivity.bucket_counts(clean))) == [
        ("A: <10 (entry)", 1, 2, 50.0, "CLIFF — price with caution")
    ]
    assert [r[:3] for r in rows(sensitivity.demand_by_bucket(clean, profiler))] == [
        ("A: <10 (entry)", 1, 100.0)
    ]


def test_negative_price_has_a_bucket_but_no_bin(frame):
    clean = frame([(-2.0,), (3.0,), (4.0,)], "price double")
    assert rows(sensitivity.demand_by_bin(sensitivity.bin_counts(clean))) == [
        (None, 1, 33.3, None, ""),
        ("$0–5", 2, 66.7, -100.0, ""),
    ]


def test_age_groups_come_in_age_order(frame, profiler):
    clean = frame(
        [("55+", 40.0), ("18-24", 5.0), ("other", 5.0), ("35-44", 20.0), (None, 9.0)],
        "age_group string, price double",
    )
    assert rows(sensitivity.age_sensitivity(clean, profiler)) == [
        ("other", 1, 5.0, 100.0, 0.0),
        ("18-24", 1, 5.0, 100.0, 0.0),
        ("35-44", 1, 20.0, 0.0, 0.0),
        ("55+", 1, 40.0, 0.0, 100.0),
    ]


def test_threshold_without_rows_below_has_no_drop(frame):
    clean = frame([(60.0,)], "price double")
    assert {r[2] for r in rows(sensitivity.threshold_decisions(clean))} == {None}


def test_shares_of_a_report_add_up(sold, profiler):
    clean = sold.withColumn("revenue", F.col("price"))
    found = sensitivity.demand_by_bucket(clean, profiler).collect()
    assert abs(sum(r.pct_of_demand for r in found) - 100) < 0.5
    assert abs(sum(r.pct_of_revenue for r in found) - 100) < 0.5
    assert [r.n_transactions for r in found] == [9390, 16820, 7803, 4574, 2685]
