"""Contextual reports replayed from published figures, and their edge cases."""

from __future__ import annotations

from helpers import column, rows
from pyspark.sql import functions as F

from shelfmetrics.functions.text import has_entry
from shelfmetrics.operators import context
from shelfmetrics.settings import SKU_PLAYBOOK, Settings

# Published results.
OCCASION_RESULT = [
    ("gym", 4106, 16.05, 22.93, 61.4, 18.7, 207319.0, 10.3, "HIGH"),
    ("religious-fasting", 5647, 16.05, 23.28, 62.7, 18.0, 280812.0, 13.9, "HIGH"),
    ("on-the-go", 4257, 15.64, 22.42, 62.5, 17.3, 207848.0, 10.3, "MODERATE"),
    ("late-night", 10629, 15.62, 22.36, 63.9, 17.0, 502068.0, 24.9, "MODERATE"),
    ("marathon-prep", 4017, 15.29, 22.92, 63.8, 17.9, 201175.0, 10.0, "MODERATE"),
    ("daily snack", 4220, 15.18, 22.41, 64.3, 17.4, 205489.0, 10.2, "MODERATE"),
    ("road-trip", 4118, 14.97, 22.54, 63.9, 18.1, 202813.0, 10.1, "LOW"),
    ("festive", 4278, 14.95, 22.19, 65.2, 17.3, 207171.0, 10.3, "LOW"),
]
MIX_RESULT = [
    ("Tier 1", "late-night", 7753, 47.4, 15.74, 45.89),
    ("Tier 1", "religious-fasting", 1579, 9.7, 16.09, 47.9),
    ("Tier 1", "festive", 1203, 7.4, 14.58, 43.85),
    ("Tier 1", "on-the-go", 1207, 7.4, 16.37, 45.1),
    ("Tier 1", "daily snack", 1193, 7.3, 14.58, 45.24),
    ("Tier 1", "gym", 1136, 7.0, 15.67, 46.81),
    ("Tier 1", "road-trip", 1151, 7.0, 15.0, 46.63),
    ("Tier 1", "marathon-prep", 1119, 6.8, 14.71, 45.85),
    ("Tier 3", "religious-fasting", 1408, 16.5, 15.8, 56.03),
    ("Tier 3", "on-the-go", 1079, 12.6, 15.12, 57.47),
    ("Tier 3", "festive", 1056, 12.4, 14.93, 56.06),
    ("Tier 3", "daily snack", 1031, 12.1, 16.11, 56.06),
    ("Tier 3", "late-night", 1034, 12.1, 15.74, 58.36),
    ("Tier 3", "gym", 1006, 11.8, 17.68, 61.39),
    ("Tier 3", "road-trip", 982, 11.5, 14.97, 55.56),
    ("Tier 3", "marathon-prep", 948, 11.1, 15.67, 60.04),
]
SIMULATION_RESULT = [
    ("Supplement", 4221, 29.37, 287917, 0.6, 297706, 9789, 274673, -13244, "RAISE"),
    ("Meal Replacement", 6776, 26.9, 395676, 0.8, 400424, 4748, 384597, -11079, "RAISE"),
    ("Protein Shake", 8853, 23.55, 440375, 1.0, 435971, -4404, 435971, -4404, "HOLD"),
    ("Healthy Snack", 5750, 16.86, 201039, 1.5, 187971, -13068, 208075, 7036, "CUT"),
    ("Electrolyte Drink", 5041, 17.35, 178904, 1.6, 165307, -13597, 186776, 7872, "CUT"),
    ("Protein Bar", 9449, 18.01, 365146, 1.4, 345428, -19718, 374640, 9494, "CUT"),
]
CLAIM_VERDICTS = {
    "vegan": (30.9, "HIGH premium power — justifies $35+"),
    "halal": (24.6, "MODERATE — supports $20–35 range"),
    "kosher": (15.3, "MODERATE — supports $20–35 range"),
    "clean-label": (14.2, "LOW — commodity, compete on volume"),
    "nut-free": (5.0, "LOW — commodity, compete on volume"),
}
STATE_TIERS = {
    "Colorado": (16.44, "PREMIUM state — support +5–10% pricing"),
    "New York": (16.11, "PREMIUM state — support +5–10% pricing"),
    "Illinois": (15.69, "MID state — standard pricing"),
    "Georgia": (14.5, "MID state — standard pricing"),
    "Texas": (14.35, "VOLUME state — price defensively"),
}


def test_occasions(frame):
    profile = frame(
        [
            (name, n, median, avg * n, n, round(low * n / 100), round(high * n / 100), revenue)
            for name, n, median, avg, low, high, revenue, *_ in OCCASION_RESULT
        ],
        "occasion string, n_transactions long, median_price double, price_sum double,"
        "priced_rows long, entry_mass_rows long, premium_luxury_rows long, revenue_sum double",
    )
    found = context.occasion_report(profile).drop("revenue_per_txn").collect()
    printed = [tuple(r)[:-1] + (r.occasion_pricing_verdict.split(" ")[0],) for r in found]
    assert printed == OCCASION_RESULT


def test_tier_mix(frame):
    profile = frame(
        [(t, o, n, median, mean * n) for t, o, n, _, median, mean in MIX_RESULT],
        "city_tier string, occasion string, n_transactions long, median_price double,"
        "revenue_sum double",
    )
    assert rows(context.mix_report(profile)) == MIX_RESULT


def test_price_change(frame):
    base = frame(
        [(c, n, avg, float(now)) for c, n, avg, now, *_ in SIMULATION_RESULT]
        + [("Unknown", 10, 30.0, 300.0), (None, 1, 1.0, 1.0)],
        "category string, n_transactions long, avg_price double, current_revenue double",
    )
    found = context.price_change_simulation(base).collect()
    printed = [tuple(r)[:-1] + (r.pricing_verdict.split(" ")[0],) for r in found]
    assert printed == SIMULATION_RESULT


def test_claim_verdicts_go_by_the_printed_share(frame):
    shares = {name: share for name, (share, _) in CLAIM_VERDICTS.items()} | {"edge": 24.95}
    profile = frame(
        [(name, 10_000, 20.0, 30.0, round(share * 100), 1.0) for name, share in shares.items()],
        "claim string, n_transactions long, median_price double, p75_price double,"
        "premium_luxury_rows long, revenue_sum double",
    )
    found = {r.claim: r for r in context.claim_report(profile).collect()}
    for name, (share, verdict) in CLAIM_VERDICTS.items():
        assert (found[name].pct_premium_luxury, found[name].claim_premium_verdict) == (
            share,
            verdict,
        )
    assert found["edge"].pct_premium_luxury == 25.0
    assert found["edge"].claim_premium_verdict.startswith("HIGH")


def test_state_tiers_go_by_the_unrounded_median(frame):
    medians = {name: median for name, (median, _) in STATE_TIERS.items()}
    medians |= {"on": 16.0, "under": 15.999}
    profile = frame(
        [(name, 1, median, 1.0, 1, 0, 1.0) for name, median in medians.items()],
        "state string, n_transactions long, median_price double, price_sum double,"
        "priced_rows long, premium_luxury_rows long, revenue_sum double",
    )
    report = context.state_report(profile)
    found = {r.state: r for r in report.collect()}
    assert {n: found[n].state_pricing_tier for n in STATE_TIERS} == {
        n: tier for n, (_, tier) in STATE_TIERS.items()
    }
    assert found["on"].state_pricing_tier.startswith("PREMIUM")
    assert found["under"].median_price == 16.0
    assert found["under"].state_pricing_tier.startswith("MID")
    assert column(report, "state")[:2] == ["Colorado", "New York"]


def test_occasion_verdicts_go_by_the_unrounded_median(frame):
    profile = frame(
        [(str(m), 1, m, 1.0, 1, 0, 0, 1.0) for m in (15.8, 15.7999, 15.0, 14.9999)],
        "occasion string, n_transactions long, median_price double, price_sum double,"
        "priced_rows long, entry_mass_rows long, premium_luxury_rows long, revenue_sum double",
    )
    found = context.occasion_report(profile).select("occasion", "occasion_pricing_verdict")
    assert [(name, verdict.split(" ")[0]) for name, verdict in rows(found)] == [
        ("15.8", "HIGH"),
        ("15.7999", "MODERATE"),
        ("15.0", "MODERATE"),
        ("14.9999", "LOW"),
    ]


def claims_of(frame, text):
    clean = frame([(text, 1.0)], "claims string, price double")
    return column(context.per_claim(clean, "price"), "claim")


def test_claims_are_split_and_trimmed_however_many(frame):
    assert claims_of(frame, "vegan") == ["vegan"]
    assert claims_of(frame, "a, b") == ["a", "b"]
    assert claims_of(frame, "a,") == ["a", ""]
    assert claims_of(frame, "") == [""]
    assert claims_of(frame, None) == []
    eleven = ", ".join(str(n) for n in range(11))
    assert claims_of(frame, eleven) == [str(n) for n in range(11)]


def test_entry_lookup_agrees_with_the_split(frame):
    texts = ["b", " a , b ", "a,b,c", "bb", "a b", "a,,", "b,", ",b", "", None]
    texts += ["0,1,2,3,4,5,6,7,8,b", "0,1,2,3,4,5,6,7,8,9,b", "a.b", "ab, b"]
    found = frame([(t,) for t in texts], "claims string").select(
        *[has_entry(F.col("claims"), entry) for entry in ("b", "a.b")]
    )
    for text, (plain, dotted) in zip(texts, rows(found)):
        listed = claims_of(frame, text)
        assert (bool(plain), bool(dotted)) == ("b" in listed, "a.b" in listed), text


def test_claim_matrix_keeps_listed_claims_with_enough_rows(frame, profiler):
    clean = frame(
        [("vegan, kosher", "Bars", 40.0)] * 3
        + [("vegan", "Shakes", 10.0)] * 2
        + [("halal", "Bars", 10.0)] * 3
        + [("halal", None, 10.0)] * 5,
        "claims string, category string, price double",
    )
    found = context.claim_category_matrix(clean, profiler, Settings(min_claim_category_rows=3))
    assert rows(found) == [
        ("vegan", "Bars", 3, 40.0, 100.0),
        ("halal", "Bars", 3, 10.0, 0.0),
    ]


def test_state_occasion_top_list(frame, profiler):
    clean = frame(
        [("Ohio", o, p, p) for o, p in [("gym", 9.0), ("gym", 9.0), ("run", 9.0), ("run", 9.0)]]
        + [("Utah", "gym", 50.0, 50.0)] * 2
        + [("Utah", "run", 99.0, 99.0), (None, "gym", 99.0, 99.0), ("Utah", None, 99.0, 99.0)],
        "state string, occasion string, price double, revenue double",
    )
    limits = Settings(min_state_occasion_rows=2, state_occasion_top=2)
    assert rows(context.state_occasion_matrix(clean, profiler, limits)) == [
        ("Utah", "gym", 2, 50.0, 100.0, 50.0),
        ("Ohio", "gym", 2, 9.0, 0.0, 9.0),
    ]


def test_city_tiers_come_in_order(frame, profiler):
    clean = frame(
        [("Tier 3", 40.0, 80.0), ("Tier 1", 10.0, 10.0), (None, 10.0, 10.0)],
        "city_tier string, price double, revenue double",
    )
    assert rows(context.city_tier_pricing(clean, profiler)) == [
        ("Tier 1", 1, 10.0, 10.0, 100.0, 0.0, 10.0),
        ("Tier 3", 1, 40.0, 40.0, 0.0, 100.0, 80.0),
    ]


def test_playbook_keeps_its_lines_and_measures_each(frame, profiler):
    clean = frame(
        [
            ("vegan, halal", "Meal Replacement", "late-night", 50.0),
            ("vegan", "Meal Replacement", "gym", 30.0),
            (None, "Protein Bar", "late-night", 10.0),
            ("vegan", "Protein Bar", None, 12.0),
        ],
        "claims string, category string, occasion string, price double",
    )
    found = {r.sku_archetype: tuple(r) for r in context.sku_playbook(clean, profiler).collect()}
    assert sorted(line[:6] for line in found.values()) == sorted(SKU_PLAYBOOK)
    measured = {name: line[6:] for name, line in found.items() if line[6] is not None}
    assert measured == {
        "Vegan Meal Replacement": (2, 30.0, 50.0),
        "Standard Protein Bar": (2, 10.0, 0.0),
        "Late-Night Bundle (Meal Repl + Protein Bar)": (2, 10.0, 50.0),
    }


def test_published_playbook(spark):
    assert rows(context.published_playbook(spark)) == list(SKU_PLAYBOOK)
