from __future__ import annotations

import random

import pytest
from helpers import nearest_rank, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

PERCENTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}


def check(frame, profiler, groups: dict[str, list], **options):
    source = frame([(k, v) for k, vs in groups.items() for v in vs], "k string, price double")
    found = {r[0]: r[2:] for r in rows(profiler.profile(source, ["k"], PERCENTILES, **options))}
    assert found == {
        k: tuple(nearest_rank(vs, p) for p in PERCENTILES.values()) for k, vs in groups.items()
    }


NAN = float("nan")


@pytest.mark.parametrize(
    "values, wanted",
    [
        ([NAN, 1.0, 2.0, 3.0], ["1.0", "2.0", "3.0", "nan"]),
        ([NAN, NAN, NAN, 1.0, 2.0, 3.0], ["2.0", "3.0", "nan", "nan"]),
        ([NAN, float("inf"), float("-inf"), None], ["-inf", "-inf", "inf", "nan"]),
        ([NAN], ["nan"] * 4),
    ],
)
def test_nan_is_above_every_number(frame, profiler, values, wanted):
    source = frame([("k", v) for v in values], "k string, price double")
    found = profiler.profile(source, ["k"], PERCENTILES).collect()
    assert [str(v) for v in found[0][2:]] == wanted


def test_small_groups_and_ties(frame, profiler):
    check(
        frame,
        profiler,
        {"one": [9.0], "two": [1.0, 2.0], "ties": [1.0, 1.0, 1.0, 9.0], "equal": [3.0] * 7},
    )


def test_missing_values_count_below_every_number(frame, profiler):
    check(
        frame,
        profiler,
        {
            "few": [None, None, 5.0, 7.0, 9.0],
            "most": [None] * 9 + [4.0],
            "all": [None, None],
            "negative": [None, -3.0, 0.0, 0.0, 8.0],
        },
    )


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.sampled_from("abc"),
        st.lists(
            st.one_of(
                st.none(),
                st.integers(-500, 12_000).map(lambda cents: cents / 100),
                st.floats(0.01, 1e6, allow_nan=False),
                st.just(float("inf")),
            ),
            min_size=1,
            max_size=60,
        ),
        min_size=1,
    )
)
def test_matches_brute_force(frame, profiler, groups):
    check(frame, profiler, groups)


def test_share_is_compared_exactly_at_every_size(frame, profiler):
    check(frame, profiler, {f"n{n:02d}": [float(v) for v in range(n)] for n in range(1, 61)})


def test_one_price_holding_most_rows(frame, profiler):
    noise = random.Random(7)
    hot = [9.99] * 6000 + [noise.uniform(1, 100) for _ in range(3000)]
    check(frame, profiler, {"hot": hot, "cold": [noise.uniform(1, 100) for _ in range(500)]})


def test_many_values_in_one_slice(frame, profiler):
    noise = random.Random(11)
    check(frame, profiler, {"dense": [15 + noise.random() / 1000 for _ in range(4000)]})


def test_null_keys_and_small_groups_are_left_out(frame, profiler):
    source = frame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), (None, 5.0), (None, 6.0)],
        "k string, price double",
    )
    found = profiler.profile(source, ["k"], {"median": 0.5}, min_rows=2)
    assert rows(found) == [("a", 3, 2.0)]


@pytest.mark.parametrize("keys", [["k"], ["k", "l"]])
def test_measures_add_up(frame, profiler, keys):
    noise = random.Random(3)
    source = frame(
        [
            (noise.choice("ab"), noise.choice("xy"), noise.choice([None, 5.0, 20.0, 35.0]), 2.0)
            for _ in range(200)
        ],
        "k string, l string, price double, revenue double",
    )
    measures = (
        "price_sum",
        "priced_rows",
        "revenue_sum",
        "entry_mass_rows",
        "premium_luxury_rows",
    )
    found = profiler.profile(source, keys, {"median": 0.5}, measures).collect()
    data = source.collect()
    for row in found:
        group = [r for r in data if all(r[k] == row[k] for k in keys)]
        prices = [r.price for r in group if r.price is not None]
        assert row.n_transactions == len(group)
        assert row.price_sum == sum(prices) and row.priced_rows == len(prices)
        assert row.revenue_sum == 2.0 * len(group)
        assert row.entry_mass_rows == sum(p < 20 for p in prices)
        assert row.premium_luxury_rows == sum(p >= 35 for p in prices)


def test_shared_search_equals_one_search_per_key_list(frame, workspace):
    """Ten thousand prices with ties, gaps, NaN and blank keys; every key list both ways."""
    import random

    from shelfmetrics.operators.profile import Profiler, SharedSlices

    rng = random.Random(2)
    prices = [None, float("nan"), -3.0, 0.0, 9.99, *(round(rng.uniform(1, 80), 2) for _ in range(40))]
    data = [
        (rng.choice(["a", "b", "", None]), rng.choice(["x", "y", None]), rng.choice(["", "q"]), rng.choice(prices))
        for _ in range(3_000)
    ]
    clean = workspace.save(
        frame(data, "one string, two string, three string, price double").selectExpr("*", "price * 2 AS revenue"),
        "rows",
    )
    lists = (("one",), ("two",), ("three",), ("one", "two"), ("three", "one"))
    shared = Profiler(workspace, SharedSlices(workspace, clean, lists))
    alone = Profiler(workspace)
    wanted = {"middle": 0.5, "upper": 0.75, "high": 0.9}
    for keys in lists:
        for least in (0, 300):
            request = (clean, list(keys), wanted, ("priced_rows", "premium_luxury_rows"), least)
            both = [sorted(map(repr, p.profile(*request).collect())) for p in (shared, alone)]
            assert both[0] == both[1] and (both[0] or least)
