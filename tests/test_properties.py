import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import hashing, scoring
from tidemark.operators import islands, joins, strategies

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ITEM = "user_id bigint, item_id bigint, t bigint, lat double, lon double"


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 500)), min_size=1, max_size=40), st.integers(0, 60))
def test_sessions_do_not_depend_on_the_order_of_rows(spark, rows, gap):
    items = [(u, k, t, None, None) for k, (u, t) in enumerate(rows)]
    make = lambda r: sorted(tuple(x) for x in strategies.gap_sessions(spark.createDataFrame(r, ITEM), ["user_id"], gap, 1).select("user_id", "n", "t_from", "t_to", "digest").collect())
    first = make(items)
    random.Random(0).shuffle(items)
    assert make(items) == first
    assert sum(r[1] for r in first) == len(items)


@FEW
@given(st.lists(st.integers(0, 300), min_size=1, max_size=30), st.integers(1, 50), st.integers(1, 50))
def test_longer_gaps_never_make_more_sessions(spark, times, gap, more):
    rows = spark.createDataFrame([(1, k, t, None, None) for k, t in enumerate(times)], ITEM)
    count = lambda g: islands.gap_runs(rows, ["user_id"], g).select("run").distinct().count()
    assert count(gap + more) <= count(gap)


@FEW
@given(st.dictionaries(st.integers(0, 12), st.sets(st.integers(0, 9), min_size=1, max_size=6), min_size=1, max_size=10), st.sampled_from([0.25, 0.5, 0.75]))
def test_overlaps_are_symmetric_and_right(spark, sets, threshold):
    rows = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s], "draft_id bigint, member bigint")
    got = {(r.a, r.b): r.jaccard for r in joins.set_overlaps(rows, threshold).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in want.items() if v >= threshold - 1e-12}


@FEW
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 1)), st.floats(0.01, 1)), min_size=1, max_size=5))
def test_weighted_means_leave_unknown_parts_out(spark, parts):
    got = spark.range(1).select(scoring.weighted_mean([(F.lit(x).cast("double"), w) for x, w in parts])).first()[0]
    known = [(x, w) for x, w in parts if x is not None]
    assert got is None if not known else abs(got - sum(x * w for x, w in known) / sum(w for _, w in known)) < 1e-9


@FEW
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_hamming_counts_bits(spark, a, b):
    got = spark.range(1).select(hashing.hamming_bytes(F.lit(f"{a:016x}"), F.lit(f"{b:016x}"))).first()[0]
    assert got == (a ^ b).bit_count()
