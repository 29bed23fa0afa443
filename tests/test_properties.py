"""Property tests: column helpers agree with the Python semantics they mirror."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mkpulse import functions as FN
from mkpulse.operators.scoring import _half_even

floats = st.floats(min_value=-1e12, max_value=1e12, allow_nan=False, allow_infinity=False)


@settings(max_examples=5, deadline=None)
@given(st.lists(floats, min_size=1, max_size=40))
def test_safe_int_matches_python(spark, values):
    rows = [(repr(v),) for v in values]
    got = [r.i for r in spark.createDataFrame(rows, "s string").select(FN.safe_int("s").alias("i")).collect()]
    assert got == [int(float(s)) for (s,) in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(floats.map(repr), st.sampled_from(["", "x", "nan", "1e400", "  "])), min_size=1, max_size=40))
def test_safe_float_matches_python(spark, values):
    def py(s):  # unparsable and NaN -> default 0.0; overflow stays infinite, as float() gives
        try:
            f = float(s)
        except ValueError:
            return 0.0
        return 0.0 if math.isnan(f) else f

    got = [r.f for r in spark.createDataFrame([(s,) for s in values], "s string").select(FN.safe_float("s").alias("f")).collect()]
    assert got == [py(s) for s in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=20000).map(lambda i: i / 100), min_size=1, max_size=40))
def test_half_even_matches_python_round_on_two_decimals(spark, values):
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(_half_even(F.col("v")).alias("x")).collect()]
    assert got == [float(round(v)) for v in values]  # Python rounds half to even
