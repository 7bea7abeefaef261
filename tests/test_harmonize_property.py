"""Property: any drifted raw schema harmonises to exactly the canonical schema."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tripmart.operators.harmonize import harmonize
from tripmart.schema import COLUMN_MAP, TRIPS_ALL_SCHEMA

_TYPES = {
    "timestamp": [T.TimestampNTZType(), T.TimestampType(), T.StringType()],
    "number": [T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()],
    "float": [T.DoubleType(), T.LongType(), T.FloatType()],
    "varchar": [T.StringType(), T.DoubleType(), T.LongType()],
}
_VALUES = {
    T.TimestampNTZType: dt.datetime(2020, 1, 5, 10, 0), T.TimestampType: dt.datetime(2020, 1, 5, 10, 0),
    T.StringType: "1", T.LongType: 1, T.IntegerType: 1, T.DoubleType: 1.0, T.FloatType: 1.0,
}


@st.composite
def raw_schemas(draw):
    fields = []
    for cands, kind, _alias in COLUMN_MAP:
        if draw(st.booleans()):
            name = draw(st.sampled_from(cands))
            name = draw(st.sampled_from([name, name.lower(), name.title()]))
            fields.append(T.StructField(name, draw(st.sampled_from(_TYPES[kind]))))
    if draw(st.booleans()):
        fields.append(T.StructField("airport_fee", T.DoubleType()))   # not canonical: dropped
    return T.StructType(fields)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(raw_schemas())
def test_any_drifted_schema_harmonises(spark, schema):
    row = tuple(_VALUES[type(f.dataType)] for f in schema.fields)
    df = spark.createDataFrame([row], schema) if schema.fields else spark.range(1).select()
    out = harmonize(df, "green", 2020, "01")
    assert out.schema == TRIPS_ALL_SCHEMA or \
        [(f.name, f.dataType) for f in out.schema.fields] == \
        [(f.name, f.dataType) for f in TRIPS_ALL_SCHEMA.fields]
    r = out.first()
    present = {c.upper() for c in schema.fieldNames()}
    for cands, _kind, alias in COLUMN_MAP:
        if not any(c in present for c in cands):
            assert r[alias] is None
    assert (r["service_type"], r["year"], r["month"]) == ("green", 2020, 1)
