"""OBT, rule sets, enrichment and quality counts on hand-made rows."""

from pyspark.sql import functions as F

from tripmart.operators import dims, marts, quality
from tests.helpers import trips, ts, zones


def _by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_rules_on_fixture_rows(spark):
    rows = [
        dict(pickup_datetime=ts("2020-01-05 00:00:59"), dropoff_datetime=ts("2020-01-05 00:01:01"),
             pu_location_id=1),                                                   # 1 min
        dict(pickup_datetime=ts("2020-01-05 10:10:00"), dropoff_datetime=ts("2020-01-05 10:00:00"),
             pu_location_id=2),                                                   # negative
        dict(pickup_datetime=ts("2020-01-05 10:00:00"), dropoff_datetime=ts("2020-01-05 10:10:00"),
             fare_amount=0.0, tip_amount=1.0, pu_location_id=3),                  # zero fare
        dict(pickup_datetime=ts("2020-01-05 10:00:00"), dropoff_datetime=ts("2020-01-05 10:10:00"),
             fare_amount=-10.0, tip_amount=-1.0, trip_distance=2.0, pu_location_id=4),
        dict(pickup_datetime=ts("2020-01-05 10:00:00"), dropoff_datetime=ts("2020-01-05 10:10:00"),
             fare_amount=1.0, tip_amount=6.0, pu_location_id=5),                  # tip 600 %
    ]
    t = trips(spark, rows).withColumn("id", F.col("pu_location_id"))
    o = marts.obt(t.drop("id")).withColumn("id", F.col("pu_location_id"))
    by = _by_id(o)
    assert by[1]["trip_minutes"] == 1
    assert by[2]["trip_minutes"] < 0
    assert by[3]["tip_pct"] is None
    assert abs(by[4]["tip_pct"] - 0.1) < 1e-12
    assert by[5]["tip_pct"] == 6.0
    clean_ids = {r["pu_location_id"] for r in marts.clean(marts.obt(t.drop("id"))).collect()}
    strict_ids = {r["pu_location_id"] for r in marts.strict(t.drop("id")).collect()}
    assert clean_ids == {1, 4}
    assert strict_ids == {1, 5}          # strict has no tip rule
    q = quality.quality_counts(marts.obt(t.drop("id"))).first()
    assert (q["trips_negativos"], q["tips_negativos"], q["tips_mayor_500pct"]) == (1, 0, 1)


def test_limits_of_both_rules(spark):
    base = ts("2020-01-06 08:00:00")
    import datetime as dt
    rows = []
    for i, m in enumerate([1, 240, 241]):
        rows.append(dict(pickup_datetime=base, dropoff_datetime=base + dt.timedelta(minutes=m),
                         pu_location_id=100 + i, fare_amount=10.0, tip_amount=1.0, trip_distance=1.0))
    for i, d in enumerate([0.0, 0.05, 0.1, 100.0, 100.01]):
        rows.append(dict(pickup_datetime=base, dropoff_datetime=base + dt.timedelta(minutes=5),
                         pu_location_id=200 + i, fare_amount=10.0, tip_amount=1.0, trip_distance=d))
    t = trips(spark, rows)
    clean_ids = sorted(r[0] for r in marts.clean(marts.obt(t)).select("pu_location_id").collect())
    strict_ids = sorted(r[0] for r in marts.strict(t).select("pu_location_id").collect())
    assert clean_ids == [100, 101, 201, 202, 203]
    assert strict_ids == [100, 101, 202, 203]


def test_obt_schema_and_counts(spark):
    t = trips(spark, [dict(pickup_datetime=ts("2020-01-05 10:00:00"),
                           dropoff_datetime=ts("2020-01-05 10:30:00"))])
    o = marts.obt(t)
    assert len(o.columns) == 24 and "passenger_count" not in o.columns
    assert marts.strict(t).columns[3] == "trip_duration_min"
    r = quality.row_counts(t, o).first()
    assert r["trips_all_rows"] == r["obt_rows"] == 1 and r["counts_match"]


def _dims(spark, zone_rows):
    return dims.build_dims(spark, zones(spark, zone_rows))


def test_enrich_codes_zones_speed(spark):
    z = [(1, "Manhattan", "Midtown", "Yellow Zone"), (2, "Queens", "JFK", "Airports")]
    rows = []
    for i, (pay, vendor) in enumerate([("1", "1"), ("1.0", "2"), ("CMT", "CMT"), ("9", None), (None, "1")]):
        rows.append(dict(pickup_datetime=ts("2020-01-05 10:00:00"),
                         dropoff_datetime=ts("2020-01-05 10:30:00"), payment_type=pay,
                         vendor_id=vendor, rate_code_id="2", pu_location_id=1,
                         do_location_id=99, fare_amount=10.0 + i))
    rows.append(dict(pickup_datetime=ts("2020-01-05 10:00:00"), dropoff_datetime=ts("2020-01-05 10:00:00"),
                     fare_amount=50.0, trip_distance=1.0, pu_location_id=2))
    t = trips(spark, rows)
    d = _dims(spark, z)
    assert d.zones_small and d.zones_unique
    e = marts.enrich(t.transform(lambda x: marts.obt(x, "trip_duration_min")), d)
    assert e.count() == t.count()
    got = {r["fare_amount"]: r for r in e.collect()}
    assert [got[10.0 + i]["payment_type_desc"] for i in range(5)] == \
        ["Credit card", "Credit card", None, None, None]
    assert got[10.0]["pu_zone"] == "Midtown" and got[10.0]["do_zone"] is None
    assert got[10.0]["rate_code_desc"] == "JFK" and got[11.0]["vendor_name"] == "VeriFone (VTS)"
    assert abs(got[10.0]["avg_speed_mph"] - 4.0) < 1e-12
    assert got[50.0]["avg_speed_mph"] is None
    assert got[10.0]["trip_type"] is None and got[10.0]["day_of_week"] == "Sun"


def test_enrich_keeps_all_joins_when_zone_key_repeats(spark):
    z = [(1, "Manhattan", "Midtown", "Yellow Zone"), (1, "Manhattan", "Midtown dup", "Yellow Zone")]
    t = trips(spark, [dict(pickup_datetime=ts("2020-01-05 10:00:00"),
                           dropoff_datetime=ts("2020-01-05 10:30:00"), pu_location_id=1)])
    d = _dims(spark, z)
    assert d.zones_small and not d.zones_unique
    strict = marts.obt(t, "trip_duration_min")
    # a skipped zone join would hide the duplicate; with a repeated key it is kept
    assert marts.enrich(strict, d, roles=()).count() == 2


def test_zone_bound_disables_broadcast(spark):
    z = [(i, "B", f"Z{i}", "S") for i in range(20)]
    d = dims.build_dims(spark, zones(spark, z), max_zone_rows=10)
    assert not d.zones_small and not d.zones_unique


def test_stored_code_tables_are_checked(spark):
    from tripmart import session
    names = dims.write_code_tables(spark, "default", session.scratch_dir(spark, "t-codes"))
    codes = dims.read_code_tables(spark, names)
    d = dims.build_dims(spark, zones(spark, [(1, "B", "Z", "S")]), codes=codes)
    assert d.codes_small and d.codes_unique
    t = trips(spark, [dict(pickup_datetime=ts("2020-01-05 10:00:00"),
                           dropoff_datetime=ts("2020-01-05 10:30:00"), payment_type="2")])
    r = marts.enrich(marts.obt(t, "trip_duration_min"), d, roles=("payment",)).first()
    assert r["payment_type_desc"] == "Cash"
