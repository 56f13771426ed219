"""Published versions, updates of some partitions, imports with a quarantine, and map tiles."""

from __future__ import annotations

import math
import os
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.functions import tile_key
from cartsight.operators import geo
from cartsight.sources import (
    add_column,
    import_csv,
    new_table_name,
    publish,
    retire,
    store_partitioned,
    update,
    versions,
)

# --- published versions ------------------------------------------------------------------------


def numbers(spark, n, value):
    return spark.range(n).select("id", F.lit(value).alias("v"))


def test_readers_never_miss_the_table(spark):
    """Readers in other threads during 20 rebuilds: every read succeeds and sees one version whole."""
    name = new_table_name("busy")
    publish(numbers(spark, 50, 0), name, keep=4)
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(spark.table(name).agg(F.count("v"), F.min("v"), F.max("v")).first())
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    readers = [threading.Thread(target=read) for _ in range(2)]
    for r in readers:
        r.start()
    for i in range(1, 21):
        publish(numbers(spark, 50 + i, i), name, keep=4)
    stop.set()
    for r in readers:
        r.join()
    assert failed == [] and seen
    assert all(n == 50 + low and low == high for n, low, high in seen)
    assert len(versions(spark, name)) == 4
    retire(spark, name)
    assert len(versions(spark, name)) == 1 and spark.table(name).count() == 70


def test_a_version_may_read_the_one_before(spark):
    name = new_table_name("growing")
    publish(numbers(spark, 3, 1), name)
    for _ in range(3):
        publish(spark.table(name).unionAll(spark.table(name)), name)
    assert spark.table(name).count() == 24


def test_a_failed_build_changes_nothing(spark):
    name = new_table_name("steady")
    publish(numbers(spark, 3, 1), name)
    before = versions(spark, name)
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        publish(broken, name)
    assert versions(spark, name) == before and spark.table(name).count() == 3


# --- partitions --------------------------------------------------------------------------------


def files_of(spark, name):
    """Name, size and time of the files, by partition folder."""
    found = {}
    for uri in spark.table(name).inputFiles():
        path = uri.removeprefix("file://")
        found.setdefault(os.path.basename(os.path.dirname(path)), set()).add((path, os.stat(path).st_size, os.stat(path).st_mtime_ns))
    return found


def test_only_partitions_with_changed_rows_are_written(spark):
    name = new_table_name("parts")
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.lit("a").alias("v"))
    store_partitioned(df, name, ["g"])
    before = files_of(spark, name)
    add_column(spark, name, "late", "int", "7")
    assert files_of(spark, name) == before
    changed = update(spark, name, ["g"], F.col("id").isin(1, 6, 10), {"v": F.lit("b"), "late": F.col("id").cast("int")})
    rows = {r.id: (r.v, r.late, r.g) for r in changed.collect()}
    assert rows == {i: ("b" if i in (1, 6, 10) else "a", i if i in (1, 6, 10) else 7, i % 5 or None) for i in range(100)}
    after = files_of(spark, name)
    assert {g for g in after if after[g] != before[g]} == {"g=1", "g=__HIVE_DEFAULT_PARTITION__"}
    update(spark, name, ["g"], F.col("id") > 1000, {"v": F.lit("c")})
    assert files_of(spark, name) == after
    with pytest.raises(ValueError, match="place the rows"):
        update(spark, name, ["g"], F.col("id") == 1, {"g": F.lit(2)})


def test_an_update_that_fails_changes_nothing(spark):
    name = new_table_name("parts")
    store_partitioned(spark.range(20).select("id", (F.col("id") % 2).alias("g"), F.lit(1).alias("v")), name, ["g"])
    before = files_of(spark, name)
    with pytest.raises(Exception, match="broken"):
        update(spark, name, ["g"], F.col("id") == 3, {"v": F.raise_error(F.lit("broken")).cast("int")})
    assert files_of(spark, name) == before
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


# --- imports -----------------------------------------------------------------------------------

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.LongType()), ("name", T.StringType()), ("price", T.DoubleType()), ("day", T.DateType()))]
)


def test_every_line_is_good_or_in_quarantine_once(spark, tmp_path):
    lines = {
        "1,plain,2.5,2020-01-31": None,
        '2,"with, comma",1e3,2020-01-31': None,
        "3,,,": None,
        "x4,no id,2.5,2020-01-31": "value not of its type",
        "5,no price,2;5,2020-01-31": "value not of its type",
        "6,no day,2.5,31.01.2020": "value not of its type",
        "7,short": "wrong number of fields",
        "8,long,2.5,2020-01-31,more": "wrong number of fields",
        "x9,both,1": "wrong number of fields",
        ",missing,2.5,2020-01-31": "missing id",
    }
    folder = tmp_path / "in"
    folder.mkdir()
    all_lines = list(lines) * 3
    random.Random(1).shuffle(all_lines)
    for i in range(3):
        (folder / f"{i}.csv").write_text("\n".join(["id,name,price,day", *all_lines[i * 10 : i * 10 + 10]]) + "\n")
    done = import_csv(spark, str(folder), SCHEMA, required=["id"])
    assert done.rows.schema == SCHEMA
    assert sorted(r.id for r in done.rows.collect()) == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert {r.price for r in done.rows.where("id = 2").collect()} == {1000.0}
    bad = [(r.line, r.reason) for r in done.quarantine.collect()]
    assert sorted(bad) == sorted((k, v) for k, v in lines.items() if v for _ in range(3))
    assert {os.path.basename(r.file) for r in done.quarantine.collect()} <= {"0.csv", "1.csv", "2.csv"}
    counts = {r.reason: r.lines for r in done.counts().collect()}
    assert sum(counts.values()) == 30 and counts["good"] == 9


def test_columns_in_any_order_and_more(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("extra,day,price,name,id\nq,2020-01-31,2.5,n,1\nq,2020-01-31,x,n,2\n")
    done = import_csv(spark, str(path), SCHEMA)
    assert done.rows.columns == SCHEMA.names and done.rows.count() == 1 and done.quarantine.count() == 1
    path.write_text("extra,day,price,name\n")
    with pytest.raises(ValueError, match="no column id"):
        import_csv(spark, str(path), SCHEMA)
    path.write_text("id,name,price,day\n")
    assert {r.reason: r.lines for r in import_csv(spark, str(path), SCHEMA).counts().collect()} == {"good": 0}


# --- map tiles ---------------------------------------------------------------------------------


def plain_tile(lat, lng, zoom):
    if lat is None or lng is None or not (abs(lat) <= 90 and abs(lng) <= 180):
        return None
    north = min(math.floor((lat + 90) / 180 * 2**zoom), 2**zoom - 1)
    east = min(math.floor((lng + 180) / 360 * 2**zoom), 2**zoom - 1)
    return sum(((north >> i & 1) * 2 + (east >> i & 1)) << 2 * i for i in range(zoom))


@pytest.mark.parametrize("zoom", [0, 1, 7, 16, 30])
def test_tile_keys(spark, zoom):
    rng = random.Random(zoom)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(500)]
    rows += [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (90.1, 0.0), (0.0, 181.0), (None, 1.0), (math.nan, 0.0)]
    df = spark.createDataFrame(rows, "lat double, lng double")
    for r in df.select("lat", "lng", tile_key("lat", "lng", zoom).alias("tile")).collect():
        assert r.tile == plain_tile(r.lat, r.lng, zoom)
    with pytest.raises(ValueError, match="zoom"):
        tile_key("lat", "lng", 31)


def test_every_level_holds_all_items(spark):
    rng = random.Random(3)
    rows = [
        (str(i), rng.uniform(-34, 5), rng.uniform(-73, -35), rng.choice(["Delayed", "Early (5+ days early)"]), rng.randint(1, 9))
        for i in range(300)
    ] + [("x", None, 1.0, "Delayed", 5)]
    names = "customer_zip_code_prefix string, customer_lat double, customer_lng double, DelayCategory string, NumberOfOrders long"
    found = geo.map_tiles(spark.createDataFrame(rows, names), zoom=9).collect()
    expected = {}
    for _, lat, lng, kind, n in rows:
        for zoom in range(10):
            if lat is not None:
                total = expected.setdefault((zoom, plain_tile(lat, lng, zoom)), [0, 0])
                total[0] += n
                total[1] += n * (kind == "Delayed")
    assert {(r.zoom, r.tile): [r.NumberOfOrders, r.Delayed] for r in found} == expected
    totals = {z: sum(r.NumberOfOrders for r in found if r.zoom == z) for z in range(10)}
    assert len(set(totals.values())) == 1
