import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "fire_count" in df.columns


def test_catalogue_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_schema_is_stable(spark):
    cols = [(f.name, f.dataType.simpleString()) for f in E.entry(spark).schema.fields]
    assert cols == [("grid_cell", "string"), ("acq_date", "date"), ("latitude", "double"),
                    ("longitude", "double"), ("latitude_original", "double"),
                    ("longitude_original", "double"), ("day_of_year", "int"), ("fire_count", "bigint"),
                    ("oblast_id", "string"), ("pop_density", "double"), ("c0", "double"),
                    ("c1", "double"), ("c2", "double"), ("c3", "double"), ("c4", "double"),
                    ("t_mean", "double"), ("cloud_cover", "double")]
