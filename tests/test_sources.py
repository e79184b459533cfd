from ratelake.sources import regional, usage

GREEN = """<feed xmlns="http://naesb.org/espi"><ReadingType><powerOfTenMultiplier>-3</powerOfTenMultiplier><uom>73</uom><intervalLength>900</intervalLength></ReadingType>
<IntervalBlock><IntervalReading><timePeriod><duration>900</duration><start>1700000000</start></timePeriod><value>110</value></IntervalReading>
<IntervalReading><timePeriod><duration>900</duration><start>1700000900</start></timePeriod><value>100</value></IntervalReading></IntervalBlock></feed>"""


def test_green_button(spark, tmp_path):
    (tmp_path / "a.xml").write_text(GREEN)
    rows = usage.read_green_button(spark, str(tmp_path / "a.xml")).orderBy("timestamp").collect()
    assert round(sum(r["kwh"] for r in rows), 6) == 0.21
    assert round(rows[0]["kw"], 6) == 0.44


def test_simple_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<r><interval timestamp="2024-01-01T00:00:00" kwh="1.5" kw="6"/><interval><timestamp>1700000000</timestamp><value>2</value></interval><interval kwh="9"/></r>')
    rows = usage.read_simple_xml(spark, str(tmp_path / "a.xml")).orderBy("kwh").collect()
    assert [(r["kwh"], r["kw"]) for r in rows] == [(1.5, 6.0), (2.0, None)]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"timestamp": "2024-01-01T00:00:00", "kwh": 1.0}, {"timestamp": "2024-01-01T00:15:00", "kwh": 2.0, "kw": 8.0}]')
    (tmp_path / "m.json").write_text('{"monthly_kwh": 900, "peak_kw": 5}')
    (tmp_path / "i.csv").write_text("kwh,timestamp\n1,2024-01-01T00:00:00\nx,2024-01-01T00:15:00\n")
    (tmp_path / "m.csv").write_text("monthly_kwh\n700\n")
    assert usage.read_interval_json(spark, str(tmp_path / "i.json")).count() == 2
    assert usage.read_monthly_json(spark, str(tmp_path / "m.json")).first()["peak_kw"] == 5.0
    assert usage.read_interval_csv(spark, str(tmp_path / "i.csv")).count() == 1
    assert usage.read_monthly_csv(spark, str(tmp_path / "m.csv")).first()["monthly_kwh"] == 700.0


def test_sector_prices(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Year,State,Residential,All Sectors\n2024,nc,"1,012.5",--\nTotal,NC,1,2\n2024,United States,1,2\n')
    rows = {(r["state"], r["sector"]): r["avg_cents_per_kwh"] for r in regional.read_sector_prices(spark, str(tmp_path / "p.csv")).collect()}
    assert rows == {("NC", "residential"): 1012.5, ("NC", "all_sectors"): None}


def test_reports_in_three_forms(spark, tmp_path):
    from ratelake.sources.reports import write_report

    df = spark.createDataFrame([(1, "a|b", [1, 2]), (2, None, None)], "n int, s string, x array<int>")
    paths = write_report(df, str(tmp_path), "audit")
    assert sorted(r["n"] for r in spark.read.json(paths["json"]).collect()) == [1, 2]
    assert spark.read.option("header", True).csv(paths["csv"]).columns == ["n", "s", "x"]
    lines = [r["value"] for kind in ("head", "rows") for r in spark.read.text(f"{paths['md']}/{kind}").collect()]
    assert lines[:2] == ["| n | s | x |", "| --- | --- | --- |"] and sorted(lines[2:]) == ["| 1 | a\\|b | [1,2] |", "| 2 |  |  |"]


def test_usage_by_suffix(spark, tmp_path):
    import pytest

    (tmp_path / "a.xml").write_text(GREEN)
    (tmp_path / "b.xml").write_text('<r><interval timestamp="2024-01-01T00:00:00" kwh="1.5" kw="6"/></r>')
    (tmp_path / "i.json").write_text('[{"timestamp": "2024-01-01T00:00:00", "kwh": 1.0}]')
    (tmp_path / "m.json").write_text('{"monthly_kwh": 900, "peak_kw": 5}')
    (tmp_path / "i.csv").write_text("kwh,timestamp\n1,2024-01-01T00:00:00\n")
    (tmp_path / "m.csv").write_text("monthly_kwh\n700\n")
    read = lambda name: [(r["kwh"], r["kw"], r["monthly_kwh"], r["peak_kw"]) for r in usage.read_usage(spark, str(tmp_path / name)).collect()]
    assert [round(k, 6) for k, *_ in read("a.xml")] == [0.11, 0.1] and read("b.xml") == [(1.5, 6.0, None, None)]
    assert read("i.json") == [(1.0, None, None, None)] and read("m.json") == [(None, None, 900.0, 5.0)]
    assert read("i.csv") == [(1.0, None, None, None)] and read("m.csv") == [(None, None, 700.0, None)]
    with pytest.raises(ValueError):
        usage.read_usage(spark, str(tmp_path / "x.pdf"))


def test_records_by_hand(spark):
    from ratelake.sources import records

    raw = [("2024-06", "nc", "N/A", " 12.5 ", "1,000", "7.9"), ("2024-Q2", None, "x", "--", "3", ""), ("2024-13x", "", None, None, None, None), (None, "sc", "9", "1e2", "0", "4")]
    df = spark.createDataFrame(raw, "period string, stateid string, sales string, price string, revenue string, customers string")
    got = [tuple(r[c] for c in ("period", "year", "month", "state", "sector", "sales_million_kwh", "price_cents_per_kwh", "revenue_million_dollars", "customers", "batch_id")) for r in records.normalise(df, "retail-sales", "monthly", "b").collect()]
    assert got == [
        ("2024-06", 2024, 6, "NC", "", None, 12.5, None, 7, "b"), ("2024-Q2", 2024, None, "", "", None, None, 3.0, None, "b"), ("2024-13x", None, None, "", "", None, None, None, None, "b"), ("", None, None, "SC", "", 9.0, 100.0, 0.0, 4, "b"),
    ]
    fuel = spark.createDataFrame([("2020", "nc", None, "Coal", "2.5")], "period string, location string, fuelTypeDescription string, `type-name` string, generation string")
    r = records.normalise(fuel, "generation-by-fuel").first()
    assert (r["fuel_type_name"], r["generation_mwh"], r["month"], r["batch_id"]) == ("Coal", 2500.0, None, None)
    for kind in records.KINDS:
        assert records.normalise(fuel.limit(0), kind).count() == 0
