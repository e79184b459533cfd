from pyspark.sql import functions as F

from ratelake.operators.provenance import discovery_match, provenance_gaps, series_coverage
from ratelake.operators.timeline import COLUMNS, canonical


def test_record_by_hash_wins_and_blanks_match_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "none", "x"), (4, "", "null"), (5, None, None), (6, "q", "q")], "document bigint, path string, hash string")
    records = spark.createDataFrame([(10, "a", "z", "D1", "f"), (11, "a", "", "D2", "f"), (12, "", "x", "D3", None), (9, None, "x", "D0", "f")], "record bigint, path string, hash string, docket string, filed string")
    got = {r["document"]: (r["linkage"], r["record"], r["record_docket"], r["record_filed"]) for r in discovery_match(docs, records).collect()}
    nothing = ("missing", None, None, None)
    assert got == {1: ("path+hash", 12, "D3", None), 2: ("path_only", 11, "D2", "f"), 3: ("hash_only", 12, "D3", None), 4: nothing, 5: nothing, 6: nothing}
    assert discovery_match(docs.where("false"), records).count() == 0
    assert {r["linkage"] for r in discovery_match(docs, records.where("false")).collect()} == {"missing"}


def test_gaps_name_what_can_fill_them(spark):
    columns = "document bigint, docket_number string, order_date string, leaf_no string, source_pdf string, docket_dir string, document_leaf string, path string, record_docket string, record_filed string"
    rows = [
        (1, None, "None", "", " ", "null", "503", "x/E-7-SUB-12/y.pdf", "E-7", None),
        (2, "E-1", "2020-01-01", "5", "a", "b", None, None, None, None),
        (3, "E-1", None, "5", "a", None, None, "y.pdf", "E-7", "2020-02-02"),
    ]
    got = {r["document"]: (r["missing"], r["fillable"]) for r in provenance_gaps(spark.createDataFrame(rows, columns)).collect()}
    assert got == {
        1: (["docket_number", "order_date", "leaf_no", "source_pdf", "docket_dir"], ["docket_number", "leaf_no", "source_pdf", "docket_dir"]),
        3: (["order_date", "docket_dir"], ["order_date"]),
    }


def test_series_known_when_a_version_began(spark):
    day = lambda n: F.to_date(F.col(n)).alias(n)
    versions = spark.createDataFrame([(1, "k", "2020-01-01"), (2, "k", "2020-03-01"), (3, "k", "2020-04-15"), (4, "k", None), (5, "other", "2021-01-01")], "version int, k string, start string").select("version", "k", day("start"))
    parts = [("k", "2020-03-01", "B", "sheet"), ("k", "2020-03-01", "A", "sum"), ("k", "2020-03-01", "A", "sheet"), ("k", "2020-04-01", "C", "sum")]
    components = spark.createDataFrame(parts, "k string, effective string, code string, kind string").select("k", day("effective"), "code", "kind")
    got = {r["version"]: (str(r["effective"]), r["coverage"], r["n_codes"], r["missing_codes"], r["kinds"]) for r in series_coverage(versions, components, ["k"], ["C", "A"]).collect()}
    none = ("None", "no_prior_series", 0, ["C", "A"], [])
    assert got == {1: none, 2: ("2020-03-01", "same_day", 2, ["C"], ["sheet", "sum"]), 3: ("2020-04-01", "carried_forward", 1, ["A"], ["sum"]), 4: none, 5: none}


def test_common_form_has_all_columns(spark):
    bare = spark.createDataFrame([("2020-01-01", 9.5)], "effective_date string, blended_base_cents_per_kwh double")
    full = bare.withColumns({"summer_base_bill": F.lit(None).cast("double"), "winter_base_bill": F.lit(95.0), "bill_coverage_status": F.lit("base_only"), "representative_kwh": F.lit(500.0)})
    both = canonical(bare, "A", "RES").unionByName(canonical(full, "B", "RS"))
    assert both.columns == list(COLUMNS) and len(COLUMNS) == 21
    one, two = (r.asDict() for r in both.orderBy("utility").collect())
    assert (one["representative_kwh"], one["base_bill_amount"], one["timeline_kind"]) == (1000.0, None, "unknown")
    assert (two["representative_kwh"], two["base_bill_amount"], two["timeline_kind"]) == (500.0, 95.0, "base_only")
    assert canonical(bare.where("false"), "A", "RES").count() == 0
