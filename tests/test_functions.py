import pytest
from pyspark.sql import functions as F

from landloom.functions import text, values
from landloom.operators.places import similarity


def ask(spark, f, *inputs, kind="string"):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strings(spark):
    assert ask(spark, text.clean_string, "  a \r\n b ", " ​", "", None, "x\ty") == ["a b", None, None, None, "x y"]
    assert ask(spark, text.header_key, "Used Land ", "NA/ Coversion Done\r\n(Acers) ", "Sr No ", "Utilization percentage(%)", "/a:", "::", "#1.") == ["used land", "na/ coversion done (acers)", "sr no", "utilization percentage(%)", "/a", None, "1"]
    assert ask(spark, text.clean_cell, "-", "N/A", " tbd ", "0", "#REF!", "Goa") == [None, None, None, "0", None, "Goa"]
    assert ask(spark, text.place_key, "S.P.S. Nellore", "Jammu & Kashmir", "A-B_c/ (d)", None, "  ") == ["sps nellore", "jammu and kashmir", "abc d", None, ""]
    assert ask(spark, text.is_place_name, "Goa", "n.a.", "-", None, "Unknown") == [True, False, False, False, False]
    assert ask(spark, text.filename_stem, "a/b/Plot 42.KMZ", "x.kml", "y.zip") == ["Plot 42", "x", "y.zip"]
    assert ask(spark, text.safe_filename, 'a<b>:"c', "...", "CON", "x" * 200, "name. . ") == ["a b c", "boundary", "CON_", "x" * 120, "name"]
    assert ask(spark, text.file_ext, "a.KML", "a.kmz", "a") == [".kml", ".kmz", ".kmz"]
    df = spark.createDataFrame([("assandh, karnal - village mardan heri", "mardan heri"), ("plot 421", "plot 42"), ("a.c", "a.c"), ("abc", "a.c"), ("abc", "")], "h string, n string")
    assert [r[0] for r in df.select(text.contains_phrase("h", "n")).collect()] == [True, False, True, False, False]
    df = spark.createDataFrame([("Goa ", None, "Plot 1"), ("Goa", "North", None)], "s string, d string, p string")
    assert [r[0] for r in df.select(text.site_key("s", "d", "p")).collect()] == ["goa||plot 1", None]


def test_numbers(spark):
    given = ["₹ 1,23,456.50", "(123)", "85%", "12 acres", "Rs. 5", "5d", "tbd", "1e400", "1,2,", "-7", ".5", "( 4 ha )", "acres", "12 sq. ft.", "+3e2", "1 2", None, "(Rs 9)"]
    want = [123456.5, -123, 85, 12, 5, None, None, None, None, -7, 0.5, -4, None, 12, 300, None, None, -9]
    assert ask(spark, values.parse_measure, *given) == want
    assert ask(spark, values.cell_type, "1", "true", "2024-01-02", "x", "", "12-1") == ["number", "boolean", "date", "string", None, "string"]
    assert ask(spark, values.distinct_key, "1", "1.0", "x", "TRUE") == ["n:1.0", "n:1.0", "s:x", "b:true"]
    df = spark.createDataFrame([(1.0, 1.004), (1.0, 1.006), (1e9, 1e9 + 0.5), (None, 1.0), (float("nan"), 1.0), (float("inf"), float("inf"))], "a double, b double")
    assert [r[0] for r in df.select(values.area_equals("a", "b")).collect()] == [True, False, True, False, False, False]
    assert spark.range(1).select(values.from_acres(F.lit(1.0), "square_foot"), values.to_acres(values.from_acres(F.lit(3.0), "hectare"), "hectare")).first()[:] == (43560.0, pytest.approx(3.0))
    with pytest.raises(ValueError):
        values.from_acres("a", "bigha")
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, 2.5, -1.0, None, float("nan"))], "v double")
    assert [r[0] for r in df.select(values.bin_index("v", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)))).collect()] == [0, 0, 1, 1, -1, -1, -1, -1]


def test_similarity(spark):
    pairs = [("raigarh", "raigad", 0.714), ("mutksar", "muktsar", 0.714), ("punjabb", "punjab", 0.857), ("ludhiyana", "ludhiana", 0.889), ("", "", 1.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [round(r[0], 3) for r in df.select(similarity(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_cleaning_reads_a_text_once(spark):
    df = spark.createDataFrame([("a",)], "x string")
    for f, most in ((text.clean_cell, 4), (text.clean_string, 4), (values.parse_measure, 20)):
        assert df.select(f("x").alias("y")).where("y is null").select("y")._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= most


def test_figures_beside_odd_spaces(spark):
    odd = ["0 Rs", "4.5 acres", "1e999", "-0", "+.5e1", "5.", "(7)", "İ1", "1  ha", "e", "1\x01", "x1", "(1,234.5) %"]
    assert [None if y is None else str(y) for y in ask(spark, values.parse_measure, *odd)] == ["0.0", "4.5", None, "-0.0", "5.0", "5.0", "-7.0", None, "1.0", None, None, None, None]
    assert ask(spark, text.clean_cell, "Nil", "nile", "a  b", "a b", " a", "a ", "-", "\x7f", "é", "n/A") == [None, "nile", "a b", "a b", "a", "a", None, "\x7f", "é", None]
