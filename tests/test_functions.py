from pyspark.sql import functions as F

from groundcover.functions import casting, lists, names, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def out(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_safe_cast_never_guesses(spark):
    df = column(spark, ["42", " 42 ", "12.5", "1e3", "NA", "", None])
    assert out(df, casting.safe_cast("v", "int")) == [42, 42, None, None, None, None, None]


def test_boolean_text(spark):
    df = column(spark, ["true", "t", "yes", "Y", "1", "false", "no", "0", "on", "", None])
    assert out(df, casting.safe_cast("v", "boolean")) == [True] * 5 + [False] * 3 + [None] * 3


def test_reported_flag_is_never_null(spark):
    df = casting.with_reported(column(spark, ["3", "NA", None]), [("v", "clean", "flag")], "int")
    assert [tuple(r) for r in df.orderBy("i").select("clean", "flag").collect()] == [
        (3, True), (None, False), (None, False)]


def test_box_three_valued(spark):
    df = spark.createDataFrame(
        [(0, 6.0, 98.0), (1, 38.0, 68.0), (2, 5.9, 70.0), (3, None, 70.0), (4, None, 10.0), (5, None, None)],
        "i int, lat double, lon double")
    assert out(df, casting.within_box("lat", "lon", (6.0, 38.0), (68.0, 98.0))) == [
        True, True, False, None, False, None]


def test_lenient_values(spark):
    df = column(spark, ["12.7", "TRUE ", "y", "", None, "x", "-3.9"])
    assert out(df, casting.as_int("v")) == [12, None, None, None, None, None, -3]
    assert out(df, casting.as_bool("v")) == [False, True, True, False, False, False, False]
    assert out(df, casting.clean_text("v")) == ["12.7", "TRUE", "y", None, None, "x", "-3.9"]
    numbers = column(spark, [2.0, 0.0, None], "double")
    assert out(numbers, casting.as_bool("v", numeric=True)) == [True, False, False]


def test_first_nonempty_skips_empty_not_blank(spark):
    df = spark.createDataFrame([(0, "", "b"), (1, " ", "b"), (2, None, None)], "i int, v string, w string")
    assert out(df, casting.first_nonempty("v", "w")) == ["b", " ", None]


def test_suppressed_values(spark):
    df = spark.createDataFrame(
        [(0, "12.3", 1.0), (1, "(12.3)", 1.0), (2, "*", 1.0), (3, "NA", 1.0), (4, "N/A", 1.0), (5, "", 1.0),
         (6, None, 1.0), (7, "(4", 1.0)], "i int, a_pct string, b_pct double")
    clean = casting.clean_suppressed(df).orderBy("i")
    assert [r["a_pct"] for r in clean.collect()] == [12.3, 12.3, None, None, None, None, None, 4.0]
    assert [r["a_pct_low_confidence"] for r in clean.collect()] == [
        False, True, False, False, False, False, None, False]
    assert "b_pct_low_confidence" not in clean.columns


def test_names(spark):
    df = column(spark, ["  New \t  Delhi ", "", None, "Ñandú "])
    assert out(df, names.norm_name("v")) == ["new delhi", "", None, "ñandú"]
    assert out(df, names.norm_name("v", empty_as_null=True))[1] is None
    assert out(df, names.name_key("v")) == ["new \t  delhi", "", None, "nandu"]
    assert out(df, names.same_name(F.col("v"), F.lit("NANDU")))[3] is True
    assert out(df, names.alias_lookup(names.norm_name("v"), {"new delhi": "delhi"})) == ["delhi", "", None, "ñandú"]


def test_lists(spark):
    df = column(spark, ['["a","a",null,""]', "[1,2]", "oops", "[]", None, "[\"x\""])
    parsed = lists.parse_list_columns(df, ["v"])
    assert out(parsed, "v") == [["a", "a", None, ""], ["1", "2"], None, [], None, None]
    assert out(parsed, lists.type_count("v")) == [4, 2, 0, 0, 0, 0]
    assert out(parsed, lists.distinct_count("v")) == [2, 2, 0, 0, 0, 0]


def test_tolerant_lists(spark):
    df = column(spark, ['["120"," b ",""]', "['x', 'y']", "http://a.org", '"alone"', "  ", None])
    assert out(df, lists.parse_list_any("v")) == [["120", "b"], ["x", "y"], ["http://a.org"], ["alone"], [], []]


def test_tuples_and_missing_items(spark):
    df = column(spark, ["('a','b')", "('a',)", "['a', None, 'b']", "(None, 'x')", "(see note)", "(one, two)", "['None']", "(1, 2)"])
    assert out(df, lists.parse_list_any("v")) == [["a", "b"], ["a"], ["a", "b"], ["x"], ["(see note)"], ["(one, two)"], ["None"], ["1", "2"]]


def test_richness_prior_modes(spark):
    df = spark.createDataFrame(
        [(0, 4, 5, True, True), (1, 1, 1, False, False), (2, 1, 1, None, True), (3, 0, 0, None, None)],
        "i int, t int, u int, s boolean, l boolean")
    cols = [F.col(c) for c in "tusl"]
    zero = [round(v, 6) for v in out(df, lists.richness_prior(*cols))]
    assert zero == [1.0, 0.45, 0.6, 0.0]
    saturate = [round(v, 6) for v in out(df, lists.richness_prior(*cols, null_presence="saturate"))]
    assert saturate == [1.0, 0.45, 1.0, 1.0]


def test_codes_and_domains(spark):
    df = column(spark, ["PIN 560001, IND", "tel 0123456789", "12345", None])
    assert out(df, text.extract_code("v")) == [560001, 12345, None, None]
    urls = column(spark, ["http://www.A.org/x", "https://user:pw@sub.b.com:81?q", "//c.net.", "nothing", None])
    assert out(urls, text.domain(F.col("v"))) == ["a.org", "sub.b.com", "c.net", "", None]


def test_highlight(spark):
    df = column(spark, ["Has an ICU ward", "nothing here"])
    cut = out(df, text.highlight_span(F.col("v"), F.array(F.lit("nicu"), F.lit("icu"))))
    assert tuple(cut[0]) == ("Has an ", "ICU", " ward")
    assert tuple(cut[1]) == ("nothing here", None, None)
