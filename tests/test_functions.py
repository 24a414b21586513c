import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as N
from linkloom.functions import tokens as T


def values(spark, rows, made):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(made(F.col("x"))).collect()]


def test_names_with_long_and_short_suffix_are_equal(spark):
    a, b, c, d = values(spark, ["Acme Corporation", "Acme Corp", "Infosys Technologies Private Limited", "Pvt. Ltd."], N.normalize_name)
    assert a == b == "acme corp"
    assert (c, d) == ("infosys technologies pvt ltd", "pvt ltd")


def test_null_and_empty_names_are_empty(spark):
    for f in (N.basic_clean, N.normalize_name, N.normalize_address, N.normalize_country):
        assert values(spark, ["", None, "  "], f) == ["", "", ""]


def test_letters_are_folded_and_other_scripts_stay(spark):
    assert values(spark, ["Émile & Søn — Straße", "東京 ＡＢＣ", "Œuvre x_y"], N.basic_clean) == ["emile son strasse", "東京 abc", "oeuvre x_y"]
    assert values(spark, ["Cafe\u0301", "Łódź Đặng İş ıþ", "ﬁn ㎏ Ⅷ ½"], N.basic_clean) == ["cafe", "lodz dang is ith", "fin kg viii 1 2"]


def test_domains_are_cut_and_slash_names_keep_their_behaviour(spark):
    upper = ["HTTPS://WWW.ACME.COM/x", "WWW.Acme.com", "Www2.Acme.Co.Uk:80", "www.", "http://", "a.b c", "x.gouv.fr", "acme.com:80:90", "http:80/x", ".com"]
    assert values(spark, upper, N.clean_domain_name) == ["acme", "acme", "acme", "www", "http", "a b c", "x", "acme com 80 90", "http", ""]
    got = values(spark, ["https://www.acme-widgets.co.uk/about", "acme.com:8080", "M/S Foo Traders", "13/85 Ameren Inc", "St. Lutheran Church LLC"], N.clean_domain_name)
    assert got == ["acme widgets", "acme", "m", "13", "st lutheran church llc"]


def test_countries(spark):
    assert values(spark, ["USA", " United States ", "U.S.A.", "Bharat", "Narnia", "uk"], N.normalize_country) == ["us", "us", "us", "in", "narnia", "gb"]


def test_tokens(spark):
    assert values(spark, ["12-A, 45 560001 A12"], T.numeric_tokens) == [["12", "45", "560001"]]
    assert values(spark, ["75008 Paris CEDEX 08, BP 12", None], T.postal_tokens) == [["75008", "cedex 08", "bp 12"], []]
    assert values(spark, ["cedex 08a bp", "12345-6789 1234567 é12 x_12345"], T.postal_tokens) == [["cedex", "bp"], ["12345"]]
    assert values(spark, ["+1-800-555-1234", "12"], T.phone_tokens) == [["8005551234"], []]
    assert values(spark, ["blue red x", "one", ""], T.name_bigrams) == [["blue red"], [], []]
    assert values(spark, ["ab cd", "a", ""], lambda x: T.char_ngrams(x, 3)) == [["abc", "bcd"], ["a"], []]
    assert values(spark, ["ab cd", "a"], T.blocking_tokens) == [["ab", "cd", "abc", "bcd"], []]
    assert values(spark, ["acme corp ltd", "acme"], T.legal_suffix) == ["ltd", None]
    assert values(spark, ["Plot 45, Sector 18", "x"], T.street_number) == ["45", None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ratios_against_plain_loops():
    for a, b in zip(strings(300, 1), strings(300, 2), strict=True):
        assert S.lcs_length(a, b) == lcs(a, b)
        short, long = sorted((a, b), key=len)
        n = len(short)
        windows = [long[max(0, s) : s + n] for s in range(1 - n, len(long))]
        both = windows + ([short[max(0, s) : s + n] for s in range(1 - n, n)] if len(a) == len(b) else [])
        if a and b:
            best = max([S.ratio(short, w) for w in windows] + ([S.ratio(long, w) for w in both[len(windows) :]]))
            assert S.partial_ratio(a, b) == pytest.approx(best)
        for f in (S.ratio, S.partial_ratio, S.token_sort_ratio, S.token_set_ratio, S.jaro_winkler):
            assert 0 <= f(a, b) <= 1
            assert f(a, b) == pytest.approx(f(b, a)) or f is S.jaro_winkler


def test_native_ratio_is_the_same(spark):
    rows = list(zip(strings(100, 3), strings(100, 4), strict=True))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("n", S.indel_ratio(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r["n"] == pytest.approx(S.ratio(r["a"], r["b"]))


def test_empty_strings():
    assert S.ratio("", "") == 1.0 and S.token_set_ratio("", "") == 0.0 and S.jaro_winkler("", "a") == 0.0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_set_similarities(spark):
    df = spark.sql("select array('a','b') x, array('b','c') y, array() z")
    r = df.select(S.jaccard(F.col("x"), F.col("y")), S.overlap(F.col("x"), F.col("y")), S.jaccard(F.col("z"), F.col("z")), S.jaccard(F.col("x"), F.col("x"))).first()
    assert tuple(r) == pytest.approx((1 / 3, 0.5, 0.0, 1.0))


def test_logit_is_clamped(spark):
    r = spark.sql("select 0D a, 1D b, 0.5D c").select(*[S.clamped_logit(F.col(x)) for x in "abc"]).first()
    assert tuple(r) == (-10.0, 10.0, 0.0)


def test_native_indel_ratio_splits_each_string_once(spark):
    plan = spark.createDataFrame([("a", "b")], "a string, b string").select(S.indel_ratio(F.col("a"), F.col("b")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 2
