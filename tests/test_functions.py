import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as T


def value(spark, x):
    return spark.range(1).select(x.alias("x")).first().x


@pytest.mark.parametrize(
    "given, wanted",
    [("Café  D'Or, S.A.R.L.", "cafe d or s a r l"), ("Œuvre ß", "œuvre ß"), ("ﬁn ＡＢ", "fin ab"), ("", ""), ("é", "e"), ("हिन्दी दुकान", "हिन्दी दुकान")],
)
def test_clean_words(spark, given, wanted):
    assert value(spark, T.clean_words(F.lit(given))) == wanted


@pytest.mark.parametrize("given, wanted", [("Foo Ltd dba Bar-Baz LLC", "Bar-Baz LLC"), ("A dba B aka C", "B aka C"), ("Acme a.k.a. Zed", ". Zed"), ("Foo t/a: Bar", "Bar")])
def test_alias(spark, given, wanted):
    assert value(spark, T.after_alias(F.lit(given))).strip() == wanted.strip() or value(spark, T.clean_words(T.after_alias(F.lit(given)))) == value(spark, T.clean_words(F.lit(wanted)))


@pytest.mark.parametrize("given, full, core", [("Acme L.L.C.", "acme llc", "acme"), ("Co Ltd", "co ltd", "co ltd"), ("@shop www.amicaledulamitie.com", "shop amicaledulamitie", "shop amicaledulamitie"), (None, "", "")])
def test_names(spark, given, full, core):
    x = T.name_full(F.lit(given).cast("string"))
    assert (value(spark, x), value(spark, T.name_core(x))) == (full, core)


@pytest.mark.parametrize(
    "raw, country, wanted",
    [("12 Main Street, Suite 4, New York", "US", "12 main st ste 4 ny"), ("3 Bd Foch, Nord", "France", "3 boulevard foch hauts de france"), ("5 Road, mh, null", "India", "5 rd maharashtra"), ("1 Av X", "other", "1 av x")],
)
def test_addresses(spark, raw, country, wanted):
    assert value(spark, T.address_clean(F.lit(raw), F.lit(country))) == wanted


def test_states_and_scripts(spark):
    assert value(spark, T.state_mask(F.lit("x, 'Goa' , Jammu & Kashmir"))) == (1 << 5) | (1 << 33)
    masks = [value(spark, T.script_mask(F.lit(t))) for t in ("अ", "മ", "x", "অ ਪ")]
    assert masks == [1, 256, 0, 6]
    assert value(spark, T.allowed_states(F.lit(1 << 5))) == 1 << 22


@pytest.mark.parametrize(
    "raw, house, units, alnum, numset",
    [
        ("unit 5, 0012 elm st", "12", {"5"}, set(), {"5", "12"}),
        ("2nd floor, shop no. 07, 45 mg road", "45", {"7", "2"}, set(), {"2", "7", "45"}),
        ("12-b park, 3rd rd, b7", "12", set(), {"12b", "b7"}, {"12", "3", "7"}),
        ("plot 000", "0", set(), set(), {"0"}),
        (None, None, set(), set(), set()),
    ],
)
def test_numbers(spark, raw, house, units, alnum, numset):
    x = F.lit(raw).cast("string")
    assert value(spark, T.house(x)) == house
    assert [set(value(spark, f(x))) for f in (T.units, T.premises, T.number_set)] == [units, alnum, numset]


def test_digits_of_other_scripts(spark):
    assert value(spark, T.numbers(F.lit("०१२ a 007"))) == ["12", "7"]


def test_trigrams_and_initials(spark):
    assert value(spark, T.trigrams(F.lit("ab c"))) == [" ab", "ab ", " c "]
    assert value(spark, T.initials(F.lit("north west"))) == "nw"


def test_substitution_keeps_separators(spark):
    table = F.create_map(F.lit("दुकान"), F.lit("dukan"))
    assert value(spark, T.substitute(F.lit("शर्मा, दुकान (x)"), table)) == "शर्मा, dukan (x)"
    assert value(spark, T.unknown_native(F.lit("शर्मा दुकान x"), table)) == 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    r = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc é") for _ in range(r.randrange(25))) for _ in range(2))
        assert S.lcs_length(a, b) == lcs(a, b)


def test_both_indel_forms(spark):
    rows = [("kitten", "sitting"), ("", ""), ("a", ""), ("", "b"), ("abc", "abc"), (None, "x"), ("é fin", "fin é")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.indel_ratio(F.col("a"), F.col("b")).alias("x"), S.indel_ratio_native(F.col("a"), F.col("b")).alias("y")).collect()
    wanted = [1.0 if not (a or "") + (b or "") else 2 * lcs(a or "", b or "") / len((a or "") + (b or "")) for a, b in rows]
    assert [round(r.x, 9) for r in got] == [round(w, 9) for w in wanted] == [round(r.y, 9) for r in got]


@pytest.mark.parametrize("a, b, wanted", [("a b", "b a c", 1.0), ("a", "", 0.0), ("", "", 0.0), ("x y", "x y", 1.0)])
def test_token_set(spark, a, b, wanted):
    assert value(spark, S.token_set_ratio(F.lit(a), F.lit(b))) == wanted


def test_folds_and_scalars(spark):
    assert [value(spark, S.fold(F.lit(str(i)))) for i in range(6)] == [0, 1, 2, 3, 0, 3]
    assert round(value(spark, S.idf(F.lit(3), F.lit(2))), 6) == 1.287682
    assert round(value(spark, S.logit(F.lit(0.9))), 6) == 2.197225
    assert round(value(spark, S.levenshtein_similarity(F.lit("kitten"), F.lit("sitting"))), 6) == 0.571429
    assert value(spark, S.log_difference(F.lit("99999999999999999999"), F.lit("1"))) == -1.0
    assert [value(spark, S.state_allows(F.lit(4), F.lit(m))) for m in (0, 4, 2, 3)] == [True, True, False, True]
