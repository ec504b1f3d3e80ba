import pytest

from quarrygrid.functions.expressions import ExpressionError, compile_expression, compile_predicate


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(1.0, 4.0, None, "Ab'c", 0.0, True, "x.y")], "a double, b double, n double, s string, z double, t boolean, `d.e` string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('"a" + "b" * 2', 9.0),
        ('("a" + "b") * 2', 10.0),
        ('-"b" / 2', -2.0),
        ('"a" / "z"', None),
        ('"b" % "z"', None),
        ("7 % 4", 3),
        ('"n" == null', True),
        ('"n" != null', False),
        ('"a" != null', True),
        ('null == "s"', False),
        ('"n" < 1', None),
        ('"a" < 1 or "b" >= 4 and not "t"', False),
        ('not ("n" > 1)', True),
        ('"n" > 1 ? 1 : 2', 2),
        ('"a" == 1 ? "b" == 5 ? 1 : 2 : 3', 2),
        ('"z" != 0 and "z" != null ? "a" / "z" * 10000 : null', None),
        ('if("b" >= 105, 1, if("b" >= 4, 2, 3))', 2),
        ('abs("a" - "b")', 3.0),
        ("upper(\"s\")", "AB'C"),
        (r"'Ab\'c' == " + '"s"', True),
        ('lower(concat("s", string(12)))', "ab'c12"),
        ("""match("s", '^A.*c$')""", True),
        ('"d.e"', "x.y"),
        ("1.5e1 + .5", 15.5),
        ('coalesce("n", "a", 9)', 1.0),
        ("true && !false", True),
        ('min2("a", "b") + max2("a", "b")', 5.0),
        ('length(trim(\'  ab \'))', 2),
        ("1", 1),
    ],
)
def test_values(row, text, want):
    assert row.select(compile_expression(text, set(row.columns)).alias("v")).first().v == want


@pytest.mark.parametrize("text", ["", "1 +", '"nope"', "drop(1)", "abs(1, 2)", "if(1, 2)", "1 2", "(1", "'open", "a b", "1 ? 2", "$"])
def test_errors(row, text):
    with pytest.raises(ExpressionError):
        compile_expression(text, set(row.columns))


def test_predicate_is_never_null(row):
    assert row.where(compile_predicate('"n" > 1')).count() == 0
    assert row.where(~compile_predicate('"n" > 1')).count() == 1
