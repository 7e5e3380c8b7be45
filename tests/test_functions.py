import pytest
from pyspark.sql import functions as F

from codeloom.functions import naming, paths, risk, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("path", "language", "role"),
    [("a/tests/x.py", "python", "test"), ("a/src/x_test.go", "go", "test"), ("a/vendor/tests/x.go", "go", "vendor"), ("dist/x.js", "javascript", "generated"), ("My.Tests/x.cs", "csharp", "test"), ("docs/x.py", "python", "docs"), ("a/x.json", "json", "docs"), ("a/x.py", "python", "source"), ("a/contest/x.py", "python", "source")],
)
def test_roles(spark, path, language, role):
    assert one(spark, paths.role(F.col("p"), F.col("l")), p=path, l=language) == role


@pytest.mark.parametrize(("name", "snake", "camel", "pascal"), [("XMLParser", "xml_parser", "xMLParser", "XMLParser"), ("getUserData", "get_user_data", "getUserData", "GetUserData"), ("parse_my-thing", "parse_my_thing", "parseMyThing", "ParseMyThing"), ("x", "x", "x", "X"), ("", "", "", "")])
def test_naming(spark, name, snake, camel, pascal):
    c = F.col("n")
    got = spark.createDataFrame([(name,)], "n string").select(naming.snake_case(c), naming.camel_case(c), naming.pascal_case(c)).first()
    assert tuple(got) == (snake, camel, pascal)


def test_variants_start_with_the_name(spark):
    assert one(spark, naming.variants(F.col("n")), n="getUser")[0] == "getUser"


def test_qualified_and_match(spark):
    parent, leaf = naming.qualified(F.col("n"))
    assert tuple(spark.createDataFrame([("a::b.c",)], "n string").select(parent, leaf).first()) == ("a", "b.c")
    assert one(spark, naming.name_match(F.col("n"), "Channel.Server"), n="Phoenix.Channel.Server")
    assert not one(spark, naming.name_match(F.col("n"), "Router"), n="RouterHelper")


def test_truncation_keeps_characters_whole(spark):
    assert one(spark, text.truncate_bytes(F.col("t"), 4), t="aé日x") == "aé"
    assert one(spark, text.truncate_bytes(F.col("t"), 100), t="aé") == "aé"
    assert one(spark, text.truncate_words(F.col("t"), 9), t="alpha beta gamma") == "alpha"


def test_estimates(spark):
    assert one(spark, text.token_estimate(F.col("t")), t="abcde") == 2
    assert one(spark, text.token_estimate(F.col("t")), t="日本語") == 2
    assert one(spark, text.word_estimate(F.col("t")), t="a b c") == 4


def test_risk(spark):
    assert one(spark, risk.risk_label(F.col("x")), x=0.7) == "HIGH"
    assert one(spark, risk.test_weakness(F.col("t"), F.col("c")), t="thorough", c=0.0) == 0.5
    assert one(spark, risk.quality_tier(F.col("a"), F.col("m"), F.lit(False)), a=1.0, m=0.0) == "thin"
    assert one(spark, risk.quality_tier(F.col("a"), F.col("m"), F.lit(True)), a=0.0, m=3.0) == "stub"


def test_common_depth_and_suffix(spark):
    assert one(spark, paths.common_depth(F.col("a"), F.col("b")), a="x/y/z.py", b="x/y/w/q.py") == 2
    assert one(spark, paths.suffix_match(F.col("a"), "./y/../y/z.py"), a="x/y/z.py")
