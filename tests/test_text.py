"""Golden values and cases of the text functions."""

import fnmatch
import re
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import terms, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def test_chunk_ids(spark):
    rows = spark.createDataFrame([("sample.py", 1), ("sample.py", 5)], "p string, n int").select(text.chunk_id(F.col("p"), F.col("n")).alias("i")).collect()
    assert [r.i for r in rows] == ["f3791711a476f9ce370d58605e354b193054026f92cb412e63938a429547ee4f", "16ca50508dd9714562b1944daccd94dc0c9ac1ab6f22c4cab934446635271da6"]
    assert str(uuid.uuid5(uuid.NAMESPACE_URL, "src/foo.py:10")) == "e76dab7b-dd95-5ceb-b893-6930a5076f1e"


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("connection", "connect"), ("indexed", "index"), ("testing", "test"), ("return", "return"), ("files", "file"), ("stemming", "stem"), ("hoping", "hope"), ("hopping", "hop"), ("skies", "sky"), ("generously", "generous"), ("relational", "relat"), ("happy", "happi"), ("by", "by")])
def test_stems(word, stem):
    assert terms.stem(word) == stem


@pytest.mark.parametrize(("token", "number"), [("hello", 613153351), ("world", 74040069), ("test", 1167338989), ("foo", 156908512), ("return", 1430125705)])
def test_token_numbers(token, number):
    assert terms.token_number(token) == number


def test_udfs(spark):
    rows = spark.createDataFrame([("running",), (None,)], "t string").select(terms.stem_udf("t").alias("s"), terms.token_id_udf("t").alias("n")).collect()
    assert [r.s for r in rows] == ["run", None] and rows[1].n is None


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Hello, World!  test") == ["hello", "world", "test"]
    assert one(spark, text.kept_tokens(F.col("t"), ["the"]), t="the a " + "x" * 41) == ["a"]


def test_callees(spark):
    found = one(spark, text.callees(F.col("t")), t='if (x) { featureService.isEnabled("flag"); DoWork(); return (1); }')
    assert found == ["isEnabled", "featureService.isEnabled", "DoWork"]
    assert one(spark, text.callees(F.col("t")), t="Foo.Bar(); Foo.Bar();") == ["Bar", "Foo.Bar"]


def test_routes_and_urls(spark):
    assert one(spark, text.route_paths(F.col("t"), F.lit("a/UsersController.cs")), t='[HttpGet("api/[controller]/list")] app.get("/x") app.post("/orders/new")') == ["api/users/list", "orders/new"]
    found = one(spark, text.config_urls(F.col("t")), t="a: /api/users\nbaseUrl: http://host/x\n")
    assert "api/users" in found["paths"] and found["base_urls"] == ["http://host/x"]
    assert one(spark, text.code_urls(F.col("t")), t='call("/api/users/list")') == ["api/users/list"]


def test_reference_types(spark):
    kind = text.reference_type(F.col("t"), F.lit("Foo"), F.lit(""))
    cases = {"public class Foo {": "definition", "@GetMapping(\"/a\")": "endpoint_definition", "requests.get(u)": "http_call", "import x": "import", "x = 1": "usage"}
    for content, expected in cases.items():
        assert one(spark, kind, t=content) == expected
    assert one(spark, text.http_verb(F.col("t")), t="app.Delete( .MapPost(") == "DELETE"


def test_paths_match(spark):
    for a, b, same in [("/api/users/{id}", "v1/api/users", True), ("users", "api/users", False), ("api/user", "api/users", False), ("a/b/c", "b/c/d", False)]:
        assert one(spark, text.paths_match(text.normal_path(F.col("a")), text.normal_path(F.col("b"))), a=a, b=b) is same


def test_names(spark):
    for name, normal in [("my-contracts-definitions", "my-contracts"), ("My_Lib.Core", "my-lib"), ("x-apis", "x"), ("plain", "plain")]:
        assert one(spark, text.normal_name(F.col("n")), n=name) == normal


def test_languages(spark):
    for path, language in [("a/b.PY", "python"), ("Dockerfile", "dockerfile"), ("x/build.gradle.kts", "groovy"), ("a.b.kts", "kotlin"), ("noext", None), (".env", "properties")]:
        assert one(spark, text.language_of(F.col("p")), p=path) == language
    assert one(spark, text.excluded(F.col("p")), p="a/node_modules/b.js") and not one(spark, text.excluded(F.col("p")), p=".github/workflows/ci.yml")
    assert one(spark, text.excluded(F.col("p")), p=".github/x.yml") and not one(spark, text.excluded(F.col("p")), p="build")


def test_manifests(spark):
    good = ["pom.xml", "a/build.gradle", "package.json", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "x.csproj", "y\\z.NUSPEC"]
    for path in good:
        assert one(spark, text.is_manifest(F.col("p")), p=path)
    for path in ["cargo.toml", "pom.xml.bak", "src/main.go"]:
        assert not one(spark, text.is_manifest(F.col("p")), p=path)


@given(st.text("ab/*?.", max_size=8), st.text("ab/.", max_size=8))
def test_globs_are_those_of_fnmatch(glob, path):
    assert bool(re.match(text.glob_pattern(glob), path)) == fnmatch.fnmatchcase(path, glob.replace("[", "[[]"))


def test_ignore_patterns():
    assert text.ignore_pattern("# x") is None and text.ignore_pattern(" ") is None
    assert re.search(text.ignore_pattern("*.log"), "a.log") and not re.search(text.ignore_pattern("*.log"), "d/a.log")
    assert not re.search(text.ignore_pattern("out/"), "out/x") and re.search(text.ignore_pattern("out/", standard=True), "out/x")


def test_request_paths(spark):
    for path, clean, name in [(" ./a\\b/ ", "a/b", "a"), ("/x", "x", "x"), ("", "", "codebase")]:
        assert one(spark, text.request_path(F.col("p")), p=path) == clean and one(spark, text.collection_of(F.col("p")), p=path) == name
    assert one(spark, text.first_tokens(F.col("t"), 2), t="A b, C d") == "a b"


def test_intervals():
    assert [text.interval_seconds(x) for x in ("30s", "5m", "2h", "1d", "01:30:00", "x", "0s")] == [30, 300, 7200, 86400, 5400, None, None]
    assert text.six_field_cron("0 3 * * *") == "0 0 3 * * ?" and text.six_field_cron("0 0 3 * * ?") == "0 0 3 * * ?"


def test_rounding_is_half_to_even(spark):
    assert spark.range(1).select(F.bround(F.lit(0.125), 2).alias("r")).first().r == 0.12
