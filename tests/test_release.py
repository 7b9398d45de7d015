import hashlib

from attesta.operators import release


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ranged_version(spark):
    rows = [("a", 5, "x"), ("a", 1, None), ("a", 4, ""), ("a", -1, "y"), ("a", None, "z"), ("b", 9, "x")]
    own = spark.createDataFrame(rows, "lang string, at long, text string")
    got = {r["lang"]: (r["ranges"], r["version"]) for r in release.ranged_version(own, "lang", "at", "text", 4).collect()}
    first, below, low, high = sha(sha("z")), sha(sha("y")), sha(sha("")), sha(sha("") + "\n" + sha("x"))
    assert got == {"a": (4, sha("\n".join([first, below, low, high]))), "b": (1, sha(sha(sha("x"))))}
    again = {r["lang"]: r["version"] for r in release.ranged_version(own.repartition(3), "lang", "at", "text", 4).collect()}
    assert again == {k: v for k, (_, v) in got.items()}


def test_ranged_version_of_nothing(spark):
    assert release.ranged_version(spark.createDataFrame([], "lang string, at long, text string"), "lang", "at", "text").count() == 0
