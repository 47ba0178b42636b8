import fnmatch
import posixpath
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.stemming import stem_ru, stemmed

SAMPLES = ["HTTPServer parseJson snake_case v2Alpha", "счётчикПовторов ЁлкаИгл über Éa", "", "a1B c_d  --", "ÀB aÀ"]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


def tokens(text):
    out = []
    for w in re.findall(r"[^\W_]+", text):
        parts = re.sub(r"(?<=[a-zа-яё0-9])(?=[A-ZА-ЯЁ])", " ", w).lower().split()
        out += parts + ([w.lower()] if len(parts) > 1 else [])
    return out


def test_tokenize(spark):
    X.register(spark)
    for s in SAMPLES:
        assert one(spark, X.tokenize("x"), s) == tokens(s)
        assert one(spark, F.expr("tokenize(x)"), s) == tokens(s)
    assert one(spark, X.query_tokens("x", True), "how does the parser work и не только") == ["parser", "work", "только"]


def test_slug(spark):
    for s, want in (("Hello, World!", "hello-world"), ("--", "section"), ("Ёлка №1", "ёлка-1"), ("a" * 80, "a" * 60)):
        assert one(spark, X.slug("x"), s) == want == one(spark, F.expr("slug(x)"), s)


def test_globs(spark):
    paths = ["a/b.py", "docs/adr/1.md", "x.g.dart", "a/tests/b.ts", "tests/x", "a[1].txt", "docs/adr/deep/2.md", "a1.txt"]
    for globs in (["*.py"], ["docs/adr/*"], X.TEST_GLOBS, X.GENERATED_GLOBS, ["a[[]1].txt"], ["a[0-9].txt", "?/b.*"], ["[!a]*"]):
        for p in paths:
            assert one(spark, X.glob_match("x", globs), p) == any(fnmatch.fnmatchcase(p, g) for g in globs), (p, globs)


@pytest.mark.parametrize("path", ["a/../b", "./a//b/./c", "../x/../y", "a/b/../../..", "a"])
def test_normpath(spark, path):
    assert one(spark, X.normpath("x"), path) == posixpath.normpath(path)


def test_paths(spark):
    assert [one(spark, X.suffix("x"), p) for p in ("a/B.PY", ".toml", "a/.x", "a.b.ts", "noext")] == [".py", "", "", ".ts", ""]
    assert one(spark, X.kind_of("x"), "docs/adr/1.md") == "decision" and one(spark, X.kind_of("x"), "a.py") == "code" and one(spark, X.kind_of("x"), "a.md") == "doc"
    assert [one(spark, X.plain_word("x"), w) for w in ("sign", "Sign", "a_b", "счёт", "ß1")] == [True, False, False, True, False]
    assert one(spark, X.strip_scope("x"), "api/x: do it") == "do it" and one(spark, X.language("x"), "Привет") == "ru"


def test_stems(spark):
    # pairs from the published algorithm's vocabulary
    known = {"важная": "важн", "важнейшими": "важн", "вагонов": "вагон", "валяется": "валя", "бегавшая": "бега", "книги": "книг", "падаем": "пада", "пакетом": "пакет", "parser": "parser", "ёлка": "елк"}
    for w, s in known.items():
        assert stem_ru(w) == s, w
    assert one(spark, stemmed(X.tokenize("x")), "важная parser книги") == ["важн", "parser", "книг"]
