"""Text and path functions as Spark columns, so that they run inside whole-stage code."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stemming import stemmed

# Suffix classes, query stopwords (English and Russian), test and generated globs, default excludes.
CODE_EXT = (".dart", ".ts", ".tsx", ".js", ".jsx", ".py", ".kt", ".swift", ".astro")
MD_EXT = (".md", ".mdx")
TEXT_EXT = (".yml", ".yaml", ".json", ".sql", ".sh", ".toml", ".txt", ".html", ".css")
STOPWORDS = tuple(
    "a an and are as at be but by can do does for from how i in is it its not of on or so that the this to was what when where which who why will with you your "
    "а без бы в во вот все всё где да для до если есть еще ещё же за и из или им их к как ко когда кто ли либо мне мы на над не нет ни но о об он она они от по под при про с со так там то тоже у уже чем что чтобы это эта эти этот я".split()
)
GENERATED_GLOBS = ("*.g.dart", "*.freezed.dart", "*.gen.dart", "*.min.js")
TEST_GLOBS = ("*/test/*", "*/tests/*", "test/*", "tests/*", "*_test.*", "*.test.*", "*.spec.*", "*integration_test/*")
DECISION_GLOBS = ("docs/adr/*", "docs/decisions/*", "docs/postmortems/*", ".ai-factory/patches/*", "docs/notes/*")

WORD = r"[\p{L}\p{N}]+"
IDENTIFIER_WORD = r"[\p{L}\p{N}_]+"
CAMEL = r"(?<=[a-zа-яё0-9])(?=[A-ZА-ЯЁ])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Lower-case words; an identifier in camelCase gives its parts and then itself. Null gives null.

    Only texts with a lower letter before a capital (or İ, whose lower case holds a mark) take the word-by-word path.
    """
    text = _col(text)

    def split(word: Column) -> Column:
        parts = F.split(F.lower(F.regexp_replace(word, CAMEL, " ")), " ")
        return F.when(word.rlike(CAMEL), F.concat(parts, F.array(F.lower(word)))).otherwise(F.array(F.lower(word)))

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    plain = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    return F.when(text.rlike(f"{CAMEL}|İ"), F.flatten(F.transform(words, split))).otherwise(plain)


def query_tokens(text: Column | str, drop_stopwords: bool = False, stem: bool = False) -> Column:
    """Tokens of a query, in order and with repeats; stopwords are matched as surface forms, stems are taken after."""
    tokens = tokenize(text)
    tokens = F.filter(tokens, lambda t: ~t.isin(*STOPWORDS)) if drop_stopwords else tokens
    return stemmed(tokens) if stem else tokens


def identifiers(text: Column | str) -> Column:
    """Words of at least four characters that begin with an ASCII letter or underscore, case kept."""
    words = F.regexp_extract_all(_col(text), F.lit(f"({IDENTIFIER_WORD})"), F.lit(1))
    return F.filter(words, lambda w: w.rlike("^[A-Za-z_]") & (F.length(w) >= 4))


def slug(text: Column | str) -> Column:
    """Lower case, runs of other characters than letters, digits and _ as one hyphen, 60 characters at most, `section` if nothing is left."""
    plain = F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, 60), F.lit("")), F.lit("section"))


def glob_regex(globs: list[str] | tuple[str, ...]) -> str:
    """One anchored pattern for any of the globs; * and ? also match a slash, brackets are classes."""
    out = []
    for glob in globs:
        made, i = "", 0
        while i < len(glob):
            c = glob[i]
            end = glob.find("]", i + 2) if c == "[" else -1
            if c == "*":
                made += ".*"
            elif c == "?":
                made += "."
            elif end > 0:
                body = re.sub(r"([\\\[&])", r"\\\1", glob[i + 1 : end])
                made += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
                i = end
            else:
                made += re.escape(c) if not c.isalnum() else c
            i += 1
        out.append(made)
    return f"(?s)^(?:{'|'.join(out)})$" if out else r"(?!)"


def glob_match(path: Column | str, globs: list[str] | tuple[str, ...]) -> Column:
    return _col(path).rlike(glob_regex(globs))


def suffix(path: Column | str) -> Column:
    """Lower-case suffix of the last name, with its dot; a leading dot isn't one."""
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)$", 1))


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def normpath(path: Column | str) -> Column:
    """A relative path without `.`, empty parts and, as far as it can be resolved, `..`."""

    def step(held: Column, part: Column) -> Column:
        can = (F.size(held) > 0) & (F.coalesce(F.element_at(held, -1), F.lit("")) != "..")
        return F.when(part.isin("", "."), held).when((part == "..") & can, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(part)))

    return F.array_join(F.aggregate(F.split(_col(path), "/"), F.array().cast("array<string>"), step), "/")


def is_test(path: Column | str) -> Column:
    return glob_match(path, TEST_GLOBS)


def is_generated(path: Column | str) -> Column:
    return glob_match(path, GENERATED_GLOBS)


def plain_word(name: Column | str) -> Column:
    """Letters only, all lower case."""
    name = _col(name)
    return name.rlike(r"^\p{L}+$") & (name == F.lower(name)) & (F.upper(name) != name)


def kind_of(path: Column | str, decision_globs: tuple[str, ...] = DECISION_GLOBS) -> Column:
    return F.when(glob_match(path, decision_globs), "decision").when(suffix(path).isin(*CODE_EXT), "code").otherwise("doc")


def language(text: Column | str) -> Column:
    return F.when(F.lower(_col(text)).rlike("[а-яё]"), "ru").otherwise("en")


def strip_scope(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"^[\p{L}\p{N}_./-]+:\s+", "")


def token_count(text: Column | str) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4).cast("int"))


def overlap_ratio(query: Column, document: Column) -> Column:
    """Share of the query's tokens that the document's tokens hold."""
    return F.size(F.filter(query, lambda t: F.array_contains(document, t))) / F.greatest(F.size(query), F.lit(1))


def register(spark: SparkSession) -> None:
    """The functions by name for SQL text, as SQL expressions (no Python runs)."""
    camel = CAMEL.replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(x STRING) RETURNS ARRAY<STRING> RETURN flatten(transform(regexp_extract_all(x, '({WORD.replace(chr(92), chr(92) * 2)})', 1), w -> if(size(split(regexp_replace(w, '{camel}', ' '), ' ')) > 1, concat(split(lower(regexp_replace(w, '{camel}', ' ')), ' '), array(lower(w))), array(lower(w)))))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION slug(x STRING) RETURNS STRING RETURN coalesce(nullif(substring(regexp_replace(regexp_replace(lower(x), '[^\\p{L}\\p{N}_]+', '-'), '^-+|-+$', ''), 1, 60), ''), 'section')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bm25_term(f DOUBLE, len DOUBLE, avg_len DOUBLE, idf DOUBLE) RETURNS DOUBLE RETURN idf * f * 2.5D / (f + 1.5D * (0.25D + 0.75D * len / avg_len))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rrf(pos INT) RETURNS DOUBLE RETURN 1D / (61 + pos)")
