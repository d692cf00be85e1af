"""Text functions as Column expressions: they run inside the JVM, row by row, and give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlog.functions import patterns as P

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is cut to this many code points.
LINE_LIMIT = 4096


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def is_blank(text: Column) -> Column:
    """Only ASCII white space, or nothing."""
    return ~text.rlike(r"[^ \t\n\r\f\x0B]")


def limit_value(text: Column, limit: int = LINE_LIMIT) -> Column:
    """struct(text, truncated): the first `limit` code points."""
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))


def mask_template(text: Column) -> Column:
    """Variable tokens (numbers, ids, addresses, times, paths with digits) become <*>; paths without a digit stay as they are.

    Each match is put between two code points that stand for nothing, with the kept path, if any, in between. A text that
    has these itself gets them written in another way first, and back afterwards.
    """

    def masked(t: Column) -> Column:
        marked = F.regexp_replace(t, P.MASK, "\ufdd0$1\ufdd1")
        return F.translate(F.replace(marked, F.lit("\ufdd0\ufdd1"), F.lit(P.MASKED)), "\ufdd0\ufdd1", "")

    def swapped(t: Column, pairs) -> Column:
        for a, b in pairs:
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    own = swapped(masked(swapped(text, _OWN)), [(b, a) for a, b in reversed(_OWN)])
    return F.when(~text.rlike(P.MASK_HINT), text).when(text.rlike("[\ufdd0-\ufdd2]"), own).otherwise(masked(text))


#: Other spellings of the code points that mark matches.
_OWN = [("\ufdd2", "\ufdd2\ufdd3"), ("\ufdd0", "\ufdd2\ufdd4"), ("\ufdd1", "\ufdd2\ufdd5")]


def lexical_terms(text: Column) -> Column:
    """All terms of a text, repeats included: lower-cased runs of letters and digits, cut where a capital follows a small letter, and the runs that - _ . : join, as one more term each."""
    parts = F.regexp_extract_all(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), F.lit(P.RUN), F.lit(0))
    whole = F.regexp_extract_all(text, F.lit(P.COMPOUND), F.lit(0))
    return F.transform(F.concat(parts, whole), ascii_lower)


def contains_exact(text: Column, needle: str) -> Column:
    """Case-sensitive; an empty needle is in nothing."""
    return F.contains(text, F.lit(needle)) if needle else F.lit(False)


def query_tokens(query: Column) -> Column:
    """Tokens of a query: one outer pair of quotes goes, then each token's."""
    unquote = lambda c: F.regexp_replace(c, '(?s)^"(.*)"$', "$1")
    return F.filter(F.transform(F.split(unquote(query), r"[\t\n\r ]+"), unquote), lambda t: t != "")


def is_identifier(token: Column) -> Column:
    return token.rlike(f"^(?:{P.IDENTIFIER})$") & ~token.rlike(r"[\n\r]$")


def query_class(query: Column) -> Column:
    """identifier, mixed or natural."""
    tokens = query_tokens(query)
    some = F.exists(tokens, is_identifier)
    return F.when(some & (F.size(tokens) == 1), "identifier").when(some, "mixed").otherwise("natural")


def member_name(name: Column) -> Column:
    """The label of an archive's member: forward slashes, no leading ./ and no trailing /."""
    return F.regexp_replace(F.regexp_replace(F.translate(name, "\\", "/"), r"^(?:\./)+", ""), "/+$", "")


def is_archive_path(path: Column) -> Column:
    return path.rlike(r"(?i)\.(?:tar|tgz|tar\.gz|tar\.xz|zip)$")


def is_gzip_path(path: Column) -> Column:
    return path.rlike(r"(?i)\.gz$")


def line_label(source: Column, array_element: Column, line: Column, score: Column, text: Column, prefixed: Column, occurrences: Column | None = None) -> Column:
    """A result as text: [source:]line N[ (count)]: score: text, the score with four decimals."""
    place = F.concat(F.when(prefixed, F.concat(source, F.lit(":"))).otherwise(""), F.when(array_element, "element").otherwise("line"), F.lit(" "), line.cast("string"))
    if occurrences is not None:
        place = F.concat(place, F.lit(" ("), occurrences.cast("string"), F.lit(")"))
    return F.concat(place, F.format_string(": %.4f: ", score.cast("double")), text)


def register(spark) -> None:
    """mask_template, lexical_terms, is_identifier, query_class and dot for SQL users of this session, as SQL functions over built-ins."""
    from siftlog.functions.vectors import register as vectors

    quote = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lower = f"translate(x, '{UPPER}', '{LOWER}')"
    own, masked = "t", lambda t: f"translate(replace(regexp_replace({t}, {quote(P.MASK)}, '\ufdd0$1\ufdd1'), '\ufdd0\ufdd1', '{P.MASKED}'), '\ufdd0\ufdd1', '')"
    for a, b in _OWN:
        own = f"replace({own}, '{a}', '{b}')"
    own = masked(own)
    for a, b in reversed(_OWN):
        own = f"replace({own}, '{b}', '{a}')"
    identifier = lambda t: f"({t} rlike {quote('^(?:' + P.IDENTIFIER + ')$')} AND NOT {t} rlike '[\\\\n\\\\r]$')"
    unquoted = lambda t: f"regexp_replace({t}, {quote('(?s)^' + chr(34) + '(.*)' + chr(34) + '$')}, '$1')"
    tokens = f"filter(transform(split({unquoted('q')}, '[\\\\t\\\\n\\\\r ]+'), x -> {unquoted('x')}), x -> x <> '')"
    bodies = {
        "mask_template(t STRING) RETURNS STRING": f"CASE WHEN NOT t rlike {quote(P.MASK_HINT)} THEN t WHEN t rlike '[\ufdd0-\ufdd2]' THEN {own} ELSE {masked('t')} END",
        "lexical_terms(t STRING) RETURNS ARRAY<STRING>": f"transform(concat(regexp_extract_all(regexp_replace(t, '([a-z])([A-Z])', '$1 $2'), {quote(P.RUN)}, 0), regexp_extract_all(t, {quote(P.COMPOUND)}, 0)), x -> {lower})",
        "is_identifier(t STRING) RETURNS BOOLEAN": identifier("t"),
        "query_class(q STRING) RETURNS STRING": f"CASE WHEN NOT exists({tokens}, x -> {identifier('x')}) THEN 'natural' WHEN size({tokens}) = 1 THEN 'identifier' ELSE 'mixed' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    vectors(spark)
