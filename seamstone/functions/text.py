"""Text measures as Column expressions without a shuffle; all but the entropy stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Line separators of Python's ``str.splitlines``.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Beginnings of comment lines.
COMMENT_STARTS = ("#", "//", "/*", "*")


def split_lines(text: Column) -> Column:
    """Lines without their ends; the empty piece after a last line end is none.  Null gives null."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def code_lines(text: Column) -> Column:
    """Number of lines that are neither blank nor begin as a comment."""

    def is_code(line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+", "")
        starts = bare.startswith(COMMENT_STARTS[0])
        for mark in COMMENT_STARTS[1:]:
            starts = starts | bare.startswith(mark)
        return (bare != "") & ~starts

    return F.size(F.filter(split_lines(text), is_code))


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes divided by four, rounded down."""
    return F.floor(F.octet_length(text) / F.lit(4)).cast("bigint")


@F.pandas_udf(DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    def of(text: str | None) -> float | None:
        if text is None:
            return None
        if not text:
            return 0.0
        share = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / len(text)
        return abs(float(-(share * np.log2(share)).sum()))

    return pd.Series([of(t) for t in texts], dtype="float64")


def entropy(text: Column) -> Column:
    """Shannon entropy over characters in bits; empty text has 0, null has null.

    Characters are counted in Arrow batches: built-in expressions need a pass
    over the text for every distinct character, or a row for every character.
    """
    return _entropy(text)


def entropy_state(h: Column) -> Column:
    """State of an entropy: up to 3 stable, up to 5 weak, up to 7 unstable."""
    return F.when(h <= 3, "STABLE").when(h <= 5, "WEAK").when(h <= 7, "UNSTABLE").otherwise("DEGENERATE")


def words(text: Column) -> Column:
    """Lower-case words between white space (Unicode white space too)."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


#: Language by extension.
LANGUAGE_BY_EXTENSION = {
    "py": "python", "pyw": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cs": "csharp", "go": "go", "rs": "rust",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "php": "php", "rb": "ruby",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of_path(path: Column) -> Column:
    """Language of a path's extension, null where it is not known."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])
    return table[extension(path)]


# The signs of a language in content, in this order.
def language_of_content(text: Column) -> Column:
    """Language guessed from content: the first sign that is found decides."""
    return (
        F.when(text.contains("#include"), "c_cpp")
        .when(text.contains("public class"), "java")
        .when(text.contains("func ") & text.contains("var "), "go")
        .when(text.contains("fn "), "rust")
        .otherwise("python")
    )


#: Speculative phrases, the short and the long list.
SPECULATIVE_SHORT = (r"\bprobably\b", r"\bmight\b", r"\bcould be\b", r"\bperhaps\b", r"\bi think\b", r"\bmaybe\b", r"\bguess\b", r"\bassume\b", r"\blikely\b")
SPECULATIVE_LONG = (
    r"\bprobably\b", r"\bmaybe\b", r"\bperhaps\b", r"\bmight be\b", r"\bcould be\b", r"\bi think\b", r"\bi guess\b", r"\bi assume\b", r"\bi believe\b", r"\bgenerally\b", r"\busually\b", r"\btypically\b",
    r"\bit seems\b", r"\blikely\b", r"\bunlikely\b", r"\bpossibly\b", r"\bmuhtemelen\b", r"\bolabilir\b", r"\bgenelde\b", r"\btahminen\b", r"\bgaliba\b",
)


def speculative(text: Column, patterns: tuple[str, ...] = SPECULATIVE_LONG) -> Column:
    """The patterns that a text matches, in order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())


# The signs of a recipe, in this order.
def route(text: Column) -> Column:
    """Kind of recipe for a text: config, log, documentation or code."""
    bare, up = F.trim(text), F.upper(text)
    shaped = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    log = up.rlike("INFO|ERROR|WARN|DEBUG|TIMESTAMP|EXCEPTION")
    doc = up.contains("<HTML") | up.contains("<!DOCTYPE") | F.substring(bare, 1, 10).contains("# ")
    return F.when(shaped & ~log, "config").when(log, "log").when(doc, "documentation").otherwise("code")


def shorten_field(name: Column, most: int = 3) -> Column:
    """Short form of a field name: initials of snake case, capitals of camel case, else its beginning."""
    initials = F.array_join(F.transform(F.filter(F.split(name, "_"), lambda p: p != ""), lambda p: F.substring(p, 1, 1)), "")
    capitals = F.lower(F.regexp_replace(name, r"[^A-Z]", ""))
    return (
        F.when(F.length(name) <= most, name)
        .when(name.contains("_") & (F.length(initials) >= 2), initials)
        .when(F.length(capitals) >= 2, capitals)
        .otherwise(F.substring(name, 1, most))
    )


def balanced(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """Whether a text has as many opening as closing marks."""
    return F.replace(text, F.lit(opening), F.lit("")).isNotNull() & (F.length(F.replace(text, F.lit(opening), F.lit(""))) == F.length(F.replace(text, F.lit(closing), F.lit(""))))


#: Call names that are no symbols of a project.
CALL_KEYWORDS = tuple(
    "if for while return print range len str int float list dict set tuple isinstance hasattr getattr setattr super open type map filter zip enumerate sorted reversed any all min max sum abs round format input hash id repr try except with as from import assert".split()
)


def referenced_symbols(text: Column) -> Column:
    """Distinct names that a piece of code defines, calls or imports from a module."""
    defined = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:class|def|function|fn|func|struct)\s+([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    called = F.array_except(F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1)), F.array(*map(F.lit, CALL_KEYWORDS)))
    made = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z0-9_]*)\s*\("), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(r"from[ \t]+\S+[ \t]+import[ \t]+([^\n]+)"), F.lit(1))
    names = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(F.split(F.trim(x), " as ").getItem(0)))
    imported = F.filter(names, lambda x: x.rlike("^[A-Za-z]"))
    return F.array_distinct(F.concat(defined, called, made, imported))


def log_level(line: Column) -> Column:
    """First level word that a line holds."""
    up = F.upper(line)
    return F.when(up.contains("INFO"), "INFO").when(up.contains("ERROR"), "ERROR").when(up.contains("WARN"), "WARNING").when(up.contains("DEBUG"), "DEBUG")


def is_anomaly(line: Column) -> Column:
    return F.upper(line).rlike("EXCEPTION|CRITICAL|FATAL|TIMEOUT")


def headers(text: Column, most: int = 20) -> Column:
    """Markdown and HTML headers of a text."""
    bare = F.transform(split_lines(text), lambda x: F.trim(x))
    return F.slice(F.filter(bare, lambda x: x.startswith("#") | (F.lower(x).startswith("<h") & x.contains(">"))), 1, most)


def keywords(text: Column, most: int = 15) -> Column:
    """Capitalised words of more than five letters and digits on longer lines, in order of appearance."""
    long = F.filter(F.transform(split_lines(text), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & x.rlike("[A-Z]"))
    tokens = F.flatten(F.transform(long, lambda x: F.split(x, r"\s+")))
    return F.slice(F.array_distinct(F.filter(tokens, lambda w: w.rlike("^[A-Z][A-Za-z0-9]{5,}$"))), 1, most)
