"""Source files that do not parse (problem 3).

Method: generalised LL parsing with graph-structured stacks.  The extension
(for configuration the file's name) says the language; where it has several
dialects (Python 3 and 2, modules and scripts of JavaScript, C++ and C in .h,
JSON with comments with or without trailing commas) their grammars run
together, and a file is flagged if every one of them rejects it.

Parsing is one narrow stage.  Token groups and statements are stored once per
worker with what is known of them, so a worker parses a shape of statement the
first time it sees it; the memory is bounded and cleared between files.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstone.llm import grammars, lexers
from seamstone.llm.gll import Grammar

_GOES_ON = frozenset("; , ) . ?. -> ?-> :: = => ? ?? : else elif elsif elseif catch finally except while BIN ADD * < > & | AND OR ASG INC block paren brack curly ID from as instanceof in of with where SEMI markup TEMPLATE until ! QUEST satisfies STR endif endwhile endfor endforeach and or".split())
_BRACES = _GOES_ON - {"while", "ID", "*", "paren", "ADD", "&", "!", "STR", "brack", "from", "as", "of", "with", "where", "<", "::"}


@dataclass
class Language:
    """Lexer, grammar text and start rules (one of each dialect) of a language."""

    name: str
    lex: Callable[[Grammar, str], int]
    text: str
    starts: tuple[str, ...]
    lists: tuple[str, ...]
    goes_on: frozenset[str] = _BRACES
    by_line: bool = False
    made: Grammar | None = field(default=None, repr=False)

    def grammar(self) -> Grammar:
        if self.made is None:
            self.made = Grammar(self.text, self.lists, self.goes_on, self.by_line)
        return self.made

    def parses(self, text: str) -> bool:
        grammar = self.grammar()
        grammar.forget()
        try:
            root = self.lex(grammar, text)
            return grammar.accepts_one(self.starts, root)
        except lexers.Rejected:
            return False


_JSON = Language("json", lexers.lex_json, grammars.JSON, ("Json",), ())
_JSON_WITH_COMMENTS = Language("json", lexers.lex_json_with_comments, grammars.JSON_WITH_COMMENTS, ("Json", "JsonC"), ())
_JS_LISTS = ("Module", "Stmts", "ClassBody")
_JAVASCRIPT = Language("javascript", lexers.script_lexer(True), grammars.JAVASCRIPT, ("Module", "ModuleS"), (*_JS_LISTS, "ModuleS", "StmtsS", "ClassBodyS"), by_line=True)
_TYPESCRIPT = Language("typescript", lexers.script_lexer(False), grammars.TYPESCRIPT, ("Module",), _JS_LISTS, by_line=True)
_TSX = Language("tsx", lexers.script_lexer(True), grammars.TYPESCRIPT, ("Module",), _JS_LISTS, by_line=True)
_JAVA = Language("java", lexers.lex_java, grammars.JAVA, ("File",), ("File", "Body", "Stmts"))
_CSHARP = Language("csharp", lexers.lex_csharp, grammars.CSHARP, ("File",), ("File", "Body", "Stmts"))
_GO = Language("go", lexers.lex_go, grammars.GO, ("File",), ("File", "Stmts"), _GOES_ON)
_RUST = Language("rust", lexers.lex_rust, grammars.RUST, ("File",), ("File",), _BRACES)
_PHP = Language("php", lexers.lex_php, grammars.PHP, ("File",), ("File", "Block", "Body"))
_RUBY = Language("ruby", lexers.lex_ruby, grammars.RUBY, ("File",), ("File", "Body"), _GOES_ON - {"ID", "from", "as", "of", "with", "where", "curly"} | {"if", "unless"})
_PYTHON = Language("python", lexers.lex_python, grammars.PYTHON, ("File", "File2"), ("File", "File2"), frozenset(["block", "elif", "else", "except", "finally"]))
_CPP = Language("cpp", lexers.lex_cpp, grammars.CPP, ("File",), ("File", "Stmts", "Body"), _GOES_ON - {"while", "&", "!", "from", "as", "of", "with", "where"})
_C = Language("c", lexers.lex_header, grammars.HEADER, ("CFile",), ("CFile", "CStmts"), _CPP.goes_on)
_HEADER = Language("cpp", lexers.lex_header, grammars.HEADER, ("File", "CFile"), ("File", "Stmts", "Body", "CFile", "CStmts"), _CPP.goes_on)
# described by their tokens, brackets and beginnings: truncation, merge marks and foreign contents are seen, other errors are not
_KOTLIN = Language("kotlin", lexers.lex_kotlin, grammars.KOTLIN, ("File",), ())
_SWIFT = Language("swift", lexers.lex_swift, grammars.SWIFT, ("File",), ())
_SQL = Language("sql", lexers.lex_sql, grammars.SQL, ("File",), ())
_CSS = Language("css", lexers.lex_css, grammars.CSS, ("File",), ())

#: Languages by extension.
LANGUAGES: dict[str, Language] = {
    **dict.fromkeys(("py", "pyw", "pyi"), _PYTHON), **dict.fromkeys(("js", "jsx", "mjs", "cjs"), _JAVASCRIPT), **dict.fromkeys(("ts", "mts", "cts"), _TYPESCRIPT), "tsx": _TSX, "java": _JAVA, "cs": _CSHARP,
    "go": _GO, "rs": _RUST, "php": _PHP, "rb": _RUBY, "json": _JSON, **dict.fromkeys(("cpp", "cc", "cxx", "hpp", "hh", "hxx"), _CPP), "h": _HEADER, "c": _C, "jsonc": _JSON_WITH_COMMENTS, "code-workspace": _JSON_WITH_COMMENTS, "kt": _KOTLIN, "kts": _KOTLIN, "swift": _SWIFT, "sql": _SQL, "css": _CSS,
}
#: Files named .json that their tools read with comments.
_COMMENTED_JSON = re.compile(r"(?:^|/)(?:(?:ts|js)config(?:\.[\w.\-]+)?|devcontainer|\.eslintrc|\.swcrc|deno|tslint|api-extractor)\.json$|(?:^|/)\.vscode/[^/]*\.json$", re.I)


def language_of(path: str | None) -> Language | None:
    """The language that a path's extension stands for, where it is supported."""
    if not path or "." not in path:
        return None
    return _JSON_WITH_COMMENTS if _COMMENTED_JSON.search(path) else LANGUAGES.get(path.rpartition(".")[2].lower())


def parses(path: str | None, content: str | None) -> bool | None:
    """Whether a file's content parses in its language; None where there is no grammar for it.

    Null, empty and comment-only contents parse, except that JSON needs a value.
    """
    language = language_of(path)
    if language is None:
        return None
    if content is None or not content.strip():
        return True
    # templates and markup in holes are read by calls in calls, two a level at most
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12_000 + 2 * len(content)))
    return language.parses(content)


_SCHEMA = pa.schema([("file_id", pa.int64()), ("intended", pa.string()), ("parsed", pa.bool_())])


def parse_files(files: DataFrame) -> DataFrame:
    """``file_id, intended, parsed`` of every row of files (file_id, path, content).

    ``intended`` is the language of the extension; both are null where it is
    not supported.  Repeated rows are rated each; other columns are ignored;
    contents are parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            names = [lang.name if (lang := language_of(p)) else None for p in paths]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([parses(p, t) for p, t in zip(paths, texts)], pa.bool_())], schema=_SCHEMA)

    return files.select(F.col("file_id").cast("long"), "path", "content").mapInArrow(run, "file_id BIGINT, intended STRING, parsed BOOLEAN")


def unparsed_files(files: DataFrame) -> DataFrame:
    """The files that every dialect of their language rejects."""
    return parse_files(files).where(~F.col("parsed"))


def unparsed_rates(files: DataFrame) -> DataFrame:
    """``repo, intended, n_files, n_unparsed, rate`` of every repository and language (file_id must be unique)."""
    keyed = files.select(F.col("file_id").cast("long").alias("file_id"), "repo")
    rated = keyed.join(parse_files(files), "file_id").where(F.col("parsed").isNotNull())
    n_bad = F.count_if(~F.col("parsed"))
    return rated.groupBy("repo", "intended").agg(F.count(F.lit(1)).alias("n_files"), n_bad.alias("n_unparsed"), F.round(n_bad / F.count(F.lit(1)), 6).alias("rate"))
