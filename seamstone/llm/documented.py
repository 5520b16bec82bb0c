"""Functions paired with their documentation (problem 6).

Method: lexed tokens are exploded into rows; cumulative windows give lines and
bracket depth, gaps and islands join lines into logical lines and comment
blocks, and lag and lead windows attach the block above or the string below to
a function's line.

Everything up to the attached text is built-in SQL.  Contents are lexed in the
scan stage; what is shuffled are narrow token rows, which carry their text only
where it is a comment or a string.  All windows over tokens share that one
partitioning by file and one sort; symbols join by file and line.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens keep the white space before them: its line ends count the lines.
_DQ = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
_BT = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_TRIPLE = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
_SLASHES = r"/\*[\s\S]*?\*/|//[^\n]*"
#: Comments, strings and the marks that begin them, by family of extensions.
FAMILIES: dict[tuple[str, ...], tuple[str, str, str]] = {
    ("py", "pyw", "pyi"): (r"#[^\n]*", rf"[rRbBuUfF]{{0,2}}(?:{_TRIPLE}|{_DQ}|{_SQ})", "\"'#"),
    ("rb",): (r"#[^\n]*", f"{_DQ}|{_SQ}", "\"'#"),
    ("php",): (_SLASHES + r"|#(?!\[)[^\n]*", f"{_DQ}|{_SQ}", "\"'/#"),
    ("rs", "c", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "h", "java", "cs"): (_SLASHES, f"{_DQ}|{_CHAR}", "\"'/"),
    ("js", "jsx", "ts", "tsx", "mjs", "cjs", "go"): (_SLASHES, f"{_DQ}|{_SQ}|{_BT}", "\"'`/"),
    ("kt", "kts", "swift"): (_SLASHES, rf'"""[\s\S]*?"""|{_DQ}|{_CHAR}', "\"'/"),
}
#: Strings and pieces of code between them that one token holds at most; what follows on the line is further tokens.
_PIECES = 40
#: White space of the token patterns.
_BLANKS = " \t\n\x0b\f\r"
#: Extensions of Python, and those in which # begins a comment.
_PYTHON = ("py", "pyw", "pyi")
_HASH = (*_PYTHON, "rb")


def _pattern(comment: str, string: str, marks: str) -> str:
    """A comment, a string, or code to the end of its line; strings within code belong to its token."""
    bare = (r"/(?![/*])|" if "/" in marks else "") + (r"#(?=\[)|" if "#(?!" in comment else "")
    return rf"\s*(?:{comment}|{string}|(?:{bare}[^\s{marks}])(?:{string}|{bare}[^{marks}\n]++){{0,{_PIECES}}}+|[{marks}])"


def _count(text: Column, mark: str) -> Column:
    # by bytes: a string knows how many it has
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _by_family(make: Callable[[str, str, str], Column]) -> Column:
    out = F.lit(None)
    for exts, patterns in FAMILIES.items():
        out = F.when(F.col("ext").isin(*exts), make(*patterns)).otherwise(out)
    return out


def tokens_of(files: DataFrame) -> DataFrame:
    """``file_id, ext, pos, lead, inner, kind, delta, text, closes, total, shut`` of every token.

    ``lead`` and ``inner`` count the line ends before and in a token, ``delta``
    is its change of bracket depth, ``closes`` whether it may end an
    annotation; ``text`` is kept for comments and the strings of Python.
    ``total`` are the line ends of the file, ``shut`` whether it ends in a bracket.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    lexed = _by_family(lambda *p: F.regexp_extract_all("content", F.lit(_pattern(*p)), F.lit(0)))
    whole = F.rtrim("content", F.lit(_BLANKS))
    # once a file, below the explode
    known = files.withColumn("ext", ext).select("file_id", "ext", "content", _count(whole, "\n").alias("total"), (whole.endswith(")") | whole.endswith("]")).alias("shut"))
    raw = known.select("file_id", "ext", "total", "shut", F.posexplode(lexed).alias("pos", "raw")).withColumn("tok", F.ltrim("raw", F.lit(_BLANKS)))
    tok = F.col("tok")
    quote = F.when(F.substring(tok, 1, 1).isin(*"rRbBuUfF"), tok.rlike(r"^[rRbBuUfF]{1,2}[\"']")).otherwise(tok.startswith('"') | tok.startswith("'"))
    shut = F.rtrim(tok, F.lit(_BLANKS))
    kind = (
        F.when(tok.startswith("/*") | tok.startswith("//") | (tok.startswith("#") & F.col("ext").isin(*_HASH)) | (tok.startswith("#") & ~tok.startswith("#[") & (F.col("ext") == "php")), "comment")
        .when(quote & (F.octet_length(tok) > 1), "string")
        .when(tok.startswith("@") | (tok.startswith("#[") & F.col("ext").isin("rs", "php")) | (tok.startswith("[") & (F.col("ext") == "cs")) | (tok.startswith("[[") & F.col("ext").isin("c", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "h")), "mark")
        .otherwise("code")
    )
    has_string = tok.contains('"') | tok.contains("'") | tok.contains("`")
    bare = F.when(has_string, _by_family(lambda _, string, __: F.regexp_replace(tok, string, ""))).otherwise(tok)
    plain = F.when(kind.isin("code", "mark"), bare).otherwise("")
    depth = _count(plain, "(") + _count(plain, "[") - _count(plain, ")") - _count(plain, "]")
    inner = _count(tok, "\n")
    text = F.when((kind == "comment") | ((kind == "string") & F.col("ext").isin(*_PYTHON)), tok)
    return raw.select("file_id", "ext", "pos", (_count(F.col("raw"), "\n") - inner).alias("lead"), inner.alias("inner"), kind.alias("kind"), depth.alias("delta"), text.alias("text"), (shut.endswith(")") | shut.endswith("]") | (tok.startswith("@") & tok.rlike(r"^@[\w.$]+\s*$"))).alias("closes"), "total", "shut")


def logical_lines(tokens: DataFrame) -> DataFrame:
    """``file_id, ext, pos, line, end_line, kind, text``: islands of tokens that belong to one logical line.

    A token begins a logical line if it is the first on its line while no
    bracket is open.  An island is kept as its first token; where it ends is
    known from the token before the next island, or from the file's end, so
    nothing is grouped.
    """
    by_pos = Window.partitionBy("file_id").orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tokens.select(
        "*",
        F.sum(F.col("lead") + F.col("inner")).over(upto).alias("till"),
        F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"),
        F.last(F.when(F.col("kind") != "comment", F.col("closes")), ignorenulls=True).over(before).alias("closed"),
    )
    # line ends before a token and in it: its first line follows those before, its last one those in it
    starts = placed.withColumn("before", F.col("till") - F.col("lead") - F.col("inner")).where(((F.col("pos") == 0) | (F.col("lead") > 0)) & (F.col("depth") <= 0))
    ended = F.coalesce(F.lead("before").over(by_pos), F.col("total")) + 1
    closes = F.when(F.lead("pos").over(by_pos).isNull(), F.col("closes") | F.col("shut")).otherwise(F.lead("closed").over(by_pos))
    return starts.select(
        "file_id", "ext", "pos", (F.col("till") - F.col("inner") + 1).alias("line"), ended.alias("end_line"),
        # an annotation before a definition on the same line is part of it
        F.when((F.col("kind") == "mark") & ~closes, "code").otherwise(F.col("kind")).alias("kind"), "text",
    )


def documentation(lines: DataFrame) -> DataFrame:
    """``file_id, line, end_line, above, below`` of every logical line of code.

    ``above`` is the text of the comment block that ends on the line before
    (decorators and annotations between are taken out of the count),
    ``below`` the string that is the first statement after a line of Python.
    """
    by_pos = Window.partitionBy("file_id").orderBy("pos")
    upto = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = F.sum(F.when(F.col("kind") == "mark", F.col("end_line") - F.col("line") + 1).otherwise(0)).over(upto)
    # decorators taken out: what was above them now ends on the line before
    bare = (
        lines.withColumn("marks", marks)
        .where(F.col("kind") != "mark")
        .withColumn("at", F.col("line") - F.col("marks"))
        .withColumn("till", F.col("end_line") - F.col("marks"))
    )
    # islands of comments: a comment that follows a comment on the line before continues its block
    previous = F.lag(F.struct("kind", "till")).over(by_pos)
    breaks = F.when((F.col("kind") == "comment") & (F.col("prev.kind") == "comment") & (F.col("at") == F.col("prev.till") + 1), 0).otherwise(1)
    in_blocks = bare.withColumn("prev", previous).withColumn("block", F.sum(breaks).over(upto))
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text"))))
    blocks = in_blocks.groupBy("file_id", "block").agg(
        F.max(F.when(F.col("kind") == "comment", 2).when(F.col("kind") == "string", 1).otherwise(0)).alias("k"), F.max(F.col("ext").isin(*_PYTHON)).alias("python"),
        F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.min("at").alias("at"), F.max("till").alias("till"), F.array_join(F.transform(texts, lambda x: x.getField("text")), "\n").alias("text"),
    )
    by_block = Window.partitionBy("file_id").orderBy("block")
    return (
        blocks.withColumn("up", F.lag(F.struct("k", "till", "text")).over(by_block))
        .where(F.col("k") != 2)
        .withColumn("down", F.lead(F.struct("k", "text")).over(by_block))
        .select(
            "file_id", "line", "end_line",
            F.when((F.col("up.k") == 2) & (F.col("at") == F.col("up.till") + 1), F.col("up.text")).alias("above"),
            F.when(F.col("python") & (F.col("down.k") == 1), F.col("down.text")).alias("below"),
        )
    )


def function_docs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_id, name, signature, doc``: functions and methods with the documentation found in their file.

    ``doc`` is null where there is none.  Symbols whose file is missing or has
    null content, and lines that hold no code, come out with null ``doc``;
    repeated symbols each get a row.
    """
    wanted = symbols.where(F.col("symbol_type").isin("function", "method")).select("symbol_id", "file_id", "line", "name", "signature")
    tokens = tokens_of(files.where(F.col("content").isNotNull()).select("file_id", "path", "content"))
    # token rows and file numbers have the partitioning of the windows that follow; the hash table holds numbers only
    used = tokens.join(wanted.select("file_id").distinct().hint("shuffle_hash"), "file_id", "left_semi")
    docs = documentation(logical_lines(used)).select("file_id", F.explode(F.sequence("line", "end_line")).alias("line"), F.coalesce("below", "above").alias("doc")).where(F.col("doc").isNotNull())
    # joined by file and line: a file that holds very many of the symbols is spread over its lines
    found = wanted.alias("s").join(docs.alias("d"), (F.col("s.file_id") == F.col("d.file_id")) & (F.col("s.line") == F.col("d.line")), "left")
    return found.select("s.symbol_id", "s.name", "s.signature", "d.doc")


# ---- what a documentation says -------------------------------------------------
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|//[/!]*|#+!?|--+)?[ \t]?|[ \t]*\*+/[ \t]*$")
_QUOTES = re.compile(r"^[rRbBuUfF]{0,2}(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')$")
_XML = re.compile(r"</?(?:summary|remarks|para|p|br|value|returns|c|code|see|param|b|i|pre|typeparam|inheritdoc|example|exception)\b[^>]*/?>", re.I)
_TAG_LINE = re.compile(r"^(?:@|\\|:)[A-Za-z]\w*\b|^:\w+[^:]*:")
_SECTION = re.compile(r"^(?:args?|arguments|params?|parameters|returns?|raises|yields?|throws|examples?|usage|notes?|see also|attributes|parametreler|donus|rueckgabe|parameter)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^\*{0,2}[A-Za-z_$]\w*\*{0,2}(?:\s*\([^)]*\))?\s*:")
_RULER = re.compile(r"^[\W_]*$")
#: Directives to tools.
_PRAGMA = re.compile(
    r"^(?:eslint|jshint|jslint|tslint|prettier|istanbul|c8|v8|nyc|@ts-|ts-(?:ignore|expect|nocheck)|@flow|flow-|noqa|nolint|nosec|pylint|flake8|mypy|type:\s*ignore|pragma|fmt:\s*(?:on|off)|yapf|isort|black|ruff|coverage|clang-format|cppcheck|checkstyle|noinspection|suppress|phpcs|phpstan|psalm|rubocop|sonar|nosonar|go:|\+build|region\b|endregion\b|#?region|rustfmt|clippy|allow\(|swiftlint|ktlint|detekt|resharper|codacy|end\b$)",
    re.I,
)
#: Phrases that stand for documentation still to be written.
_PLACEHOLDER = re.compile(
    r"^(?:todo|fixme|xxx|tbd|tba|hack)\b.{0,60}$|^(?:none|n/?a|null|empty|nothing|foo|bar|test|docstring|description|desc|summary|doc(?:s|umentation)?|comment|text|placeholder|stub)\W*(?:here|goes here|of the (?:method|function|class))?\W*$"
    r"|^(?:short|brief|long|method|function|class|one[- ]line|some|my)? ?(?:description|summary|documentation|docs?|comment)(?: (?:here|goes here|of (?:the )?(?:method|function|class)|missing|tbd))?\W*$"
    r"|^(?:auto-?generated|automatically generated)\b.{0,40}stub\W*$|^(?:insert|add|write|put|enter|your) (?:your |the |some )?(?:docs?|description|documentation|comment|text|summary)\b.{0,20}$"
    r"|^(?:yazilacak|yazılacak|eklenecek|doldurulacak|folgt|kommt noch|beschreibung|aciklama|açıklama|noch zu (?:schreiben|dokumentieren))\b.{0,20}$|^(?:to be (?:written|done|documented|added)|not (?:yet )?documented|undocumented|needs? docs?|explain me)\b.{0,20}$",
    re.I,
)
_POINTER = re.compile(
    r"^(?:see|same as|as|like|cf\.?|refer to|ref\.?|siehe|wie|bkz\.?|bakiniz|look at|compare|described in|documented in)\b(?!.*\b(?:is|are|was|returns?|when|because|so that|and|must|which)\b.{10,}).{0,60}$|^\{?@?(?:inheritdoc|inherit|link|see)\b.{0,60}$|^(?:inherited|overridden|overrides)\b.{0,40}$|^(?:https?|file)://\S+$",
    re.I,
)
_CODE = re.compile(
    r"[;{}]\s*$|^[\w.$\[\]>\-:]+\s*(?:=|\+=|:=)\s*\S+|^(?:if|for|while|switch|elif|else if)\s*\(.*\)|^(?:return|import|from|def|class|function|var|let|const|func|fn|public|private|static|print|console|else|try|catch|raise|throw)\b.*[(){};=]|^[\w.$:\->]+\([^)]*\)\s*[;:]?\s*$|^(?:if|for|while|elif|with)\b.*:\s*$"
)
#: A list of parameter names at the end of a line.
_LISTED = re.compile(r"\(\s*[$&*]{0,2}\w+(?:\s*,\s*[$&*]{0,2}\w+)*\s*\)\s*[.:]?$")
#: Words that add nothing to a name.
_FILL = frozenset(
    "a an the this that these of to for in on and or is are be does do did it its function functions method methods func fn procedure routine helper helpers util utility class constructor getter setter handler callback main simple given from with by performs perform executes execute runs run implements implementation "
    "der die das den dem ein eine einen funktion methode fuer für und zum zur von bu bir ve ile icin için fonksiyon fonksiyonu metot metodu".split()
)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]|\d+")


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ies", "ing", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def plain_text(doc: str) -> list[str]:
    """A documentation's lines without comment marks, quotes, markup and tag lines."""
    doc = doc.strip()
    if re.match(r"[rRbBuUfF]{0,2}[\"']", doc):
        doc = _QUOTES.sub("", _QUOTES.sub("", doc, count=1))
        raw = doc.split("\n")
    else:
        raw = [_MARKS.sub("", line.rstrip()) for line in doc.split("\n")]
    out, in_tag, in_section = [], False, False
    for line in raw:
        indented = line[:1] in " \t"
        line = _XML.sub(" ", line).strip()
        if not line:
            in_tag = False
            in_section = in_section and not out
            continue
        if _SECTION.match(line):
            in_section, in_tag = True, False
            continue
        if _TAG_LINE.match(line):
            in_tag = True
            continue
        if (in_tag and indented) or (in_section and (_ITEM.match(line) or indented)):
            continue
        in_tag = in_section = False
        out.append(line)
    return out


def tells_something(name: str | None, doc: str | None, min_words: int = 4) -> bool:
    """Whether a documentation says something in a sentence beyond the name it stands at."""
    if not doc:
        return False
    named = {_stem(w) for w in _SPLIT.findall(name or "")}
    kept = []
    for line in plain_text(doc):
        bare = line.strip(" \t*-_=~<>|.#/")
        if _RULER.match(line) or _PRAGMA.match(bare) or _PRAGMA.match(line) or _PLACEHOLDER.match(bare) or _POINTER.match(bare) or _CODE.search(line):
            continue
        kept.append(_LISTED.sub("", line))
    text = " ".join(kept)
    words = re.findall(r"[^\W\d_]+", text)
    if len(words) < min_words:
        return False
    parts = [p for w in re.findall(r"\w+", text) for p in _SPLIT.findall(w)]
    said = [p for p in parts if p.lower() not in _FILL and _stem(p) not in named and not p.isdigit()]
    return len(said) >= 2


def documented_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_id, name, signature, doc`` of the functions whose documentation tells something."""
    schema = pa.schema([("symbol_id", pa.int64()), ("name", pa.string()), ("signature", pa.string()), ("doc", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [tells_something(n, d) for n, d in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, schema=schema)

    pairs = function_docs(symbols, files).where(F.col("doc").isNotNull())
    return pairs.select(F.col("symbol_id").cast("long"), "name", "signature", "doc").mapInArrow(run, "symbol_id BIGINT, name STRING, signature STRING, doc STRING")
