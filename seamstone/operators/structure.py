"""Code structure: names by regex in the JVM, symbols and calls of Python by its own parser."""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import pyarrow as pa

from seamstone.functions import text as T
from seamstone.functions.arrowmap import map_rows

#: Name patterns of each family (class, functions..., import).
PATTERNS = {
    "python": (r"^\s*class\s+([a-zA-Z0-9_]+)", (r"^\s*def\s+([a-zA-Z0-9_]+)",), r"^\s*(?:import|from)\s+([a-zA-Z0-9_\.]+)"),
    "rust": (r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+([a-zA-Z0-9_]+)", (r"^\s*(?:pub\s+)?fn\s+([a-zA-Z0-9_]+)",), r"^\s*use\s+([a-zA-Z0-9_:]+)"),
    "javascript": (
        r"^\s*(?:export\s+)?class\s+([a-zA-Z0-9_]+)",
        (r"^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_]+)", r"^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z0-9_]+)\s*=\s*(?:async\s*)?(?:function|\(.*\)\s*=>)", r"^\s{2,}([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{"),
        r"""^\s*import\s+.*\s+from\s+['"](.*?)['"]""",
    ),
    "go": (r"^\s*type\s+([a-zA-Z0-9_]+)\s+struct", (r"^\s*func\s+([a-zA-Z0-9_]+)",), r"""^\s*import\s+['"](.*?)['"]"""),
    "c_cpp": (r"^\s*(?:class|struct)\s+([a-zA-Z0-9_]+)", (r"^\s*(?:[a-zA-Z0-9_]+[\s\*]+)+([a-zA-Z0-9_]+)\s*\(",), r"""^\s*#include\s+[<"](.*?)['">]"""),
    "java_csharp": (
        r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:class|interface|enum)\s+([a-zA-Z0-9_]+)",
        (r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:[a-zA-Z0-9_<>\[\]]+\s+)+([a-zA-Z0-9_]+)\s*\(",),
        r"^\s*(?:import|using)\s+([a-zA-Z0-9_\.]+)",
    ),
    "php": (r"^\s*(?:abstract\s+)?class\s+([a-zA-Z0-9_]+)", (r"^\s*function\s+([a-zA-Z0-9_]+)",), r"""^\s*(?:use|require|include)\s+['"](.*?)['"]"""),
    "ruby": (r"^\s*class\s+([a-zA-Z0-9_]+)", (r"^\s*def\s+([a-zA-Z0-9_]+)",), r"""^\s*require\s+['"](.*?)['"]"""),
    "swift": (r"^\s*(?:public|private)?\s*(?:class|struct|enum|protocol)\s+([a-zA-Z0-9_]+)", (r"^\s*(?:public|private)?\s*func\s+([a-zA-Z0-9_]+)",), r"^\s*import\s+([a-zA-Z0-9_]+)"),
    "kotlin": (r"^\s*(?:open|data)?\s*class\s+([a-zA-Z0-9_]+)", (r"^\s*fun\s+([a-zA-Z0-9_]+)",), r"^\s*import\s+([a-zA-Z0-9_\.]+)"),
    "sql": (r"^\s*CREATE\s+TABLE\s+([a-zA-Z0-9_]+)", (r"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+([a-zA-Z0-9_]+)",), r"^\s*--\s*IMPORT\s+(.*)"),
}
#: Family by extension; others are read as Python.
FAMILY = {"rs": "rust", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "go": "go", "c": "c_cpp", "h": "c_cpp", "cpp": "c_cpp", "hpp": "c_cpp", "java": "java_csharp", "cs": "java_csharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "sql": "sql"}
_NOT_METHODS = ("if", "for", "while", "switch", "catch", "with")


def _all(text: Column, pattern: str) -> Column:
    # lines end at line feeds only
    return F.regexp_extract_all(text, F.lit("(?md)" + pattern), F.lit(1))


def structure(files: DataFrame) -> DataFrame:
    """Add ``family, found_classes, found_functions, found_imports`` to files (path, content); null content gives null."""
    family = F.coalesce(F.create_map(*[F.lit(x) for p in FAMILY.items() for x in p])[T.extension(F.col("path"))], F.lit("python"))
    kinds: dict[str, Column] = {k: F.lit(None).cast("array<string>") for k in ("classes", "functions", "imports")}
    for name, (cls, fns, imp) in PATTERNS.items():
        here = F.col("family") == name
        found = [_all(F.col("content"), p) for p in fns]
        if len(found) == 3:
            found[2] = F.filter(found[2], lambda x: ~x.isin(*_NOT_METHODS))
        kinds["classes"] = F.when(here, _all(F.col("content"), cls)).otherwise(kinds["classes"])
        kinds["functions"] = F.when(here, F.concat(*found)).otherwise(kinds["functions"])
        kinds["imports"] = F.when(here, _all(F.col("content"), imp)).otherwise(kinds["imports"])
    return files.withColumn("family", family).withColumns({f"found_{k}": v for k, v in kinds.items()})


def carried_class(lines: DataFrame, class_pattern: str = r"^\s*(?:public\s+|export\s+)?class\s+(\w+)") -> DataFrame:
    """Add ``current_class`` to (file_id, n, line): the last class seen in the file up to the line; a file is one task's window."""
    seen = F.nullif(F.regexp_extract("line", class_pattern, 1), F.lit(""))
    return lines.withColumn("current_class", F.last(seen, ignorenulls=True).over(Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))


def numbered_lines(files: DataFrame) -> DataFrame:
    """``file_id, n, line`` (n from 1) of every line."""
    return files.select("file_id", F.posexplode(T.split_lines(F.col("content"))).alias("p", "line")).select("file_id", (F.col("p") + 1).alias("n"), "line")


#: Symbol patterns of the languages without a parser here, by kind.
SYMBOL_PATTERNS = {
    "javascript": {"class": r"class\s+(\w+)", "interface": r"interface\s+(\w+)", "enum": r"enum\s+(\w+)", "function": r"function\s+(\w+)", "method": r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", "arrow_function_const": r"const\s+(\w+)\s*=\s*(?:async\s*)?\("},
    "typescript": {"class": r"class\s+(\w+)", "interface": r"interface\s+(\w+)", "enum": r"enum\s+(\w+)", "function": r"function\s+(\w+)", "method": r"(?:public|private|protected|readonly)?\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*:"},
    "java": {
        "class": r"(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)", "interface": r"interface\s+(\w+)", "enum": r"enum\s+(\w+)",
        "method": r"(?:public|private|protected)?\s*(?:static|final|abstract)?\s*(?:\w+)\s+(\w+)\s*\([^)]*\)\s*(?:\{|;|\w+)",
    },
    "csharp": {
        "class": r"(?:public|private|protected|internal)?\s*(?:abstract|sealed|static)?\s*class\s+(\w+)", "interface": r"interface\s+(\w+)", "enum": r"enum\s+(\w+)",
        "method": r"(?:public|private|protected|internal)?\s*(?:static|virtual|abstract|override)?\s*(?:\w+)\s+(\w+)\s*\([^)]*\)",
    },
    "go": {"struct": r"type\s+(\w+)\s+struct", "interface": r"type\s+(\w+)\s+interface", "function": r"func\s+(\w+)", "method": r"func\s+\([^)]*\)\s*(\w+)"},
    "rust": {"struct": r"struct\s+(\w+)", "enum": r"enum\s+(\w+)", "trait": r"trait\s+(\w+)", "function": r"fn\s+(\w+)"},
    "cpp": {"class": r"class\s+(\w+)", "struct": r"struct\s+(\w+)", "function": r"(?:\w+[\s*&]+)+(\w+)\s*\([^)]*\)\s*(?:\{|const)"},
    "php": {"class": r"class\s+(\w+)", "interface": r"interface\s+(\w+)", "trait": r"trait\s+(\w+)", "function": r"function\s+(\w+)"},
    "ruby": {"class": r"class\s+(\w+)", "method": r"def\s+(\w+)"},
}
#: The order in which the kinds of a line are taken, and names that are no functions.
CLASS_KINDS = ("class", "struct", "interface", "enum", "trait")
FUNCTION_KINDS = ("function", "method", "arrow_function_const")
NOT_FUNCTIONS = ("if", "while", "for", "switch", "catch")


def line_symbols(files: DataFrame) -> DataFrame:
    """``file_id, name, symbol_type, line, col_offset, class_name`` of files in the languages of ``SYMBOL_PATTERNS``.

    Lines that begin as a comment are left out.  A line may hold one symbol of
    each kind; the last class-like one that was seen owns the methods that
    follow (it is never reset).  Patterns run in the scan stage; only lines
    with a symbol are shuffled, by file, to carry the class on.  Null paths
    and contents and other languages give no rows.
    """
    language = T.language_of_path(F.col("path"))
    lines = files.where(language.isin(*SYMBOL_PATTERNS)).select("file_id", language.alias("language"), F.posexplode(F.split("content", "\n", -1)).alias("p", "text"))
    bare = F.regexp_replace("text", r"^\s+", "")
    code = lines.where(~bare.startswith("//") & ~bare.startswith("#"))

    def found(kind: str) -> Column:
        name = F.lit(None).cast("string")
        for lang, kinds in SYMBOL_PATTERNS.items():
            if kind in kinds:
                name = F.when(F.col("language") == lang, F.nullif(F.regexp_extract("text", kinds[kind], 1), F.lit(""))).otherwise(name)
        return name

    named = code.select("file_id", (F.col("p") + 1).alias("line"), "text", *[found(k).alias(k) for k in (*CLASS_KINDS, *FUNCTION_KINDS)])
    named = named.withColumns({k: F.when(~F.col(k).isin(*NOT_FUNCTIONS), F.col(k)) for k in FUNCTION_KINDS})
    entry = lambda k: F.struct(F.lit(k).alias("kind"), F.col(k).alias("name"), (F.instr("text", F.col(k)) - 1).alias("col_offset"))
    some = F.filter(F.array(*[entry(k) for k in (*CLASS_KINDS, *FUNCTION_KINDS)]), lambda x: x.getField("name").isNotNull())
    owner = F.coalesce(*[F.col(k) for k in reversed(CLASS_KINDS)])
    kept = named.select("file_id", "line", owner.alias("owner"), some.alias("some")).where(F.size("some") > 0)
    owned = kept.withColumn("owner", F.last("owner", ignorenulls=True).over(Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    method = (F.col("s.kind") != "function") & F.col("owner").isNotNull()
    kind = F.when(F.col("s.kind").isin(*CLASS_KINDS), F.col("s.kind")).when(method, "method").otherwise("function")
    each = owned.select("file_id", "line", "owner", F.explode("some").alias("s")).select("file_id", F.col("s.name").alias("name"), kind.alias("symbol_type"), "line", F.col("s.col_offset").alias("col_offset"), "owner")
    return each.select("file_id", "name", "symbol_type", "line", "col_offset", F.when(F.col("symbol_type") == "method", F.col("owner")).alias("class_name"))


def _parsed(text: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    args = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args]
    args += [f"{stars}{a.arg}" for stars, a in (("*", node.args.vararg), ("**", node.args.kwarg)) if a]
    return f"({', '.join(args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def _decorator(node: ast.expr) -> str:
    called = isinstance(node, ast.Call)
    of = node.func if called else node
    return ast.unparse(of) + "()" * called if isinstance(of, (ast.Name, ast.Attribute)) else "<unknown>"


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_symbols_of(text: str | None) -> list[tuple]:
    """(name, kind, line, column, class, parent, decorators, signature, docstring) of a text's classes, functions, methods and what functions assign.

    Functions within functions are not entered, but names assigned in them
    are variables of the outer one, constants where they are in capitals with
    an underscore.  A text that does not parse has none.
    """
    tree = _parsed(text)
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)] if tree else []
    while todo:
        node, owner = todo.pop()
        if isinstance(node, _DEFS):
            out.append((node.name, "method" if owner else "function", node.lineno, node.col_offset, owner, owner, list(map(_decorator, node.decorator_list)), _signature(node), ast.get_docstring(node)))
            for inner in ast.walk(node):
                for name in inner.targets if isinstance(inner, ast.Assign) else ():
                    if isinstance(name, ast.Name):
                        out.append((name.id, "constant" if name.id.isupper() and "_" in name.id else "variable", inner.lineno, inner.col_offset, owner, node.name, [], None, None))
            continue
        if isinstance(node, ast.ClassDef):
            out.append((node.name, "class", node.lineno, node.col_offset, None, None, list(map(_decorator, node.decorator_list)), None, ast.get_docstring(node)))
            owner = node.name
        todo += [(n, owner) for n in reversed(list(ast.iter_child_nodes(node)))]
    return out


_SYMBOLS = pa.schema([("file_id", pa.int64()), ("name", pa.string()), ("symbol_type", pa.string()), ("line", pa.int32()), ("col_offset", pa.int32()), ("class_name", pa.string()), ("parent", pa.string()), ("decorators", pa.list_(pa.string())), ("signature", pa.string()), ("docstring", pa.string())])
_SYMBOLS_DDL = "file_id BIGINT, name STRING, symbol_type STRING, line INT, col_offset INT, class_name STRING, parent STRING, decorators ARRAY<STRING>, signature STRING, docstring STRING"


def _of_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(T.language_of_path(F.col("path")) == language).select(F.col("file_id").cast("long").alias("file_id"), "content")


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of every Python file of (file_id, path, content)."""

    def make():
        return lambda file_id, text: ((file_id, *s) for s in python_symbols_of(text))

    return map_rows(_of_language(files, "python"), ["file_id", "content"], make, _SYMBOLS_DDL, _SYMBOLS)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of all supported languages: Python by its parser, the others by line patterns (without parent, decorators, signature and docstring)."""
    return python_symbols(files).unionByName(line_symbols(files), allowMissingColumns=True)


def symbol_stats(found: DataFrame, files: DataFrame) -> DataFrame:
    """``language, files, symbols`` of every supported language that occurs."""
    named = files.select("file_id", T.language_of_path(F.col("path")).alias("language")).where(F.col("language").isNotNull())
    n = found.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return named.join(n, "file_id", "left").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("symbols"))


#: Names whose calls are calls of the language itself.
BUILTIN_CALLS = frozenset(
    "print len range enumerate zip map filter open input int str list dict set tuple isinstance hasattr getattr setattr super classmethod staticmethod property type id "
    "iter next sum min max abs round divmod pow callable repr dir vars globals locals eval exec compile breakpoint help exit quit".split()
)


def import_names(tree: ast.AST) -> dict[str, str]:
    """What each imported name stands for: alias -> qualified name; the dots of relative imports are kept, stars name nothing."""
    out: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {a.asname or a.name: a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out |= {a.asname or a.name: f"{module}.{a.name}" if module else a.name for a in node.names if a.name != "*"}
    return out


def _dotted(node: ast.expr) -> str | None:
    """The chain of names before a call's attribute; a call counts as what it calls, an index as what it is taken from."""
    parts: list[str] = []
    while isinstance(node, (ast.Attribute, ast.Subscript)):
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        node = node.func
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts)) or None


def resolve_callee(func: ast.expr, caller: str, owner: str | None, imports: dict[str, str]) -> tuple[str, str]:
    """(callee, call type) of a called expression by what its file alone says."""
    if isinstance(func, ast.Name):
        name = func.id
        if name == caller.rpartition(".")[2]:
            return caller, "recursive"
        if name in imports:
            return imports[name], "external"
        if name in BUILTIN_CALLS:
            return f"builtins.{name}", "external"
        return (f"{owner}.{name}", "internal") if owner else (name, "unknown")
    if isinstance(func, ast.Lambda):
        return "<lambda>", "external"
    if not isinstance(func, ast.Attribute):
        return "UNKNOWN", "unknown"
    of = _dotted(func.value)
    if of is None:
        return f"<unknown>.{func.attr}", "unknown"
    if of in ("self", "cls") and owner:
        return f"{owner}.{func.attr}", "internal"
    if of == "super":
        return f"{owner or of}.{func.attr}", "external"
    head, dot, rest = of.partition(".")
    known = imports.get(of) or (imports[head] + dot + rest if dot and head in imports else of)
    return f"{known}.{func.attr}", "external"


def python_calls_of(text: str | None) -> list[tuple]:
    """(caller, callee, call type, line, column, raw call) of calls within classes and functions; [] where the text does not parse.

    The caller is the chain of the classes and functions around the call.
    """
    tree = _parsed(text)
    if tree is None:
        return []
    imports, out = import_names(tree), []
    todo: list[tuple[ast.AST, tuple[str, ...], str | None]] = [(tree, (), None)]
    while todo:
        node, chain, owner = todo.pop()
        if isinstance(node, (*_DEFS, ast.ClassDef)):
            chain = (*chain, node.name)
            owner = node.name if isinstance(node, ast.ClassDef) else owner
        elif isinstance(node, ast.Call) and chain:
            caller = ".".join(chain)
            try:
                raw = ast.unparse(node)
            except RecursionError:
                raw = "<unparseable>"
            out.append((caller, *resolve_callee(node.func, caller, owner, imports), node.lineno, node.col_offset, raw))
        todo += [(n, chain, owner) for n in reversed(list(ast.iter_child_nodes(node)))]
    return out


_CALLS = pa.schema([("file_id", pa.int64()), ("caller", pa.string()), ("callee", pa.string()), ("call_type", pa.string()), ("line", pa.int32()), ("col_offset", pa.int32()), ("raw_call", pa.string())])


def python_calls(files: DataFrame) -> DataFrame:
    """Calls of every Python file of (file_id, path, content)."""

    def make():
        return lambda file_id, text: ((file_id, *c) for c in python_calls_of(text))

    return map_rows(_of_language(files, "python"), ["file_id", "content"], make, "file_id BIGINT, caller STRING, callee STRING, call_type STRING, line INT, col_offset INT, raw_call STRING", _CALLS)


def python_imports(files: DataFrame) -> DataFrame:
    """``file_id, alias, qualified`` of every name that a Python file imports."""

    def make():
        return lambda file_id, text: ((file_id, *pair) for pair in import_names(_parsed(text) or ast.Module([], [])).items())

    return map_rows(_of_language(files, "python"), ["file_id", "content"], make, "file_id BIGINT, alias STRING, qualified STRING", pa.schema([("file_id", pa.int64()), ("alias", pa.string()), ("qualified", pa.string())]))


def call_graph(files: DataFrame, keys: list[str], found: DataFrame | None = None, with_calls: bool = True) -> tuple[DataFrame, DataFrame]:
    """The graph of a collection from its sources: nodes (keys..., full_name, symbol_type, file_id, line) and resolved calls.

    ``files`` holds (keys..., file_id, path, content), keys name one graph (a
    repository).  Names are unique in a graph: of equal ones the definition
    with the greatest file and line stands.  Calls of callers that are no nodes
    are left out; internal ones to what is no node become unknown.
    ``with_calls=False`` gives the nodes and no calls.
    """
    own = files.select(*keys, F.col("file_id").cast("long").alias("file_id"))
    full = F.when(F.col("class_name").isNotNull(), F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))
    every = (symbols(files) if found is None else found).withColumn("full_name", full).join(own, "file_id")
    nodes = every.groupBy(*keys, "full_name").agg(F.max(F.struct("file_id", "line", "symbol_type")).alias("m")).select(*keys, "full_name", "m.symbol_type", "m.file_id", "m.line")
    calls = python_calls(files if with_calls else files.limit(0)).join(own, "file_id")
    return nodes, resolve_calls(calls, nodes, keys)


def resolve_calls(calls: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Calls whose internal callee is no known symbol become unknown (``resolved_type``).

    ``symbols`` holds (keys..., full_name).  Callers that are no symbols are
    left out.
    """
    known = symbols.select(*keys, "full_name").distinct()
    inside = calls.join(known.withColumnRenamed("full_name", "caller"), [*keys, "caller"], "left_semi")
    marked = inside.join(known.select(*keys, F.col("full_name").alias("callee"), F.lit(True).alias("_known")), [*keys, "callee"], "left")
    return marked.withColumn("resolved_type", F.when((F.col("call_type") == "internal") & F.col("_known").isNull(), "unknown").otherwise(F.col("call_type"))).drop("_known")


def _imported(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., src, module``: what each import names, without the words and marks around it."""
    bare = F.regexp_replace(F.regexp_replace("raw", r"^[\s\"';]+|[\s\"';]+$", ""), r"^(?:import|from)\s+", "")
    each = files.select(*keys, F.col("path").alias("src"), F.explode(F.array_distinct("imports")).alias("raw"))
    return each.select(*keys, "src", F.regexp_extract(bare, r"^(\S*)", 1).alias("module")).where("module <> ''").distinct()


def import_edges(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., src, dst`` file edges of imports (path, imports): to the first other file, by path, whose name is the import's last part.

    A name's files are reduced to the first two before they are joined, so
    one that very many files bear costs a row an import.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^./]*$", "")
    first = files.where(F.col("path").isNotNull()).groupBy(*keys, stem.alias("last")).agg(F.min("path").alias("one"))
    second = files.select(*keys, "path", stem.alias("last")).join(first, [*keys, "last"]).where(F.col("path") != F.col("one")).groupBy(*keys, "last").agg(F.min("path").alias("two"))
    heads = first.join(second, [*keys, "last"], "left")
    wanted = _imported(files, keys).withColumn("last", F.element_at(F.split("module", r"[./]|::"), -1))
    dst = F.when(F.col("one") != F.col("src"), F.col("one")).otherwise(F.col("two"))
    return wanted.join(heads, [*keys, "last"]).select(*keys, "src", dst.alias("dst")).where(F.col("dst").isNotNull()).distinct()


def import_edges_by_stem(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., src, dst`` to every other file whose name without extension is the import or what follows one of its dots."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^./]*$", "")
    own = files.where(F.col("path").isNotNull()).select(*keys, F.col("path").alias("dst"), stem.alias("tail")).distinct()
    parts = F.split("module", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wanted = _imported(files, keys).select(*keys, "src", F.explode(F.array_distinct(tails)).alias("tail"))
    return wanted.join(own, [*keys, "tail"]).where("src <> dst").select(*keys, "src", "dst").distinct()


def shared_symbol_files(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., name, file, representative, others`` of names that several files define.

    Files of one name are linked through the first of them by path, with the
    number of other files; they are never paired.
    """
    held = symbols.where(F.col("name").isNotNull() & F.col("file").isNotNull()).select(*keys, "name", "file").distinct()
    per = held.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("representative")).where("n > 1")
    return held.join(per, [*keys, "name"]).select(*keys, "name", "file", "representative", (F.col("n") - 1).alias("others"))


def reference_files(symbols: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., name, path``: the files of the same keys that name a symbol defined elsewhere.

    File contents become distinct identifiers once, which turns the search of
    every symbol in every file into equi-joins; definitions are taken off by
    file and name, so no pair of files is ever built.
    """
    names = F.filter(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w{3,}"), F.lit(0))), lambda x: F.length(x) > 3)
    used = files.where(F.col("content").isNotNull()).select(*keys, "path", F.explode(names).alias("name")).distinct()
    defined = symbols.where(F.length("name") > 3).select(*keys, F.col("file").alias("path"), "name").distinct()
    wanted = defined.select(*keys, "name").distinct()
    return used.join(wanted, [*keys, "name"], "left_semi").join(defined, [*keys, "path", "name"], "left_anti").select(*keys, "name", "path")


def symbol_references(symbols: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., name, n_files``: in how many other files of the same keys a defined symbol is named."""
    return reference_files(symbols, files, keys).groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n_files"))


def import_edges_by_part(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., src, dst`` where any dotted part of an import is the base name of a file (the loose variant)."""
    own = files.select(*keys, F.col("path").alias("dst"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^./]*$", "").alias("part")).distinct()
    parts = files.select(*keys, F.col("path").alias("src"), F.explode(F.array_distinct("imports")).alias("raw")).select(*keys, "src", F.explode(F.array_distinct(F.split("raw", r"[./:@\s\"';]+"))).alias("part"))
    return parts.where("part <> ''").distinct().join(own, [*keys, "part"]).where("src <> dst").select(*keys, "src", "dst").distinct()


def migration_ends(ordered: DataFrame, within: list[str], n: int = 5) -> DataFrame:
    """The first and last ``n`` nodes of a topological order (within..., node, level), by level and name (a report)."""
    known = ordered.where("level IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(*within).orderBy("level", "node"))
    last = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("level"), F.desc("node")))
    a = known.withColumn("rank", first).where(F.col("rank") <= n).withColumn("end", F.lit("first"))
    b = known.withColumn("rank", last).where(F.col("rank") <= n).withColumn("end", F.lit("last"))
    return a.unionByName(b)
