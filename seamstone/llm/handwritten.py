"""Generated, minified, vendored and data files among source files (problem 4).

Method: thresholds on layout statistics (longest and mean line, share of
white space and of letters and digits, density of numeric literals, long
encoded runs), tuned per language: ``fit_limits`` takes them from a bounded
sample of labelled files.  Layout decides first.  It cannot tell a tool's
output or a third-party copy that is laid out like hand-written code, so
direct evidence follows: marker comments, banners and file locations;
``evidence`` says what decided.  Strings that only mention a marker are no
evidence.  One narrow Arrow stage over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstone.functions.arrowmap import map_rows


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language.

    ``few_numbers`` and ``few_encoded`` are what a hand-written file may hold
    of constants and of encoded characters whatever their share is.
    """

    packed_max_line: int = 500
    packed_mean_line: float = 160.0
    packed_space: float = 0.07
    few_numbers: int = 40
    number_density: float = 0.28
    number_share: float = 0.14
    few_encoded: int = 240
    encoded_share: float = 0.62
    encoded_alnum: float = 0.60
    literal_lines: float = 0.85
    literal_min_lines: int = 60


_PLAIN = Limits()
#: Languages that are bundled and packed for browsers.
_SCRIPT = Limits(packed_max_line=300, packed_mean_line=110.0, packed_space=0.085)
#: Languages written with many numbers and short lines of values.
_NATIVE = Limits(number_density=0.40, number_share=0.20)
#: Limits by extension, as ``fit_limits`` gives them (rounded) where its sample holds such files.
LIMITS = {
    **dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "tsx"), _SCRIPT), "css": replace(_SCRIPT, number_density=0.60, number_share=0.30), "json": replace(_PLAIN, packed_mean_line=1e9, number_share=0.18),
    **dict.fromkeys(("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "go"), _NATIVE), **dict.fromkeys(("py", "pyw", "pyi", "rb"), replace(_PLAIN, literal_lines=0.80)), **dict.fromkeys(("java", "cs", "rs", "php"), replace(_PLAIN, number_density=0.35)),
}

#: Folders of third-party copies, and of tool output.
VENDOR_DIRS = ("third_party", "third-party", "thirdparty", "3rdparty", "vendor", "node_modules", "bower_components", "external", "externals", "Godeps", "site-packages", "Pods")
OUTPUT_DIRS = ("generated", "__generated__", "gen", "autogen", "codegen")
#: File names that tools give.
OUTPUT_NAMES = r"(?:_pb2(?:_grpc)?\.py|\.pb\.(?:go|cc|h|hpp|cpp)|\.g\.(?:dart|cs|ts)|\.designer\.cs|\.generated\.\w+|_generated\.\w+|\.min\.(?:js|css)|\.bundle\.js|[\-.]bundle\.min\.js)$|(?:^|/)(?:moc_|ui_|qrc_)\w+\.(?:cpp|cc|h|hpp|py)$"
_VENDOR_PATH = re.compile(r"(?:^|/)(?:" + "|".join(map(re.escape, VENDOR_DIRS)) + r")/")
_OUTPUT_PATH = re.compile(r"(?:^|/)(?:" + "|".join(map(re.escape, OUTPUT_DIRS)) + r")/|" + OUTPUT_NAMES)

_COMMENT = r"^[ \t]*(?:/\*+!?|//+!?|#+|\*|--|;+|<!--|%+)[ \t]*"
#: What marker comments say.
MARKERS = (
    r"code generated by\b.{0,80}\bdo not (?:edit|modify)",
    r"(?:auto-?generated|automatically generated|generated) (?:file|code|by|from)\b.{0,80}(?:do not (?:edit|modify|change)|don't edit|run `|regenerate|changes will be (?:lost|overwritten))",
    r"auto-?generated file\b",
    r"this (?:file|code) (?:was|is|has been) (?:auto-?|automatically )?(?:produced|generated|created|written) (?:by|from|with|out of)\b",
    r"do not (?:edit|modify)\b.{0,40}\b(?:auto-?generated|generated (?:by|from|file))",
    r"<auto-?generated\b",
    r"@generated\b",
    r"machine[- ](?:written|generated|made) (?:from|by)\b",
    r"otomatik (?:olarak )?(?:uretil|üretil|olustur|oluştur)",
    r"automatisch (?:erzeugt|generiert|erstellt) (?:von|aus|mit)\b",
)
_MARKER = re.compile(_COMMENT + "(?:" + "|".join(MARKERS) + ")", re.I | re.M)
#: A text without one of these (in lower case) has no marker.
_MARKER_HINTS = ("generated", "do not edit", "do not modify", "machine-", "machine ", "automatisch", "otomatik", *(f"{verb} {how}" for verb in ("produced", "created", "written") for how in ("by", "from", "with", "out")))
#: What banners of third-party copies say.
BANNERS = (
    r"bundled third[- ]party (?:library|code|copy)",
    r"(?:third[- ]party|upstream|vendored) (?:copy|library) (?:of|from|:)",
    r".{0,80}\b(?:copied|taken|vendored|imported) (?:unmodified |unchanged |verbatim )?from (?:the )?upstream\b",
    r"released by the .{1,60} (?:project|team|authors)\b.{0,80}\bupstream copy",
    r"vendored (?:copy|from|library)\b",
    r"local patch \d",
)
_BANNER = re.compile(_COMMENT + "(?:" + "|".join(BANNERS) + ")", re.I | re.M)
_BANNER_HINTS = ("third party", "third-party", "upstream", "vendored", "local patch")

_NUMBER = re.compile(r"(?<![\w.])(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?!\w)")
_ENCODED = re.compile(r"[A-Za-z0-9+/=]{40,}")
_LITERAL = r"(?:[bru]?\"[^\"\n]*\"|[bru]?'[^'\n]*'|[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*)"
_LITERAL_LINE = re.compile(rf"^[ \t]*{_LITERAL}(?:[ \t]*,[ \t]*{_LITERAL})*[ \t]*,?[ \t]*\r?$", re.M)
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
_WORDS = re.compile(r"\w+")
_NOT_ALNUM = re.compile(r"[^A-Za-z0-9]+")


def layout(text: str) -> tuple[int, int, float, float, float, float, float, float, float]:
    """(lines, longest line, mean line, space, letters and digits, numbers a word, characters in numbers, in encoded runs, lines of literals only).

    Key blocks are left out of the lines and of the encoded runs.
    """
    return measured(text)[0]


def measured(text: str) -> tuple[tuple, int, int]:
    """(layout, numbers, characters in encoded runs) of a text."""
    plain = _KEY_BLOCK.sub(" ", text) if "-----BEGIN " in text else text
    lines = plain.splitlines() or [""]
    n = max(1, len(text))
    numbers = _NUMBER.findall(text)
    words = len(_WORDS.findall(text))
    encoded = sum(map(len, _ENCODED.findall(plain)))
    stats = (
        len(lines),
        max(map(len, lines)),
        len(plain) / len(lines),
        1 - len("".join(text.split())) / n,
        len(_NOT_ALNUM.sub("", text)) / n,
        len(numbers) / max(1, words),
        sum(map(len, numbers)) / n,
        encoded / n,
        sum(1 for _ in _LITERAL_LINE.finditer(plain)) / len(lines),
    )
    return stats, len(numbers), encoded


def _in_literal(text: str, at: int, ext: str) -> bool:
    """Whether a place lies in a string of several lines."""
    quotes = ('"""', "'''") if ext == "py" else ("`",) if ext in ("js", "jsx", "ts", "tsx", "go") else ()
    return any(text.count(q, 0, at) % 2 for q in quotes)


def layout_kind(stats: tuple, n_numbers: int, n_encoded: int, limits: Limits) -> str | None:
    """minified, data or None by the statistics alone."""
    n_lines, longest, mean, space, alnum, density, number_share, encoded, literal = stats
    if longest >= limits.packed_max_line and mean >= limits.packed_mean_line and space <= limits.packed_space and encoded < limits.encoded_share:
        return "minified"
    numbers = n_numbers > limits.few_numbers and density >= limits.number_density and number_share >= limits.number_share
    runs = n_encoded > limits.few_encoded and encoded >= limits.encoded_share and alnum > limits.encoded_alnum
    return "data" if numbers or runs or (n_lines >= limits.literal_min_lines and literal >= limits.literal_lines) else None


def rate(path: str | None, content: str | None, limits: dict[str, Limits] = LIMITS) -> tuple:
    """(kind or None, evidence, *layout) of a file; kind is generated, vendored, minified or data."""
    text, where = content or "", path or ""
    ext = where.rpartition(".")[2].lower() if "." in where else ""
    stats, n_numbers, n_encoded = measured(text)
    kind = layout_kind(stats, n_numbers, n_encoded, limits.get(ext, _PLAIN))
    if kind:
        return (kind, "layout", *stats)
    low = text.lower()
    if any(h in low for h in _BANNER_HINTS) and any(not _in_literal(text, m.start(), ext) for m in _BANNER.finditer(text)):
        return ("vendored", "banner", *stats)
    if any(h in low for h in _MARKER_HINTS) and any(not _in_literal(text, m.start(), ext) for m in _MARKER.finditer(text)):
        return ("generated", "marker", *stats)
    if _VENDOR_PATH.search(where):
        return ("vendored", "location", *stats)
    if _OUTPUT_PATH.search(where):
        return ("generated", "location", *stats)
    return (None, None, *stats)


_NUMBERS = ("mean_line", "space_share", "alnum_share", "number_density", "number_share", "encoded_share", "literal_lines")
_FIELDS = "kind STRING, evidence STRING, n_lines INT, max_line INT, " + ", ".join(f"{c} DOUBLE" for c in _NUMBERS)


def rate_files(files: DataFrame, limits: dict[str, Limits] = LIMITS) -> DataFrame:
    """``file_id, kind, evidence`` and the layout statistics of every row of files (file_id, path, content).

    ``kind`` is null for hand-written files; ``evidence`` is layout, banner,
    marker or location, in this order.  A null or empty content is rated by
    its path alone, a null path by its content alone; repeated rows are rated
    each; files are read whole; other columns are ignored.
    """
    arrow = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("evidence", pa.string()), ("n_lines", pa.int32()), ("max_line", pa.int32())] + [(c, pa.float64()) for c in _NUMBERS])

    def make():
        return lambda file_id, path, content: ((file_id, *rate(path, content, limits)),)

    return map_rows(files.withColumn("file_id", F.col("file_id").cast("long")), ["file_id", "path", "content"], make, "file_id BIGINT, " + _FIELDS, arrow)


def not_handwritten(files: DataFrame) -> DataFrame:
    """The rated files that are not hand-written."""
    return rate_files(files).where(F.col("kind").isNotNull())


def fit_limits(labelled: DataFrame, most: int = 20_000, start: dict[str, Limits] = LIMITS) -> dict[str, Limits]:
    """Limits by extension from labelled files (path, content, label: minified, data, or null where hand-written).

    Each threshold is put half way between the hand-written files' 99.9th
    percentile and the labelled kind's 1st where the two are apart; else it
    stays as in ``start``.  At most ``most`` files (those of the smallest
    hashes) are fitted on; rating covers all files.
    """
    some = labelled.where(F.col("content").isNotNull()).orderBy(F.xxhash64("path", "content")).limit(most).select("path", "content", "label")
    arrow = pa.schema([("ext", pa.string()), ("label", pa.string()), ("max_line", pa.float64())] + [(c, pa.float64()) for c in _NUMBERS])

    def make():
        def call(path, content, label):
            stats, _, _ = measured(content)
            yield ((path or "").rpartition(".")[2].lower(), label, float(stats[1]), *stats[2:])

        return call

    rows = map_rows(some, ["path", "content", "label"], make, "ext STRING, label STRING, max_line DOUBLE, " + ", ".join(f"{c} DOUBLE" for c in _NUMBERS), arrow).toPandas()
    out = dict(start)
    for ext, mine in rows.groupby("ext"):
        plain, made = mine[mine["label"].isna()], out.get(ext, _PLAIN)
        if plain.empty:
            continue

        def between(label: str, stat: str, low: bool = False) -> float | None:
            found = mine[mine["label"] == label][stat]
            if found.empty:
                return None
            a, b = (plain[stat].quantile(0.001), found.quantile(0.99)) if low else (plain[stat].quantile(0.999), found.quantile(0.01))
            return (a + b) / 2 if (b < a if low else a < b) else None

        for field, value in {
            "packed_max_line": between("minified", "max_line"), "packed_mean_line": between("minified", "mean_line"), "packed_space": between("minified", "space_share", low=True),
            "number_density": between("data", "number_density"), "number_share": between("data", "number_share"), "encoded_share": between("data", "encoded_share"), "literal_lines": between("data", "literal_lines"),
        }.items():
            if value is not None:
                made = replace(made, **{field: type(getattr(_PLAIN, field))(value)})
        out[ext] = made
    return out
