"""Template residue, filler, error pages and scripts-required notices (problem 9).

Method: delimiter-specific grammars for unfilled slots, and regular
expressions for filler and notices.  Context and density decide: fenced,
indented and inline code is taken out first (there a slot is an explanation),
a slot in quotes or in a sentence about slots counts only where slots are
dense, and a notice or filler sentence only where such sentences make up most
of the text.  One narrow Arrow stage over whole texts, no shuffle.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstone.functions.arrowmap import map_rows
from seamstone.llm.trigram import Need, TrigramCodes, all_of, any_of, required, trigrams_in

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+){0,5}"
#: One grammar for each kind of delimiter.
SLOT_GRAMMARS = {
    "double_brace": r"\{\{\{?[-~#&]?\s*" + _NAME + r"(?:\s*\|\s*\w+)*\s*[-~]?\}?\}\}",
    "shell": r"\$\{\s*(?!HOME\b|PATH\b|PWD\b|USER\b|SHELL\b|TMPDIR\b)" + _NAME + r"\s*(?::?-[^}\n]{0,20})?\}",
    "percent_tag": r"<%[=\-]?\s*" + _NAME + r"\s*-?%>",
    "block_tag": r"\{%-?\s*" + _NAME + r"\s*-?%\}",
    "double_bracket": r"\[\[\s*" + _NAME + r"\s*\]\]",
    "double_angle": r"<<\s*" + _NAME + r"\s*>>",
    "double_at": r"@@\s*" + _NAME + r"\s*@@",
    "dunder": r"(?<![\w`])__(?!FILE__|LINE__|DATE__|TIME__|VA_ARGS__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    "format": r"%\(\s*" + _NAME + r"\s*\)[sdrfi]",
    "percent": r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%(?!\w)",
    "dollar": r"(?<![\w$])\$[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\$(?![\w$])",
    "hash_brace": r"#\{\s*" + _NAME + r"\s*\}",
    "insert": r"\[\s*(?i:insert|enter|add|your|fill in|replace|put|name of|type)\b[^\]\n]{1,50}\]",
    "your": r"<\s*(?i:your|insert|enter|my)[ _\-][A-Za-z0-9 _\-]{1,50}>",
    "to_do": r"\[(?:TBD|TODO|TBA|XXX+|PLACEHOLDER|FIXME)(?::[^\]\n]{0,40})?\]|<(?:TBD|TODO|TBA|PLACEHOLDER)>",
}
_SLOT = re.compile("|".join(f"(?:{g})" for g in SLOT_GRAMMARS.values()))
#: A text without one of these has no slot.
_SLOT_HINT = re.compile(r"\$[A-Z]|\{\{|\$\{|<%|\{%|\[\[|<<|@@|__[A-Z]|%\(|%[A-Z]|#\{|\[\s*[A-Za-z]|<\s*[A-Za-z]")

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<(pre|code)\b[^>]*>.*?</\1>", re.S | re.I)
_INLINE = re.compile(r"(`+)(?!`)[^\n]+?(?<!`)\1(?!`)")
_INDENTED = re.compile(r"^(?:    |\t).*$", re.M)

#: Words of the usual filler text, beside the two of its name.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute "
    "irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non "
    "proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Those of them that are no words of living languages; a filler sentence holds one.
LATIN_MARKS = ("lorem", "ipsum", "amet", "consect", "adipisc", "eiusmod", "incididunt", "labor", "magna", "aliqu", "veniam", "nostrud", "exercitation", "ullamco", "irure", "reprehenderit", "voluptate", "cillum", "fugiat", "pariatur", "excepteur", "occaecat", "cupidatat", "proident", "officia", "deserunt", "mollit")
#: Sentences that stand where content should be.
FILLER = (
    r"lorem ipsum",
    r"(?:text|content|description|copy|title|summary) (?:goes|will go|comes|here) here|(?:text|content) here\b",
    r"^(?:blah[ ,.]*)+$",
    r"(?:dummy|placeholder|sample|filler|example) (?:content|text|paragraph|copy)\b.{0,40}",
    r"^(?:add|insert|write|enter|put) (?:your|a|the|some) (?:own )?(?:description|text|content|title|summary)\b.{0,20}",
    r"^replace (?:this|me|with)\b.{0,40}",
    r"(?:ornek|örnek) (?:metin|icerik|içerik)|metin (?:buraya )?gelecek|buraya (?:metin|yazi|yazı)",
    r"blindtext|platzhalter(?:text)?|beispieltext|hier (?:kommt|steht) (?:der |ein )?text|fülltext|fuelltext",
    r"^(?:asdf|qwerty|foo bar|test)(?:[ ,.]*(?:asdf|qwerty|foo|bar|baz|test))*$",
    r"^(?:this is )?(?:just )?(?:a )?(?:placeholder|dummy|test text)$",
    r"^(?:title|heading|headline|subtitle|baslik|überschrift|ueberschrift|untitled)(?: here)?$",
    r"^(?:to be (?:written|done|completed|announced)|coming soon|tbd|tba|todo|yazilacak|folgt)$",
)
_STATUS = r"(?:bad request|unauthorized|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
#: Sentences of error pages.
ERRORS = (
    rf"^(?:http )?(?:error |hata |fehler )?(?:[45]\d\d)?[ :\-–]*{_STATUS}\b.{{0,20}}$",
    rf"\"(?:message|error|title|detail)\": *\"{_STATUS}",
    r"^(?:error|fehler|hata|http error) ?[:#]? ?[45]\d\d\b",
    r"\((?:http )?(?:code|error|status|hata kodu)?:? ?[45]\d\d\)",
    r"too many requests|rate limit (?:reached|exceeded)|retry after \d+|slow down and reload",
    r"upstream (?:connect error|[\w ]{1,30} did not answer)|connection (?:refused|reset|timed out)|reset reason",
    r"(?:something|etwas|bir seyler|bir şeyler) (?:went wrong|ist schiefgelaufen|ters gitti)|^oops",
    r"(?:session|sitzung|oturum\w*) (?:has |ist )?(?:expired|abgelaufen|sona erdi)|sign in (?:again|with another account)",
    r"(?:do not|don't) have permission|access (?:is )?denied|erisim engellendi|erişim engellendi|zugriff verweigert",
    r"(?:page|document|file|resource|repository) (?:you (?:asked|requested|are looking) for )?(?:\w+ ){0,3}(?:could not be (?:shown|found|displayed)|(?:has been|was) (?:moved|deleted|removed)|does not exist|cannot be found|is not available)",
    r"return to the (?:start|home) ?page|go (?:back )?to the home ?page",
    r"under maintenance|be back (?:shortly|soon)|wartungsarbeiten|bakim (?:calismasi|asamasinda)|bakımda",
    r"not available in your (?:region|country)",
    r"sayfa (?:bulunamadi|bulunamadı)|adresi kontrol edin|seite (?:ist )?nicht (?:erreichbar|gefunden)|spaeter erneut versuchen|später erneut versuchen",
    r"(?:please )?go back(?: or|$)|try again in (?:a few|some|\d+) (?:minutes|seconds)",
    r"server (?:could not complete|encountered|is overloaded)|try again later",
    r"^(?:reference|request id|request|ray id|incident|referenz|istek)[ :#]+[0-9a-f\-]{6,}",
    r"^\w+ at [\w.\-]+ port \d+",
)
#: Notices that scripts are required.
NOTICES = (
    r"(?:enable|activate|turn on|allow|require\w*|needs?|without) (?:java ?script|scripts?|scripting|cookies)",
    r"(?:java ?script|scripts?|scripting) (?:is|are|must be|has to be|have to be) (?:required|disabled|blocked|off|on|enabled|turned|needed|necessary|not)",
    r"turn (?:java ?script|scripts) on|allow scripts",
    r"java ?script (?:gereklidir|gerekli|benoetigt|benötigt|etkinle\w*|aktivieren|erforderlich)|(?:benoetigt|benötigt|erfordert) java ?script|skripte? (?:erlauben|aktivieren)|^lutfen etkinlestirin|^lütfen etkinleştirin",
    r"browser (?:does not|doesn't) support|checking your browser|cannot be displayed without (?:them|java ?script|scripts)",
    r"<noscript>",
    r"takes a few seconds",
)
#: Page furniture that is no content of its own.
CHROME = (
    r"skip to (?:main )?content",
    r"(?:menu|home|search|help|files|issues|sign in|log ?in|login|about|contact|anasayfa|startseite|suche|hilfe)(?:[ |·/>•\-]+(?:menu|home|search|help|files|issues|pulls|wiki|sign in|sign up|log ?in|about|contact|settings|ara|yardim|suche|hilfe))*",
)
#: What a longer sentence says that talks about such pages instead of being one.
TALK = r"\b(?:also|still|even) works?\b|\bbecause\b|\bso that\b|\bif you see\b|\bwe (?:replaced|removed|changed|fixed|added|renamed|moved|log|show|return)\b|\b(?:error|status) (?:page|code) of\b|\bpreview\b"
_TALK_WORDS = 8
_TALK = re.compile(TALK)
# sentences are put in lower case first: matching without regard to case is several times slower
_KINDS = {"filler": FILLER, "error": ERRORS, "notice": NOTICES}


def _ascii(need: Need) -> Need:
    """A requirement without trigrams outside ASCII."""
    if need is None or isinstance(need, str):
        return need if need and need.isascii() else None
    return (all_of if need[0] == "and" else any_of)(_ascii(part) for part in need[1])


#: Every pattern with the trigrams it requires: only those a text holds the trigrams of are searched in it.
_PATTERNS = [(kind, part, _ascii(required(part))) for kind, parts in _KINDS.items() for part in parts]
_CODES = TrigramCodes(set().union(*(trigrams_in(need) for _, _, need in _PATTERNS)))


def _masks(need: Need) -> list[int]:
    """Bit sets of trigrams of which a text has to hold one whole; where several choices are required the smallest is kept."""
    if need is None:
        return [0]
    if isinstance(need, str):
        return [1 << _CODES.trigrams.index(need)]
    each = [_masks(part) for part in need[1]]
    if need[0] == "or":
        return [m for one in each for m in one]
    sure = functools.reduce(int.__or__, (one[0] for one in each if len(one) == 1), 0)
    choice = min((one for one in each if len(one) > 1), key=len, default=[0])
    return [sure | m for m in choice]


_MASKS = [(k, _masks(need)) for k, (_, _, need) in enumerate(_PATTERNS)]


def _searches(low: str) -> dict[str, re.Pattern]:
    """By kind one pattern of the parts that a text can match by its trigrams."""
    held = sum(1 << k for k in _CODES.of(low))
    return _patterns(tuple(k for k, masks in _MASKS if any(held & m == m for m in masks)))


@functools.lru_cache(maxsize=4_096)
def _patterns(numbers: tuple[int, ...]) -> dict[str, re.Pattern]:
    parts: dict[str, list[str]] = {}
    for k in numbers:
        parts.setdefault(_PATTERNS[k][0], []).append(_PATTERNS[k][1])
    return {kind: _joined(tuple(some)) for kind, some in parts.items()}


@functools.lru_cache(maxsize=4_096)
def _joined(parts: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in parts))


_CHROME = re.compile("(?:" + "|".join(CHROME) + ")")
_TAG = re.compile(r"<(?!noscript)/?[a-zA-Z!][^<>]{0,200}>")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"\w+")


def prose_of(text: str) -> str:
    """The text with fenced, preformatted, indented and inline code blanked."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<pre" in text or "<code" in text:
        text = _PRE.sub(" ", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    if "    " in text or "\t" in text:
        text = _INDENTED.sub("", text)
    return text


#: What a sentence says that explains slots instead of leaving one unfilled.
EXPLAINS = r"placeholders?\b|(?:template|merge|interpolation) (?:variables?|fields?|syntax|tags?|slots?|engine)|slots? (?:like|such as|are|is)\b|(?:is|are|gets?|be) (?:replaced|substituted|expanded|interpolated|filled in)|stands? for\b|expands? to\b|(?:variable|slot|tag|token|marker|syntax|notation)s? (?:like|such as|named|called)\b|platzhalter|wird (?:durch|ersetzt)|werden ersetzt|yer tutucu|ile degistirilir|ile değiştirilir"
_EXPLAINS = re.compile(EXPLAINS, re.I)
_OPENING, _CLOSING = "\"'\u201c\u2018\u201e\u00ab", "\"'\u201d\u2019\u201c\u00bb"
#: Words a slot in a text that only explains slots; a text with more of them is a template all the same.
_WORDS_A_SLOT = 12
_BREAK = re.compile(r"[.!?](?=\s)|\n")


def slots_in(text: str) -> list[str]:
    """Unfilled slots in the prose of a text: those that no quotes and no sentence explain, or all where they are dense."""
    if not _SLOT_HINT.search(text):
        return []
    prose = prose_of(text)
    every, open_ = [], []
    for m in _SLOT.finditer(prose):
        every.append(m[0])
        quoted = prose[m.start() - 1 : m.start()] in tuple(_OPENING) and prose[m.end() : m.end() + 1] in tuple(_CLOSING)
        if not quoted:
            begin = 0
            for stop in _BREAK.finditer(prose, max(0, m.start() - 1_000), m.start()):
                begin = stop.end()
            stop = _BREAK.search(prose, m.end())
            quoted = bool(_EXPLAINS.search(prose[max(begin, m.start() - 1_000) : m.start()] + " " + prose[m.end() : stop.start() if stop else None]))
        if not quoted:
            open_.append(m[0])
    if open_ or not every:
        return open_
    return every if len(every) * _WORDS_A_SLOT >= len(_WORD.findall(prose)) else []


def _mostly_filler(found: re.Pattern, plain: str, n_words: int) -> bool:
    """Whether filler phrases make up a third of a sentence's words or more."""
    return 3 * sum(len(_WORD.findall(m[0])) for m in found.finditer(plain)) >= n_words


_NOTHING = {"filler": 0.0, "error": 0.0, "notice": 0.0}


def shares(text: str) -> dict[str, float]:
    """Share of words in filler, error and notice sentences, page furniture left out."""
    low = _TAG.sub("\n", text).lower()
    search = _searches(low)
    latin_text = any(w in low for w in LATIN_MARKS)
    if not search and not latin_text:
        return _NOTHING
    filler, error, notice = search.get("filler"), search.get("error"), search.get("notice")
    weight: Counter[str] = Counter()
    for sentence in _SENTENCE.split(low):
        sentence = sentence.strip().lstrip("#").strip(" \t*-=|>")
        words = _WORD.findall(sentence)
        if not words or _CHROME.fullmatch(sentence):
            continue
        plain = sentence.rstrip(".!?: ")
        latin = sum(map(LATIN_FILLER.__contains__, words)) if latin_text else 0
        kind = "content"
        if latin >= 3 and 2 * latin >= len(words) and any(w in plain for w in LATIN_MARKS):
            kind = "filler"
        elif filler and filler.search(plain) and _mostly_filler(filler, plain, len(words)):
            kind = "filler"
        elif notice and notice.search(plain):
            kind = "notice"
        elif error and error.search(plain):
            kind = "error"
        if kind != "content" and latin < 3 and len(words) >= _TALK_WORDS and _TALK.search(plain):
            kind = "content"
        weight[kind] += len(words)
    total = sum(weight.values())
    return {k: weight[k] / total for k in _NOTHING} if total else _NOTHING


def residue_of(text: str | None, min_share: float = 0.5) -> tuple[int, float, float, float, str | None]:
    """(slots, filler share, error share, notice share, kind of residue or None) of a text."""
    if not text or text.isspace():
        return 0, 0.0, 0.0, 0.0, None
    slots = len(slots_in(text))
    s = shares(text)
    kind = None
    if s["filler"] >= min_share:
        kind = "filler"
    elif s["error"] + s["notice"] >= min_share:
        kind = "error" if s["error"] >= s["notice"] else "notice"
    elif slots:
        kind = "slot"
    return slots, s["filler"], s["error"], s["notice"], kind


_FIELDS = "n_slots INT, filler_share DOUBLE, error_share DOUBLE, notice_share DOUBLE, kind STRING"


def text_residue(df: DataFrame, id_col: str, text_col: str, min_share: float = 0.5) -> DataFrame:
    """``id_col, n_slots, filler_share, error_share, notice_share, kind`` of every row.

    ``kind`` is slot, filler, error, notice or null (the text is kept).  Null,
    empty and blank texts have null kind; repeated rows are rated each; other
    columns are ignored; texts are read whole.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(id_type)), ("n_slots", pa.int32()), ("filler_share", pa.float64()), ("error_share", pa.float64()), ("notice_share", pa.float64()), ("kind", pa.string())])

    def make():
        return lambda rec_id, text: ((rec_id, *residue_of(text, min_share)),)

    return map_rows(df, [id_col, text_col], make, f"`{id_col}` {id_type.simpleString()}, {_FIELDS}", arrow)


def without_residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose text is content (``id_col`` must be unique)."""
    bad = text_residue(df, id_col, text_col).where(F.col("kind").isNotNull()).select(id_col)
    return df.join(bad, id_col, "left_anti")
