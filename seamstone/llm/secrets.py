"""Credentials in source files and scan reports (problem 5).

Method: a trigram index over file chunks.  Each rule's required trigrams are
derived from its regex; the posting lists of a block of chunks are
intersected, and the regex runs on the candidate chunks only.  An exact look
at the value follows (placeholders, references, addresses without a password,
names that only talk about secrets).

Files are cut into overlapping chunks of lines.  The index of a block of
chunks is built from the trigrams of each chunk, used and dropped within one
narrow stage, and nothing is shuffled.  Configuration files (told by their
path) have rules of their own for values without quotes.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstone.llm.trigram import Postings, TrigramCodes, bits, required, trigrams_in

#: Characters of a chunk, and of its overlap with the next one.  Longer lines are chunks of their own.
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 1_024
#: Chunks indexed at once.
BLOCK_CHUNKS = 256


@dataclass(frozen=True)
class Rule:
    """``group`` 1 of the regex is the value; ``check`` names the test it must pass."""

    label: str
    pattern: str
    check: str
    flags: int = 0
    #: whether the rule is for configuration files only
    config: bool = False


#: What words in a name make its value a secret ...
SECRET_NAME = r"(?:pass(?:word|wd|phrase)?|passwort|pwd|pw|secret|token|api_?key|apikey|access_?key|auth_?key|private_?key|signing_?key|encryption_?key|master_?key|client_?key|service_?key|secret_?key|account_?key|license_?key|credentials?|creds?|parola|sifre|kennwort|bearer|auth)"
#: ... and which make it talk about one only.
_ABOUT = re.compile(r"(?i)(?:hint|field|label|path|file|dir|name|user|template|pattern|regex|policy|length|len|count|type|kind|url|uri|host|header|prefix|suffix|format|min|max|ttl|expir\w*|public|hash|digest|checksum|fingerprint|placeholder|example|env|var|limit|index|version|mask\w*|title|message|text|prompt|error|id)$|public|hint")

#: Shapes of issued credentials, by issuer-independent prefix forms.
RULES = (
    Rule("private_key", r"(-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----)", "key_block"),
    Rule("cloud_key_id", r"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Za-z0-9])", "issued"),
    Rule("cloud_key_id", r"(?<![A-Za-z0-9])(ASIA[A-Z0-9]{16})(?![A-Za-z0-9])", "issued"),
    Rule("repo_token", r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{30,})(?![A-Za-z0-9])", "issued"),
    Rule("repo_token", r"(?<![A-Za-z0-9_])(github_pat_[A-Za-z0-9_]{30,})(?![A-Za-z0-9])", "issued"),
    Rule("repo_token", r"(?<![A-Za-z0-9_])(glpat-[A-Za-z0-9_\-]{20,})", "issued"),
    Rule("package_token", r"(?<![A-Za-z0-9_])((?:npm_|pypi-|shpat_|dop_v1_)[A-Za-z0-9_\-]{30,})", "issued"),
    Rule("chat_token", r"(?<![A-Za-z0-9_])(xox[abeoprs]-[A-Za-z0-9\-]{15,})", "issued"),
    Rule("payment_key", r"(?<![A-Za-z0-9_])([sr]k_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])", "issued"),
    # any issuer: a short word or two and an underscore before a random part
    Rule("prefixed_token", r"(_[A-Za-z0-9]{16,})(?![A-Za-z0-9_])", "prefixed"),
    Rule("cloud_key", r"(?<![A-Za-z0-9_])(AIza[A-Za-z0-9_\-]{35})(?![A-Za-z0-9_\-])", "issued"),
    Rule("session_jwt", r"(?<![A-Za-z0-9_])(eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{20,})", "issued"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s:/@\"'`<>{}]*:([^\s@/\"'`]+)@[A-Za-z0-9\[]", "password"),
    Rule("basic_header", r"authorization[\"']?\s*[:=,]\s*[\"']?basic\s+([A-Za-z0-9+/=_\-]{8,})", "basic", re.I),
    Rule("bearer_header", r"authorization[\"']?\s*[:=,]\s*[\"']?(?:bearer|token)\s+([^\s\"'`]{8,})", "token", re.I),
    Rule("key_header", r"(?:x-)?(?:api-key|auth-token|access-token|amz-security-token)[\"']?\s*[:=,]\s*[\"']?([^\s\"'`]{8,})", "token", re.I),
    *(
        Rule("named_value", rf"(?<![A-Za-z0-9])((?:[A-Za-z0-9_\-]*?)?{word}[A-Za-z0-9_\-]*[\"'`]?\]?(?:[ \t]*:[ \t]*[&\w<>\[\]\*:?' ]{{1,30}}?)?[ \t]*(?::=|=>|=|:)(?!=)[ \t]*(?:\(\s*|\[\s*|\\\n\s*|\n\s*)?(?:[bruf@]|new String\()?[\"'`][^\"'`\n]{{6,}}[\"'`])", "named", re.I)
        for word in ("pass", "pwd", "secret", "token", "api_?key", "access_?key", "private_?key", "signing_?key", "encryption_?key", "auth", "cred", "parola", "sifre", "kennwort", "bearer", "master_?key", "service_?key", "client_?key", "account_?key")
    ),
    Rule("named_value", r"(?<![A-Za-z0-9])((?:pw\": ?|pw': ?|pw = ?|pw=|pw:=? ?|pw := )[ \t]*[\"'`][^\"'`\n]{6,}[\"'`])", "named", re.I),
    *(
        Rule("comment", rf"(?:^|[^\S\n]|/)(?:#|//|/\*|\*|--|;|<!--)[^\n]*?(?<![A-Za-z]){word}(?:(?<![A-Za-z])|(?![A-Za-z]))[^\n]*?[ :=]([^\s:=\"'`<>(),]{{8,}})(?=[ \t.,;)]*(?:\*/|-->)?[ \t\r]*$)", "comment", re.I | re.M)
        for word in ("pw(?: for| is| was|:|=| =)", "pwd", "pass", "password", "passwd", "passwort", "parola", "sifre", "kennwort", "key", "token", "secret", "credentials?", "rotation", "works locally", "login")
    ),
    *(
        Rule("config_value", rf"^[ \t]*(?:-[ \t]+|export[ \t]+|set[ \t]+|env[ \t]+|//[^\s=]*:)?([\w.\-]*{word}[\w.\-]*[ \t]*[:=][ \t]*[^\s\"'`#;{{}}\[\]|>&*!][^\s\"'`]*)[ \t]*(?:[#;][^\n]*)?\r?$", "config", re.I | re.M, True)
        for word in ("pass", "pwd", "secret", "token", "key", "auth", "cred", "parola", "sifre", "kennwort")
    ),
)
#: Files of settings, where values need no quotes.
_CONFIG_FILE = re.compile(r"(?:^|/)(?:\.env(?:\.[\w.\-]+)?|[^/]*\.(?:env|ini|cfg|conf|cnf|config|properties|ya?ml|toml|tfvars)|\.(?:npmrc|pypirc|netrc|pgpass|s3cfg)|Dockerfile[^/]*|credentials)$", re.I)
_COMPILED = [(r, re.compile(r.pattern, r.flags), required(r.pattern, r.flags)) for r in RULES]
_CODES = TrigramCodes(set().union(*(trigrams_in(n) for _, _, n in _COMPILED)))
#: What stands before the random part of a prefixed token.
_ISSUER = re.compile(r"(?<![A-Za-z0-9_\-./+])[a-z][a-z0-9]{1,9}(?:_[a-z]{2,8})?\Z")

#: Forms that refer to a value kept elsewhere, or mask it.
_REFERENCE = re.compile(
    r"(?i)^\$|\$\{|\{\{|^\{|%\(|^%\w+%$|#\{|^<[^>]*>$|^env[:.(]|^vault[:/]|^secrets?[:/]|^file:|^ref[:+]|^arn:|^ssm:|os\.environ|process\.env|getenv|^@@|^__|^\[|^ENC\[|^sha\d+[:\-]|^md5[:\-]|x{6,}|\*\*\*|\.\.\."
)
#: Words that stand in for a value; a value with several digits is not made of them.
_STAND_IN = re.compile(
    r"(?i)^(?:todo|tbd|none|null|nil|undefined|true|false|unset|empty|secret|password|passwort|parola|token|change_?it)\W*$"
    r"|change[_\- ]?me|replace[_\- ]?(?:me|this|with)|placeholder|example|sample[_\-]|dummy|your[_\- ]|my[_\-](?:pass|secret|token|key)|insert[_\- ]|fill[_\- ]?in|redacted|masked|not[_\- ]?(?:a[_\- ])?real|fake|<set in"
)
_LITERAL_JOIN = re.compile(r"""(["'`])[ \t]*(?:\+|\.\.|\.|<<|&|\\)?[ \t]*((?:\r?\n[ \t]*)?)(?:\+|\.|<<|&)?[ \t]*(?:f|b|r|u)?\1(?=[^\s,;:)\]}])""")


def looks_random(value: str) -> bool:
    """Whether a value is built like a key or a password rather than like words."""
    kinds = sum(bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if not re.search(r"\d", value):
        return len(value) >= 20 and kinds >= 2 and entropy(value) > 3.5 and not re.search(r"[_\-./ ]", value)
    if re.fullmatch(r"[\d.\-:/ ]+", value):
        return False
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return len(value) >= 16 and entropy(value) > 2.5
    return kinds >= 2 and len(value) >= 8 and entropy(value) >= 2.3


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def placeholder(value: str) -> bool:
    """Whether a value stands for a secret kept elsewhere or to be filled in."""
    if _REFERENCE.search(value) or len(set(value)) <= 3:
        return True
    return sum(c.isdigit() for c in value) < 3 and bool(_STAND_IN.search(value))


# a search from inside a name could only fail again, once for each character of a long value
_NAMED = re.compile(r"""(?<![\w\-])([\w\-]+)["'`]?\]?(?:[ \t]*:[ \t]*[^=:"'`]{1,30}?)?[ \t]*(?::=|=>|=|:)[ \t]*(?:\(\s*|\[\s*|\\\n\s*|\n\s*)?(?:[bruf@]|new String\()?["'`]([^"'`\n]*)["'`]$""")


def _good_password(value: str) -> bool:
    return len(value) >= 6 and not placeholder(value) and bool(re.search(r"\d", value) or len(value) >= 10) and not value.startswith(("$", "{", "%", "<"))


def _secret_name(name: str) -> bool:
    return bool(re.search(rf"(?:^|[_\-]|\d){SECRET_NAME}(?:$|[_\-]|\d)|{SECRET_NAME}$", name))


def value_of(rule: Rule, found: str) -> str | None:
    """The secret in a match, or None where an exact look turns it down."""
    if rule.check == "key_block":
        return found
    if rule.check == "issued":
        return None if "EXAMPLE" in found.upper() or re.search(r"(?i)x{6,}|0{8,}|(.)\1{7,}", found) else found
    if rule.check == "prefixed":
        body = found[1:]
        mixed = all(re.search(k, body) for k in (r"[a-z]", r"[A-Z]", r"\d"))
        in_words = sum(map(len, re.findall(r"[A-Z]?[a-z]{3,}", body)))
        return found if mixed and entropy(body) >= 3.3 and 5 * in_words <= 3 * len(body) and not placeholder(found) else None
    if rule.check == "config":
        name, value = re.split(r"[ \t]*[:=][ \t]*", found, maxsplit=1)
        name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().replace(".", "_")
        if _ABOUT.search(name.rstrip("_0123456789")) or not _secret_name(name) or "://" in value or placeholder(value):
            return None
        typed = re.search(r"pass|pwd|pw$|parola|sifre|kennwort", name) and len(value) >= 6 and re.search(r"[A-Za-z]", value) and re.search(r"\d|[^\w\-./,]", value)
        return value if typed or looks_random(value) else None
    if rule.check == "password":
        return found if _good_password(found) else None
    if rule.check == "basic":
        try:
            plain = base64.b64decode(found + "=" * (-len(found) % 4), validate=True).decode("utf-8")
        except (binascii.Error, ValueError):
            return None
        user, colon, password = plain.partition(":")
        return found if colon and _good_password(password) else None
    if rule.check == "token":
        return found if looks_random(found) and not placeholder(found) and "://" not in found else None
    if rule.check == "comment":
        plain = found.rstrip(".,;")
        return plain if looks_random(plain) and not placeholder(plain) and "://" not in plain and not re.search(r"[()\[\]{}]|^[a-z]+(?:_[a-z]+)+$|^v?\d+(?:\.\d+)+$", plain) else None
    named = _NAMED.search(found)
    if not named:
        return None
    name, value = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", named[1]).lower(), named[2]
    if _ABOUT.search(name.rstrip("_0123456789")) or not _secret_name(name):
        return None
    if " " in value or "://" in value or "\\n" in value or placeholder(value) or not looks_random(value):
        return None
    return value


#: A line end within a joined value or between a name and its value: what stands before it, and after.
_OPEN_END = re.compile(r"""(?:["'`][ \t]*(?:\+|\.\.|\.|<<|&|\\)?|[=:(\[\\]|=>)\Z""")
_VALUE_NEXT = re.compile(r"""\s*(?:\+|\.\.|\.|<<|&)?[ \t]*(?:[bruf@]|new String\()?["'`]""")


def chunks_of(text: str) -> Iterator[tuple[int, str]]:
    """(offset, chunk) pieces that begin at line starts and overlap by whole lines.

    A piece goes on to the end of a value of any length that has begun in it.
    """
    at, n = 0, len(text)
    while at < n:
        till = min(n, at + CHUNK_CHARS)
        if till < n:
            cut = text.rfind("\n", at, till)
            till = cut + 1 if cut > at else (text.find("\n", till) + 1 or n)
            while till < n and (value := _VALUE_NEXT.match(text, till)) and _OPEN_END.search(text[max(at, till - OVERLAP_CHARS) : till].rstrip()[-8:]):
                till = text.find("\n", value.end()) + 1 or n
        yield at, text[at:till]
        if till >= n:
            return
        back = text.rfind("\n", at, max(at, till - OVERLAP_CHARS))
        at = max(back + 1, at + 1) if back > at else till


def joined_literals(text: str) -> tuple[str, list[int], list[int]]:
    """The text with literals that are joined by concatenation made one.

    Returns it with two lists that map offsets in it back: starts of the kept
    pieces in the new text, and their offsets in the old one.
    """
    out, new, old, at, length = [], [0], [0], 0, 0
    for m in _LITERAL_JOIN.finditer(text):
        if m[2] == "" and not re.search(r"[+.<&\\]|[ \t]", m[0]):
            continue
        out.append(text[at : m.start()])
        length += m.start() - at
        at = m.end()
        new.append(length)
        old.append(at)
    out.append(text[at:])
    return "".join(out), new, old


_CONTINUES = re.compile(r"(?:[=+(\[,\\.]|<<|&&|\|\||:=|=>|:)[ \t]*$")
_GOES_ON = re.compile(r"^[ \t]*(?:[+.&|?)]|<<)")


def statement_line(lines: list[str], line: int) -> int:
    """0-based line on which the statement that holds ``line`` begins.

    Goes up while the line before cannot be the end of a statement; entries of
    lists and objects are statements of their own.
    """
    while line > 0:
        before, here = lines[line - 1].rstrip("\r"), lines[line]
        value_only = re.match(r"""[ \t]*[bruf@]?["'`]""", here) and not re.match(r"""[ \t]*["'`][^"'`]*["'`][ \t]*(?::|=>)""", here)
        if re.search(r"(?:=|\+|:=|=>|\\|\()[ \t]*$", before) and value_only or _GOES_ON.match(here) and not here.lstrip().startswith((")", "}")) and re.search(r"""["'`]""", before):
            line -= 1
        elif value_only and re.search(r"""["'`][ \t]*$""", before) and not before.rstrip().endswith(","):
            line -= 1
        elif re.search(r"(?:[^:]:)[ \t]*$", before) and value_only:
            line -= 1
        else:
            return line
    return line


def scan_text(text: str, chunk: str, offset: int, rules: list[int]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, value) in ``text`` of the verified matches of ``rules`` in a chunk."""
    joined, new, old = joined_literals(chunk)
    for k in rules:
        rule, regex, _ = _COMPILED[k]
        for m in regex.finditer(joined):
            value = value_of(rule, m[1])
            if value is None:
                continue
            start = m.start(1) + (m[1].rfind(value) if value != m[1] else 0)
            end = start + len(value)
            if rule.check == "prefixed":
                issuer = _ISSUER.search(joined, max(0, start - 20), start)
                if issuer is None:
                    continue
                start, value = issuer.start(), issuer[0] + value
            a, b = bisect_right(new, start) - 1, bisect_right(new, end - 1) - 1
            yield offset + old[a] + start - new[a], offset + old[b] + end - new[b], rule.label, value


def find_in_texts(texts: list[str], paths: list[str | None] | None = None) -> list[list[tuple[int, int, str, str]]]:
    """Verified (start, end, label, value) in each text of a block, by the chunk index.

    ``paths`` tell configuration files.

    Chunks are indexed after literals joined by concatenation were made one, so
    that a value in parts has the trigrams its rule requires.
    """
    found: list[dict[tuple[int, int], tuple[str, str]]] = [{} for _ in texts]
    config = [bool(p and _CONFIG_FILE.search(p)) for p in paths or ()]
    block: list[tuple[int, int, str]] = []

    def flush() -> None:
        postings = Postings([joined_literals(c)[0] if '"' in c or "'" in c or "`" in c else c for _, _, c in block], _CODES)
        settings = sum(1 << number for number, (which, _, _) in enumerate(block) if config and config[which])
        rules: dict[int, list[int]] = {}
        for k, (rule, _, need) in enumerate(_COMPILED):
            if rule.config and not settings:
                continue
            found_in = postings.candidates(need)
            for number in bits(found_in & settings if rule.config else found_in):
                rules.setdefault(number, []).append(k)
        for number, some in rules.items():
            which, offset, chunk = block[number]
            for start, end, label, value in scan_text(texts[which], chunk, offset, some):
                found[which].setdefault((start, end), (label, value))
        block.clear()

    for which, text in enumerate(texts):
        for offset, chunk in chunks_of(text):
            block.append((which, offset, chunk))
            if len(block) >= BLOCK_CHUNKS:
                flush()
    if block:
        flush()
    return [sorted((s, e, label, value) for (s, e), (label, value) in one.items()) for one in found]


def line_positions(text: str, found: list[tuple[int, int, str, str]]) -> list[int]:
    """1-based lines on which the statements of the found values begin."""
    if not found:
        return []
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out = []
    for start, _, label, _ in found:
        line = bisect_right(starts, start) - 1
        out.append((line if label in ("private_key", "config_value") else statement_line(lines, line)) + 1)
    return out


def redact_text(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with every found value replaced, all around it left as it is.

    Letters, digits and most marks become ``*``; quotes, concatenation and line
    ends stay, so the code keeps its form.  A key block is masked to its END line.
    """
    out, at = [], 0
    for start, end, label, _ in sorted(found):
        if start < at:
            continue
        if label == "private_key":
            close = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----").search(text, end)
            stop = close.start() if close else len(text)
            body = re.sub(r"(\\n)|[A-Za-z0-9+/=]", lambda m: m[1] or "*", text[end:stop])
            out += [text[at:end], body]
            at = stop
        else:
            # a plain value must not begin with a mark that means something to the reader of the settings
            out += [text[at:start], "x" * (end - start) if label == "config_value" else _mask(text[start:end])]
            at = end
    out.append(text[at:])
    return "".join(out)


def _mask(piece: str) -> str:
    """Mask a value; where it runs over joined literals, only what is inside the quotes."""
    parts = re.split(r"""(["'`]\s*(?:\+|\.|<<|&|\\)?\s*["'`])""", piece)
    return "".join(p if k % 2 else "*" * len(p) for k, p in enumerate(parts))


_MASKED = re.compile(r"\*{2,}|\.\.\.|…|•|^\[.*\]$|^<.*>$|^(?:sha\d*|md5|hash)[:\-]|^x+$|^\W*(?:redacted|masked|hidden|removed|none|null)\W*$", re.I)


def readable(value: object) -> bool:
    """Whether a finding's masked_value shows the full value."""
    return isinstance(value, str) and len(value.strip()) >= 6 and not _MASKED.search(value.strip()) and not placeholder(value.strip())


def findings_in(payload: object) -> list[tuple[int, str]]:
    """(position, value) of the readable findings of a context document."""
    from seamstone.operators.context_tables import ENVELOPES
    from seamstone.operators.nested import decode_record

    record = decode_record(payload, ENVELOPES)
    scan = record.get("secrets_scan") if record else None
    findings = scan.get("findings") if isinstance(scan, dict) else None
    if isinstance(findings, dict):
        findings = [findings]
    out = []
    for pos, one in enumerate(findings if isinstance(findings, list) else []):
        value = one.get("masked_value") if isinstance(one, dict) else None
        if readable(value):
            out.append((pos, value))
    return out


def redact_payload(payload: str | None) -> str | None:
    """The payload with readable findings masked in place; the JSON around them stays byte for byte."""
    for _, value in findings_in(payload):
        for shown in {json.dumps(value)[1:-1], json.dumps(json.dumps(value)[1:-1])[1:-1], json.dumps(value, ensure_ascii=False)[1:-1]}:
            payload = payload.replace(shown, "*" * len(value))
    return payload


_FOUND = pa.schema([("origin", pa.string()), ("rec_id", pa.int64()), ("pos", pa.int32()), ("label", pa.string())])
_FOUND_DDL = "origin STRING, rec_id BIGINT, pos INT, label STRING"


def _found(origin: str, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    rows = list(dict.fromkeys(rows))
    return pa.RecordBatch.from_arrays(
        [pa.array([origin] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], schema=_FOUND
    )


def _contents(files: DataFrame) -> DataFrame:
    path = F.col("path") if "path" in files.columns else F.lit(None)
    return files.select(F.col("file_id").cast("long"), "content", path.cast("string").alias("path"))


def file_secrets(files: DataFrame) -> DataFrame:
    """``origin, rec_id, pos, label`` of every credential in files (file_id, content, and path where there is one).

    The path only tells configuration files.  Null and empty contents give no rows; repeated files are reported each;
    every chunk of a content is indexed, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = [(i, pos, hit[2]) for i, text, found in zip(ids, texts, find_in_texts(texts, batch.column(2).to_pylist())) if found for pos, hit in zip(line_positions(text, found), found)]
            if rows:
                yield _found("file", rows)

    return _contents(files).mapInArrow(run, _FOUND_DDL)


def context_secrets(contexts: DataFrame) -> DataFrame:
    """The same for findings of contexts (context_id, payload) left readable; unreadable payloads give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, pos, "finding") for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p and "masked_value" in p for pos, _ in findings_in(p)]
            if rows:
                yield _found("context", rows)

    return contexts.select(F.col("context_id").cast("long"), "payload").mapInArrow(run, _FOUND_DDL)


def found_secrets(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """Distinct ``origin, rec_id, pos`` over files and contexts."""
    return file_secrets(files).unionByName(context_secrets(contexts)).select("origin", "rec_id", "pos").distinct()


def redact_files(files: DataFrame) -> DataFrame:
    """``file_id, content`` with credentials masked; other contents come back unchanged, null stays null."""
    schema = pa.schema([("file_id", pa.int64()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = find_in_texts([t or "" for t in texts], batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact_text(t, f) if f else t for t, f in zip(texts, found)], pa.string())], schema=schema)

    return _contents(files).mapInArrow(run, "file_id BIGINT, content STRING")


def redact_contexts(contexts: DataFrame) -> DataFrame:
    """``context_id, payload`` with readable findings masked."""
    schema = pa.schema([("context_id", pa.int64()), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact_payload(p) for p in batch.column(1).to_pylist()], pa.string())], schema=schema)

    return contexts.select(F.col("context_id").cast("long"), "payload").mapInArrow(run, "context_id BIGINT, payload STRING")
