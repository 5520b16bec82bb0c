"""Lexers that turn a text into nested token sequences for ``gll``.

A lexer returns the number of the outermost group, or None where the text has
no tokens of the language (unfinished strings and comments, stray characters,
brackets that do not match, marks of an unresolved merge).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from seamstone.llm.gll import Grammar

_OPEN = {"(": "paren", "[": "brack", "{": "curly"}
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: Marks that an unresolved merge leaves at the beginning of a line.
_MERGE = r"(?P<e0>^(?:<{7}|>{7}|\|{7})(?=[ \r\n]|\Z))"


class Rejected(Exception):
    """The text is not made of the language's tokens."""


def operators(**kinds: str) -> dict[str, str]:
    """Operator -> kind, from kind=\"op op op\"; a trailing underscore keeps operators as their own kind."""
    return {op: (op if kind.endswith("_") else kind) for kind, ops in kinds.items() for op in ops.split()}


def operator_pattern(ops: dict[str, str]) -> str:
    return "|".join(re.escape(o) for o in sorted([*ops, "(", ")", "[", "]", "{", "}"], key=len, reverse=True))


class Nest:
    """Builds groups while tokens come in order."""

    __slots__ = ("grammar", "stack", "now", "line")

    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.stack, self.now, self.line = grammar, [], [], False

    def open(self, mark: str) -> None:
        self.stack.append((mark, self.now, self.line))
        self.now, self.line = [], False

    def close(self, mark: str) -> None:
        if not self.stack or self.stack[-1][0] != _CLOSE[mark]:
            raise Rejected
        inside = self.grammar.group(self.now)
        opened, self.now, line = self.stack.pop()
        self.now.append((("\n" if line else "") + _OPEN[opened], inside))

    def finish(self) -> int:
        if self.stack:
            raise Rejected
        return self.grammar.group(self.now)


_NUMBER = r"(?:0[xX][\da-fA-F_']+|0[bB][01_']+|0[oO]?[0-7_]+(?![\d.eE])|(?:\d[\d_']*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?:%s)?(?!\w)"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_LINE = r"//[^\n]*"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_WORD = r"[^\W\d]\w*"


def plain_lexer(
    skip: str, strings: str, number_suffix: str, ops: dict[str, str], keywords: dict[str, str], chars: str = r"(?!)", word: str = _WORD, member: tuple[str, ...] = (), line_ends: frozenset[str] | None = None, number: str = _NUMBER
) -> Callable[[Grammar, str], int]:
    """Lexer of a language whose tokens do not depend on what is around them.

    ``member``: operators after which every word is a name.  ``line_ends``:
    kinds after which a line end is a semicolon (None: line ends mean nothing).
    """
    newline = r"(?P<n>\n)|" if line_ends is not None else ""
    pattern = re.compile(
        rf"{_MERGE}|{newline}(?P<s>{skip})|(?P<q>{strings})|(?P<c>{chars})|(?P<w>{word})|(?P<d>{number % number_suffix})|(?P<o>{operator_pattern(ops)})|(?P<e>[^\s])",
        re.M,
    )
    find = pattern.finditer

    def lex(grammar: Grammar, text: str) -> int:
        nest = Nest(grammar)
        for m in find(text):
            kind = m.lastgroup
            if kind == "w":
                now = nest.now
                if member and now and now[-1] in member:
                    now.append("ID")
                else:
                    now.append(keywords.get(m[0], "ID"))
            elif kind == "o":
                op = m[0]
                if op in _OPEN:
                    nest.open(op)
                elif op in _CLOSE:
                    if line_ends is not None and op == "}" and nest.now and nest.now[-1] == ";":
                        nest.now.pop()
                    nest.close(op)
                else:
                    nest.now.append(ops[op])
            elif kind == "s":
                if line_ends is not None and "\n" in m[0]:
                    _semicolon(nest.now, line_ends)
            elif kind == "n":
                _semicolon(nest.now, line_ends)
            elif kind == "q":
                nest.now.append("STR")
            elif kind == "d":
                nest.now.append("NUM")
            elif kind == "c":
                nest.now.append("CHAR" if m[0][-1] == "'" else "LIFE")
            else:
                raise Rejected
        return nest.finish()

    return lex


def _semicolon(now: list, line_ends: frozenset[str]) -> None:
    if now:
        last = now[-1]
        if (last if type(last) is str else last[0]) in line_ends:
            now.append(";")


def words(text: str, **kinds: str) -> dict[str, str]:
    """Keyword -> kind: those of ``text`` are kinds of their own."""
    return {**{w: w for w in text.split()}, **{w: k for k, ws in kinds.items() for w in ws.split()}}


# ---- JSON ----------------------------------------------------------------
_json_tokens = re.compile(r'(?P<q>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<d>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<w>(?:true|false|null)(?!\w))|(?P<o>[{}\[\],:])|(?P<e>[^ \t\r\n])')


_JSON_NOTE = r"(?P<s>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|"
_json_tokens_notes = re.compile(_JSON_NOTE + _json_tokens.pattern)


def lex_json(grammar: Grammar, text: str, tokens: re.Pattern = _json_tokens) -> int:
    nest = Nest(grammar)
    for m in tokens.finditer(text):
        kind = m.lastgroup
        if kind == "o":
            op = m[0]
            if op in _OPEN:
                nest.open(op)
            elif op in _CLOSE:
                nest.close(op)
            else:
                nest.now.append(op)
        elif kind == "q":
            nest.now.append("STR")
        elif kind == "d":
            nest.now.append("NUM")
        elif kind == "w":
            nest.now.append(m[0])
        elif kind != "s":
            raise Rejected
    return nest.finish()


def lex_json_with_comments(grammar: Grammar, text: str) -> int:
    return lex_json(grammar, text, _json_tokens_notes)


# ---- scripts ---------------------------------------------------------------
_SCRIPT_OPS = operators(
    ADD="+ -", UN="~", INC="++ --", ASG="+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=", BIN="/ % ** << <= >= == != === !== ^ && || ??",
    own_="* ! < > & | = => ? ?. : ; , . ... @",
)
_SCRIPT_WORDS = words(
    "async of get set static from as type using accessor yield let assert implements interface public private protected abstract readonly declare override namespace module keyof infer is satisfies unique asserts "
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
)
_script_tokens = re.compile(
    rf"{_MERGE}|(?P<n>\n)|(?P<s>[ \t\r\f\v﻿\xa0  ]+|{_LINE}|{_BLOCK}|\A#![^\n]*)|(?P<w>#?(?:[^\W\d]|\$)[\w$]*)|(?P<d>{_NUMBER % 'n'})|(?P<q>{_DQ}|{_SQ})|(?P<t>`)|(?P<o>\?\.(?!\d)|{operator_pattern({k: v for k, v in _SCRIPT_OPS.items() if k != '?.'})})|(?P<e>\S)",
    re.M,
)
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_OPERAND_END = frozenset(["ID", "NUM", "STR", "REGEX", "TEMPLATE", "this", "super", "null", "true", "false", "INC", "paren", "brack", "curly", "markup", "of", "get", "set", "static", "from", "as", "type", "async"])
_TAG_OPEN = re.compile(r"<(?:(?P<name>[A-Za-z_$][\w.$:\-]*)|(?=>))")
_ATTR = re.compile(r"\s*(?:(?P<name>[A-Za-z_$][\w$:\-.]*)(?:\s*=\s*(?P<q>\"[^\"]*\"|'[^']*'|(?=[{<])))?|(?P<hole>\{)|(?P<end>/?>))")


class _Script:
    """Scripts: regex literals, templates and markup depend on the token before."""

    def __init__(self, grammar: Grammar, text: str, markup: bool) -> None:
        self.grammar, self.text, self.markup = grammar, text, markup

    def lex(self, at: int = 0, hole: bool = False) -> tuple[int, int]:
        """Tokens from ``at``; in a hole up to the brace that closes it.  (group, end)"""
        text, nest, find, n = self.text, Nest(self.grammar), _script_tokens.match, len(self.text)
        line = False
        while at < n:
            m = find(text, at)
            kind = m.lastgroup
            at = m.end()
            if kind == "s":
                line = line or "\n" in m[0]
                continue
            if kind == "n":
                line = True
                continue
            now = nest.now
            last = now[-1] if now else ""
            last = last if type(last) is str else last[0]
            if kind == "w":
                made = "ID" if last.endswith(".") and last.lstrip("\n") in (".", "?.") else _SCRIPT_WORDS.get(m[0], "ID")
            elif kind == "o":
                op = m[0]
                if op in _OPEN:
                    nest.line = line
                    nest.open(op)
                    line = False
                    continue
                if op in _CLOSE:
                    if op == "}" and hole and not nest.stack:
                        return self.grammar.group(nest.now), at
                    nest.close(op)
                    line = False
                    continue
                operand = last.lstrip("\n") in _OPERAND_END
                if op in ("/", "/=") and not operand:
                    r = _REGEX.match(text, m.start())
                    if not r:
                        raise Rejected
                    made, at = "REGEX", r.end()
                elif op == "<" and self.markup and not operand and _TAG_OPEN.match(text, m.start()):
                    holes: list = []
                    at = self._tag(m.start(), holes)
                    made = ("markup", self.grammar.group(holes))
                else:
                    made = _SCRIPT_OPS[op]
            elif kind == "q":
                made = "STR"
            elif kind == "d":
                made = "NUM"
            elif kind == "t":
                holes = []
                while True:
                    at = _TEMPLATE_TEXT.match(text, at).end()
                    if at >= n:
                        raise Rejected
                    if text[at] == "`":
                        at += 1
                        break
                    inside, at = self.lex(at + 2, True)
                    holes.append(("curly", inside))
                made = ("markup", self.grammar.group(holes)) if holes else "TEMPLATE"
            else:
                raise Rejected
            if line:
                made = "\n" + made if type(made) is str else ("\n" + made[0], made[1])
                line = False
            now.append(made)
        if hole:
            raise Rejected
        return nest.finish(), at

    def _tag(self, at: int, holes: list) -> int:
        """Scan one element, collecting the groups in its braces; its end."""
        text = self.text
        m = _TAG_OPEN.match(text, at)
        name, at = m["name"] or "", m.end()
        while True:
            a = _ATTR.match(text, at)
            if not a:
                raise Rejected
            at = a.end()
            if a["end"] == "/>":
                return at
            if a["end"] == ">":
                break
            if a["hole"] or (a["q"] == "" and text[at] == "{"):
                inside, at = self.lex(at if a["hole"] else at + 1, True)
                holes.append(("curly", inside))
            elif a["q"] == "":
                at = self._tag(at, holes)
        while True:
            step = re.compile(r"[^<{]*").match(text, at).end()
            if step >= len(text):
                raise Rejected
            at = step
            if text[at] == "{":
                inside, at = self.lex(at + 1, True)
                holes.append(("curly", inside))
            elif text.startswith("</", at):
                c = re.compile(r"</\s*([\w.$:\-]*)\s*>").match(text, at)
                if not c or c[1] != name:
                    raise Rejected
                return c.end()
            elif _TAG_OPEN.match(text, at):
                at = self._tag(at, holes)
            else:
                raise Rejected


def script_lexer(markup: bool) -> Callable[[Grammar, str], int]:
    return lambda grammar, text: _Script(grammar, text, markup).lex()[0]


# ---- languages with plain tokens ---------------------------------------------
_C_SKIP = rf"{_LINE}|{_BLOCK}"
_JAVA_OPS = operators(ADD="+ -", UN="~ !", INC="++ --", ASG="+= -= *= /= %= <<= >>= >>>= &= |= ^=", BIN="/ % << <= >= == != ^ && ||", own_="* < > & | = -> :: ? : ; , . ... @")
lex_java = plain_lexer(
    _C_SKIP, rf'"""(?:[^\\]|\\[\s\S])*?"""|{_DQ}', "[fFdDlL]", _JAVA_OPS,
    words(
        "package import static class interface enum record extends implements permits throws default final synchronized if else for while do return break continue throw yield assert try catch finally switch case when instanceof new this super true false null module",
        MOD="public private protected abstract native strictfp transient volatile sealed", PRIM="int long short byte char float double boolean void",
        RESERVED="goto const",
    ),
    chars=r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'",
)

_CSHARP_OPS = operators(ADD="+ -", UN="~", INC="++ --", ASG="+= -= *= /= %= <<= >>= >>>= &= |= ^= ??=", BIN="/ % << <= >= == != && ||", own_="! * < > & | ^ = => -> :: ? ?? : ; , . ..")
lex_csharp = plain_lexer(
    rf"{_C_SKIP}|^[ \t]*#[^\n]*", rf'\$*"""+[\s\S]*?"""+|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?{_DQ}(?:u8)?', "[fFdDmMuUlL]{0,3}", _CSHARP_OPS,
    words(
        "global using static extern namespace readonly const ref async unsafe new partial required file class struct interface record enum delegate where default base this event implicit explicit operator true false null get set init add remove in out params await if else for foreach while do return break continue throw goto case "
        "yield try catch finally switch lock fixed checked unchecked when var from let join on equals into orderby ascending descending select group by is as with not and or typeof sizeof nameof stackalloc",
        MOD="public private protected internal abstract sealed virtual override volatile", PRIM="int uint long ulong short ushort byte sbyte char float double decimal bool string object void nint nuint dynamic",
    ),
    chars=r"'(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{1,4}|.))'", word=r"@?[^\W\d]\w*",
)

_GO_OPS = operators(ADD="+ -", UN="~", INC="++ --", ASG="+= -= *= /= %= <<= >>= &= |= ^= &^=", BIN="/ % << >> <= >= == != ^ &^ && ||", DEF=":=", ARROW="<-", own_="! * < > & | = : ; , . ...")
lex_go = plain_lexer(
    rf"[ \t\r]+|{_LINE}|{_BLOCK}", rf"{_DQ}|`[^`]*`", "i", _GO_OPS,
    words("package import var const type func map chan struct interface if else for range switch case default select return break continue goto fallthrough go defer"),
    chars=r"'(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[0-7]{3}|.))'",
    line_ends=frozenset(["ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "INC", "paren", "brack", "curly"]),
)

_RUST_OPS = operators(ADD="+ -", ASG="+= -= *= /= %= <<= >>= &= |= ^=", BIN="/ % << <= >= == != ^", AND="&&", OR="||", own_="! * < > & | = -> => :: ? : ; , . .. ..= ... @ # $ ~")
lex_rust = plain_lexer(
    rf"{_LINE}|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|\A#![^\[\n][^\n]*", rf'[bc]?r(?P<h>#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*"', r"_?[iuf](?:8|16|32|64|128|size)", _RUST_OPS,
    words(
        "use extern crate as mod unsafe const static mut type struct union enum auto trait impl for pub self super Self fn async default where dyn let if else match loop while in move ref box return yield break continue true false await raw _"
    ),
    chars=r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]{1,8}\}|x[0-9a-fA-F]{2}|.))'|(?P<life>'[^\W\d]\w*)",
    number=_NUMBER.replace(r"?|\.\d[\d_]*)(?:[eE]", "?)(?:[eE]"),
)

_CPP_OPS = operators(ADD="+ -", UN="~", INC="++ --", ASG="+= -= *= /= %= <<= >>= &= |= ^=", BIN="/ % << <= >= == != <=> ^", AND="&&", OR="||", own_="! * < > & | = -> ->* .* :: ? : ; , . ...")
_cpp_lexer = lambda **more: plain_lexer(
    rf"{_LINE}|{_BLOCK}|^[ \t]*\#(?:[^\n\\]|\\\r?\n|\\)*", rf'(?:u8|[uUL])?R"(?P<h>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=h)"|(?:u8|[uUL])?{_DQ}', r"[uUlLfFzZ]{1,3}|_\w+", _CPP_OPS,
    words(
        "inline namespace extern using typename static_assert concept template requires alignas __attribute__ static const constexpr auto decltype explicit virtual friend typedef mutable class struct union enum final operator new delete noexcept override throw try catch default if else for while do return co_return break continue goto "
        "switch case asm consteval sizeof alignof co_await co_yield typeid true false nullptr this",
        MOD="volatile register thread_local restrict __restrict constinit", PRIM="int long short char float double bool void unsigned signed wchar_t char8_t char16_t char32_t size_t", ACCESS="public private protected",
        CASTOP="static_cast dynamic_cast const_cast reinterpret_cast", **more,
    ),
    chars=r"(?:u8|[uUL])?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]+|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)){1,4}'",
)
lex_cpp = _cpp_lexer()
lex_header = _cpp_lexer(CQUAL="_Noreturn _Thread_local _Complex _Imaginary", COF="_Alignas typeof typeof_unqual __typeof__", GENERIC="_Generic", _Atomic="_Atomic")

# ---- PHP ------------------------------------------------------------------
_PHP_OPS = operators(
    ADD="+ -", UN="~", INC="++ --", ASG="+= -= *= /= %= **= .= <<= >>= &= |= ^= ??=", BIN="/ % ** << >> <= >= == != === !== <> <=> ^ && ||", SILENT="@", BSL="\\",
    own_="! * < > & | . = => -> ?-> :: ? ?? : ; , ... $ #",
)
_PHP_WORDS = words(
    "namespace use function const class interface trait enum extends implements static var echo print if else elseif endif while endwhile do for endfor foreach endforeach switch case default endswitch break continue return try catch finally global unset declare goto "
    "as array callable null true false self parent instanceof new clone yield from throw fn list match isset empty",
    MOD="public private protected abstract final readonly", LOGIC="and or xor", include="include include_once", require="require require_once", exit="exit die",
)
_php_tokens = re.compile(
    rf"{_MERGE}|(?P<s>\s+|(?://|\#(?!\[))(?:[^\n?]|\?(?!>))*|{_BLOCK})|(?P<x>\?>\n?)|(?P<v>\$[^\W\d]\w*)|(?P<w>{_WORD})|(?P<d>{_NUMBER % '(?!)'})"
    rf"|(?P<h><<<[ \t]*(?P<hq>[\"']?)(?P<hn>[^\W\d]\w*)(?P=hq)\r?\n(?:[\s\S]*?\n)??[ \t]*(?P=hn)(?!\w))|(?P<q>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)"
    rf"|(?P<k>\(\s*(?:int|integer|float|double|string|bool|boolean|array|object|binary)\s*\))|(?P<o>{operator_pattern(_PHP_OPS)})|(?P<e>\S)",
    re.M | re.I,
)
_PHP_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)


def lex_php(grammar: Grammar, text: str) -> int:
    nest, n = Nest(grammar), len(text)
    at = 0
    while at < n:
        opened = _PHP_OPEN.search(text, at)
        if not opened:
            nest.now.append("HTML")
            break
        if opened.start() > at:
            nest.now.append("HTML")
        if opened[0] == "<?=":
            nest.now.append("echo")
        at = opened.end()
        while at < n:
            m = _php_tokens.match(text, at)
            kind, at = m.lastgroup, m.end()
            now = nest.now
            if kind == "v":
                now.append("VAR")
            elif kind == "w":
                now.append("ID" if now and now[-1] in ("->", "?->") else _PHP_WORDS.get(m[0].lower(), "ID"))
            elif kind == "o":
                op = m[0]
                if op in _OPEN:
                    nest.open(op)
                elif op in _CLOSE:
                    nest.close(op)
                else:
                    now.append(_PHP_OPS[op])
            elif kind == "x":
                now.append(";")
                break
            elif kind in ("q", "h"):
                now.append("STR")
            elif kind == "d":
                now.append("NUM")
            elif kind == "k":
                now.append("CAST")
            elif kind != "s":
                raise Rejected
    return nest.finish()


# ---- Ruby -----------------------------------------------------------------
_RUBY_OPS = operators(
    ADD="+ -", UN="~", ASG="+= -= *= /= %= **= <<= >>= &= |= ^= &&= ||=", BIN="/ % >> <= >= == != === =~ !~ <=> &&", OR="||", ARROW="->", **{".._": ".. ..."},
    own_="! * ** < > & | ^ << = => :: ? : ; , . &.",
)
_RUBY_OPS["..."] = ".."
_RUBY_WORDS = words("alias and begin BEGIN break case class def do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __method__", defined="defined?")
_RUBY_OPENERS = frozenset(["def", "class", "module", "begin", "case", "for", "if", "unless", "while", "until", "do"])
_RUBY_MODIFIERS = frozenset(["if", "unless", "while", "until"])
_RUBY_BEFORE = frozenset(["", ";", "=", "ASG", ",", "then", "else", "do", "and", "or", "not", "OR", "BIN", "!", "=>", "|", "?", ":", "LABEL", "ADD", "<<"])
_RUBY_CARRY = frozenset(["BIN", "ADD", "*", "**", "<", ">", "<<", "&", "|", "^", "OR", "=", "ASG", "=>", "::", "?", ":", ",", ".", "&.", "!", "and", "or", "not", ";", "..", "ARROW"])
_RUBY_OPERAND = frozenset(["ID", "CONST", "VAR", "NUM", "STR", "SYM", "REGEX", "HEREDOC", "nil", "true", "false", "self", "super", "paren", "brack", "curly", "block", "end"])
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_ruby_tokens = re.compile(
    rf"{_MERGE}|(?P<n>\r?\n)|(?P<s>[ \t\r]+|\\\r?\n|\#[^\n]*|^=begin\b[\s\S]*?^=end\b[^\n]*|^__END__\r?\n[\s\S]*)|(?P<lab>(?:[^\W\d]\w*[?!]?|\"(?:[^\"\\\n]|\\.)*\"):(?![:\w]))|(?P<w>defined\?|[^\W\d]\w*(?:[?!](?!=))?)|(?P<v>@{{1,2}}[^\W\d]\w*|\$(?:[^\W\d]\w*|[\d!@&~_.,/\;:<>\"$?*]))"
    rf"|(?P<d>{_NUMBER % '[ri]'})|(?P<sym>:(?:[^\W\d]\w*[?!=]?(?![=>~])|[^\W\d]\w*[?!]?|\"(?:[^\"\\]|\\[\s\S])*\"|\[\]=?|[+\-*/%<>=!~&|^]+))|(?P<h><<[~\-]?(?P<hq>[\"'`]?)(?P<hn>[A-Z_]\w*)(?P=hq))|(?P<pct>%[wWiIqQrsx]?(?P<pd>[(\[{{<|!/]))"
    rf"|(?P<q>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)|(?P<ch>\?\w(?!\w))|(?P<o>{operator_pattern(_RUBY_OPS)})|(?P<e>\S)",
    re.M,
)
_RUBY_REGEX = re.compile(r"/(?:[^/\\\n]|\\[\s\S])*/[a-z]*")
_LEADING_DOT = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*(?:\.(?!\.)|&\.)")


def lex_ruby(grammar: Grammar, text: str) -> int:
    nest, n, at = Nest(grammar), len(text), 0
    heredocs: list[str] = []
    loops: list[int] = []
    while at < n:
        m = _ruby_tokens.match(text, at)
        kind, start = m.lastgroup, at
        at = m.end()
        now = nest.now
        last = now[-1] if now else ""
        last = last if type(last) is str else last[0]
        spaced = start > 0 and text[start - 1] in " \t"
        if kind == "s":
            continue
        if kind == "n":
            for name in heredocs:
                end = re.compile(rf"^[ \t]*{name}\r?$", re.M).search(text, at)
                if not end:
                    raise Rejected
                at = end.end()
            heredocs.clear()
            if last not in _RUBY_CARRY and not (last == "" and not nest.stack) and not _LEADING_DOT.match(text, at):
                now.append(";")
            continue
        if kind == "w":
            word = m[0]
            made = "ID" if last in (".", "&.") else _RUBY_WORDS.get(word, "CONST" if word[0].isupper() else "ID")
            if last == "def" and made != "self":
                made = "CONST" if word[0].isupper() else "ID"
            if made in _RUBY_OPENERS:
                if made == "do" and loops and loops[-1] == len(nest.stack):
                    loops.pop()
                    now.append("do")
                    continue
                if made not in _RUBY_MODIFIERS or last in _RUBY_BEFORE or last in ("if", "unless", "while", "until", "return") and made == "case":
                    nest.stack.append((made, now, False))
                    nest.now = [made]
                    if made in ("while", "until", "for"):
                        loops.append(len(nest.stack))
                    continue
            if made == "end":
                if not nest.stack or nest.stack[-1][0] not in _RUBY_OPENERS:
                    raise Rejected
                while loops and loops[-1] >= len(nest.stack):
                    loops.pop()
                inside = grammar.group(nest.now)
                _, nest.now, _ = nest.stack.pop()
                nest.now.append(("block", inside))
                continue
            now.append(made)
            continue
        if kind == "o":
            op = m[0]
            if op in _OPEN:
                nest.open(op)
            elif op in _CLOSE:
                while loops and loops[-1] >= len(nest.stack):
                    loops.pop()
                nest.close(op)
            elif op == "/" and (last not in _RUBY_OPERAND or (last == "ID" and spaced and text[at : at + 1] not in " =\n")):
                r = _RUBY_REGEX.match(text, start)
                if not r:
                    raise Rejected
                now.append("REGEX")
                at = r.end()
            elif op == "=" and nest.stack and nest.stack[-1][0] == "def" and ";" not in now and len(now) > 1:
                if last != "paren" and text[at : at + 1] == "(":
                    continue  # the name of a setter
                head = now
                _, nest.now, _ = nest.stack.pop()
                nest.now += ["DEF", *head[1:], "="]
            else:
                if op == ";" and loops and loops[-1] == len(nest.stack):
                    loops.pop()
                now.append(_RUBY_OPS[op])
            continue
        if kind == "lab":
            ternary = "?" in [x for x in now[-12:] if type(x) is str]
            if m[0][0] == '"' or not ternary or last in (",", "") or last == "(":
                now.append("LABEL")
            else:
                at = m.end() - 1
                now.append(_RUBY_WORDS.get(m[0][:-1], "ID"))
            continue
        if kind == "h":
            if last in _RUBY_OPERAND and not (last == "ID" and spaced) or (last == "class"):
                now.append("<<")
                at = start + 2
            else:
                heredocs.append(m["hn"])
                now.append("HEREDOC")
            continue
        if kind == "pct":
            if last in _RUBY_OPERAND and not (last == "ID" and spaced and m[0][1:2] not in " "):
                now.append("BIN")
                at = start + 1
            else:
                opened = m["pd"]
                closed, depth = _PAIRS.get(opened, opened), 1
                while depth:
                    if at >= n:
                        raise Rejected
                    c = text[at]
                    if c == "\\":
                        at += 1
                    elif c == closed:
                        depth -= 1
                    elif c == opened:
                        depth += 1
                    at += 1
                now.append("REGEX" if m[0][1] == "r" else "STR")
            continue
        made = {"v": "VAR", "d": "NUM", "sym": "SYM", "q": "STR", "ch": "STR"}.get(kind)
        if made is None:
            raise Rejected
        if kind == "ch" and last in _RUBY_OPERAND:
            now.append("?")
            at = start + 1
            continue
        now.append(made)
    if heredocs:
        raise Rejected
    return nest.finish()


# ---- Python ---------------------------------------------------------------
_PYTHON_OPS = operators(ADD="+ -", UN="~", ASG="+= -= *= /= //= %= **= @= <<= >>= &= |= ^=", BIN="// % << >> < > <= >= == != & ^", WALRUS=":=", SEMI=";", LTGT="<>", TICK="`", own_="* ** / @ | = -> : , . ...")
_PYTHON_WORDS = words("and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try type while with yield None True False print exec")
_PY_PREFIX = r"(?:[uU][rR]|[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?"
_python_tokens = re.compile(
    rf"{_MERGE}|(?P<n>\r?\n)|(?P<s>[ \t\f]+|\\\r?\n|\#[^\n]*)|(?P<q>{_PY_PREFIX}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\"){_DQ[1:]}|'(?!''){_SQ[1:]}))|(?P<w>{_WORD})"
    rf"|(?P<d>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))|(?P<l>(?:0[xX][\da-fA-F]+|\d+)[lL](?!\w))|(?P<o>{operator_pattern(_PYTHON_OPS)})|(?P<e>\S)",
    re.M,
)
_INDENT = re.compile(r"[ \t\f]*")
_OLD_PREFIX = ("ur", "uR", "Ur", "UR")
_OLD_OCTAL = re.compile(r"0\d*[1-9]\d*$|00*_?[1-9]")


def lex_python(grammar: Grammar, text: str) -> int:
    if text[:1] == "﻿":
        text = text[1:]
    nest, levels, depth = Nest(grammar), [0], 0
    fresh = _line_start(nest, levels, text, 0)
    decorator = False
    for m in _python_tokens.finditer(text):
        kind = m.lastgroup
        if kind == "w":
            nest.now.append(_PYTHON_WORDS.get(m[0], "ID"))
            fresh = False
        elif kind == "o":
            op = m[0]
            if op in _OPEN:
                nest.open(op)
                depth += 1
            elif op in _CLOSE:
                nest.close(op)
                depth -= 1
            else:
                if op == "@" and fresh:
                    decorator = True
                nest.now.append(_PYTHON_OPS[op])
            fresh = False
        elif kind == "n":
            if depth == 0:
                if not fresh:
                    nest.now.append("DNL" if decorator else ";")
                    decorator = False
                fresh = _line_start(nest, levels, text, m.end()) or fresh
        elif kind == "q":
            nest.now.append("OLDSTR" if m[0][:2] in _OLD_PREFIX else "STR")
            fresh = False
        elif kind == "d":
            old = m[0].isdigit() and _OLD_OCTAL.match(m[0])
            if old and not m[0].strip("01234567") == "":
                raise Rejected
            nest.now.append("OLDNUM" if old else "NUM")
            fresh = False
        elif kind == "l":
            nest.now.append("OLDNUM")
            fresh = False
        elif kind != "s":
            raise Rejected
    if depth == 0 and not fresh:
        nest.now.append(";")
    while len(levels) > 1:
        _dedent(nest, levels)
    return nest.finish()


def _line_start(nest: Nest, levels: list[int], text: str, at: int) -> bool:
    """Open or close blocks at the beginning of a line; True where a statement begins."""
    end = _INDENT.match(text, at).end()
    if end >= len(text) or text[end] in "#\r\n":
        return True
    width = len(text[at:end].expandtabs(8))
    if width > levels[-1]:
        levels.append(width)
        nest.stack.append(("block", nest.now, False))
        nest.now = []
    else:
        while width < levels[-1]:
            _dedent(nest, levels)
        if width != levels[-1]:
            raise Rejected
    return True


def _dedent(nest: Nest, levels: list[int]) -> None:
    levels.pop()
    if not nest.stack or nest.stack[-1][0] != "block":
        raise Rejected
    inside = nest.grammar.group(nest.now)
    _, nest.now, _ = nest.stack.pop()
    nest.now.append(("block", inside))


# ---- languages known by their tokens, brackets and beginnings only ----------------
_ANY_OPS = operators(OP="! $ % & * + , - . / : < = > ? \\ ^ | ~ `", START="@ # ;")
#: Words that declarations and statements at the outermost level begin with.
_KOTLIN_HEADS = "package import fun class interface object val var typealias enum sealed data abstract open final private public internal protected inline suspend operator infix tailrec external annotation const lateinit expect actual value override companion"
_SQL_HEADS = "select insert update delete create alter drop with set use begin commit rollback grant revoke explain merge truncate replace call declare do end exec execute analyze vacuum comment copy lock show describe values start savepoint pragma attach go if while print raiserror deallocate reset refresh"
lex_kotlin = plain_lexer(rf"{_LINE}|{_BLOCK}|\A#![^\n]*", rf'"""[\s\S]*?"""+|{_DQ}|`[^`\n]+`', r"[uUlLfF]{0,2}", _ANY_OPS, words("", HEAD=_KOTLIN_HEADS), chars=r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'")
lex_swift = plain_lexer(rf"{_LINE}|{_BLOCK}|\A#![^\n]*", rf'#"(?:(?!"#)[^\n])*"#|"""[\s\S]*?"""|{_DQ}|`[^`\n]+`', r"", _ANY_OPS, {})
lex_sql = plain_lexer(rf"--[^\n]*|{_BLOCK}", r"""'(?:[^'\\]|''|\\[\s\S])*'|"(?:[^"]|"")*"|`[^`]*`|\$(?P<h>\w*)\$[\s\S]*?\$(?P=h)\$""", r"\w*", _ANY_OPS, words("", HEAD=" ".join(w for k in _SQL_HEADS.split() for w in (k, k.upper(), k.title()))))
lex_css = plain_lexer(rf"{_BLOCK}", rf"{_DQ}|{_SQ}", r"[\w%]*", _ANY_OPS, {}, word=r"[^\W\d][\w\-]*|\d[\w\-%]*")
