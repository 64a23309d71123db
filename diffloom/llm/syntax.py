"""Source files that do not parse: language-specific lexers with a pushdown stack.

A lexer walks each source once; delimiters, interpolations, template parts, JSX elements, indentation (Python) and the
parts of objects and arrays (JSON) go on a stack. Unterminated literals, unbalanced delimiters, merge-conflict markers,
stray characters, premature ends, misplaced lines and text of another language are reported with the line. For Python an
exact parser gives a second opinion afterwards; what it can't judge for size or depth is left to the stack.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Extension -> language, and other spellings of the languages' names.
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "pyi": "python", "java": "java", "go": "go", "rs": "rust", "cs": "csharp", "json": "json"}
ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "rs": "rust", "cs": "csharp", "c#": "csharp", "golang": "go"}

_CLOSER = {"(": ")", "[": "]", "{": "}"}
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)(?:\.(?!\.)[\d_]*(?![A-Za-z_.]))?(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)[A-Za-z]\w*|(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)\b|\.\d[\d_]*|\d[\d_]*"
_WORD = r"[^\W\d][\w]*"
_DQ, _SQ = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_CHAR = r"'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\x[0-9a-fA-F]{1,4}|\\U[0-9a-fA-F]{8}|\\.)'"
_SLASHED = r"//[^\n]*"
_BLOCK = r"/\*[\s\S]*?\*/"


def _lexer(comment: str, string: str, word: str = _WORD, op: str = r"[^\w\s]") -> re.Pattern:
    return re.compile(rf"[^\S\n]*(?:(?P<word>{word})|(?P<comment>{comment})|(?P<space>\n\s*)|(?P<str>{string})|(?P<num>{_NUMBER})|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<op>{op})|(?P<end>\Z)|(?P<stray>[\s\S]))")


_OPS = r"[-+*/%&|^!~<>?:=.,;@#$`\\]"
_LEXERS = {
    "java": _lexer(f"{_SLASHED}|{_BLOCK}", rf'"""[\s\S]*?"""|{_DQ}|{_CHAR}', r"[^\W\d][\w$]*", r"->|::|\+\+|--|[-+*/%&|^!~<>?:=.,;@]"),
    "go": _lexer(f"{_SLASHED}|{_BLOCK}", rf"{_DQ}|`[^`]*`|'(?:\\(?:x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}|.)|[^'\\\n])'", _WORD, r":=|<-|\.\.\.|\+\+|--|[-+*/%&|^!~<>:=.,;]"),
    "rust": _lexer(_SLASHED, r'b?r(?P<h>#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*"' + r"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^'\\\n])'", r"'[^\W\d]\w*(?!')|r#[^\W\d]\w*|(?!b?r#*\"|[bc]\"|b')[^\W\d]\w*", r"=>|->|::|\.\.=?|[-+*/%&|^!~<>?:=.,;@#$]"),
    "csharp": _lexer(f"{_SLASHED}|{_BLOCK}|(?m:^[ \\t]*#(?:region|endregion|if|else|elif|endif|define|undef|pragma|nullable|warning|error|line)\\b[^\\n]*)", rf'"""[\s\S]*?"""|@"(?:[^"]|"")*"|{_DQ}(?:u8)?|{_CHAR}', r"@?[^\W\d]\w*", r"=>|->|::|\?\?|\?\.|\+\+|--|[-+*/%&|^!~<>?:=.,;$@]"),
    "typescript": _lexer(f"{_SLASHED}|{_BLOCK}|\\A#![^\\n]*", rf"{_DQ}|{_SQ}", r"#?[^\W\d][\w$]*|\$[\w$]*", r"=>|\?\.|\.\.\.|\+\+|--|[-+*/%&|^!~<>?:=.,;@`]"),
    "python": _lexer(r"\#[^\n]*", rf'[rRbBuUfFtT]{{0,2}}(?:"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|{_DQ}|{_SQ})', r"(?![rRbBuUfFtT]{1,2}[\"'])" + _WORD, r"->|:=|\*\*|//|[-+*/%&|^!~<>:=.,;@\\]"),
    "json": _lexer(r"(?!)", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r"true\b|false\b|null\b", r"[-+:,.]"),
}
_LEXERS["javascript"] = _LEXERS["typescript"]

_CONFLICT = re.compile(r"(?:<{7}|>{7}|={7}|\|{7})(?![<>=|])[^\n]*")
# Words after which an operand follows in TypeScript and JavaScript, or that may stand before a name.
_TS_JOIN = set(
    "abstract accessor as assert asserts async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get global if implements import in infer instanceof "
    "interface is keyof let module namespace new of out override private protected public readonly return satisfies set static super switch this throw try type typeof unique using var void while with yield".split()
)
_TS_REGEX_AFTER = set("return typeof case in of delete void throw new do else instanceof await yield default".split())
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
# Keywords of Java, C# and Rust that may stand beside a name without a sign between.
_KEYWORDS = {
    "java": set(
        "abstract assert break case catch class continue default do else enum extends final finally for goto if implements import instanceof interface native new non-sealed package permits private protected public record return sealed "
        "static strictfp super switch synchronized this throw throws transient try var volatile while yield when void int long short byte char boolean float double module requires exports opens to uses provides with open transitive non".split()
    ),
    "csharp": set(
        "abstract add alias and as ascending async await base by break case catch checked class const continue default delegate descending do dynamic else enum equals event explicit extern file finally fixed for foreach from get global goto group if implicit in "
        "init interface internal into is join let lock managed namespace new not notnull on operator or orderby out override params partial private protected public readonly record ref remove required return scoped sealed select set sizeof stackalloc static struct "
        "switch this throw try typeof unchecked unmanaged unsafe using var virtual volatile when where while with yield void int long short byte char bool float double decimal string object uint ulong ushort sbyte nint nuint".split()
    ),
    "rust": set(
        "as async await box break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type union unsafe use where while yield macro_rules auto default raw safe gen become".split()
    ),
}
# Words with which a top-level item may begin.
_ITEMS = {
    "java": set("package import public private protected abstract final static class interface enum record sealed non strictfp module open @ ; void int long short byte char boolean float double".split()),
    "go": set("package import func type var const ;".split()),
    "rust": set("use mod fn pub struct enum impl trait const static type extern macro_rules unsafe async union auto default safe # ; crate".split()),
    "csharp": set("using namespace class public internal private protected static sealed abstract partial interface enum record struct readonly delegate extern global file unsafe ref [ @ ; new await var if for foreach while return try throw int string bool".split()),
}
_NEEDS_MORE = set("= + - * / % & | ^ ! ~ < ? : . , @ -> => := <- :: ?. ?? ... && ||".split())


class _Broken(Exception):
    """A fault at a place of the text."""

    def __init__(self, reason: str, at: int):
        self.reason, self.at = reason, at


# What follows within a literal, by what is on top of the stack; its end, and the end of the literal.
_PARTS = {
    "`": (re.compile(r"(?:[^\\`$]|\\[\s\S]|\$(?!\{))*"), "`"),
    '$"': (re.compile(r'(?:[^\\"{}\n]|\\.|\{\{|\}\})*'), '"'),
    '$@"': (re.compile(r'(?:[^"{}]|""|\{\{|\}\})*'), '"'),
    '$"""': (re.compile(r'(?:[^"{}]|"(?!""))*'), '"""'),
}
_INTERPOLATED = re.compile(r'(\$+)"""|\$@"|@\$"|\$"')
_NESTED_COMMENT = re.compile(r"/\*|\*/")
_MARKER = re.compile(r"(?m)^(?:<{7}|>{7}|={7}|\|{7})(?![<>=|])")
_TAG = re.compile(r"<(?:>|([A-Za-z][\w.:-]*)(?=[\s/>]))")
_IN_TAG = re.compile(r"(?:\s+|[A-Za-z_$@][\w.:$-]*|=|\"[^\"]*\"|'[^']*'|//[^\n]*|/\*[\s\S]*?\*/)*")
_TAG_TEXT = re.compile(r"[^<{]*")
_TAG_END = re.compile(r"</\s*[\w.:-]*\s*>")
_DIRECTIVE = re.compile(r"#\s*(\w+)")
#: Kinds that are literal on top of the stack: what follows isn't made of tokens.
_LITERAL = {*_PARTS, "<tag", "<text"}


def _literal(text: str, i: int, stack: list, out: list) -> int:
    """Go on from ``i`` inside the literal on top of the stack, up to its end or to an expression within it."""
    top, began = stack[-1][:2]
    if top in _PARTS:
        part, end = _PARTS[top]
        i = part.match(text, i).end()
        if text.startswith(end, i):
            stack.pop()
            out.append(("str", end, i, len(stack), False))
            return i + len(end)
        if i >= len(text) or top != "`" and text[i] != "{":
            raise _Broken("unterminated literal", began)
        out.append(("op", "${", i, len(stack), False))
        stack.append(("${", i, False))
        return i + (2 if top == "`" else 1)
    if top == "<tag":
        i = _IN_TAG.match(text, i).end()
        if text.startswith("/>", i) or text.startswith(">", i):
            stack.pop()
            if text[i] == ">":
                stack.append(("<text", began, False))
                return i + 1
            out.append(("close", ">", i, len(stack), False))
            return i + 2
    else:
        i = _TAG_TEXT.match(text, i).end()
        if m := _TAG_END.match(text, i):
            stack.pop()
            out.append(("close", ">", i, len(stack), False))
            return m.end()
        if m := _TAG.match(text, i):
            stack.append(("<text" if m.group() == "<>" else "<tag", i, False))
            return m.end()
    if not text.startswith("{", i):
        raise _Broken("unterminated literal", began)
    out.append(("op", "${", i, len(stack), False))
    stack.append(("${", i, False))
    return i + 1


def _is_element(text: str, m: re.Match) -> bool:
    """Whether what looks like a tag is a JSX element and not a type in angle brackets: it is closed by name or by itself."""
    if m.group() == "<>":
        return "</>" in text[m.end() :]
    head = text[m.end() : text.find(">", m.end()) + 1]
    return head.endswith("/>") or f"</{m.group(1)}" in text[m.end() :] or head.count("{") > head.count("}") and "/>" in text[m.end() :]


def _tokens(text: str, language: str) -> list[tuple]:
    """(kind, text, place, depth, flag) of each token but space and comments; raises _Broken at the first fault.

    The stack holds opening delimiters, the literals that have expressions within them, and these expressions ("${").
    The flag is set on a parenthesis that closes the head of a statement, and on Rust tokens inside a macro call.
    """
    lexer = _LEXERS[language]
    js, cs, rust = language in ("typescript", "javascript"), language == "csharp", language == "rust"
    out: list[tuple] = []
    stack: list[tuple] = []  # (what, place, flag)
    branches: list[list] = []  # the stack at each open #if
    markers = {m.start() for m in _MARKER.finditer(text)} if language != "json" else set()
    i, n, add = 0, len(text), out.append
    while i < n:
        if stack and stack[-1][0] in _LITERAL:
            i = _literal(text, i, stack, out)
            continue
        depth, macro = len(stack), rust and bool(stack) and stack[-1][2]
        for m in lexer.finditer(text, i):
            kind = m.lastgroup
            if kind == "space":
                continue
            at, tok = m.start(kind), m.group(kind)
            if markers and at in markers and kind != "comment":
                raise _Broken("merge-conflict marker", at)
            if kind == "word" or kind == "num" or kind == "str":
                add((kind, tok, at, depth, macro))
            elif kind == "open":
                before = out[-1][1] if out else ""
                macro = rust and (macro or before == "!" or len(out) > 1 and out[-2][1] == "!")
                add((kind, tok, at, depth, False))
                stack.append((tok, at, macro or js and tok == "(" and before in ("if", "for", "while", "with")))
                depth += 1
            elif kind == "close":
                top = stack[-1] if stack else ("", at, False)
                if tok == "}" and top[0] == "${":
                    stack.pop()
                    if stack[-1][0] in _LITERAL:
                        i = m.end()
                        break
                    depth -= 1
                elif _CLOSER.get(top[0]) != tok:
                    raise _Broken("unbalanced delimiter", at)
                else:
                    stack.pop()
                    depth -= 1
                    macro = rust and bool(stack) and stack[-1][2]
                    add((kind, tok, at, depth, top[2]))
            elif kind == "comment":
                if cs and tok[0] == "#":
                    word = _DIRECTIVE.match(tok).group(1)
                    if word == "if":
                        branches.append(list(stack))
                    elif word in ("else", "elif") and branches:
                        stack[:] = branches[-1]
                    elif word == "endif" and branches:
                        branches.pop()
                    depth = len(stack)
            elif kind == "stray" or kind == "end":
                if kind == "stray":
                    raise _Broken("unterminated literal" if tok in "\"'" else "character that belongs to no token", at)
            elif tok == "/" and text.startswith("/*", at):
                i = _after_comment(text, at) if rust else -1  # block comments nest in Rust
                if i < 0:
                    raise _Broken("unterminated literal", at)
                break
            elif js and tok == "`":
                stack.append(("`", at, False))
                i = at + 1
                break
            elif cs and tok in "$@" and (s := _INTERPOLATED.match(text, at)):
                stack.append(('$"""' if s.group(1) else '$@"' if "@" in s.group() else '$"', at, False))
                i = s.end()
                break
            elif cs and tok == ":" and stack and stack[-1][0] == "${":  # the format of an interpolation
                i = text.find("}", at)
                if i < 0:
                    raise _Broken("unterminated literal", at)
                break
            elif js and tok in "/<" and (r := _operand(text, at, tok, out)):
                if tok == "<":
                    stack.append(("<text" if r.group() == "<>" else "<tag", at, False))
                else:
                    add(("str", r.group(), at, depth, False))
                i = r.end()
                break
            else:
                add((kind, tok, at, depth, False))
        else:
            i = n
    if stack:
        raise _Broken("unterminated literal" if stack[-1][0] not in "([{" else "delimiter left open", stack[-1][1])
    return out


def _after_comment(text: str, at: int) -> int:
    """The place after the nested block comment that begins at ``at``, or -1."""
    depth = 0
    for c in _NESTED_COMMENT.finditer(text, at):
        depth += 1 if c.group() == "/*" else -1
        if not depth:
            return c.end()
    return -1


def _operand(text: str, at: int, tok: str, out: list) -> re.Match | None:
    """The regular expression or the tag that begins at a slash or an angle bracket, where an operand is due; else None."""
    p = out[-1] if out else ("", "", 0, 0, False)
    asserted = p[1] == "!" and len(out) > 1 and out[-2][0] in ("word", "close") and out[-2][2] + len(out[-2][1]) == p[2]
    due = not asserted and p[0] not in ("num", "str", "close") and not (p[0] == "word" and p[1] not in _TS_REGEX_AFTER)
    due = due or p[1] == ")" and p[4]
    if tok == "<":
        m = _TAG.match(text, at)
        return m if due and m and _is_element(text, m) else None
    if not due:
        return None
    r = _REGEX.match(text, at)
    if not r and not (p[0] == "op" and p[1] == "<"):
        raise _Broken("unterminated literal", at)
    return r


def _other_language(toks: list[tuple], text: str, language: str) -> None:
    """Raise where a top-level item begins with a word its language doesn't know."""
    items = _ITEMS.get(language)
    if items is None or not toks:
        return
    begin, closed = True, False
    for k, (kind, tok, at, depth, _) in enumerate(toks):
        if depth == 0 and kind != "close":
            fresh = begin
            if language == "go" and k and "\n" in text[toks[k - 1][2] : at] and toks[k - 1][0] != "op":
                fresh = True
            if closed and language != "go" and tok not in (";", ",", ".", "=", "(", "where", "else", "catch", "finally", "throws", "{", "?", "->", "=>", "extends", "implements", "permits", "while", "default"):
                fresh = True
            if fresh and tok not in items and not (language == "rust" and kind == "word" and k + 1 < len(toks) and toks[k + 1][1] in ("!", "::")) and not (closed and language == "java" and kind == "word"):
                if not (language == "csharp" and kind == "word" and _calls(toks, k)):
                    raise _Broken("text of another language", at)
            begin = tok == ";"
            closed = False
        elif depth == 0 and kind == "close":
            closed = tok == "}"
    if language == "go" and toks[0][1] != "package":
        raise _Broken("text of another language", toks[0][2])


def _calls(toks: list, k: int) -> bool:
    """Whether a C# top-level statement is a call, an assignment or a declaration."""
    nxt = toks[k + 1][1] if k + 1 < len(toks) else ""
    return nxt in (".", "(", "=", "<", "[", "?") or (k + 2 < len(toks) and toks[k + 1][0] == "word" and toks[k + 2][1] in ("=", ";", "("))


def _beside(toks: list[tuple], text: str, language: str) -> None:
    """Raise where two operands stand side by side with no operator between them."""
    js = language in ("typescript", "javascript")
    if not js and language not in _KEYWORDS:
        return
    joins = _TS_JOIN if js else _KEYWORDS[language]
    run = 0
    for k in range(1, len(toks)):
        (ka, a, pa_, _, head), (kb, b, pb, _, macro) = toks[k - 1], toks[k]
        same_line = "\n" not in text[pa_:pb]
        if ka not in ("word", "num", "str", "close") or kb not in ("word", "num", "str"):
            run = 0
            continue
        if a in joins and ka == "word" or b in joins and kb == "word":
            run = 0
            continue
        if ka == "close":
            if js and same_line and a == "]" and kb != "word":
                raise _Broken("operands side by side", pb)
            if js and same_line and a == ")" and kb == "str" and b != "`" and not head:
                raise _Broken("operands side by side", pb)
            continue
        if js:
            if same_line and not (b == "`" and ka == "word") and not (a == "`" and b == "`"):
                raise _Broken("operands side by side", pb)
            if kb == "str" and b == "`":
                continue
        elif language == "rust":
            if a.startswith("'") or a == "union" or ka == "word" and k >= 2 and toks[k - 2][1] in ("!", "$"):
                continue
            if not macro:
                raise _Broken("operands side by side", pb)
        elif ka != "word" or kb != "word":
            if not (a == '"' or b == '"'):
                raise _Broken("operands side by side", pb)
        else:
            run += 1
            if run > 1:
                raise _Broken("operands side by side", pb)
            if k + 1 < len(toks) and toks[k + 1][1] not in ("=", ";", ",", "(", ")", ":", "[", "{", "->", "=>", "<", ".", "&", "|", "?", "in", "!", "]", ">", "}", "+") and toks[k + 1][1] not in joins:
                raise _Broken("operands side by side", toks[k + 1][2])


def _imported(toks: list[tuple], language: str) -> None:
    """Raise where an import or package clause of Java, TypeScript or JavaScript isn't complete."""
    for k, (kind, tok, at, depth, _) in enumerate(toks):
        if depth or kind != "word" or k and toks[k - 1][1] in (".", "@", "#"):
            continue
        rest = [t[1] for t in toks[k + 1 : k + 4]] + ["", "", ""]
        if language == "java" and tok in ("import", "package") and (k == 0 or toks[k - 1][1] in (";", ")", "}") or toks[k - 1][0] == "word"):
            j = k + 1
            while j < len(toks) and (toks[j][0] == "word" and toks[j][1] not in ("import", "package") or toks[j][1] in (".", "*")):
                j += 1
            if j == k + 1 or j == len(toks) or toks[j][1] not in (";", "{"):
                raise _Broken("import without its end", at)
        elif language != "java" and tok == "import" and toks[k + 1 : k + 2] and toks[k + 1][0] == "word" and rest[0] not in ("type", "defer", "source"):
            if rest[1] not in ("from", ",", "="):
                raise _Broken("import without its end", at)


def _ended(toks: list[tuple], language: str) -> None:
    """Raise where the last statement of a braced language is cut off."""
    if not toks:
        return
    kind, tok, at = toks[-1][:3]
    if tok in _NEEDS_MORE and not (tok == "!" and language == "typescript"):
        raise _Broken("premature end", at)
    if language in ("java", "csharp", "rust") and tok not in (";", "}") and not (tok == "]" and toks[0][1] in ("#", "[")):
        raise _Broken("premature end", at)
    start = len(toks) - 1  # the last top-level statement
    while start > 0 and not (toks[start - 1][3] == 0 and (toks[start - 1][1] == ";" or toks[start - 1][0] == "close" and toks[start - 1][1] == "}" and start - 1 != len(toks) - 1)):
        start -= 1
    head = [t for t in toks[start:] if t[3] == 0]
    words = [t[1] for t in head if t[0] == "word"]
    body = any(t[1] == "{" for t in head)
    if language in ("typescript", "javascript"):
        if kind == "word" and tok in _TS_JOIN and tok not in ("this", "super", "debugger", "break", "continue", "return", "default", "of", "type", "from", "as", "is", "get", "set", "async", "global", "module", "namespace", "package", "using"):
            raise _Broken("premature end", at)
        if {"class", "interface", "enum", "function"} & set(words[:4]) and not body and tok != ";":
            raise _Broken("premature end", at)
        if words[:1] == ["import"] and "from" not in words and head[-1][0] not in ("str", "close") and tok != ";":
            raise _Broken("premature end", at)
        if words[:1] in (["export"], ["import"]) and len(head) < 3 and not any(t[0] == "str" for t in head):
            raise _Broken("premature end", at)
        if words[-1:] == ["from"] and kind == "word":
            raise _Broken("premature end", at)
        if words and words[0] in ("const",) and not any(t[1] in ("=", "enum") for t in head) or words[:2] == ["export", "const"] and not any(t[1] in ("=", "enum") for t in head):
            raise _Broken("premature end", at)
    if language == "go":
        if kind == "word" and tok in ("func", "type", "var", "const", "import", "package", "struct", "interface", "map", "chan", "return", "range") and tok != "return":
            raise _Broken("premature end", at)
        last = max((k for k, t in enumerate(toks) if t[3] == 0 and t[1] in ("func", "type", "var", "const", "import")), default=None)
        if last is not None:
            rest = toks[last:]
            flat = [t for t in rest if t[3] == 0]
            if rest[0][1] == "func" and not any(t[0] == "open" and t[1] == "(" for t in flat):
                raise _Broken("premature end", at)
            if rest[0][1] == "func" and not any(t[1] == "{" for t in flat):
                raise _Broken("premature end", at)
            if rest[0][1] in ("type", "var", "const") and len(rest) < 3:
                raise _Broken("premature end", at)


_DECLARE = re.compile(r"\A(?:﻿)?\s*(?:<!DOCTYPE|<html|<\?xml|diff --git |version https://|--- a/|\+\+\+ b/|={1,6} \w|#{1,6} \w)", re.I)


# Words of Python that begin a block, and those that may stand beside an operand.
_PY_BLOCK = set("def class if elif else for while try except finally with async match case".split())
_PY_HEADS = _PY_BLOCK - {"match", "case", "async"}
_OPERANDS = ("word", "num", "str")
_PY_JOIN = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
# Words that end no line, and for words that go on a statement, those of the block before.
_PY_UNFINISHED = set("await and or not in is import lambda del async from assert".split())
_PY_AFTER = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}
_PY_MORE = set("= + - * / % & | ^ ~ < > . , @ := -> ** // !".split()) - {","}


def _laid_out(toks: list[tuple], text: str) -> None:
    """Raise where a line of Python is misplaced: open indents are the stack."""
    lines: list[list[tuple]] = []
    end, joined, line, was = 0, False, None, ("", "")
    for t in toks:
        kind, tok, at, depth, _ = t
        if kind == "op" and tok == "\\":
            joined, end = True, at + 1
            continue
        if line is None or depth == 0 and kind != "close" and not joined and text.find("\n", end, at) >= 0:
            line = []
            lines.append(line)
        elif kind in _OPERANDS and was[0] in _OPERANDS and not (kind == was[0] == "str") and tok not in _PY_JOIN and was[1] not in _PY_JOIN:
            raise _Broken("operands side by side", at)
        line.append(t)
        joined, end, was = False, at + len(tok), t
    indents, opened, heads = [""], False, [""]  # heads: the block that each level has just had
    for line in lines:
        first, last = line[0], line[-1]
        start = text.rfind("\n", 0, first[2]) + 1
        indent = text[start : first[2]].replace("\f", "")
        if indent.strip() == "":
            if opened:
                if len(indent) <= len(indents[-1]):
                    raise _Broken("block without lines", first[2])
                indents.append(indent)
                heads.append("")
            else:
                while len(indents) > 1 and len(indent) < len(indents[-1]):
                    indents.pop()
                    if heads.pop() == "try":
                        raise _Broken("block without its end", first[2])
                if indent != indents[-1]:
                    raise _Broken("indent that fits no block", first[2])
            goes_on = _PY_AFTER.get(first[1]) if first[0] == "word" else None
            if goes_on and heads[-1] not in goes_on or heads[-1] == "try" and not goes_on:
                raise _Broken("block without its end" if heads[-1] == "try" else "block without its head", first[2])
            heads[-1] = (line[1][1] if first[1] == "async" and len(line) > 1 else first[1]) if last[1] == ":" or first[1] in _PY_BLOCK else ""
        opened = last[1] == ":" and last[3] == 0
        if first[0] == "word" and first[1] in _PY_HEADS and not any(t[1] == ":" and t[3] == 0 for t in line):
            raise _Broken("head of a block without colon", first[2])
        if last[0] == "word" and last[1] in _PY_UNFINISHED and last[3] == 0:
            raise _Broken("premature end", last[2])
        if last[0] == "op" and last[1] in _PY_MORE and not (last[1] == "*" and first[1] == "from"):
            raise _Broken("premature end", last[2])
        if first[0] == "op" and first[1] not in ("@", "-", "+", "~", "*", "..."):
            raise _Broken("line that begins with an operator", first[2])
    if opened or "try" in heads:
        raise _Broken("premature end", len(text) - 1)


_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _json(text: str) -> None:
    """Raise where a text isn't one JSON value: open objects and arrays are the stack."""
    stack: list[str] = []
    due, i, n = "value", 0, len(text)
    while True:
        while i < n and text[i] in " \t\r\n":
            i += 1
        if i >= n:
            break
        c = text[i]
        if due == "end":
            raise _Broken("text after the value", i)
        if due in ("value", "value or ]") and c in "{[":
            stack.append(c)
            due, i = "key or }" if c == "{" else "value or ]", i + 1
        elif c in "}]":
            if not stack or _CLOSER[stack[-1]] != c or due not in (", or end", "key or }", "value or ]"):
                raise _Broken("unbalanced delimiter", i)
            stack.pop()
            due, i = ", or end" if stack else "end", i + 1
        elif due == ", or end":
            if c != ",":
                raise _Broken("operands side by side", i)
            due, i = "key" if stack[-1] == "{" else "value", i + 1
        elif due == ":":
            if c != ":":
                raise _Broken("key without value", i)
            due, i = "value", i + 1
        else:
            m = _LEXERS["json"].match(text, i) if c in '"tfn' else _JSON_NUMBER.match(text, i)
            if not m or m.lastgroup == "stray" or due.startswith("key") and c != '"' or m.lastgroup == "word" and m.group("word") not in ("true", "false", "null"):
                raise _Broken("unterminated literal" if c == '"' and m.lastgroup == "stray" else "not a value", i)
            if due.startswith("key"):
                due = ":"
            else:
                due = ", or end" if stack else "end"
            i = m.end()
    if due != "end":
        raise _Broken("delimiter left open" if stack else "premature end", max(0, n - 1))


def fault(source: str, language: str) -> tuple[str, int] | None:
    """(reason, line) of the first fault of ``source``, or None if it is sound or its language isn't known."""
    if language not in _LEXERS:
        return None
    text = source[1:] if source.startswith("﻿") else source
    found = None
    try:
        if language == "json":
            _json(text)
        else:
            toks = _tokens(text, language)
            if language == "python":
                _laid_out(toks, text)
            else:
                if toks and _DECLARE.match(text) and not (language == "csharp" and text.lstrip().startswith("#")):
                    raise _Broken("text of another language", 0)
                _other_language(toks, text, language)
                if language in ("java", "typescript", "javascript"):
                    _imported(toks, language)
                _beside(toks, text, language)
                _ended(toks, language)
    except _Broken as x:
        found = x.reason, text.count("\n", 0, x.at) + 1
    return _second_opinion(text, found) if language == "python" else found


def _second_opinion(text: str, found: tuple[str, int] | None) -> tuple[str, int] | None:
    """What Python's own parser makes of a source that the stack has judged; sources beyond its limits stay as judged."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as x:
        return found or ("does not parse", x.lineno or 1) if "too many" not in str(x) else found
    except (ValueError, RecursionError, MemoryError):
        return found
    return None


def language_of(language_id: Column, path: Column) -> Column:
    """The language of a row: language_id in lower case, or the language of the path's extension."""
    ext = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    named = F.lower(F.trim(language_id))
    named = F.coalesce(F.try_element_at(alias, named), named)
    return F.coalesce(named, F.try_element_at(ext, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))))


def source_faults(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, repo, language, reason, line) of every row of ``cases``; reason and line are null for sound sources.

    A null source and a source of an unknown language have no fault; an empty JSON source has one, an empty source of
    another language none. Repeated rows stay; extra columns are ignored.
    """

    def run(batches):
        for b in batches:
            found = [fault(s, lg) if s is not None and lg else None for s, lg in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            reason = pa.array([f and f[0] for f in found], pa.string())
            line = pa.array([f and f[1] for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), reason, line], names=[key, "repo", "language", "reason", "line"])

    kind = cases.schema[key].dataType.simpleString()
    given = cases.select(key, "repo", language_of(F.col("language_id"), F.col("path")).alias("language"), "source")
    return given.mapInArrow(run, f"{key} {kind}, repo string, language string, reason string, line int")


def fault_rates(faults: DataFrame) -> DataFrame:
    """(repo, language, files, broken, rate) per repository and language; null repos and languages are groups."""
    broken = F.count_if(F.col("reason").isNotNull())
    return faults.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), broken.alias("broken"), (broken / F.count(F.lit(1))).alias("rate"))
