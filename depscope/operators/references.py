"""Calls and imports in the token stream of a source text, by the rules of four languages."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator

from depscope.operators.lexing import Tokens, body_of, generics_start

#: Words before a parenthesis that are no names, unless a dot stands before them.
KEYWORDS = {
    "typescript": "if for while switch catch return typeof await void delete instanceof case throw yield do else function import super with new",
    "python": "if elif while for in and or not is return lambda yield assert del await raise from import except with else def class",
    "go": "if for switch select return go defer range func map chan interface struct case var const type import",
    "rust": "if while for match return in let loop fn move else where impl pub unsafe as mut ref use",
}
_WORDS = {lang: frozenset(words.split()) for lang, words in KEYWORDS.items()}
#: Operators that are also names, by what stands before them; words before the name of a member.
_BETWEEN = frozenset("of in as is satisfies extends keyof asserts implements".split())
_MODIFIERS = frozenset("public private protected static async override readonly abstract get set declare accessor * #".split())
_HEADS = frozenset("class interface function".split())
_STARTS = _HEADS | {"type"}
_RUST_HEADS = frozenset("enum fn struct impl trait mod".split())
Found = tuple[str, str]


def _chain(t: Tokens, k: int, dots: tuple[str, ...] = (".",)) -> int:
    """First name of the chain a.b.c that ends in name k."""
    while t.at(k - 1) in dots and t.is_name(k - 2):
        k -= 2
    return k


def _ends_operand(t: Tokens, k: int) -> bool:
    return k >= 0 and (k in t.strings or t.text[k] in (")", "]", "}", "`") or t.text[k][0].isdigit() or t.is_name(k) and t.text[k] not in _WORDS["typescript"])


def type_bodies(t: Tokens) -> set[int]:
    """Braces that hold the members of a class, an interface or an object type."""
    out = set()
    for k, word in enumerate(t.text):
        if word not in ("class", "interface", "type") or t.at(k - 1) in (".", "?.") or k in t.strings:
            continue
        named = t.is_name(k + 1)
        if word == "type":
            j = k + 2
            if named and t.at(j) == "<":
                depth = 0
                while j < len(t.text) and t.text[j] not in "=;{}" and t.text[j] not in _STARTS:
                    depth += (t.text[j] == "<") - (t.text[j] == ">")
                    j += 1
                    if not depth:
                        break
            if named and t.at(j) == "=":
                j += 1
                while t.at(j) in ("|", "&", "{"):
                    if t.text[j] == "{":
                        out.add(j)
                        j = t.partner[j]
                    j += 1
        elif named or word == "class":
            brace = body_of(t, k + 1, _HEADS)
            if brace >= 0:
                out.add(brace)
    return out


def _member_start(t: Tokens, k: int) -> bool:
    """Whether name k can begin a member of what is inside the braces around it."""
    if t.inside[k] < 0 or t.text[t.inside[k]] != "{":
        return False
    while t.at(k - 1) in _MODIFIERS and not (t.fresh[k] and t.text[k - 1] not in ("*", "#")):
        k -= 1
    return t.at(k - 1) in ("{", ";", "}", ",") or t.fresh[k] and (_ends_operand(t, k - 1) or t.at(k - 1) == "void")


def typescript(t: Tokens) -> Iterator[Found]:
    """Calls f(...), f<T>(...), f?.(...), a.f(...); no declaration, signature, keyword or new X. Paths of import statements with a dot first or a slash."""
    bodies = type_bodies(t)
    for k, sign in enumerate(t.text):
        if k in t.strings:
            continue
        if sign == "import" and t.at(k - 1) not in (".", "?.") and t.at(k + 1) not in ("(", "."):
            j = k + 1
            while j not in t.strings and (t.is_name(j) or t.at(j) in ("{", "}", ",", "*")) and t.at(j) != "import":
                j += 1
            if j in t.strings and (j == k + 1 or t.text[j - 1] == "from") and (t.strings[j].startswith(".") or "/" in t.strings[j]):
                yield "import", t.strings[j]
        if sign != "(":
            continue
        j = k - 1
        if t.at(j) == "?.":
            j -= 1
        if t.at(j) == ">":
            j = generics_start(t, j)
        if not t.is_name(j):
            continue
        name, lead, after = t.text[j], t.at(j - 1), t.at(t.after(k))
        if lead not in (".", "?."):
            if name in _WORDS["typescript"] or lead == "function" or lead == "*" and t.at(j - 2) == "function":
                continue
            if name in _BETWEEN and _ends_operand(t, j - 1) and not t.fresh[j] and not (name == "of" and lead == ")") or name == "async" and after == "=>":
                continue
            if _member_start(t, j) and (t.inside[j] in bodies or after == "{" or after == ":"):
                continue
        if t.at(_chain(t, j) - 1) != "new":
            yield "call", name


def _python_tree(src: bytes) -> Iterator[Found]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(src)
    found: list[tuple[int, int, int, str, str]] = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute):
            found.append((n.lineno, n.col_offset, 0, "call", n.func.id if isinstance(n.func, ast.Name) else n.func.attr))
        elif isinstance(n, ast.Import):
            found += [(n.lineno, n.col_offset, k, "import", a.name) for k, a in enumerate(n.names)]
        elif isinstance(n, ast.ImportFrom):
            found.append((n.lineno, n.col_offset, 0, "import", "." * n.level + (n.module or "")))
    for *_, kind, name in sorted(found):
        yield kind, name.encode().decode("latin-1")


def _dotted(t: Tokens, k: int) -> tuple[str, int]:
    """The dotted name from token k on, and the token after it."""
    out = ""
    while t.at(k) == "." or t.is_name(k) and t.text[k] != "import" and (not out or out.endswith(".")):
        out += t.text[k]
        k += 1
    return out, k


def _python_tokens(t: Tokens) -> Iterator[Found]:
    """For text that is no valid Python: the same by tokens; strings are not looked into."""
    for k, sign in enumerate(t.text):
        if k in t.strings:
            continue
        first = k == 0 or t.fresh[k]
        if first and sign == "import":
            while True:
                name, k = _dotted(t, k + 1)
                if name:
                    yield "import", name
                if t.at(k) == "as":
                    k += 2
                if t.at(k) != ",":
                    break
        elif first and sign == "from":
            name, j = _dotted(t, k + 1)
            if name and t.at(j) == "import":
                yield "import", name
        elif sign == "(" and t.is_name(k - 1):
            name, lead = t.text[k - 1], t.at(k - 2)
            soft = name in ("match", "case") and (k == 1 or t.fresh[k - 1]) and t.at(t.after(k)) == ":"
            if lead == "." or name not in _WORDS["python"] and lead not in ("def", "class") and not soft:
                yield "call", name


def python(src: str) -> Iterator[Found]:
    """Calls of names and attributes, inside f-strings too; each module of import, the module of from with its dots."""
    try:
        yield from list(_python_tree(src.encode("latin-1")))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _python_tokens(Tokens(src, "python"))


def go(t: Tokens) -> Iterator[Found]:
    """Calls f(...), f[T](...), p.F(...); no function heads and no methods of interface types. Quoted paths of import declarations."""
    kinds = {k + 1 for k, w in enumerate(t.text) if w == "interface" and t.at(k + 1) == "{"}
    for k, sign in enumerate(t.text):
        if k in t.strings:
            continue
        if sign == "import" and t.inside[k] < 0:
            if t.at(k + 1) == "(":
                yield from (("import", t.strings[j]) for j in range(k + 2, min(t.partner[k + 1], len(t.text))) if j in t.strings)
            else:
                j = k + 1 if k + 1 in t.strings else k + 2
                if j in t.strings:
                    yield "import", t.strings[j]
        if sign != "(":
            continue
        j = k - 1
        if t.at(j) == "]" and t.partner[j] >= 0:
            j = t.partner[j] - 1
        if not t.is_name(j):
            continue
        lead = t.at(j - 1)
        if lead != ".":
            method = lead == ")" and t.partner[j - 1] > 0 and t.text[t.partner[j - 1] - 1] == "func"
            signature = t.inside[j] in kinds and t.fresh[j] or t.inside[j] in kinds and lead in ("{", ";")
            if t.text[j] in _WORDS["go"] or lead == "func" or method or signature:
                continue
        yield "call", t.text[j]


#: What stands before a pattern of an arm.
_ARM = ("{", ",", "}", "|")


def _no_calls(t: Tokens) -> dict[int, int]:
    """First and last token of stretches of Rust that hold no calls: arguments of macros, attributes, bodies of enums, patterns."""
    out: dict[int, int] = {}
    arms: dict[int, bool] = {}
    for k, sign in enumerate(t.text):
        if sign == "!" and t.is_name(k - 1) and t.at(k + 1) in ("(", "[", "{"):
            out[k + 1] = t.partner[k + 1]
        elif sign == "#" and (t.at(k + 1) == "[" or t.at(k + 1) == "!" and t.at(k + 2) == "["):
            j = k + 1 if t.text[k + 1] == "[" else k + 2
            out[j] = t.partner[j]
        elif sign == "enum" and t.is_name(k + 1):
            j = body_of(t, k + 2, _RUST_HEADS)
            if j >= 0:
                out[j] = t.partner[j]
        elif sign == "(" and t.is_name(k - 1):
            first = _chain(t, k - 1, ("::",)) - 1
            lead = t.at(first - 1) if t.at(first) == "&" else t.at(first)
            if lead in ("let", "for") or lead in _ARM and _ends_pattern(t, k, arms):
                out[k - 1] = t.partner[k]
    return out


def _ends_pattern(t: Tokens, k: int, arms: dict[int, bool]) -> bool:
    """Whether the bracket k is the pattern of an arm, or one of several with | between. arms: brackets that are known already."""
    seen = []
    while k not in arms:
        seen.append(k)
        j = t.after(k)
        if t.at(j) != "|" or not t.is_name(j + 1):
            arms[k] = t.at(j) in ("=>", "if")
            break
        j += 2
        while t.at(j) == "::":
            j += 2
        if t.at(j) == "(":
            k = j
        else:
            arms[k] = t.at(j) == "=>"
    for b in seen:
        arms[b] = arms[k]
    return arms[k]


def rust(t: Tokens) -> Iterator[Found]:
    """Calls f(...), a.f(...), T::f(...), none in the arguments of macros; first segments of use but self, super and crate, names of mod x;"""
    skip, until = _no_calls(t), -1
    for k, sign in enumerate(t.text):
        if k in skip:
            until = max(until, skip[k])
        if sign == "use" and k > until:
            j = k + 2 if t.at(k + 1) == "::" else k + 1
            if t.is_name(j) and t.text[j] not in ("self", "super", "crate"):
                yield "import", t.text[j]
        elif sign == "mod" and t.is_name(k + 1) and t.at(k + 2) == ";" and k > until:
            yield "import", t.text[k + 1]
        elif sign == "(" and t.is_name(k - 1) and k > until:
            name, lead = t.text[k - 1], t.at(k - 2)
            if lead in (".", "::") or name not in _WORDS["rust"] and lead not in ("fn", "struct", "union") and name not in ("Fn", "FnMut", "FnOnce"):
                yield "call", name


#: (kind, name) pairs of a Latin-1 text in order, by language.
READERS: dict[str, Callable[[str], Iterator[Found]]] = {
    "typescript": lambda s: typescript(Tokens(s, "typescript")),
    "python": python,
    "go": lambda s: go(Tokens(s, "go")),
    "rust": lambda s: rust(Tokens(s, "rust")),
}
