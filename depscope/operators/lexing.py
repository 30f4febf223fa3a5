"""Tokens of a source text in one pass, with a stack of modes, and the scopes that its brackets make.

Text is Latin-1: a character is a byte, so places are byte offsets. Literals and comments are
matched without backtracking; a template literal's ${...} is code again until its brace closes. Every
step is linear in the text, however deep it nests and whether or not its brackets close.
"""

from __future__ import annotations

import re

ID = r"[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*"
_IS_NAME = re.compile(ID)
_BLANK, _NUMBER = r"[ \t\r\f\v\n]++", r"[0-9][0-9A-Za-z_]*+(?:\.[0-9][0-9A-Za-z_]*+)?"
_OPS = r"=>|\?\.|::|->|."
#: What begins a token that is neither name, number nor sign, by language.
_SHAPES = {
    "typescript": {"comment": r"//[^\n]*+", "block": r"/\*", "template": "`", "quote": "[\"']"},
    "python": {"comment": r"#[^\n]*+", "quote": "\"\"\"|\'\'\'|[\"']"},
    "go": {"comment": r"//[^\n]*+", "block": r"/\*", "raw": "`", "quote": "[\"']"},
    "rust": {"comment": r"//[^\n]*+", "block": r"/\*", "raw": 'b?r#*+"', "char": r"'(?:\\[^\n']{1,9}+|\\'|[^'\\\n\x80-\xff]|[\x80-\xff]{2,4}+)'", "lifetime": f"'{ID}", "quote": '"'},
}
_MASTER = {
    lang: re.compile("|".join([f"(?P<blank>{_BLANK})", *[f"(?P<{k}>{v})" for k, v in shapes.items()], f"(?P<name>{ID})|(?P<number>{_NUMBER})|(?P<op>{_OPS})"]), re.DOTALL)
    for lang, shapes in _SHAPES.items()
}
#: Contents of a literal by its quote; Rust's go over lines.
_BODY = {
    '"': re.compile(r'(?:[^"\\\n]++|\\.)*+', re.DOTALL), "'": re.compile(r"(?:[^'\\\n]++|\\.)*+", re.DOTALL),
    '"""': re.compile(r'(?:[^"\\]++|\\.|"(?!""))*+', re.DOTALL), "'''": re.compile(r"(?:[^'\\]++|\\.|'(?!''))*+", re.DOTALL),
}
_LINES = re.compile(r'(?:[^"\\]++|\\.)*+', re.DOTALL)
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[A-Za-z]*+")
_NEST = re.compile(r"/\*|\*/")
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Words after which a slash begins a regular expression, and before whose closing parenthesis it does.
_BEFORE_REGEX = frozenset("return typeof case in of delete void instanceof new do else yield await throw".split())
_HEADS = frozenset("if while for with".split())


class Tokens:
    """Tokens of a text: text[k] (a literal's is its quote), start[k], end[k], fresh[k]: whether a line begins before it.

    partner[k]: the bracket that closes or opens k, len(text) if none closes it, -1 for other tokens.
    inside[k]: the innermost bracket that is open at k, or -1. strings: the literals' contents.
    """

    def __init__(self, src: str, lang: str):
        self.lang, self.src = lang, src
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.fresh: list[bool] = []
        self.partner: list[int] = []
        self.inside: list[int] = []
        self.strings: dict[int, str] = {}
        self._stack: list[int] = []
        self._many = {"(": 0, "[": 0, "{": 0}
        self._line = True
        self._read()
        for k in self._stack:
            self.partner[k] = len(self.text)

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.text) and _IS_NAME.match(self.text[k]) is not None and k not in self.strings

    def at(self, k: int) -> str:
        """Text of token k; empty outside."""
        return self.text[k] if 0 <= k < len(self.text) else ""

    def after(self, opening: int) -> int:
        """The token after the bracket that closes opening."""
        return self.partner[opening] + 1

    def _add(self, text: str, start: int, end: int) -> int:
        k = len(self.text)
        self.text.append(text)
        self.start.append(start)
        self.end.append(end)
        self.fresh.append(self._line)
        self.partner.append(-1)
        self.inside.append(self._stack[-1] if self._stack else -1)
        self._line = False
        return k

    def _open(self, k: int) -> None:
        self._stack.append(k)
        self._many[self.text[k][-1]] += 1

    def _close(self, k: int) -> str:
        """Pairs a closing bracket with the nearest opening one of its kind; those opened since stay open up to it. Text of the opening one."""
        want = _CLOSES[self.text[k]]
        if not self._many[want]:
            return ""
        while True:
            top = self._stack.pop()
            self._many[self.text[top][-1]] -= 1
            self.partner[top] = k
            if self.text[top][-1] == want:
                self.partner[k] = top
                self.inside[k] = self.inside[top]
                return self.text[top]

    def _block_end(self, at: int) -> int:
        """End of the comment that begins at; in Rust comments nest."""
        if self.lang != "rust":
            end = self.src.find("*/", at + 2)
            return len(self.src) if end < 0 else end + 2
        depth = 0
        for m in _NEST.finditer(self.src, at):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(self.src)

    def _template(self, at: int) -> int:
        """From inside a template literal to behind its end, or to behind the ${ that makes it code again."""
        end = _TEMPLATE.match(self.src, at).end()
        if self.src.startswith("${", end):
            self._open(self._add("${", end, end + 2))
            return end + 2
        self._add("`", at, min(end + 1, len(self.src)))
        return end + 1

    def _regex_fits(self) -> bool:
        last = self.at(len(self.text) - 1)
        if last == ")":
            return self.at(self.partner[-1] - 1) in _HEADS
        if last in _BEFORE_REGEX:
            return self.at(len(self.text) - 2) not in (".", "?.")
        return last not in ("]", "<") and not (self.text and (self.is_name(len(self.text) - 1) or last[:1].isdigit() or len(self.text) - 1 in self.strings or last == "`"))

    def _literal(self, quote: str, at: int) -> int:
        """End of the literal that begins at; a quote that nothing closes is a sign, and so are others of its kind up to where the search ended."""
        if at >= self._dead.get(quote, 0):
            end = (_LINES if self.lang == "rust" else _BODY[quote]).match(self.src, at + len(quote)).end()
            if self.src.startswith(quote, end):
                self.strings[self._add('"', at, end + len(quote))] = self.src[at + len(quote) : end]
                return end + len(quote)
            self._dead[quote] = end
        self._add(quote[0], at, at + 1)
        return at + 1

    def _regex(self, at: int) -> int:
        """End of the regular expression that begins at, or at if there is none."""
        if at < self._dead.get("/", 0) or not self._regex_fits():
            return at
        m = _REGEX.match(self.src, at)
        if m:
            self.strings[self._add('"', at, m.end())] = ""
            return m.end()
        end = self.src.find("\n", at)
        self._dead["/"] = len(self.src) if end < 0 else end
        return at

    def _read(self) -> None:
        src, find, at = self.src, _MASTER[self.lang].match, 0
        self._dead: dict[str, int] = {}
        while at < len(src):
            m = find(src, at)
            kind, text, end = m.lastgroup, m[0], m.end()
            if kind == "blank" or kind == "comment":
                self._line = self._line or "\n" in text
            elif kind == "block":
                end = self._block_end(at)
                self._line = self._line or "\n" in src[at:end]
            elif kind == "template":
                end = self._template(end)
            elif kind == "raw":
                close = '"' + "#" * text.count("#") if self.lang == "rust" else "`"
                stop = src.find(close, end)
                end = len(src) if stop < 0 else stop + len(close)
                self._add("`", at, end)
            elif kind == "quote":
                end = self._literal(text, at)
            elif kind == "char":
                self._add("`", at, end)
            elif kind == "op":
                stop = self._regex(at) if text == "/" and self.lang == "typescript" else at
                if stop > at:
                    end = stop
                else:
                    k = self._add(text, at, end)
                    if text in "([{":
                        self._open(k)
                    elif text in ")]}" and self._close(k) == "${":
                        end = self._template(end)
            elif kind != "lifetime":
                self._add(text, at, end)
            at = end

    def stops(self) -> list[int]:
        """For each token the next one from it on, at its level, that is a brace, a semicolon or a closing bracket; len(text) if none is."""
        n = len(self.text)
        out = [n] * (n + 1)
        for k in range(n - 1, -1, -1):
            t = self.text[k]
            if t in "{;)]}" or t == "${":
                out[k] = k
            elif t in "([":
                out[k] = out[min(self.after(k), n)]
            else:
                out[k] = out[k + 1]
        return out


def generics_start(t: Tokens, k: int) -> int:
    """The token before <...> whose closing angle is k, or k if there are none. A parenthesis ends the search, so all searches of a text read it once."""
    depth, j = 0, k
    while j >= 0 and t.text[j] not in "(){};":
        depth += (t.text[j] == ">") - (t.text[j] == "<")
        if not depth:
            return j - 1
        j -= 1
    return k


def body_of(t: Tokens, k: int, words: frozenset[str] = frozenset()) -> int:
    """The first brace after k that is outside <...> and other brackets; -1 if a semicolon, a closing bracket or one of words comes first."""
    depth = 0
    while k < len(t.text):
        x = t.text[k]
        if x == "{" and depth <= 0:
            return k
        if x in ";)]}" or x in words:
            return -1
        depth += (x == "<") - (x == ">")
        k = t.after(k) if x in "([{" else k + 1
    return -1
