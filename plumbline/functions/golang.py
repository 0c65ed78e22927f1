"""Reading Go source without a Go compiler: a tokenizer with automatic semicolons, declarations, and walks over bodies.

Only what text can tell is offered: declarations, calls, branches, executable statements, table cases and mutants. Results
that need type checking are not attempted. Broken source yields what could be read before the break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

#: Go keywords, and tokens after which a line end becomes a semicolon.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset({"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"})
_TOKEN = re.compile(
    r"[ \t\r]*+(?:(?P<word>[^\W\d]\w*+)|(?P<line>\n)|(?P<mark>[()\[\]{},;])|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)|(?P<rune>'(?:\\.|[^'\\\n])+')"
    r"|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)|\Z)", re.S)


class Token(NamedTuple):
    kind: str  # word, number, string, rune, op, end
    text: str
    start: int
    line: int


class _Pieces(dict):
    """Of a piece of source, blanks and what follows them: kind (None for line ends and comments), text, blanks, length, line
    ends, and whether a line end after it becomes a semicolon. Source repeats its pieces, so each is looked into once."""

    MOST, LONGEST = 1 << 16, 80

    def __missing__(self, piece: str) -> tuple:
        m = _TOKEN.match(piece)
        kind = m.lastgroup
        text = m[kind] if kind else ""
        kind = "op" if kind == "mark" else kind
        ends = kind not in ("word", "op") or text in _ENDS or kind == "word" and text not in KEYWORDS
        found = ("end" if text == ";" else None if kind in ("line", "comment") else kind, text, len(piece) - len(text), len(piece), text.count("\n"), ends)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = found
        return found


_PIECE, _PIECES = re.compile(re.sub(r"\(\?P<\w+>", "(?:", _TOKEN.pattern), re.S), _Pieces()


def tokenize(source: str, line: int = 1) -> list[Token]:
    """line: number of the first."""
    out: list[Token] = []
    add, new = out.append, tuple.__new__
    at, ends = 0, False  # ends: whether a line end here becomes a semicolon
    for kind, text, blanks, length, breaks, last in map(_PIECES.__getitem__, _PIECE.findall(source)):
        if kind is not None:
            add(new(Token, (kind, text, at + blanks, line)))
            ends = last
        elif breaks and ends:
            add(new(Token, ("end", ";", at + blanks, line)))
            ends = False
        line += breaks
        at += length
    if ends:
        add(Token("end", ";", len(source), line))
    return out


_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")


def match_brackets(tokens: list[Token]) -> dict[int, int]:
    """Index of an opening bracket -> index of its closing one."""
    out, stack = {}, []
    for i, text in [(i, t[1]) for i, t in enumerate(tokens) if t[1] in _BRACKETS]:
        if text in _CLOSE:
            stack.append(i)
        elif stack and _CLOSE[tokens[stack[-1]].text] == text:
            out[stack.pop()] = i
    return out


#: Characters of a piece of a file that is read by itself, and tokens that a piece may have where a longer text has others.
PIECE, _TORN = 1 << 14, frozenset("`\"'/")


def _whole(text: str, tokens: list[Token]) -> bool:
    """Whether what follows a text that ends with a line of } is read as if it stood alone: no bracket, string or comment is open."""
    stack = []
    for kind, mark, start, _ in [t for t in tokens if t[1] in _BRACKETS or t[1] in _TORN]:
        if mark in _TORN:
            if mark != "/" or text.startswith("*", start + 1):
                return False
        elif mark in _CLOSE:
            stack.append(_CLOSE[mark])
        elif not stack or stack.pop() != mark:
            return False
    return not stack and len(tokens) > 1 and tokens[-2].text == "}" and tokens[-1].kind == "end"


def sources(text: str, size: int = PIECE) -> Iterator[Source]:
    """The declarations of a file in pieces of about `size` characters, so that a task holds few tokens at once.

    A piece ends with a line of } at which no bracket, string or comment is open: the whole text has the same tokens, and is
    between two declarations there. Places are counted in the piece, lines in the file. A piece has its functions until the
    next one is asked for.
    """
    at, line, least = 0, 1, size
    while at < len(text):
        cut = text.find("\n}\n", at + least)
        piece = text[at : cut + 3] if cut >= 0 else text[at:]
        tokens = tokenize(piece, line)
        if cut >= 0 and not _whole(piece, tokens):
            least = 2 * len(piece)
            continue
        source = Source(piece, tokens)
        yield source
        source.functions.clear()  # they hold the source: no cycle is left to the garbage collector
        at, line, least = at + len(piece), line + piece.count("\n"), size


def heads(text: str) -> Iterator[Source]:
    """The pieces of a file that may hold imports: up to the last place that says so."""
    at, last = 0, text.rfind("import")
    for source in sources(text, 1 << 10):
        yield source
        if (at := at + len(source.text)) > last:
            break


@dataclass
class Function:
    """A declaration by its tokens; what they say is read when it is asked for."""

    source: Source = field(repr=False)
    name: str
    at: dict[str, tuple[int, int]] = field(repr=False)  # tokens of its parts
    start_line: int = 0
    end_line: int = 0
    start: int = 0  # of body in the source
    first: int = 0  # tokens of the block, after { and before }
    last: int = 0

    @cached_property
    def receiver(self) -> str:
        found = self.source.parameters(*self.at["receiver"]) if "receiver" in self.at else []
        return found[0][1] if found else ""

    @cached_property
    def type_params(self) -> str:
        return self.source.plain(*self.at["type_params"]) if "type_params" in self.at else ""

    @cached_property
    def params(self) -> list[tuple[str, str]]:
        return self.source.parameters(*self.at["params"])

    @cached_property
    def returns(self) -> list[str]:
        a, b = self.at["returns"]
        tokens, close = self.source.tokens, self.source.close
        if a < len(tokens) and tokens[a].text == "(" and close.get(a, b) < b:
            return [t for _, t in self.source.parameters(a + 1, close[a])]
        return [self.source.plain(a, b)] if b > a else []

    @cached_property
    def body(self) -> str:
        """The whole declaration, with its name and signature."""
        return self.source.slice(*self.at["body"])

    @cached_property
    def doc(self) -> str:
        return self.source._doc(self.start)

    @property
    def signature(self) -> str:
        receiver = f"({self.receiver}) " if self.receiver else ""
        params = ", ".join(f"{n} {t}".strip() for n, t in self.params)
        returns = "" if not self.returns else " " + self.returns[0] if len(self.returns) == 1 else f" ({', '.join(self.returns)})"
        return f"func {receiver}{self.name}{self.type_params}({params}){returns}"


@dataclass
class Type:
    name: str
    kind: str  # struct, interface, func, map, slice, array, pointer, chan, alias
    source: str
    type_params: str = ""
    fields: list[tuple[str, str, str]] = field(default_factory=list)
    methods: list[tuple[str, str]] = field(default_factory=list)
    embedded: list[str] = field(default_factory=list)
    underlying: str = ""


@dataclass
class Variable:
    name: str
    type: str
    value: str
    is_const: bool


class Source:
    """Tokens of a file and the declarations found in them."""

    def __init__(self, text: str, tokens: list[Token] | None = None):
        self.text, self.tokens = text, tokenize(text) if tokens is None else tokens
        self.close = match_brackets(self.tokens)
        self.open = {b: a for a, b in self.close.items()}
        self.package, self.imports = "", []
        self.functions: list[Function] = []
        self._found: dict[str, list[tuple]] = {"type": [], "var": []}  # tokens of declarations, read when asked for
        self._declarations()

    @cached_property
    def types(self) -> list[Type]:
        return [self._type(a, b) for a, b in self._found["type"] if a < b]

    @cached_property
    def variables(self) -> list[Variable]:
        return [v for a, b, const in self._found["var"] for v in self._var(a, b, const)]

    # -- slices

    def slice(self, a: int, b: int) -> str:
        """Source text of tokens a..b-1."""
        return self.text[self.tokens[a].start : self._end(b - 1)] if b > a else ""

    def _end(self, i: int) -> int:
        t = self.tokens[i]
        return t.start + (0 if t.kind == "end" and t.text == ";" and self.text[t.start : t.start + 1] != ";" else len(t.text))

    def plain(self, a: int, b: int) -> str:
        """Tokens a..b-1 written the usual way, whatever their spacing was."""
        out = ""
        for t in self.tokens[a:b]:
            text = t.text
            glue = not out or text in ".,)]}" or out[-1] in ".([*&" or text in "([" and (out[-1:].isalnum() or out[-1:] in ")]_") or out.endswith("]")
            if out.endswith("...") or out.endswith("<-") and text != "chan":
                glue = True
            out += text if glue else " " + text
        return out.replace(" {}", "{}").replace("interface {}", "interface{}").replace("{ }", "{}")

    def skip(self, i: int) -> int:
        return self.close.get(i, len(self.tokens) - 1) + 1

    def until(self, i: int, stop: set[str]) -> int:
        """First index from i at this depth whose token is in `stop` or a statement end."""
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "end" or t.kind == "op" and t.text in stop:
                return i
            i = self.skip(i) if t.kind == "op" and t.text in _CLOSE else i + 1
        return i

    # -- declarations

    def _declarations(self) -> None:
        i, n = 0, len(self.tokens)
        while i < n:
            t = self.tokens[i]
            if t.text == "package" and i + 1 < n:
                self.package = self.tokens[i + 1].text
                i += 2
            elif t.text in ("import", "type", "var", "const") and t.kind == "word":
                read = {"import": self._import, "type": self._type_at, "var": self._var_at, "const": self._const_at}[t.text]
                if i + 1 < n and self.tokens[i + 1].text == "(":
                    stop, j = self.close.get(i + 1, n), i + 2
                    while j < stop:
                        if self.tokens[j].kind == "end":
                            j += 1
                            continue
                        end = min(self.until(j, set()), stop)
                        read(j, end)
                        j = end + 1
                    i = stop + 1
                else:
                    end = self.until(i + 1, set())
                    read(i + 1, end)
                    i = end + 1
            elif t.text == "func" and t.kind == "word":
                i = self._function(i)
            else:
                i = self.skip(i) if t.kind == "op" and t.text in _CLOSE else i + 1

    def _import(self, a: int, b: int) -> None:
        words = self.tokens[a:b]
        if words and words[-1].kind == "string":
            self.imports.append((words[-1].text[1:-1], words[0].text if len(words) > 1 else ""))

    def _names(self, a: int, b: int) -> tuple[list[str], int]:
        names = []
        while a < b and self.tokens[a].kind == "word":
            names.append(self.tokens[a].text)
            a += 1
            if a < b and self.tokens[a].text == ",":
                a += 1
            else:
                break
        return names, a

    def _var_at(self, a: int, b: int) -> None:
        self._found["var"].append((a, b, False))

    def _const_at(self, a: int, b: int) -> None:
        self._found["var"].append((a, b, True))

    def _type_at(self, a: int, b: int) -> None:
        self._found["type"].append((a, b))

    def _var(self, a: int, b: int, const: bool) -> list[Variable]:
        names, at = self._names(a, b)
        equal = self.until(at, {"="})
        equal = min(equal, b)
        kind = self.plain(at, equal)
        values, j = [], equal + 1
        while equal < b and j < b:
            end = min(self.until(j, {","}), b)
            values.append(self.slice(j, end))
            j = end + 1
        return [Variable(name, kind, values[k] if k < len(values) else "", const) for k, name in enumerate(names)]

    def _type(self, a: int, b: int) -> Type:
        name, at, params = self.tokens[a].text, a + 1, ""
        if at < b and self.tokens[at].text == "[":
            stop = self.close.get(at, b)
            if stop - at > 2:  # [N]T is an array, [T any] are type parameters
                params, at = self.plain(at, stop + 1), stop + 1
        if at < b and self.tokens[at].text == "=":
            at += 1
        head = self.tokens[at].text if at < b else ""
        kind = {"struct": "struct", "interface": "interface", "func": "func", "map": "map", "chan": "chan", "*": "pointer"}.get(head, "alias")
        if head == "[":
            kind = "slice" if self.tokens[at + 1].text == "]" else "array"
        out = Type(name, kind, self.slice(a, b), params)
        if kind in ("struct", "interface") and at + 1 < b and self.tokens[at + 1].text == "{":
            (self._fields if kind == "struct" else self._methods)(out, at + 2, self.close.get(at + 1, b))
        else:
            out.underlying = self.plain(at, b)
        return out

    def _lines(self, a: int, b: int):
        while a < b:
            if self.tokens[a].kind == "end":
                a += 1
                continue
            end = min(self.until(a, set()), b)
            yield a, end
            a = end + 1

    def _fields(self, out: Type, a: int, b: int) -> None:
        for i, end in self._lines(a, b):
            tag = ""
            if self.tokens[end - 1].kind == "string":
                tag, end = self.tokens[end - 1].text, end - 1
            names, at = self._names(i, end)
            if at >= end or not names or self.tokens[at].text == "." or self.tokens[i].text == "*":
                out.embedded.append(self.plain(i, end))
            else:
                out.fields += [(n, self.plain(at, end), tag) for n in names]

    def _methods(self, out: Type, a: int, b: int) -> None:
        for i, end in self._lines(a, b):
            if self.tokens[i].kind == "word" and i + 1 < end and self.tokens[i + 1].text == "(":
                out.methods.append((self.tokens[i].text, self.plain(i, end)))
            else:
                out.embedded.append(self.plain(i, end))

    def parameters(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name, type) of a parameter list between brackets; unnamed ones have an empty name."""
        parts, i = [], a
        while i < b:
            end = min(self.until(i, {","}), b)
            if end > i:
                parts.append((i, end))
            i = end + 1

        def named(i: int, end: int) -> bool:
            return end - i >= 2 and self.tokens[i].kind == "word" and self.tokens[i].text not in KEYWORDS and self.tokens[i + 1].text != "." and not (self.tokens[i + 1].text == "[" and self.close.get(i + 1) == end - 1 and end - i > 3)

        if not any(named(i, end) for i, end in parts):
            return [("", self.plain(i, end)) for i, end in parts]
        out, waiting = [], []
        for i, end in parts:
            if named(i, end):
                kind = self.plain(i + 1, end)
                out += [(n, kind) for n in (*waiting, self.tokens[i].text)]
                waiting = []
            else:
                waiting.append(self.plain(i, end))
        return out + [(n, "") for n in waiting]

    def _function(self, i: int) -> int:
        at, parts = i + 1, {}
        if at < len(self.tokens) and self.tokens[at].text == "(":
            stop = self.close.get(at)
            if stop is None:
                return i + 1
            parts["receiver"], at = (at + 1, stop), stop + 1
        if at >= len(self.tokens) or self.tokens[at].kind != "word":
            return at
        name, at = self.tokens[at].text, at + 1
        if at < len(self.tokens) and self.tokens[at].text == "[":
            stop = self.close.get(at, at)
            parts["type_params"], at = (at, stop + 1), stop + 1
        if at >= len(self.tokens) or self.tokens[at].text != "(" or at not in self.close:
            return at
        parts["params"], start = (at + 1, self.close[at]), self.close[at] + 1
        at = self.block_start(start, header=True)
        has_body = at < len(self.tokens) and self.tokens[at].text == "{"
        stop = self.close.get(at, len(self.tokens) - 1) if has_body else at - 1
        parts |= {"returns": (start, at), "body": (i, stop + 1)}
        first, last = (at + 1, stop) if has_body else (at, at)
        self.functions.append(Function(self, name, parts, self.tokens[i].line, self.tokens[stop].line, self.tokens[i].start, first, last))
        return stop + 1

    def _doc(self, start: int) -> str:
        out, end = [], self.text.rfind("\n", 0, start)
        while end >= 0:
            before = self.text.rfind("\n", 0, end)
            if not self.text.startswith("//", before + 1, end):
                break
            out.append(self.text[before + 3 : end].strip())
            end = before
        return "\n".join(reversed(out))

    def block_start(self, i: int, header: bool = False) -> int:
        """Index of the { that opens a statement's block: the first that is not part of a type or, outside headers, a literal."""
        start = i
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "end" and t.text == ";" and self.text[t.start : t.start + 1] != ";":
                return i
            if t.text == "{" and t.kind == "op":
                before = self.tokens[i - 1].text if i > start else ""
                if before not in ("struct", "interface") and (header or not self._literal(start, i)):
                    return i
            if t.text == "func" and t.kind == "word" and i + 1 < len(self.tokens) and self.tokens[i + 1].text == "(" and i > start:
                block = self.block_start(self.skip(i + 1))
                if block < len(self.tokens) and self.tokens[block].text == "{" and self.close.get(block, 0) + 1 < len(self.tokens) and self.tokens[self.close[block] + 1].kind != "end":
                    i = self.skip(block)
                    continue
            i = self.skip(i) if t.kind == "op" and t.text in _CLOSE else i + 1
        return i

    def _literal(self, start: int, i: int) -> bool:
        """Whether the { at i follows a slice, array or map type."""
        j = i - 1
        while j >= start and (self.tokens[j].kind == "word" and self.tokens[j].text not in KEYWORDS or self.tokens[j].text in (".", "*")):
            j -= 1
        if j < start or self.tokens[j].text != "]":
            return False
        opening = self.open.get(j)
        if opening is None or opening < start:
            return False
        if j == i - 1:
            return False
        before = self.tokens[opening - 1] if opening > start else None
        return before is None or before.text == "map" or not (before.kind in ("word", "string") and before.text not in KEYWORDS or before.text in (")", "]"))

    # -- walks over bodies

    def calls(self, f: Function) -> list[tuple[str, str, list[str], int]]:
        """(receiver or "", name, arguments, line) of every call in a body."""
        out = []
        for i in range(f.first, f.last):
            t = self.tokens[i]
            if t.text != "(" or i == 0 or self.tokens[i - 1].kind != "word" or self.tokens[i - 1].text in KEYWORDS or i not in self.close:
                continue
            receiver = self.tokens[i - 3].text if i >= 3 and self.tokens[i - 2].text == "." and self.tokens[i - 3].kind == "word" else "" if self.tokens[i - 2].text != "." else "?"
            args, j, stop = [], i + 1, self.close[i]
            while j < stop:
                end = min(self.until(j, {","}), stop)
                if end > j:
                    args.append(self.plain(j, end))
                j = end + 1
            out.append((receiver, self.tokens[i - 1].text, args, self.tokens[i - 1].line))
        return out

    def _first_line(self, brace: int) -> int:
        """Line of a block's first statement, else of its opening brace."""
        j = brace + 1
        while j < self.close.get(brace, brace) and self.tokens[j].kind == "end":
            j += 1
        return self.tokens[j].line if j < self.close.get(brace, brace) else self.tokens[brace].line

    def _is_error_check(self, a: int, b: int) -> bool:
        ends = [i for i in range(a, b) if self.tokens[i].kind == "end"]
        a = ends[-1] + 1 if ends else a
        c = [t.text for t in self.tokens[a:b]]
        return len(c) == 3 and c[1] in ("!=", "==") and {c[0], c[2]} == {"err", "nil"}

    def branches(self, f: Function) -> list[tuple[str, int, bool]]:
        """(kind, line of the first statement, is_error_path) of if chains, switch, type switch and select clauses."""
        out, chained = [], set()
        for i in range(f.first, f.last):
            t = self.tokens[i]
            if t.kind != "word" or t.text not in ("if", "switch", "select"):
                continue
            if t.text == "if":
                if i in chained:
                    continue
                at, kind = i, "if"
                while True:
                    block = self.block_start(at + 1)
                    if block not in self.close:
                        break
                    out.append((kind, self._first_line(block), self._is_error_check(at + 1, block)))
                    then = self.close[block] + 1
                    if then >= f.last or self.tokens[then].text != "else":
                        break
                    if self.tokens[then + 1].text == "if":
                        at, kind = then + 1, "else-if"
                        chained.add(at)
                    else:
                        out.append(("else", self._first_line(then + 1), False))
                        break
                continue
            block = self.block_start(i + 1)
            if block not in self.close:
                continue
            head = [x.text for x in self.tokens[i + 1 : block]]
            is_type = any(head[j : j + 4] == [".", "(", "type", ")"] for j in range(len(head)))
            kind = "select-case" if t.text == "select" else "type-case" if is_type else "switch-case"
            j, stop = block + 1, self.close[block]
            while j < stop:
                if self.tokens[j].text in ("case", "default") and self.tokens[j].kind == "word":
                    colon = j + 1
                    while colon < stop and self.tokens[colon].text != ":":
                        colon = self.skip(colon) if self.tokens[colon].text in _CLOSE and self.tokens[colon].kind == "op" else colon + 1
                    k = colon + 1
                    while k < stop and self.tokens[k].kind == "end":
                        k += 1
                    empty = k >= stop or self.tokens[k].text in ("case", "default") and self.tokens[k].kind == "word"
                    out.append(("default" if self.tokens[j].text == "default" else kind, self.tokens[j].line if empty else self.tokens[k].line, False))
                    j = colon + 1
                else:
                    j = self.skip(j) if self.tokens[j].text in _CLOSE and self.tokens[j].kind == "op" else j + 1
        return out

    def branch_texts(self, f: Function) -> list[str]:
        """Descriptions of a body's branches: conditions with all of their chain, switches with their cases, then what is inside."""
        out, chained = [], set()
        for i in range(f.first, f.last):
            t = self.tokens[i]
            if t.text in ("!=",) and {self.tokens[i - 1].text, self.tokens[i + 1].text} == {"err", "nil"} and self.tokens[i - 2].text != "." and self.tokens[i + 2].text not in (".", "(", "["):
                out.append("Error check (err != nil)")
            if t.kind != "word" or t.text not in ("if", "switch", "select") or i in chained:
                continue
            at, said = i, "Condition"
            while t.text == "if":
                block = self.block_start(at + 1)
                if block not in self.close:
                    break
                parts = [j for j in range(at + 1, block) if self.tokens[j].kind == "end"]
                out.append(f"{said}: `{self.slice(parts[-1] + 1 if parts else at + 1, block)}`")
                then = self.close[block] + 1
                if then >= f.last or self.tokens[then].text != "else":
                    break
                if self.tokens[then + 1].text != "if":
                    out.append("Else branch")
                    break
                at, said = then + 1, "Else-if"
                chained.add(at)
            if t.text != "if" and (block := self.block_start(i + 1)) in self.close:
                head = [x.text for x in self.tokens[i + 1 : block]]
                if any(head[j : j + 4] == [".", "(", "type", ")"] for j in range(len(head))):
                    out.append("Type switch")
                else:
                    out.append("Select statement" if t.text == "select" else "Switch statement")
                    out += self._cases(block, t.text == "select")
        return out

    def _cases(self, block: int, whole: bool) -> list[str]:
        """What the clauses of a switch or select wait for; whole: one text a clause, else one a value."""
        out, j, stop = [], block + 1, self.close[block]
        while j < stop:
            t = self.tokens[j]
            if t.kind == "word" and t.text == "default":
                out.append("Default case")
            elif t.kind == "word" and t.text == "case":
                start = j + 1
                while j < stop and self.tokens[j].text != ":":
                    if self.tokens[j].text == "," and not whole:
                        out.append(f"Case: `{self.slice(start, j)}`")
                        start = j + 1
                    j = self.skip(j) if self.tokens[j].text in _CLOSE and self.tokens[j].kind == "op" else j + 1
                out.append(f"Case: `{self.slice(start, j)}`")
                continue
            j = self.skip(j) if t.text in _CLOSE and t.kind == "op" else j + 1
        return out

    def declarations(self) -> list[tuple[set[str], str]]:
        """(names, whole lines) of every top-level type, var and const declaration, groups as one."""
        out, i, lines = [], 0, self.text.split("\n")
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "word" and t.text in ("type", "var", "const") and i + 1 < len(self.tokens):
                end = self.close.get(i + 1, i + 1) if self.tokens[i + 1].text == "(" else self.until(i + 1, set()) - 1
                inner = Source("package p\n" + self.slice(i, end + 1))
                last = t.line - 1 + self.text.count("\n", t.start, self._end(end))
                out.append(({x.name for x in [*inner.types, *inner.variables]}, "\n".join(lines[t.line - 1 : last + 1])))
                i = end + 1
            else:
                i = self.skip(i) if t.kind == "op" and t.text in _CLOSE else i + 1
        return out

    def executable_ranges(self) -> list[tuple[int, int]]:
        """(start, end) lines of function heads and of statements in bodies, each with all its blocks."""
        out = []
        for f in self.functions:
            if f.last > f.first or self.tokens[f.first - 1].text == "{":
                out.append((f.start_line, self.tokens[f.first - 1].line))
            self._statements(f.first, f.last, out)
        return out

    def _statements(self, a: int, b: int, out: list[tuple[int, int]]) -> None:
        i = a
        while i < b:
            t = self.tokens[i]
            if t.kind == "end" or t.text == "}":
                i += 1
            elif t.kind == "word" and t.text in ("if", "for", "switch", "select"):
                block = self.block_start(i + 1)
                if block not in self.close:
                    return
                self._statements(block + 1, self.close[block], out)
                i = self.close[block] + 1
                while i + 1 < b and self.tokens[i].text == "else":
                    block = self.block_start(i + 1)
                    if block not in self.close:
                        return
                    self._statements(block + 1, self.close[block], out)
                    i = self.close[block] + 1
                out.append((t.line, self.tokens[i - 1].line))
            elif t.kind == "word" and t.text in ("case", "default"):
                while i < b and self.tokens[i].text != ":":
                    i = self.skip(i) if self.tokens[i].text in _CLOSE and self.tokens[i].kind == "op" else i + 1
                i += 1
            elif t.text == "{" and i in self.close:
                self._statements(i + 1, self.close[i], out)
                i = self.close[i] + 1
            else:
                j = i
                while j < b and self.tokens[j].kind != "end":
                    if self.tokens[j].text == "{" and self.tokens[j - 1].text == ")" and j in self.close:  # a function literal
                        self._statements(j + 1, self.close[j], out)
                    j = self.skip(j) if self.tokens[j].text in _CLOSE and self.tokens[j].kind == "op" else j + 1
                out.append((t.line, self.tokens[min(j, b) - 1].line))
                i = j + 1

    def mutants(self, f: Function) -> list[tuple[str, int, str, str]]:
        """(kind, line, original, replacement) in source order."""
        from ..operators.mutation import RETURNS, SWAPS

        out, i = [], f.first
        operands = ("word", "number", "string", "rune")
        while i < f.last:
            t, before = self.tokens[i], self.tokens[i - 1]
            binary = before.kind in operands and before.text not in KEYWORDS or before.text in (")", "]", "}")
            if t.kind == "op":
                for kind, swaps in SWAPS.items():
                    if t.text in swaps and binary:
                        out.append((kind, t.line, t.text, swaps[t.text]))
                if t.text == "!" and not binary:
                    out.append(("cond_negate", t.line, "!", ""))
            elif t.text == "return" and t.kind == "word":
                j, end = i + 1, self.until(i + 1, {"}"})
                while j < end:
                    stop = min(self.until(j, {",", "}"}), end)
                    if stop - j == 1 and self.tokens[j].text in RETURNS:
                        out.append(("return", t.line, self.tokens[j].text, RETURNS[self.tokens[j].text]))
                    j = stop + 1
            i += 1
        return out

    def table_cases(self, f: Function) -> list[tuple[int, list[tuple[str, str]], int, int]]:
        """(table, fields, start, end) of the elements of slice-of-struct literals; fields are (key or "", value text)."""
        out, table = [], 0
        for i in range(f.first, f.last):
            t = self.tokens[i]
            if t.text != "{" or t.kind != "op" or i not in self.close or i < 2:
                continue
            if not (self.tokens[i - 1].text == "}" and self._struct_slice(i - 1) or self._literal(f.first, i)):
                continue
            found, j, stop = [], i + 1, self.close[i]
            while j < stop:
                if self.tokens[j].kind == "end" or self.tokens[j].text == ",":
                    j += 1
                    continue
                end = min(self.until(j, {","}), stop)
                if self.tokens[j].text == "{" and j in self.close:
                    found.append((table, self._pairs(j + 1, self.close[j]), self.tokens[j].start, self._end(self.close[j])))
                j = end + 1
            if found:
                out += found
                table += 1
        return out

    def _struct_slice(self, close: int) -> bool:
        opening = self.open.get(close, 0)
        return opening >= 3 and self.tokens[opening - 1].text == "struct" and self.tokens[opening - 2].text == "]"

    def _pairs(self, a: int, b: int) -> list[tuple[str, str]]:
        out, i = [], a
        while i < b:
            if self.tokens[i].kind == "end":
                i += 1
                continue
            end = min(self.until(i, {","}), b)
            keyed = end - i > 2 and self.tokens[i].kind == "word" and self.tokens[i + 1].text == ":"
            out.append((self.tokens[i].text, self.slice(i + 2, end)) if keyed else ("", self.slice(i, end)))
            i = end + 1
        return out

    def variables_in(self, f: Function) -> list[tuple[str, str]]:
        """(name, label) of local variables: the constructor, type or literal they come from."""
        out = []
        for i in range(f.first, f.last):
            t = self.tokens[i]
            if t.text in (":=", "=") and t.kind == "op":
                names, j = [], i - 1
                while j >= f.first and (self.tokens[j].kind == "word" or self.tokens[j].text == ","):
                    if self.tokens[j].kind == "word":
                        names.insert(0, self.tokens[j].text)
                    j -= 1
                values, j, end = [], i + 1, self.until(i + 1, set())
                while j < end:
                    stop = min(self.until(j, {","}), end)
                    values.append((j, stop))
                    j = stop + 1
                for name, (a, b) in zip([n for n in names if n not in KEYWORDS], values):
                    if label := self._label(a, b):
                        out.append((name, label))
            elif t.text == "var" and t.kind == "word":
                end = self.until(i + 1, {"="})
                names, at = self._names(i + 1, end)
                label = self.tokens[end - 1].text if at < end and self.tokens[at].text not in ("[", "map", "func", "chan") and self.tokens[end - 1].kind == "word" else ""
                out += [(n, label) for n in names if label]
        return out

    def _label(self, a: int, b: int) -> str:
        while a < b and self.tokens[a].text in ("&", "*", "-", "!"):
            a += 1
        at = a
        while at < b and (self.tokens[at].kind == "word" and self.tokens[at].text not in KEYWORDS or self.tokens[at].text == "."):
            at += 1
        if at == a or at >= b or self.tokens[at].text not in ("(", "{") or self.close.get(at) != b - 1:
            return ""
        return self.tokens[at - 1].text.removeprefix("New") if self.tokens[at].text == "(" else self.tokens[at - 1].text


def normalise(body: str) -> str:
    """A body without comments, spacing and blank lines, for comparison."""
    out, line = [], []
    for t in tokenize(body):
        if t.kind == "end":
            if line:
                out.append(" ".join(line))
            line = []
        else:
            line.append(t.text)
    return "\n".join([*out, *([" ".join(line)] if line else [])])


def apply_mutant(source: str, kind: str, line: int, original: str, replacement: str) -> str:
    """The source with the first fitting token of a line replaced; unchanged if there is none."""
    s = Source(source)
    for i, t in enumerate(s.tokens):
        if t.line != line or t.text != original:
            continue
        if kind == "return" and "return" not in [x.text for x in s.tokens[:i] if x.line == line]:
            continue
        return source[: t.start] + replacement + source[t.start + len(t.text) :]
    return source


def extract_functions(source: str, names: list[str]) -> str:
    """Package clause, imports that stay in use and the named functions, as one file."""
    s = Source(source)
    kept = [f.body for f in s.functions if f.name in names]
    body = "\n\n".join(kept)
    used = [(p, a) for p, a in s.imports if re.search(rf"\b{re.escape(a or p.rsplit('/', 1)[-1])}\.", body)]
    imports = "import (\n" + "".join(f"\t{a + ' ' if a else ''}\"{p}\"\n" for p, a in used) + ")\n\n" if used else ""
    return f"package {s.package}\n\n{imports}{body}\n"


def body_after_imports(source: str) -> str:
    """What follows the last import declaration."""
    return _after_imports(Source(source))


def _after_imports(s: Source) -> str:
    last = 0
    for i, t in enumerate(s.tokens):
        if t.text == "import" and t.kind == "word":
            end = s.close.get(i + 1, i + 1) if s.tokens[i + 1].text == "(" else s.until(i + 1, set()) - 1
            last = s._end(end)
        elif t.text == "func" and t.kind == "word":
            break
    if not last:
        at = next((i for i, t in enumerate(s.tokens) if t.text == "package"), None)
        last = s._end(at + 1) if at is not None and at + 1 < len(s.tokens) else 0
    return s.text[last:].strip()


def _stripped(source: str, end: int) -> int:
    """Length of source[:end] without the blanks at its end."""
    while end and source[end - 1].isspace():
        end -= 1
    return end


def remove_functions(source: str, names: set[str]) -> str:
    """The source without functions and their comments, in one pass from its end: each character is copied once."""
    s = Source(source)
    kept, cut = [], len(source)
    for f in reversed(s.functions):
        if f.name in names:
            kept.append(source[f.start + len(f.body) : cut])
            cut = _stripped(source, f.start)
            for _ in f.doc.split("\n") if f.doc else ():
                cut = _stripped(source, max(source.rfind("\n", 0, cut), 0))
    out = [source[:cut]]
    for part in reversed(kept):
        if out[-1] != "\n\n":
            out.append("\n\n")
        if part := part.lstrip():
            out.append(part)
    return "".join(out).rstrip() + "\n"


def remove_cases(source: str, function: str, names: set[str]) -> str:
    """The source without table cases of a function whose name is in `names`; blanks and underscores are the same."""
    return remove_all_cases(source, [(function, names)])


def remove_all_cases(source: str, steps: list[tuple[str, set[str]]]) -> str:
    """The source without the table cases that steps of (function, names) name, read once; only a function that has further
    steps is read again, by itself."""
    by: dict[str, list[set[str]]] = {}
    for function, names in steps:
        by.setdefault(function, []).append({n.replace("_", " ") for n in names})
    s, out, at = Source(source), [], 0
    for f in s.functions:
        if f.name in by:
            first, *more = by[f.name]
            body = _without_spans(f.body, [(a - f.start, b - f.start) for a, b in _named_cases(s, f, first)])
            for same in more:
                again = Source(body)
                body = _without_spans(body, [x for g in again.functions for x in _named_cases(again, g, same)])
            out += [source[at : f.start], body]
            at = f.start + len(f.body)
    return "".join([*out, source[at:]])


def _named_cases(s: Source, f: Function, same: set[str]) -> list[tuple[int, int]]:
    spans = []
    for _, fields, start, end in s.table_cases(f):
        name = next((v for k, v in fields if k == "name"), fields[0][1] if fields and not fields[0][0] else "").strip("\"`")
        if name.replace("_", " ") in same:
            spans.append((start, end))
    return spans


def _without_spans(source: str, spans: list[tuple[int, int]]) -> str:
    for start, end in reversed(spans):
        after = re.match(r"\s*,?[ \t]*\n?", source[end:]).end()
        source = source[:start].rstrip(" \t") + source[end + after :]
    return source


def merge(existing: str, generated: str) -> tuple[str, list[str], list[str]]:
    """Existing source with the generated imports, declarations and functions it lacks, these with their comments; names of the
    functions added and skipped."""
    a, b = Source(existing), Source(generated)
    have = {n for names, _ in a.declarations() for n in names}
    functions = {f.name for f in a.functions}
    paths = {p for p, _ in a.imports}
    imports = sorted({(p, al) for p, al in a.imports} | {(p, al) for p, al in b.imports if p not in paths})
    new = [f for f in b.functions if f.name not in functions]
    block = "import (\n" + "".join(f"\t{al + ' ' if al else ''}\"{p}\"\n" for p, al in imports) + ")\n\n" if imports else ""
    said = ["".join(f"// {line}".rstrip() + "\n" for line in f.doc.split("\n")) + f.body if f.doc else f.body for f in new]
    parts = [_after_imports(a), *(text for names, text in b.declarations() if not names & have), *said]
    text = f"package {a.package or b.package}\n\n{block}" + "\n\n".join(p for p in parts if p) + "\n"
    return text, [f.name for f in new], [f.name for f in b.functions if f.name in functions]


def split_outside(text: str) -> list[str]:
    """Parts between commas that are not inside brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()] if part.strip() else out


def method_parts(signature: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Parameters and return types of a method's text, like Name(a int) (string, error)."""
    s = Source("package p\nfunc " + signature + "\n")
    return (s.functions[0].params, s.functions[0].returns) if s.functions else ([], [])


def mock(name: str, methods: list[tuple[str, str]]) -> str:
    """A struct with a function field for each method of an interface."""
    fields, bodies = [], []
    for method, signature in methods:
        params, returns = method_parts(signature)
        params = [(n or f"p{i}", t) for i, (n, t) in enumerate(params)]
        args = ", ".join(f"{n} {t}" for n, t in params)
        call = ", ".join(n + "..." if t.startswith("...") else n for n, t in params)
        out = "" if not returns else " " + returns[0] if len(returns) == 1 else f" ({', '.join(returns)})"
        fields.append(f"\t{method}Func func({args}){out}")
        zero = "".join(f"\tvar r{i} {t}\n" for i, t in enumerate(returns))
        back = f"{zero}\treturn {', '.join(f'r{i}' for i in range(len(returns)))}\n" if returns else ""
        take = f"\t\treturn m.{method}Func({call})\n" if returns else f"\t\tm.{method}Func({call})\n\t\treturn\n"
        bodies.append(f"func (m *Mock{name}) {method}({args}){out} {{\n\tif m.{method}Func != nil {{\n{take}\t}}\n{back}}}")
    return f"type Mock{name} struct {{\n" + "\n".join(fields) + "\n}\n\n" + "\n\n".join(bodies) + "\n"
