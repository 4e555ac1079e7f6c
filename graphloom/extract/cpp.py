"""C and C++ symbols and calls, by a tokenizer and a scanner of scopes.

It reads well-formed code without a grammar: namespaces, types, function
definitions and the calls in them. Unbalanced brackets or open strings and
comments count as an error, and a file with an error gives nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from graphloom.extract.base import Extraction, Ref, Symbol, register
from graphloom.schema import CLASS, ENUM, FUNCTION, IMPORT, NAMESPACE, STRUCT, TYPE_ALIAS

# Callees that are not recorded unless called on an object.
BUILTINS = (
    # casts and operators
    "static_cast", "dynamic_cast", "reinterpret_cast", "const_cast",
    "sizeof", "alignof", "typeid", "noexcept",
    # basic types
    "size_t", "int8_t", "uint8_t", "int16_t", "uint16_t",
    "int32_t", "uint32_t", "int64_t", "uint64_t",
    "intptr_t", "uintptr_t", "ptrdiff_t", "nullptr_t",
    # standard library
    "to_string", "sort", "min", "max", "swap", "move", "forward",
    "make_shared", "make_unique", "memcpy", "memset", "memmove",
    "fprintf", "printf", "snprintf", "abort", "exit",
    "setw", "setprecision", "setfill", "left", "right",
    # containers and iterators
    "begin", "end", "rbegin", "rend", "data", "size", "empty",
    # variant, optional, any
    "get", "holds_alternative", "visit", "any_cast",
    # conversions
    "stoi", "stol", "stoul", "stod", "stof",
    "atoi", "atol", "strtol", "strtoul", "strtod",
    # system calls
    "sleep_for", "sleep_until",
    "strerror", "perror",
    "waitpid", "fork", "exec", "execv", "execvp",
    "kill", "getpid", "getppid",
    # sockets
    "socket", "setsockopt", "getsockopt", "bind", "listen",
    "accept", "accept4", "connect", "close", "shutdown",
    "send", "recv", "sendto", "recvfrom",
    "htons", "htonl", "ntohs", "ntohl",
    "inet_pton", "inet_ntop", "inet_addr",
    # polling and descriptors
    "epoll_create", "epoll_ctl", "epoll_wait",
    "fcntl", "ioctl", "pipe", "pipe2", "socketpair",
    # files
    "open", "read", "write", "lseek", "dup", "dup2",
    "mmap", "munmap", "mprotect",
    # process status
    "WEXITSTATUS", "WIFEXITED", "WIFSIGNALED", "WTERMSIG",
    "eventfd", "timerfd_create", "signalfd",
    # generated message code
    "GetEmptyStringAlreadyInited", "InitSCC", "GetArena",
    "GetArenaNoVirtual", "GetCachedSize", "ByteSizeLong", "Clear",
    "_Internal", "default_instance_", "InitDefaultsImpl",
    "GetProto3PreserveUnknownsDefault", "VerifyUtf8String",
    "ComputeUnknownFieldsSize", "SerializeUnknownFields",
    "SerializeUnknownFieldsToArray", "DynamicCastToGenerated",
    "CreateMaybeMessage", "OnShutdownDestroyMessage",
    "InternalAddGeneratedFile", "InternalRegisterGeneratedFile",
    "NameOfEnum",
)
_BUILTIN_SET = frozenset(BUILTINS)

_TOKEN = re.compile(
    rb"""(?P<space>[\s\\]+)
    |(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<raw>(?:u8|[uUL])?R"(?P<tag>[^\s()\\]{0,16})\(.*?\)(?P=tag)")
    |(?P<string>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*')
    |(?P<number>\.?\d(?:[\w.]|'(?=\w)|(?<=[eEpP])[+-])*)
    |(?P<name>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)
    |(?P<sign>::|->|<<=|[\[\](){};:,<>=+\-*/%&|^!~?.@\#])
    """,
    re.X | re.S,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_NOT_CALLED = frozenset("if for while switch return catch sizeof alignof decltype alignas static_assert noexcept throw new delete operator else do case goto typeid asm defined and or not requires co_return co_await co_yield".split())
_BEFORE_CALL = frozenset("return else throw case do and or not co_return co_await co_yield in".split())
_AFTER_PARAMETERS = frozenset("const volatile noexcept override final try mutable constexpr requires".split())


@dataclass
class Token:
    text: str
    kind: str
    at: int
    end: int


class _Error(Exception):
    pass


class _Scanner:
    def __init__(self, content: bytes):
        self.content = content
        self.starts = [0, *[m.end() for m in re.finditer(rb"\n", content)]]
        self.tokens: list[Token] = []
        self.includes: list[tuple[int, int, str]] = []
        self.comments: list[Token] = []
        self.match: dict[int, int] = {}
        self.out = Extraction()
        self._tokenize()

    def place(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def _tokenize(self) -> None:
        at, fresh, content = 0, True, self.content
        while at < len(content):
            if fresh and content[at : at + 1] == b"#":
                end = re.compile(rb"(?:[^\n\\]|\\.)*", re.S).match(content, at).end()  # type: ignore[union-attr]
                line = content[at:end].decode("utf-8", "replace")
                if re.match(r"#\s*include\b", line):
                    cut = line.find("<") if "<" in line else line.find('"')
                    self.includes.append((at, end, re.split(r"\s+//|\s*/\*", line[cut:])[0].strip() if cut >= 0 else ""))
                at = end
                continue
            m = _TOKEN.match(content, at)
            if m is None:
                raise _Error
            kind = m.lastgroup if m.lastgroup != "tag" else "raw"
            if kind == "space":
                fresh = fresh or b"\n" in m[0]
            elif kind == "comment":
                self.comments.append(Token(m[0].decode("utf-8", "replace"), kind, at, m.end()))
            else:
                fresh = False
                self.tokens.append(Token(m[0].decode("utf-8", "replace"), str(kind), at, m.end()))
            at = m.end()
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "sign":
                continue
            if t.text in _PAIRS:
                stack.append(i)
            elif t.text in _PAIRS.values():
                if not stack or _PAIRS[self.tokens[stack[-1]].text] != t.text:
                    raise _Error
                self.match[stack.pop()] = i
        if stack:
            raise _Error

    def angle_end(self, i: int, stop: int) -> int | None:
        """Index after the ``>`` that closes the ``<`` at i; None if it is a comparison."""
        depth = 0
        while i < stop:
            t = self.tokens[i].text
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif t in ("(", "["):
                i = self.match[i]
            elif t in ("{", "}", ";", "&&", "||") or self.tokens[i].kind == "string":
                return None
            i += 1
        return None

    def docstring(self, at: int) -> str:
        """The block comment, or run of line comments, that ends just above."""
        line, lines, edge = self.place(at)[0], [], at
        for c in reversed([c for c in self.comments if c.end <= at]):
            first, last = self.place(c.at)[0], self.place(c.end)[0]
            if last < line - 1 or last > line or (lines and c.text.startswith("/*")) or self.content[c.end : edge].strip():
                break
            if c.text.startswith("/*"):
                return "\n".join(x.strip().lstrip("*").strip() for x in c.text[2:-2].splitlines()).strip()
            if self.content[self.starts[first - 1] : c.at].strip():
                break
            lines.append(c.text.lstrip("/").strip())
            line, edge = first, c.at
        return "\n".join(reversed(lines))

    def add(self, kind: int, name: str, scope: list[str], first: int, last: int, signature: str = "", **more) -> int:
        a, b = self.tokens[first].at, self.tokens[last].end
        (line, col), (end_line, end_col) = self.place(a), self.place(b)
        self.out.nodes.append(Symbol(kind, name, "::".join([*scope, name]), line, col, end_line, end_col, signature, self.docstring(a), **more))
        return len(self.out.nodes) - 1

    def statements(self, i: int, stop: int, scope: list[str]) -> None:
        while i < stop:
            i = self.statement(i, stop, scope)

    def statement(self, i: int, stop: int, scope: list[str]) -> int:
        """Reads one declaration and returns the index after it."""
        tokens, begin = self.tokens, i
        text = tokens[i].text
        if text in (";", "}"):
            return i + 1
        if text in ("public", "private", "protected") and i + 1 < stop and tokens[i + 1].text == ":":
            return i + 2
        while i < stop and tokens[i].text in ("template", "inline", "export") and (tokens[i].text == "template" or (i + 1 < stop and tokens[i + 1].text == "namespace")):
            if tokens[i].text == "template" and i + 1 < stop and tokens[i + 1].text == "<":
                i = self.angle_end(i + 1, stop) or stop
            else:
                i += 1
        if i >= stop:
            return stop
        text = tokens[i].text
        if text == "namespace":
            j = i + 1
            while j < stop and tokens[j].text not in ("{", ";", "="):
                j += 1
            if j < stop and tokens[j].text == "{":
                name = "".join(t.text for t in tokens[i + 1 : j] if t.kind == "name" or t.text == "::")
                inner = scope
                if name:
                    self.add(NAMESPACE, name, scope, begin, self.match[j])
                    inner = [*scope, name]
                self.statements(j + 1, self.match[j], inner)
                return self.match[j] + 1
            return self.skip(i, stop)
        if text == "extern" and i + 2 < stop and tokens[i + 1].kind == "string" and tokens[i + 2].text == "{":
            self.statements(i + 3, self.match[i + 2], scope)
            return self.match[i + 2] + 1
        if text == "using" and i + 2 < stop and tokens[i + 1].text == "namespace":
            end = self.skip(i, stop)
            name = "".join(t.text for t in tokens[i + 2 : end] if t.text != ";")
            self.add(TYPE_ALIAS, name, scope, begin, min(end, stop) - 1)
            return end
        if text in ("using", "typedef", "friend", "static_assert"):
            return self.skip(i, stop)
        return self.declaration(begin, i, stop, scope)

    def skip(self, i: int, stop: int) -> int:
        while i < stop:
            if self.tokens[i].text == ";":
                return i + 1
            i = self.match.get(i, i) + 1
        return stop

    def declaration(self, begin: int, i: int, stop: int, scope: list[str]) -> int:
        tokens = self.tokens
        typed, parameters, j = None, None, i
        while j < stop:
            t = tokens[j]
            if t.text == ";":
                return j + 1
            if t.text == "operator" and parameters is None:  # its signs are part of the name
                j += 3 if tokens[j + 1].text == "(" else 1
                while j < stop and tokens[j].text not in ("(", ";"):
                    j += 1
                continue
            if t.text == "=" and parameters is None:
                return self.skip(j, stop)
            if t.text in ("class", "struct", "union", "enum") and typed is None and parameters is None:
                typed = j
            if t.text == "<" and j > i and tokens[j - 1].kind == "name" and tokens[j - 1].text != "operator":
                j = self.angle_end(j, stop) or j + 1
                continue
            if t.text == "(":
                if parameters is None and j > i and not (tokens[j - 1].text in ("__attribute__", "alignas", "decltype", "explicit", "noexcept", "__declspec")):
                    parameters = j
                j = self.match[j] + 1
                continue
            if t.text == "[":
                j = self.match[j] + 1
                continue
            if t.text == "{":
                if parameters is not None:
                    return self.function(begin, i, parameters, j, stop, scope)
                if typed is not None:
                    return self.type(begin, typed, j, stop, scope)
                j = self.match[j] + 1
                continue
            if t.text == ":" and parameters is not None:
                j = self.body_after_initializers(j + 1, stop)
                if j >= stop or tokens[j].text != "{":
                    return self.skip(j, stop)
                return self.function(begin, i, parameters, j, stop, scope)
            j += 1
        return stop

    def body_after_initializers(self, j: int, stop: int) -> int:
        """Index of the body after a constructor's initializers: the brace that follows no name."""
        while j < stop:
            t = self.tokens[j]
            if t.text == ";":
                return j
            if t.text == "<" and self.tokens[j - 1].kind == "name":
                j = self.angle_end(j, stop) or j + 1
                continue
            if t.text == "{" and self.tokens[j - 1].kind != "name" and self.tokens[j - 1].text != ">":
                return j
            j = self.match.get(j, j) + 1
        return stop

    def type(self, begin: int, at: int, brace: int, stop: int, scope: list[str]) -> int:
        tokens, word = self.tokens, self.tokens[at].text
        j = at + 1
        if word == "enum" and tokens[j].text in ("class", "struct"):
            j += 1
        name = ""
        while j < brace and tokens[j].text != ":":
            if tokens[j].text == "(" or tokens[j].text == "[":
                j = self.match[j]
            elif tokens[j].kind == "name" and tokens[j].text not in ("final", "alignas", "__attribute__", "__declspec") and not (j + 1 < brace and tokens[j + 1].kind == "name" and tokens[j + 1].text != "final"):
                name = tokens[j].text
            j += 1
        end = self.match[brace]
        inner = scope
        if name:
            kind = ENUM if word == "enum" else CLASS if word == "class" else STRUCT
            if word != "union":
                self.add(kind, name, scope, at, end)
            inner = [*scope, name]
        if word != "enum":
            self.statements(brace + 1, end, inner)
        return self.skip(end + 1, stop)

    def function(self, begin: int, first: int, parameters: int, brace: int, stop: int, scope: list[str]) -> int:
        tokens = self.tokens
        j = parameters - 1
        if tokens[j].text == ">":  # a specialisation: f<int>(
            depth = 0
            while j > first:
                depth += (tokens[j].text == ">") - (tokens[j].text == "<")
                j -= 1
                if not depth:
                    break
        start = j
        ops = [k for k in range(first, parameters) if tokens[k].text == "operator"]
        if ops:
            start = ops[-1]
            name = "operator" + (" " if tokens[start + 1].kind == "name" else "") + "".join(t.text for t in tokens[start + 1 : parameters])
        elif tokens[j].kind == "name":
            name = tokens[j].text
            if start > first and tokens[start - 1].text == "~":
                start -= 1
                name = "~" + name
        else:
            self.nested(brace + 1, self.match[brace], scope)
            return self.match[brace] + 1
        while start - 2 >= first and tokens[start - 1].text == "::" and tokens[start - 2].kind == "name":
            name = f"{tokens[start - 2].text}::{name}"
            start -= 2
        end = self.match[brace]
        words = {t.text for t in tokens[first:start]}
        signature = self.content[tokens[begin].at : tokens[brace].at].split(b"{")[0].decode("utf-8", "replace").rstrip()
        known = name not in _NOT_CALLED and not (set(name) <= set("~"))
        if known:
            node = self.add(FUNCTION, name, scope, begin, end, signature, is_static="static" in words, is_const="const" in words)
            self.out.refs += [Ref(node, callee, *self.place(at)) for callee, at in self.calls(parameters, end, self.initialized(parameters, brace))]
        self.nested(brace + 1, end, scope)
        return end + 1

    def nested(self, i: int, stop: int, scope: list[str]) -> None:
        """Types that a function body defines."""
        while i < stop:
            t = self.tokens[i]
            if t.text in ("class", "struct", "enum") and self.tokens[i - 1].text in ("{", "}", ";"):
                i = self.declaration(i, i, stop, scope)
            else:
                i += 1

    def initialized(self, parameters: int, brace: int) -> set[int]:
        """Members that a constructor initializes: they look like calls."""
        found, j = set(), self.match[parameters] + 1
        while j < brace:
            if self.tokens[j].kind == "name":
                found.add(j)
            j = self.match.get(j, j) + 1
        return found

    def calls(self, i: int, stop: int, no: set[int]):
        """(name, place) of each call."""
        tokens = self.tokens
        while i < stop:
            t = tokens[i]
            if t.kind == "name" and t.text not in _NOT_CALLED and i not in no:
                after = i + 1
                if after < stop and tokens[after].text == "<":
                    after = self.angle_end(after, stop) or after
                if after < stop and tokens[after].text == "(" and (found := self.callee(i)):
                    yield found, self.tokens[self.expression_start(i)].at
            i += 1

    def expression_start(self, i: int) -> int:
        while i >= 2 and self.tokens[i - 1].text in ("::", ".", "->") and self.tokens[i - 2].kind == "name":
            i -= 2
        return i

    def closes_type(self, i: int) -> bool:
        """Whether the ``>`` at i ends template arguments."""
        for k in range(i - 1, max(0, i - 60), -1):
            if self.tokens[k].text in (";", "{", "}"):
                return False
            if self.tokens[k].text == "<" and self.tokens[k - 1].kind == "name" and self.angle_end(k, i + 1) == i + 1:
                return True
        return False

    def callee(self, i: int) -> str | None:
        tokens = self.tokens
        before = tokens[i - 1] if i else None
        if before is not None and before.text == "template" and i >= 2:
            before = tokens[i - 2]
        member = before is not None and before.text in (".", "->")
        head = i
        while head >= 2 and tokens[head - 1].text == "::" and tokens[head - 2].kind == "name":
            head -= 2
        if head >= 1 and tokens[head - 1].text == "::":
            head -= 1
        lead = tokens[head - 1] if head else None
        if not member and lead is not None and ((lead.kind == "name" and lead.text not in _BEFORE_CALL) or lead.text == "~"):
            return None  # a declaration of a variable, or an allocation
        if not member and lead is not None and lead.text == ">" and self.closes_type(head - 1):
            return None
        if not member and tokens[i].text in _BUILTIN_SET:
            return None
        return tokens[i].text


@register("cpp", "c", "h", "hpp", "hxx", "hh")
def extract(content: bytes) -> Extraction:
    """Symbols and calls of a file, symbols in the order of the text."""
    try:
        scanner = _Scanner(content)
        scanner.statements(0, len(scanner.tokens), [])
    except (_Error, RecursionError, IndexError):
        return Extraction()
    for at, end, name in scanner.includes:
        (line, col), (end_line, end_col) = scanner.place(at), scanner.place(end)
        scanner.out.nodes.append(Symbol(IMPORT, name, name, line, col, end_line, end_col))
    order = sorted(range(len(scanner.out.nodes)), key=lambda k: (scanner.out.nodes[k].line, scanner.out.nodes[k].col, k))
    place = {old: new for new, old in enumerate(order)}
    refs = [Ref(place[r.source], r.ref_name, r.line, r.col) for r in scanner.out.refs]
    return Extraction([scanner.out.nodes[k] for k in order], refs)


def normalize_callee(text: str) -> str:
    """Bare name of a callee: without ``template``, object, scope and template arguments."""
    text = text.strip().removeprefix("template ")
    for sign in ("->", ".", "::"):
        text = text.rsplit(sign, 1)[-1]
    return text.split("<", 1)[0].strip().removeprefix("template ").strip()
