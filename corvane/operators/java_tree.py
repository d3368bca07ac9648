"""The declarations of a Java source as a tree, by recursive descent over its tokens.

Nodes are declarations (of any depth: nested, local and anonymous types have members too),
class literals and comments.  What tells a declaration apart is parsed; statements and
expressions are only followed as far as declarations may stand in them.  Broken sources
give what can be made out; every token is read once.  Columns count UTF-8 bytes.
"""

from __future__ import annotations

import bisect
import re

_TOKEN = re.compile(r'(//[^\n]*|/\*.*?(?:\*/|\Z))|("""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|[\w$]+|\S', re.S)
_MODIFIERS = frozenset("public protected private static final abstract synchronized native default strictfp transient volatile sealed".split())
_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
ANNOTATION_TYPE, METHOD, CONSTRUCTOR, FIELD, LITERAL = "annotation_type_declaration", "method_declaration", "constructor_declaration", "field_declaration", "class_literal"
COMMENTS = _LINE, _BLOCK = "line_comment", "block_comment"


class Node:
    """A node; ``doc`` is the comment that stands right before it, among its siblings."""

    __slots__ = ("kind", "name", "modifiers", "start", "end", "doc", "parent", "before")

    def __init__(self, kind, start, name=None, modifiers=(), doc=None):
        self.kind, self.start, self.name, self.modifiers, self.doc = kind, start, name, modifiers, doc
        self.end, self.parent, self.before = start, None, None


class _Parser:
    def __init__(self, source: str):
        self.source, self.nodes, self.at = source, [], 0
        self.words, self.starts, self.ends, self.comment_before = [], [], [], {}
        last = None
        for m in _TOKEN.finditer(source):
            if m[1]:
                last = Node(_LINE if m[1].startswith("//") else _BLOCK, m.start())
                last.end = m.end()
                self.nodes.append(last)
                continue
            if last:
                self.comment_before[len(self.words)] = last
                last = None
            self.words.append('""' if m[2] else m[0])
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.words += [""] * 3  # the end, seen from any token
        self.n = len(self.starts)
        while self.at < self.n:
            if self.words[self.at] == "}":
                self.at += 1
            else:
                self.member("")

    def word(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead] if self.at + ahead < self.n else ""

    def named(self, ahead: int = 0) -> bool:
        w = self.word(ahead)
        return w != "" and (w[0].isalpha() or w[0] in "_$")

    def open(self, kind: str, first: int, name=None, modifiers=()) -> Node:
        node = Node(kind, self.starts[first], name, modifiers, self.comment_before.get(first))
        self.nodes.append(node)
        return node

    def close(self, node: Node) -> None:
        node.end = self.ends[min(self.at, self.n) - 1]

    # types and their members

    def modifiers(self) -> list[str]:
        found = []
        while True:
            w = self.word()
            if w in _MODIFIERS:
                found.append(w)
                self.at += 1
            elif w == "non" and self.word(1) == "-" and self.word(2) == "sealed":
                found.append("non-sealed")
                self.at += 3
            elif w == "@" and self.word(1) != "interface":
                self.annotation()
            else:
                return found

    def annotation(self) -> None:
        self.at += 1
        while self.named() or self.word() == ".":
            self.at += 1
            if self.named(-1) and self.word() != ".":
                break
        if self.word() == "(":
            self.inside()

    def type_ahead(self) -> bool:
        w = self.word()
        if w == "@":
            return self.word(1) == "interface"
        return self.named(1) and (w in ("class", "interface", "enum") or w == "record" and self.word(2) in ("(", "<"))

    def type_declaration(self, first: int, modifiers: list[str]) -> None:
        word = self.word()
        kind = ANNOTATION_TYPE if word == "@" else _TYPES[word]
        self.at += 2 if word == "@" else 1
        node = self.open(kind, first, self.word(), modifiers)
        while self.word() not in ("", "{", "}", ";"):
            if self.word() == "(":
                self.inside()
            else:
                self.at += 1
        if self.word() == "{":
            self.body(word)
        self.close(node)

    def body(self, kind: str) -> None:
        self.at += 1
        if kind == "enum":
            while self.word() not in ("", ";", "}"):
                if self.word() == "(":
                    self.inside()
                elif self.word() == "{":
                    self.body("class")
                else:
                    self.at += 1
        while self.word() not in ("", "}"):
            self.member(kind)
        self.at += 1

    def member(self, kind: str) -> None:
        first = self.at
        if self.word() in (";", "{"):
            self.piece()
            return
        modifiers = self.modifiers()
        if self.type_ahead():
            self.type_declaration(first, modifiers)
            return
        name, words, typed = None, 0, self.word() == "<"
        while True:
            w = self.word()
            if w == "<":
                self.angles()
                continue
            if w == "(" and name and not (kind == "" and not words):
                self.callable(first, kind, name, words, modifiers)
                return
            if w == "{":  # static and instance blocks, compact constructors, broken members
                self.piece()
                return
            if w in ("", "}"):
                return
            if w in ("=", ";", ",") or w == "(":
                break
            if w == "@":
                self.annotation()
                continue
            if self.named():
                name, words = w, words + 1
            self.at += 1
        if name is None and not typed and not modifiers and w != ";":
            self.piece()
            return
        node = self.open(FIELD, first, name, modifiers) if kind else None
        while self.word() not in ("", ";", "}"):
            self.piece()
        if self.word() == ";":
            self.at += 1
        if node:
            self.close(node)

    def callable(self, first: int, kind: str, name: str, words: int, modifiers: list[str]) -> None:
        what = "annotation_type_element_declaration" if kind == "@" else CONSTRUCTOR if words == 1 else METHOD
        node = self.open(what, first, name, modifiers)
        self.inside()
        while self.word() not in ("", ";", "{", "}"):
            if self.word() == "default":  # of an annotation's element, maybe an array
                while self.word() not in ("", ";", "}"):
                    self.piece()
                break
            self.at += 1
        if self.word() == "{":
            self.piece()
        elif self.word() == ";":
            self.at += 1
        self.close(node)

    def angles(self) -> None:
        depth = 0
        while self.word() not in ("", ";", "{", "}"):
            w = self.word()
            depth += (w == "<") - (w == ">")
            self.at += 1
            if depth == 0:
                return

    # code, as far as declarations may stand in it

    def inside(self) -> None:
        """What stands in brackets, ( or {; a ( also ends where its { does."""
        end = ")" if self.word() == "(" else "}"
        self.at += 1
        while self.word() not in ("", end, "}"):
            self.piece()
        self.at += self.word() == end

    def piece(self) -> None:
        w = self.word()
        if w in ("(", "{"):
            self.inside()
        elif w == "new":
            self.creation()
        elif w in ("class", "interface", "enum", "record", "@") or w in _MODIFIERS:
            first = self.at
            if self.at and self.words[self.at - 1] == ".":
                self.at += 1
                if w == "class":
                    self.at -= 1
                    node = self.open(LITERAL, first)
                    self.at += 1
                    self.close(node)
                return
            modifiers = self.modifiers()
            if self.type_ahead():
                self.type_declaration(first, modifiers)
            elif self.at == first:
                self.at += 1
        else:
            self.at += 1

    def creation(self) -> None:
        self.at += 1
        while True:
            w = self.word()
            if w == "@":
                self.annotation()
            elif w == "<":
                self.angles()
            elif self.named() or w == ".":
                self.at += 1
            else:
                break
        if self.word() == "(":
            self.inside()
            if self.word() == "{":
                self.body("class")


def parsed(source: str) -> list[Node]:
    """Nodes in no order; RecursionError where blocks are nested too deep."""
    return _Parser(source).nodes


def java_tree(source: str) -> list[Node]:
    """The nodes in walk order (each before what is in it), with parents and what sibling is
    the one before; none where blocks are nested too deep."""
    try:
        nodes = parsed(source)
    except RecursionError:
        return []
    nodes.sort(key=lambda x: (x.start, -x.end))
    around, last = [], {None: None}
    for node in nodes:
        while around and around[-1].end <= node.start:
            around.pop()
        node.parent = around[-1] if around else None
        node.before, last[node.parent] = last.get(node.parent), node
        around.append(node)
    return nodes


class Places:
    """Line (from 1) and column, in bytes, of positions in a text."""

    def __init__(self, source: str):
        self.source, self.plain = source, source.isascii()
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def of(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at)
        start = self.starts[line - 1]
        return line, at - start if self.plain else len(self.source[start:at].encode("utf-8", "replace"))


def attached_doc(node: Node, places: Places, source: str) -> Node | None:
    """The doc comment right before a declaration, that ends at most one line above it."""
    doc = node.doc
    if doc is None or not source.startswith("/**", doc.start):
        return None
    return doc if places.of(node.start)[0] - places.of(doc.end)[0] <= 1 else None
