"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {# comment #}   a dash inside a tag's border trims the blanks beside it
    {% if e %} {% elif e %} {% else %} {% endif %}      {% for m in e %} {% endfor %}      {% set name = e %}
    {% generation %} {% endgeneration %}                what a model is to learn to write

Expressions: text and whole numbers, true, false, none, names, ``a.b`` and ``a['b']`` (keys of mappings only, none where
absent), ``not and or``, comparisons, ``in``, ``+`` and ``-`` of two numbers or two texts, ``~`` (joins as text),
``| filter``. Nothing can be called, no attribute of a Python object is reachable, loops run over what they are given,
so every template ends. ``loop`` has index, index0, first, last and previous.

``messages`` may be named once, as the source of a loop: a conversation is then rendered as it streams by and is never
held whole.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

Fragment = tuple[str, bool]  # text, and whether a generation block holds it
_TAG = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>+~|.()\[\]=]))", re.DOTALL)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


def shown(value: object) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def escaper(controls: Sequence[str]) -> Callable[[object], str]:
    """A backslash before every control string and every backslash of a text.

    No control string may hold a backslash, or the first character of one anywhere but at its start. Then none can begin
    inside escaped text, nor end outside what the template itself wrote, and ``unescaped`` is the exact inverse.
    """
    heads = {c[:1] for c in controls}
    if "" in heads or any(x == "\\" or (i and x in heads) for c in controls for i, x in enumerate(c)):
        raise TemplateError(f"unfit control strings {controls}")
    found = re.compile("|".join(["\\\\", *map(re.escape, sorted(controls, key=len, reverse=True))]))
    return lambda value: found.sub(r"\\\g<0>", shown(value))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


# --- syntax tree: ("const", v), ("name", n), ("item", e, key), ("op", f, a, b), ("not", e), ("and"/"or", a, b), ("filter", n, e)


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            text, number, name, sign = m.groups()
            self.tokens.append(("text", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.DOTALL)) if text is not None else ("number", int(number)) if number else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def takes(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def needs(self, kind: str) -> object:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def any_of(self) -> tuple:
        tree = self.all_of()
        while self.takes("or"):
            tree = ("or", tree, self.all_of())
        return tree

    def all_of(self) -> tuple:
        tree = self.negation()
        while self.takes("and"):
            tree = ("and", tree, self.negation())
        return tree

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.takes("not") else self.comparison()

    def comparison(self) -> tuple:
        tree = self.sum()
        while sign := self.takes(*_COMPARE, "in", "not"):
            if sign == "not" and not self.takes("in"):
                raise TemplateError("in expected")
            right = self.sum()
            tree = ("op", _COMPARE[sign], tree, right) if sign in _COMPARE else ("op", _inside, tree, right)
            if sign == "not":
                tree = ("not", tree)
        return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while sign := self.takes("+", "-", "~"):
            tree = ("op", {"+": _plus, "-": _minus, "~": _join}[sign], tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.single()
        while True:
            if self.takes("."):
                tree = ("item", tree, ("const", self.needs("name")))
            elif self.takes("["):
                tree = ("item", tree, self.any_of())
                if not self.takes("]"):
                    raise TemplateError("] expected")
            elif self.takes("|"):
                tree = ("filter", self.needs("name"), tree)
            else:
                return tree

    def single(self) -> tuple:
        if self.takes("("):
            tree = self.any_of()
            if not self.takes(")"):
                raise TemplateError(") expected")
            return tree
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        self.at += 1
        if kind in ("text", "number"):
            return ("const", value)
        if kind == "name":
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError("expression expected")


def _inside(a: object, b: object) -> bool:
    return a in b if isinstance(b, (dict, list, tuple)) or isinstance(a, str) and isinstance(b, str) else False


def _plus(a: object, b: object) -> object:
    if type(a) is not type(b) or not isinstance(a, (int, str)):
        raise TemplateError("+ takes two numbers or two texts")
    return a + b


def _minus(a: object, b: object) -> int:
    if type(a) is not int or type(b) is not int:
        raise TemplateError("- takes two numbers")
    return a - b


def _join(a: object, b: object) -> str:
    return shown(a) + shown(b)


def _item(value: object, key: object) -> object:
    return value.get(key) if isinstance(value, dict) else None


# --- blocks: ("text", s), ("out", e), ("set", name, e), ("if", [(e, body)...], body), ("for", name, e, body), ("mark", body)


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content): text, and the tags {{ }} and {% %} without their borders."""
    out, at = [], 0
    trim = False
    for m in _TAG.finditer(source):
        before, tag = source[at:m.start()], m.group()
        before = before.lstrip() if trim else before
        out.append(("text", before.rstrip() if tag[2:3] == "-" else before))
        trim = tag[-3:-2] == "-" and len(tag) > 4
        if not tag.startswith("{#"):
            out.append((tag[1].replace("{", "out").replace("%", "tag"), tag[2:-2].removeprefix("-").removesuffix("-").strip()))
        at = m.end()
    rest = source[at:]
    out.append(("text", rest.lstrip() if trim else rest))
    if any(re.search(r"\{[{%#]|[%}#]\}", t) for k, t in out if k == "text"):
        raise TemplateError("a tag is not closed")
    return [p for p in out if p != ("text", "")]


def parse(source: str) -> list[tuple]:
    pieces, at = _pieces(source), 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind != "tag":
                nodes.append(("text", content) if kind == "text" else ("out", _Expression(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return nodes, content
            if word == "if":
                arms, otherwise, test = [], [], rest
                while True:
                    held, end = body("elif", "else", "endif")
                    arms.append((_Expression(test).whole(), held))
                    if end.startswith("elif "):
                        test = end[5:]
                        continue
                    if end == "else":
                        otherwise, end = body("endif")
                    break
                nodes.append(("if", arms, otherwise))
            elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)):
                nodes.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.*)", rest, re.DOTALL)):
                nodes.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                nodes.append(("mark", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return nodes, ""

    return body()[0]


def folded(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """The expression with every part that needs no variable worked out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]}")
        inner = folded(tree[2], filters)
        return ("const", filters[tree[1]](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = [folded(x, filters) if isinstance(x, tuple) else x for x in tree[1:]]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    done = (kind, *parts)
    return ("const", _value(done, filters)({})) if all(x[0] == "const" for x in parts if isinstance(x, tuple)) else done


def fold(nodes: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """Constants become text, arms that cannot run go, texts side by side become one."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        made: list[tuple] = []
        if kind == "text":
            made = [node]
        elif kind == "out":
            e = folded(node[1], filters)
            made = [("text", shown(e[1])) if e[0] == "const" else ("out", e)]
        elif kind == "set":
            made = [("set", node[1], folded(node[2], filters))]
        elif kind == "for":
            made = [("for", node[1], folded(node[2], filters), fold(node[3], filters))]
        elif kind == "mark":
            held = fold(node[1], filters)
            made = [("mark", held)] if held else []
        else:
            arms, otherwise = [], fold(node[2], filters)
            for test, held in node[1]:
                test = folded(test, filters)
                if test[0] != "const":
                    arms.append((test, fold(held, filters)))
                elif test[1]:
                    otherwise = fold(held, filters)
                    break
            made = [("if", arms, otherwise)] if arms else otherwise
        for m in made:
            if m[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + m[1])
            elif m != ("text", ""):
                out.append(m)
    return out


def _value(tree: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        const = tree[1]
        return lambda env: const
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "filter":
        f, e = filters[tree[1]], _value(tree[2], filters)
        return lambda env: f(e(env))
    if kind == "not":
        e = _value(tree[1], filters)
        return lambda env: not e(env)
    f = _item if kind == "item" else tree[1] if kind == "op" else None
    a, b = (_value(x, filters) for x in tree[-2:])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env: f(a(env), b(env))


Run = Callable[[dict], Iterator[Fragment]]


def _block(nodes: list[tuple], filters: dict[str, Callable], marked: bool) -> Run:
    steps = [_node(n, filters, marked) for n in nodes]

    def run(env: dict) -> Iterator[Fragment]:
        for step in steps:
            yield from step(env)

    return run


def _node(node: tuple, filters: dict[str, Callable], marked: bool) -> Run:
    kind = node[0]
    if kind == "text":
        fixed = [(node[1], marked)]
        return lambda env: fixed
    if kind == "mark":
        return _block(node[1], filters, True)
    if kind == "if":
        arms, otherwise = [(_value(t, filters), _block(b, filters, marked)) for t, b in node[1]], _block(node[2], filters, marked)
        return lambda env: next((body for test, body in arms if test(env)), otherwise)(env)
    value = _value(node[1] if kind == "out" else node[2], filters)
    if kind == "out":
        return lambda env: [(shown(value(env)), marked)]
    name = node[1]
    if kind == "set":

        def put(env: dict) -> Iterator[Fragment]:
            env[name] = value(env)
            return iter(())

        return put
    body = _block(node[3], filters, marked)

    def loop(env: dict) -> Iterator[Fragment]:
        items, previous, index = iter(value(env) or ()), None, 0
        nothing = object()
        item = next(items, nothing)
        while item is not nothing:
            following = next(items, nothing)
            inner = env | {name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": following is nothing, "previous": previous}}
            yield from body(inner)
            previous, item, index = item, following, index + 1

    return loop


def _names(tree: object) -> Iterator[str]:
    if isinstance(tree, tuple) and tree[:1] == ("name",):
        yield tree[1]
    elif isinstance(tree, (tuple, list)):
        for x in tree:
            yield from _names(x)


def _check(nodes: list[tuple], known: set[str]) -> None:
    """Only names that are set can be used, and ``messages`` only as what a loop runs over, outside any other loop."""
    for node in nodes:
        kind = node[0]
        used = set(_names([t for t, _ in node[1]] if kind == "if" else node[2] if kind in ("for", "set") else node[1] if kind == "out" else []))
        if kind == "for" and node[2] == ("name", "messages"):
            used -= {"messages"}
        if used - known or "messages" in used:
            raise TemplateError(f"names not known here: {sorted(used - known | used & {'messages'})}")
        if kind == "set":
            known = known | {node[1]}
        for held in ([b for _, b in node[1]] + [node[2]] if kind == "if" else [node[3]] if kind == "for" else [node[1]] if kind == "mark" else []):
            _check(held, known | {node[1], "loop"} if kind == "for" else known)


def _loops(nodes: list[tuple], inside: bool = False) -> int:
    n = 0
    for node in nodes:
        own = node[0] == "for" and node[2] == ("name", "messages")
        if own and inside:
            raise TemplateError("messages can only be read once")
        for held in ([b for _, b in node[1]] + [node[2]] if node[0] == "if" else [node[3]] if node[0] == "for" else [node[1]] if node[0] == "mark" else []):
            n += _loops(held, inside or node[0] == "for")
        n += own
    return n


def compiled(source: str, controls: Sequence[str]) -> Callable[[Iterable[dict]], Iterator[Fragment]]:
    """Renders an iterable of mappings (role, text) to fragments. ``controls`` are what ``| escape`` protects."""
    filters = {"escape": escaper(controls), "trim": lambda v: shown(v).strip(), "upper": lambda v: shown(v).upper(), "lower": lambda v: shown(v).lower()}
    nodes = fold(parse(source), filters)
    _check(nodes, {"messages"})
    if _loops(nodes) > 1:
        raise TemplateError("messages can only be read once")
    run = _block(nodes, filters, False)
    return lambda messages: run({"messages": messages})
