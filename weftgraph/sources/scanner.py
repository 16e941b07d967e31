"""Facts of sources in brace languages and Ruby by a lexical scanner.

A language is a :class:`Spec`: its comments and strings, the shape of its
definitions and imports, words that look like calls and are none.  The scanner
blanks out comments and strings, pairs brackets, and reads definitions with their
bodies, members, imports, inheritance, calls with their arguments and simple
assignments from what is left.  It knows no types and no preprocessor.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from dataclasses import dataclass

_NAME = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_CONTAINERS = ("class", "struct", "interface", "trait", "enum", "impl", "extension", "module", "namespace", "object")
_CONTROL = "if for while switch catch return sizeof do else case new throw await typeof in of and or not unless until elsif defined function fn func fun def super using lock foreach synchronized assert yield import"
#: Words of one language only.
_MORE = {"go": ("go", "defer", "select", "range"), "rust": ("match", "loop"), "kotlin": ("when",), "cangjie": ("match",), "php": ("match",), "ruby": ("when",), "csharp": ("when",)}
#: Words before a bracket that a definition with a type or of a member is not.
_NO_NAME = frozenset("if for while switch catch return else do function foreach using lock synchronized".split())


@dataclass(frozen=True)
class Spec:
    """How one language looks; a definition pattern has the groups ``name`` and, where there is one, ``params``."""

    definitions: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]
    line_comment: tuple[str, ...] = ("//",)
    block_comment: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    strings: tuple[str, ...] = ('"', "'")
    raw_strings: tuple[str, ...] = ()
    bases: str | None = None
    ends: bool = False  # bodies end with a word and not a brace


def _spec(definitions, imports, **more) -> Spec:
    return Spec(tuple((k, p.replace("NAME", _NAME)) for k, p in definitions), tuple(p.replace("NAME", _NAME) for p in imports), **more)


_PARAMS = r"\((?P<params>[^(){};]*(?:\([^(){};]*\)[^(){};]*)*)\)"
_TYPED = r"(?:^|(?<=[;{}\n]))[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|inline|extern|constexpr|const|unsafe|partial|readonly|native|default|explicit)\s+)*(?:[\w$:]+(?:<[^;{}()]*>)?(?:\[\])*[\s*&?]+)+(?:NAME::)*(?P<name>~?NAME)\s*" + _PARAMS + r"(?:\s*(?:const|noexcept|override|final|throws\s+[\w., ]+|->\s*[\w:<>]+))*\s*(?=[{])"
_METHOD = r"(?:^|(?<=[;{}\n]))[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|\*)\s+)*(?P<name>NAME)\s*" + _PARAMS + r"(?:\s*:\s*[^={};]+)?\s*(?=[{])"
_SCRIPT = [
    ("class", r"\bclass\s+(?P<name>NAME)"),
    ("function", r"\bfunction\s*\*?\s*(?P<name>NAME)\s*" + _PARAMS),
    ("function", r"\b(?:const|let|var)\s+(?P<name>NAME)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\s*)?" + _PARAMS + r"(?:\s*:\s*[^={};]+)?\s*=>"),
    ("method", _METHOD),
]
_CONSTRUCTOR = r"(?:^|(?<=[;{}\n]))[ \t]*(?:(?:public|private|protected|internal|explicit)\s+)*(?P<name>~?[A-Z]\w*)\s*" + _PARAMS + r"(?:\s*(?:throws\s+[\w., ]+|:\s*[^;{}]*))?\s*(?=[{])"
_SCRIPT_IMPORTS = [r"\bimport\s+(?:type\s+)?(?P<what>[^'\"`;]*?)\s*from\s*(?P<module>STRING)", r"\bimport\s*(?P<module>STRING)", r"\brequire\s*\(\s*(?P<module>STRING)\s*\)", r"\bexport\s+(?P<what>[^'\"`;]*?)\s*from\s*(?P<module>STRING)"]
_BASES = r"\b(?:extends|implements)\s+(?P<bases>[\w$.,<> ]+?)(?=\s*(?:implements\b|extends\b|\{))"
_COLON_BASES = r"(?:class|struct|interface)\s+NAME(?:<[^{}()]*>)?\s*(?:\([^(){}]*\))?\s*:\s*(?P<bases>[^{};]+?)\s*\{".replace("NAME", _NAME)
_INCLUDE = [r"^[ \t]*#[ \t]*include[ \t]*(?P<module>STRING|<[^>\n]+>)"]

#: Specifications by language.
SPECS = {
    "c": _spec([("struct", r"\bstruct\s+(?P<name>NAME)\s*(?=\{)"), ("enum", r"\benum\s+(?P<name>NAME)\s*(?=\{)"), ("function", _TYPED)], _INCLUDE),
    "cpp": _spec([("namespace", r"\bnamespace\s+(?P<name>NAME)\s*(?=\{)"), ("class", r"\bclass\s+(?P<name>NAME)[^;{}()]*(?=\{)"), ("struct", r"\bstruct\s+(?P<name>NAME)[^;{}()]*(?=\{)"), ("enum", r"\benum\s+(?:class\s+)?(?P<name>NAME)[^;{}()]*(?=\{)"), ("function", _TYPED), ("constructor", _CONSTRUCTOR)], _INCLUDE, bases=_COLON_BASES),
    "csharp": _spec([("namespace", r"\bnamespace\s+(?P<name>[\w.]+)"), ("class", r"\b(?:class|record)\s+(?P<name>NAME)"), ("struct", r"\bstruct\s+(?P<name>NAME)"), ("interface", r"\binterface\s+(?P<name>NAME)"), ("enum", r"\benum\s+(?P<name>NAME)"), ("method", _TYPED), ("constructor", _CONSTRUCTOR)], [r"^[ \t]*using\s+(?:static\s+)?(?P<module>[\w.]+)\s*;"], bases=_COLON_BASES),
    "java": _spec([("class", r"\b(?:class|record)\s+(?P<name>NAME)"), ("interface", r"\binterface\s+(?P<name>NAME)"), ("enum", r"\benum\s+(?P<name>NAME)"), ("method", _TYPED), ("constructor", _CONSTRUCTOR)], [r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.]*\w(?:\.\*)?)\s*;"], bases=_BASES),
    "javascript": _spec(_SCRIPT, _SCRIPT_IMPORTS, strings=('"', "'", "`"), bases=_BASES),
    "typescript": _spec([*_SCRIPT, ("interface", r"\binterface\s+(?P<name>NAME)"), ("enum", r"\benum\s+(?P<name>NAME)"), ("type_alias", r"\btype\s+(?P<name>NAME)(?:<[^={}]*>)?\s*=")], _SCRIPT_IMPORTS, strings=('"', "'", "`"), bases=_BASES),
    "arkts": _spec([*_SCRIPT, ("struct", r"\bstruct\s+(?P<name>NAME)"), ("interface", r"\binterface\s+(?P<name>NAME)"), ("enum", r"\benum\s+(?P<name>NAME)")], _SCRIPT_IMPORTS, strings=('"', "'", "`"), bases=_BASES),
    "go": _spec([("struct", r"\btype\s+(?P<name>NAME)\s+struct\b"), ("interface", r"\btype\s+(?P<name>NAME)\s+interface\b"), ("method", r"\bfunc\s*\((?P<receiver>[^()]*)\)\s*(?P<name>NAME)\s*" + _PARAMS), ("function", r"\bfunc\s+(?P<name>NAME)\s*(?:\[[^\]]*\])?\s*" + _PARAMS)], [r"\bimport\s+(?:NAME\s+)?(?P<module>STRING)", r"^[ \t]+(?:NAME\s+|_\s+|\.\s+)?(?P<module>STRING)[ \t]*$"], raw_strings=("`",)),
    "rust": _spec([("module", r"\bmod\s+(?P<name>NAME)\s*(?=\{)"), ("struct", r"\bstruct\s+(?P<name>NAME)"), ("enum", r"\benum\s+(?P<name>NAME)"), ("trait", r"\btrait\s+(?P<name>NAME)"), ("impl", r"\bimpl(?:<[^{}]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>NAME)[^;{}]*(?=\{)"), ("function", r"\bfn\s+(?P<name>NAME)\s*(?:<[^(){}]*>)?\s*" + _PARAMS)], [r"\buse\s+(?P<module>[\w:]+(?:::\{[^}]*\}|::\*)?)(?:\s+as\s+\w+)?\s*;"], strings=('"',)),
    "kotlin": _spec([("class", r"\bclass\s+(?P<name>NAME)"), ("interface", r"\binterface\s+(?P<name>NAME)"), ("object", r"\bobject\s+(?P<name>NAME)"), ("function", r"\bfun\s+(?:<[^(){}]*>\s*)?(?:[\w<>?]+\.)?(?P<name>NAME)\s*" + _PARAMS)], [r"^[ \t]*import\s+(?P<module>[\w.]*\w(?:\.\*)?)"], bases=_COLON_BASES),
    "php": _spec([("class", r"\bclass\s+(?P<name>NAME)"), ("interface", r"\binterface\s+(?P<name>NAME)"), ("trait", r"\btrait\s+(?P<name>NAME)"), ("function", r"\bfunction\s+&?(?P<name>NAME)\s*" + _PARAMS)], [r"^[ \t]*use\s+(?P<module>[\w\\]+)(?:\s+as\s+\w+)?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*(?P<module>STRING)"], line_comment=("//", "#"), bases=_BASES),
    "cangjie": _spec([("class", r"\bclass\s+(?P<name>NAME)"), ("struct", r"\bstruct\s+(?P<name>NAME)"), ("interface", r"\binterface\s+(?P<name>NAME)"), ("enum", r"\benum\s+(?P<name>NAME)"), ("function", r"\bfunc\s+(?P<name>NAME)\s*(?:<[^(){}]*>)?\s*" + _PARAMS)], [r"^[ \t]*import\s+(?P<module>[\w.]*\w(?:\.\*)?)"]),
    "ruby": _spec([("module", r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)"), ("class", r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)"), ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>NAME[?!=]?)(?:[ \t]*" + _PARAMS + r")?")], [r"^[ \t]*require(?:_relative)?\s*\(?\s*(?P<module>STRING)"], line_comment=("#",), block_comment=(("\n=begin", "\n=end"),), bases=r"\bclass\s+[\w:]+\s*<\s*(?P<bases>[\w:]+)", ends=True),
}


def blanked(text: str, spec: Spec) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with comments and the insides of strings as blanks (line ends stay), and where the strings are."""
    marks = [*spec.line_comment, *(a for a, _ in spec.block_comment), *spec.strings, *spec.raw_strings]
    opening = re.compile("|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))
    ends = dict(spec.block_comment)
    out, strings, done = [], [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while m := opening.search(text, done):
        out.append(text[done : m.start()])
        mark = m.group()
        if mark in spec.line_comment:
            end = text.find("\n", m.end())
            end = len(text) if end < 0 else end
            out.append(blank(text[m.start() : end]))
        elif mark in ends:
            end = text.find(ends[mark], m.end())
            end = len(text) if end < 0 else end + len(ends[mark])
            out.append(blank(text[m.start() : end]))
        else:
            end = m.end()
            while end < len(text) and text[end] != mark and (text[end] != "\n" or mark in ("`", *spec.raw_strings)):
                end += 2 if text[end] == "\\" and mark not in spec.raw_strings else 1
            end = min(end + 1, len(text))
            strings.append((m.start(), end))
            out.append(mark + blank(text[m.start() + 1 : end - 1]) + text[end - 1 : end] if end - m.start() > 1 else mark)
        done = end
    return "".join([*out, text[done:]]), strings


def paired(text: str) -> dict[int, int]:
    """Where each opening bracket of blanked text is closed; those that never are end with the text."""
    open_, out = [], {}
    for m in re.finditer(r"[()\[\]{}]", text):
        if m.group() in "([{":
            open_.append(m.start())
        else:
            while open_ and text[open_[-1]] + m.group() not in ("()", "[]", "{}"):
                out[open_.pop()] = m.start()  # not closed by its own kind
            if open_:
                out[open_.pop()] = m.start()
    return out | {k: len(text) for k in open_}


_RUBY_OPEN = re.compile(r"^[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*$)|=[ \t]*(?:if|case|begin)\b", re.M)
_RUBY = re.compile(_RUBY_OPEN.pattern + r"|^[ \t]*(?P<end>end)\b", re.M)


def _word_bodies(text: str) -> dict[int, int]:
    """For each word that opens a body, by the end of its leading blanks, where the body's ``end`` ends."""
    open_, out = [], {}
    for m in _RUBY.finditer(text):
        if m["end"]:
            if open_:
                out[open_.pop()] = m.end()
        else:
            open_.append(m.start() + len(m.group()) - len(m.group().lstrip()))
    return out | {k: len(text) for k in open_}


def _arguments(text: str, start: int, end: int, pairs: dict[int, int]) -> list[str]:
    """What lies between the commas of a bracket, those of inner brackets left alone."""
    parts, at, k = [], start, start
    while k < end:
        if text[k] in "([{" and k in pairs:
            k = pairs[k]
        elif text[k] == ",":
            parts.append(text[at:k].strip())
            at = k + 1
        k += 1
    parts.append(text[at:end].strip())
    return parts if any(parts) else []


def extract_source(path: str, language: str, text: str) -> list[tuple]:
    """Fact rows of one source, in the columns of ``FACT``; positions are byte offsets and 0-based lines."""
    spec = SPECS[language]
    data = text.encode(errors="surrogatepass").decode("latin-1")  # a character is a byte
    plain, strings = blanked(data, spec)
    pairs = paired(plain)
    bodies = _word_bodies(plain) if spec.ends else {}
    lines = [m.start() for m in re.finditer("\n", data)]
    line = lambda at: bisect.bisect_left(lines, at)
    back = lambda s: s.encode("latin-1").decode(errors="replace")
    rows: list[tuple] = []

    found = []
    for kind, pattern in spec.definitions:
        for m in re.finditer(pattern, plain, re.M):
            name = m["name"]
            if name in _NO_NAME:
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if spec.ends:
                end = bodies.get(start, m.end())
            else:
                brace = re.compile(r"[{;]").search(plain, m.end())
                end = pairs[brace.start()] + 1 if brace and brace.group() == "{" else brace.start() if brace else len(plain)
            groups = m.groupdict()
            found.append((start, end, kind, name, m.start("name"), groups.get("params"), groups.get("receiver")))
    unique: dict = {}
    for f in sorted(found, key=lambda f: (f[4], f[2] == "method", -f[1])):
        unique.setdefault(f[4], f)  # one definition at a name
    found = sorted(unique.values(), key=lambda f: (f[0], -f[1]))

    def add(fact, kind, name, qualified, start, end, parent=None, target=None, arity=None, payload=None):
        key = hashlib.sha256("\0".join((path, fact, kind, qualified, str(start), str(end))).encode(errors="replace")).hexdigest()
        rows.append((path, fact, key, parent, kind, name, qualified, target, arity, start, end, line(start), line(max(start, end - 1)), None if payload is None else json.dumps(payload)))

    add("scope", "module", "module", "module", 0, len(data))
    stack: list[tuple[int, str, str]] = []  # end, kind, qualified name
    held = []
    for start, end, kind, name, at, params, receiver in found:
        while stack and stack[-1][0] <= start:
            stack.pop()
        inside = stack[-1] if stack else None
        parent = inside[2] if inside else None
        if receiver:
            parent = back(re.findall(_NAME, receiver)[-1]) if re.findall(_NAME, receiver) else None
        if kind in ("function", "method"):
            kind = "method" if receiver or (inside and inside[1] in _CONTAINERS and inside[1] not in ("namespace", "module")) else "function"
        qualified = ".".join(x for x in (parent, back(name)) if x)
        args = None if params is None else [a for a in _arguments(plain, *_span(plain, params, at), pairs) if a != "void"]
        names = [back((re.findall(_NAME, a.split("=")[0].split(":")[0]) or ["?"])[0 if language in ("go", "rust", "kotlin", "typescript", "arkts", "cangjie", "javascript", "ruby") else -1]) for a in args or []]
        if kind != "impl":
            add("symbol", kind, back(name), qualified, start, end, parent, None, None if args is None else len(args), {"exported": not name.startswith("_")})
        add("scope", kind, back(name), qualified, start, end, parent)
        for i, p in enumerate(names):
            add("binding", "parameter", p, p, at, at + len(name), qualified, payload={"arg_index": i})
        stack.append((end, kind, parent if kind == "impl" and parent else qualified))
        held.append((start, end, qualified))

    def owner(at: int) -> str | None:
        best = None
        for start, end, qualified in held[: bisect.bisect_right(held, (at, 1 << 62, ""))]:
            if at < end:
                best = qualified
        return best

    taken = {f[4] for f in found}
    if spec.bases:
        for m in re.finditer(spec.bases, plain, re.M):
            for base in re.finditer(r"[A-Za-z_][\w.:\\]*", re.sub(r"<[^<>]*>", lambda g: " " * len(g.group()), m["bases"])):
                word = base.group()
                if word not in ("public", "private", "protected", "virtual", "implements", "extends"):
                    start = m.start("bases") + base.start()
                    add("reference", "inheritance", back(word), back(word), start, start + len(word), owner(start))
    starts = {a: b for a, b in strings}
    for pattern in spec.imports:
        for m in re.finditer(pattern.replace("STRING", r"[\"'`][^\"'`\n]*[\"'`]"), plain, re.M):
            a, b = m.span("module")
            module = data[a + 1 : starts[a] - 1] if a in starts else data[a:b].strip("<>")
            inner = re.search(r"\{([^}]*)\}", module)
            last = module.rpartition("/")[2] if data[a] == "<" or "#" in m.group() else re.split(r"[./:\\]+", module.rstrip("/*.:"))[-1]
            what = re.findall(_NAME + r"|\*", m.groupdict().get("what") or (inner and inner[1]) or "") or [last]
            for name in what:
                if name not in ("as", "type", "default", "self"):
                    add("import", "import", back(name), back(name), m.start(), m.end(), target=back(module), payload={"wildcard": module.endswith("*") or name == "*", "relative": module.startswith(".")})
    for m in re.finditer(rf"(?<![\w$.])(?P<receiver>(?:(?:{_NAME}|\))(?:\.|->|::|\?\.))*)(?P<name>{_NAME})(?:!)?(?:<[\w:, ]*>)?\s*(?P<open>\()", plain):
        name = m["name"]
        if m.start("name") in taken or name in _CONTROL.split() or name in _MORE.get(language, ()):
            continue
        close = pairs[m.start("open")]
        args = _arguments(plain, m.end("open"), close, pairs)
        receiver = back(re.sub(r"(\.|->|::|\?\.)$", "", m["receiver"])) or None
        before = plain[: m.start()].rstrip()[-4:]
        kind = "instantiation" if re.search(r"\bnew$", before) else "call"
        add("reference", kind, back(name), back(name), m.start("name"), m.end("name"), owner(m.start()), receiver, len(args))
        add("callsite", kind, back(m["receiver"] + name), back(m["receiver"] + name), m.start(), min(close + 1, len(data)), owner(m.start()), receiver, len(args), [back(a) for a in args])
    for m in re.finditer(rf"(?<![\w$.>=!<])(?P<to>{_NAME})\s*(?::\s*[\w<>\[\]?]+\s*)?:?=(?![=>~])\s*(?P<of>[^;\n{{]*)", plain):
        if m["to"] not in _CONTROL.split():
            add("binding", "local", back(m["to"]), back(m["to"]), m.start("to"), m.end("to"), owner(m.start()))
            for s in sorted(set(re.findall(rf"(?<![\w$.]){_NAME}(?!\s*[(\w$\x80-\xff])", m["of"]))):
                add("dataflow", "assign", back(m["to"]), back(m["to"]), m.start(), m.end(), owner(m.start()), back(s))
    for m in re.finditer(r"\breturn\b(?P<of>[^;\n}]*)", plain):
        for s in sorted(set(re.findall(rf"(?<![\w$.]){_NAME}(?!\s*[(\w$\x80-\xff])", m["of"]))):
            add("dataflow", "return", "return", "return", m.start(), m.end(), owner(m.start()), back(s))
    return rows


def _span(plain: str, params: str, at: int) -> tuple[int, int]:
    start = plain.find("(" + params, at) + 1
    return start, start + len(params)
