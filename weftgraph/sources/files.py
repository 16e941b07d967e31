"""Source trees as facts: discovery, decoding, extraction.

Discovery lists paths with Spark's file source; decoding and extraction run in
the tasks, one file at a time, and a file that fails gives a diagnostic row
instead of facts.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.columns import LANGUAGES, any_of, glob_regex, language_of
from weftgraph.sources import scanner

EXTENSIONS = tuple(LANGUAGES)


def discover(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, ignored: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``path, size, modified, language`` of the source files below ``root``, without reading them.

    ``include``, ``exclude`` and ``ignored`` are globs relative to the root.  With a
    ``limit`` one row more is asked for, so the caller can tell a cut listing.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.substring_index("path", base, -1), r"^file:/+", "")
    out = rows.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = out.withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    if include:
        out = out.where(any_of([F.col("path").rlike(glob_regex(g)) for g in include]))
    for g in [*(exclude or []), *(ignored or [])]:
        out = out.where(~F.col("path").rlike(glob_regex(g)))
    return out if limit is None else out.orderBy("path").limit(limit + 1)


def decode_bytes(data: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8, else GBK if it decodes, else windows-1252 (undefined bytes replaced)."""
    for encoding in ("utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8", "gbk"):
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if encoding != "gbk" or sum(0x4E00 <= ord(c) < 0xA000 or ord(c) < 0x80 for c in text) == len(text):
            return text, encoding
    return data.decode("cp1252", errors="replace"), "cp1252"


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """``path, language, text, encoding, raw_hash, text_hash`` of every source file; hashes of the bytes and of the decoded text."""
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.select(F.substring_index("path", base, -1).alias("path"), "content").withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [decode_bytes(bytes(c)) for c in frame["content"]]
            yield pd.DataFrame(
                {
                    "path": frame["path"],
                    "language": frame["language"],
                    "text": [t for t, _ in texts],
                    "encoding": [e for _, e in texts],
                    "raw_hash": [hashlib.sha256(bytes(c)).hexdigest() for c in frame["content"]],
                    "text_hash": [hashlib.sha256(t.encode()).hexdigest() for t, _ in texts],
                }
            )

    return rows.mapInPandas(run, "path string, language string, text string, encoding string, raw_hash string, text_hash string")


FACT = "path string, fact string, id string, parent string, kind string, name string, qualified_name string, target string, arity int, start_byte int, end_byte int, start_line int, end_line int, payload string"


class _Python(ast.NodeVisitor):
    """Facts of one Python module; positions are 0-based lines and byte offsets."""

    def __init__(self, path: str, text: str):
        self.path, self.rows, self.stack, self.scopes = path, [], [], ["module"]
        self.offsets = [0]
        for line in text.encode().split(b"\n"):
            self.offsets.append(self.offsets[-1] + len(line) + 1)

    def at(self, line: int, column: int) -> int:
        return self.offsets[line - 1] + column

    def add(self, fact: str, node, kind: str, name: str, target: str | None = None, arity: int | None = None, payload=None, parent: str | None = None) -> str:
        start, end = (self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)) if hasattr(node, "lineno") else (0, self.offsets[-1])
        qualified = ".".join([*self.stack, name]) if fact in ("symbol", "scope") else name
        key = hashlib.sha256("\0".join((self.path, fact, kind, qualified, str(start), str(end))).encode()).hexdigest()
        lines = (node.lineno - 1, node.end_lineno - 1) if hasattr(node, "lineno") else (0, len(self.offsets) - 2)
        self.rows.append((self.path, fact, key, parent or ".".join(self.stack) or None, kind, name, qualified, target, arity, start, end, *lines, json.dumps(payload) if payload is not None else None))
        return key

    def visit_Module(self, node):
        self.add("scope", node, "module", "module")
        self.generic_visit(node)

    def _definition(self, node, kind: str):
        if kind == "function" and len(self.scopes) > 1 and self.scopes[-1] == "class":
            kind = "method"
        parameters = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]] if kind != "class" else None
        self.add("symbol", node, kind, node.name, arity=None if parameters is None else len(parameters), payload={"exported": not node.name.startswith("_"), "async": isinstance(node, ast.AsyncFunctionDef)})
        self.add("scope", node, kind, node.name)
        for d in node.decorator_list:
            self.add("reference", d, "decoration", _dotted(d.func if isinstance(d, ast.Call) else d) or "?", target=node.name)
        for base in getattr(node, "bases", []):
            self.add("reference", base, "inheritance", _dotted(base) or "?")
        self.stack.append(node.name)
        self.scopes.append(kind)
        for i, p in enumerate(parameters or []):
            self.add("binding", node, "parameter", p, payload={"arg_index": i})
        if kind != "class":
            self._cfg(node)
        for child in node.body:
            self.visit(child)
        self.scopes.pop()
        self.stack.pop()

    def visit_FunctionDef(self, node):
        self._definition(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self._definition(node, "class")

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", node, "import", a.asname or a.name, target=a.name)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", node, "from_import", a.asname or a.name, target=f"{module}:{a.name}", payload={"wildcard": a.name == "*", "relative": node.level > 0})

    def visit_Call(self, node):
        name = _dotted(node.func)
        if name:
            args = [_dotted(a) or type(a).__name__.lower() for a in node.args]
            self.add("reference", node.func, "call", name.rsplit(".", 1)[-1], target=name.rpartition(".")[0] or None, arity=len(node.args))
            self.add("callsite", node, "call", name, target=name.rpartition(".")[0] or None, arity=len(node.args), payload=args)
        self.generic_visit(node)

    def visit_Assign(self, node):
        sources = sorted({n.id for n in ast.walk(node.value) if isinstance(n, ast.Name)})
        for target in node.targets:
            for t in ast.walk(target):
                if isinstance(t, ast.Name) and isinstance(t.ctx, ast.Store):
                    self.add("binding", t, "local", t.id)
                    for s in sources:
                        self.add("dataflow", node, "assign", t.id, target=s)
        self.generic_visit(node)

    def visit_Return(self, node):
        for s in sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)}):
            self.add("dataflow", node, "return", "return", target=s)
        self.generic_visit(node)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self.add("use", node, "read", node.id)

    def _cfg(self, function) -> None:
        """Control-flow nodes and edges of a function: entry, statements, branch, join, loop, exit."""
        nodes, edges = [("entry", function.lineno - 1)], []

        def new(kind: str, line: int) -> int:
            nodes.append((kind, line))
            return len(nodes) - 1

        def walk(body: list, before: list[tuple[int, str]], loop: tuple[int, list] | None) -> list[tuple[int, str]]:
            for s in body:
                if not before:
                    break
                here = new("branch" if isinstance(s, (ast.If, ast.Match)) else "loop" if isinstance(s, (ast.For, ast.AsyncFor, ast.While)) else "statement", s.lineno - 1)
                edges.extend((a, here, k) for a, k in before)
                before = [(here, "next")]
                if isinstance(s, ast.If):
                    before = walk(s.body, [(here, "true")], loop) + walk(s.orelse, [(here, "false")], loop)
                elif isinstance(s, ast.Match):
                    before = [(here, "false")] + [e for c in s.cases for e in walk(c.body, [(here, "case")], loop)]
                elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                    breaks: list = []
                    edges.extend((a, here, "back") for a, _ in walk(s.body, [(here, "true")], (here, breaks)))
                    before = walk(s.orelse, [(here, "false")], loop) + breaks
                elif isinstance(s, ast.Try):
                    end = walk(s.body, before, loop)
                    end = walk(s.orelse, end, loop) if s.orelse else end
                    for h in s.handlers:
                        end = end + walk(h.body, [(here, "exception")], loop)
                    before = walk(s.finalbody, end, loop) if s.finalbody else end
                elif isinstance(s, (ast.With, ast.AsyncWith)):
                    before = walk(s.body, before, loop)
                elif isinstance(s, (ast.Return, ast.Raise)):
                    done.append((here, "return" if isinstance(s, ast.Return) else "exception"))
                    before = []
                elif isinstance(s, ast.Break) and loop:
                    loop[1].append((here, "next"))
                    before = []
                elif isinstance(s, ast.Continue) and loop:
                    edges.append((here, loop[0], "back"))
                    before = []
                if len(before) > 1:
                    join = new("join", s.lineno - 1)
                    edges.extend((a, join, k) for a, k in before)
                    before = [(join, "next")]
            return before

        done: list[tuple[int, str]] = []
        last = walk(function.body, [(0, "next")], None)
        end = new("exit", function.end_lineno - 1)
        edges.extend((a, end, k) for a, k in [*last, *done])
        self.add("cfg", function, "graph", ".".join(self.stack), payload={"nodes": nodes, "edges": edges})


def _dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def extract_python(path: str, text: str) -> list[tuple]:
    """Fact rows of one Python source."""
    visitor = _Python(path, text)
    visitor.visit(ast.parse(text))
    return visitor.rows


def extract(sources: DataFrame, modes: tuple[str, ...] = ("symbol", "scope", "reference", "import", "callsite", "binding", "use", "dataflow", "cfg")) -> DataFrame:
    """Facts of ``sources (path, language, text)``, one row each; a file that cannot be parsed gives one ``diagnostic``.

    Python is parsed by its own grammar; the languages of ``scanner.SPECS`` are
    scanned (no control flow and no reads); other files give no facts.  Null texts
    count as empty.
    """
    names = [c.split()[0] for c in FACT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"]):
                try:
                    found = extract_python(path, text or "") if language == "python" else scanner.extract_source(path, language, text or "")
                    rows += [r for r in found if r[1] in modes]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "diagnostic", hashlib.sha256(path.encode()).hexdigest(), None, type(e).__name__, str(e), *[None] * 8))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("arity", "start_byte", "end_byte", "start_line", "end_line")})

    return sources.where(F.col("language").isin("python", *scanner.SPECS)).select("path", "language", "text").mapInPandas(run, FACT)


def excerpt(text, start: int, end: int, most: int = 65_536):
    """Lines ``start`` to ``end`` (0-based, inclusive) of a text column, at most ``most`` characters."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), start + 1, end - start + 1), "\n"), 1, most)


def path_aliases(config: str) -> list[tuple[str, str]]:
    """Pattern and target of the ``paths`` of a compiler configuration, relative to its ``baseUrl``."""
    options = json.loads(config).get("compilerOptions", {})
    base = options.get("baseUrl", ".").strip("./")
    return [(pattern, "/".join(p for p in (base, targets[0].removeprefix("./")) if p)) for pattern, targets in options.get("paths", {}).items() if targets]
