"""What calls do to resources, by language: who makes one, who ends one, who lets it go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of calls that make or end a resource.  ``x*`` is a prefix, ``*x`` a suffix, others are whole names; case is ignored.
_C_MAKES = ("malloc", "calloc", "strdup", "strndup", "fopen", "kmalloc", "kzalloc", "kcalloc", "kmalloc_array", "kvcalloc", "vmalloc", "vzalloc", "kzalloc_obj", "operator new", "operator new[]", "realloc", "asprintf", "aprintf", "Curl_copy_header_value", "curl_copy_*")
_C_ENDS = ("free", "kfree", "kvfree", "vfree", "operator delete", "operator delete[]", "std::free", "fclose", "closedir", "safefree", "Curl_safefree", "*_free")
_SCRIPT_MAKES = ("open", "*createConnection", "*openConnection", "createReadStream", "createWriteStream", "createServer", "createClient", "useEffect", "useMemo", "useCallback", "setTimeout", "setInterval")
_SCRIPT_ENDS = ("*.dispose", "*.close", "*.destroy", "*.release", "clearTimeout", "clearInterval")
MAKES = {
    "c": _C_MAKES,
    "cpp": _C_MAKES,
    "typescript": _SCRIPT_MAKES,
    "javascript": _SCRIPT_MAKES,
    "python": ("open", "sqlite3.connect", "socket.socket", "requests.Session", "*connect"),
    "java": ("*openConnection", "*openStream", "*newInputStream", "*newOutputStream", "*getConnection"),
    "go": ("os.Open", "os.Create", "sql.Open", "net.Dial", "os.OpenFile"),
    "rust": ("Box::new", "Vec::new", "Arc::new", "Rc::new", "std::sync::Arc::new", "std::rc::Rc::new"),
    "csharp": ("File.Open", "new FileStream", "*SqlConnection", "*HttpClient", "*OpenConnection", "*OpenStream"),
    "php": ("fopen", "mysqli_connect", "curl_init", "*connect"),
    "ruby": ("File.open", "File.new", "TCPSocket.new", "TCPServer.new", "UDPSocket.new", "Net::HTTP.start", "Net.HTTP.start", "IO.open", "IO.new", "Tempfile.create", "Dir.chdir", "Dir.open", "Dir.new", "*.open", "*.new"),
    "kotlin": ("*File", "*bufferedReader", "*bufferedWriter", "*openConnection"),
}
ENDS = {
    "c": _C_ENDS,
    "cpp": _C_ENDS,
    "typescript": _SCRIPT_ENDS,
    "javascript": _SCRIPT_ENDS,
    "python": ("*.close", "*.dispose", "*.release", "os.close"),
    "java": ("*.close", "*.close()", "*.dispose", "*.dispose()", "*.destroy", "*.destroy()"),
    "go": ("*.Close",),
    "rust": ("drop", "std::mem::drop", "std::mem::forget"),
    "csharp": ("*.Dispose", "*.Close"),
    "php": ("fclose", "mysqli_close", "curl_close", "*close"),
    "ruby": (".close", ".dispose", "*.close", "*.dispose"),
    "kotlin": (".use", "*.close", "*.dispose"),
}
ESCAPES = {"rust": ("std::mem::forget",)}
#: Calls that may return what is owned already, whatever the language; languages that clean up at a scope's end; C's own calls need a free even there.
MAYBE_MAKES = ("useEffect", "realloc")
CLEANING = ("cpp", "java", "rust", "csharp")
#: Names of methods that end their receiver.
METHODS = (".close", ".Close", ".dispose", ".Dispose", ".destroy", ".Destroy", ".release", ".Release")


def _named(callee: Column, pattern: str) -> Column:
    name, low = F.lower(callee), pattern.lower()
    if low.startswith("*"):
        return name.endswith(low[1:])
    return name.startswith(low[:-1]) if low.endswith("*") else name == low


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _in(callee: Column, language: Column, table: dict[str, tuple[str, ...]], more: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether a language's patterns, or those that a project adds for it, name the call; false for null and unknown ones."""
    names = {k: (*table.get(k, ()), *(more or {}).get(k, ())) for k in {**table, **(more or {})}}
    return F.coalesce(_any([(language == k) & _any([_named(callee, p) for p in patterns]) for k, patterns in names.items()]), F.lit(False))


def returned(callee: Column, language: Column, more: dict[str, tuple[str, ...]] | None = None) -> Column:
    """``maybe_owned`` or ``new_owned`` for a call that returns a resource, else null."""
    return F.when(_any([_named(callee, p) for p in MAYBE_MAKES]), "maybe_owned").when(_in(callee, language, MAKES, more), "new_owned")


def ended(callee: Column, language: Column, more: dict[str, tuple[str, ...]] | None = None) -> Column:
    """``method``, ``deferred`` or ``explicit`` for a call that ends a resource, else null."""
    style = F.when(_any([callee.contains(m) for m in METHODS]), "method").when(callee.contains("defer "), "deferred").otherwise("explicit")
    return F.when(_in(callee, language, ENDS, more), style)


def escapes(callee: Column, language: Column, context: Column) -> Column:
    """Whether a call lets its resource out of the function: started as a goroutine, or forgotten on purpose."""
    return F.coalesce(context == "go_goroutine", F.lit(False)) | _in(callee, language, ESCAPES)


def cleaned_at_exit(callee: Column, language: Column) -> Column:
    """Whether what the call makes is ended with its scope."""
    return F.coalesce(language.isin(*CLEANING), F.lit(False)) & ~_in(callee, language, {"cpp": MAKES["cpp"]})
