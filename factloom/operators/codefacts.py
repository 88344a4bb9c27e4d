"""Facts of Python sources: one Arrow job parses each file once and returns narrow rows.

The helper only reads the standard syntax tree of a single file; everything across nodes,
functions and files (hashes, complexity, resolution, roll-ups) is relational work on the tables
that :class:`CodeFacts` exposes.
"""

from __future__ import annotations

import ast
import functools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from factloom.functions import scores
from factloom.operators.extract import RISK_CUES, RISKS, fact_row, pattern_hits
from factloom.operators.pages import text_pages
from factloom.operators.resolve import is_external

# Operations counted as hot, branch nodes, loop nodes, modules and calls that keep a
# function cold, and names that hint at lookups by string.
HOT_OPERATIONS = [
    "append", "extend", "insert", "pop", "remove", "sort", "reverse", "split", "join", "replace", "find", "index",
    "count", "strip", "startswith", "endswith", "encode", "decode", "format", "map", "filter", "reduce", "sorted", "zip",
    "enumerate",
]
BRANCHES = ["If", "For", "AsyncFor", "While", "IfExp", "ExceptHandler"]
LOOPS = ["For", "While", "ListComp", "SetComp", "DictComp", "GeneratorExp"]
THREADING_MODULES = [
    "threading", "multiprocessing", "concurrent", "concurrent.futures", "asyncio", "_thread", "queue", "subprocess",
]
HARDWARE_MODULES = ["ctypes", "cffi", "sysconfig", "mmap", "fcntl", "termios", "resource", "signal", "pty", "tty"]
GPU_MODULES = ["cuda", "pycuda", "numba", "cupy", "torch", "tensorflow", "jax", "opencl", "pyopencl"]
THREADING_CALLS = ["Thread", "Process", "Pool", "Executor"]
THREADING_CONTEXTS = ["ThreadPoolExecutor", "ProcessPoolExecutor", "Pool", "Lock", "Semaphore", "Barrier"]
DYNAMIC_NAMES = ["globals", "locals", "vars", "eval", "exec", "__import__", "getattr"]
_DYNAMIC_WORDS = [*DYNAMIC_NAMES, "import_module", "modules"]
#: Canonical kinds of syntax nodes, and categories of those that have none; other nodes are UNKNOWN.
CANONICAL_KINDS = {
    "FunctionDef": "function_declaration", "AsyncFunctionDef": "function_declaration", "ClassDef": "type_declaration",
    "Import": "import_declaration", "ImportFrom": "import_declaration", "Module": "translation_unit",
}
IDENTIFIERS = ["Name", "arg", "alias", "keyword"]
STATEMENTS = sorted(c.__name__ for c in ast.stmt.__subclasses__())
EXPRESSIONS = sorted(c.__name__ for c in ast.expr.__subclasses__())
TYPE_HINTS = {"bool": "boolean", "int": "integer", "float": "real", "str": "string"}
CODE_CONFIDENCE = {"state_variable": 0.9, "boundary": 0.9, "equation": 0.8}

_NODE = "struct<id:int,parent:int,last:int,depth:int,kind:string,name:string,line:int,col:int,end_line:int,end_col:int,start_byte:int,end_byte:int,text:string,role:string,code:string>"
_NAME = "struct<role:string,name:string>"
_IMPORT = "struct<module:string,bound:string,original:string,level:int,from_import:boolean,top:boolean,line:int>"
_CALL = "struct<function:int,owner:string,node:int,name:string,root:string,leaf:string,line:int>"
SCHEMA = (
    f"path string, error string, line_count int, dynamic boolean, nodes array<{_NODE}>, names array<{_NAME}>, "
    f"imports array<{_IMPORT}>, calls array<{_CALL}>"
)
#: Arrays of a file's row.
PARTS = ("nodes", "names", "imports", "calls")
#: Fields of their elements.
FIELDS = {
    part: tuple(field.split(":")[0] for field in element[len("struct<") : -1].split(","))
    for part, element in zip(PARTS, (_NODE, _NAME, _IMPORT, _CALL), strict=True)
}
#: Bytes of source in a page; its nodes take some hundred times as much.
SOURCE_BYTES = 1 << 18
#: Fields of nodes that :meth:`CodeFacts.facts` reads.
FACT_FIELDS = ("id", "parent", "last", "depth", "kind", "name", "line", "text", "role", "code")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Nodes that contribute names, by role.
_NAMING_BY_ROLE = {
    "annotation": {*_FUNCTIONS}, "defined": {*_FUNCTIONS, ast.ClassDef, ast.Assign}, "imported": {ast.Import, ast.ImportFrom},
    "in_string": {ast.Constant}, "local": {*_FUNCTIONS, ast.ClassDef, ast.arg, ast.Name}, "mentioned": {ast.Name},
    "used": {*_FUNCTIONS, ast.Name},
}
_NAMING = frozenset().union(*_NAMING_BY_ROLE.values())
_IMPORTING = frozenset({ast.Import, ast.ImportFrom})
_CALLING = frozenset({*_FUNCTIONS, ast.Call})
_LOOKING = frozenset({ast.Name, ast.Attribute})
_KINDS = [c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)]
#: Nodes with a name or the type of a constant for one, and nodes with a place of their own.
_NAMED = frozenset([ast.Constant, *(c for c in _KINDS if "name" in c._fields)])
_PLACED = frozenset(c for c in _KINDS if c._attributes)
#: Fields that hold text or numbers in every kind of node.
_PLAIN = {"id", "attr", "arg", "asname", "module", "level", "kind", "type_comment", "is_async", "simple", "conversion"}
_WORD = re.compile(r"[A-Za-z_]\w*")
#: Kinds of nodes that blocks of statements are made of, and the fields that hold such blocks.
_IN_BLOCKS = (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)
_BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")
#: Expressions whose source is kept, by the kind of their parent and their place in it.
_SHOWN = {(ast.Assert, "test"), (ast.Return, "value")}


@functools.cache
def _inner_fields(kind: type) -> tuple[str, ...]:
    """Fields that may hold nodes, the last one first."""
    if kind in (ast.Constant, ast.alias):
        return ()
    return tuple(field for field in reversed(kind._fields) if field not in _PLAIN)


def _flatten(tree: ast.AST) -> list[tuple[ast.AST, int | None, int, str | None]]:
    """Nodes in preorder with parent, depth and role; an id is the place in the list."""
    out: list[tuple[ast.AST, int | None, int, str | None]] = []
    stack: list[tuple[ast.AST, int | None, int, str | None]] = [(tree, None, 0, None)]
    pop, push, add, at = stack.pop, stack.append, out.append, -1
    while stack:
        entry = pop()
        add(entry)
        at += 1
        node = entry[0]
        kind = type(node)
        if kind is ast.Name:  # its only node is its context
            add((node.ctx, at, entry[2] + 1, "ctx"))
            at += 1
            continue
        for field in _inner_fields(kind):
            value = getattr(node, field, None)
            if not value:
                continue
            if type(value) is list:
                below = entry[2] + 1
                for child in reversed(value):
                    if isinstance(child, ast.AST):
                        push((child, at, below, field))
            elif isinstance(value, ast.AST):
                push((value, at, entry[2] + 1, field))
    return out


@functools.cache
def _ways(kinds: frozenset[type]) -> dict[type, tuple[str, ...]]:
    """Nodes to look at for nodes of ``kinds``, with the fields to enter: expressions hold no statements."""
    ways = {}
    only_blocks = all(issubclass(kind, _IN_BLOCKS) for kind in kinds)
    contexts = any(issubclass(kind, ast.expr_context) for kind in kinds)
    for kind in _KINDS:
        fields = () if kind is ast.Name and not contexts else _inner_fields(kind)
        if only_blocks:
            fields = tuple(field for field in fields if field in _BLOCKS) if issubclass(kind, _IN_BLOCKS) else ()
        if fields or kind in kinds:
            ways[kind] = fields
    return ways


def _flatten_some(tree: ast.AST, kinds: frozenset[type]) -> list[tuple[ast.AST, int | None, int, str | None]]:
    """Like :func:`_flatten` with nodes of ``kinds`` only; a parent is the next listed node above."""
    ways = _ways(kinds)
    out: list[tuple[ast.AST, int | None, int, str | None]] = []
    stack: list[tuple[ast.AST, int | None, int, str | None]] = [(tree, None, 0, None)]
    pop, push, add = stack.pop, stack.append, out.append
    while stack:
        entry = pop()
        node, at, below, _ = entry
        kind = type(node)
        if kind in kinds:
            at = len(out)
            add(entry)
        below += 1
        for field in ways[kind]:
            value = getattr(node, field, None)
            if type(value) is list:
                for child in reversed(value):
                    if type(child) in ways:
                        push((child, at, below, field))
            elif type(value) in ways:
                push((value, at, below, field))
    return out


class _Parsed:
    """A file's nodes in preorder, all or those of some kinds, their kinds, and what several columns are made of."""

    def __init__(self, text: str, tree: ast.AST, some: frozenset[type] | None = None):
        self.text = text
        self.tree = tree
        self.some = some
        self.flat = _flatten(tree) if some is None else _flatten_some(tree, some)
        self.kinds = [type(entry[0]) for entry in self.flat]

    @functools.cached_property
    def last(self) -> list[int]:
        """Id of each node's last descendant, or its own."""
        last = list(range(len(self.flat)))
        for at in range(len(last) - 1, 0, -1):
            parent = self.flat[at][1]
            if parent is not None and last[at] > last[parent]:
                last[parent] = last[at]
        return last

    @functools.cached_property
    def line_starts(self) -> list[int]:
        return [0, *accumulate(map(len, self.text.encode("utf-8", "surrogatepass").splitlines(keepends=True)))]

    def place(self, attribute: str) -> list[int | None]:
        return [getattr(entry[0], attribute) if kind in _PLACED else None for entry, kind in zip(self.flat, self.kinds, strict=True)]

    def bytes(self, line: str, col: str) -> list[int | None]:
        starts = self.line_starts
        return [None if n is None or c is None else starts[n - 1] + c for n, c in zip(self.place(line), self.place(col), strict=True)]

    def names(self) -> list[str | None]:
        return [
            (type(entry[0].value).__name__ if kind is ast.Constant else entry[0].name) if kind in _NAMED else None
            for entry, kind in zip(self.flat, self.kinds, strict=True)
        ]

    def values(self) -> list[str | None]:
        return [
            entry[0].id if kind is ast.Name else repr(entry[0].value) if kind is ast.Constant else None
            for entry, kind in zip(self.flat, self.kinds, strict=True)
        ]

    def code(self) -> list[str | None]:
        kinds = self.kinds
        return [
            _code(node) if (role == "value" or role == "test") and (kinds[parent], role) in _SHOWN else None
            for node, parent, _, role in self.flat
        ]


def _code(node: ast.AST) -> str:
    return node.id if type(node) is ast.Name else ast.unparse(node)


#: Fields of a file's nodes, one list each.
_COLUMNS: dict[str, Callable[[_Parsed], list]] = {
    "id": lambda file: list(range(len(file.flat))),
    "parent": lambda file: [entry[1] for entry in file.flat],
    "last": lambda file: file.last,
    "depth": lambda file: [entry[2] for entry in file.flat],
    "kind": lambda file: [kind.__name__ for kind in file.kinds],
    "name": _Parsed.names,
    "line": lambda file: file.place("lineno"),
    "col": lambda file: file.place("col_offset"),
    "end_line": lambda file: file.place("end_lineno"),
    "end_col": lambda file: file.place("end_col_offset"),
    "start_byte": lambda file: file.bytes("lineno", "col_offset"),
    "end_byte": lambda file: file.bytes("end_lineno", "end_col_offset"),
    "text": _Parsed.values,
    "role": lambda file: [entry[3] for entry in file.flat],
    "code": _Parsed.code,
}


def _dotted(node: ast.AST) -> list[str]:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return parts[::-1]


def _annotations(node: ast.AST) -> Iterator[str]:
    spec = node.args
    every = [*spec.posonlyargs, *spec.args, *spec.kwonlyargs, *filter(None, [spec.vararg, spec.kwarg])]
    for note in [a.annotation for a in every] + [node.returns]:
        if isinstance(note, ast.Constant) and isinstance(note.value, str):
            try:
                note = ast.parse(note.value, mode="eval")
            except SyntaxError:
                continue
        if type(note) is ast.Name:
            yield note.id
        elif note is not None:
            yield from (n.id for n in ast.walk(note) if isinstance(n, ast.Name))


def _names(node: ast.AST, top: bool) -> Iterator[tuple[str, str]]:
    """(role, name) pairs that a declaration, an assignment or an import contributes."""
    if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
        yield "local", node.name
        if top:
            yield "defined", node.name
    if isinstance(node, _FUNCTIONS):
        for name in _annotations(node):
            yield "annotation", name
            yield "used", name
    elif isinstance(node, ast.Assign) and top:
        yield from (("defined", t.id) for t in node.targets if isinstance(t, ast.Name))
    elif isinstance(node, ast.Import) and top:
        yield from (("imported", a.asname or a.name.split(".")[-1]) for a in node.names)
    elif isinstance(node, ast.ImportFrom) and top:
        yield from (("imported", a.asname or a.name) for a in node.names)


def _names_of(file: _Parsed, roles: Sequence[str] | None = None) -> dict[str, list]:
    """Names by role, in order, of all roles or of some."""
    names: dict[str, set[str]] = defaultdict(set)
    mentioned, used, local, in_string = names["mentioned"], names["used"], names["local"], names["in_string"]
    for entry, kind in zip(file.flat, file.kinds, strict=True):
        if kind not in _NAMING:
            continue
        node = entry[0]
        if kind is ast.Name:
            mentioned.add(node.id)
            (used if type(node.ctx) is ast.Load else local).add(node.id)
        elif kind is ast.arg:
            local.add(node.arg)
        elif kind is ast.Constant:
            if type(node.value) is str:
                in_string.update(_WORD.findall(node.value))
        else:
            for role, name in _names(node, entry[2] == 1):
                names[role].add(name)
    ordered = [(role, sorted(names[role])) for role in sorted(names if roles is None else names.keys() & set(roles))]
    return {"role": [role for role, own in ordered for _ in own], "name": [name for _, own in ordered for name in own]}


def _imports_of(file: _Parsed) -> dict[str, list]:
    columns: dict[str, list] = {field: [] for field in FIELDS["imports"]}
    for at, kind in enumerate(file.kinds):
        if kind in _IMPORTING:
            node, _, depth, _ = file.flat[at]
            is_from, aliases = kind is ast.ImportFrom, node.names
            columns["module"] += [node.module if is_from else a.name for a in aliases]
            columns["bound"] += [a.asname or (a.name if is_from else a.name.split(".")[0]) for a in aliases]
            columns["original"] += [a.name for a in aliases]
            same = {"level": node.level if is_from else 0, "from_import": is_from, "top": depth == 1, "line": node.lineno}
            for field, value in same.items():
                columns[field] += [value] * len(aliases)
    return columns


def _calls_of(file: _Parsed) -> dict[str, list]:
    """Calls by name; a nested call counts for every enclosing function."""
    columns: dict[str, list] = {field: [] for field in FIELDS["calls"]}
    flat, last = file.flat, file.last
    enclosing: list[int] = []
    for at, kind in enumerate(file.kinds):
        if kind not in _CALLING:
            continue
        node = flat[at][0]
        while enclosing and at > last[enclosing[-1]]:
            enclosing.pop()
        if kind is not ast.Call:
            enclosing.append(at)
        elif enclosing and isinstance(node.func, (ast.Name, ast.Attribute)):
            dotted = _dotted(node.func)
            same = {"node": at, "name": ".".join(dotted), "root": dotted[0], "leaf": dotted[-1], "line": node.lineno}
            for field, value in same.items():
                columns[field] += [value] * len(enclosing)
            columns["function"] += enclosing
            columns["owner"] += [flat[function][0].name for function in enclosing]
    return columns


def _is_dynamic(file: _Parsed) -> bool:
    text = file.text
    if text.isascii() and not any([word in text for word in _DYNAMIC_WORDS]):
        return False  # names of such a text are as written
    flat = file.flat if file.some is None else _flatten_some(file.tree, _LOOKING)
    for node, _, _, _ in flat:
        kind = type(node)
        if kind is ast.Name:
            if node.id in DYNAMIC_NAMES:
                return True
        elif kind is ast.Attribute and (node.attr == "import_module" or _dotted(node) == ["sys", "modules"]):
            return True
    return False


_MAKERS: dict[str, Callable[[_Parsed], dict[str, list]]] = {"imports": _imports_of, "calls": _calls_of}


def _kinds_to_read(wanted: Mapping[str, Sequence[str]], node_kinds: Sequence[str] | None, roles: Sequence[str] | None) -> frozenset[type] | None:
    """Kinds of nodes that the wanted parts are made of, or None for all."""
    if node_kinds is None and not wanted.keys().isdisjoint({"nodes", "calls"}) or "code" in wanted.get("nodes", ()):
        return None  # ids are places among all nodes, and source is kept by the parent itself
    kinds = {getattr(ast, kind) for kind in node_kinds or ()}
    if "names" in wanted:
        kinds = kinds.union(*(of for role, of in _NAMING_BY_ROLE.items() if roles is None or role in roles))
    for part, of in (("imports", _IMPORTING), ("calls", _CALLING)):
        kinds |= of if part in wanted else set()
    return frozenset(kinds)


def _read_file(
    text: str | None, wanted: Mapping[str, Sequence[str]], some: frozenset[type] | None = None, roles: Sequence[str] | None = None
) -> dict:
    """Error, or number of lines, dynamic lookups and the wanted parts, each as one list per field."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError) as exc:
        return {"error": f"{type(exc).__name__}: {exc}"}
    file = _Parsed(text or "", tree, some)
    made = {"line_count": len(text.splitlines()), "dynamic": _is_dynamic(file)}
    for part, fields in wanted.items():
        if part == "nodes":
            made[part] = {field: _COLUMNS[field](file) for field in fields}
        else:
            made[part] = _names_of(file, roles) if part == "names" else _MAKERS[part](file)
    return made


def _lists(files: list[dict], part: str, kind: pa.ListType) -> pa.Array:
    """Array column of a part; null where a file did not parse."""
    columns: dict[str, list] = {field.name: [] for field in kind.value_type}
    ends, size = [0], 0
    for file in files:
        for name, values in columns.items():
            values += file[part][name] if part in file else ()
        size = len(next(iter(columns.values())))
        ends.append(size)
    fields = list(kind.value_type)
    values = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind, mask=pa.array([part not in f for f in files]))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all tasks by their keys, for work that costs far more than moving them."""
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, F.xxhash64(*keys))


def read_code(
    files: DataFrame,
    keep: Sequence[str] = (),
    parts: Sequence[str] = PARTS,
    node_fields: Sequence[str] = FIELDS["nodes"],
    node_kinds: Sequence[str] | None = None,
    roles: Sequence[str] | None = None,
    deal: bool = True,
) -> DataFrame:
    """One row per (path, text) file with its nodes, names, imports and calls as arrays.

    Files that do not parse carry the error. ``keep`` names columns of ``files`` that go along, and
    ``parts`` the arrays that are wanted: nodes are many times the size of a file, so ``node_fields``
    names what is wanted of them. Of ``node_kinds`` all nodes are there, other kinds may be left out;
    an id is then a place among the nodes that are there, and a parent the next of them above. ``roles`` names the
    roles of names. Python builds columns, as a row for each node costs more than
    the parser. Parsing a file costs far more than moving it, and a table of many small files may
    come in a few splits, so the files are dealt over all tasks first, unless ``deal`` says that they are.
    """
    files = files.select("path", "text", *keep)
    spread = dealt(files, "path", "text") if deal else files
    wanted = {part: [f for f in FIELDS[part] if part != "nodes" or f in node_fields] for part in PARTS if part in parts}
    some = _kinds_to_read(wanted, node_kinds, roles)

    def narrowed(field: StructField) -> StructField:
        chosen = [f for f in field.dataType.elementType if f.name in wanted[field.name]]
        return StructField(field.name, ArrayType(StructType(chosen)))

    whole = [f for f in StructType.fromDDL(SCHEMA) if f.name not in PARTS or f.name in wanted]
    schema = StructType([*(narrowed(f) if f.name in wanted else f for f in whole), *files.select(*keep).schema])
    arrow_schema = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in text_pages(batches, "text", SOURCE_BYTES):
            read = [_read_file(text, wanted, some, roles) for text in page.column("text").to_pylist()]
            columns = []
            for field in arrow_schema:
                if field.name in wanted:
                    columns.append(_lists(read, field.name, field.type))
                elif field.name in ("error", "line_count", "dynamic"):
                    columns.append(pa.array([file.get(field.name) for file in read], field.type))
                else:
                    columns.append(page.column(field.name).cast(field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return spread.mapInArrow(parse, schema)


def _node(place: Column) -> Column:
    return F.get("nodes", place)


def _names_in(node: Column) -> Column:
    """Names under a node, outer ones first."""
    inside = F.slice("nodes", node["id"] + 1, node["last"] - node["id"] + 1)
    found = F.filter(inside, lambda n: n["kind"] == "Name")
    placed = F.array_sort(F.transform(found, lambda n: F.struct(n["depth"].alias("depth"), n["id"].alias("id"), n["text"].alias("text"))))
    return F.transform(placed, lambda n: n["text"])


def _fact(node: Column, kind: str, symbol: Column, **more: Column) -> Column:
    text = F.lit(None).cast("string")
    parts = {
        "description": text, "type_hint": text, "number": F.lit(None).cast("double"), "expression": text, "lhs": text,
        "rhs": text, "variables": F.lit(None).cast("array<string>"),
    } | more
    return F.struct(
        node["id"].alias("id"), F.lit(kind).alias("kind"), symbol.alias("symbol"), node["line"].alias("line"),
        *[column.alias(name) for name, column in parts.items()],
    )


def _constants() -> Column:
    """Assignments at module level of one constant to one name."""

    def value_of(s: Column) -> Column:
        second = _node(_node(s["id"] + 1)["last"] + 1)
        return F.when(s["kind"] == "AnnAssign", _node(second["last"] + 1)).otherwise(second)

    def fits(s: Column) -> Column:
        target, value = _node(s["id"] + 1), value_of(s)
        own = (value["parent"] == s["id"]) & (value["role"] == "value") & (value["kind"] == "Constant")
        return (s["depth"] == 1) & s["kind"].isin("Assign", "AnnAssign") & (target["kind"] == "Name") & own & (value["name"] != "NoneType")

    def fact(s: Column) -> Column:
        name, value = _node(s["id"] + 1)["text"], value_of(s)
        hints = F.create_map(*[F.lit(x) for pair in TYPE_HINTS.items() for x in pair])
        return _fact(
            s, "state_variable", name, description=F.concat(F.lit("module-level constant '"), name, F.lit("'")),
            type_hint=F.coalesce(F.try_element_at(hints, value["name"]), F.lit("unknown")),
            number=F.when(value["name"].isin("int", "float"), value["text"].try_cast("double")),
        )

    return F.transform(F.filter("nodes", lambda s: F.coalesce(fits(s), F.lit(False))), fact)


def _boundaries() -> Column:
    """Asserted comparisons."""

    def fact(s: Column) -> Column:
        test = _node(s["id"] + 1)
        names = _names_in(test)
        symbol = F.coalesce(F.get(names, F.lit(0)), F.concat(F.lit("assert_"), s["line"].cast("string")))
        return _fact(s, "boundary", symbol, description=F.concat(F.lit("assert "), test["code"]), expression=test["code"], variables=names)

    asserted = F.filter("nodes", lambda s: (s["kind"] == "Assert") & F.coalesce(_node(s["id"] + 1)["kind"] == "Compare", F.lit(False)))
    return F.transform(asserted, fact)


def _equations() -> Column:
    """Functions that, besides bare constants, only return an expression."""

    def steps(f: Column) -> Column:
        inside = F.slice("nodes", f["id"] + 1, f["last"] - f["id"] + 1)
        bare = lambda n: (n["kind"] == "Expr") & F.coalesce(_node(n["id"] + 1)["kind"] == "Constant", F.lit(False))
        return F.filter(inside, lambda n: (n["parent"] == f["id"]) & (n["role"] == "body") & ~bare(n))

    def returned(f: Column) -> Column:
        return _node(F.get(steps(f), F.lit(0))["id"] + 1)

    def fits(f: Column) -> Column:
        only, value = F.get(steps(f), F.lit(0)), returned(f)
        own = (only["kind"] == "Return") & (value["parent"] == only["id"])
        return f["kind"].isin("FunctionDef", "AsyncFunctionDef") & (F.size(steps(f)) == 1) & own & ~value["kind"].isin("Constant", "Name")

    def fact(f: Column) -> Column:
        value = returned(f)
        return _fact(
            f, "equation", f["name"], expression=F.concat(f["name"], F.lit(" = "), value["code"]), lhs=f["name"], rhs=value["code"],
            variables=F.array_distinct(_names_in(value)),
        )

    return F.transform(F.filter("nodes", lambda f: F.coalesce(fits(f), F.lit(False))), fact)


class CodeFacts:
    """Narrow tables over the result of :func:`read_code` (write that result once, read it often)."""

    def __init__(self, code: DataFrame):
        self.code = code

    def nodes(self) -> DataFrame:
        """Syntax nodes with canonical kind and category; spans in bytes, where a node has a place of its own."""
        rows = self.code.select("path", F.inline("nodes"))
        kinds = F.create_map(*[F.lit(x) for pair in CANONICAL_KINDS.items() for x in pair])
        canonical, kind = F.try_element_at(kinds, F.col("kind")), F.col("kind")
        category = (
            F.when(canonical.endswith("_declaration"), "DECLARATION").when(canonical == "translation_unit", "MODULE")
            .when(kind.isin(STATEMENTS), "STATEMENT").when(kind == "Constant", "LITERAL").when(kind.isin(IDENTIFIERS), "IDENTIFIER")
            .when(kind.isin(EXPRESSIONS), "EXPRESSION").otherwise("UNKNOWN")
        )
        return rows.withColumns({"canonical_kind": canonical, "category": category})

    def names(self, role: str) -> DataFrame:
        wanted = F.filter("names", lambda n: n["role"] == role)
        return self.code.select("path", F.explode(F.transform(wanted, lambda n: n["name"])).alias("name"))

    def imports(self) -> DataFrame:
        structural = (F.col("module") == "__future__") & F.col("from_import") | (F.col("original") == "*")
        return self.code.select("path", F.inline("imports")).withColumn("structural", F.coalesce(structural, F.lit(False)))

    def aliases(self) -> DataFrame:
        """(path, alias, module root) of every name an import binds."""
        return self.imports().where("module IS NOT NULL").select(
            "path", F.col("bound").alias("alias"), F.split_part("module", F.lit("."), F.lit(1)).alias("module")
        )

    def modules(self) -> DataFrame:
        """(path, module) as written, with leading dots for relative imports."""
        dots = F.repeat(F.lit("."), F.col("level"))
        return self.imports().select("path", F.concat(dots, F.coalesce("module", F.lit(""))).alias("module")).distinct()

    def dynamic_files(self) -> DataFrame:
        """Files with dynamic lookups; their guessed size must not send them to the driver, see :mod:`resolve`."""
        return self.code.where("dynamic").select("path").hint("merge")

    def symbols(self) -> DataFrame:
        """Declared functions and types per file, sorted and unique."""

        def declared(kinds: list[str]) -> Column:
            found = F.filter("nodes", lambda n: n["kind"].isin(kinds))
            return F.array_sort(F.array_distinct(F.transform(found, lambda n: n["name"])))

        return self.code.where("error IS NULL").select(
            "path", declared(["FunctionDef", "AsyncFunctionDef"]).alias("functions"), declared(["ClassDef"]).alias("types")
        )

    def facts(self, domain: Column) -> DataFrame:
        """Constants, asserted comparisons and one-line functions in the common fact columns."""
        found = F.array_sort(F.concat(_constants(), _boundaries(), _equations()))  # by node
        rows = self.code.withColumn("domain", domain).select("path", "domain", F.posexplode(found).alias("position", "f"))
        confidence = F.create_map(*[F.lit(x) for pair in CODE_CONFIDENCE.items() for x in pair])
        return rows.select(
            fact_row(
                kind=F.col("f.kind"), domain=F.col("domain"), symbol=F.col("f.symbol"), description=F.col("f.description"),
                type_hint=F.col("f.type_hint"),
                bounds=F.when(F.col("f.number").isNotNull(), F.struct(F.col("f.number").alias("lo"), F.col("f.number").alias("hi"))),
                expression=F.col("f.expression"), lhs=F.col("f.lhs"), rhs=F.col("f.rhs"), variables=F.col("f.variables"),
                path=F.col("path"), line=F.col("f.line"), position=F.col("position"), confidence=confidence[F.col("f.kind")],
            )
        )

    def calls(self) -> DataFrame:
        """Calls with the name of each enclosing function."""
        named = F.transform(
            "calls",
            lambda c: F.struct(
                c["owner"].alias("function"), c["name"].alias("call"), c["root"].alias("root"),
                c["leaf"].alias("leaf"), c["line"].alias("line"),
            ),
        )
        return self.code.select("path", F.inline(named))

    def complexity(self) -> DataFrame:
        """Branch nodes inside each function plus one, counted within the row of the file."""
        rows = self.code.select(
            "path", F.filter("nodes", lambda n: n["kind"].isin(BRANCHES)).alias("branches"),
            F.explode(F.filter("nodes", lambda n: n["kind"].isin("FunctionDef", "AsyncFunctionDef"))).alias("f"),
        )
        inside = F.filter("branches", lambda b: (b["id"] > F.col("f.id")) & (b["id"] <= F.col("f.last")))
        return rows.select(
            "path", F.col("f.name").alias("name"), F.col("f.id").alias("start"), F.col("f.line").alias("line"),
            F.col("f.end_line").alias("end_line"), (F.col("f.depth") == 1).alias("top_level"),
            (F.size(inside) + 1).cast("long").alias("complexity"),
        )

    def measures(self) -> DataFrame:
        """Loop depth, calls, hot operations, recursion, span and score of every function.

        All inputs of a function are in the row of its file, so this needs no join.
        """
        functions = self.code.select(
            "path", "calls", F.filter("nodes", lambda n: n["kind"].isin(LOOPS)).alias("loops"),
            F.explode(F.filter("nodes", lambda n: n["kind"].isin("FunctionDef", "AsyncFunctionDef"))).alias("f"),
        )
        within = F.filter("loops", lambda n: (n["id"] > F.col("f.id")) & (n["id"] <= F.col("f.last")))
        depths = F.transform(
            "_loops", lambda a: F.size(F.filter("_loops", lambda b: (b["id"] <= a["id"]) & (a["id"] <= b["last"])))
        )
        own = F.filter("calls", lambda c: c["function"] == F.col("f.id"))
        measured = functions.withColumns({"_loops": within, "_calls": F.transform(own, lambda c: c["leaf"])}).select(
            "path", F.col("f.name").alias("name"), F.col("f.line").alias("line"), F.col("f.end_line").alias("end_line"),
            F.coalesce(F.array_max(depths), F.lit(0)).alias("loop_depth"), F.col("_calls").alias("calls"),
            F.size(F.filter("_calls", lambda c: c.isin(HOT_OPERATIONS))).alias("hot_operations"),
            F.array_contains("_calls", F.col("f.name")).alias("recursive"),
        )
        span = F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))
        return measured.withColumn(
            "score", scores.function_score(F.col("loop_depth"), F.col("hot_operations"), F.col("recursive"), F.size("calls"), span)
        )

    def risks(self, source: str = "source") -> DataFrame:
        """(path, function, line, risks) of every function: why it stays out of the hot path; hot ones have no risk.

        A risk is (category, detail, line): imports of risky modules inside the function, calls and
        contexts that start threads, coroutines, calls that an alias of the file leads to a risky or
        external module, and unsafe patterns in the function's source, which ``source`` holds for
        the whole file. Everything is in the row of the file, so aliases resolve without a join.
        """
        kinds = {"threading": THREADING_MODULES, "hardware": HARDWARE_MODULES, "gpu": GPU_MODULES}
        risky = [m for modules in kinds.values() for m in modules]

        def root(module: Column) -> Column:
            return F.split_part(module, F.lit("."), F.lit(1))

        def outside(module: Column) -> Column:
            return root(module).isin(risky) | is_external(module)

        def risk(category: str, detail: Column, line: Column) -> Column:
            return F.struct(F.lit(category).alias("category"), detail.alias("detail"), line.alias("line"))

        def any_of(text: Column, parts: Sequence[str]) -> Column:
            return text.rlike("|".join(parts))

        named = F.filter("imports", lambda i: i["module"].isNotNull())
        aliased = F.filter("away", lambda i: i["from_import"] | (i["bound"] != root(i["module"])))
        # an alias may stand for a module that another import made external
        reached = F.concat(
            F.transform("away", lambda i: root(i["module"])), F.transform(aliased, lambda i: i["bound"]),
            F.transform(F.filter("away", lambda i: i["from_import"]), lambda i: i["original"]),
        )
        contexts = F.filter(
            "nodes",
            lambda n: (n["kind"] == "Call") & (n["role"] == "context_expr") & (_node(_node(n["parent"])["parent"])["kind"] == "With"),
        )
        # what counts is taken from the nodes once per file, and not once per function
        known = self.code.where("error IS NULL").select(
            "path", "imports", "calls", F.filter(named, lambda i: outside(i["module"])).alias("away"), contexts.alias("contexts"),
            F.filter("nodes", lambda n: n["kind"].isin("Await", "AsyncFunctionDef")).alias("waits"),
            F.filter("nodes", lambda n: n["kind"].isin("FunctionDef", "AsyncFunctionDef")).alias("functions"),
            F.split(source, "\n").alias("lines"),
        )
        functions = known.select(
            "path", "imports", "calls", F.array_distinct(reached).alias("reached"), "contexts", "waits", "lines", F.explode("functions").alias("f")
        )
        own_calls = F.filter("calls", lambda c: c["function"] == F.col("f.id"))
        lines = F.slice("lines", F.col("f.line"), F.col("f.end_line") - F.col("f.line") + 1)
        parts = functions.withColumns({"own": own_calls, "body": F.array_join(lines, "\n")})

        def inside(nodes: str) -> Column:
            return F.filter(nodes, lambda n: n["id"].between(F.col("f.id"), F.col("f.last")))

        def imported(category: str, modules: Sequence[str]) -> Column:
            here = F.filter(
                "imports", lambda i: root(i["module"]).isin(list(modules)) & i["line"].between(F.col("f.line"), F.col("f.end_line"))
            )
            return F.transform(here, lambda i: risk(category, F.concat(F.lit("module "), root(i["module"])), i["line"]))

        modules = [imported(*pair) for pair in kinds.items()]
        def call_at(node: Column) -> Column:
            return F.get(F.filter("own", lambda c: c["node"] == node["id"]), F.lit(0))["name"]

        found = F.concat(
            *modules,
            F.transform(F.filter("own", lambda c: any_of(c["name"], THREADING_CALLS)), lambda c: risk("threading", F.concat(F.lit("call "), c["name"]), c["line"])),
            F.transform(
                F.filter("own", lambda c: F.array_contains(F.col("reached"), c["root"])),
                lambda c: risk("external_dep", F.concat(F.lit("call "), c["name"]), c["line"]),
            ),
            F.transform(
                F.filter(inside("contexts"), lambda n: F.coalesce(any_of(call_at(n), THREADING_CONTEXTS), F.lit(False))),
                lambda n: risk("threading", F.concat(F.lit("context "), call_at(n)), n["line"]),
            ),
            F.transform(F.filter(inside("waits"), lambda n: n["kind"] == "Await"), lambda n: risk("threading", F.lit("await"), n["line"])),
            F.transform(
                F.filter(inside("waits"), lambda n: n["kind"] == "AsyncFunctionDef"),
                lambda n: risk("threading", F.concat(F.lit("coroutine "), n["name"]), n["line"]),
            ),
        )
        scanned = pattern_hits(
            parts.select("path", F.col("f.name").alias("function"), F.col("f.line").alias("line"), found.alias("found"), "body"), RISKS["python"], "body", RISK_CUES
        )
        unsafe = F.transform("hits", lambda h: risk("unsafe_pattern", h["detail"], F.col("line") + h["line"] - 1))
        return scanned.select("path", "function", "line", F.concat("found", unsafe).alias("risks"))

    def structural_hash(self) -> DataFrame:
        """Hash over the ordered node kinds: comments and layout do not change it."""
        kinds = F.array_join(F.transform("nodes", lambda n: n["kind"]), "\n")
        return self.code.where("error IS NULL").select("path", F.sha2(kinds, 256).alias("structural_hash"))

    def node_profile(self) -> DataFrame:
        """Node counts by type in long form, for frequencies and entropy."""
        return self.nodes().groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("max_depth"))


def profile_entropy(counts: DataFrame, keys: list[str], n: str = "n", more: Sequence[Column] = ()) -> DataFrame:
    """Entropy, total and number of types from (keys, type, n) counts; ``more`` adds aggregates."""
    total = F.sum(n)
    entropy = F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total
    return counts.groupBy(*keys).agg(F.round(entropy, 6).alias("entropy"), total.alias("total_nodes"), F.count(F.lit(1)).alias("unique_types"), *more)


def file_rollup(functions: DataFrame, cold_by_name: Column, key: str = "path") -> DataFrame:
    """Per file: largest depth, hot operations, density, recursive functions, hot or cold."""
    rolled = functions.groupBy(key).agg(
        F.max("loop_depth").alias("max_nesting_depth"), F.sum("hot_operations").alias("total_operations"),
        F.array_sort(F.collect_set(F.when(F.col("recursive"), F.col("name")))).alias("recursive_functions"),
        F.round(F.sum("score"), 2).alias("density"),
    )
    return rolled.withColumn("classification", scores.hot_or_cold(F.col("density"), cold_by_name))
