"""Name resolution and reference checks over narrow fact tables.

Name tables have the columns (path, role, name) or (path, name).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions import text as T
from factloom.session import cut_lineage


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the files: it is never broadcast.

    Spark guesses the size of rows that come out of arrays or out of Python from the size of the scan below,
    which can be hundreds of times too small.
    """
    return side.hint("merge")


def unresolved_names(
    used: DataFrame, defined: DataFrame, imported: DataFrame, builtins: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """(path, name) used but neither defined, imported nor built in; optionally only known names."""
    missing = (
        used.select("path", "name")
        .distinct()
        .join(_shuffled(defined.select("path", "name")), ["path", "name"], "left_anti")
        .join(_shuffled(imported.select("path", "name")), ["path", "name"], "left_anti")
        .join(builtins.select("name"), "name", "left_anti")
    )
    return missing if known is None else missing.join(known.select("name").distinct(), "name", "left_semi")


def symbol_index(definitions: DataFrame, order: str = "path") -> DataFrame:
    """First definition of every name in ``order``."""
    return definitions.groupBy("name").agg(F.min_by("path", order).alias("target"))


def resolve_missing(missing: DataFrame, index: DataFrame) -> DataFrame:
    """Import edges for missing names, never to the file itself."""
    return missing.join(index, ["name"]).where("path <> target")


def dead_imports(imports: DataFrame, uses: DataFrame, dynamic_files: DataFrame) -> DataFrame:
    """Imported names without a use in their file.

    ``imports`` has (path, name, structural); structural imports (future, star) stay, ``uses``
    includes names inside strings, and files with dynamic lookups are left alone. Few paths may hold many
    imports, so how these files are joined is left to their table.
    """
    return (
        imports.where(~F.col("structural"))
        .join(_shuffled(uses.select("path", "name")), ["path", "name"], "left_anti")
        .join(dynamic_files.select("path"), "path", "left_anti")
        .select("path", "name")
        .distinct()
    )


def is_external(module: Column, standard: Sequence[str] = tuple(sorted(sys.stdlib_module_names))) -> Column:
    """Whether the root of a dotted module is outside the ``standard`` parameter list."""
    root = F.split_part(module, F.lit("."), F.lit(1))
    return ~(root.isin(list(standard)) | (root.startswith("_") & F.ltrim(root, F.lit("_")).isin(list(standard))))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve (path, module) against a file list; leading dots climb, ``.py`` beats a package."""
    dots = F.length("module") - F.length(F.ltrim(F.col("module"), F.lit(".")))
    parts = F.filter(F.split("module", r"\."), lambda p: p != "")
    folder = F.split("path", "/")
    base = F.when(dots > 0, F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots, F.lit(0)))).otherwise(
        F.array().cast("array<string>")
    )
    stem = F.array_join(F.concat(base, parts), "/")
    tries = F.when(
        F.size(parts) > 0,
        F.array(
            F.struct(F.lit(0).alias("priority"), F.concat(stem, F.lit(".py")).alias("candidate")),
            F.struct(F.lit(1).alias("priority"), F.concat(stem, F.lit("/__init__.py")).alias("candidate")),
        ),
    )
    wanted = imports.select("path", "module").distinct()
    found = (
        wanted.select("path", "module", F.inline(tries))
        .join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
        .groupBy("path", "module")
        .agg(F.min_by("candidate", "priority").alias("resolved"))
    )
    return wanted.join(found, ["path", "module"], "left")


def adjacency(resolved: DataFrame) -> DataFrame:
    """Sorted unique dependencies per file (a file imports a bounded number of modules)."""
    return (
        resolved.where("resolved IS NOT NULL")
        .groupBy("path")
        .agg(F.array_sort(F.collect_set("resolved")).alias("requires"))
    )


def reference_edges(items: DataFrame, variables: DataFrame) -> DataFrame:
    """Edges from facts to the state variables of their own domain that they mention."""
    mentions = items.select("id", "domain", F.explode(F.array_distinct("variables")).alias("symbol"))
    targets = cut_lineage(variables.groupBy("domain", "symbol").agg(F.max("id").alias("target")))  # a plain side can be split against
    return mentions.join(targets, ["domain", "symbol"]).where("id <> target").select("id", "target", "symbol")


def shared_symbol_edges(variables: DataFrame) -> DataFrame:
    """Both directions between the nodes of one symbol in different domains.

    Grouping to (symbol, domain) first bounds a symbol's set by the number of domains, a
    fixed list, so even a symbol used everywhere stays a small set.
    """
    sets = (
        variables.select("symbol", "domain")
        .distinct()
        .groupBy("symbol")
        .agg(F.collect_set("domain").alias("domains"))
        .where(F.size("domains") > 1)
    )
    return (
        sets.select("symbol", "domains", F.explode("domains").alias("src_domain"))
        .select("symbol", "src_domain", F.explode("domains").alias("dst_domain"))
        .where("src_domain <> dst_domain")
    )


def declared_links(links: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Declared (src, dst) links with ``accepted``: both ends must exist in their node table."""
    src = sources.select(F.col("node").alias("src"), F.lit(True).alias("has_src"))
    dst = targets.select(F.col("node").alias("dst"), F.lit(True).alias("has_dst"))
    joined = links.join(src, ["src"], "left").join(dst, ["dst"], "left")
    return joined.withColumn("accepted", F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()).drop("has_src", "has_dst")


#: Bits of an anchor filter, as a power of two: sixteen for each anchor, at most 2 MB.
MOST_FILTER_BITS = 24
#: Counted candidates up to which they travel to the texts instead of the texts to them.
SMALL_ROWS = 200_000


def _anchor_filter(wanted: DataFrame, anchors: int) -> Column:
    """One array of longs, of bounded size, whose bits mark the hashes of the wanted anchors."""
    bits = min(MOST_FILTER_BITS, max(6, (16 * anchors).bit_length()))
    low = (1 << bits) - 1
    hashed = wanted.select(F.expr(f"xxhash64(anchor) & {low}L").alias("h"))
    masks = hashed.groupBy(F.shiftright("h", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("mask"))
    every = wanted.sparkSession.range(1 << (bits - 6)).join(masks, "id", "left")
    words = F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0)).alias("mask")))), lambda w: w["mask"])
    return cut_lineage(every.agg(F.struct(words.alias("words"), F.lit(low).cast("long").alias("low")).alias("filter"))).scalar()


def _candidates(docs: DataFrame, wanted: DataFrame, arrays: Sequence[Column], on: Sequence[str] = ()) -> DataFrame:
    """(doc_key, phrase_id, phrase) of the documents that hold the phrase's anchor and agree with it in ``on``.

    Anchors of a text are filtered inside its arrays, so only those that may be wanted become rows,
    and no text goes with them.
    """
    wanted = cut_lineage(wanted)
    count = wanted.select("anchor").distinct().count()
    anchors = [column.alias(f"_anchors{i}") for i, column in enumerate(arrays)]
    known = docs.select(F.struct("doc_id", *on).alias("doc_key"), *on, *anchors).withColumn("f", _anchor_filter(wanted, count))
    near = [
        F.expr(
            f"filter(transform(_anchors{i}, a -> struct(a AS anchor, xxhash64(a) & f.low AS h)),"
            " a -> (shiftrightunsigned(get(f.words, cast(shiftright(a.h, 6) AS int)), cast(a.h & 63 AS int)) & 1L) = 1L)"
        )
        for i in range(len(anchors))
    ]
    met = known.select("doc_key", *on, F.explode(F.concat(*near)).alias("a")).select("doc_key", *on, F.col("a.anchor").alias("anchor"))
    return met.join(wanted, [*on, "anchor"]).select("doc_key", "phrase_id", "phrase").distinct()


def _containing(docs: DataFrame, candidates: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """The candidates whose text contains the phrase; texts are joined back to these only."""
    candidates = cut_lineage(candidates)
    rows = candidates.count()
    texts = docs.select("doc_id", *on, "text", F.struct("doc_id", *on).alias("doc_key"))
    found = texts.join(F.broadcast(candidates) if rows <= SMALL_ROWS else candidates, "doc_key")
    return found.where(F.contains("text", "phrase")).select("doc_id", *on, "phrase_id")


def contained_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase_id) where the document text contains the phrase as a substring.

    Instead of testing every pair, each phrase is found through one anchor. A word inside a
    phrase (neither first nor last) must be a whole word of any text that contains the phrase,
    so the longest such word is the anchor; phrases without an inner word are anchored by their
    first characters. Both give an equality join, and ``contains`` decides the candidates.
    """
    words = T.tokens(F.col("phrase"))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchored = cut_lineage(phrases.select("phrase_id", "phrase", longest.alias("anchor")).where("phrase <> ''"))
    by_word = _candidates(docs, anchored.where("anchor IS NOT NULL"), [F.array_distinct(T.tokens(F.col("text")))])
    short, _ = _name_candidates(docs, anchored.where("anchor IS NULL").select("phrase_id", "phrase"))
    return _containing(docs, by_word.unionByName(short).distinct())


def contained_names(docs: DataFrame, names: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Like :func:`contained_phrases` for short names, anchored by their leading characters.

    Both tables have the columns ``on``, in which a document and a name must agree.
    """
    candidates, whole = _name_candidates(docs, names, on)
    found = candidates.select("doc_key.*", "phrase_id") if whole else _containing(docs, candidates, on)
    return found.distinct()


#: Most lengths of anchors of names.
ANCHOR_LENGTHS = 16
LONGEST_ANCHOR = 256
#: Characters up to which all substrings of a text are cheaper to take from the text itself.
SHORT_TEXT = 500


def _name_candidates(docs: DataFrame, names: DataFrame, on: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Candidates of names, and whether an anchor is the whole name everywhere, so that they need no test.

    An anchor is the whole name while names have few lengths: names that only begin alike share no
    anchor, and a document meets no more names than it holds. Else it has the longest of some
    lengths that fits.
    """
    names = cut_lineage(names)
    length = F.least(F.length("phrase"), F.lit(LONGEST_ANCHOR))
    lengths = sorted(r.size for r in names.select(length.alias("size")).distinct().collect())  # at most LONGEST_ANCHOR
    step = max(1.0, len(lengths) / ANCHOR_LENGTHS)
    sizes = [lengths[int(i * step)] for i in range(min(len(lengths), ANCHOR_LENGTHS))]
    if not sizes:
        fields = [*docs.select(F.struct("doc_id", *on).alias("doc_key")).schema.fields, *names.select("phrase_id", "phrase").schema.fields]
        return docs.sparkSession.createDataFrame([], StructType(fields)), True
    size_of = F.coalesce(F.length("text"), F.lit(0))
    # a substring is looked for from the front, so long texts are cut into characters first
    docs = docs.withColumn("_chars", F.when(size_of > SHORT_TEXT, F.split("text", "")))

    def grams(size: int) -> Column:
        starts = F.when(size_of >= size, F.sequence(F.lit(1), size_of - (size - 1))).otherwise(F.array().cast("array<int>"))
        sliced = F.transform(starts, lambda i: F.array_join(F.slice("_chars", i, size), ""))
        plain = F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(size)))
        return F.array_distinct(F.when(size_of > SHORT_TEXT, sliced).otherwise(plain))

    fitting = F.array_max(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.length("phrase")))
    anchored = names.withColumn("anchor", F.left("phrase", fitting))
    whole = len(sizes) == len(lengths) and lengths[-1] < LONGEST_ANCHOR
    return _candidates(docs, anchored, [grams(size) for size in sizes], on), whole


def cross_language_edges(calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """Call sites whose text contains any name of a foreign binding.

    ``calls`` has (node, text); ``bindings`` has (name, target, type, names ARRAY<STRING>).
    """
    skipped = ["gpu_kernel", "python_ctypes", "python_cffi"]
    wanted = bindings.where(~F.col("type").isin(skipped))
    names = wanted.select(
        F.struct("name", "target", "type").alias("phrase_id"),
        F.explode(F.array_distinct(F.array_compact(F.col("names")))).alias("phrase"),
    ).where("phrase <> ''")
    hits = contained_names(calls.select(F.col("node").alias("doc_id"), "text"), names).distinct()
    edge = F.when(F.col("phrase_id.type") == "pyo3_function", "pyo3_ffi_bridge").otherwise("c_abi_bridge")
    return hits.select(
        F.col("doc_id").alias("src"), F.col("phrase_id.target").alias("dst"), edge.alias("edge_type"),
        F.col("phrase_id.name").alias("ffi_function"),
    )


def kernel_edges(calls: DataFrame, kernels: DataFrame) -> DataFrame:
    """Calls to a kernel by name or by a launch (``name<<<``) in their text."""
    launches = F.regexp_extract_all("text", F.lit(r"(?U)(\w+)\s*<<<"), F.lit(1))
    named = calls.select(F.col("node").alias("src"), F.explode(F.array_union(F.array("name"), launches)).alias("kernel"))
    return named.join(kernels.select(F.col("name").alias("kernel"), F.col("node").alias("dst")), "kernel").distinct()


def def_use_edges(definitions: DataFrame, uses: DataFrame, order: str) -> DataFrame:
    """Edges from the last definition of a name to its uses."""
    last = cut_lineage(definitions.groupBy("name").agg(F.max_by("node", order).alias("src")))  # a plain side can be split against
    return uses.select("name", F.col("node").alias("dst")).join(last, ["name"]).where("src <> dst")


def external_calls(calls: DataFrame, aliases: DataFrame, external: DataFrame) -> DataFrame:
    """Calls (path, function, root, call) into external modules, through the aliases of their file."""
    return (
        calls.join(_shuffled(aliases.select("path", F.col("alias").alias("root"), "module")), ["path", "root"], "left")
        .withColumn("module", F.coalesce("module", "root"))
        .join(_shuffled(external.select("path", "module").distinct()), ["path", "module"], "left_semi")
        .select("path", "function", "call", "module")
    )


def attribute_to_dependency(errors: DataFrame, dependencies: DataFrame, locked: DataFrame) -> DataFrame:
    """Name the dependency behind a receiver type or import path, with declared and locked version.

    ``errors`` has (id, target, receiver); ``dependencies`` has (target, crate, version) and
    ``locked`` has (crate, version). A bare type is blamed on a target's only dependency.
    """
    cleaned = F.regexp_replace(F.ltrim(F.trim("receiver"), F.lit("&")), r"^\s*mut\s+", "")
    receiver = F.trim(F.regexp_replace(cleaned, r"<.*$", ""))
    qualified = F.contains(receiver, F.lit("::"))

    def path_form(name: Column) -> Column:
        return F.replace(name, F.lit("-"), F.lit("_"))

    keyed = errors.withColumn("receiver", receiver).withColumn(
        "crate_key", F.when(qualified, path_form(F.split_part("receiver", F.lit("::"), F.lit(1))))
    )
    named = dependencies.groupBy("target", path_form(F.col("crate")).alias("crate_key")).agg(
        F.min("crate").alias("dep"), F.min_by("version", "crate").alias("declared")
    )
    single = dependencies.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_deps"), F.min("crate").alias("only_dep"), F.min("version").alias("only_version")
    ).where("n_deps = 1")
    versions = locked.groupBy(path_form(F.col("crate")).alias("lock_key")).agg(F.max("version").alias("locked"))
    head = F.split_part("receiver", F.lit("::"), F.lit(1))
    crate = F.coalesce(F.col("dep"), F.when(F.col("crate_key").isNotNull(), head), F.col("only_dep"))
    return (
        keyed.join(named, ["target", "crate_key"], "left")
        .join(single, "target", "left")
        .withColumn("crate", crate)
        .withColumn(
            "declared_version",
            F.coalesce("declared", F.when(F.col("crate_key").isNull(), F.col("only_version"))),
        )
        .withColumn("lock_key", path_form(F.col("crate")))
        .join(versions, "lock_key", "left")
        .select("id", "target", "receiver", "crate", "declared_version", F.col("locked").alias("resolved_version"))
    )


def partition_names(names: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Every row once, marked as passed or held."""
    marks = held.select(key).distinct().withColumn("_held", F.lit(True))
    return names.join(marks, key, "left").withColumn(
        "decision", F.when(F.col("_held"), "held").otherwise("passed")
    ).drop("_held")
