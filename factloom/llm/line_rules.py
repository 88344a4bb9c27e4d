"""Quality rules by cross-document line frequency, in built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD, let, stored, text_of

SYMBOLS = r"[#*$%&|<>]"
#: Runs of white space inside a line that are not one blank.
BLANKS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate of its host in more than so many of the host's documents ...
LINE_DOCS = 10
#: ... and in more than so many per thousand of them.
LINE_PER_MILLE = 100
#: A document is depleted when boilerplate lines hold more than this share of its words.
DEPLETED_PERCENT = 70


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def window_hash(words: Column, start: Column) -> Column:
    return F.xxhash64(F.get(words, start), F.get(words, start + 1), F.get(words, start + 2))


def packed_windows(words: Column) -> Column:
    """Windows of three words in order of half their hash; the low half holds where each starts.

    A sort of plain longs, far cheaper than one of (hash, start); :func:`repeated_words` compares
    whole hashes where halves meet.
    """
    high = F.lit(-(1 << 32))
    hashes = F.transform(
        words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
    )
    return F.sort_array(F.slice(hashes, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def repeated_words(words: Column, packed: Column) -> Column:
    """Words inside a window of three that is found at least twice in the text."""

    def half(x: Column) -> Column:
        return F.shiftright(x, 32)

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda s, i: F.least(F.coalesce(F.get(starts, i + 1) - s, F.lit(3)), F.lit(3)))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def twice(tagged: Column) -> Column:
        def at(i: Column) -> Column:
            return F.get(tagged, i)["h"]

        same = F.filter(
            tagged,
            lambda x, i: F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def whole(near: Column) -> Column:
        starts = F.transform(near, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
        return F.sort_array(F.transform(starts, lambda i: F.struct(window_hash(words, i).alias("h"), i.alias("i"))))

    near = F.filter(
        packed,
        lambda x, i: (half(x) == half(F.get(packed, i + 1))) | ((i > 0) & (half(x) == half(F.get(packed, i - 1)))),
    )
    return let(near, lambda x: F.when(F.size(x) == 0, F.lit(0)).otherwise(let(let(whole(x), twice), covered))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def normalised(text: Column) -> Column:
    """Numbers as 0 and white space inside lines as single blanks."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), BLANKS, " ")


def normalised_lines(text: Column) -> Column:
    """Normalised lines that hold a word."""
    return F.filter(F.transform(F.split(normalised(text), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def line_profiles(docs: DataFrame) -> DataFrame:
    """One narrow row per document: counts, rule results, and hashes and sizes of its lines.

    The text is read once here and not needed again. Arrays that several expressions use are
    columns of their own, so each is built once.
    """
    text = docs.select("doc_id", F.col("source").alias("host"), text_of().alias("text"))
    split = text.select("*", words_of(F.col("text")).alias("w"))
    sorted_windows = split.select("*", packed_windows(F.col("w")).alias("p"))
    return sorted_windows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("content"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("w"), F.col("p")).alias("n_repeat_words"),
        F.transform(
            normalised_lines(F.col("text")),
            lambda s: F.struct(F.xxhash64(s).alias("line"), F.size(F.split(s, " ")).alias("words")),
        ).alias("lines"),
    )


def boilerplate_lines(profiles: DataFrame, line_docs: int, line_per_mille: int) -> DataFrame:
    """(host, line) of the lines found in too many different documents of their host.

    Documents with the same text count once, so copies of one clean document do not turn its lines
    into boilerplate. Counts are summed per task before each shuffle, so a line that a third of all
    documents hold sends one row per task.
    """
    once = profiles.select("host", "content", F.explode("lines.line").alias("line")).distinct()
    found = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > line_docs)
    hosts = (
        profiles.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
        .withColumnRenamed("host", "_host")
    )
    joined = found.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    return joined.where(F.col("n_docs") * 1000 > F.col("host_docs") * line_per_mille).select("host", "line", "n_docs")


def line_rules(
    docs: DataFrame,
    line_docs: int = LINE_DOCS,
    line_per_mille: int = LINE_PER_MILLE,
    depleted_percent: int = DEPLETED_PERCENT,
) -> DataFrame:
    """Judge every document by fixed rules and by how much of it is boilerplate of its host.

    Lines are normalised and hashed; the different documents of each host that hold a line are
    counted; lines above both limits are removed, and a document that loses more than
    ``depleted_percent`` of its words is rejected. ``source`` is the host; null is a host of its own.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_removed_words, kept, and removed_lines (hashes). A null or empty
    text has no words and fails; repeated rows are judged alike; an empty table gives no rows; other
    columns are ignored.
    """
    profiles = stored(line_profiles(docs), "line-profiles")
    bad = boilerplate_lines(profiles, line_docs, line_per_mille).select(
        F.col("host").alias("_host"), F.col("line").alias("_line")
    )
    key = ["doc_id", "host", "content"]
    lines = profiles.select(*key, F.posexplode("lines").alias("pos", "x")).select(
        *key, "pos", F.col("x.line").alias("line"), F.col("x.words").alias("words")
    )
    # A row that is repeated in the table meets its lines here once, by position.
    hit = lines.join(bad, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line"))).select(
        *key, "pos", "line", "words"
    ).distinct()
    lost = hit.groupBy(*key).agg(
        F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_set("line")).alias("removed_lines")
    ).select(*[F.col(k).alias(f"_{k}") for k in key], "n_removed_words", "removed_lines")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = profiles.drop("lines").join(lost, same, "left")
    removed = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        removed.alias("n_removed_words"),
        (~failed & (100 * removed <= depleted_percent * F.col("n_words"))).alias("kept"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
    )


def remove_lines(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Texts without their boilerplate lines; documents that are not kept go.

    Takes the rows of :func:`line_rules` as ``verdicts``. Rows of one doc_id are one document here:
    they stay if one of them is kept, and lose the lines of all. A null text becomes empty; an empty
    table gives no rows; other columns, whatever their names, stay as they are.
    """
    kept = verdicts.where("kept").groupBy(F.struct("doc_id").alias("key")).agg(F.flatten(F.collect_list("removed_lines")).alias("removed"))
    rows = docs.select(F.struct("*").alias("doc"), F.struct("doc_id").alias("key"), text_of().alias("whole"))

    def stays(line: Column) -> Column:
        return ~F.array_contains(F.col("removed"), F.xxhash64(F.trim(normalised(line))))

    text = F.array_join(F.filter(F.split("whole", "\n"), stays), "\n")
    joined = rows.join(kept, "key").withColumn("text", text)
    return joined.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
