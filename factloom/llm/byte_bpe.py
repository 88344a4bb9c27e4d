"""Byte-level BPE with the merges done by recursive DuckDB queries inside each Spark task."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import free_name, give_back

#: The characters of the split pattern's ``\s``, spelled out: libraries differ on the control characters 0x1C-0x1F.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: A blank beside other white space; the split pattern may put both into one match.
WIDE_BLANK = re.compile(r" \s|\s ")
#: A merge query makes this many steps before its rows are written down and the next one goes on from them.
STEPS = 12
LONG = 64
#: New words of a batch are merged in groups of about so many bytes.
GROUP_BYTES = 250_000
#: Words whose ids a task remembers before it starts its memory anew.
KNOWN_WORDS = 300_000
#: Texts of a batch are handled in runs of about so many characters or ids.
RUN = 1_000_000

#: The token-position rows of every word join the merge table; its leftmost pair of minimum rank is
#: contracted, until no pair is left.
CONTRACT = """
WITH RECURSIVE state AS (
  SELECT word, ids FROM tokens
  UNION ALL
  (WITH pairs AS (
    SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS pos FROM state
  ), best AS (
    SELECT word, min((rank::BIGINT << 32) + pos) AS best FROM pairs JOIN merges USING (a, b) GROUP BY word
  ), found AS (
    SELECT word, (best >> 32)::INT AS merged, best & 4294967295 AS pos FROM best
  )
  SELECT word, ids[:pos - 1] || [merged] || ids[pos + 2:] FROM found JOIN state USING (word))
)
SELECT word, arg_min(ids, len(ids)) AS ids FROM state GROUP BY word ORDER BY word
"""
#: The same for words of over LONG bytes, whose many steps would each read them whole, STEPS steps at a time. Where no pair that a merge creates can rank below the merge itself, all its places in the word are
#: contracted at once (in a chain a-a-a every second one), which gives the same tokens in fewer steps.
CONTRACT_LONG = f"""
WITH RECURSIVE state AS (
  SELECT word, pos, id, 0 AS step, true AS active FROM tokens
  UNION ALL
  SELECT word, pos, merged, step + 1, found
  FROM (
    SELECT word, pos, step, best IS NOT NULL AS found,
           CASE WHEN first THEN best ELSE id END AS merged,
           coalesce(lag(first) OVER w, false) AS second
    FROM (
      SELECT *, CASE WHEN best IS NULL THEN false
                     WHEN safe THEN rank = best AND (turn - 1) % 2 = 0
                     ELSE pos = place END AS first
      FROM (
        SELECT *, row_number() OVER (PARTITION BY word, chain, rank = best ORDER BY pos) AS turn
        FROM (
          SELECT *, sum((rank IS DISTINCT FROM best)::INT) OVER (PARTITION BY word ORDER BY pos) AS chain
          FROM (
            SELECT p.word, p.pos, p.id, p.step, m.rank, min(m.rank) OVER (PARTITION BY p.word) AS best,
                   min(CASE WHEN m.rank IS NOT NULL THEN m.rank * 4294967296 + p.pos END) OVER (PARTITION BY p.word) % 4294967296 AS place,
                   coalesce(bool_and(m.safe) OVER (PARTITION BY p.word, m.rank), false) AS safe
            FROM (
              SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next FROM state WHERE active AND step < {STEPS}
            ) p LEFT JOIN merges m ON p.id = m.a AND p.next = m.b))))
    WINDOW w AS (PARTITION BY word ORDER BY pos))
  WHERE NOT second
)
SELECT word, pos, id, active FROM state
QUALIFY step = max(step) OVER (PARTITION BY word)
"""


class Tokenizer:
    """Ranks of a tiktoken file, as DuckDB tables in this process's memory."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("the ranks do not cover all bytes")
        a, b, rank = [], [], []
        for token, own in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    rank.append(own)
        a, b, rank = (np.array(x, np.int32) for x in (a, b, rank))
        lowest = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(lowest, a, rank)  # the lowest rank of a pair that holds the token
        np.minimum.at(lowest, b, rank)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '250MB'")
        merges = pa.table({"a": a, "b": b, "rank": rank, "safe": lowest[rank] > rank})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        pieces = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM pieces")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.ids = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per word) of words that are no tokens themselves."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        number = pa.array(np.arange(len(words), dtype=np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        self.db.register("tokens", pa.table({"word": number, "ids": lists}))
        merged = self.db.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("tokens")
        return merged.flatten().to_numpy(), np.diff(merged.offsets.to_numpy())

    def _merge_long(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        tokens = pa.table({"word": np.zeros(len(ids), np.int32), "pos": np.arange(len(ids), dtype=np.int32), "id": ids})
        active = True
        while active:
            self.db.register("tokens", tokens)
            rows = self.db.sql(CONTRACT_LONG).to_arrow_table()
            self.db.unregister("tokens")
            active = rows.column("active")[0].as_py()
            tokens = rows.select(["word", "pos", "id"]).sort_by("pos")
        return tokens.column("id").to_numpy(), np.array([len(tokens)])

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        new = [w for w in words if w not in self.index]
        encoded = [w.encode() for w in new]
        ranks = list(map(self.ranks.get, encoded))
        whole = [i for i, r in enumerate(ranks) if r is not None]
        self._add([new[i] for i in whole], np.array([ranks[i] for i in whole], np.int32), np.ones(len(whole), np.int64))
        rest = [i for i, r in enumerate(ranks) if r is None]
        sizes = np.array([len(encoded[i]) for i in rest])
        short = np.flatnonzero(sizes <= LONG)
        group = np.cumsum(sizes[short]) // GROUP_BYTES
        for part in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else []:
            own = [rest[i] for i in part]
            self._add([new[i] for i in own], *self._merge([encoded[i] for i in own]))
        for i in np.flatnonzero(sizes > LONG):
            self._add([new[rest[i]]], *self._merge_long(encoded[rest[i]]))

    def _know(self, pieces: list[str]) -> None:
        """Encode pieces of texts that are not known yet: each match of the pattern by itself."""
        new = [p for p in pieces if p not in self.index]
        split = [self.pattern.findall(p) for p in new]
        self.learn({w for words in split for w in words})
        several = [(p, words) for p, words in zip(new, split, strict=True) if len(words) != 1]
        if several:
            ids, bounds = self._joined([words for _, words in several])
            self._add([p for p, _ in several], ids, np.diff(bounds))

    def _joined(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of known strings, and where each row begins and ends."""
        ids, ends = self._ids(np.fromiter((self.index[w] for words in rows for w in words), np.int64))
        return ids, np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])]

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text.

        A text is cut before single blanks between other characters, where matches of the pattern
        end in any case; pieces that texts have in common are split and encoded once. Texts with
        wider blanks are not cut.
        """
        if len(self.index) > KNOWN_WORDS:
            self.forget()
        wide = [i for i, t in enumerate(texts) if not t or t[0] == " " or WIDE_BLANK.search(t)]
        whole = [self.pattern.findall(texts[i]) for i in wide]
        self.learn({w for words in whole for w in words})
        rows: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        if wide:
            ids, bounds = self._joined(whole)
            for k, i in enumerate(wide):
                rows[i] = ids[bounds[k] : bounds[k + 1]]
        chosen = set(wide)
        plain = [i for i in range(len(texts)) if i not in chosen]
        if plain:
            split = pa.compute.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
            coded = split.flatten().dictionary_encode()
            words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            begins = split.offsets.to_numpy()
            first = code[begins[:-1]]  # these have no blank before them
            later = np.delete(code, begins[:-1])
            heads = {int(c): words[c] for c in np.unique(first)}
            tails = {int(c): " " + words[c] for c in np.unique(later)}
            self._know(list(dict.fromkeys([*heads.values(), *tails.values()])))
            place = np.zeros(2 * len(words), np.int64)
            for shift, known in ((0, heads), (len(words), tails)):
                at = np.fromiter(known, np.int64, len(known))
                place[at + shift] = np.fromiter(map(self.index.__getitem__, known.values()), np.int64, len(known))
            code += len(words)
            code[begins[:-1]] -= len(words)
            ids, ends = self._ids(place[code])
            bounds = np.concatenate([[0], ends])[begins]
            for k, i in enumerate(plain):
                rows[i] = ids[bounds[k] : bounds[k + 1]]
        bounds = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int32()))

    def _ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known strings one after another, and where each string's end."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.index)
        self.index.update(zip(names, range(first, first + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        sizes = np.diff(ids.offsets.to_numpy())
        flat = ids.flatten()
        tokens = pa.table({  # noqa: F841
            "doc": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
            "pos": np.arange(len(flat), dtype=np.int32),
            "id": flat,
        })
        self.db.register("ids", tokens)
        rows = self.db.execute(
            "SELECT doc, string_agg(piece, '') AS text"
            " FROM (SELECT doc, piece FROM ids JOIN vocabulary USING (id) ORDER BY pos) GROUP BY doc"
        ).fetchall()
        self.db.unregister("ids")
        out = [b""] * len(sizes)
        for doc, text in rows:
            out[doc] = text.encode("latin-1")
        return out


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per worker process and vocabulary."""
    return Tokenizer(path, pattern)


def _runs(sizes: list[int]) -> Iterator[slice]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > RUN:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(
    docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text", decoded: str | None = None,
    keep: bool = True,
) -> DataFrame:
    """Every row with its whole text as token ids in the array column ``ids``, which replaces a namesake.

    Each match of ``pattern`` is encoded by itself, without special tokens. A null text counts as
    empty and has no ids. Texts are read in runs of bounded size and the different words of a run are
    encoded once. ``path`` must be readable on every executor. ``decoded`` names a binary column for
    what :func:`decode` makes of the ids, in the same pass. Repeated rows are encoded alike; an empty
    table gives no rows; other columns stay. With ``keep`` a worker process holds its merge tables
    and known words for its next task; without it, their memory is given back.
    """
    out = [ids, decoded] if decoded else [ids]
    columns = [c for c in docs.columns if c not in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = batch.column(len(columns))
            for part in _runs(pa.compute.binary_length(texts).to_pylist()):
                encoded = bpe.encode(texts[part].to_pylist())
                made = [encoded, pa.array(bpe.decode(encoded), pa.binary())] if decoded else [encoded]
                rest = [batch.column(i)[part] for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*columns, *out])
        if not keep:
            del bpe
            tokenizer.cache_clear()
            give_back()

    schema = T.StructType(docs.select(*columns).schema.fields).add(ids, T.ArrayType(T.IntegerType()))
    schema = schema.add(decoded, T.BinaryType()) if decoded else schema
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(free_name(columns, "_text"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Every row with the bytes of its ids in the binary column ``out``, which replaces a namesake.

    Null ids give no bytes; repeated rows are decoded alike; an empty table gives no rows.
    """
    columns = [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            lists = batch.column(len(columns)).cast(pa.list_(pa.int32()))
            for part in _runs(pa.compute.list_value_length(lists).to_pylist()):
                own = pa.array(lists[part].to_pylist(), pa.list_(pa.int32()))
                rest = [batch.column(i)[part] for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(bpe.decode(own), pa.binary())], names=[*columns, out])

    schema = T.StructType(encoded.select(*columns).schema.fields).add(out, T.BinaryType())
    filled = F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(free_name(columns, "_ids"))
    return encoded.select(*columns, filled).mapInArrow(run, schema)
