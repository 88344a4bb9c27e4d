"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import give_back, labelled_sample, stored, text_of

#: Labelled documents that teach a model, at most: those first in the order of a hash of their ids.
SAMPLE = 4000
#: The kernel compares subsequences of three characters that lie within SPAN characters; a character
#: of the stretch they lie in weighs DECAY, so gaps and inserted characters cost little.
SPAN, DECAY = 7, 0.75
INSULTS, PLAIN = 40, 40
NEGATIVES = 6000
#: A labelled toxic document counts for new insults until so many that it holds are found.
COVER = 3
LONGEST = 40
#: Length of a string of four letters, the shortest that is learned, with a character between all letters.
GAPPED = 7
#: Tokens whose subsequences are laid out at once.
CHUNK = 2000
RUN_CHARS = 1_000_000
#: Words that a task remembers before it starts its memory anew.
KNOWN_WORDS = 150_000

_OFFSETS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


#: Letters set apart by blanks.
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
OUTER = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def words_of(text: str, heads: frozenset[str] = frozenset()) -> set[str]:
    """Different lower-case words of a text, and those that blanks have taken apart.

    Letters set apart by blanks are put together; a piece that is one of ``heads``, beginnings of
    insults, is put together with the pieces after it.
    """
    text = text.lower()
    pieces = text.split()
    words = set(pieces)
    for run in SPELLED.finditer(text):
        words.add("".join(run.group().split()))
    for i in [i for i, piece in enumerate(pieces) if piece.strip(OUTER) in heads]:
        joined = pieces[i].strip(OUTER)
        for piece in pieces[i + 1 :]:
            joined += piece
            words.add(joined)
            if joined not in heads:
                break
    return words


def heads_of(insults: list[str]) -> frozenset[str]:
    """Beginnings of two letters and more; without its first letter alone an insult is similar to itself."""
    return frozenset(s[:k] for s in insults for k in range(2, len(s)))


def views(word: str) -> list[str]:
    """What of a word is compared: itself, its letters alone, and every other character.

    Between the letters of an insult the other two leave out what was put there.
    """
    token = word.strip(OUTER)
    kinds = [token]
    if not token.isalpha():
        kinds.append("".join(filter(str.isalpha, token)))
    if len(token) >= GAPPED:
        kinds += [token[::2], token[1::2]]
    return list(dict.fromkeys(part for kind in kinds for part in cut(kind)))


def cut(word: str) -> list[str]:
    """The word without outer punctuation, in overlapping parts if it is long."""
    token = word.strip(OUTER)
    if len(token) <= LONGEST:
        return [token] if len(token) > 2 else []
    return [token[i : i + LONGEST] for i in range(0, len(token) - SPAN, LONGEST - SPAN)]


def _codes(tokens: list[str]) -> np.ndarray:
    """Characters folded to 1..63 as a matrix, 0 where a token has ended. Longer tokens are cut into overlapping parts before."""
    width = max(map(len, tokens), default=1)
    data = np.zeros((len(tokens), width + SPAN), np.int32)
    joined = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    rows = np.repeat(np.arange(len(tokens)), sizes)
    data[rows, np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = 1 + joined % 61
    return data


def _triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of each token (-1: none) and their weights, as columns."""
    width = codes.shape[1] - SPAN
    parts, weights = [], []
    first = codes[:, :width]
    for a, b in _OFFSETS:
        second, third = codes[:, a : a + width], codes[:, a + b : a + b + width]
        parts.append(np.where((third > 0) & (second > 0), (first * 64 + second) * 64 + third, -1))
        weights.append(np.full(width, DECAY ** (a + b + 1)))
    return np.concatenate(parts, axis=1), np.concatenate(weights)


def _norms(triples: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square root of each token's kernel with itself."""
    order = np.argsort(triples, axis=1)
    code = np.take_along_axis(triples, order, axis=1)
    weight = np.where(code < 0, 0.0, weights[order])
    total = np.cumsum(weight, axis=1)
    last = np.concatenate([code[:, 1:] != code[:, :-1], np.ones((len(code), 1), bool)], axis=1)
    upto = np.where(last, total, 0.0)
    before = np.concatenate([np.zeros((len(code), 1)), np.maximum.accumulate(upto, axis=1)[:, :-1]], axis=1)
    return np.sqrt((np.where(last, total - before, 0.0) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Landmarks:
    """Landmark strings by their subsequences: those of ``place[code]`` are entries ``begin`` to the next one's."""

    place: np.ndarray
    begin: np.ndarray
    mark: np.ndarray
    value: np.ndarray
    count: int

    @staticmethod
    def of(strings: list[str]) -> Landmarks:
        triples, weights = _triples(_codes(strings))
        norm = np.maximum(_norms(triples, weights), 1e-12)
        known, inverse = np.unique(triples, return_inverse=True)
        table = np.zeros((len(known), len(strings)))
        row = np.repeat(np.arange(len(strings)), triples.shape[1])
        np.add.at(table, (inverse.ravel(), row), np.tile(weights, len(strings)) / norm[row])
        table[known < 0] = 0
        place = np.full(64**3, -1, np.int32)
        place[known[known >= 0]] = np.flatnonzero(known >= 0)
        at, mark = np.nonzero(table)
        return Landmarks(place, np.searchsorted(at, np.arange(len(known) + 1)), mark, table[at, mark], len(strings))

    def kernel(self, tokens: list[str], weights: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
        """Normalised kernel of each token with each landmark.

        Rows are left at 0 where an upper bound shows that with these landmarks' ``weights`` they do not pass ``least``.
        """
        out = np.zeros((len(tokens), self.count))
        order = np.argsort(np.fromiter(map(len, tokens), np.int64, len(tokens)), kind="stable")
        for low in range(0, len(tokens), CHUNK):
            chunk = order[low : low + CHUNK]
            triples, decays = _triples(_codes([tokens[i] for i in chunk]))
            place = np.where(triples >= 0, self.place[triples], -1)
            rows, columns = np.nonzero(place >= 0)
            place = place[rows, columns]
            times = self.begin[place + 1] - self.begin[place]
            ends = np.cumsum(times)
            entry = np.repeat(self.begin[place] - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)
            cell = np.repeat(rows, times) * self.count + self.mark[entry]
            shared = np.bincount(cell, np.repeat(decays[columns], times) * self.value[entry], len(chunk) * self.count)
            shared = shared.reshape(len(chunk), self.count)
            some = shared.any(axis=1)
            if weights is not None:  # a norm is at least that of a token whose subsequences all differ
                floor = np.sqrt(np.where(triples >= 0, decays**2, 0.0).sum(axis=1))
                some &= shared @ weights > least * floor * (1 - 1e-9)
            some = np.flatnonzero(some)
            norm = np.maximum(_norms(triples[some], decays), 1e-12)
            out[chunk[some]] = shared[some] / norm[:, None]
        return out


@dataclass(frozen=True)
class ToxicityModel:
    landmarks: Landmarks
    heads: frozenset[str]  # beginnings of the insults among the landmarks
    weights: np.ndarray  # on the kernel with the landmarks, the Nystroem map included
    bias: float
    scale: np.ndarray  # logistic map of the two highest margins of a text

    def margins(self, tokens: list[str]) -> np.ndarray:
        """Margins of the machine; where they are neither positive nor above that of an empty token, the latter."""
        return self.landmarks.kernel(tokens, self.weights, max(0.0, -self.bias)) @ self.weights + self.bias

    def score(self, top: np.ndarray) -> np.ndarray:
        """Probability from the two highest margins (columns) of each text."""
        z = np.column_stack([np.ones(len(top)), np.clip(top, 0, 1.5)]) @ self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; the last one is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate /= 2 * np.linalg.eigvalsh((x * cost[:, None]).T @ x)[-1] + 1e-3
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ w))
        grad = 1e-3 * w - 2 * (x.T @ (cost * y * gap))
        speed = 0.9 * speed - rate * grad
        w = w + speed
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the bias first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * len(x) * 1e-1 * np.eye(x.shape[1]) + 1e-9 * np.eye(x.shape[1])
    keep[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, eligible: Column, size: int = SAMPLE) -> ToxicityModel | None:
    """Learn from labelled documents; None when both labels do not occur among them.

    Texts are compared word by word; sentences are not split. Strings (words and beginnings of
    words) that are found in many toxic documents and hardly in clean ones are chosen one by one,
    each for the toxic documents not yet explained. Words of toxic documents that begin with one, and
    words of clean documents, teach the machine; its landmarks are the chosen strings and common
    words of clean documents.
    """
    word = F.explode(
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}@]+"), F.lit(0)))
    )
    sample = labelled_sample(docs, labels, "toxic", eligible, size)
    words = stored(sample.select("doc_id", "label", word.alias("word")).where("length(word) BETWEEN 3 AND 40"), "labelled-words")
    counts = {r.label: r.n for r in words.select("doc_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    strings = words.select(
        "doc_id", "label", F.explode(F.array_distinct(F.array("word", *[F.left("word", F.lit(k)) for k in (4, 5, 6)]))).alias("string")
    ).where("length(string) > 3").distinct()
    often = strings.where("label = 1").groupBy("string").agg(F.count(F.lit(1)).alias("toxic")).where("toxic > 2")
    often = stored(often.orderBy(F.desc("toxic"), "string").limit(20_000), "strings")
    clean = strings.where("label = 0").join(F.broadcast(often.select("string")), "string")
    clean = clean.groupBy("string").agg(F.count(F.lit(1)).alias("clean"))
    strong = often.join(clean, "string", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    strong = strong.where(F.col("clean") * n_toxic * 20 <= F.col("toxic") * n_clean)
    strong = strong.orderBy(F.desc("toxic"), "string").limit(2000)
    found = strings.where("label = 1").join(F.broadcast(strong), "string").select("string", "doc_id", "clean").toPandas()
    insults = _chosen(found, max(3, n_toxic // 60))
    if not insults:
        return None
    clean = words.where("label = 0").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    plain = [r.word for r in clean.orderBy(F.desc("n"), "word").limit(PLAIN + 400).collect()]
    others = [r.word for r in clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES).collect()]
    starts = F.lit(False)
    for s in insults:
        starts = starts | F.col("word").startswith(s)
    toxic = words.where("label = 1").where(starts).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    toxic = [r.word for r in toxic.orderBy(F.desc("n"), "word").limit(3000).collect()]
    close = words.where("label = 0").where(starts).select("word").distinct().limit(1000)
    positives = sorted(set(toxic) - set(plain))
    clean_words = set(plain) | set(others) | {r.word for r in close.collect()}
    negatives = sorted(clean_words | {v for w in clean_words for v in views(w)} - set(positives))
    marks = list(dict.fromkeys([*insults, *plain]))[: len(insults) + PLAIN]
    landmarks = Landmarks.of(marks)
    own = landmarks.kernel(marks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-3 * values[-1]
    nystroem = vectors[:, good] / np.sqrt(values[good])
    x = landmarks.kernel(positives + negatives) @ nystroem
    y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
    cost = np.where(y > 0, 0.5 / len(positives), 0.5 / len(negatives))
    w = _hinge(x, y, cost)
    model = ToxicityModel(landmarks, heads_of(insults), nystroem @ w[:-1], float(w[-1]), np.zeros(3))
    tops = sample.select("label", margins_of(F.col("text"), model).alias("m")).select("label", "m.*").toPandas()
    top = tops[["top1", "top2"]].to_numpy()
    scale = logistic(np.clip(top, 0, 1.5), tops["label"].to_numpy().astype(float))
    return ToxicityModel(landmarks, heads_of(insults), model.weights, model.bias, scale)


def _chosen(found: pd.DataFrame, least: int) -> list[str]:
    """Strings one by one: those in most toxic documents that are not explained often enough yet."""
    docs = {s: set(g) for s, g in found.groupby("string")["doc_id"]}
    clean = found.groupby("string")["clean"].first().to_dict()
    covered: dict[int, int] = {}
    chosen: list[str] = []
    while docs and len(chosen) < INSULTS:
        gain = {s: sum(covered.get(d, 0) < COVER for d in ids) - 3 * clean[s] for s, ids in docs.items()}
        best = max(docs, key=lambda s: (gain[s], len(s), s))
        if gain[best] < least:
            break
        chosen.append(best)
        for d in docs.pop(best):
            covered[d] = covered.get(d, 0) + 1
        docs = {s: ids for s, ids in docs.items() if not s.startswith(best) and not best.startswith(s)}
    return chosen


def _tops(model: ToxicityModel, batches: Iterator[pd.Series]) -> Iterator[np.ndarray]:
    """Margins of the two most toxic words of each text of a batch; every different word is compared once."""
    known: set[str] = set()
    toxic: dict[str, float] = {}
    for batch in batches:
        tops, at = [np.empty((0, 2))], 0
        while at < len(batch):
            held: list[set[str]] = []
            size = 0
            while at + len(held) < len(batch) and (not held or size < RUN_CHARS):
                text = batch.iat[at + len(held)]
                size += len(text)
                held.append(words_of(text, model.heads))
            if len(known) > KNOWN_WORDS:
                known, toxic = set(), {}
            new = list(set().union(*held) - known)
            known.update(new)
            parts = [(w, part) for w in new for part in views(w)]
            margins = model.margins([part for _, part in parts]) if parts else np.empty(0)
            for i in np.flatnonzero(margins > max(model.bias, 0.0)):  # scores see nothing below 0
                w = parts[i][0]
                toxic[w] = max(float(margins[i]), toxic.get(w, model.bias))
            top = np.full((len(held), 2), model.bias)
            for k, words in enumerate(held):
                if best := sorted({toxic[w] for w in words & toxic.keys()})[-2:]:
                    top[k, : len(best)] = best[::-1]
            tops.append(top)
            at += len(held)
        yield np.concatenate(tops)
    del known, toxic
    give_back()


def margins_of(text: Column, model: ToxicityModel) -> Column:
    """(top1, top2): margins of the two most toxic words of a text.

    The margin of a sentence is that of its most toxic word, and that of a text is that of its most
    toxic sentence.
    """

    @F.pandas_udf("top1 double, top2 double")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for top in _tops(model, batches):
            yield pd.DataFrame(top, columns=["top1", "top2"])

    return margins(text_of(text))


def toxicity_score(text: Column, model: ToxicityModel | None) -> Column:
    """The probability of the label, between 0 and 1, from the whole text; null counts as empty.

    An empty text, and any text under a missing model, has the score of a text without toxic words.
    """
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for top in _tops(model, batches):
            yield pd.Series(model.score(top))

    return score(text_of(text))


def toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score) per input row; repeated rows get equal scores, other columns are ignored."""
    return docs.select("doc_id", toxicity_score(F.col("text"), model).alias("score"))


def without_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores below ``threshold``, with the columns that they have.

    A null text counts as empty; repeated rows stay or go alike; an empty table gives no rows.
    """
    return docs.where(toxicity_score(F.col("text"), model) < threshold)
