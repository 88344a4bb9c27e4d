"""Quality by a sparse ensemble of rules, learned from trees and compiled into column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD, labelled_sample, stored, text_of

#: Labelled documents that teach a model, at most: those first in the order of a hash of their ids.
SAMPLE = 5000
TREES, DEPTH = 16, 3
LASSO = 0.002

#: (feature, low, threshold, above): the rule holds where the feature is above the threshold, or not.
Condition = tuple[str, float, bool]


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def statistics(docs: DataFrame) -> DataFrame:
    """The rows without their text, with statistics of the whole text; null texts count as empty."""
    rest = [c for c in docs.columns if c not in ("text", *FEATURES)]
    split = docs.select(*rest, text_of().alias("_text")).select(
        "*", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda s: s != "").alias("_lines"),
    )

    def count(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern))

    size, words, lines = F.length("_text"), F.size("_words"), F.size("_lines")
    made = {
        "log_words": F.log1p(words.cast("double")),
        "word_length": _share(F.length(F.array_join("_words", "")), words),
        # on a log scale, as long texts repeat more words
        "different_words": F.log1p(F.size(F.array_distinct("_words")).cast("double")) / F.log1p(F.greatest(words, F.lit(1)).cast("double")),
        "echoes": _share(count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)\x20\1(?![^\x20\x09-\x0D])"), words),
        "symbols": _share(count(r"[#*$%&<>=+~^]"), words),
        "bars": _share(count(r"\|"), words),
        "shouts": _share(count("!"), words),
        "capitals": _share(count("[A-Z]"), size),
        "digits": _share(count("[0-9]"), size),
        "stops": _share(count(r"\."), words),
        "commas": _share(count(","), words),
        "line_words": _share(words, lines),
        "repeated_lines": _share(lines - F.size(F.array_distinct("_lines")), lines),
    }
    return split.select(*rest, *[column.alias(name) for name, column in made.items()])


FEATURES = (
    "log_words", "word_length", "different_words", "echoes", "symbols", "bars", "shouts", "capitals", "digits", "stops",
    "commas", "line_words", "repeated_lines",
)


@dataclass(frozen=True)
class RuleModel:
    """Conjunctive rules with logistic weights; rules that the lasso set to zero are left out."""

    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        terms = [F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in zip(self.rules, self.weights, strict=True)]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def holds(rule: tuple[Condition, ...]) -> Column:
    parts = [F.col(name) > threshold if above else F.col(name) <= threshold for name, threshold, above in rule]
    return reduce(lambda a, b: a & b, parts)


def tree_rules(tree: DecisionTreeClassificationModel) -> list[tuple[Condition, ...]]:
    """The paths from the root to each other node, as conjunctions."""
    found: list[tuple[Condition, ...]] = []

    def walk(node, path: tuple[Condition, ...]) -> None:
        if path:
            found.append(path)
        if node.subtreeDepth() > 0:
            split = node.split()
            name, threshold = FEATURES[split.featureIndex()], split.threshold()
            walk(node.leftChild(), (*path, (name, threshold, False)))
            walk(node.rightChild(), (*path, (name, threshold, True)))

    walk(tree._java_obj.rootNode(), ())
    return found


def train_rules(docs: DataFrame, labels: DataFrame, eligible: Column, size: int = SAMPLE) -> RuleModel:
    """Learn from at most ``size`` labelled documents; with one label only, the model is its share."""
    sample = statistics(labelled_sample(docs, labels, "quality", eligible, size))
    sample = stored(sample.select(F.col("label").cast("double").alias("label"), *FEATURES), "quality-statistics")
    total, good = sample.select(F.count(F.lit(1)), F.sum("label")).first()
    if not total or good in (0, total):
        share = (good or 0) / total if total else 0.5
        return RuleModel((), (), 20.0 if share == 1 else -20.0 if share == 0 and total else 0.0)
    points = sample.coalesce(2).select("*", array_to_vector(F.array(*FEATURES)).alias("features"))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.7,
        featureSubsetStrategy="0.5", minInstancesPerNode=3,
    ).fit(points)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in tree_rules(tree)))
    if not rules:
        share = min(max(good / total, 1e-6), 1 - 1e-6)
        return RuleModel((), (), math.log(share / (1 - share)))
    tested = points.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("rules"))
    fitted = LogisticRegression(
        labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False
    ).fit(tested)
    chosen = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w]
    return RuleModel(tuple(r for r, _ in chosen), tuple(w for _, w in chosen), float(fitted.intercept))


def quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, score) per input row, scored by built-in expressions over the whole text.

    Null and empty texts are scored by the statistics of an empty text. Repeated rows get equal
    scores; an empty table gives no rows; other columns are ignored.
    """
    return statistics(docs.select("doc_id", "text")).select("doc_id", model.score().alias("score"))
