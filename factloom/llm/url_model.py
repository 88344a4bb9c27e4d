"""URL filters: host rules, then the ratio of two character models, in built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, UPPER, stored

#: The models predict a character from up to ORDER - 1 characters before it.
ORDER = 5
START, END = "\x02", "\x03"
#: Log-likelihood ratios are kept as whole millionths, so sums do not depend on their order.
MICRO = 1_000_000
#: Scores are calibrated on a grid of so many steps to each side of 0, STEP wide.
GRID, STEP = 1000, 0.01


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for text without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """The longest rule's name or verdict; null where none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, what))).otherwise(out)
    return out


def grams(text: Column) -> Column:
    """Windows of ORDER characters, one for each character and one for the end."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def gram_ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio): log of the rejected over the accepted model's probability, in millionths.

    ``counted`` has (gram, accepted, rejected) counts. The models interpolate all orders: in a context
    seen n times with t different next characters, the shorter context's model weighs t / (n + t);
    below the single character all 65,536 are alike.
    """
    lower = None
    for k in range(1, ORDER + 1):
        table = counted.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(
            F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
        )
        table = table.withColumn("context", F.left("gram", F.lit(k - 1)))
        sums = table.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_n") for c in ("accepted", "rejected")],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_t") for c in ("accepted", "rejected")],
        )
        table = table.join(sums, "context")
        if lower is None:
            table = table.withColumn("accepted_p", F.lit(1 / 65536)).withColumn("rejected_p", F.lit(1 / 65536))
        else:
            table = table.withColumn("shorter", F.right("gram", F.lit(k - 1))).join(lower, "shorter")
        for c in ("accepted", "rejected"):
            n, t = F.col(f"{c}_n"), F.col(f"{c}_t")
            p = (F.col(c) + t * F.col(f"{c}_p")) / F.greatest(n + t, F.lit(1))
            table = table.withColumn(f"{c}_p", F.when(n > 0, p).otherwise(F.col(f"{c}_p")))
        lower = stored(table.select(F.col("gram").alias("shorter"), "accepted_p", "rejected_p"), f"model-{k}")
    ratio = F.round(F.log(F.col("rejected_p") / F.col("accepted_p")) * MICRO).cast("long")
    return lower.select(F.col("shorter").alias("gram"), ratio.alias("ratio"))


def calibrated_step(scored: DataFrame) -> int:
    """The grid step above which most rejected and fewest accepted URLs lie; the highest of equal ones.

    Reads a histogram of at most 2 * GRID + 1 rows. Without examples of both kinds it is the last step.
    """
    steps = scored.where("verdict IS NOT NULL").groupBy("step").agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("rejected"),
    )
    rows = sorted(steps.collect(), key=lambda r: r.step)
    accepted, rejected = sum(r.accepted for r in rows), sum(r.rejected for r in rows)
    if not accepted or not rejected:
        return GRID
    best, at, above_a, above_r = 0, GRID, 0, 0
    for i in range(len(rows) - 1, 0, -1):
        above_a += rows[i].accepted
        above_r += rows[i].rejected
        gain = above_r * accepted - above_a * rejected
        if gain > best:
            best, at = gain, rows[i].step - 1
    return at


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    URLs that a rule fits get its verdict and teach two models of the characters of host and path,
    one of accepted and one of rejected URLs, from all of them. The others are blocked when their
    log-likelihood difference per character lies above the calibrated step. A null URL, or one
    without ``://``, is judged as an empty one. Repeated rows are judged alike; an empty table gives
    no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.select(
        "*", rule_of(F.col("host"), F.col("path"), rules, "name").alias("rule"),
        rule_of(F.col("host"), F.col("path"), rules, "verdict").alias("verdict"),
    )
    # Different texts are counted and scored once, with how often each occurs.
    texts = ruled.groupBy(F.concat("host", "path").alias("text"), "verdict").agg(F.count(F.lit(1)).alias("n"))
    texts = stored(texts, "url-texts")
    windows = texts.select("text", "verdict", "n", F.explode(grams(F.col("text"))).alias("gram"))
    counted = windows.groupBy("gram").agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("rejected"),
    )
    ratios = stored(gram_ratios(stored(counted, "url-grams")), "url-ratios")
    scored = windows.join(ratios, "gram").groupBy("text", "verdict", "n").agg(
        F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("length")
    )
    step = F.floor(F.col("ratio") / (F.col("length") * int(MICRO * STEP)))
    scored = stored(
        scored.select("text", "verdict", "n", (F.col("ratio") / (F.col("length") * MICRO)).alias("score"),
                      F.greatest(F.lit(-GRID), F.least(F.lit(GRID), step)).cast("int").alias("step")),
        "url-scores",
    )
    limit = calibrated_step(scored)
    verdicts = scored.where("verdict IS NULL").select(
        F.col("text").alias("_text"), "score", F.when(F.col("step") > limit, "block").otherwise("allow").alias("judged")
    )
    verdicts = stored(verdicts, "url-verdicts")
    rows = ruled.withColumn("_key", F.when(F.col("verdict").isNull(), F.concat("host", "path")))
    joined = rows.join(verdicts, F.col("_key") == F.col("_text"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", "judged").alias("verdict"), "score")
