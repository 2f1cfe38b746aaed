"""URL filter: rules for hosts and paths first, a ratio of two character models for the rest. DataFrame functions only.

A URL is spelled in 32 symbols: the letters, one symbol for all digits, ``/``, ``.``, ``-``, one for everything else, and one that marks
both ends. A run of four symbols, a gram, is a 20-bit number. URLs that a rule accepts or rejects train one Markov model each: grams are
counted over all of them, and the counts of shorter runs are sums over the grams. The chance of a symbol is taken from the longest
context that was seen often enough, each order smoothed by the next shorter one. The score of a URL is the mean, over its symbols, of the
logarithm of accepted over rejected chance. A part of the judged URLs, kept out of training, calibrates the score up to which a URL
is blocked. Logarithms are whole thousandths, so sums do not depend on their order.

There are at most 2^20 grams, which bounds the table that is sent to the tasks; URLs themselves are shuffled once, as (row, sum).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from codeloom.functions.binding import bind
from codeloom.settings import materialize

#: A context counts if a model has met it at least so often; the next shorter order weighs as much as so many symbols.
MIN_SEEN = 2
STRENGTH = 4.0
#: Share of accepted URLs, of those kept out of training, that the cut may block, in percent.
MAX_FALSE_PERCENT = 5
#: URLs whose md5 begins with one of these digits calibrate and do not train.
CALIBRATION_DIGITS = "012"

_SYMBOLS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII 0x60 to 0x7F in order: the end mark, 26 letters, digits, slash, dot, hyphen, everything else.
_END, _DIGIT, _SLASH, _DOT, _HYPHEN, _OTHER = "`", "{", "|", "}", "~", "\x7f"


class Rule(NamedTuple):
    """``verdict`` for the paths under ``path`` of ``host`` and all its subdomains."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    return bind(F.instr(url, "://"), lambda at: F.when(at > 0, F.substr(url, at + 3)))


def host_of(url: Column) -> Column:
    """Lower-cased host, with port and user if it names them; empty for a null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first in the alphabet."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.verdict))
    table = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in ordered])
    fits = F.filter(table, lambda r: ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first.rule.alias("rule"), first.verdict.alias("verdict")))


def spelled(url: Column) -> Column:
    """The URL without its scheme, in letters 0x61 to 0x7F."""
    text = ascii_lower(F.coalesce(_after_scheme(url), url, F.lit("")))
    return F.translate(F.regexp_replace(text, "[^a-z0-9/.-]", _OTHER), "0123456789/.-", _DIGIT * 10 + _SLASH + _DOT + _HYPHEN)


def grams(spelling: Column) -> Column:
    """One number for each symbol and for the end: the symbol after its three predecessors, five bits each."""
    codes = F.transform(F.split(F.concat(F.lit(_END * 3), spelling, F.lit(_END)), ""), lambda c: F.ascii(c) - 0x60)

    def windows(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(3), F.size(c) - 1), lambda i: ((F.get(c, i - 3) * 32 + F.get(c, i - 2)) * 32 + F.get(c, i - 1)) * 32 + F.get(c, i))

    return bind(codes, windows)


def judged_by_rules(pages: DataFrame, rules: list[Rule], id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path, rule, ruled, part, spelling, row) of every row; ``part`` is train or calibrate."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    kept_out = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1).isin(*CALIBRATION_DIGITS)
    return found.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"),
        F.when(kept_out, "calibrate").otherwise("train").alias("part"), spelled(F.col("url")).alias("spelling"), F.monotonically_increasing_id().alias("row"),
    )


def gram_counts(judged: DataFrame) -> DataFrame:
    """(gram, allow, block): how often each gram of any URL stands in accepted and rejected training URLs; 2^20 rows at most."""

    def counted(verdict: str) -> Column:
        return F.sum(F.when((F.col("part") == "train") & (F.col("ruled") == verdict), 1).otherwise(0)).alias(verdict)

    return judged.select("part", "ruled", F.explode(grams(F.col("spelling"))).alias("gram")).groupBy("gram").agg(counted("allow"), counted("block"))


def gram_gains(counts: DataFrame) -> DataFrame:
    """(gram, gain): thousandths of the logarithm of accepted over rejected chance of the last symbol, rounded down.

    Orders 0 to 3: a symbol's chance after a context seen at least ``MIN_SEEN`` times is (count + STRENGTH * chance in the next
    shorter order) / (count of the context + STRENGTH); after any other context it is that of the shorter order.
    """
    gram, before = F.col("gram"), F.shiftright("gram", 5)
    totals = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()

    def total(verdict: str, *key: Column) -> Column:
        return F.sum(verdict).over(Win.partitionBy(*key)).cast("double")

    runs = counts
    for verdict in ("allow", "block"):
        runs = runs.withColumns(
            {f"{verdict}_{size}": total(verdict, gram % (1 << 5 * size)) for size in (1, 2, 3)} | {f"{verdict}_4": F.col(verdict).cast("double")}
            | {f"{verdict}_after_{size}": total(verdict, before % (1 << 5 * size)) for size in (1, 2, 3)}
        )
    for verdict in ("allow", "block"):
        runs = runs.withColumn("chance", (F.col(f"{verdict}_1") + 1.0) / (float(totals[verdict] or 0) + _SYMBOLS))
        for size in (1, 2, 3):
            seen = F.col(f"{verdict}_after_{size}")
            longer = (F.col(f"{verdict}_{size + 1}") + STRENGTH * F.col("chance")) / (seen + STRENGTH)
            runs = runs.withColumn("chance", F.when(seen >= MIN_SEEN, longer).otherwise(F.col("chance")))
        runs = runs.withColumnRenamed("chance", f"{verdict}_chance")
    return runs.select("gram", F.floor(1000 * F.log(F.col("allow_chance") / F.col("block_chance"))).alias("gain"))


def with_scores(judged: DataFrame, gains: DataFrame) -> DataFrame:
    """``judged`` without spelling and number, with ``score``: the floored mean gain of a URL's grams (0 for an empty URL)."""
    own = [c for c in judged.columns if c not in ("spelling", "row")]
    each = judged.select(*own, "row", (F.length("spelling") > 0).alias("filled"), F.explode(grams(F.col("spelling"))).alias("gram"))
    # At most 2^20 rows of two numbers.
    summed = each.join(F.broadcast(gains), "gram").groupBy("row", "filled", *own).agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))
    return summed.select(*own, "filled", F.when(F.col("filled"), F.floor(F.col("gain") / F.col("n"))).otherwise(0).alias("score"))


def calibrated_cut(scored: DataFrame, max_false_percent: int = MAX_FALSE_PERCENT) -> int | None:
    """The score up to which URLs are blocked: where the blocked share of the rejected URLs kept out of training exceeds that of the accepted
    ones by most, among the scores that block at most ``max_false_percent`` percent of the accepted ones; the lowest of equally good ones.

    None without such URLs of both kinds. Scores are whole thousandths of a logarithm, so their histogram has a bounded number of rows.
    """
    known = scored.filter("part = 'calibrate' AND ruled IS NOT NULL")
    counts = known.groupBy("score").agg(*[F.sum((F.col("ruled") == v).cast("bigint")).alias(v) for v in ("allow", "block")])
    up_to, every = Win.orderBy("score").rowsBetween(Win.unboundedPreceding, 0), Win.partitionBy()
    sums = counts.select("score", *[F.sum(v).over(w).alias(f"{v}{name}") for v in ("allow", "block") for name, w in (("", up_to), ("_all", every))])
    gap = F.expr("CAST(block AS DECIMAL(19)) * allow_all - CAST(allow AS DECIMAL(19)) * block_all")
    good = sums.filter(100 * F.col("allow") <= max_false_percent * F.col("allow_all")).filter(gap > 0)
    best = good.orderBy(gap.desc(), "score").select("score").first()
    return best.score if best else None


def filter_urls(
    pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", max_false_percent: int = MAX_FALSE_PERCENT
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block), score (null where no model could be made).

    A rule decides where one fits. Other URLs are blocked if their score is not above the calibrated cut. A null or empty URL, and
    every URL without a rule where accepted or rejected training URLs are lacking, is allowed. Repeated rows and null ids
    are rows like others. Other columns are not read.
    """
    judged = judged_by_rules(pages, RULES if rules is None else rules, id_col, url_col)
    counts = materialize(gram_counts(judged), "grams")
    trained = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if not trained.allow or not trained.block:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("bigint").alias("score"))
    scored = materialize(with_scores(judged, materialize(gram_gains(counts), "gains")), "scored")
    blocked = F.col("filled") & (F.col("score") <= F.lit(calibrated_cut(scored, max_false_percent)).cast("bigint"))
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
