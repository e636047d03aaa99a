"""Operator 3: URL filters, in DataFrame functions only.

A rule list decides first, by host suffix and path prefix. What no rule fits is judged by a logistic
regression on hashed character n-grams of host and path. It is trained from a small labelled table in
its dual form: the Gram matrix of the training URLs is one small row, on which gradient descent runs as
a fold; the weights follow by joining the dual coefficients back to the n-grams."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4, 5)
DIMENSIONS = 1 << 15
STEPS, RATE, PENALTY = 300, 0.5, 0.01
#: The Gram matrix of the training table is one row; this bounds it.
MOST_LABELLED = 400

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A small labelled table: unwanted kinds of host, and ordinary ones on the same kinds of path.
_UNWANTED = (
    "casino-win", "casino-royal", "win-casino", "free-bets", "best-bets", "bets-online", "cheap-pills", "pills-shop", "buy-pills",
    "adult-x", "adult-cams", "xxx-adult", "spam-farm", "link-farm", "spam-links", "ads-track", "track-ads", "ads-click", "free-casino", "poker-win",
)
_WANTED = (
    "library", "news", "garden", "motion", "weather", "station", "shipping", "university", "thelast", "other", "heating", "nation",
    "theories", "reading", "answer", "thinking", "edition", "friendly", "museum", "brother", "landing", "orchard", "wholesale", "stable",
)
_FRONT = ("", "www.", "blog.", "m.")
_PLACES = ("example.com/en/", "example.org/de/", "example.net/fr/", "example.com/es/")
_TAILS = ("104", "277.html", "83/", "615?page=2&ref=x", "492#top", "738?utm_source=feed")


def labelled_urls() -> list[tuple[str, str]]:
    """``(url, verdict)`` rows of the default training table."""
    rows = []
    for verdict, names in (("block", _UNWANTED), ("allow", _WANTED)):
        for i, name in enumerate(names):
            for j in range(3):
                k = i + 2 * j
                rows.append((f"https://{_FRONT[k % 4]}{name}.{_PLACES[(k + j) % 4]}{_TAILS[k % 6]}", verdict))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as ``struct(length, rule, verdict)``; null if none does. Of two rules
    of one length the one later in the alphabet wins; the same rule twice blocks if one of them does."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    listed = F.array(*[
        F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit("." + h).alias("host"), F.lit(p).alias("path"))
        for h, p, v in rules
    ])
    fits = F.filter(listed, lambda r: F.endswith(F.concat(F.lit("."), host), r["host"]) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def ngrams(host: Column, path: Column) -> Column:
    """Distinct hash indices of the character n-grams of host and path, each with marked ends."""

    def of(text: Column, mark: str, size: int) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        chars = F.filter(chars, lambda c: c != "")
        starts = F.when(F.size(chars) >= size, F.sequence(F.lit(0), F.size(chars) - size)).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]))
        return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(DIMENSIONS)).cast("int"))

    return F.array_distinct(F.flatten(F.array(*[of(text, mark, size) for text, mark in ((host, "h"), (path, "p")) for size in SIZES])))


def train(labelled: DataFrame) -> list[float]:
    """Weights by hash index, the intercept last, from ``(url, verdict)`` with at most
    ``MOST_LABELLED`` rows. Rows without a verdict of ``block`` or ``allow`` take no part; from no rows
    come zero weights."""
    host, path = host_and_path(F.col("url"))
    rows = (
        labelled.where(F.col("verdict").isin("block", "allow"))
        .select(F.col("url").alias("_u"), F.col("verdict").alias("_v"), ngrams(host, path).alias("grams"))
        .groupBy("_u", "_v", "grams").agg(F.count("*").alias("_n"))
        .orderBy(F.xxhash64("_u", "_v")).limit(MOST_LABELLED)
        .select(F.array_sort(F.collect_list(F.struct("_u", "_v", "grams", "_n")).over(_all())).alias("all"), F.row_number().over(_ordered()).alias("i"))
        .where("i = 1")
    )
    # Gram matrix of unit vectors, plus one for the intercept.
    gram = F.transform("all", lambda a: F.transform("all", lambda b: F.size(F.array_intersect(a["grams"], b["grams"])) / F.sqrt(F.size(a["grams"]) * F.size(b["grams"])) + 1.0))
    one = rows.select("all", gram.alias("gram"), F.transform("all", lambda a: F.when(a["_v"] == "block", 1.0).otherwise(0.0)).alias("y"))
    started = F.transform("y", lambda _: F.lit(0.0))

    def step(alpha: Column, _: Column) -> Column:
        def moved(target: Column, k: Column) -> Column:
            margin = F.aggregate(F.zip_with(alpha, F.get("gram", k), lambda a, g: a * g), F.lit(0.0), lambda s, x: s + x)
            return F.get(alpha, k) * (1 - RATE * PENALTY) + RATE * (target - 1 / (1 + F.exp(-margin)))

        return F.transform("y", moved)

    fitted = one.select("all", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), started, step).alias("alpha"))
    parts = fitted.select(F.explode(F.arrays_zip("all", "alpha")).alias("x"))
    weights = (
        parts.select("x.alpha", (F.col("x.alpha") / F.sqrt(F.size("x.all.grams"))).alias("share"), F.explode(F.concat("x.all.grams", F.array(F.lit(DIMENSIONS)))).alias("index"))
        .groupBy("index").agg(F.sum(F.when(F.col("index") == DIMENSIONS, F.col("alpha")).otherwise(F.col("share"))).alias("weight"))
    )
    vector = [0.0] * (DIMENSIONS + 1)
    for row in weights.collect():  # at most DIMENSIONS + 1 rows
        vector[row["index"]] = row["weight"]
    return vector


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def _ordered():
    return _all().orderBy("_u", "_v")


def block_probability(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability that a url is unwanted; without n-grams that of the intercept alone."""
    used = {i: w for i, w in enumerate(weights[:-1]) if w}
    vector = F.from_json(F.lit(json.dumps([used.get(i, 0.0) for i in range(DIMENSIONS)])), "array<double>")
    grams = ngrams(host, path)
    total = F.aggregate(grams, F.lit(0.0), lambda s, i: s + F.get(vector, i))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(grams), F.lit(1))) + F.lit(weights[-1]))))


def local_table(spark: SparkSession, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """A small literal table ``(url, verdict)``."""
    none = spark.range(0).select(F.lit("").alias("url"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(v).alias("verdict")) for u, v in rows]))) if rows else none


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, probability`` of every row of ``pages(page_id, url)``.

    A null url, or one without ``://``, has an empty host and path; no default rule fits it and the
    model judges what is empty. Repeated rows and rows without an id are judged each. Other columns are
    dropped, so none can clash. The work per row is linear in the url."""
    weights = train(labelled)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parts.select(
        "page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("_best"),
        block_probability(F.col("host"), F.col("path"), weights).alias("probability"),
    )
    return judged.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.when(F.col("probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "probability",
    )
