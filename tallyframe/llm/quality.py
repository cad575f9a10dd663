"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base counts of a text are taken with array functions inside its row. A rule compares one ratio of them with a cutoff. For each
stratum and rule, cutoffs are tried from the mildest on against labelled rows: a cutoff stands if the exact binomial
probability of seeing so few good rows rejected, were the true rate of false rejection `risk / rules`, is at most
`error / (strata * rules)`. The first that fails ends the sequence (fixed-sequence testing inside a rule, Bonferroni's
correction over rules and strata), so with probability 1 - error no stratum rejects more than `risk` of its good rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, without

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: rule -> (its ratio, cutoffs from the mildest on); a row fails where the ratio is above the cutoff.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.40, 0.30, 0.20, 0.15, 0.10, 0.05)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.80, 0.60, 0.40, 0.30, 0.20)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.80, 0.60, 0.40, 0.30, 0.20)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 25.0, 16.0, 12.0, 10.0)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.90, 0.70, 0.50, 0.30)),
    "exclamation": ("n_exclamations / greatest(n_words, 1)", (0.90, 0.60, 0.40, 0.20)),
}
#: Strata that are broadcast with their cutoffs; with more, the cutoffs are joined by Spark's choice.
FEW_STRATA = 10_000


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and with n_lines, n_capitals, n_exclamations.

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none, like an empty one. word_chars: code points in words. n_symbols:
    characters of `#*$%&|<>`. n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in 5-word
    windows that occur at least twice in the text (windows are compared by a 64-bit hash of their words).
    """
    base = without(docs, [*BASE, "n_lines", "n_capitals", "n_exclamations"])
    t = F.coalesce(F.col(text), F.lit(""))

    # each level of columns is used more than once by the next, so that Spark computes it once
    rows = base.withColumns({
        "_words": F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "n_capitals": F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).cast("long"),
        "n_exclamations": F.length(F.regexp_replace(t, "[^!]+", "")).cast("long"),
    })
    n = F.size("_words")
    window = F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(5)]))
    rows = rows.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < 5, F.array().cast("array<bigint>")).otherwise(window).alias("_hashes"),
    ).drop("_words", "_lines")
    placed = F.zip_with("_hashes", F.sequence(F.lit(0), F.greatest(F.size("_hashes") - 1, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.select("*", F.when(repeats, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_windows")).drop("_hashes")
    k = F.size("_windows")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    # a window equals its neighbour in sorted order if it occurs twice; their places, in order, cover runs of words
    before = F.concat(none, F.slice("_windows", F.lit(1), F.greatest(k - 1, F.lit(0))))
    after = F.concat(F.slice("_windows", F.lit(2), F.greatest(k - 1, F.lit(0))), none)
    marked = F.zip_with(F.zip_with("_windows", before, lambda w, b: F.struct(w.alias("w"), F.coalesce(b["h"] == w["h"], F.lit(False)).alias("same"))), after, lambda x, a: F.when(x["same"] | F.coalesce(a["h"] == x["w"]["h"], F.lit(False)), x["w"]["i"]))
    places = F.when(k > 1, F.sort_array(F.array_compact(marked))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", places.alias("_places")).drop("_windows")
    m = F.size("_places")
    following = F.slice("_places", F.lit(2), F.greatest(m - 1, F.lit(1)))
    covered = F.aggregate(F.zip_with("_places", following, lambda p, q: F.least(F.lit(5), F.coalesce(q - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.when(m > 0, covered).otherwise(0).cast("long")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series ten steps up, and back down."""
    y = x + 10
    down = F.log(reduce(lambda a, i: a * (x + i), range(1, 10), x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n and p: the term of k times the sum of the terms below it relative to it; from the mean
    on, one less the same of the terms above. Terms farther than ten standard deviations do not count, so that there are
    about as many as the root of n, never k."""
    k, n, q = k.cast("double"), n.cast("double"), 1 - p
    far = F.ceil(10 * F.sqrt(n * p * q)) + 50

    def series(at: Column, most: Column, ratio) -> Column:
        term = F.exp(_log_gamma(n + 1) - _log_gamma(at + 1) - _log_gamma(n - at + 1) + at * math.log(p) + (n - at) * math.log(q))
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def step(s: Column, j: Column) -> Column:
            now = s["term"] * ratio(j.cast("double"))
            return F.struct(now.alias("term"), (s["total"] + now).alias("total"))

        steps = F.sequence(F.lit(0).cast("long"), F.least(most, far).cast("long"))
        return term * F.aggregate(F.filter(steps, lambda j: j > 0), start, step, lambda s: s["total"])

    below = series(k, k, lambda j: (k - j + 1) * q / ((n - k + j) * p))
    above = series(k + 1, n - k - 1, lambda j: (n - k - j) * p / ((k + 1 + j) * q))
    return F.when(k >= n, F.lit(1.0)).when(k < 0, F.lit(0.0)).when(k < n * p, below).otherwise(1 - above)


def cutoffs(labelled: DataFrame, stratum: str = "stratum", label: str = "label", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoff of each rule that stands in each stratum.

    labelled has the columns of base_counts, a stratum and a label, 1 for good rows; rows that fail base_failed() and rows
    with another label are not used. A rule for which none stands, or that rejects no labelled bad row, is left out.
    """
    bad = labelled.where(~base_failed()).withColumn("good", F.col(label) == 1).where(F.col(label).isin(0, 1))
    ratios = bad.select(stratum, "good", *[F.expr(ratio).cast("double").alias(rule) for rule, (ratio, _) in RULES.items()])
    tallies = [F.sum(F.col("good").cast("long")).alias("n")]
    for rule, (_, levels) in RULES.items():
        for i, level in enumerate(levels):
            above = F.col(rule) > F.lit(level)
            tallies += [F.sum((above & F.col("good")).cast("long")).alias(f"g_{rule}_{i}"), F.sum((above & ~F.col("good")).cast("long")).alias(f"b_{rule}_{i}")]
    counts = ratios.groupBy(stratum).agg(*tallies)
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(level).alias("cutoff"), F.col(f"g_{rule}_{i}").alias("k"), F.col(f"b_{rule}_{i}").alias("caught")) for rule, (_, levels) in RULES.items() for i, level in enumerate(levels)])
    tests = counts.select(stratum, "n", F.explode(tests).alias("t")).select(stratum, "n", "t.*")
    strata = counts.agg(F.count("*").alias("strata"))
    tests = tests.crossJoin(F.broadcast(strata))  # one row
    passed = binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= F.lit(error) / (F.col("strata") * len(RULES))
    tests = tests.select(stratum, "rule", "i", "cutoff", "caught", passed.alias("passed"))
    runs = tests.groupBy(stratum, "rule").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("i"))), F.lit(1 << 20)).alias("stop"), F.array_sort(F.collect_list(F.struct("i", "cutoff", "caught"))).alias("t"))
    stands = F.filter("t", lambda x: (x["i"] < F.col("stop")) & (x["caught"] > 0))
    # a stricter cutoff that catches no more bad rows only costs good ones
    return runs.select(stratum, "rule", stands.alias("t"), F.array_max(F.transform(stands, lambda x: x["caught"])).alias("most")).where("most > 0").select(stratum, "rule", F.array_min(F.transform(F.filter("t", lambda x: x["caught"] == F.col("most")), lambda x: x["i"])).alias("i"), "t").select(stratum, "rule", F.filter("t", lambda x: x["i"] == F.col("i"))[0]["cutoff"].alias("cutoff"))


def _judged(docs: DataFrame, labels: DataFrame, text: str, key: str, stratum: str | None, label: str, risk: float, error: float, *carried) -> DataFrame:
    """_key, the columns that judge() adds and, if it is carried, the column _doc of the same row."""
    columns = [F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.col(stratum).cast("string") if stratum else F.lit(""), F.lit("")).alias("_stratum")]
    counted = materialize(base_counts(docs.select(*columns, *carried), "_text").drop("_text"), "quality")
    marks = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(F.col(label).isin(0, 1))
    table = cutoffs(counted.join(marks, "_key"), "_stratum", "_label", risk, error)
    table = materialize(table.groupBy("_stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_c_{rule}") for rule in RULES]), "cutoffs")
    table = F.broadcast(table) if table.count() <= FEW_STRATA else table
    rows = counted.join(table, "_stratum", "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(ratio) > F.col(f"_c_{rule}"), F.lit(rule)) for rule, (ratio, _) in RULES.items()]))
    rows = rows.select("_key", *BASE, "n_lines", base_failed().alias("base_failed"), failed.alias("failed_rules"), *(["_doc"] if carried else []))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str | None = "lang", label: str = "quality", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """key, the base counts, n_lines, base_failed, failed_rules (names of the rules that reject the row, in order) and kept;
    other columns of docs are left out. Whole texts are counted, however long; an empty table gives an empty one.

    The bound holds for good rows that pass the base rules: what base_failed rejects comes on top.
    labels (key, label) are the holdout: 1 good, 0 bad, other values unused. Null strata are one stratum, ''. A stratum without
    labelled rows, and every stratum without labels at all, has no rules beyond base_failed. Repeated rows are judged each by
    itself; a key with several labels counts with each.
    """
    return _judged(docs, labels, text, key, stratum, label, risk, error).withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str | None = "lang", label: str = "quality", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """docs that the rules keep; the columns stay as they are. Each row is judged by itself, whether its key is null,
    repeated or neither."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    return _judged(docs, labels, text, key, stratum, label, risk, error, whole).where("kept").select("_doc.*")
