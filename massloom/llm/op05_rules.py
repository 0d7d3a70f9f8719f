"""Quality rules as a learned decision list, in DataFrame functions throughout.

Text statistics are column expressions. From labelled documents' statistics,
sequential covering learns an ordered list of conjunctions of thresholds: the rows that pass the base checks are learned from, so a rule says what those
miss. Each rule is grown on two thirds of the rows still uncovered (the threshold with the
best information gain at each step), pruned on the other third (conditions go
from the end while that helps), and kept while it is precise there. The list
becomes one ``CASE WHEN`` over the statistics, readable as it stands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import GAP, one_row_each, smallest_hashed
from massloom.plans.store import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Labelled documents that rules are learned from, at most (those of the smallest hashed ids).
MAX_LABELLED = 20_000
#: A rule must be this precise on the rows that it is pruned on, and cover so many.
PRECISION, SUPPORT, MAX_RULES, MAX_CONDITIONS = 0.9, 8, 12, 3

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule features by name, as SQL over the statistics.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
}


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep`` and the statistics of each row's whole text.

    A null text has no words and all counts are 0. ``n_repeat_words`` counts
    the words under an 8-word window that occurs twice or more in the text,
    the first occurrence included; ``n_dup_lines`` the lines with a word that
    equal an earlier line.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("text"))
    worded = base.select(
        "doc_id",
        *keep,
        F.filter(F.split("text", GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.length("text").alias("chars"),
        F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        F.length(without(F.col("text"), SYMBOLS)).alias("plain"),
        F.length(without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("not_upper"),
        F.length(without(F.col("text"), "0123456789")).alias("not_digit"),
        F.length(without(F.col("text"), ".!?")).alias("not_stop"),
    )
    # a window that occurs twice puts WINDOW words behind an earlier one of the same kind
    repeated = F.size("words") - F.size(F.array_distinct("words")) >= WINDOW
    hashed = worded.withColumn("coded", F.when(repeated, F.transform("words", lambda w: F.xxhash64(w))))
    windows = F.transform(F.sequence(F.lit(0), F.size("coded") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("coded"), i + j) for j in range(WINDOW)]))
    counted = hashed.select(
        "doc_id",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        "word_chars",
        (F.col("chars") - F.col("plain")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.col("chars") - F.col("not_upper")).cast("long").alias("n_upper"),
        (F.col("chars") - F.col("not_digit")).cast("long").alias("n_digits"),
        (F.col("chars") - F.col("not_stop")).cast("long").alias("n_stops"),
        F.when(F.col("coded").isNotNull(), windows).alias("hashes"),
    )
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    paired = F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = counted.select(*[c for c in counted.columns if c != "hashes"], paired.alias("p"))
    at = lambda j: F.get(F.col("p"), j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda j: at(j).eqNullSafe(at(j + 1)) | at(j).eqNullSafe(at(j - 1)))
    starts = F.transform(twice, lambda j: F.get(F.col("p"), j)["i"])
    under = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + (WINDOW - 1))))))
    return ordered.select(*[c for c in ordered.columns if c != "p"], F.when(F.col("p").isNotNull(), under).otherwise(0).cast("long").alias("n_repeat_words"))


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold): feature > threshold, or <=."""

    conditions: list[tuple[str, bool, float]]

    def column(self) -> Column:
        out = None
        for name, above, t in self.conditions:
            value = F.expr(FEATURES[name])
            c = value > F.lit(t) if above else value <= F.lit(t)
            out = c if out is None else out & c
        return out

    def covers(self, x: np.ndarray, names: list[str], upto: int | None = None) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, t in self.conditions[:upto]:
            v = x[:, names.index(name)]
            out &= v > t if above else v <= t
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.4g}" for n, a, t in self.conditions)


def best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, tuple[str, bool, float]] | None:
    """The threshold with the best gain for the bad rows among the rows given."""
    pos, n = bad.sum(), len(bad)
    best = None
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, p = x[order, k], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        low_p, low_n = p[cut], cut + 1.0
        for above, hits, size in ((False, low_p, low_n), (True, pos - low_p, n - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hits > 0, hits * (np.log2(hits / size) - np.log2(pos / n)), -1)
            i = int(np.argmax(gain))
            if best is None or gain[i] > best[0]:
                best = (float(gain[i]), (name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best if best and best[0] > 0 else None


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """Sequential covering: rules for the bad rows, in order."""
    rules, left = [], np.ones(len(x), dtype=bool)
    grow_part = np.arange(len(x)) % 3 != 0
    while len(rules) < MAX_RULES:
        grow, prune = left & grow_part, left & ~grow_part
        if bad[grow].sum() < SUPPORT:
            break
        rule, inside = Rule([]), grow.copy()
        while len(rule.conditions) < MAX_CONDITIONS and bad[inside].sum() < inside.sum():
            found = best_condition(x[inside], bad[inside], names)
            if not found:
                break
            rule.conditions.append(found[1])
            inside = grow & rule.covers(x, names)
        worth = []
        for upto in range(1, len(rule.conditions) + 1):
            c = prune & rule.covers(x, names, upto)
            p, n = int(bad[c].sum()), int((~bad[c]).sum())
            worth.append(((p - n) / max(1, p + n), p, upto))
        worth = [w for w in worth if w[1]]
        if not worth:
            break
        value, hits, upto = max(worth, key=lambda w: (round(w[0], 3), w[1], -w[2]))
        rule.conditions = rule.conditions[:upto]
        covered = left & rule.covers(x, names)
        if (value + 1) / 2 < PRECISION or bad[covered].sum() < SUPPORT or bad[covered].sum() < PRECISION * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """The number of the first rule that fits a row, or null: one CASE WHEN."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(k)).otherwise(out)
    return out


def labelled_statistics(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(features, whether bad, feature names) of at most ``most`` labelled ids, in hashed order; an id of several rows gives one."""
    names = list(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = smallest_hashed(known, most, "doc_id", "quality")
    known = known.dropDuplicates()
    named = stats.select("doc_id", *[F.expr(c).alias(n) for n, c in FEATURES.items()]).join(known.select("doc_id").distinct(), "doc_id")
    rows = one_row_each(named, "doc_id", *names).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *names).collect()
    return np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(-1, len(names)), np.array([r.quality == 0 for r in rows], dtype=bool), names


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, statistics, base_failed, rule, kept) for each row of ``docs``, and the rules.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated
    windows. ``rule`` is the learned rule that fits, counted from 0, else null;
    a row is kept if neither speaks against it. Rows with null or empty texts
    fail the base. Labels of null, of ids that no document has, and repeated
    labels are harmless; without labels no rule is learned. Repeated rows are
    judged each for itself; thresholds lie halfway between the values that they
    part, so ties fall on one side. Extra columns are not read, whatever their
    names. Very long texts are judged whole: their words and window hashes are
    arrays in one row, about 30 bytes a word. An empty table gives no rows.
    """
    stats = materialize(text_statistics(docs), "rules-stats")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rules = learn_rules(*labelled_statistics(stats.filter(~failed), labels))
    out = stats.withColumn("base_failed", failed).withColumn("rule", decision_list(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; nulls, long texts and repeats as in :func:`judge`."""
    out, _ = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept")
