"""Quality rules: text statistics and a learned decision list, all as Spark expressions.

The statistics are DataFrame functions over whole texts.  The list is learned by sequential covering: a conjunction of thresholds is
grown on two thirds of the labelled statistics by information gain, pruned back on the rest, kept if it is precise there, and
what it covers is taken away before the next one is grown.  The result is an ordered list of readable rules that becomes one
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import WORD, text_of

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_sentences"]


def _chars_in(text: Column, chars: str) -> Column:
    bare = text
    for c in chars:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.length(text) - F.length(bare)


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, computed here: no later filter or lambda gets their expressions copied into it."""
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_now")).select(*keep, "_now.*")


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and the counts of ``COUNTS`` (bigint) for every whole text.

    Words are runs of anything but ASCII white space.  A null text counts as empty: every count is zero.  Columns of the
    input named like a count are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    text = text_of(text_col)
    cut = _once(docs, keep, _text=text, _words=F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _lines=F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)))
    n = F.size("_words")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
    ))
    ranked = _once(cut, [*keep, "_text", "_words", "_lines"], _windows=F.sort_array(windows))
    twice = F.filter("_windows", lambda x, k: F.get(F.col("_windows"), k + 1)["h"].eqNullSafe(x["h"]) | F.get(F.col("_windows"), k - 1)["h"].eqNullSafe(x["h"]))
    repeated = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    t = F.col("_text")
    counts = {
        "n_words": n, "word_chars": F.length(F.array_join("_words", "")), "n_symbols": _chars_in(t, SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": F.when(n >= 3, F.size(repeated)).otherwise(0),
        "n_lines": F.size("_lines"), "n_distinct_words": F.size(F.array_distinct("_words")),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", "")), "n_digits": F.length(t) - F.length(F.regexp_replace(t, "[0-9]+", "")),
        "n_marks": _chars_in(t, "!?"), "n_sentences": _chars_in(t, ".!?"),
    }
    return _once(ranked, keep, **{name: c.cast("bigint") for name, c in counts.items()})


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios of the counts, by name; a text without words has zeros."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"), "upper_per_char": share("n_upper", "word_chars"), "digits_per_char": share("n_digits", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"), "sentences_per_word": share("n_sentences", "n_words"), "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Test:
    """``feature >= bound`` or ``feature < bound``."""

    feature: str
    at_least: bool
    bound: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return columns[self.feature] >= self.bound if self.at_least else columns[self.feature] < self.bound

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= F.lit(self.bound) if self.at_least else value < F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.bound:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, else the text is kept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def rejects(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            test = rule[0].column()
            for part in rule[1:]:
                test = test & part.column()
            out = F.when(test, F.lit(True)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, rule)) for rule in self.rules), "else keep"])


def _covered(rule, columns, among: np.ndarray) -> np.ndarray:
    hit = among.copy()
    for test in rule:
        hit &= test.holds(columns)
    return hit


def _grow(columns, bad: np.ndarray, rows: np.ndarray, cuts, most_tests: int) -> tuple[Test, ...]:
    rule: tuple[Test, ...] = ()
    while len(rule) < most_tests:
        p0, n0 = int((rows & bad).sum()), int((rows & ~bad).sum())
        if not n0 or not p0:
            break
        base, best, gain = math.log2(p0 / (p0 + n0)), None, 1e-9
        for name, bounds in cuts.items():
            values = columns[name]
            p_below = np.searchsorted(np.sort(values[rows & bad]), bounds, "left")
            n_below = np.searchsorted(np.sort(values[rows & ~bad]), bounds, "left")
            for at_least, p, n in ((False, p_below, n_below), (True, p0 - p_below, n0 - n_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
                at = int(np.argmax(g))
                if g[at] > gain:
                    gain, best = float(g[at]), Test(name, at_least, float(bounds[at]))
        if best is None:
            break
        rule, rows = (*rule, best), rows & best.holds(columns)
    return rule


def learn_list(columns: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 5, most_rules: int = 24, most_tests: int = 5) -> DecisionList:
    """Sequential covering over labelled statistics; rows are taken in the order given, every third one for pruning.

    A rule stays if at least ``least`` rows of its pruning rows are bad and their share among those it covers is ``precision`` or more.
    """
    found, n = DecisionList(), len(bad)
    prune = np.arange(n) % 3 == 2
    cuts = {}
    for name, values in columns.items():
        seen = np.unique(values)
        middle = (seen[1:] + seen[:-1]) / 2
        cuts[name] = middle if len(middle) <= 256 else np.unique(np.quantile(middle, np.linspace(0, 1, 256)))
    cuts = {k: v for k, v in cuts.items() if len(v)}
    rest = np.ones(n, bool)
    while len(found.rules) < most_rules and cuts:
        rule = _grow(columns, bad, rest & ~prune, cuts, most_tests)
        if not rule:
            break

        def worth(r):
            hit = _covered(r, columns, rest & prune)
            p = int((hit & bad).sum())
            return (2 * p - int(hit.sum())) / max(1, int(hit.sum())), p

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        value, p = worth(rule)
        if p < least or (value + 1) / 2 < precision:
            break
        found.rules.append(rule)
        rest &= ~_covered(rule, columns, rest)
    return found


def fit_list(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8192, **options) -> DecisionList:
    """Learn a list from at most ``sample_rows`` labelled rows (those whose ids hash lowest); label 0 is bad.

    Rows without a label are left out.  Without labels, or with labels of one kind only, the list is empty and keeps everything.
    """
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = chosen.orderBy(order, id_col).limit(sample_rows)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(chosen), id_col)  # sample_rows rows at most
    stats = with_statistics(texts, "_t", [id_col, "_label"])
    parts = features()
    rows = stats.select(order.alias("_o"), F.col("_label"), *[c.alias(k) for k, c in parts.items()]).where(~base_failed()).orderBy("_o", *parts).limit(sample_rows).collect()
    columns = {k: np.array([r[k] for r in rows], float) for k in parts}
    return learn_list(columns, np.array([r["_label"] == 0 for r in rows], bool), **options)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to every row; null and empty texts fail."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base_failed", "kept")]
    stats = with_statistics(docs, text_col, keep)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rules.rejects())
