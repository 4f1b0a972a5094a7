"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for was with this are be by on it as not or at from have an "
    "der die das und ist nicht ein eine mit von für auf den zu im des dem "
    "le la les de et est un une dans pour que qui du par sur pas en "
    "el los las y es una con para por del al se lo su como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``."""

    metric: str
    low: float
    high: float


#: Length, symbol, stop-word and line ratios of running prose.
RULES = (
    Rule("n_words", 50, float("inf")),
    Rule("mean_word_chars", 2, 15),
    Rule("symbols_per_word", 0, 0.1),
    Rule("stop_words", 2, float("inf")),
    Rule("upper_share", 0, 0.5),
    Rule("dup_line_share", 0, 0.5),
    Rule("repeat_word_share", 0, 0.5),
)


def base_columns(text: Column) -> dict[str, Column]:
    """Counts of a whole text; zeros for NULL.

    Repeated 3-word windows are found by sorting their fingerprints with their positions and
    comparing neighbours, inside the row; texts without a repeated window stop before that.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    return {
        "words": words,
        "word_chars": F.length(F.translate(text, _BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
    }


def _windows(words: Column) -> Column:
    """Fingerprints of all 3-word windows."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.zip_with(
        F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)),
        F.slice(hashes, 3, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda ab, c: F.xxhash64(ab, c),
    )


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur at least twice."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_covered(placed))


def _covered(placed: Column) -> Column:
    n = F.size(placed)
    before = F.slice(placed, 1, n - 1)
    after = F.slice(placed, 2, n - 1)
    pairs = F.filter(F.zip_with(before, after, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
    at = F.array_distinct(F.flatten(pairs))
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metrics of the rules; see :func:`judge`."""
    base = base_columns(F.col(text))
    names = ["word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper"]
    made = [*names, "n_words", "n_repeat_words", "stop_words"]
    rows = docs.drop(*made).withColumns({"words__": base["words"], **{n: base[n] for n in names}})
    rows = rows.withColumn("windows__", _windows(F.col("words__")))
    low = F.transform(F.col("words__"), lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    stops = F.filter(low, lambda w: w.isin(STOP_WORDS))
    rows = rows.withColumns(
        {
            "n_words": F.size("words__").cast("long"),
            "n_repeat_words": _repeated_words(F.col("windows__")).cast("long"),
            "stop_words": F.size(stops).cast("long"),
        }
    )
    return rows.drop("words__", "windows__")


def _ratio(over: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


#: Metrics that rules may name, as expressions of the measured counts.
METRICS = {
    "n_words": lambda: F.col("n_words"),
    "stop_words": lambda: F.col("stop_words"),
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "upper_share": lambda: _ratio("n_upper", "word_chars"),
    "dup_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_word_share": lambda: _ratio("n_repeat_words", "n_words"),
}


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measured counts, ``base_failed`` and ``kept``, one row per row.

    The rules become one conjunction of comparisons. NULL and empty texts have no words and are
    not kept; texts of any length are measured whole; repeated rows are judged alike; input
    columns named like a count are replaced; an empty table gives no rows. Nothing is shuffled.
    """
    rows = measure(docs.drop("base_failed", "kept"), text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = F.lit(True)
    for rule in rules:
        value = METRICS[rule.metric]()
        passed = passed & (value >= F.lit(float(rule.low))) & (value <= F.lit(float(rule.high)))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & passed)
