"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every measure is a row-local expression over the whole text, so the operator is a scan
and a projection: no shuffle, no Python, no skew, whatever the sources or copies.
Repeated word windows are found within the row by sorting its windows, and only
where a hash-based distinct has shown that there are any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.tables import SPACE, SPACE_CHARS, table

SYMBOLS = "#*$%&|<>"
#: Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with a an in is it for on was as are by this from at or not he "
    "le la les de des du un une et en que qui dans pour par sur au avec est pas ne "
    "der die das den dem des ein eine und in zu mit von ist im auf für sich nicht "
    "el la los las un una de del en y que a por con para se no es al lo"
).split()

LONGEST_STOP_WORD = max(map(len, STOP_WORDS))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # of the base rules
MAX_LOOKUP = 24  # different repeated windows that are looked up rather than sorted

#: The method's rules: measure, comparison, threshold. A document that breaks one goes.
THRESHOLDS = [
    ("n_words", "<=", 1_000_000.0),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 20.0),
    ("symbol_ratio", "<=", 0.1),  # symbols by words
    ("stop_word_ratio", ">=", 0.02),  # stop words by words
    ("dup_line_ratio", "<=", 0.5),  # repeated lines by lines with a word
]


def compile_rules(thresholds: list[tuple[str, str, float]]) -> Column:
    """One boolean expression: all rules hold. A null measure breaks no rule."""
    ok = F.lit(True)
    compare = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    for name, sign, bound in thresholds:
        ok = ok & F.coalesce(compare[sign](F.col(name), F.lit(bound)), F.lit(True))
    return ok


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for the row. A plain alias would be
    copied into lambdas when filters move down, and then computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(places: Column) -> Column:
    """Number of words in the 3-word windows at these places, given in order."""
    return F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def repeated_window_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Sorted, equal ones are neighbours. Where few
    different windows repeat, their places are looked up in the list of those; else the
    windows are sorted with their places, so that no text costs the square of its length."""

    def by_sorting(windows: Column) -> Column:
        def places(ordered: Column) -> Column:
            hash_at = lambda k: F.get(ordered, k)["w"]
            twice = F.transform(ordered, lambda x, k: F.when(x["w"].eqNullSafe(hash_at(k + 1)) | ((k > 0) & x["w"].eqNullSafe(hash_at(F.greatest(k - 1, F.lit(0))))), x["i"]))
            return _covered(F.sort_array(F.filter(twice, lambda i: i.isNotNull())))

        return let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), places)

    def by_lookup(windows: Column, twice: Column) -> Column:
        places = F.transform(windows, lambda w, i: F.when(F.array_contains(twice, w), i))
        return _covered(F.filter(places, lambda i: i.isNotNull()))

    def repeated(windows: Column) -> Column:
        twice = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda w, k: w.eqNullSafe(F.get(s, k + 1)))))
        found = let(twice, lambda t: F.when(F.size(t) <= MAX_LOOKUP, by_lookup(windows, t)).otherwise(by_sorting(windows)))
        return F.when(F.size(windows) > F.size(F.array_distinct(windows)), found).otherwise(0)

    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, let(F.slice(hashes, F.lit(1), F.size(words) - 2), repeated)).otherwise(0)


def with_measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of its text."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    stops = lambda ws: F.size(F.filter(ws, lambda w: (F.length(w) <= LONGEST_STOP_WORD) & F.lower(w).isin(STOP_WORDS)))
    of_words = let(words, lambda ws: F.struct(F.size(ws).alias("n_words"), repeated_window_words(ws).alias("n_repeat_words"), stops(ws).alias("n_stop_words")))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    without_space = text
    for c in SPACE_CHARS:
        without_space = F.replace(without_space, F.lit(c), F.lit(""))
    rows = docs.select(
        "doc_id", of_words.alias("of_words"), of_lines.alias("of_lines"), F.length(without_space).alias("word_chars"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).alias("n_symbols"))
    names = ["of_words.n_words", "word_chars", "n_symbols", "of_lines.n_lines", "of_lines.n_dup_lines", "of_words.n_repeat_words", "of_words.n_stop_words"]
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in names])


def judge_quality(docs: DataFrame, thresholds: list[tuple[str, str, float]] = THRESHOLDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words: all counts 0, base_failed, not kept. Texts
    of any length are measured whole. Ratios with a zero denominator are null and
    break no rule. Repeated rows are each judged; null doc_ids stay null; an empty
    table gives no rows; other columns are ignored.
    """
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    rows = with_measures(docs).select(
        "*", ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & compile_rules(thresholds))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1),
    lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS w
  FROM words WHERE len(words) >= 3),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
measures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop
  FROM words LEFT JOIN covered USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 1000000 AND coalesce(word_chars / n_words BETWEEN 2 AND 20, true)
    AND coalesce(n_symbols / n_words <= 0.1, true) AND coalesce(n_stop / n_words >= 0.02, true)
    AND coalesce(n_dup_lines / n_lines <= 0.5, true) AS kept
FROM failed
""".replace("{stop}", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
