"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import constants as K


def fold(text: Column) -> Column:
    folded = F.translate(F.lower(text), K.FOLD_FROM, K.FOLD_TO)
    return F.replace(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Trigrams of each word, with two spaces before it and one after, without repeats."""
    word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(tokens(text), word)))


def similarity(a: Column, b: Column) -> Column:
    """Trigrams in both by trigrams in either."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both)


def keyword_trigrams(keyword: str) -> list[str]:
    words = re.findall(r"[^\W_]+", keyword.lower())
    return sorted({("  " + w + " ")[i : i + 3] for w in words for i in range(len(w) + 1)})


def strict_word_similarity(keyword: str, title: Column, least: float = K.FUZZY_THRESHOLD) -> Column:
    """The largest similarity of the keyword to a run of whole words of the title, of any length; exact
    where it is ``least`` or more, else 0 or an understatement.

    The best run starts with a word that shares a trigram with the keyword, as any other start would only add to
    what the two do not share. A run grows word by word until it has so many trigrams that the keyword's are
    fewer than ``least`` of them; from there on no longer run can do."""
    own = keyword_trigrams(keyword)
    if not own:
        return F.lit(0.0)
    key, most = F.array(*[F.lit(g) for g in own]), int(len(own) / least)
    word_grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    nothing = F.struct(F.array().cast("array<string>").alias("grams"), F.lit(0.0).alias("best"))

    def grown(run: Column, grams: Column) -> Column:
        union = F.array_union(run["grams"], grams)
        both = F.size(F.array_intersect(union, key))
        similar = both.cast("double") / (F.size(union) + len(own) - both)
        return F.when(F.size(run["grams"]) > most, run).otherwise(F.struct(union.alias("grams"), F.greatest(run["best"], similar).alias("best")))

    def of_words(words: Column) -> Column:
        runs = F.transform(words, lambda w, i: F.when(F.arrays_overlap(w, key), F.aggregate(F.slice(words, i + 1, F.size(words) - i), nothing, grown, lambda run: run["best"])))
        return F.coalesce(F.array_max(runs), F.lit(0.0))

    # Bound once: a plain alias would be copied into the lambdas.
    return F.get(F.transform(F.array(F.transform(tokens(title), word_grams)), of_words), F.lit(0))


def work_arrangement(value: Column) -> Column:
    plain = F.lower(F.translate(F.trim(value), "-_ ", ""))
    return F.when(plain.isin("remote", "onsite", "hybrid"), plain).otherwise("unspecified")


def source_hash(text: Column, runes: int = K.SOURCE_HASH_RUNES) -> Column:
    return F.sha2(F.left(text, F.lit(runes)), 256)


def ngrams(text: Column, n: int = 3) -> Column:
    words = tokens(text)
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def retention(before: Column, after: Column) -> Column:
    """The share of the n-grams of ``before`` that are in ``after``; 0 if it has none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(before, after)).cast("double"), F.size(before)), F.lit(0.0))


def fidelity_state(status: Column, kept: Column, same_title: Column) -> Column:
    return F.when((status != 200) | (kept < K.FIDELITY_GONE), "gone").when((kept >= K.FIDELITY_SAME) & F.coalesce(same_title, F.lit(True)), "same").otherwise("drifted")


def initial(name: Column) -> Column:
    first = F.upper(F.left(fold(F.trim(name)), F.lit(1)))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("0-9")


def relative_time(seconds: Column) -> Column:
    """How long ago, in the largest whole unit."""
    out = F.when(seconds < 5, "just now")
    for limit, unit, name in ((60, 1, "sec"), (3600, 60, "min"), (86400, 3600, "hr"), (2592000, 86400, "day"), (31536000, 2592000, "mo")):
        out = out.when(seconds < limit, _ago(seconds, unit, name))
    return F.when(seconds.isNull(), "—").otherwise(out.otherwise(_ago(seconds, 31536000, "yr")))


def _ago(seconds: Column, unit: int, name: str) -> Column:
    n = F.floor(seconds / unit)
    return F.concat(n.cast("string"), F.when(n == 1, f" {name} ago").otherwise(f" {name}s ago"))


def pretty_url(url: Column) -> Column:
    """A URL without its scheme and one closing slash."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/$", "")


def host_of(url: Column) -> Column:
    """The host with its port; of what is no URL, what stands before the first slash."""
    host = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), "^.*@", "")
    return F.when(host != "", F.lower(host)).otherwise(F.substring_index(pretty_url(url), "/", 1))


def sparkline(series: Column, width: float, height: float, pad: float = 6.0) -> Column:
    """Points ``x,y`` of a series of numbers in a box, with one decimal: the largest at the top, a flat or empty
    series in the middle, a single number as a line."""
    low, high, n = F.array_min(series), F.array_max(series), F.size(series)
    one = lambda x: F.format_string("%.1f", F.round(x.cast("double"), 1))
    y = lambda v: F.when(high == low, F.lit(height / 2)).otherwise(height - pad - (v - low) / (high - low) * (height - 2 * pad))
    points = F.transform(series, lambda v, i: F.concat(one(i / F.greatest(n - 1, F.lit(1)) * width), F.lit(","), one(y(v))))
    flat = lambda v: F.array(F.concat(F.lit("0,"), one(v)), F.concat(F.lit(f"{width:g},"), one(v)))
    return F.array_join(F.when(F.coalesce(n, F.lit(0)) <= 0, flat(F.lit(height / 2))).when(n == 1, flat(y(F.get(series, F.lit(0))))).otherwise(points), " ")


def vocabulary_groups(body: Column, groups: list[list[str]] = K.VOCABULARY_GROUPS) -> Column:
    """How many groups have a phrase in the lower-cased body."""
    hit = lambda g: F.exists(F.array(*[F.lit(p) for p in g]), lambda p: F.contains(body, p)).cast("int")
    return sum((hit(g) for g in groups[1:]), hit(groups[0]))


def contains_word(text: Column, word: str) -> Column:
    """Whether the text has the word between ASCII word boundaries, in any case."""
    return F.lit(False) if not word else text.rlike(rf"(?i)(?<![0-9A-Za-z_]){re.escape(word)}(?![0-9A-Za-z_])")


def contains_text(text: Column, part: str) -> Column:
    """Whether the text has the part, in any case; an empty part is in none."""
    return F.contains(F.lower(text), F.lit(part.lower())) if part else F.lit(False)
