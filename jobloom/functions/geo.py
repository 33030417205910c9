"""Locations to countries, over a gazetteer table (layer, phrase, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import constants as K
from jobloom.functions.text import fold, tokens

#: A small gazetteer of our own: countries, US states, cities.
GAZETTEER = [
    ("country", "germany", "DE"), ("country", "deutschland", "DE"), ("country", "austria", "AT"), ("country", "switzerland", "CH"), ("country", "france", "FR"),
    ("country", "canada", "CA"), ("country", "united states", "US"), ("country", "united kingdom", "GB"), ("country", "spain", "ES"), ("country", "korea", "KR"),
    ("country", "north korea", "KP"), ("country", "china", "CN"), ("country", "japan", "JP"), ("country", "india", "IN"), ("country", "brazil", "BR"), ("country", "egypt", "EG"),
    ("state", "california", "US"), ("state", "texas", "US"), ("state", "new york", "US"), ("state", "georgia", "US"),
    ("city", "berlin", "DE"), ("city", "munchen", "DE"), ("city", "munich", "DE"), ("city", "bern", "CH"), ("city", "zurich", "CH"), ("city", "salzburg", "AT"),
    ("city", "wien", "AT"), ("city", "vienna", "AT"), ("city", "london", "GB"), ("city", "stockholm", "SE"), ("city", "paris", "FR"), ("city", "madrid", "ES"),
]
US_TOKEN = r"(?:^|[^A-Za-z])(?:USA|U\.S\.A\.|U\.S\.|US)(?:[^A-Za-z]|$)"


def resolve(locations: DataFrame, gazetteer: DataFrame, column: str = "location") -> DataFrame:
    """(location, country) for each different location; '' if nothing matches. Layers go
    country, the bare token US, state, city; in each the phrase that ends last wins, then
    the longer one. Locations are few beside rows: resolve each once, then join."""
    longest = gazetteer.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1  # words of the longest phrase
    places = locations.select(F.col(column).alias("location")).distinct()
    words = tokens(fold(F.col("location")))
    spans = places.select("location", words.alias("w")).select("location", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))).alias("at"))
    spans = spans.select("location", "at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("at"), n), " ").alias("phrase")))).alias("s"), F.size("w").alias("size"))
    spans = spans.filter(F.col("at") + F.col("s.n") - 1 <= F.col("size")).select("location", (F.col("at") + F.col("s.n")).alias("end"), F.col("s.n").alias("n"), F.col("s.phrase").alias("phrase"))
    hits = spans.join(gazetteer, "phrase")
    best = lambda layer: F.max(F.when(F.col("layer") == layer, F.struct("end", "n", "code")))["code"]
    found = hits.groupBy("location").agg(best("country").alias("country"), best("state").alias("state"), best("city").alias("city"))
    us = F.when(F.col("location").rlike(US_TOKEN), "US")
    return places.join(found, "location", "left").select("location", F.coalesce("country", us, "state", "city", F.lit("")).alias("country"))


def iso_codes(spark: SparkSession) -> list[str]:
    """The two-letter codes of countries that Java knows."""
    return list(spark._jvm.java.util.Locale.getISOCountries())


def hinted(hint: Column, resolved_hint: Column, resolved: Column, codes: list[str]) -> Column:
    """A hint that is a country's code as it is, else what the hint resolves to, else the location."""
    code = F.upper(F.trim(hint))
    return F.coalesce(F.when(F.array_contains(F.array(*[F.lit(c) for c in codes]), code), code), F.nullif(resolved_hint, F.lit("")), resolved)


def dominant_country(cities: DataFrame) -> DataFrame:
    """(name, country) of ``cities`` (name, country, population): of names in one country that
    one; else the largest, if large enough and well ahead of the runner-up."""
    most = cities.groupBy("name", "country").agg(F.max("population").alias("p"))
    ranked = most.groupBy("name").agg(F.slice(F.sort_array(F.collect_list(F.struct("p", "country")), asc=False), 1, 2).alias("top"))
    first, second = F.col("top")[0], F.get("top", 1)
    ahead = (first["p"] >= K.POPULATION_FLOOR) & (second["p"] > 0) & (first["p"] >= K.POPULATION_RATIO * second["p"])
    return ranked.filter((F.size("top") == 1) | ahead).select("name", first["country"].alias("country"))
