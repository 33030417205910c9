"""GeoNames files to rows, and the gazetteer that is built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.geo import dominant_country
from jobloom.functions.text import fold, tokens

#: Fixed values. English words that are no US state in a location; regions that are no city; codes that are no country.
STATE_STOP = ["or", "hi", "ok", "oh"]
CITY_STOP = (
    "america americas asia apac eu europe africa oceania antarctica emea emeia mena latam benelux nordics nordic scandinavia dach anz man to union"
).split()
UNASSIGNED = ["AN", "CS", "XK"]


def _fields(lines: DataFrame, least: int) -> DataFrame:
    """``lines`` (raw) split at tabs; comments, empty lines and short ones are left out."""
    f = F.split(F.rtrim(F.col("raw"), F.lit("\r")), "\t", -1)
    return lines.filter((F.col("raw") != "") & ~F.startswith("raw", F.lit("#"))).select(f.alias("f")).filter(F.size("f") >= least)


def _at(i: int) -> Column:
    return F.trim(F.get("f", F.lit(i)))


def cities(lines: DataFrame) -> DataFrame:
    """(name, alias, country, population): the name in ASCII, the alias in its own letters."""
    rows = _fields(lines, 15).select(_at(2).alias("name"), _at(1).alias("alias"), _at(8).alias("country"), F.coalesce(_at(14).try_cast("long"), F.lit(0)).alias("population"))
    return rows.filter("name <> '' AND country <> ''")


def countries(lines: DataFrame) -> DataFrame:
    """(code, name)."""
    return _fields(lines, 5).select(_at(0).alias("code"), _at(4).alias("name")).filter("code <> '' AND name <> ''")


def us_states(lines: DataFrame) -> DataFrame:
    """(code, name) of the first-order divisions of the United States."""
    return _fields(lines, 2).filter(F.startswith(_at(0), F.lit("US."))).select(F.trim(F.substring(_at(0), 4, 100)).alias("code"), _at(1).alias("name")).filter("code <> '' AND name <> ''")


def key(name: Column) -> Column:
    return F.array_join(tokens(fold(name)), " ")


def gazetteer(country_rows: DataFrame, city_rows: DataFrame, state_rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(layer, phrase, code) for :func:`jobloom.functions.geo.resolve`, of countries (code, name), cities, US states and
    ``synonyms`` (kind, phrase, code). A phrase is a country before it is a state, and that before it is a city. A state's code is a
    phrase unless it is a country's code or an English word. A city's name stands for the country that it is in
    alone or far larger than elsewhere; a synonym decides before that. The tables are small: a gazetteer is built once."""
    known = country_rows.filter(~F.col("code").isin(UNASSIGNED))
    said = lambda kind: synonyms.filter(F.col("kind") == kind).select(key(F.col("phrase")).alias("phrase"), "code")
    country = known.select(key(F.col("name")).alias("phrase"), "code").unionByName(said("country")).filter("phrase <> ''").groupBy("phrase").agg(F.min("code").alias("code"))
    codes = country_rows.select(F.lower("code").alias("phrase"))
    short = state_rows.select(F.lower("code").alias("phrase")).filter(F.col("phrase").rlike("^[a-z]{2}$") & ~F.col("phrase").isin(STATE_STOP)).join(codes, "phrase", "left_anti")
    state = short.unionByName(state_rows.select(key(F.col("name")).alias("phrase"))).filter("phrase <> ''").distinct().join(country, "phrase", "left_anti").withColumn("code", F.lit("US"))
    free = lambda d: d.filter((F.col("phrase") != "") & ~F.col("phrase").isin(CITY_STOP)).join(country, "phrase", "left_anti").join(state, "phrase", "left_anti")
    named = city_rows.join(known.select(F.col("code").alias("country")), "country", "left_semi")
    both = named.select("country", "population", F.explode(F.array_distinct(F.array(key(F.col("name")), key(F.col("alias"))))).alias("phrase"))
    lone = dominant_country(free(both).select(F.col("phrase").alias("name"), "country", "population")).select(F.col("name").alias("phrase"), F.col("country").alias("code"))
    by_synonym = free(said("city")).groupBy("phrase").agg(F.min("code").alias("code"))
    city = by_synonym.unionByName(lone.join(by_synonym, "phrase", "left_anti"))
    layer = lambda d, name: d.select(F.lit(name).alias("layer"), "phrase", "code")
    return layer(country, "country").unionByName(layer(state, "state")).unionByName(layer(city, "city"))
