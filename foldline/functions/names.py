"""Place names: qualifiers, full names, the ladder that tells namesakes apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def disambiguate(city: Column, state: Column, country: Column, total: Column, countries: Column, in_country: Column, claimed: Column, sep: str = ", ") -> Column:
    """The city alone while nothing else has its name; else with its state, or its country, whichever tells it apart first."""
    with_state, with_country = F.concat(city, F.lit(sep), state), F.concat(city, F.lit(sep), country)
    return (
        F.when((total <= 1) & ~claimed, city)
        .when((in_country > 1) & (state != ""), with_state)
        .when((countries > 1) & (country != ""), with_country)
        .when(state != "", with_state)
        .otherwise(city)
    )


def full_name(city: Column, state: Column, country: Column) -> Column:
    """City, state and country without empty parts and without a part that repeats the one before it."""
    state, country = F.trim(state), F.trim(country)
    state = F.when((state != "") & (state != city), state)
    before = F.coalesce(state, city)
    return F.concat_ws(", ", city, state, F.when((country != "") & (country != before), country))


def split_qualified(name: Column) -> Column:
    """struct(city, qualifiers) of a name like "City, State, Country"."""
    parts = F.transform(F.split(F.trim(name), ","), lambda x: F.trim(x))
    return F.struct(parts[0].alias("city"), F.filter(F.slice(parts, 2, 1 << 20), lambda x: x != "").alias("qualifiers"))


def matches_qualifiers(state: Column, country: Column, qualifiers: Column) -> Column:
    """Every qualifier is the state or the country (all lower-cased and without accents); none matches anything."""
    return F.forall(qualifiers, lambda q: (q == state) | (q == country))
