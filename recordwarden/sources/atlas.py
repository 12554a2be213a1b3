"""Country and owner dimensions. All come from policy, so their size is bounded by it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import country_key_value, person_key_value

# Countries of each sales region.
REGION_COUNTRIES = {
    "North America": ("United States", "Canada", "Mexico"),
    "LATAM": (
        "Brazil", "Argentina", "Chile", "Colombia", "Peru", "Uruguay", "Paraguay", "Bolivia",
        "Ecuador", "Venezuela", "Costa Rica", "Panama", "Guatemala", "Honduras", "El Salvador",
        "Nicaragua", "Dominican Republic", "Puerto Rico", "Jamaica", "Trinidad and Tobago",
    ),
    "EMEA": (
        "United Kingdom", "Ireland", "France", "Germany", "Spain", "Portugal", "Italy",
        "Netherlands", "Belgium", "Luxembourg", "Switzerland", "Austria", "Denmark", "Sweden",
        "Norway", "Finland", "Iceland", "Poland", "Czechia", "Slovakia", "Hungary", "Romania",
        "Bulgaria", "Greece", "Croatia", "Slovenia", "Serbia", "Estonia", "Latvia", "Lithuania",
        "Ukraine", "Malta", "Cyprus",
        "Turkey", "Israel", "United Arab Emirates", "Saudi Arabia", "Qatar", "Kuwait", "Bahrain",
        "Oman", "Jordan", "Lebanon",
        "Egypt", "Morocco", "Tunisia", "Algeria", "Nigeria", "Ghana", "Kenya", "South Africa",
        "Tanzania", "Uganda", "Ethiopia", "Rwanda", "Senegal", "Ivory Coast", "Cameroon",
        "Zambia", "Zimbabwe", "Botswana", "Mauritius",
    ),
    "APAC": (
        "Australia", "New Zealand", "Japan", "China", "Hong Kong", "Taiwan", "South Korea",
        "Singapore", "Malaysia", "Indonesia", "Thailand", "Vietnam", "Philippines", "India",
        "Pakistan", "Bangladesh", "Sri Lanka", "Nepal", "Cambodia", "Laos", "Myanmar",
        "Mongolia", "Fiji",
    ),
}

# Other spellings, already reduced to a country key.
COUNTRY_ALIASES = {
    "us": "United States",
    "usa": "United States",
    "u s": "United States",
    "u s a": "United States",
    "america": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom",
    "u k": "United Kingdom",
    "great britain": "United Kingdom",
    "britain": "United Kingdom",
    "england": "United Kingdom",
    "scotland": "United Kingdom",
    "wales": "United Kingdom",
    "northern ireland": "United Kingdom",
    "uae": "United Arab Emirates",
    "u a e": "United Arab Emirates",
    "emirates": "United Arab Emirates",
    "holland": "Netherlands",
    "the netherlands": "Netherlands",
    "czech republic": "Czechia",
    "korea": "South Korea",
    "republic of korea": "South Korea",
    "cote d ivoire": "Ivory Coast",
    "cote divoire": "Ivory Coast",
    "deutschland": "Germany",
    "espana": "Spain",
    "brasil": "Brazil",
}
# Keys that are never resolved to a country.
UNMAPPED_COUNTRIES = ("russia",)


def canonical_countries() -> dict[str, str]:
    """Country key to the one spelling used in correction tables."""
    known = {country_key_value(c): c for group in REGION_COUNTRIES.values() for c in group}
    known.update(COUNTRY_ALIASES)
    return {key: name for key, name in known.items() if key not in UNMAPPED_COUNTRIES}


def country_regions(region_countries: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Country key to region; the first region naming a country keeps it."""
    named: dict[str, str] = {}
    for region, countries in region_countries.items():
        for country in countries:
            named.setdefault(country_key_value(country), region)
    named.pop("", None)
    spelled = {
        alias: named[country_key_value(country)]
        for alias, country in COUNTRY_ALIASES.items()
        if country_key_value(country) in named
    }
    return {**spelled, **named}


def owner_regions_by_key(owner_regions: Mapping[str, str]) -> dict[str, str]:
    """Owner key to region; the last entry for an owner wins."""
    pairs = ((person_key_value(owner), region) for owner, region in owner_regions.items())
    return {key: region for key, region in pairs if key and region}


def dimension(spark: SparkSession, mapping: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A two-column lookup table that says how to join it, by its bytes.

    Up to the session's `spark.sql.autoBroadcastJoinThreshold` it is broadcast. Spark itself would
    take 20 bytes for a text of any length, so a larger one asks for a sort-merge join, whose hot
    keys adaptive execution splits.
    """
    columns = {key: list(mapping.keys()), value: list(mapping.values())}
    entries = pa.table(columns, pa.schema([(c, pa.string()) for c in columns]))
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    frame = spark.createDataFrame(entries)
    return F.broadcast(frame) if entries.nbytes <= limit else frame.hint("merge")
