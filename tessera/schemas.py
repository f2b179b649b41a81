"""Record types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def _struct(fields: str) -> T.StructType:
    """A record type from "name kind, ..."; needs no session."""
    out = T.StructType()
    for field in fields.split(", "):
        name, kind = field.split(" ", 1)
        out = out.add(name, COMBO if kind == "combo" else _KINDS[kind])
    return out


LISTING = _struct("name string, profile_url string, avatar_url string, title string, rank string")
PROFILE = _struct(
    "name string, profile_url string, category string, title string, location string, rating double, reviews_count int, completion_rate string, rehire_rate string, response_time string, "
    "last_seen string, member_since string, parse_confidence string, skills array<string>, portfolio_count int, stats map<string,string>, scraped_at timestamp")
COMBO: T.StructType = _struct("dim string, value string, params map<string,string>, keyword string")
PAGE_COUNT = _struct("label string, combo combo, last_page int")
KEYWORD = _struct("keyword string, combo combo")
RAW_PAGE = _struct("profile_url string, html string, portfolio_html string")
PAGE_CACHE = _struct("label string, last_page int")
METRIC = _struct("phase string, metric string, value double, overlappable boolean")
RUN = _struct("run_id string, command string, files array<string>, timestamp timestamp")

#: Numeric columns of the analytics rows; absent or bad values are zero.
NUMERIC = (
    "employment_rate", "received_projects", "financial_deals", "completion_rate", "ontime_delivery_rate", "rehire_rate",
    "communication_success_rate", "total_completed_projects", "avg_response_time_minutes", "portfolio_count", "skills_count", "success_score")
