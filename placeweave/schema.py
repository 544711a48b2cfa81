"""Schemas of the directory and what counts as a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.ddl import schema

RAW_PLACE = schema(
    "name string, address string, city string, area string, phone string, website string, rating double, review_count int, latitude double, longitude double, "
    "place_id string, categories array<string>, hours map<string,string>, description string, google_maps_url string, source_query string, listing_type string, "
    "search_area string, found_by array<string>, closed boolean, reviews array<struct<author:string,rating:int,text:string,date:string>>, "
    "images array<struct<url:string,alt:string,file:string>>"
)
LISTING = schema(
    "id long, name string, slug string, listing_type string, city_id long, area_id long, sub_area string, address string, phone string, website string, "
    "description string, rating double, review_count int, latitude double, longitude double, place_id string, maps_url string, categories array<string>, "
    "hours map<string,string>, is_verified boolean, is_featured boolean, is_active boolean, locked_fields array<string>, last_seen_at timestamp, "
    "created_at timestamp, updated_at timestamp"
)
CITY = schema("id long, name string, slug string, meta_description string")
AREA = schema("id long, city_id long, name string, slug string, meta_description string")
CENTRE = schema("area string, lat double, lng double, osm_match string")
TASK = schema("ord long, key string, query string, keyword string, area string, lat double, lng double, zoom int")
#: Fields that a manual edit locks against later imports.
LOCKABLE = ("name", "listing_type", "area", "sub_area", "address", "phone", "website", "description", "rating", "review_count", "latitude", "longitude", "categories", "hours", "maps_url", "reviews", "images")
#: Fields that duplicates share with the row kept.
MERGED = ("name", "area_id", "address", "phone", "website", "description", "rating", "review_count", "latitude", "longitude", "categories", "hours", "maps_url")


def is_empty(column: Column | str, kind: T.DataType) -> Column:
    """Whether a value is missing: null, "", 0, [] or {}. Blanks alone are a value."""
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) <= 0)
    if isinstance(kind, T.NumericType):
        return c.isNull() | (c == 0)
    return c.isNull()


def schema_order(columns: list[str], schema: T.StructType) -> list[Column]:
    """The schema's columns, those that are missing as nulls, others dropped: a tolerant loader."""
    return [(F.col(f.name).cast(f.dataType) if f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
