"""Schemas of the tables the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRACK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("artists", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("external_urls", T.StructType([T.StructField("spotify", T.StringType())])),
    T.StructField("album", T.StructType([
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))),
    ])),
])

# One search-result page: the playlists found for one phrase of one request.
PLAYLIST_PAGE = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("query_no", T.IntegerType()),
    T.StructField("page_no", T.LongType()),
    T.StructField("playlists", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("tracks", T.ArrayType(T.StructType([T.StructField("track", TRACK)]))),
    ]))),
])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail at plan time when a column an operator cannot do without is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df
