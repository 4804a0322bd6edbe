"""The given tables seen as a song corpus, playlists, requests and job events.

The text runs unchanged in Spark and in the engine the results are checked with. Titles
are numbered so that a (title, artist) key has a handful of rows at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from songloom.session import spread

TABLES = ["documents", "embeddings", "orders", "lineitem", "events", "conversations"]

# name -> (what it reads, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "songs": (["documents"], """
        SELECT doc_id AS song_id,
               CASE WHEN doc_id % 37 = 0 THEN NULL
                    ELSE concat('  Song ', CAST(CAST(floor(doc_id / 40) AS BIGINT) * 20 + doc_id % 20 AS VARCHAR(20)), ' ')
               END AS title,
               CASE WHEN doc_id % 41 = 0 THEN NULL ELSE upper(source) END AS artist,
               CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN 'Pop' WHEN doc_id % 6 = 1 THEN 'rap'
                    WHEN doc_id % 6 = 2 THEN 'rb' WHEN doc_id % 6 = 3 THEN 'ROCK' WHEN doc_id % 6 = 4 THEN 'country'
                    ELSE 'misc' END AS tag,
               lang AS language,
               CASE WHEN doc_id % 17 = 0 THEN 'unknown' ELSE CAST(1790 + doc_id % 240 AS VARCHAR(20)) END AS year,
               CASE WHEN doc_id % 13 = 0 THEN 'n/a' WHEN doc_id % 11 = 0 THEN '0' WHEN doc_id % 19 = 0 THEN '-5'
                    ELSE CAST(n_chars * (1 + doc_id % 7 * 100) AS VARCHAR(20)) END AS views,
               CAST(doc_id % 4 + 1 AS INT) AS chunk_index,
               CAST(floor(doc_id / 4) AS BIGINT) AS original_index,
               CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '   '
                    ELSE replace(text, chr(10), concat(chr(10), chr(10))) END AS lyrics
        FROM documents"""),
    "vectors": (["embeddings"], """
        SELECT vec_id AS song_id, CAST(vec_id % 4 + 1 AS INT) AS chunk_index,
               CAST(floor(vec_id / 4) AS BIGINT) AS original_index, embedding, label
        FROM embeddings"""),
    "song_vectors": (["songs", "vectors"], """
        SELECT s.song_id, s.title, s.artist, s.tag, s.language, s.year, s.views, s.chunk_index, s.original_index,
               v.embedding, v.label
        FROM songs s JOIN vectors v ON s.song_id = v.song_id"""),
    "playlist_items": (["orders", "lineitem"], """
        SELECT o.o_custkey AS request_id, CAST(o.o_orderkey % 5 + 1 AS INT) AS query_no, o.o_orderkey % 2 AS page_no,
               o.playlist_pos, o.o_orderkey AS playlist_id,
               count(*) OVER (PARTITION BY o.o_orderkey) AS playlist_total,
               l_linenumber * 1000000000000000 + l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)
                 AS track_pos,
               l_partkey % 59 <> 0 AS has_track,
               CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE concat('t', CAST(l_partkey AS VARCHAR(20))) END AS track_id,
               concat('SONG ', CAST(CAST(floor(l_partkey / 40) AS BIGINT) * 20 + l_partkey % 20 AS VARCHAR(20)),
                      CASE WHEN l_partkey % 5 = 0 THEN ' (live)' ELSE '' END) AS name,
               CASE WHEN l_partkey % 47 = 0 THEN NULL
                    WHEN l_partkey % 3 < 2 THEN concat(' src', CAST(l_partkey % 20 AS VARCHAR(20)))
                    ELSE concat('src', CAST(l_suppkey % 20 AS VARCHAR(20))) END AS artist_name,
               CASE WHEN l_partkey % 43 = 0 THEN NULL
                    ELSE concat('https://tracks.example/', CAST(l_partkey AS VARCHAR(20))) END AS url,
               CASE WHEN l_partkey % 7 = 0 THEN NULL
                    ELSE concat('https://images.example/', CAST(l_partkey AS VARCHAR(20))) END AS image_url
        FROM (SELECT *, CAST(2 * (row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5, o_orderkey % 2
                                                     ORDER BY o_orderkey DESC) - 1)
                             + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS INT) AS playlist_pos FROM orders) o
        JOIN lineitem l ON o.o_orderkey = l.l_orderkey"""),
    "tracks": (["playlist_items"], """
        SELECT request_id, query_no, page_no, playlist_pos, playlist_id, playlist_total, track_pos, track_id, name,
               coalesce(artist_name, '') AS artist_name, url, image_url
        FROM playlist_items WHERE has_track"""),
    "prompts": (["conversations"], """
        SELECT conv_id * 1000 + turn AS prompt_id, conv_id, turn, text AS prompt
        FROM conversations WHERE role = 'user'"""),
    "openings": (["conversations"], """
        SELECT conv_id AS request_id, min_by(text, turn) AS prompt
        FROM conversations WHERE role = 'user' GROUP BY conv_id"""),
    "asked_songs": (["songs", "openings"], """
        SELECT s.*, o.request_id, o.prompt FROM songs s
        JOIN openings o ON o.request_id = s.song_id % (SELECT max(request_id) + 1 FROM openings)"""),
    "responses": (["events"], """
        SELECT event_id, score_text, CASE
                 WHEN event_id % 6 = 0 THEN concat('{"score": ', score_text, '}')
                 WHEN event_id % 6 = 1 THEN concat('```json', chr(10), '{"score": ', score_text, '}', chr(10), '```')
                 WHEN event_id % 6 = 2 THEN concat('{"score": "', score_text, '"}')
                 WHEN event_id % 6 = 3 THEN concat('{"score": ', score_text, '.7}')
                 WHEN event_id % 18 = 4 THEN concat('{"score": ', score_text, '} {"score": 1}')
                 WHEN event_id % 18 = 10 THEN concat('{"score": ', score_text, '} extra}')
                 WHEN event_id % 6 = 4 THEN concat('{"score": ', score_text, '} extra')
                 ELSE concat('oops ', score_text) END AS response
        FROM (SELECT event_id,
                     CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) * 2 - 50 AS VARCHAR(20)) AS score_text
              FROM events) AS scored"""),
    "job_events": (["events"], """
        SELECT event_id, ts, user_id AS job_id,
               CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'in_progress'
                    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS progress,
               CASE WHEN event_id % 4 = 0 THEN concat('Found ', counted, ' candidate songs')
                    WHEN event_id % 4 = 1 THEN concat('Filtered to ', counted, ' songs for selected genres')
                    WHEN event_id % 4 = 2 THEN concat('Step ', counted, ' of the search')
                    ELSE 'Fetching candidates' END AS message
        FROM (SELECT *, CASE WHEN event_id * 37 < 1000 THEN CAST(event_id * 37 AS VARCHAR(20))
                             WHEN event_id * 37 < 1000000 THEN
                               concat(CAST(CAST(floor(event_id * 37 / 1000) AS BIGINT) AS VARCHAR(20)), ',',
                                      lpad(CAST(event_id * 37 % 1000 AS VARCHAR(20)), 3, '0'))
                             ELSE CAST(event_id * 37 AS VARCHAR(20)) END AS counted
              FROM events) AS e"""),
    "view_counts": (["events"], """
        SELECT event_id, CASE WHEN event_id % 100 = 0 THEN '100' WHEN event_id % 100 = 1 THEN '1000'
                              WHEN event_id % 100 = 2 THEN '10000000' WHEN event_id % 100 = 3 THEN '-1'
                              WHEN event_id % 100 = 4 THEN 'n/a'
                              WHEN event_id % 100 = 5 THEN CAST(value * value * 4000 AS VARCHAR(40))
                              ELSE CAST(value * value * 40 AS VARCHAR(40)) END AS views
        FROM events"""),
}


def register(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in ``sf_dir``, with whatever it reads registered first."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":
            df = spread(df, "l_orderkey", "l_partkey", "l_extendedprice")
    else:
        reads, text = VIEWS[name]
        for other in reads:
            register(spark, sf_dir, other)
        df = spark.sql(text)
    df.createOrReplaceTempView(name)
    return df
