"""The catalog's results as plain SQL over the same tables, for a second engine to compute.

Written for DuckDB. Each text is a full statement: the views it reads come first.
"""

from __future__ import annotations

from songloom.constants import FALLBACK_PHRASES, LYRICS_FOOTER, QUERY_TEMPLATES, VIEW_EDGES
from songloom.plans.catalog import WATCH_TERMS
from songloom.plans.views import TABLES, VIEWS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def _number(column: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE)"


def _mult(views: str) -> str:
    return f"greatest(1 + 0.1 * (log10(greatest(coalesce({views}, 1), 1)) - 3), 0.1)"


def _checksum(vector: str) -> str:
    return f"list_dot_product({vector}::DOUBLE[], list_transform(range(1, len({vector}) + 1), lambda i: i::DOUBLE))"


def _norm(vector: str) -> str:
    return f"sqrt(list_dot_product({vector}::DOUBLE[], {vector}::DOUBLE[]))"


def _tokens(column: str) -> str:
    return (rf"list_distinct(list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}]+'), "
            "lambda w: w <> ''))")


def _hex_mod(text: str, modulus: int) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {modulus})"


def _result_id(position: str) -> str:
    key = "title || '_' || artist"
    return f"'song_' || ({position}) || '_' || {_hex_mod(key, 10000)}"


def _slot_counts(key: str, rows: str, text: str, where: str, dim: int) -> str:
    """How often each slot of hashed words occurs in a text."""
    words = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
    return f"""
        SELECT {key}, slot, count(*) AS n FROM (
          SELECT {key}, ('0x' || substr(md5(unnest({words})), 1, 8))::BIGINT % {dim} AS slot FROM {rows} WHERE {where})
        GROUP BY {key}, slot"""


def _slot_vectors(key: str, counts: str, dim: int) -> str:
    """Slot counts as unit vectors, in single precision as they are stored."""
    return f"""
        SELECT {key}, list(coalesce(v, 0)::FLOAT::DOUBLE ORDER BY slot) AS embedding FROM (
          SELECT {key}, unnest(range({dim})) AS slot FROM (SELECT DISTINCT {key} FROM {counts}))
        LEFT JOIN (SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS v FROM {counts}) USING ({key}, slot)
        GROUP BY {key}"""


SEEN = "query_no, page_no, playlist_pos, track_pos"
KEYS = "lower(trim(name)) AS norm_title, lower(trim(artist_name)) AS norm_artist"
SONG_KEYS = "lower(trim(title)) AS norm_title, lower(trim(artist)) AS norm_artist"
TERMS = ", ".join(f"({_text(t)})" for t in WATCH_TERMS)
BREAK = "chr(10) || chr(10)"

# name -> (what it reads, text); on top of the shared views
DERIVED: dict[str, tuple[list[str], str]] = {
    "centre": (["vectors"], f"""
        SELECT list_transform(q, lambda x: x / {_norm('q')}) AS q FROM (
          SELECT list(m ORDER BY i) AS q FROM (
            SELECT i, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v,
                                               unnest(range(1, len(embedding) + 1)) AS i FROM vectors) GROUP BY i))"""),
    "label_queries": (["vectors"], f"""
        SELECT query_id, list_transform(q, lambda x: x / {_norm('q')}) AS q FROM (
          SELECT query_id, list(m ORDER BY i) AS q FROM (
            SELECT query_id, i, avg(v) AS m FROM (
              SELECT label::BIGINT AS query_id, unnest(embedding)::DOUBLE AS v,
                     unnest(range(1, len(embedding) + 1)) AS i FROM vectors) GROUP BY query_id, i) GROUP BY query_id)"""),
    "raw_vectors": (["song_vectors"], """
        SELECT * REPLACE (list_transform(embedding::DOUBLE[], lambda x: x *
            CASE WHEN song_id % 97 = 0 THEN 0 WHEN chunk_index = 1 THEN 1 ELSE 1 + song_id % 3 END) AS embedding)
        FROM song_vectors"""),
    "track_keys": (["tracks"], f"SELECT DISTINCT {KEYS} FROM tracks"),
    "keyed_songs": (["songs"], f"SELECT *, {SONG_KEYS} FROM songs"),
    "matched": (["keyed_songs", "track_keys"], """
        SELECT s.* FROM keyed_songs s
        WHERE (s.norm_title, s.norm_artist) IN (SELECT (norm_title, norm_artist) FROM track_keys)"""),
    "first_tracks": (["tracks"], f"""
        SELECT * FROM (SELECT *, {KEYS}, row_number() OVER (
            PARTITION BY lower(trim(name)), lower(trim(artist_name)) ORDER BY request_id, {SEEN}) AS rn FROM tracks)
        WHERE rn = 1"""),
    "hits": (["song_vectors", "label_queries"], f"""
        SELECT query_id AS request_id, song_id, title, artist, greatest(coalesce({_number('views')}, 1), 1) AS views,
               s AS vector_score, CASE WHEN song_id % 10 <> 0 THEN (song_id % 101)::INT END AS relevance,
               song_id % 10 = 1 AS failed
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, song_id) AS place FROM (
                SELECT *, list_dot_product(embedding::DOUBLE[], q) * {_mult(_number('views'))} AS s
                FROM song_vectors, label_queries WHERE title IS NOT NULL AND artist IS NOT NULL))
        WHERE place <= 100"""),
    "neutral": (["hits"], """
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, song_id) AS rank FROM (
          SELECT request_id, song_id, title, artist, vector_score,
                 CASE WHEN failed THEN 50 ELSE coalesce(relevance, 50) END AS relevance,
                 CASE WHEN failed THEN vector_score
                      ELSE 0.7 * vector_score + 0.3 * coalesce(relevance, 50) / 100.0 END AS score FROM hits)"""),
    "strict": (["hits"], """
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, song_id) AS rank FROM (
          SELECT request_id, song_id, title, artist,
                 CASE WHEN failed THEN 0 ELSE coalesce(relevance, 0) END AS relevance,
                 CASE WHEN failed THEN 0.7 * vector_score WHEN relevance IS NULL THEN vector_score
                      ELSE 0.7 * vector_score + 0.3 * relevance / 100.0 END AS score FROM hits)"""),
    "genre_requests": (["openings"], """
        SELECT *, CASE request_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Pop'] WHEN 2 THEN ['R&B', ' rock ']
                  ELSE [''] END AS genres,
               CASE request_id % 4 WHEN 1 THEN ['pop'] WHEN 2 THEN ['rb', 'rock'] ELSE []::VARCHAR[] END AS tags
        FROM openings"""),
    "prompt_slots": (["openings"], _slot_counts("request_id", "openings", "prompt", "TRUE", 256)),
    "prompt_vectors": (["prompt_slots"], _slot_vectors("request_id", "prompt_slots", 256)),
    "lyric_vectors": (["encoded"], _slot_vectors("song_id", "encoded", 256)),
    "requests": (["genre_requests", "prompt_vectors"], """
        SELECT r.*, v.embedding AS q FROM genre_requests r JOIN prompt_vectors v ON v.request_id = r.request_id"""),
    "request_tracks": (["tracks", "requests"], f"""
        SELECT * FROM (
          SELECT *, {KEYS}, row_number() OVER (PARTITION BY request_id, lower(trim(name)), lower(trim(artist_name))
                                              ORDER BY {SEEN}) AS by_key
          FROM (SELECT *, row_number() OVER (PARTITION BY request_id, track_id ORDER BY {SEEN}) AS by_id FROM tracks
                WHERE request_id IN (SELECT request_id FROM requests))
          WHERE by_id = 1)
        WHERE by_key = 1"""),
    "request_matches": (["keyed_songs", "request_tracks"], """
        SELECT t.request_id, s.song_id, s.title, s.artist, s.tag, s.views, t.url, t.image_url
        FROM keyed_songs s JOIN request_tracks t ON s.norm_title = t.norm_title AND s.norm_artist = t.norm_artist"""),
    "request_songs": (["request_matches", "requests"], """
        SELECT m.* FROM request_matches m JOIN requests r ON m.request_id = r.request_id
        WHERE len(r.tags) = 0 OR coalesce(list_contains(r.tags, lower(m.tag)), FALSE)"""),
    "request_scores": (["request_songs", "requests", "lyric_vectors"], f"""
        SELECT m.*, list_dot_product(v.embedding, r.q) AS raw_score, {_mult(_number('m.views'))} AS mult
        FROM request_songs m JOIN requests r ON m.request_id = r.request_id JOIN lyric_vectors v ON v.song_id = m.song_id"""),
    "two_stage_hits": (["request_scores"], """
        SELECT * FROM (
          SELECT *, raw_score * mult AS vector_score,
                 row_number() OVER (PARTITION BY request_id ORDER BY raw_score * mult DESC, song_id) AS hit FROM (
            SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY raw_score DESC, song_id) AS near
            FROM request_scores)
          WHERE near <= 200 AND title IS NOT NULL AND artist IS NOT NULL)
        WHERE hit <= 100"""),
    "fused_hits": (["request_scores"], """
        SELECT * FROM (
          SELECT *, raw_score * mult AS vector_score,
                 row_number() OVER (PARTITION BY request_id ORDER BY raw_score * mult DESC, song_id) AS hit
          FROM request_scores WHERE title IS NOT NULL AND artist IS NOT NULL)
        WHERE hit <= 100"""),
    "named_songs": (["request_songs"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, title, artist ORDER BY song_id) AS rn
                       FROM request_songs WHERE title IS NOT NULL AND artist IS NOT NULL) WHERE rn = 1"""),
    "word_lists": (["songs"], f"""
        SELECT song_id, {_tokens('lyrics')} AS words FROM songs
        WHERE lyrics IS NOT NULL AND {_strip('lyrics')} <> ''"""),
    "ask_lists": (["openings"], f"SELECT request_id, prompt, {_tokens('prompt')} AS asked FROM openings"),
    "passage_parts": (["songs"], f"""
        SELECT song_id, list_filter(list_transform(string_split(lyrics, {BREAK}), lambda p: {_strip('p')}),
                                    lambda p: p <> '') AS parts
        FROM songs WHERE lyrics IS NOT NULL"""),
    "song_passages": (["passage_parts"], f"""
        SELECT song_id, coalesce(flatten(list_transform(list_append(f.done, f.open), lambda m:
                 list_transform(range(1, length(m) + 1, 800), lambda i: substr(m, i, 800)))), []::VARCHAR[]) AS passages
        FROM (SELECT song_id, CASE WHEN len(parts) > 0 THEN list_reduce(
                list_transform(parts, lambda p: {{'done': []::VARCHAR[], 'open': p}}),
                lambda a, x: CASE WHEN length(a.open) + length(x.open) < 200
                  THEN {{'done': a.done, 'open': a.open || {BREAK} || x.open}}
                  ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END) END AS f FROM passage_parts)"""),
    "passage_rows": (["song_passages"], """
        SELECT song_id, unnest(passages) AS passage, unnest(range(0, len(passages))) AS passage_no FROM song_passages"""),
    "positive": (["passage_rows"], """
        SELECT song_id, draw_no, 'positive' AS kind, max(CASE WHEN rn = 1 THEN passage END) AS sentence_0,
               max(CASE WHEN rn = 2 THEN passage END) AS sentence_1
        FROM (SELECT *, row_number() OVER (PARTITION BY song_id, draw_no ORDER BY
                md5('42|' || song_id || '|' || draw_no || '|' || passage_no), passage_no) AS rn
              FROM passage_rows, (SELECT unnest([1, 2])::INT AS draw_no))
        GROUP BY song_id, draw_no HAVING count(*) >= 2"""),
    "synthetic": (["passage_rows"], f"""
        SELECT song_id, 1 AS draw_no, 'synthetic' AS kind, replace(
                 [{', '.join(_text(t) for t in QUERY_TEMPLATES)}][1 + {_hex_mod("'42|template|' || song_id || '|1'", 5)}],
                 '{{}}', array_to_string(regexp_split_to_array({_strip('passage')}, '\\s+')[1:20], ' ')) AS sentence_0,
               passage AS sentence_1
        FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY
                md5('42|passage|' || song_id || '|1|' || passage_no)) AS rn FROM passage_rows) WHERE rn = 1"""),
    "valid_views": (["view_counts"], f"""
        SELECT event_id, {_number('views')} AS views FROM view_counts WHERE {_number('views')} >= 0"""),
    "encoded": (["songs"], _slot_counts("song_id", "songs", "lyrics", f"lyrics IS NOT NULL AND {_strip('lyrics')} <> ''", 256)),
    "short_encoded": (["songs"], _slot_counts(
        "song_id", "songs", "lyrics", f"lyrics IS NOT NULL AND {_strip('lyrics')} <> ''", 64)),
    "short_vectors": (["short_encoded"], _slot_vectors("song_id", "short_encoded", 64)),
    "all_vectors": (["vectors", "short_vectors"], """
        SELECT song_id, embedding::DOUBLE[] AS embedding FROM vectors
        UNION ALL SELECT song_id, embedding FROM short_vectors WHERE song_id NOT IN (SELECT song_id FROM vectors)"""),
    "encodings": (["encoded"], """
        SELECT song_id, count(*) AS nonzero, sum((n / length)::FLOAT::DOUBLE * (slot + 1)) AS checksum
        FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY song_id)) AS length FROM encoded) GROUP BY song_id"""),
}

_ALL = {**VIEWS, **DERIVED}


def _needed(reads: list[str], seen: list[str]) -> list[str]:
    for name in reads:
        if name not in TABLES and name not in seen:
            _needed(_ALL[name][0], seen)
            seen.append(name)
    return seen


def _statement(reads: str, select: str) -> str:
    views = [f"{name} AS ({_ALL[name][1]})" for name in _needed(reads.split(), [])]
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + select


_HIT = f"""song_id, title, artist, greatest(coalesce({_number('views')}, 1), 1) AS views,
    round(raw_score, 6) AS raw_score, round(mult, 6) AS views_multiplier, round(raw_score * mult, 6) AS score"""


def _scored(rows: str = "song_vectors") -> str:
    return f"""(SELECT s.*, list_dot_product(embedding::DOUBLE[], q) AS raw_score, {_mult(_number('views'))} AS mult
                FROM {rows} s, centre)"""


def _two_stage(rows: str, near: int) -> str:
    return f"""SELECT {_HIT} FROM (SELECT * FROM {rows} ORDER BY raw_score DESC, song_id LIMIT {near})
               WHERE title IS NOT NULL AND artist IS NOT NULL ORDER BY raw_score * mult DESC, song_id LIMIT 8"""


_CANDIDATES = f"{_scored()} WHERE song_id IN (SELECT song_id FROM matched)"

_BATCH = f"""(SELECT query_id, s.*, list_dot_product(embedding::DOUBLE[], q) AS raw_score,
                     {_mult(_number('views'))} AS mult FROM song_vectors s, label_queries)"""


def _recommendation(hits: str, top: int, known: str, score: str) -> str:
    return f"""
    SELECT f.request_id, f.rank, f.song_id, {_result_id('f.rank - 1').replace('title', 'f.title').replace('artist', 'f.artist')} AS id,
           f.title, f.artist, 'Unknown Album' AS album, coalesce(n.tag, 'Unknown Genre') AS genre, 180000 AS duration_ms,
           round(f.score, 6) AS score, f.streams, f.relevance, coalesce(n.url, 'None') AS url, n.image_url, round(f.vector_score, 6) AS vector_score
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, song_id) AS rank FROM (
            SELECT request_id, song_id, title, artist, vector_score, {known} AS relevance, {score} AS score,
                   trunc(greatest(coalesce({_number('views')}, 1), 1))::BIGINT AS streams
            FROM (SELECT h.*, CASE WHEN w.words IS NOT NULL THEN floor(100.0 * len(list_intersect(a.asked, w.words))
                                   / greatest(len(a.asked), 1))::INT END AS llm
                  FROM {hits} h LEFT JOIN word_lists w ON w.song_id = h.song_id
                  JOIN ask_lists a ON a.request_id = h.request_id))) f
    LEFT JOIN named_songs n ON n.request_id = f.request_id AND n.title = f.title AND n.artist = f.artist
    WHERE f.rank <= {top}"""


_SERVICE = _recommendation("two_stage_hits", 50, "coalesce(llm, 50)", "0.7 * vector_score + 0.3 * coalesce(llm, 50) / 100.0")
_CLI = _recommendation("fused_hits", 7, "coalesce(llm, 0)",
                       "CASE WHEN llm IS NULL THEN vector_score ELSE 0.7 * vector_score + 0.3 * llm / 100.0 END")
_SERVICE_READS = "two_stage_hits named_songs word_lists ask_lists"
_CLI_READS = "fused_hits named_songs word_lists ask_lists"


def _histogram(edges: list[float]) -> str:
    bins = ", ".join(f"({i + 1}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)"
                     for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"""SELECT b.bin::INT AS bin, b.left_edge, b.right_edge, count(v.views) AS songs
        FROM (VALUES {bins}) b(bin, left_edge, right_edge) LEFT JOIN valid_views v
          ON v.views >= b.left_edge AND (v.views < b.right_edge OR (b.bin = {len(edges) - 1} AND v.views = b.right_edge))
        GROUP BY ALL"""


_JOB_STATUS = """
    SELECT job_id, d.status AS status,
           CASE d.status WHEN 'completed' THEN 100 WHEN 'failed' THEN 0 WHEN 'cancelled' THEN 0 ELSE d.progress END::INT
             AS progress,
           CASE d.status WHEN 'completed' THEN 'Playlist created successfully!' WHEN 'failed' THEN 'Failed to create playlist'
             WHEN 'cancelled' THEN 'Job cancelled by user' ELSE d.message END AS message,
           CASE WHEN d.status = 'failed' THEN d.message END AS error, created_at, d.ts AS updated_at
    FROM (SELECT job_id, created_at, coalesce(final, last) AS d FROM (
      SELECT job_id, min(ts) AS created_at, max_by(e, (ts, event_id)) AS last,
             min_by(e, (ts, event_id)) FILTER (e.status IN ('completed', 'failed', 'cancelled')) AS final
      FROM (SELECT job_id, ts, event_id, {'ts': ts, 'status': status, 'progress': progress, 'message': message} AS e
            FROM job_events) GROUP BY job_id))"""

# Pairs with their number and, where t > 0 and x < n, their place x in the order of an epoch.
_EPOCH_ORDER = """        WITH RECURSIVE numbered AS (
          SELECT song_id, kind, draw_no, row_number() OVER (ORDER BY song_id, kind, draw_no) - 1 AS pair_no, count(*) OVER () AS n
          FROM (SELECT song_id, kind, draw_no FROM positive WHERE draw_no = 1 UNION ALL SELECT song_id, kind, draw_no FROM synthetic)
        ), bases AS (
          SELECT *, (n + high - 1) // high AS low FROM (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS high FROM numbered)
        ), turns(song_id, kind, draw_no, pair_no, n, high, low, x, t) AS (
          SELECT *, pair_no, 0 FROM bases
          UNION ALL
          SELECT song_id, kind, draw_no, pair_no, n, high, low, s.h * low + s.l, t + 1 FROM (
            SELECT *, list_reduce(list_concat([{'h': x // low, 'l': x % low, 'k': -1::BIGINT}],
                list_transform(range(6), lambda k: {'h': 0::BIGINT, 'l': 0::BIGINT, 'k': k})),
              lambda a, e: CASE WHEN e.k % 2 = 0
                THEN {'h': (a.h + ('0x' || substr(md5('42|epoch 3|' || e.k || '|' || a.l), 1, 8))::BIGINT % high) % high, 'l': a.l, 'k': e.k}
                ELSE {'h': a.h, 'l': (a.l + ('0x' || substr(md5('42|epoch 3|' || e.k || '|' || a.h), 1, 8))::BIGINT % low) % low, 'k': e.k}
              END) AS s FROM turns WHERE t = 0 OR x >= n)
        )"""

_INVENTORY = """SELECT c.chunk_index::INT AS chunk_index, coalesce(m.n, 0) AS metadata_rows, coalesce(v.n, 0) AS vector_rows,
      coalesce(m.n, 0) > 0 AND coalesce(v.n, 0) > 0 AS present,
      CASE WHEN coalesce(m.n, 0) > 0 AND coalesce(v.n, 0) > 0 THEN 'loaded' ELSE 'missing' END AS status
    FROM (SELECT unnest([1, 2, 3, 4, 5]) AS chunk_index) c
    LEFT JOIN (SELECT chunk_index, count(*) AS n FROM songs GROUP BY 1) m ON m.chunk_index = c.chunk_index
    LEFT JOIN (SELECT chunk_index, count(*) AS n FROM vectors GROUP BY 1) v ON v.chunk_index = c.chunk_index"""

_PLACED = """SELECT *, (row_number() OVER (PARTITION BY playlist_id ORDER BY track_pos) - 1)::INT AS pos
    FROM playlist_items"""

_KEPT_YEAR = f"{_number('year')} >= 1800"
_KEPT = f"({_KEPT_YEAR} AND language IN ('en', 'es'))"
_BLANK = f"lyrics IS NOT NULL AND {_strip('lyrics')} <> ''"
_CLEANED_RAW = "coalesce(lyrics, '') || chr(10) || '12' || " + _text(LYRICS_FOOTER)
_CLEANED = _strip(rf"replace(regexp_replace({_CLEANED_RAW}, '^[^\n]*\n', ''), {_text(LYRICS_FOOTER)}, '')")
_UNFENCED = f"replace(replace({_strip('response')}, '```json', ''), '```', '')"
_WATCHED = f"""SELECT t.term, m.song_id, m.title, m.artist FROM matched m
    JOIN (VALUES {TERMS}) t(term) ON regexp_matches(m.title, t.term, 'i')"""

_RENDERED = """'Score from 0 to 100 how well this song answers the request. Reply with {"score": n} only.' || chr(10)
                 || 'Request: ' || prompt || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Artist: '
                 || coalesce(artist, '') || chr(10) || 'Lyrics:' || chr(10)
                 || CASE WHEN length(lyrics) > 5000 THEN substr(lyrics, 1, 5000) || '...' ELSE lyrics END"""

_SAMPLE = """
        SELECT chunk_index, sample_no, song_id FROM (
          SELECT chunk_index, song_id,
                 row_number() OVER (PARTITION BY chunk_index ORDER BY md5('42|song|' || song_id), song_id) AS sample_no
          FROM songs)
        WHERE sample_no <= greatest(100, ({total} // (SELECT count(DISTINCT chunk_index) FROM songs)) // 2)"""

# key -> (views it reads, select)
_CHECKS: dict[str, tuple[str, str]] = {
    "scan_lyrics_csv": ("songs", """
        SELECT song_id, chunk_index, title, length(lyrics) AS chars, md5(lyrics) AS lyrics_md5 FROM songs"""),
    "scan_csv_ranges": ("songs", "SELECT song_id, chunk_index, artist, md5(lyrics) AS lyrics_md5 FROM songs"),
    "scan_metadata_csv": ("songs", "SELECT song_id, chunk_index, title, artist, views FROM songs"),
    "scan_metadata": ("songs", "SELECT * EXCLUDE (lyrics) FROM songs"),
    "scan_npy": ("vectors", f"""
        SELECT chunk_index, original_index, len(embedding)::INT AS dim, round({_checksum('embedding')}, 6) AS checksum
        FROM vectors"""),
    "align_chunks": ("songs vectors", """
        SELECT s.song_id, chunk_index, original_index, len(embedding)::INT AS dim, md5(lyrics) AS lyrics_md5
        FROM songs s JOIN vectors v USING (chunk_index, original_index)"""),
    "chunk_inventory": ("songs vectors", _INVENTORY),
    "chunk_status_line": ("songs vectors", f"""
        SELECT 'loaded chunks [' || string_agg(chunk_index::VARCHAR, ', ' ORDER BY chunk_index) FILTER (present)
               || ']; missing chunks [' || string_agg(chunk_index::VARCHAR, ', ' ORDER BY chunk_index) FILTER (NOT present)
               || ']' AS status_line FROM ({_INVENTORY})"""),
    "split_to_sizes": ("songs", """
        SELECT song_id, c.chunk_index::INT AS chunk_index, (i - c.start)::BIGINT AS original_index
        FROM (SELECT song_id, row_number() OVER (ORDER BY song_id) - 1 AS i FROM songs) s
        JOIN (SELECT chunk_index, sum(n) OVER (ORDER BY chunk_index) - n AS start, sum(n) OVER (ORDER BY chunk_index) AS stop
              FROM (SELECT chunk_index, count(*) AS n FROM songs GROUP BY 1)) c ON s.i >= c.start AND s.i < c.stop"""),
    "write_clean_reported": ("songs", f"""
        SELECT chunk_index, count(*) AS rows_before, count(*) FILTER ({_KEPT}) AS rows_after,
               count(*) = count(*) FILTER ({_KEPT}) AS none_filtered FROM songs GROUP BY chunk_index"""),
    "write_clean": ("songs", f"""
        SELECT song_id, chunk_index, original_index, year, language, md5(lyrics) AS lyrics_md5 FROM songs WHERE {_KEPT}"""),
    "flatten_playlists": ("playlist_items", f"""
        SELECT request_id, query_no, page_no, playlist_pos, playlist_id, playlist_total, pos AS track_pos, track_id, name,
               coalesce(artist_name, '') AS artist_name, url, image_url FROM ({_PLACED}) WHERE has_track"""),
    "playlist_sink": ("neutral genre_requests", f"""
        SELECT r.request_id AS id, CASE WHEN length(prompt) <= 50 THEN prompt ELSE substr(prompt, 1, 47) || '...' END AS title,
               array_to_string(genres, '|') AS genres, count(*)::INT AS n_songs,
               string_agg({_result_id('rank - 1').replace('title', 's.title').replace('artist', 's.artist')}, '|' ORDER BY rank)
                 AS song_ids, round(max(score), 6) AS top_score
        FROM genre_requests r JOIN neutral s ON s.request_id = r.request_id WHERE rank <= 25 GROUP BY ALL"""),
    "incremental_embed": ("all_vectors centre", f"""
        SELECT song_id, len(embedding)::INT AS dim, round({_checksum('embedding')}, 3) AS checksum,
               round(list_dot_product(embedding, q), 6) AS raw_score FROM all_vectors, centre"""),
    "normalise_key": ("tracks", f"SELECT request_id, playlist_id, track_pos, {KEYS} FROM tracks"),
    "numeric_coerce": ("songs", f"SELECT song_id, {_number('views')} AS views, {_number('year')} AS year FROM songs"),
    "year_filter": ("songs", f"SELECT song_id, year FROM songs WHERE {_KEPT_YEAR}"),
    "language_filter": ("songs", "SELECT song_id, language FROM songs WHERE language IN ('en', 'es')"),
    "clean_corpus": ("songs vectors", f"""
        SELECT s.song_id, year, language, round({_checksum('embedding')}, 6) AS checksum, length(lyrics) AS chars
        FROM songs s JOIN vectors v USING (chunk_index, original_index) WHERE {_KEPT}"""),
    "genre_filter": ("songs", "SELECT song_id, tag FROM songs WHERE lower(tag) IN ('pop', 'rock')"),
    "genre_label_map": ("genre_requests", """
        SELECT request_id, (i - 1)::INT AS pos, label, CASE trim(label) WHEN 'Pop' THEN 'pop' WHEN 'Rap' THEN 'rap'
               WHEN 'R&B' THEN 'rb' WHEN 'Rock' THEN 'rock' WHEN 'Country' THEN 'country' ELSE lower(trim(label)) END AS tag
        FROM (SELECT request_id, unnest(genres) AS label, unnest(range(1, len(genres) + 1)) AS i FROM genre_requests)"""),
    "genre_filter_requests": ("asked_songs genre_requests", """
        SELECT r.request_id, s.song_id, s.tag FROM asked_songs s JOIN genre_requests r ON r.request_id = s.request_id
        WHERE len(r.tags) = 0 OR list_contains(r.tags, lower(s.tag))"""),
    "drop_unidentified": ("songs", """
        SELECT song_id, title, artist FROM songs WHERE title IS NOT NULL AND artist IS NOT NULL"""),
    "drop_blank_lyrics": ("songs", f"SELECT song_id, md5(lyrics) AS lyrics_md5 FROM songs WHERE {_BLANK}"),
    "search_titles": ("songs", """
        SELECT song_id, title, artist FROM songs
        WHERE regexp_matches(title, 'song (1|2)', 'i') AND regexp_matches(artist, 'src1', 'i')"""),
    "watchlist_found": ("matched", f"""
        SELECT t.term, count(m.song_id) AS matches, count(m.song_id) > 0 AS found
        FROM (VALUES {TERMS}) t(term) LEFT JOIN matched m ON regexp_matches(m.title, t.term, 'i') GROUP BY t.term"""),
    "watchlist_matches": ("matched", _WATCHED),
    "match_terms": ("songs tracks", """
        SELECT t.term, s.song_id FROM (SELECT DISTINCT name AS term FROM tracks) t
        JOIN songs s ON regexp_matches(s.title, t.term, 'i')"""),
    "found_terms": ("songs tracks", """
        SELECT t.term, count(s.song_id) AS matches, count(s.song_id) > 0 AS found
        FROM (SELECT DISTINCT name AS term FROM tracks) t LEFT JOIN songs s ON regexp_matches(s.title, t.term, 'i') GROUP BY t.term"""),
    "training_columns": ("songs", """
        SELECT song_id::VARCHAR AS song_id, title, artist, md5(lyrics) AS lyrics_md5 FROM songs WHERE lyrics IS NOT NULL"""),
    "min_score_filter": ("songs hits", f"""
        SELECT DISTINCT s.song_id, s.title, s.artist, h.relevance FROM songs s JOIN hits h ON h.song_id = s.song_id
        WHERE h.relevance >= 50 AND {_BLANK}"""),
    "nonneg_views": ("valid_views", "SELECT event_id, round(views, 6) AS views FROM valid_views"),
    "match_candidates": ("matched", "SELECT song_id, norm_title, norm_artist FROM matched"),
    "match_candidates_stored": ("matched", "SELECT song_id, norm_title, norm_artist FROM matched"),
    "match_candidates_strict": ("matched", """
        SELECT song_id, title, artist FROM matched WHERE norm_title <> '' AND norm_artist <> ''"""),
    "attach_track_attrs": ("matched first_tracks", """
        SELECT m.song_id, m.norm_title, m.norm_artist, t.track_id, t.url, t.image_url
        FROM matched m LEFT JOIN first_tracks t ON t.norm_title = m.norm_title AND t.norm_artist = m.norm_artist"""),
    "restrict_to_hits": ("matched hits", """
        SELECT song_id, title, artist FROM matched WHERE (title, artist) IN (SELECT (title, artist) FROM hits)"""),
    "fetch_lyrics": ("matched", f"""
        SELECT song_id, chunk_index, original_index, length(t) AS chars, md5(t) AS lyrics_md5
        FROM (SELECT *, nullif({_strip('lyrics')}, '') AS t FROM matched)"""),
    "lookup_ids": ("hits songs", """
        SELECT h.request_id, s.song_id, s.title, s.artist, s.tag, s.language, round(h.vector_score, 6) AS vector_score
        FROM hits h JOIN songs s ON s.song_id = h.song_id"""),
    "enrich_hits": ("hits matched first_tracks", """
        SELECT h.request_id, h.song_id, h.title, h.artist, 'Unknown Album' AS album, coalesce(m.tag, 'Unknown Genre') AS genre,
               180000 AS duration_ms, coalesce(m.url, 'None') AS url, m.image_url
        FROM hits h LEFT JOIN (
          SELECT m.*, t.url, t.image_url, row_number() OVER (PARTITION BY title, artist ORDER BY song_id) AS rn
          FROM matched m JOIN first_tracks t ON t.norm_title = m.norm_title AND t.norm_artist = m.norm_artist) m
          ON m.title = h.title AND m.artist = h.artist AND m.rn = 1"""),
    "watchlist_in_final": ("matched strict", f"""
        SELECT w.song_id, w.title, w.artist, (w.title, w.artist) IN (
                 SELECT (title, artist) FROM strict WHERE rank <= 25) AS in_final
        FROM (SELECT DISTINCT song_id, title, artist FROM ({_WATCHED})) w"""),
    "query_x_corpus": ("song_vectors label_queries", """
        SELECT query_id, count(*) AS songs, round(avg(s), 6) AS mean_score, round(min(s), 6) AS lowest_score,
               round(max(s), 6) AS highest_score
        FROM (SELECT query_id, list_dot_product(embedding::DOUBLE[], q) AS s FROM song_vectors, label_queries) GROUP BY query_id"""),
    "dedup_tracks": ("tracks", f"""
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, track_id ORDER BY {SEEN}) AS rn
                                    FROM tracks) WHERE rn = 1"""),
    "dedup_keys_first": ("tracks", f"""
        SELECT request_id, norm_title, norm_artist, track_id, url, {SEEN} FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id, norm_title, norm_artist ORDER BY {SEEN}) AS rn
          FROM (SELECT *, {KEYS} FROM tracks)) WHERE rn = 1"""),
    "distinct_keys": ("track_keys", "SELECT * FROM track_keys"),
    "dedup_corpus": ("keyed_songs", f"""
        SELECT song_id, norm_title, norm_artist, length(lyrics) AS chars FROM (
          SELECT *, row_number() OVER (PARTITION BY norm_title, norm_artist
                                       ORDER BY coalesce({_number('views')}, 0) DESC, song_id) AS rn FROM keyed_songs)
        WHERE rn = 1 OR norm_title IS NULL OR norm_artist IS NULL"""),
    "corpus_counts": ("songs", "SELECT chunk_index, count(*) AS songs FROM songs GROUP BY ROLLUP (chunk_index)"),
    "clean_report": ("songs", f"""
        SELECT chunk_index, count(*) AS rows_before, count(*) FILTER ({_KEPT}) AS rows_after,
               count(*) = count(*) FILTER ({_KEPT}) AS none_filtered FROM songs GROUP BY chunk_index"""),
    "views_hist_edges": ("valid_views", _histogram(VIEW_EDGES)),
    "views_hist_equal": ("valid_views", _histogram([i * 1_000_000 for i in range(11)])),
    "views_trimmed": ("valid_views", "SELECT count(*) AS trimmed FROM valid_views WHERE views > 10000000"),
    "vector_profile": ("raw_vectors", f"""
        SELECT chunk_index, count(*) AS vectors, max(len(embedding))::INT AS dim,
               round(avg({_norm('embedding')}) FILTER (original_index < 512), 6) AS mean_norm,
               avg({_norm('embedding')}) FILTER (original_index < 512) BETWEEN 0.98 AND 1.02 AS already_unit
        FROM raw_vectors GROUP BY chunk_index"""),
    "run_summary": ("requests tracks request_matches request_songs two_stage_hits", """
        SELECT r.request_id, coalesce(c.n, 0) AS total_candidates, coalesce(m.n, 0) AS dataset_matches,
               coalesce(g.n, 0) AS after_genre, coalesce(h.n, 0) AS hits
        FROM requests r
        LEFT JOIN (SELECT request_id, count(DISTINCT coalesce(track_id, '')) AS n FROM tracks GROUP BY 1) c USING (request_id)
        LEFT JOIN (SELECT request_id, count(*) AS n FROM request_matches GROUP BY 1) m USING (request_id)
        LEFT JOIN (SELECT request_id, count(*) AS n FROM request_songs GROUP BY 1) g USING (request_id)
        LEFT JOIN (SELECT request_id, count(*) AS n FROM two_stage_hits GROUP BY 1) h USING (request_id)"""),
    "pair_counts": ("song_passages", """
        SELECT count(*) FILTER (len(passages) >= 2) AS songs_with_pairs,
               count(*) FILTER (len(passages) >= 2) AS positive_pairs,
               count(*) FILTER (len(passages) > 0) AS synthetic_pairs FROM song_passages"""),
    "candidates_by_chunk": ("matched", """
        SELECT chunk_index, count(*) AS candidates, min(original_index) AS first_index, max(original_index) AS last_index
        FROM matched GROUP BY chunk_index"""),
    "l2_normalise": ("raw_vectors", f"""
        SELECT song_id, round(CASE WHEN {_norm('embedding')} = 0 THEN 0 ELSE 1 END::DOUBLE, 6) AS length,
               round({_checksum('embedding')} / CASE WHEN {_norm('embedding')} = 0 THEN 1 ELSE {_norm('embedding')} END, 6)
                 AS checksum FROM raw_vectors"""),
    "cosine_scan": ("song_vectors centre", f"SELECT song_id, round(raw_score, 6) AS raw_score FROM {_scored()}"),
    "cosine_raw": ("raw_vectors centre", f"""
        SELECT song_id, title, artist, round(score, 6) AS score FROM (
          SELECT song_id, title, artist, CASE WHEN {_norm('embedding')} = 0 THEN 0
                 ELSE list_dot_product(embedding, q) / ({_norm('embedding')} * {_norm('q')}) END AS score
          FROM raw_vectors, centre) ORDER BY score DESC, song_id LIMIT 10"""),
    "views_multiplier": ("songs", f"SELECT song_id, round({_mult(_number('views'))}, 6) AS views_multiplier FROM songs"),
    "topk_fused": ("song_vectors centre", f"""
        SELECT {_HIT} FROM {_scored()} WHERE title IS NOT NULL AND artist IS NOT NULL
        ORDER BY raw_score * mult DESC, song_id LIMIT 7"""),
    "topk_fused_candidates": ("song_vectors centre matched", f"""
        SELECT {_HIT} FROM {_CANDIDATES} AND title IS NOT NULL AND artist IS NOT NULL
        ORDER BY raw_score * mult DESC, song_id LIMIT 7"""),
    "topk_two_stage": ("song_vectors centre", _two_stage(_scored(), 24)),
    "topk_two_stage_candidates": ("song_vectors centre matched", _two_stage(_CANDIDATES, 16)),
    "topk_batch": ("song_vectors label_queries", f"""
        SELECT query_id, rank, {_HIT} FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score * mult DESC, song_id) AS rank
          FROM {_BATCH} WHERE title IS NOT NULL AND artist IS NOT NULL) WHERE rank <= 7"""),
    "topk_batch_two_stage": ("song_vectors label_queries", f"""
        SELECT query_id, rank, {_HIT} FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score * mult DESC, song_id) AS rank
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, song_id) AS near FROM {_BATCH})
          WHERE near <= 21 AND title IS NOT NULL AND artist IS NOT NULL) WHERE rank <= 7"""),
    "blend_scores": ("hits", """
        SELECT request_id, song_id, coalesce(relevance, 50) AS relevance,
               round(0.7 * vector_score + 0.3 * coalesce(relevance, 50) / 100.0, 6) AS score FROM hits"""),
    "rerank_neutral": ("neutral", "SELECT request_id, rank, song_id, relevance, round(score, 6) AS score FROM neutral"),
    "rerank_strict": ("strict", "SELECT request_id, rank, song_id, relevance, round(score, 6) AS score FROM strict"),
    "score_watchlist": ("request_songs request_scores " + _CLI_READS, f"""
        SELECT request_id, song_id, title, artist, views, relevance, (request_id, title, artist) IN (SELECT (request_id, title, artist) FROM ({_CLI})) AS in_final,
               round(v, 6) AS vector_score, round(s, 6) AS score
        FROM (SELECT w.request_id, w.song_id, w.title, w.artist, greatest(coalesce({_number('w.views')}, 1), 1) AS views,
                     c.raw_score * c.mult AS v, coalesce(x.llm, 0) AS relevance,
                     CASE WHEN x.llm IS NULL THEN c.raw_score * c.mult
                          ELSE 0.7 * c.raw_score * c.mult + 0.3 * x.llm / 100.0 END AS s
              FROM (SELECT * FROM (
                      SELECT *, row_number() OVER (PARTITION BY request_id, title, artist ORDER BY song_id) AS rn
                      FROM request_songs WHERE artist IS NOT NULL
                        AND EXISTS (SELECT 1 FROM (VALUES {TERMS}) t(term) WHERE regexp_matches(title, t.term, 'i')))
                    WHERE rn = 1) w
              JOIN request_scores c ON c.request_id = w.request_id AND c.song_id = w.song_id
              LEFT JOIN (SELECT a.request_id, l.song_id, floor(100.0 * len(list_intersect(a.asked, l.words))
                                / greatest(len(a.asked), 1))::INT AS llm
                         FROM request_scores p JOIN ask_lists a ON a.request_id = p.request_id
                         JOIN word_lists l ON l.song_id = p.song_id) x
                ON x.request_id = w.request_id AND x.song_id = w.song_id)"""),
    "recommend": (_SERVICE_READS, _SERVICE),
    "recommend_cli": (_CLI_READS, _CLI),
    "normalise_if_needed": ("raw_vectors", f"""
        SELECT song_id, unit AS already_unit, round(CASE WHEN unit OR n = 0 THEN n ELSE 1 END, 6) AS length,
               round({_checksum('embedding')} / CASE WHEN unit OR n = 0 THEN 1 ELSE n END, 6) AS checksum
        FROM (SELECT *, {_norm('embedding')} AS n, avg({_norm('embedding')}) FILTER (original_index < 512)
                OVER (PARTITION BY chunk_index) BETWEEN 0.98 AND 1.02 AS unit FROM raw_vectors)"""),
    "rank_results": ("hits", """
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY vector_score DESC, song_id) AS rank, song_id
        FROM hits"""),
    "pick_playlist_in_range": ("tracks", f"""
        SELECT request_id, rank, query_no, playlist_id, track_id, name FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {SEEN}) AS rank FROM (
            SELECT t.*, row_number() OVER (PARTITION BY t.request_id, t.track_id ORDER BY {SEEN}) AS rn
            FROM tracks t WHERE (t.request_id, t.query_no, t.playlist_id) IN (
              SELECT (request_id, query_no, min_by(playlist_id, (page_no, playlist_pos))) FROM tracks
              WHERE playlist_total BETWEEN 5 AND 100 GROUP BY request_id, query_no)) WHERE rn = 1) WHERE rank <= 30"""),
    "quota_sample": ("songs", _SAMPLE.format(total=200_000)),
    "epoch_pairs": ("songs positive synthetic", f"""
        SELECT pair_no, chunk_index, kind, song_id, md5(sentence_0) AS md5_0, md5(sentence_1) AS md5_1 FROM (
          SELECT *, row_number() OVER (ORDER BY chunk_index, kind, sample_no, draw_no) AS pair_no
          FROM ({_SAMPLE.format(total=200_000)})
          JOIN (SELECT * FROM positive WHERE draw_no = 1 UNION ALL SELECT * FROM synthetic) USING (song_id))
        WHERE pair_no <= 200000"""),
    "epoch_order": ("positive synthetic", f"""
        SELECT * FROM ({_EPOCH_ORDER} SELECT song_id, kind, draw_no, pair_no, x AS place FROM turns WHERE t > 0 AND x < n)"""),
    "epoch_shards": ("positive synthetic", f"""
        SELECT * FROM ({_EPOCH_ORDER} SELECT CASE WHEN x < n // 2 THEN 0 ELSE 1 END::INT AS shard, count(*) AS pairs, min_by(pair_no, x) AS first,
                       max_by(pair_no, x) AS last FROM turns WHERE t > 0 AND x < n GROUP BY 1)"""),
    "shuffle_pairs": ("positive synthetic", """
        SELECT song_id, kind, draw_no, md5('42|shuffle|' || song_id || '|' || kind || '|' || draw_no) AS shuffle_key,
               md5(sentence_0) AS md5_0, md5(sentence_1) AS md5_1
        FROM (SELECT * FROM positive WHERE draw_no = 1 UNION ALL SELECT * FROM synthetic)"""),
    "union_chunks": ("songs", "SELECT song_id, title, artist, chunk_index, original_index FROM songs"),
    "passages": ("passage_rows", """
        SELECT song_id, passage_no::INT AS passage_no, length(passage) AS chars, md5(passage) AS passage_md5
        FROM passage_rows"""),
    "positive_pairs": ("positive", "SELECT * FROM positive"),
    "synthetic_queries": ("synthetic", "SELECT * FROM synthetic"),
    "truncate_lyrics": ("songs", """
        SELECT song_id, length(t) AS chars, md5(t) AS lyrics_md5 FROM (
          SELECT song_id, CASE WHEN length(lyrics) > 5000 THEN substr(lyrics, 1, 5000) || '...' ELSE lyrics END AS t FROM songs)"""),
    "render_prompt": ("asked_songs", f"""
        SELECT song_id, length(t) AS chars, md5(t) AS request_md5 FROM (SELECT song_id, {_RENDERED} AS t FROM asked_songs)"""),
    "score_with_model": ("asked_songs", f"""
        SELECT song_id, CASE WHEN t IS NULL THEN NULL WHEN length(t) % 7 = 0 THEN 0
                 ELSE least(length(t) % 131, 100) END::INT AS relevance
        FROM (SELECT song_id, {_RENDERED} AS t FROM asked_songs)"""),
    "score_with_failures": ("asked_songs", f"""
        SELECT song_id, CASE WHEN t IS NULL OR length(t) % 5 = 0 THEN NULL WHEN length(t) % 7 = 0 THEN 0
                 ELSE least(length(t) % 131, 100) END::INT AS relevance,
               coalesce(length(t) % 5 = 0, false) AS failed,
               CASE WHEN length(t) % 5 = 0 THEN 'ConnectionError: no answer in time' END AS error
        FROM (SELECT song_id, {_RENDERED} AS t FROM asked_songs)"""),
    "rerank_with_failures": ("hits asked_songs", f"""
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, song_id)::INT AS rank, song_id,
               llm AS relevance, round(s, 6) AS score FROM (
          SELECT request_id, song_id, CASE WHEN failed THEN 50 ELSE known END::INT AS llm,
                 CASE WHEN failed THEN vector_score ELSE 0.7 * vector_score + 0.3 * (known / 100.0) END AS s FROM (
            SELECT h.request_id, h.song_id, h.vector_score, coalesce(length(t) % 5 = 0, false) AS failed,
                   CASE WHEN t IS NULL THEN 50 WHEN length(t) % 7 = 0 THEN 0 ELSE least(length(t) % 131, 100) END AS known
            FROM hits h JOIN (SELECT song_id, {_RENDERED} AS t FROM asked_songs) USING (song_id)))"""),
    "parse_score": ("responses", f"""
        SELECT event_id, CASE WHEN json_valid({_UNFENCED})
                 THEN greatest(least(trunc(TRY_CAST(json_extract_string({_UNFENCED}, '$.score') AS DOUBLE)), 100), 0)
                 ELSE 0 END::INT AS score FROM responses"""),
    "parse_queries_json": ("prompts", """
        SELECT prompt_id, (i - 1)::INT AS pos, phrase FROM (
          SELECT prompt_id, unnest(w) AS phrase, unnest(range(1, len(w) + 1)) AS i
          FROM (SELECT prompt_id, string_split(prompt, ' ') AS w FROM prompts WHERE prompt_id % 5 <> 0))"""),
    "parse_queries_lines": ("prompts", f"""
        SELECT prompt_id, (i - 1)::INT AS pos, phrase FROM (
          SELECT prompt_id, unnest(w) AS phrase, unnest(range(1, len(w) + 1)) AS i FROM (
            SELECT prompt_id, CASE WHEN prompt_id % 5 = 0 THEN [{', '.join(_text(p) for p in FALLBACK_PHRASES)}]
              ELSE list_filter(list_transform(string_split(replace(prompt, '. ', ' ' || {BREAK} || ' '), chr(10)),
                     lambda x: {_strip('x')}), lambda x: x <> '')[1:5] END AS w FROM prompts))"""),
    "query_context": ("genre_requests", """
        SELECT request_id, prompt || '(' || array_to_string(genres, ' ') || ')' AS context,
               CASE WHEN len(genres) > 0 THEN ' Focus on ' || array_to_string(genres, ', ') || ' music.' ELSE '' END AS focus
        FROM genre_requests"""),
    "first_nested": ("playlist_items", f"""
        SELECT playlist_id, pos AS track_pos, coalesce(artist_name, '') AS artist, url, image_url
        FROM ({_PLACED}) WHERE has_track"""),
    "clean_lyrics": ("songs", f"""
        SELECT song_id, length(t) AS chars, md5(t) AS lyrics_md5 FROM (SELECT song_id, {_CLEANED} AS t FROM songs)
        WHERE t <> ''"""),
    "playlist_title": ("prompts", """
        SELECT prompt_id, t AS title, CASE WHEN len(string_split(t, ' ')) > 3
                 THEN array_to_string(string_split(t, ' ')[1:3], ' ') || '...' ELSE t END AS short_title
        FROM (SELECT prompt_id, CASE WHEN length(prompt) <= 50 THEN prompt ELSE substr(prompt, 1, 47) || '...' END AS t
              FROM prompts)"""),
    "result_id": ("hits", f"""
        SELECT request_id, song_id, {_result_id('place - 1')} AS result_id FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY vector_score DESC, song_id) AS place FROM hits)"""),
    "present_row": ("asked_songs genre_requests", f"""
        SELECT s.song_id, sec // 60 || ':' || lpad((sec % 60)::VARCHAR, 2, '0') AS duration,
               CASE WHEN s.song_id % 200 = 0 THEN '' ELSE floor((s.song_id % 200) / 200.0 * 100 + 0.5)::INT || '%' END AS percent,
               coalesce(trunc({_number('views')})::BIGINT, 0) AS streams,
               CASE WHEN coalesce(len(genres), 0) > 0 THEN array_to_string(genres[1:3], ', ') ELSE 'Various Genres' END AS genres
        FROM (SELECT *, floor(coalesce(length(lyrics), 0) * 130 / 1000.0 + 0.5)::INT AS sec FROM asked_songs) s
        JOIN genre_requests r ON r.request_id = s.request_id"""),
    "message_count": ("job_events", """
        SELECT event_id, CASE WHEN message LIKE '%songs%' OR message LIKE '%candidates%'
                 THEN TRY_CAST(replace(regexp_extract(message, '([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)'), ',', '') AS BIGINT) END AS songs
        FROM job_events"""),
    "embed_texts": ("encodings", """
        SELECT song_id, 256 AS dim, nonzero::INT AS nonzero, 1.0::DOUBLE AS length, round(checksum, 3) AS checksum FROM encodings"""),
    "embed_snapshots": ("encodings songs", f"""
        SELECT e.song_id, sha256(s.lyrics) AS lyrics_hash, CASE WHEN e.song_id % 9 = 0 OR e.song_id % 10 = 3 THEN 2 ELSE 1 END::INT AS delta,
               round(e.checksum, 3) AS checksum FROM encodings e JOIN songs s ON s.song_id = e.song_id"""),
    "score_relevance": ("asked_songs ask_lists word_lists", """
        SELECT s.song_id, CASE WHEN s.lyrics IS NULL THEN NULL ELSE
                 floor(100.0 * len(list_intersect(asked, coalesce(words, []))) / greatest(len(asked), 1))::INT END AS relevance
        FROM asked_songs s JOIN ask_lists a ON a.request_id = s.request_id LEFT JOIN word_lists w ON w.song_id = s.song_id"""),
    "job_status": ("job_events", _JOB_STATUS),
    "job_status_stream": ("job_events", _JOB_STATUS),
    "job_machine_stream": ("job_events", """
        SELECT job_id, s.status, s.progress, s.message, s.error, s.created_at, s.updated_at, s.refused, s.unknown FROM (
          SELECT job_id, list_reduce(list_concat([{'status': NULL::VARCHAR, 'progress': 0, 'message': NULL::VARCHAR, 'error': NULL::VARCHAR,
              'created_at': NULL::TIMESTAMP, 'updated_at': NULL::TIMESTAMP, 'refused': 0::BIGINT, 'unknown': 0::BIGINT}],
              list({'status': status, 'progress': progress, 'message': message, 'error': NULL::VARCHAR, 'created_at': ts::TIMESTAMP,
                    'updated_at': ts::TIMESTAMP, 'refused': 0::BIGINT, 'unknown': 0::BIGINT} ORDER BY ts, event_id)),
            lambda a, e: CASE
              WHEN a.status IN ('completed', 'failed', 'cancelled') OR a.status IS NULL AND e.status = 'cancelled'
                   OR a.status IS NOT NULL AND e.status = 'pending'
                THEN {'status': a.status, 'progress': a.progress, 'message': a.message, 'error': a.error, 'created_at': a.created_at,
                      'updated_at': a.updated_at, 'refused': a.refused + 1, 'unknown': a.unknown + CASE WHEN a.status IS NULL THEN 1 ELSE 0 END}
              ELSE {'status': e.status,
                    'progress': CASE e.status WHEN 'completed' THEN 100 WHEN 'failed' THEN 0 WHEN 'cancelled' THEN 0
                                  ELSE greatest(a.progress, coalesce(e.progress, 0)) END,
                    'message': CASE e.status WHEN 'completed' THEN 'Playlist created successfully!' WHEN 'failed' THEN 'Failed to create playlist'
                                 WHEN 'cancelled' THEN 'Job cancelled by user' ELSE e.message END,
                    'error': CASE WHEN e.status = 'failed' THEN e.message END,
                    'created_at': coalesce(a.created_at, e.created_at), 'updated_at': e.updated_at, 'refused': a.refused, 'unknown': a.unknown}
              END) AS s
          FROM job_events GROUP BY job_id)"""),
    "recommend_stages_stream": ("openings " + _SERVICE_READS, f"""
        SELECT o.request_id, CASE WHEN o.request_id % 5 < 2 THEN 'cancelled' ELSE 'completed' END AS status,
               CASE WHEN o.request_id % 5 < 2 THEN 0 ELSE 100 END::INT AS progress,
               CASE WHEN o.request_id % 5 < 2 THEN 'Job cancelled by user' ELSE 'Playlist created successfully!' END AS message,
               CASE o.request_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END::BIGINT AS told,
               CASE WHEN o.request_id % 5 < 2 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS songs
        FROM openings o LEFT JOIN (SELECT request_id, count(*) AS n FROM ({_SERVICE}) GROUP BY 1) s USING (request_id)"""),
    "recommend_stream": (_SERVICE_READS, _SERVICE),
}

_CHECKS["topk_batch_pruned"] = _CHECKS["topk_batch"]

# Lengths and row numbers are 32-bit in Spark, 64-bit here.
_NARROW: dict[str, list[str]] = {
    "chars": ["scan_lyrics_csv", "clean_corpus", "fetch_lyrics", "dedup_corpus", "passages", "truncate_lyrics",
              "render_prompt", "clean_lyrics"],
    "rank": ["topk_batch", "topk_batch_pruned", "topk_batch_two_stage", "rerank_neutral", "rerank_strict", "recommend", "recommend_cli",
             "recommend_stream", "rank_results", "pick_playlist_in_range"],
    "sample_no": ["quota_sample"],
}


def _narrowed(name: str, select: str) -> str:
    for column, names in _NARROW.items():
        if name in names:
            select = f"SELECT * REPLACE ({column}::INT AS {column}) FROM ({select})"
    return select


CHECKS: dict[str, str] = {name: _statement(reads, _narrowed(name, select)) for name, (reads, select) in _CHECKS.items()}
