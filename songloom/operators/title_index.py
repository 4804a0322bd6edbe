"""Titles searched by many terms at once, through an index of their pieces of some lengths.

A term is a pattern. What any title that it matches must contain can be read off it: runs of plain
characters that are not optional. The longest pieces of a run that are stored are looked up in the
postings, the rarest one of each term; only titles that have it are tested with the pattern itself.
Lengths double, so a piece is more than half as long as its run up to the longest: the more titles
there are to tell apart, the longer the runs that do so, and the work grows with what the terms
have in common with titles, not with terms times titles.

A term from which nothing can be read (``a.c``, ``one|two``, ``..``) is tested against every title,
as the plain form does; such terms are kept apart, in blocks of ``PLAIN_TERMS``.

Case does not matter for ASCII letters, as in the plain form; only runs of ASCII characters are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.session import settle

# Lengths of the pieces of titles that are stored. A title has fewer pieces of each than characters.
GRAMS = (3, 6, 12, 24)
# Pieces of a term that are looked up, the rarest ones.
LOOKED_UP = 1
PLAIN_TERMS = 500

# What makes the character or group before it optional or repeated, and what is no plain character.
_OPTIONAL = "?*{"
_SPECIAL = set(".^$+()[]{}|\\?*")


def required_runs(pattern: str) -> list[str]:
    """Runs of plain characters that every match of a pattern contains, as far as they are easy to see.

    Groups, character classes and escapes end a run and are not looked into; with an alternative or
    a flag outside of them nothing is required.
    """
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        following = pattern[i + 1:i + 2]
        if c == "\\":
            if following in "Qx0123456789" or following.isalpha():  # classes, quotations, references, codes
                if following in ("Q", "E"):
                    return []
                plain = None
            else:
                plain = following
            i += 2
            after = pattern[i:i + 1]
            if depth == 0 and plain and after not in tuple(_OPTIONAL):
                run += plain
            elif depth == 0:
                runs.append(run)
                run = ""
            continue
        if c == "[":
            end = i + 1 + (pattern[i + 1:i + 2] == "^")
            end += pattern[end:end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            if "[" in pattern[i + 1:end] or "&&" in pattern[i + 1:end]:
                return []
            i = end
        elif c == "(":
            if pattern[i + 1:i + 2] == "?" and pattern[i + 2:i + 3] not in (":", "="):
                return []
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return []
        if c in _SPECIAL or depth or following in tuple(_OPTIONAL):
            if depth == 0 and c == "{":
                end = pattern.find("}", i)
                i = end if end > 0 else i
            if run:
                runs.append(run)
            run = ""
            # A character repeated at least once stands there; what follows it need not touch it.
        else:
            run += c
            if following == "+":
                runs.append(run)
                run = ""
        i += 1
    return [r for r in [*runs, run] if r] if depth == 0 else []


def term_grams(pattern: str) -> list[str]:
    """Pieces, lower-cased, that every match has, of each run the longest ones stored; none where that cannot be told."""
    pieces = set()
    for run in required_runs(pattern):
        for plain in re.findall(r"[\x00-\x7F]+", run):
            gram = max((n for n in GRAMS if n <= len(plain)), default=0)
            pieces.update(plain[i:i + gram].lower() for i in range(len(plain) - gram + 1) if gram)
    return sorted(pieces)


def _grams(text: Column) -> Column:
    """The different pieces of a text."""
    lowered = F.lower(text)

    def pieces(gram: int) -> Column:
        starts = F.when(F.length(lowered) >= gram, F.sequence(F.lit(1), F.length(lowered) - gram + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(lowered, i, F.lit(gram))))

    return F.concat(*[pieces(gram) for gram in GRAMS])


def store_title_index(songs: DataFrame) -> DataFrame:
    """The postings (gram, song_id) of all titles, stored."""
    return settle(songs.select("song_id", F.explode(_grams(F.col("title"))).alias("gram")).repartition(
        "gram", "song_id").sortWithinPartitions("gram", "song_id"), "title-index")


def _with_grams(terms: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(term_grams)

    return terms.withColumn("grams", grams(F.col("term")))


def _tested(title: Column, term: Column) -> Column:
    """Whether a title contains a pattern."""
    return F.coalesce(F.rlike(title, F.concat(F.lit("(?i)"), term)), F.lit(False))


def candidate_pairs(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(term, song_id) for titles that have the rarest piece of a term (term, grams)."""
    asked = terms.select("term", F.explode("grams").alias("gram"))
    wanted = settle(asked, "term-grams")
    counts = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(
        F.count(F.lit(1)).alias("titles"))
    rarest = wanted.join(settle(counts, "gram-counts"), "gram", "left").groupBy("term").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram"))), 1, LOOKED_UP).alias("g"))
    # A term's list has a few letters; one of its pieces that no title has means no match.
    looked_up = rarest.filter(F.col("g")[0]["titles"] > 0).select("term", F.size("g").alias("needed"), F.explode("g.gram").alias("gram"))
    found = index.join(settle(looked_up, "looked-up"), "gram").groupBy("term", "song_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
    return found.filter("n = needed").select("term", "song_id")


def match_terms(songs: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(term, and the song's columns) for each song whose title contains a term of a table (``term``).

    ``index``: what :func:`store_title_index` gives for these songs.
    """
    read = settle(_with_grams(terms.select("term").filter(F.col("term").isNotNull()).distinct()), "terms")
    pairs = settle(candidate_pairs(read.filter(F.size("grams") > 0), index), "title-candidates")
    found = pairs.join(songs, "song_id").filter(_tested(F.col("title"), F.col("term")))
    out = found.select("term", *songs.columns)
    plain = read.filter(F.size("grams") == 0).select("term")
    # Terms that can only be tested one by one: this many at a time, as a list in the row's own plan.
    blocks = plain.withColumn("block", F.floor(F.monotonically_increasing_id() / PLAIN_TERMS)).groupBy("block").agg(
        F.collect_list("term").alias("list"))
    for row in blocks.toLocalIterator():
        hits = F.filter(F.array(*[F.lit(t) for t in row["list"]]), lambda t: _tested(F.col("title"), t))
        out = out.unionByName(songs.withColumn("term", F.explode(hits)).select("term", *songs.columns))
    return out


def found_terms(songs: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """One row per term of a table: how many songs it matches, and whether any."""
    counts = match_terms(songs.select("song_id", "title"), terms, index).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.select("term").filter(F.col("term").isNotNull()).distinct().join(counts, "term", "left").select(
        "term", F.coalesce("n", F.lit(0)).alias("matches"), (F.coalesce("n", F.lit(0)) > 0).alias("found"))
