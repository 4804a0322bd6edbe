"""Secret scans: fixed patterns, and strings that look random to two character models.

DataFrame functions only. Two Markov models of characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples; a long token is reported when the
log-likelihood ratio of the models is high enough.

Defined results: a missing or empty text holds no secrets; repeated rows are scanned each for
itself; an empty table gives an empty result; without samples both models are uniform and
report nothing. Columns other than the text are passed on, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the scan reports in any case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{4,}"

CODES = 128
# Documents the models are counted from, at most, chosen by a hash of the id.
SAMPLE_DOCS = 2_000
# Mean log-likelihood ratio per character from which a token counts as random.
LEAST_RATIO = 0.75

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Where the pattern matches, leftmost first and without overlap; code points, end exclusive.

    Texts between the matches and the matches themselves are laid end to end. Matches whose
    ``group`` is shorter than ``least`` take up their place but are not reported.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(F.length(part["part"]) >= max(least, 1), F.concat(seen["found"], span)).otherwise(
                seen["found"]).alias("found"))

    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(parts, nothing, step, lambda seen: seen["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then by kind."""
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, 2, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _code(character: Column) -> Column:
    return F.least(F.ascii(character), F.lit(CODES - 1))


def labelled_samples(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, secret) from at most ``docs`` documents: what the patterns find, and the words."""
    rows = documents.select(F.xxhash64(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = rows.select("key").distinct().orderBy("key").limit(docs)
    text = rows.join(F.broadcast(chosen), "key", "left_semi").select("text")
    found = F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))
    return text.select(F.explode(found).alias("value"), F.lit(True).alias("secret")).filter(
        F.length("value") >= ASSIGN_LEAST).union(
            text.select(F.explode(words).alias("value"), F.lit(False).alias("secret")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, from (value, secret) rows.

    Counted on the executors; what comes here is a row per pair of characters and label.
    """
    pair = F.explode(F.transform(
        F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.struct(
            _code(F.substr("value", i, F.lit(1))).alias("a"), _code(F.substr("value", i + 1, F.lit(1))).alias("b"))))
    rows = samples.filter(F.length("value").between(2, 4096)).groupBy("value", "secret").count().select(
        "secret", "count", pair.alias("pair")).groupBy("secret", "pair.a", "pair.b").agg(F.sum("count").alias("n"))
    # Characters that an identifier can be made of; each pair is taken as seen once more than it was.
    known = [c for c in range(CODES) if chr(c).isalnum() or chr(c) in "+/_=-"]
    counts = {(s, a, b): 1.0 for s in (True, False) for a in known for b in known}
    for row in rows.collect():
        key = (row["secret"], row["a"], row["b"])
        if key in counts:
            counts[key] += row["n"]
    totals: dict[tuple[bool, int], float] = {}
    for (s, a, _), n in counts.items():
        totals[s, a] = totals.get((s, a), 0.0) + n
    table = [0.0] * (CODES * CODES)
    for a in known:
        for b in known:
            table[a * CODES + b] = math.log(counts[True, a, b] / totals[True, a]) - math.log(
                counts[False, a, b] / totals[False, a])
    return table


def mean_ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio over the pairs of characters of a token."""
    model = F.lit(table)

    def step(seen: Column, character: Column) -> Column:
        code = _code(character)
        gain = F.when(seen["last"] < 0, 0.0).otherwise(F.element_at(model, seen["last"] * CODES + code + 1))
        return F.struct(code.alias("last"), (seen["sum"] + gain).alias("sum"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    characters = F.regexp_extract_all(token, F.lit("."), F.lit(0))
    return F.aggregate(characters, start, step, lambda seen: seen["sum"] / F.greatest(F.length(token) - 1, F.lit(1)))


def find_secrets(documents: DataFrame, table: list[float], text_col: str = "text", base_col: str = "base_spans",
                 spans_col: str = "spans", least: float = LEAST_RATIO) -> DataFrame:
    """Add the spans of the fixed patterns, and all spans: those and the random-looking tokens.

    A token that overlaps a span of the patterns is left to them. A span is (start, kind, end),
    kind being the place in ``KINDS``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = _spans(text, TOKEN, 3)
    free = F.filter(tokens, lambda t: ~F.exists(
        F.col(base_col), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    random = F.filter(free, lambda t: mean_ratio(
        F.substr(text, (t["start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int")), table) >= least)
    return documents.withColumn(base_col, base_spans(text)).withColumn(
        spans_col, F.array_sort(F.concat(F.col(base_col), random)))


def describe(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
