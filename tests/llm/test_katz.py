"""Katz scores against a plain model, whose probabilities are added up over all words."""

import collections
import math
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom.llm import catalog, katz

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _tokens(text):
    return [*WORD.findall((text or "").translate(_LOWER)), None]


def _held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _discounts(counts):
    n = collections.Counter(counts)
    out = {}
    for r in range(1, 6):
        common = 6 * n[6] / n[1] if n[1] else 1
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return lambda r: out[r] * r if r <= 5 else r


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = collections.Counter(), collections.Counter()
        for text in texts:
            tokens = _tokens(text)
            self.words.update(tokens)
            self.pairs.update(zip(["<begin>", *tokens[:-1]], tokens, strict=True))
        self.total = sum(self.words.values())
        self.kept_1, self.kept_2 = _discounts(self.words.values()), _discounts(self.pairs.values())
        rest = self.total - sum(map(self.kept_1, self.words.values()))
        self.scale, self.unknown = (1 / self.total, rest / self.total) if rest > 0 else (1 / (self.total + 1),) * 2
        self.followers = collections.defaultdict(dict)
        for (v, w), r in self.pairs.items():
            self.followers[v][w] = r

    def single(self, w):
        return self.kept_1(self.words[w]) * self.scale if w in self.words else self.unknown

    def probability(self, v, w):
        seen = self.followers.get(v)
        if not seen:
            return self.single(w)
        n = sum(seen.values())
        left = (n - sum(map(self.kept_2, seen.values()))) / n
        whole = n
        if left <= 0:
            left, whole = 1 / (n + 1), n + 1
        if w in seen:
            return self.kept_2(seen[w]) / whole
        return left / (1 - sum(map(self.single, seen))) * self.single(w)

    def score(self, text):
        tokens = _tokens(text)
        pairs = zip(["<begin>", *tokens[:-1]], tokens, strict=True)
        base = sum(math.log10((self.words[w] + 0.5) / (self.total + 0.5 * (len(self.words) + 1))) for w in tokens)
        return len(tokens), sum(w in self.words for w in tokens), base, sum(math.log10(self.probability(*p)) for p in pairs)


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 700, "part_tokens": 2000, "spread_tokens": 40}])
def test_scores_equal_the_plain_ones(documents, rows, sizes):
    small = [r for r in rows if not (r["text"] and len(r["text"]) > 20_000)]
    model = Plain([r["text"] for r in small if not _held(r["doc_id"])])
    frame = documents.filter("text IS NULL OR length(text) <= 20000").withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    got = katz.score_documents(frame, **sizes).collect()
    assert {r["train_tokens"] for r in got} == {model.total}
    found = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    wanted = sorted((r["doc_id"] or -1, _held(r["doc_id"]), *model.score(r["text"])) for r in small)
    assert [f[:4] for f in found] == [w[:4] for w in wanted]
    assert np.allclose([f[4:] for f in found], [w[4:] for w in wanted], rtol=1e-9)


def test_probabilities_add_up_to_one(rows):
    model = Plain([r["text"] for r in rows[:60]])
    for v in ["<begin>", "the", *list(model.followers)[::40]]:
        assert math.isclose(sum(model.probability(v, w) for w in [*model.words, "\x00unknown"]), 1, rel_tol=1e-9)


def test_weights_of_contexts_that_leave_nothing_over():
    keep = katz.discounts([10, 5, 3, 2, 1, 1])
    payload = [katz.pack(np.array([4])), katz.pack(np.array([20])), *[katz.pack(np.array([0]))] * 5, katz._floats(np.array([0.25]))]
    table = katz._batch([(0, 7, katz.WORDS, [katz.pack(np.array([4, 5]))] * 3, None), (0, -1, katz.SUMS, payload, None)])
    (row,) = katz._weigh(table, keep, 0.1).to_pylist()
    weight, code = katz._from_floats(row["payload"][0]), katz.unpack(row["payload"][1])
    assert np.allclose(weight, [1 / 21 / 0.75, 1]) and code.tolist() == [41, 0]


def test_discounts():
    keep = katz.discounts([100, 40, 20, 12, 8, 5])
    common = 6 * 5 / 100
    assert np.allclose(keep, [0, *[((r + 1) * n / (r * m) - common) / (1 - common)
                                   for r, m, n in ((1, 100, 40), (2, 40, 20), (3, 20, 12), (4, 12, 8), (5, 8, 5))]])
    assert np.allclose(katz.discounts([0] * 6)[1:], [(r - 0.5) / r for r in range(1, 6)])


@pytest.mark.parametrize("values", [[], [0], [255, 256], [1 << 40, 3], list(range(70_000))])
def test_packed_numbers_come_back(values):
    assert katz.unpack(katz.pack(np.array(values, np.int64))).tolist() == values


def test_nothing_to_learn_from_and_no_documents(documents, none, rows):
    out = katz.score_documents(documents.withColumn("held_out", F.lit(True))).collect()
    assert len(out) == len(rows) and all(r["score"] == r["base_score"] == r["n_known"] == r["train_tokens"] == 0 for r in out)
    assert katz.score_documents(none.withColumn("held_out", F.lit(False))).count() == 0


def test_query_takes_the_whole_table(spark):
    rows = catalog.op12_katz_scores(spark, SF).collect()
    assert len(rows) == 200 and all(r["held_out"] == _held(r["doc_id"]) and r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
