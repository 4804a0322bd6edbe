"""The Merkle manifest against a plain version, for every shape of tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from check_results import compare, open_tables
from songloom.llm import merkle

SF = "/root/testdata/sf0.001"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain(leaves, fanout=3):
    """Root and the siblings of each leaf, level by level."""
    paths, nodes, below = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                step = ("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k))
                for i in below[k]:
                    paths[i].append(step)
        below = [sum((below[k] for k in run), []) for run in runs]
        nodes = [_h(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], paths


def _manifest(rows):
    """(source, doc_id, leaf) -> sorted (leaf, witness), subroots and root, as plain Python."""
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    sources = sorted({r[0] for r in rows}, key=order)
    own, roots = [], []
    for s in sources:
        leaves = sorted((r for r in rows if r[0] == s), key=lambda r: (order(r[1]), r[2]))
        root, paths = _plain([r[2] for r in leaves])
        roots.append(root)
        own.append([(r, path) for r, path in zip(leaves, paths, strict=True)])
    root, upper = _plain(roots)
    return root, sorted(repr((*r, path + upper[k], roots[k])) for k, part in enumerate(own) for r, path in part)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 81, 100])
def test_frontier_equals_the_whole_tree(n):
    leaves = [_h(str(i)) for i in range(n)]
    tree = merkle.Frontier()
    for leaf in leaves:
        tree.append(leaf)
    root = tree.close(merkle._levels(n, 3, 40))
    assert (root, tree.witnesses) == _plain(leaves)


def test_witnesses_are_known_as_soon_as_their_subtree_is_complete():
    leaves = [_h(str(i)) for i in range(20)]
    tree = merkle.Frontier()
    for n, leaf in enumerate(leaves, 1):
        tree.append(leaf)
        done = n // 9 * 9
        assert [w[:2] for w in tree.witnesses[:done]] == [w[:2] for w in _plain(leaves)[1][:done]]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_the_plain_one(spark, height):
    rng = random.Random(height)
    rows = [(s, i if i else None, _h(s or "", str(i))) for s, n in
            [("a", 1), ("b", 2), ("é", 3), ("Z", 10), (None, 9), ("hot", 130), ("", 28), *[(f"s{i}", rng.randint(1, 12)) for i in range(9)]]
            for i in range(n)]
    rows += rows[:3] + rows[40:44]  # repeated rows
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows],
                                  "source string, doc_id long, leaf string, grp string, `root` string, pos string")
    out = merkle.build_manifest(frame.repartition(4), height=height)
    assert out.columns == ["source", "doc_id", "leaf", "grp", "pos", "witness", "subroot", "root"]
    got = out.collect()
    root, wanted = _manifest(rows)
    assert {r["root"] for r in got} == {root} and {(r["grp"], r["pos"]) for r in got} == {("x", "z")}
    found = sorted(repr((r["source"], r["doc_id"], r["leaf"], [(w["left"], w["right"]) for w in r["witness"]], r["subroot"])) for r in got)
    assert found == wanted
    folded = out.select(merkle.fold(F.col("leaf"), F.col("witness")).alias("f")).distinct().collect()
    assert [r["f"] for r in folded] == [root]


def test_leaves_of_odd_rows(documents, rows):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    got = documents.select("doc_id", merkle.leaf_digest(*fields).alias("leaf")).collect()
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted((r["doc_id"] or 0, r["leaf"]) for r in got) == sorted(
        (r["doc_id"] or 0, _h(*[one(r[f]) for f in fields])) for r in rows)


def test_no_documents(none):
    leaves = none.select("doc_id", "source", F.lit("").alias("leaf"))
    out = merkle.build_manifest(leaves)
    assert out.columns == ["doc_id", "source", "leaf", "witness", "subroot", "root"] and out.count() == 0


def test_query_agrees_with_sql(spark):
    ok, said = compare(spark, open_tables(SF), SF, "op11_merkle_manifest")
    assert ok, said
