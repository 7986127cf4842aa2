"""Merkle manifest against a plain tree over Python lists."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import merkle_manifest as M
from fieldpulse.llm import queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    """(root, the (left, right) siblings of each leaf, level by level)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, p in zip(paths, at):
            run = level[p // fanout * fanout:(p // fanout + 1) * fanout]
            path.append(("".join(run[:p % fanout]), "".join(run[p % fanout + 1:])))
        at = [p // fanout for p in at]
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return (level or [None])[0], paths


def expected(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((leaf(*r[:5]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    subs = {s: tree([x[0] for x in groups[s]], fanout) for s in order}
    root, tops = tree([subs[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for (digest, r), path in zip(groups[s], subs[s][1]):
            low = r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            got = leaf(*r[:4], low) if hit else digest
            for left, right in path + top:
                got = sha(left + got + right)
            out.append((r[0], digest, subs[s][0], root, sha("".join(a + b for a, b in path + top)), got, got == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def run(spark, tmp_path, docs):
    path = str(tmp_path / "in")
    docs.write.parquet(f"{path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, path)
    return sorted([tuple(r) for r in got.collect()], key=key)


def test_query_equals_a_plain_tree(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = queries.op11_merkle_manifest(spark, data_dir).collect()
    assert sorted(map(tuple, got)) == sorted(expected([tuple(r) for r in rows]))
    assert {r.verified for r in got} == {True, False}


def test_odd_rows(spark, odd, tmp_path):
    docs = odd.unionByName(odd.filter("doc_id < 3"))            # ties, repeated rows, nulls in every column
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert run(spark, tmp_path, docs) == sorted(expected(rows), key=key)


def test_empty_table_and_single_rows(spark, empty, odd, tmp_path):
    assert run(spark, tmp_path / "none", empty) == []
    one = odd.filter("doc_id = 7")
    (row,) = run(spark, tmp_path / "one", one)
    assert row[1] == row[2] == row[3] and row[4] == sha("")     # a lone leaf is its own root and has no siblings


@pytest.mark.parametrize("fanout", [4, 16])
def test_hot_group_any_fanout(spark, fanout):
    """A group with a third of all rows beside 66 groups of three; three levels with a fanout of 4."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 100}", None, i, f"T{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = M.Manifest(df, M.leaf_of(*[F.col(c) for c in df.columns]), F.col("source"), F.col("doc_id"),
                   {"doc_id": F.col("doc_id"), "digest": F.col("text"), "g": F.col("source")}, fanout)
    proofs = m.proofs()
    checked = M.verify(proofs, "leaf")
    got = sorted((r.doc_id, r.leaf, r.subroot, r.root, r.p) for r in proofs.select(
        "doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("path")).alias("p")).collect())
    assert got == sorted(e[:5] for e in expected(rows, fanout))
    assert checked.filter("NOT verified").count() == 0
    assert m.root().collect()[0].root == got[0][3]
    assert m.subroots().count() == len({r[1] for r in rows})
    moved = M.verify(proofs.withColumn("other", F.sha2("leaf", 256)), "other")
    assert moved.filter("verified").count() == 0
