from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexcheck.llm import merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes: list[str], at: int, fanout: int):
    """(root, siblings as (before, after) per level) of one node, level by level."""
    path = []
    while len(nodes) > 1:
        lo = at - at % fanout
        run = nodes[lo : lo + fanout]
        path.append((run[: at - lo], run[at - lo + 1 :]))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at //= fanout
    return nodes[0], path


def expected(rows: list[tuple], fanout: int = 2) -> list[tuple]:
    """rows: doc_id, source, lang, n_chars, text."""
    key = lambda x: b"" if x is None else b"\x01" + x.encode()
    groups: dict = {}
    for r in rows:
        groups.setdefault(key(r[2]), []).append(r)
    order = {g: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g, m in groups.items()}
    subroots = [climb([leaf_of(r) for r in order[g]], 0, fanout)[0] for g in sorted(order)]
    out = []
    for k, g in enumerate(sorted(order)):
        leaves = [leaf_of(r) for r in order[g]]
        for i, r in enumerate(order[g]):
            path = climb(leaves, i, fanout)[1] + climb(subroots, k, fanout)[1]
            root = climb(subroots, k, fanout)[0]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            fold = leaf_of((*r[:3], r[3] + 1, r[4])) if tampered else leaves[i]
            for before, after in path:
                fold = h(*before, fold, *after)
            out.append((r[0], leaves[i], subroots[k], root, h(*(x for b, a in path for x in (*b, *a))), fold, fold == root))
    return sorted(out, key=str)


ROWS = [(i, f"s{i % 3}", ["en", "de", None, "", "zz", "é"][i * i % 6], None if i % 9 == 0 else i, None if i % 11 == 0 else "tëxt\n" * (i % 5)) for i in range(150)]
ROWS += [ROWS[3], ROWS[3], (3, "other", *ROWS[3][2:]), (None, None, None, None, None), (None, "a", "en", 1, "b"), (151, "s", "lone", 2, "one leaf")]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (2, 10), (3, 1)])
def test_manifest_matches_brute_force(spark, fanout, levels):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"tree": F.lit("x"), "place": F.lit(1), "key": F.lit(2)}).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf([F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS]))
    checked = merkle.manifest(docs, carried={"claimed": tampered}, fanout=fanout, levels=levels, finish=merkle.Check("claimed"))
    found = [tuple(r) for r in checked.collect()]
    assert sorted(found, key=str) == expected(ROWS, fanout)


def test_query_over_a_table_without_rows_and_one_row(spark, tmp_path):
    for rows, n in (([], 0), ([(5, "a", None, 1, "t")], 1)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found = merkle.op13_merkle_manifest(spark, f"{tmp_path}/{n}").collect()
        assert len(found) == n
        if n:
            assert found[0].leaf == found[0].subroot == found[0].root == leaf_of(rows[0]) and found[0].proof_sha256 == h()


def test_many_groups_and_equal_rows(spark):
    rows = [(i % 4, "s", f"g{i:03}", 1, "t") for i in range(70)] + [(1, "s", "hot", 1, "same")] * 60
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, levels=3).collect()
    assert all(merkle.fold_proof(r.leaf.hex(), r.steps) == r.root for r in found)
    proofs = [h(*(x for pair in merkle.siblings(r.steps) for x in pair)) for r in found]
    want = [r[:5] for r in expected(rows)]
    assert sorted([(r.key, r.leaf.hex(), r.subroot, r.root, p) for r, p in zip(found, proofs, strict=True)], key=str) == sorted(want, key=str)
