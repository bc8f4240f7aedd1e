"""Merkle manifests and proofs against a plain tree."""

import hashlib
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stridelake.llm import merkle as M
from tests.oracle import compare, views

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, up long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified by the rule itself."""

    def tree(nodes):
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for leaf_, i in enumerate(at):
                run = range(i - i % 3, min(len(level), i - i % 3 + 3))
                paths[leaf_].append((level[run.start : i], level[i + 1 : run.stop]))
            level = [H(*level[k : k + 3]) for k in range(0, len(level), 3)]
            at = [i // 3 for i in at]
        return level[0], paths

    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        by.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), text, lang, n_chars))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    made = {s: tree([r[1] for r in by[s]]) for s in order}
    root, tops = tree([made[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (doc_id, own, text, lang, n_chars), path in zip(by[s], made[s][1]):
            path = path + tops[k]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(doc_id, s, lang, n_chars, text)
            for left, right in path:
                folded = H(*left, folded, *right)
            out.append((doc_id, own, made[s][0], root, H(*(x for left, right in path for x in left + right)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def write(tmp_path, rows):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    table = pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})
    pq.write_table(table.append_column("rank", pa.array(["x"] * len(rows))).append_column("up", pa.array([1] * len(rows))), tmp_path / "documents.parquet")
    return str(tmp_path)


def some(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "\n", "a\nb", "é\n\nü 😀", "plain", "q" * 50 + "\n"])
            rows.append((rng.randrange(10**6), text, rng.choice([None, "de"]), source, rng.choice([None, 0, 7])))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2}, {"a": 3, None: 1}, {"": 4, "b": 1, "ä": 10}, {None: 28, "a": 9, "b": 81, "z": 82}, {str(k): 1 + k % 3 for k in range(40)}])
def test_small_trees(spark, tmp_path, sizes):
    rows = some(sizes)
    assert found(M.op11_merkle(spark, write(tmp_path, rows))) == plain(rows)


def test_large_trees_ties_and_repeated_rows(spark, tmp_path):
    rows = some({None: 730, "hot": 2500, "b": 729, "c": 30})
    rows += rows[:5] + [(None, "x\ny", None, "hot", 1), (None, "x\ny", None, "hot", 1), (rows[800][0], "other", "de", "hot", 3)]
    assert found(M.op11_merkle(spark, write(tmp_path, rows))) == plain(rows)


def test_more_levels_than_a_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "CELL_LEVELS", 2)
    monkeypatch.setattr(M, "CELL", 9)
    rows = some({"a": 500, "b": 100, "c": 1, "d": 10} | {f"s{k}": 1 for k in range(30)})
    assert found(M.op11_merkle(spark, write(tmp_path, rows))) == plain(rows)


def test_empty(spark, tmp_path):
    df = M.op11_merkle(spark, write(tmp_path, []))
    assert df.collect() == [] and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_oracle(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    assert compare(M.op11_merkle(spark, base), M.ORACLE_SQL, views(base)) > 0
    rows = some({None: 5, "a": 40, "é": 1, "b": 3})
    base = write(tmp_path, rows)
    assert compare(M.op11_merkle(spark, base), M.ORACLE_SQL, views(base)) == len(rows)
