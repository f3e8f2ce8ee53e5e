"""The Merkle manifest against a tree built by hand in plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

from ripplegraph.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(hashes, fan=3):
    """The root and, for each leaf, its (left, right) siblings from below."""
    paths, own = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        for at in range(0, len(hashes), fan):
            run = hashes[at : at + fan]
            for j, leaves in enumerate(own[at : at + fan]):
                for leaf in leaves:
                    paths[leaf].append((run[:j], run[j + 1 :]))
        own = [sum(own[at : at + fan], []) for at in range(0, len(hashes), fan)]
        hashes = [h(*hashes[at : at + fan]) for at in range(0, len(hashes), fan)]
    return hashes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return h(*[encoded(x) for x in r])

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = tree([leaf(r) for r in sources[s]])
    root, tops = tree([built[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(sources[s], built[s][1]):
            cut = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", "")
            folded = leaf((*r[:4], cut))
            for left, right in path + top:
                folded = h(*left, folded, *right)
            proof = h(*[x for left, right in path + top for x in (*left, *right)])
            out.append((r[0], leaf(r), built[s][0], root, proof, folded, folded == root))
    return out


def result(docs, spark):
    rows, root = manifest.manifest(manifest.document_leaves(docs))
    return Counter((r.doc_id, r.leaf, r.subroot, root, r.proof_sha256, r.folded_root, r.folded_root == root) for r in rows.collect())


COLUMNS = "doc_id", "source", "lang", "n_chars", "text"


@pytest.mark.parametrize("heavy", [2000, 6])
def test_manifest_of_odd_rows(spark, odd_docs, heavy, monkeypatch):
    """Null sources, ids and texts, repeated rows and clashing columns; climbed through heavy nodes alone, and through light ones first."""
    monkeypatch.setattr(manifest, "HEAVY", heavy)
    want = Counter(plain([tuple(r) for r in odd_docs.select(*COLUMNS).collect()]))
    assert result(odd_docs, spark) == want
    assert {w[6] for w in want} == {True, False}


def test_manifest_of_none_and_one(spark, no_docs, odd_docs):
    rows, root = manifest.manifest(manifest.document_leaves(no_docs))
    assert rows.count() == 0 and root is None
    one = odd_docs.where("doc_id = 3")
    assert result(one, spark) == Counter(plain([tuple(r) for r in one.select(*COLUMNS).collect()]))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) != "-1"


def test_many_equal_rows_are_leaves_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(manifest, "HEAVY", 10)
    docs = spark.sql("SELECT 7L AS doc_id, 'é' AS source, cast(NULL AS string) AS lang, 3 AS n_chars, 'a\nb' AS text FROM range(0, 50, 1, 7) UNION ALL SELECT id, 'z', 'en', 1, 'x' FROM range(9)")
    assert result(docs, spark) == Counter(plain([tuple(r) for r in docs.select(*COLUMNS).collect()]))


def test_a_changed_source_changes_its_subroot_alone(spark, odd_docs):
    rows, root = manifest.manifest(manifest.document_leaves(odd_docs))
    changed, other = manifest.manifest(manifest.document_leaves(odd_docs.selectExpr("doc_id", "source", "lang", "n_chars", "if(source = 'b', 'else', text) AS text")))
    subroots = lambda r: {x.subroot for x in r.select("subroot").distinct().collect()}
    assert root != other and len(subroots(rows) - subroots(changed)) == 1
