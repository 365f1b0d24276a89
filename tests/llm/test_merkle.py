"""The Merkle manifest: against SQL, against whole trees built in plain Python, and on awkward tables."""

import hashlib
import zlib

import pytest

from tessera.llm import merkle, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(told, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))


def tree(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


def brute(docs):
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
    trees = {s: tree([leaf(d, d["text"]) for d in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for place, d in enumerate(by[s]):
            text = d["text"]
            if text is not None and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, proof = leaf(d, text), ""
            for whole, pos in ((trees[s], place), (top, at)):
                for nodes in whole[:-1]:
                    start = pos // 3 * 3
                    left, right = "".join(nodes[start:pos]), "".join(nodes[pos + 1 : start + 3])
                    node, proof, pos = h(left, node, right), proof + left + right, pos // 3
            out.append((d["doc_id"], leaf(d, d["text"]), trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_sql(same):
    same(queries.QUERIES["op11_merkle"], queries.SQL["op11_merkle"])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 26, 27, 28, 100, 243])
def test_traversal_gives_every_path(n):
    leaves = [h(str(i)) for i in range(n)]
    whole = tree(leaves)
    walked = merkle.Traversal(leaves, merkle.levels(n))
    assert walked.root() == whole[-1][0]
    for i, path in enumerate(walked):
        assert len(path) == len(whole) - 1
        node = leaves[i]
        for left, right in path:
            node = h(left, node, right)
        assert node == whole[-1][0]


def test_traversal_holds_little():
    most = {}
    for height in (4, 5, 6, 7):
        walked = merkle.Traversal([h(str(i)) for i in range(3**height)], height)
        for _ in walked:
            pass
        most[height] = walked.most
    assert all(most[k] <= 8 * k for k in most), most


@pytest.mark.parametrize("height", [1, 2, 7])
def test_blocks_of_any_height_agree(spark, height):
    """Small blocks, so that trees have several levels of them, with ragged ends; one source is hot."""
    rows = [(i * 7 % 301, f"text {i}\nline", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(301)]
    docs = spark.createDataFrame(rows, DOC)
    assert sorted(map(tuple, merkle.audited(docs, height).collect()), key=repr) == brute([r.asDict() for r in docs.collect()])


def test_awkward_rows(spark):
    """Nulls anywhere, blanks, repeats and ties, a long text, and extra columns whose names clash."""
    from pyspark.sql import functions as F

    rows = [
        (None, "a\nb", None, None, None),
        (None, "a\nb", None, None, None),
        (1, None, "en", "s", 3),
        (1, "", "en", "s", 3),
        (1, "", "en", "s", 3),
        (-4, "\n\n", "", "", 0),
        (2, "x" * 300_000 + "\n" + "é\U0001f600", "de", "é", 300_003),
        (3, "-", "-", "0", 1),
        (4, "3:abc", "1:-", "1s", 1),
        (10, "one\ntwo", "en", "\U0001f600", 7),
    ]
    docs = spark.createDataFrame(rows, DOC)
    clash = docs.withColumns({c: F.lit("clash") for c in "tree digest pos n place part row block path root subroot leaf source_ copied_ verified".split()})
    got = sorted(map(tuple, merkle.audited(clash).collect()), key=repr)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert all(r[-1] for r in got if r[0] is None) and not next(r for r in got if r[0] == 10)[-1] == (zlib.crc32(b"10") % 2 == 0)
    one = merkle.manifest(docs.where("doc_id = 10")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def test_empty(spark):
    df = merkle.audited(spark.createDataFrame([], DOC))
    assert df.collect() == [] and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
