"""The Merkle manifest against a plain recursion, across tiers and on awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import Row

from topicloom.llm import manifest

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    out = ""
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        x = r[name]
        if x is None:
            out += "-"
            continue
        x = str(x + more) if name == "n_chars" else str(x)
        out += f"{len(x.encode())}:{x}"
    return h(out)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def way(of, k):
    out = []
    for nodes in of[:-1]:
        out.append((k & 1, nodes[k ^ 1] if k ^ 1 < len(nodes) else None))
        k >>= 1
    return out


def expected(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for lang in langs}
    built = {lang: levels([leaf(r) for r in trees[lang]]) for lang in langs}
    top = levels([built[lang][-1][0] for lang in langs])
    out = []
    for j, lang in enumerate(langs):
        for k, r in enumerate(trees[lang]):
            steps = way(built[lang], k) + way(top, j)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf(r, 1) if bad else leaf(r)
            for right, beside in steps:
                node = h(node) if beside is None else h(beside, node) if right else h(node, beside)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), built[lang][-1][0], root, h(*(s for _, s in steps if s)), node, node == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("height", [2, 3, 12])
def test_documents(spark, scratch, height):
    """Low heights make several tiers of small runs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(manifest.merkle_manifest(docs, scratch, height)) == expected([r.asDict() for r in docs.collect()])


def test_awkward_rows(awkward, scratch):
    rows = [r.asDict() for r in awkward.collect()]
    assert found(manifest.merkle_manifest(awkward, scratch)) == expected(rows)


def test_null_ids_repeats_and_many_languages(spark, scratch):
    rows = [Row(doc_id=None if k % 7 == 0 else k % 11, source=None, lang=None if k % 5 == 0 else f"é{k % 37}", n_chars=None if k % 3 else k, text="same" if k % 2 else None) for k in range(120)]
    rows.append(Row(doc_id=14, source="s", lang="x", n_chars=2**63 - 1, text="long"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(manifest.merkle_manifest(docs, scratch, 2)) == expected([r.asDict() for r in rows])


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(awkward, scratch, n):
    docs = awkward.limit(n)
    assert found(manifest.merkle_manifest(docs, scratch)) == expected([r.asDict() for r in docs.collect()])


def test_levels_of_the_store(spark, scratch):
    """Levels are stored once each, every one made from the one below."""
    base = spark.range(9).selectExpr("0L as tree", "id as idx", "9L as n", "unhex(sha2(cast(id as string), 256)) as hash")
    store = manifest.Store(scratch, "s", base, 9)
    rows = {r.level: manifest._hexed(r.nodes) for r in store.tiers[0].collect()}
    assert rows == dict(enumerate(levels([h(str(k)) for k in range(9)])))
