"""Scans that hold for files cut anywhere, and running totals."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from topicloom.sources import corpus


@pytest.fixture
def tiny_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "57b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def news(rng, n):
    """Documents as text, and the tokens of those that count."""
    out, want = "junk before\n", []
    for k in range(n):
        words = [f"w{rng.choice('abcdef')}x" for _ in range(rng.randrange(0, 9))]
        tag = rng.choice(["DOC", "doc", "Doc"])
        closed = k % 5 != 4  # a document without an end is none
        out += f"<{tag} id=\"{k}\" type='story'>\n<HEADLINE>not this</HEADLINE>\n<P>\n{chr(10).join(words[:4])}\n</P> nor this\n<p a=b>{' '.join(words[4:])}</p>\n" + (f"</{tag}>\n" if closed else "")
        if closed and words:
            want.append(words)
    return out, want


def test_newswire_cut_anywhere(spark, tmp_path, tiny_splits):
    rng, want = random.Random(2), {}
    for name in ("b.txt", "a.txt", "c.gz"):
        text, want[name] = news(rng, 14)
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    for pattern, names in (("*.txt", ["a.txt", "b.txt"]), ("*.gz", ["c.gz"])):
        pieces = corpus.read_newswire(spark, str(tmp_path), pattern)
        found = corpus.transform_newswire(pieces, "file_no", place="doc_no").orderBy("doc_id").collect()
        assert [r.tokens for r in found] == [t for name in names for t in want[name]]
        assert {r.doc_id >> 32 for r in found} == set(range(len(names)))
    assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5


def test_lines_keep_their_order(spark, tmp_path, tiny_splits):
    for name in ("b", "a"):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(60)))
    (tmp_path / ".hidden").write_text("no\n")
    lines = corpus.sorted_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in lines] == list(enumerate([f"{x} {k}" for x in "ab" for k in range(60)]))


def test_running_totals(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 13).cast("int").alias("n"), F.array(F.col("id")).alias("more"))
    want, total = [], 0
    for r in sorted(rows.collect(), key=lambda r: r.k):
        want.append((r.k, r.n, r.more, len(want), total))
        total += r.n or 0
    out = corpus.running_totals(rows.repartition(7), ["k"], "n")
    assert [tuple(r) for r in out.orderBy("k").collect()] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "k ASC" not in plan.split("Window")[-1].split("FileScan")[0]  # only totals of ranges meet in a window
    assert corpus.running_totals(rows.where("false"), ["k"], "n").count() == 0
