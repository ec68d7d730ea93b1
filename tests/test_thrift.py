"""Annotated documents as bytes: round trips, unknown fields, corrupt files, pruning, commits."""

import random
import struct
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.sources import corpus, thrift

TREES = st.fixed_dictionaries({"id": st.integers(0, 1 << 40).map(str), "text": st.text(max_size=300), "sectionSegmentations": st.lists(st.fixed_dictionaries({"sectionList": st.lists(st.fixed_dictionaries({"sentenceSegmentation": st.lists(st.fixed_dictionaries({"sentenceList": st.lists(st.fixed_dictionaries({"tokenizationList": st.lists(st.fixed_dictionaries({"tokenList": st.lists(st.fixed_dictionaries({"text": st.text(max_size=9)}), max_size=20)}), max_size=2)}), max_size=2)}), max_size=2)}), max_size=2)}), max_size=2)})


@settings(max_examples=60, deadline=None)
@given(TREES, st.booleans())
def test_round_trip_of_structs(tree, compact):
    raw = thrift.encoded(tree, thrift.COMMUNICATION, compact)
    reader = thrift.Reader(raw, compact)
    assert reader.struct(thrift.COMMUNICATION) == tree and reader.at == len(raw)
    for end in random.Random(1).sample(range(len(raw)), min(6, len(raw))):
        with pytest.raises(ValueError):
            thrift.Reader(raw[:end], compact).struct(thrift.COMMUNICATION)


def test_known_bytes():
    """The protocols' own layouts, spelled out."""
    tree = {"id": "7", "text": "ab"}
    assert thrift.encoded(tree, thrift.COMMUNICATION, False) == b"\x0b\x00\x01\x00\x00\x00\x017\x0b\x00\x04\x00\x00\x00\x02ab\x00"
    assert thrift.encoded(tree, thrift.COMMUNICATION, True) == b"\x18\x017\x38\x02ab\x00"


def test_unknown_fields_are_skipped():
    own = thrift.encoded({"id": "7"}, thrift.COMMUNICATION, False)[:-1]
    more = struct.pack(">bhq", thrift.I64, 50, 5) + struct.pack(">bhb", thrift.BOOL, 51, 1) + struct.pack(">bhd", thrift.DOUBLE, 52, 0.5) + struct.pack(">bhbbi", thrift.MAP, 53, thrift.STRING, thrift.I32, 1) + struct.pack(">i1si", 1, b"k", 9) + struct.pack(">bhbi", thrift.LIST, 54, thrift.STRUCT, 1) + struct.pack(">bhi", thrift.I32, 1, 3) + b"\0"
    assert thrift.Reader(own + more + b"\0", False).struct(thrift.COMMUNICATION) == {"id": "7"}
    # compact: a true flag, a list of two flags, a map, a short and a struct
    more = bytes([0x91, 0x19, 0x21, 1, 2, 0x1B, 1, 0x85, 1, ord("k"), 18, 0x14, 6, 0x1C, 0x15, 2, 0])
    assert thrift.Reader(thrift.encoded({"id": "7"}, thrift.COMMUNICATION, True)[:-1] + more + b"\0", True).struct(thrift.COMMUNICATION) == {"id": "7"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, ["a/b", "c", None][k % 3], "train" if k % 4 else "test", [f"w{j}é" for j in range(k % 7)]) for k in range(90)]
    return spark.createDataFrame(rows, "doc_id long, category string, split string, tokens array<string>").repartition(5)


@pytest.mark.parametrize("protocol", ["binary", "compact"])
def test_documents_and_pruning(spark, docs, tmp_path, protocol):
    path = str(tmp_path / "out")
    thrift.write_documents(corpus.annotate(docs), path, protocol)
    found = thrift.read_documents(spark, path, protocol, partitionBytes=500)
    assert found.rdd.getNumPartitions() > 3
    flat = corpus.flatten_annotated(found).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("doc_id", "category", "split", "tokens")) for r in flat] == [tuple(r) for r in docs.where(F.size("tokens") > 0).orderBy("doc_id").collect()]
    # a file that the filter leaves out is not even opened
    for file in (tmp_path / "out").rglob("category=c/*.dat"):
        file.write_bytes(file.read_bytes()[:-3])
    some = thrift.read_documents(spark, path, protocol)
    assert some.where("category = 'a/b'").count() == 30
    with pytest.raises(Exception, match="is corrupt"):
        some.where("category = 'c'").collect()
    with pytest.raises(Exception, match="exists"):
        thrift.write_documents(corpus.annotate(docs), path, protocol)
    thrift.write_documents(corpus.annotate(docs), path, protocol, mode="overwrite")
    assert thrift.read_documents(spark, path, protocol).count() == 90


def test_failed_writes_leave_nothing(spark, docs, tmp_path):
    path = tmp_path / "out"
    bad = corpus.annotate(docs).withColumn("doc_id", F.when(F.col("doc_id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("doc_id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        thrift.write_documents(bad, str(path))
    assert not [f for f in path.rglob("*.dat")]
    thrift.write_documents(corpus.annotate(docs), str(path))
    assert thrift.read_documents(spark, str(path)).count() == 90 and (path / "_SUCCESS").exists()


def test_nothing(spark, docs, tmp_path):
    thrift.write_documents(corpus.annotate(docs.where("false")), str(tmp_path / "out"))
    assert thrift.read_documents(spark, str(tmp_path / "out")).count() == 0


def test_trees_in_memory_are_few(tmp_path):
    def peaks(n):
        tokens = [{"text": f"word{k}"} for k in range(300)]
        rows = [{"doc_id": d, "category": "a", "split": "train", "sections": [{"sentences": [{"tokenizations": [{"tokens": tokens}]}]}]} for d in range(n)]
        batch, path = pa.RecordBatch.from_pylist(rows, thrift.ARROW), str(tmp_path / str(n))
        del rows
        writer = thrift.AnnotatedWriter({"path": path, "protocol": "compact", "filebytes": "20000"}, False)
        tracemalloc.start()
        writer.commit([writer.write(iter([batch]))])
        wrote = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        whole = thrift.AnnotatedWriter({"path": path + "w", "protocol": "compact"}, False)
        whole.commit([whole.write(iter([batch]))])
        reader = thrift.AnnotatedReader({"path": path + "w", "protocol": "compact"})
        tracemalloc.start()
        found = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
        read = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == n
        return wrote, read

    few, many = peaks(50), peaks(800)
    assert many[0] < 2 * few[0] and many[1] < 8 * few[1]
