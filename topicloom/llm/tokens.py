"""Token ids in ORC: texts are encoded once, written in document order with
integer run lengths, row indexes and a Bloom filter on the ids of documents,
and read back stripe by stripe."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Signs that a tokenizer cuts off letters before them and keeps in one run; not the apostrophe, which begins endings such as 's.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

def _printable(text: str) -> bool:
    """Whether line ends and spaces are the only white space and there are no
    control characters: Python takes all others as not printable."""
    return text.replace("\n", "").isprintable()


def _plain(text: str) -> bool:
    """Printable, with single spaces and single line ends, none beside another."""
    return not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text) and _printable(text)


class Encoder:
    """Whole-text encoding with the tokenizers library, through a cache of
    words.

    A text is cut only where the tokenizer itself always cuts, so joining the
    ids of its parts gives the ids of the text: before single spaces and around
    single line ends in plain texts; other texts are encoded whole. New words
    are encoded together. A word is cached when it is met in a second block, up to
    about ``limit`` of them; a full cache starts anew, which changes no result.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: How the strings of special tokens begin: a text that holds one may hold such a token, so it is encoded whole.
        self.special = {x for t in self.tokenizer.get_added_tokens_decoder().values() for x in (t.content[:2], t.content[:2].lower(), t.content[:2].upper())}
        #: How ids are held: little-endian, 16 bits where the vocabulary fits.
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.after_space: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}  # of runs of signs behind letters
        self.once: dict[str, bytes] = {}  # new in this block of texts
        self.met = bytearray(1 << 23)  # by hash, whether a word was in a block before
        self.limit = limit
        pieces = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        #: White space is dropped and words end in a marked token; else a byte-level vocabulary, whose tokens mark a space before.
        self.word_end = any(p.endswith("</w>") for p in pieces[:2000])
        self.mark = np.array([p.endswith("</w>") if self.word_end else p.startswith("Ġ") for p in pieces])
        #: For words of lower-case letters alone, which normalising leaves as they are.
        self.direct = self.tokenizer
        if self.word_end:
            from tokenizers import Tokenizer, pre_tokenizers

            self.direct = Tokenizer(self.tokenizer.model)
            self.direct.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters = re.compile(rf"[{LETTERS}]+").fullmatch
        self.line_end = b"" if self.word_end else self._one("\n")
        #: The id of a line end, where it is one.
        self.break_id = int(np.frombuffer(self.line_end, self.kind)[0]) if len(self.line_end) == self.kind.itemsize else -1

    def _ordinary(self, text: str) -> bool:
        return not any(x in text for x in self.special)

    def _one(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _many(self, texts: list[str], direct: bool = False) -> list[np.ndarray]:
        by = self.direct if direct else self.tokenizer
        return [np.asarray(e.ids, self.kind) for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], odd: list[str]) -> None:
        """Caches words as they are encoded after a space. Words of letters are
        joined to texts, whose ids are cut at marks, of the space before a word or
        of its end. Odd words are encoded each on its own."""
        before = "" if self.word_end else " "
        self.once.update(zip(odd, [x.tobytes() for x in self._many([before + w for w in odd])], strict=True))
        groups = [new[k : k + 512] for k in range(0, len(new), 512)]
        joined = [before + " ".join(g) for g in groups]
        for part, ids in zip(groups, self._many(joined, direct=True), strict=True):
            at = np.flatnonzero(self.mark[ids])
            cuts = np.concatenate(([0], at + 1)) if self.word_end else np.concatenate((at, [len(ids)]))
            if len(at) != len(part) or cuts[0] or cuts[-1] != len(ids):  # not of the expected form: one by one
                self.once.update([(x, self._one(before + x)) for x in part])
                continue
            raw, cuts = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
            self.once.update(zip(part, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def _learn_heads(self, new: list[str]) -> None:
        """Caches line ends with a word behind, joined as above and cut at line ends."""
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            ids = np.frombuffer(self._one("".join(part)), self.kind)
            cuts = np.append(np.flatnonzero(ids == self.break_id), len(ids)) if self.break_id >= 0 else []
            if len(cuts) != len(part) + 1 or cuts[0]:
                self.once.update([(x, self.line_end + self._one(x[1:])) for x in part])
            else:
                self.once.update([(x, ids[a:b].tobytes()) for x, a, b in zip(part, cuts[:-1], cuts[1:], strict=True)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of ``kind``; null is empty."""
        if len(self.after_space) > self.limit:
            self.after_space.clear()
        if len(self.signs) > self.limit // 8:
            self.signs.clear()
        # white space or, for a byte-level vocabulary, cuts before spaces; a line end goes with the word behind it, so that a text is cut once
        plain = _printable if self.word_end else _plain
        whole = [not (t and plain(t) and self._ordinary(t)) for t in texts]
        cut = [t for t, w in zip(texts, whole, strict=True) if not w]
        if self.word_end:
            words = pc.ascii_split_whitespace(pa.array(cut, pa.large_string()))
        else:
            words = pc.split_pattern(pa.array([("\n" + t).replace("\n", " \n")[1:] for t in cut], pa.large_string()), " ")
        joined = iter(self._joined(words, len(self.line_end)))  # the first line has no line end before it
        return [(self._one(t) if t else b"") if w else next(joined) for t, w in zip(texts, whole, strict=True)]

    def _joined(self, texts: pa.ListArray, skip: int) -> list[bytes]:
        """The ids of each text of words, without the first ``skip`` bytes. Each
        word of the block is looked up once."""
        held = texts.flatten().dictionary_encode()
        words = held.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.after_space.get, words))
        self._fill(words, ids)
        ids = pa.array(ids, pa.large_binary()).take(held.indices)
        _, at, raw = ids.buffers()
        if raw is None:
            return [b""] * len(texts)
        at, raw = np.frombuffer(at, np.int64)[texts.offsets.to_numpy()].tolist(), memoryview(raw)
        return [bytes(raw[a + skip : b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def _fill(self, words: list[str], ids: list[bytes | None]) -> None:
        """Learns the words behind the gaps: those of letters, those of letters
        with signs behind, whose ids are those of the letters and of the signs, as
        the tokenizer always cuts between them, and odd ones."""
        gaps = [k for k, x in enumerate(ids) if x is None]
        if not gaps:
            return
        once, known, letters, new, signed, stems, odd, heads = self.once, self.after_space, self.letters, set(), [], [], [], []
        for w in [words[k] for k in gaps]:
            stem = w.rstrip(SIGNS)
            if stem.isalpha():
                if not (stem.isascii() or letters(stem)):
                    odd.append(w)
                    continue
                if self.word_end:  # the tokenizer does so; letters of Latin-1 have one lower case each
                    stem = stem.lower()
                if stem != w:
                    signed.append(w)
                    stems.append(stem)
                    if stem in known:
                        continue
                new.add(stem)
            elif stem[:1] == "\n":
                if letters(stem[1:]):
                    heads.append(w)
                else:
                    once[w] = self.line_end + self._one(w[1:])
            else:
                odd.append(w)
        self._learn(list(new), odd)
        for w, stem in zip(signed, stems, strict=True):
            sign = w[len(stem) :]
            behind = self.signs.get(sign)
            if behind is None:
                behind = self.signs[sign] = self._one(sign)
            once[w] = (once.get(stem) or known[stem]) + behind
        self._learn_heads(heads)
        for k in gaps:
            ids[k] = once[words[k]]
        met, last = self.met, len(self.met) - 1
        for w, ids in once.items():
            k = hash(w) & last
            if met[k]:
                self.after_space[w] = ids
            else:
                met[k] = 1
        once.clear()


@functools.cache
def encoder_for(path: str) -> Encoder:
    """One for each worker process, so that tasks share its cache."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, column: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``limit`` text bytes, with their ids."""
    from topicloom.llm.common import chunks

    for part, _, _ in chunks(batches, "_text", limit):
        yield part, encoder.encode(part.column(column).to_pylist())


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20, index_rows: int = 10_000) -> None:
    """Writes (doc_id, part, before, n_tokens, ids) in ascending doc_id order.

    Files hold ranges of doc_id, so their names, stripe statistics and row
    indexes prune by range, and the Bloom filter prunes point lookups. ``before``
    counts the tokens that precede a document in its file. Null texts hold only
    the end id; repeated doc_ids stay, in the order of their texts; an empty
    table gives files without rows; extra columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = encoder_for(tokenizer), 0
        end = np.array([end_id], encoder.kind).tobytes()
        part = TaskContext.get().partitionId()
        for rows, ids in encoded(batches, encoder, 1):
            each = [x + end for x in ids]
            n = np.array([len(x) for x in each], np.int64) // encoder.kind.itemsize
            at = np.concatenate(([0], np.cumsum(n)))
            values = np.frombuffer(b"".join(each), encoder.kind).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + at[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))],
                names=["doc_id", "part", "before", "n_tokens", "ids"],
            )
            before += int(at[-1])

    rows = docs.select("doc_id", F.col("text").alias("_text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")
    out = rows.mapInArrow(kernel, "doc_id bigint, part int, before bigint, n_tokens bigint, ids array<int>")
    out.write.option("compression", "lz4").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows).option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_orc(spark: SparkSession, path: str, broadcast_files: int = 500_000) -> DataFrame:
    """The written documents, with ``start``: the ids of all documents before.
    Only sums of the files, one row each, meet in one task; they are broadcast
    up to ``broadcast_files`` rows of 12 bytes, and joined by a shuffle beyond."""
    rows = spark.read.schema("doc_id bigint, part int, before bigint, n_tokens bigint, ids array<int>").orc(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = files.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("ahead"))
    few = files.limit(broadcast_files + 1).count() <= broadcast_files
    return rows.join(F.broadcast(ahead) if few else ahead, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(3)
                at, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
                crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(kernel, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
