"""Annotated documents as Thrift structs: a data source that reads and writes them.

A file holds one struct after another. Files lie in folders ``split=.../category=...``,
so filters on either are answered by leaving files out. A document's tree is
sections, sentences, tokenizations and tokens; fields that aren't known are skipped.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: Wire types of the binary protocol, and those of the compact one.
STOP, BOOL, BYTE, DOUBLE, I16, I32, I64, STRING, STRUCT, MAP, SET, LIST = 0, 2, 3, 4, 6, 8, 10, 11, 12, 13, 14, 15
COMPACT = {1: BOOL, 2: BOOL, 3: BYTE, 4: I16, 5: I32, 6: I64, 7: DOUBLE, 8: STRING, 9: LIST, 10: SET, 11: MAP, 12: STRUCT}
TO_COMPACT = {STRING: 8, LIST: 9, STRUCT: 12}

#: Names and numbers of fields: text is a string, a dict a struct, a list of a dict a list.
TOKEN = {"text": (2, str)}
TOKENIZATION = {"tokenList": (3, [TOKEN])}
SENTENCE = {"tokenizationList": (2, [TOKENIZATION])}
SENTENCES = {"sentenceList": (3, [SENTENCE])}
SECTION = {"sentenceSegmentation": (2, [SENTENCES])}
SECTIONS = {"sectionList": (3, [SECTION])}
COMMUNICATION = {"id": (1, str), "text": (4, str), "sectionSegmentations": (6, [SECTIONS])}


class Reader:
    """Structs from bytes, by a table of fields."""

    def __init__(self, raw: bytes, compact: bool):
        self.raw, self.at, self.compact = raw, 0, compact

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError(f"a value of {n} bytes at {self.at} goes beyond the end at {len(self.raw)}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(f">{code}", self.take(struct.calcsize(code)))[0]

    def varint(self) -> int:
        out = shift = 0
        while True:
            byte = self.number("B")
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7
            if shift > 63:
                raise ValueError(f"a number at {self.at} has no end")

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def string(self) -> bytes:
        return self.take(self.varint() if self.compact else self.number("i"))

    def field(self, last: int) -> tuple[int, int]:
        """(wire type, number) of the next field."""
        if not self.compact:
            kind = self.number("b")
            return kind, self.number("h") if kind else 0
        head = self.number("B")
        if not head:
            return STOP, 0
        number = last + (head >> 4) if head >> 4 else self.zigzag()
        if head & 15 not in COMPACT:
            raise ValueError(f"no wire type {head & 15} at {self.at}")
        return COMPACT[head & 15], number

    def items(self) -> tuple[int, int]:
        """(wire type, number) of a list's members."""
        if not self.compact:
            kind, n = self.number("b"), self.number("i")
        else:
            head = self.number("B")
            n, kind = head >> 4, COMPACT.get(head & 15, -1)
            n = self.varint() if n == 15 else n
        if n < 0 or n > len(self.raw) - self.at or kind < 0:
            raise ValueError(f"a list of {n} at {self.at} does not fit")
        return kind, n

    def skip(self, kind: int, member: bool = False) -> None:
        if kind == STRUCT:
            self.struct({})
        elif kind == STRING:
            self.string()
        elif kind in (LIST, SET):
            inner, n = self.items()
            for _ in range(n):
                self.skip(inner, True)
        elif kind == MAP:
            if self.compact:
                n = self.varint()
                kinds = self.number("B") if n else 0
                pair = (COMPACT.get(kinds >> 4, -1), COMPACT.get(kinds & 15, -1))
            else:
                pair, n = (self.number("b"), self.number("b")), self.number("i")
            if n < 0 or n > len(self.raw) - self.at:
                raise ValueError(f"a map of {n} at {self.at} does not fit")
            for _ in range(n):
                self.skip(pair[0], True)
                self.skip(pair[1], True)
        elif kind == BOOL:
            self.take(0 if self.compact and not member else 1)
        elif kind in (BYTE, DOUBLE):
            self.take(1 if kind == BYTE else 8)
        elif kind in (I16, I32, I64):
            self.varint() if self.compact else self.take({I16: 2, I32: 4, I64: 8}[kind])
        else:
            raise ValueError(f"no wire type {kind} at {self.at}")

    def value(self, kind: int, of) -> object:
        if of is str and kind == STRING:
            return self.string().decode()
        if isinstance(of, dict) and kind == STRUCT:
            return self.struct(of)
        if isinstance(of, list) and kind in (LIST, SET):
            inner, n = self.items()
            return [self.value(inner, of[0]) for _ in range(n)]
        raise ValueError(f"a field at {self.at} has wire type {kind}")

    def struct(self, of: dict) -> dict:
        names, out, last = {number: (name, kind) for name, (number, kind) in of.items()}, {}, 0
        while True:
            kind, last = self.field(last)
            if kind == STOP:
                return out
            if last in names:
                out[names[last][0]] = self.value(kind, names[last][1])
            else:
                self.skip(kind)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def encoded(value: object, of, compact: bool) -> bytes:
    if of is str:
        raw = value.encode()
        return (_varint(len(raw)) if compact else struct.pack(">i", len(raw))) + raw
    if isinstance(of, list):
        kind = STRING if of[0] is str else STRUCT
        body = b"".join(encoded(x, of[0], compact) for x in value)
        n = len(value)
        if not compact:
            return struct.pack(">bi", kind, n) + body
        return (bytes([n << 4 | TO_COMPACT[kind]]) if n < 15 else bytes([0xF0 | TO_COMPACT[kind]]) + _varint(n)) + body
    out, last = [], 0
    for name, (number, kind) in sorted(of.items(), key=lambda x: x[1][0]):
        if value.get(name) is None:
            continue
        wire = STRING if kind is str else LIST if isinstance(kind, list) else STRUCT
        if not compact:
            head = struct.pack(">bh", wire, number)
        else:  # numbers grow, by less than sixteen
            head = bytes([number - last << 4 | TO_COMPACT[wire]]) if number - last < 16 else bytes([TO_COMPACT[wire]]) + _varint(2 * number)
        out.append(head + encoded(value[name], kind, compact))
        last = number
    return b"".join(out) + b"\0"


SCHEMA = "doc_id bigint, category string, split string, sections array<struct<sentences:array<struct<tokenizations:array<struct<tokens:array<struct<text:string>>>>>>>>"
_TOKENS = pa.list_(pa.struct([("text", pa.string())]))
_SECTIONS = pa.list_(pa.struct([("sentences", pa.list_(pa.struct([("tokenizations", pa.list_(pa.struct([("tokens", _TOKENS)])))])))]))
ARROW = pa.schema([("doc_id", pa.int64()), ("category", pa.string()), ("split", pa.string()), ("sections", _SECTIONS)])
NULL = "__null__"
#: Bytes of a file that are trees at a time; a tree takes many times its bytes.
PIECE_BYTES = 1 << 19


def from_tree(tree: dict) -> list[dict]:
    """Sections of the nested form; a missing list is an empty one."""
    sections = [s for seg in tree.get("sectionSegmentations", ()) for s in seg.get("sectionList", ())]
    return [{"sentences": [{"tokenizations": [{"tokens": [{"text": t.get("text")} for t in z.get("tokenList", ())]} for z in x.get("tokenizationList", ())]} for seg in s.get("sentenceSegmentation", ()) for x in seg.get("sentenceList", ())]} for s in sections]


def to_tree(doc_id: int, sections: list[dict] | None) -> dict:
    out = [{"sentenceSegmentation": [{"sentenceList": [{"tokenizationList": [{"tokenList": z["tokens"] or []} for z in x["tokenizations"] or []]} for x in s["sentences"] or []]}]} for s in sections or []]
    text = " ".join(t["text"] for s in sections or [] for x in s["sentences"] or [] for z in x["tokenizations"] or [] for t in z["tokens"] or [] if t["text"] is not None)
    return {"id": str(doc_id), "text": text, "sectionSegmentations": [{"sectionList": out}]}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder_values(path: str) -> dict[str, str | None]:
    found = dict(x.split("=", 1) for x in path.split("/")[:-1] if x.startswith(("category=", "split=")))
    return {k: None if v == NULL else unquote(v) for k, v in found.items()}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class AnnotatedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.compact = options["path"], options.get("protocol", "binary") == "compact"
        self.limit, self.chosen = int(options.get("partitionbytes", 64 << 20)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality with values of the folders; the others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In) and f.attribute in (("category",), ("split",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.chosen.append((f.attribute[0], values if isinstance(f, EqualNullSafe) else values - {None}))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = _place(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.is_file and not any(x.startswith((".", "_")) for x in f.path[len(root) :].split("/"))]
        files = [f for f in sorted(files, key=lambda f: f.path) if all(_folder_values(f.path).get(name) in values for name, values in self.chosen)]
        out, size = [], 0
        for f in files:
            if not out or size + f.size > self.limit:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(paths) for paths in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as file:
                reader = Reader(file.read(), self.compact)
            of, rows, begun = _folder_values(path), [], 0
            try:
                while reader.at < len(reader.raw):
                    tree = reader.struct(COMMUNICATION)
                    rows.append({"doc_id": int(tree["id"]), "category": of.get("category"), "split": of.get("split"), "sections": from_tree(tree)})
                    if len(rows) == 1000 or reader.at - begun >= PIECE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, begun = [], reader.at
            except (ValueError, KeyError, struct.error, RecursionError) as e:
                raise ValueError(f"{path} is corrupt: {e}") from e
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class AnnotatedWriter(DataSourceArrowWriter):
    """Tasks write below a hidden folder; what the job commits is moved to its place,
    so a task that is run twice, or a job that fails, leaves nothing."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.compact, self.overwrite = options["path"], options.get("protocol", "binary") == "compact", overwrite
        self.limit, self.job = int(options.get("filebytes", 64 << 20)), uuid.uuid4().hex
        system, root = _place(self.path)
        if not overwrite and system.get_file_info(root).type != fs.FileType.NotFound and any(f.base_name != "_temporary" for f in system.get_file_info(fs.FileSelector(root))):
            raise ValueError(f"{self.path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _place(self.path)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        files: list[tuple[str, str]] = []

        def put(folder: str) -> None:
            name = f"part-{uuid.uuid4().hex}.dat"
            there = f"{root}/_temporary/{self.job}"
            system.create_dir(there, recursive=True)
            with system.open_output_stream(f"{there}/{name}") as file:
                file.write(b"".join(held.pop(folder)))
            sizes.pop(folder)
            files.append((f"{there}/{name}", f"{root}/{folder}/{name}"))

        for batch in iterator:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):  # a document's tree at a time
                names = ("split", "category")
                folder = "/".join(f"{k}={NULL if row[k] is None else quote(row[k], safe='')}" for k in names)
                raw = encoded(to_tree(row["doc_id"], row["sections"]), COMMUNICATION, self.compact)
                held.setdefault(folder, []).append(raw)
                sizes[folder] = sizes.get(folder, 0) + len(raw)
                if sizes[folder] >= self.limit or sum(sizes.values()) >= 2 * self.limit:
                    put(max(sizes, key=sizes.get))
        for folder in list(held):
            put(folder)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        old = []
        if self.overwrite and system.get_file_info(root).type != fs.FileType.NotFound:
            old = [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name != "_temporary"]
        for f in old:
            system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)
        system.create_dir(root, recursive=True)
        for there, here in [x for m in messages if m for x in m.files]:
            system.create_dir(here.rsplit("/", 1)[0], recursive=True)
            system.move(there, here)
        self._clear(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS") as file:
            file.write(json.dumps({"files": sum(len(m.files) for m in messages if m)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_temporary/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_temporary/{self.job}")
            if not system.get_file_info(fs.FileSelector(f"{root}/_temporary")):  # no other job writes here
                system.delete_dir(f"{root}/_temporary")


class AnnotatedSource(DataSource):
    """``annotated``: options path, protocol (binary or compact), partitionBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "annotated"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnnotatedReader:
        return AnnotatedReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> AnnotatedWriter:
        return AnnotatedWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_documents(spark: SparkSession, path: str, protocol: str = "binary", **options: object) -> DataFrame:
    """Rows of SCHEMA. A file that is no sequence of whole structs raises. Lets the
    session push filters to Python sources, so those on folders leave files out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnnotatedSource)
    return spark.read.format("annotated").options(protocol=protocol, **options).load(path)


def write_documents(docs: DataFrame, path: str, protocol: str = "binary", mode: str = "append", **options: object) -> None:
    """Rows of SCHEMA as files; with mode append the folder must be new."""
    docs.sparkSession.dataSource.register(AnnotatedSource)
    docs.select("doc_id", "category", "split", "sections").write.format("annotated").mode(mode).options(protocol=protocol, **options).save(path)
