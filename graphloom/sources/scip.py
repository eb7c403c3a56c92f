"""A data source for symbol indexes in the public SCIP format: ``spark.read.format("scip").load(path)``.

The driver walks over the top-level tags only, reading lengths and skipping bodies, and cuts the file
into byte ranges of whole messages; tasks seek to their range and decode it, some megabytes at a time.  Rows are documents in
the order of the file, between the metadata (doc_ord 0) and the external symbols (the last one, in rows of some thousands).  A document of
more than PIECE symbols or occurrences has several rows; ``first`` is the place of a row's first symbol and of its first occurrence.
The option ``only`` leaves the symbols or the occurrences (or both: heads) out.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import INDEX, ITEM, SYMBOL_INFO
from . import wire

RANGE_BYTES = 32 << 20
WINDOW = 8 << 20  # bytes of a document that a task holds
PIECE = 512  # symbols and occurrences a row
BATCH = 4096  # of a record batch
EXTERNAL_ROWS = 4096  # external symbols a row
#: The fields of a document that are decoded, by what is asked for.
_WANTED = {"": frozenset((2, 3)), "heads": frozenset(), "symbols": frozenset((3,)), "occurrences": frozenset((2,))}


def _relationship(data: memoryview) -> dict:
    out = {"symbol": "", "is_reference": False, "is_implementation": False, "is_type_definition": False, "is_definition": False}
    names = list(out)
    for number, _, value in wire.fields(data):
        if number == 1:
            out["symbol"] = wire.text(value)
        elif 2 <= number <= 5:
            out[names[number - 1]] = bool(value)
    return out


def _symbol(data: memoryview) -> dict:
    symbol = display = enclosing = signature = ""
    kind, docs, relations = 0, [], []
    for number, _, value in wire.fields(data):
        if number == 1:
            symbol = wire.text(value)
        elif number == 3:
            docs.append(wire.text(value))
        elif number == 4:
            relations.append(_relationship(value))
        elif number == 5:
            kind = value
        elif number == 6:
            display = wire.text(value)
        elif number == 7:
            for inner, _, body in wire.fields(value):
                if inner == 5:
                    signature = wire.text(body)
        elif number == 8:
            enclosing = wire.text(value)
    return dict(zip(SYMBOL_INFO.names, (symbol, display, kind, docs, signature, enclosing, relations), strict=True))


_ARROW = to_arrow_schema(INDEX)
_OCCURRENCE = _ARROW.field("occurrences").type.value_type


def _lanes(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The fields of many messages at once, the first of each, then the second of each: (message, number, wire type, value, size), where the value of a sized field is its place, and the size of a number its place."""
    rows = np.flatnonzero(at < end)
    at, end = at[rows], end[rows]
    while len(rows):
        tag, at = wire.varints_at(data, at)
        number, kind, before = tag >> 3, tag & 7, at
        if ((kind != 0) & (kind != 1) & (kind != 2) & (kind != 5)).any():
            raise ValueError("wire type is not known")
        if (at >= end).any():
            raise ValueError("truncated field")
        size = np.where(kind == 1, 8, np.where(kind == 5, 4, 0))
        value, behind = wire.varints_at(data, at, (kind == 0) | (kind == 2))
        sized = kind == 2
        size[sized] = value[sized]
        value[sized] = behind[sized]
        at = behind + size
        if (at > end).any() or (size < 0).any():
            raise ValueError("truncated field")
        yield rows, number, kind, value, np.where(kind == 0, before, size)
        left = np.flatnonzero(at < end)
        rows, at, end = rows[left], at[left], end[left]


class Occurrences:
    """Decoded occurrences as columns, all messages of a window at once: a million of them as Python rows would take gigabytes, and minutes."""

    def __init__(self) -> None:
        self.arrays: list[pa.Array] = []
        self.held: tuple[bytes, list[int], list[int]] = (b"", [], [])
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def add(self, data: bytes, at: int, end: int) -> None:
        """The message at data[at:end]."""
        if data is not self.held[0]:
            self._close()
            self.held = (data, [], [])
        self.held[1].append(at)
        self.held[2].append(end)
        self.n += 1

    def _close(self) -> None:
        if self.held[1]:
            self.arrays.append(self._decoded(*self.held))
        self.held = (b"", [], [])

    @staticmethod
    def _decoded(data: bytes, at: list[int], end: list[int]) -> pa.Array:
        n, low, high = len(at), at[0], end[-1]
        raw = np.zeros(high - low + 16, np.uint8)  # numbers may be looked for behind the end
        raw[: high - low] = np.frombuffer(data, np.uint8)[low:high]
        roles, start, size = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {k: [] for k in (1, 7)}  # message, its first byte, its bytes
        structs = {k: (np.zeros((w, n), np.int32), np.ones(n, bool)) for k, w in ((8, 3), (9, 4), (10, 3), (11, 4))}
        for rows, number, kind, value, length in _lanes(raw, np.array(at, np.int64) - low, np.array(end, np.int64) - low):
            for k in np.unique(number).tolist():
                here = np.flatnonzero((number == k) & (kind == 2))
                where, v, w = rows[here], value[here], length[here]
                if k == 2:
                    start[where], size[where] = v, w
                elif k in parts:
                    one = np.flatnonzero((number == k) & (kind == 0))  # not packed: a list of one
                    ends = wire.varints_at(raw, length[one])[1]
                    parts[k] += [(where, v, w), (rows[one], length[one], ends - length[one])]
                elif k == 3:
                    one = (number == 3) & (kind == 0)
                    roles[rows[one]] = value[one].astype(np.int32)
                elif k in structs:
                    out, none = structs[k]
                    out[:, where], none[where] = 0, False
                    for r, inner, kind_, x, _ in _lanes(raw, v, v + w):
                        ok = (kind_ == 0) & (inner >= 1) & (inner <= len(out))
                        out[inner[ok] - 1, where[r[ok]]] = x[ok].astype(np.int32)
        symbols = wire.cut(raw, start, size)
        try:
            symbols = symbols.cast(pa.string())
        except pa.ArrowInvalid:
            symbols = pa.array([x.decode("utf-8", "replace") for x in symbols.to_pylist()], pa.string())
        ready = {"symbol": symbols, "symbol_roles": pa.array(roles)}
        for k, name in ((1, "range"), (7, "enclosing_range")):
            where, v, w = (np.concatenate(x) for x in zip(*parts[k], strict=True)) if parts[k] else (np.empty(0, np.int64),) * 3
            order = np.argsort(where, kind="stable")
            values, counts = wire.lists_at(raw, v[order], w[order])
            by = np.bincount(where[order], weights=counts, minlength=n).astype(np.int64)
            ready[name] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(by)]), pa.int32()), pa.array(values.astype(np.int32)), _OCCURRENCE.field(name).type)
        for k, name in ((8, "single_line"), (9, "multi_line"), (10, "single_line_enclosing"), (11, "multi_line_enclosing")):
            out, none = structs[k]
            ready[name] = pa.StructArray.from_arrays([pa.array(x) for x in out], fields=list(_OCCURRENCE.field(name).type), mask=pa.array(none))
        return pa.StructArray.from_arrays([ready[f.name] for f in _OCCURRENCE], fields=list(_OCCURRENCE))

    def array(self) -> pa.Array:
        self._close()
        return pa.concat_arrays(self.arrays) if self.arrays else pa.array([], _OCCURRENCE)


class Rows:
    """Rows of the index schema that make one record batch."""

    def __init__(self) -> None:
        self.heads: list[tuple] = []  # doc_ord, part, path, language, metadata, first, and up to where in symbols and occurrences the row reaches
        self.symbols: list[dict] = []
        self.occurrences = Occurrences()

    def close(self, order: int, part: str, path: str, language: str, metadata: dict | None, first: int, without: int = 0) -> None:
        """A row of what came since the last one, the last symbols, so many of them, left out."""
        self.heads.append((order, part, path, language, metadata, first, len(self.symbols) - without, len(self.occurrences)))

    def many(self) -> bool:
        return len(self.heads) + len(self.symbols) + len(self.occurrences) >= BATCH

    def batch(self) -> pa.RecordBatch:
        *plain, to_symbol, to_occurrence = zip(*self.heads, strict=True)
        columns = dict(zip(("doc_ord", "part", "relative_path", "language", "metadata", "first"), plain, strict=True))
        arrays = {k: pa.array(v, _ARROW.field(k).type) for k, v in columns.items()}
        for name, ends, values in (("symbols", to_symbol, pa.array(self.symbols, _ARROW.field("symbols").type.value_type)), ("occurrences", to_occurrence, self.occurrences.array())):
            arrays[name] = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values, _ARROW.field(name).type)
        return pa.RecordBatch.from_arrays([arrays[f.name] for f in _ARROW], schema=_ARROW)


def parts_of(read: Callable[[int, int], bytes], at: int, length: int, wanted: frozenset[int]) -> Iterator[tuple[int, bytes, int, int]]:
    """(number, data, start, end) of each wanted field with a length of the message at this place, of which WINDOW bytes are held at a time."""
    end, data, base, pos = at + length, b"", at, 0
    while base + pos < end:
        if len(data) - pos < 20 and base + len(data) < end:
            base += pos
            data, pos = read(base, min(WINDOW, end - base)), 0
        tag, pos = (data[pos], pos + 1) if data[pos] < 0x80 else wire.varint(data, pos, 32)
        kind = tag & 7
        if kind == 2:
            size, pos = (data[pos], pos + 1) if pos < len(data) and data[pos] < 0x80 else wire.varint(data, pos, 32)
            if base + pos + size > end:
                raise ValueError("truncated field")
            if tag >> 3 in wanted:
                if pos + size > len(data):
                    base += pos
                    data, pos = read(base, min(max(WINDOW, size), end - base)), 0
                yield tag >> 3, data, pos, pos + size
            pos += size
        elif kind == 0:
            _, pos = wire.varint(data, pos)
        elif kind in (1, 5):
            pos += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind} is not known")
    if base + pos > end:
        raise ValueError("truncated field")


def document(read: Callable[[int, int], bytes], order: int, at: int, length: int, only: str, rows: Rows) -> Iterator[Rows]:
    """A document's rows, of PIECE symbols and PIECE occurrences at most, put into rows; yields rows when they are many, and then goes on with new ones.

    Its path and language are read first, wherever they stand in the message, since all its rows have them.
    """
    path = language = ""
    for number, data, a, b in parts_of(read, at, length, frozenset((1, 4))):
        if number == 1:
            path = wire.text(data[a:b])
        else:
            language = wire.text(data[a:b])
    came, first = [0, 0], [0, 0]  # symbols and occurrences so far, and before the open row

    def close() -> None:
        apart = first[0] != first[1] and came[0] > first[0] and came[1] > first[1]
        if apart:  # a row has one place for both
            rows.close(order, "document", path, language, None, first[1], came[0] - first[0])
        rows.close(order, "document", path, language, None, first[1] if came[1] > first[1] and not apart else first[0])
        first[:] = came

    for number, data, a, b in parts_of(read, at, length, _WANTED[only]) if _WANTED[only] else ():
        if number == 2:
            rows.occurrences.add(data, a, b)
        else:
            rows.symbols.append(_symbol(memoryview(data)[a:b]))
        came[number == 2] += 1
        if came[number == 2] - first[number == 2] == PIECE:
            close()
            if rows.many():
                yield rows
                rows = Rows()
    if came != first or came == [0, 0]:
        close()
    yield rows


def _metadata(data: memoryview | bytes) -> dict:
    root = name = version = ""
    arguments: list[str] = []
    for number, _, value in wire.fields(data):
        if number == 3:
            root = wire.text(value)
        elif number == 2:
            for inner, _, body in wire.fields(value):
                if inner == 1:
                    name = wire.text(body)
                elif inner == 2:
                    version = wire.text(body)
                elif inner == 3:
                    arguments.append(wire.text(body))
    return {"project_root": root, "tool_name": name, "tool_version": version, "tool_arguments": arguments}


def messages(stream: io.RawIOBase, size: int) -> Iterator[tuple[int, int, int]]:
    """(field number, offset of the body, its length) of each top-level message, without reading bodies."""
    at = 0
    while at < size:
        stream.seek(at)
        head = stream.read(min(20, size - at))
        tag, here = wire.varint(head, 0, 32)
        kind = tag & 7
        if kind == 2:
            length, here = wire.varint(head, here, 32)
            if at + here + length > size:
                raise ValueError("truncated index")
            yield tag >> 3, at + here, length
            at += here + length
        elif kind == 0:
            _, here = wire.varint(head, here)
            at += here
        elif kind in (1, 5):
            at += here + (8 if kind == 1 else 4)
        else:
            raise ValueError(f"wire type {kind} is not known")


class Chunk(InputPartition):
    """Some messages of one kind: (doc_ord, offset, length) of each; first: how many of the kind come before."""

    def __init__(self, part: str, where: list[tuple[int, int, int]], first: int = 0):
        super().__init__(f"{part}:{where[0][0] if where else 0}:{first}")
        self.part, self.where, self.first = part, where, first


class ScipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.only = options.get("only", "")

    def _file(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path

    def partitions(self) -> list[Chunk]:
        fs, path = self._file()
        info = fs.get_file_info(path)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(path)
        metadata, external, out, now, held, order = [], [], [], [], 0, 0
        with fs.open_input_file(path) as f:
            for number, at, length in messages(f, info.size):
                if number == 1:
                    metadata.append((0, at, length))
                elif number == 2:
                    order += 1
                    now.append((order, at, length))
                    held += length
                    if held >= self.range_bytes:
                        out.append(Chunk("document", now))
                        now, held = [], 0
                elif number == 3:
                    external.append((0, at, length))
        if now:
            out.append(Chunk("document", now))
        # external symbols are one document behind the others, in ranges too
        parts, now, held = [], [], 0
        for _, at, length in external:
            now.append((order + 1, at, length))
            held += length
            if held >= self.range_bytes:
                parts.append(Chunk("external", now, parts[-1].first + len(parts[-1].where) if parts else 0))
                now, held = [], 0
        if now:
            parts.append(Chunk("external", now, parts[-1].first + len(parts[-1].where) if parts else 0))
        return [Chunk("metadata", metadata), *out, *parts]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.where or (partition.part == "external" and self.only == "occurrences"):
            return
        fs, path = self._file()
        rows = Rows()
        with fs.open_input_file(path) as f:

            def body(at: int, length: int) -> bytes:
                f.seek(at)
                return f.read(length)

            for k, (order, at, length) in enumerate(partition.where):
                if partition.part == "document":
                    for rows in document(body, order, at, length, self.only, rows):
                        if rows.many():
                            yield rows.batch()
                    if rows.many():
                        rows = Rows()
                elif partition.part == "metadata":
                    rows.close(order, "metadata", "", "", _metadata(body(at, length)), 0)
                else:
                    if self.only != "heads":
                        rows.symbols.append(_symbol(memoryview(body(at, length))))
                    if (k + 1) % EXTERNAL_ROWS == 0:
                        rows.close(order, "external", "", "", None, partition.first + k + 1 - EXTERNAL_ROWS)
                        yield rows.batch()
                        rows = Rows()
            if partition.part == "external" and len(partition.where) % EXTERNAL_ROWS:
                rows.close(order, "external", "", "", None, partition.first + len(partition.where) // EXTERNAL_ROWS * EXTERNAL_ROWS)
        if rows.heads:
            yield rows.batch()


class Scip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scip"

    def schema(self) -> StructType:
        return INDEX

    def reader(self, schema: StructType) -> ScipReader:
        return ScipReader({k.lower(): v for k, v in self.options.items()})


def read_scip(spark, path: str, **options: int | str):  # noqa: ANN001, ANN201
    from ..session import ship

    ship(spark)
    spark.dataSource.register(Scip)
    return spark.read.format("scip").options(**{k: str(v) for k, v in options.items()}).load(path)


# Writing

HEAD, IS_OCCURRENCE, IS_SYMBOL = 0, 1, 2  # what
_RANGE = 32 << 20  # bytes that the driver receives together
_ITEM_ORDER = ["doc_ord", "what", "g", "k1", "k2"]


def _occurrences(rows: pa.StructArray) -> pa.Array:
    """The field of each occurrence in its document, column by column."""
    join = lambda *x: pc.binary_join_element_wise(*x, pa.scalar(b"", pa.binary()), null_handling="replace", null_replacement=b"")
    sized = lambda tag, x: join(pa.scalar(wire.number(tag << 3 | 2), pa.binary()), wire.varints(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)), x)
    get = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
    parts = [sized(2, pc.fill_null(get["symbol"], "").cast(pa.binary())), pa.scalar(wire.number(3 << 3), pa.binary()), wire.varints(pc.fill_null(get["symbol_roles"], 0).to_numpy(zero_copy_only=False))]
    for number, name in ((1, "range"), (7, "enclosing_range"), (8, "single_line"), (9, "multi_line"), (10, "single_line_enclosing"), (11, "multi_line_enclosing")):
        x = get[name]
        if x.null_count == len(x):
            continue
        if number in (1, 7):
            counts = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            body, have = wire.packed(pc.list_flatten(x).to_numpy(zero_copy_only=False), counts), counts > 0
        else:
            have = x.is_valid().to_numpy(zero_copy_only=False)
            values = [pc.fill_null(x.field(i), 0).to_numpy(zero_copy_only=False) for i in range(x.type.num_fields)]
            tagged = np.stack([y for i, v in enumerate(values, 1) for y in (np.full(len(v), i << 3), v)], axis=1)
            body = wire.packed(tagged.reshape(-1), np.full(len(x), tagged.shape[1]))
        if have.any():
            parts.append(pc.if_else(pa.array(have), sized(number, body), pa.scalar(b"", pa.binary())))
    return sized(2, join(*parts))


def _encoded_symbol(s: dict) -> bytes:
    out = wire.put(1, s["symbol"]) + b"".join(wire.put(3, d) for d in s["documentation"] or [])
    for r in s["relationships"] or []:
        out += wire.put(4, wire.put(1, r["symbol"]) + b"".join(wire.put(i, 1) for i, k in enumerate(("is_reference", "is_implementation", "is_type_definition", "is_definition"), 2) if r[k]))
    out += wire.put(5, s["kind"] or 0) + wire.put(6, s["display_name"] or "")
    if s["signature"]:
        out += wire.put(7, wire.put(5, s["signature"]))
    return wire.put(3, out + (wire.put(8, s["enclosing_symbol"]) if s["enclosing_symbol"] else b""))


def _encoded_metadata(m: dict) -> bytes:
    tool = wire.put(1, m["tool_name"] or "") + wire.put(2, m["tool_version"] or "") + b"".join(wire.put(3, a) for a in m["tool_arguments"] or [])
    return wire.put(1, wire.put(2, tool) + wire.put(3, m["project_root"] or ""))


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted items as pieces of messages, of one document and one kind of item each: (the first item's order, part, bytes); external symbols and metadata are fields of the index itself."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    for batch in batches:
        what, docs = batch.column("what").to_numpy(), batch.column("doc_ord").to_numpy()
        cuts = np.flatnonzero((what[1:] != what[:-1]) | (docs[1:] != docs[:-1])) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(what)], strict=True):
            some = batch.slice(a, b - a)
            if what[a] == IS_OCCURRENCE:
                body = wire.joined(_occurrences(some.column("occurrence")))
            elif what[a] == IS_SYMBOL:
                body = b"".join(map(_encoded_symbol, some.column("symbol").to_pylist()))
            else:
                body = b"".join(_encoded_metadata(r["metadata"]) if r["part"] == "metadata" else wire.put(1, r["relative_path"] or "") + wire.put(4, r["language"] or "") for r in some.to_pylist())
            rows.append((*(some.column(c)[0].as_py() for c in [*_ITEM_ORDER, "part"]), body))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*_ITEM_ORDER, "part", "message"])


def write_scip(items: DataFrame, path: str) -> None:
    """Write rows of the ITEM schema as one index file; tasks encode, the driver appends piece after piece, of which it holds _RANGE bytes or so at a time."""
    from ..session import materialise, ship

    ship(items.sparkSession)
    # one kind of item at a time: a batch whose lists are all null takes Spark a time that is quadratic in its rows
    columns = {HEAD: ["relative_path", "language", "metadata"], IS_OCCURRENCE: ["occurrence"], IS_SYMBOL: ["symbol"]}
    some = [items.where(F.col("what") == what).select(*_ITEM_ORDER, "part", *own).repartitionByRange(*_ITEM_ORDER).sortWithinPartitions(*_ITEM_ORDER) for what, own in columns.items()]
    pieces = [df.mapInArrow(_messages, "doc_ord long, what int, g int, k1 long, k2 long, part string, message binary") for df in some]
    encoded = materialise(reduce(DataFrame.union, pieces), "messages")
    sizes = {r["doc_ord"]: r["n"] for r in encoded.where("part = 'document'").groupBy("doc_ord").agg(F.sum(F.octet_length("message")).alias("n")).collect()}  # a number a document
    ranges = encoded.agg(F.coalesce(F.sum(F.octet_length("message")), F.lit(0))).first()[0] // _RANGE + 1
    with open(path, "wb") as f:
        for r in encoded.repartitionByRange(ranges, *_ITEM_ORDER).sortWithinPartitions(*_ITEM_ORDER).select("doc_ord", "message").toLocalIterator():
            if r["doc_ord"] in sizes:
                f.write(wire.head(2, sizes.pop(r["doc_ord"])))
            f.write(r["message"])
