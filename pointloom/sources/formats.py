"""Spark data sources of the binary formats: ``spark.read.format("ply" | "points3d" | "npz")``, ``df.write.format("ply" | "points3d")`` and ``writeStream``.

A file is cut at record offsets, so one large file is read by many tasks, each of which holds a block at a time. With the option ``pushdown`` simple comparisons are
pushed into the read: load anew for each query then, as Spark (4.1) keeps what was pushed with the loaded table, for queries of it without filters, too. Writers have a file for each task, which a commit moves into place or joins into one file whose header has the tasks' counts; an abort removes
them. Files are opened by ``pyarrow.fs``, so a path is local or a URI that it knows. ``register`` makes the formats known to a session.
"""

from __future__ import annotations

import io
import operator
import struct
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .ply import KINDS

#: Bytes that a task reads, unless the option ``partitionBytes`` says otherwise, and bytes of one read.
PARTITION_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
#: Element types of the formats as Spark's.
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "u8": "decimal(20,0)", "f2": "float", "f4": "float", "f8": "double", "b1": "boolean"}
COMPARE = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str, suffixes: Sequence[str]) -> list[tuple[str, int]]:
    """(path in its file system, bytes) of a file, or of a folder's files with one of the ``suffixes`` in order of their names; hidden ones are left out."""
    where, at = opened(path)
    info = where.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(at, info.size)]
    found = where.get_file_info(pafs.FileSelector(at, recursive=True))
    inside = lambda f: f.path[len(at) :].lstrip("/").split("/")
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(tuple(suffixes)) and not any(p[0] in "._" for p in inside(f)))


@dataclass
class Span(D.InputPartition):
    """Records ``first`` to ``last`` of a file; the first begins at byte ``at``."""

    path: str
    at: int
    first: int
    last: int
    member: str = ""


class Filtered(D.DataSourceReader):
    """A reader that knows which records the filters in ``taken`` let through; a null meets none of them."""

    def __init__(self, schema: T.StructType, options):
        self.schema, self.options, self.taken = schema, dict(options), []
        self.path, self.bytes = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.plain = {f.name for f in schema.fields if isinstance(f.dataType, T.NumericType | T.StringType | T.BooleanType) and not isinstance(f.dataType, T.DecimalType)}

    def bounds(self, name: str) -> tuple[float, float]:
        """Least and largest value of a column that the filters taken over let through."""
        lo, hi = float("-inf"), float("inf")
        for f in self.taken:
            if f.attribute[0] == name and not isinstance(f, D.IsNotNull):
                values = list(f.value) if isinstance(f, D.In) else [f.value]
                lo = max(lo, min(values, default=lo)) if isinstance(f, D.In | D.EqualTo | D.GreaterThan | D.GreaterThanOrEqual) else lo
                hi = min(hi, max(values, default=hi)) if isinstance(f, D.In | D.EqualTo | D.LessThan | D.LessThanOrEqual) else hi
        return lo, hi

    def passes(self, path: str) -> bool:
        """Whether the filters on the path let a file through."""
        return all(path in f.value if isinstance(f, D.In) else COMPARE[type(f)](path, f.value) for f in self.taken if f.attribute[0] == "path" and not isinstance(f, D.IsNotNull))

    def kept(self, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
        """Records that pass. NaN counts as Spark counts it: equal to itself and above all numbers."""
        good = np.ones(n, bool)
        for f in self.taken:
            name = f.attribute[0]
            if name not in columns:  # null in this file
                good &= name == "path"
            elif isinstance(f, D.In):
                good &= np.isin(columns[name], list(f.value))
            elif not isinstance(f, D.IsNotNull):
                x = columns[name]
                met = COMPARE[type(f)](x, f.value)
                if x.dtype.kind == "f":
                    met = np.where(np.isnan(x), (f.value != f.value and not isinstance(f, D.GreaterThan | D.LessThan)) or (f.value == f.value and isinstance(f, D.GreaterThan | D.GreaterThanOrEqual)), met | ((f.value != f.value) and isinstance(f, D.LessThan | D.LessThanOrEqual)))
                good &= met
        return good

    def batch(self, path: str, columns: dict[str, np.ndarray | pa.Array], good: np.ndarray) -> pa.RecordBatch:
        """The wanted columns of the records that pass, in the order of the schema and of its types."""
        at = np.flatnonzero(good)
        arrays = []
        for f in self.schema.fields:
            kind = arrow_type(f.dataType)
            if f.name == "path":
                arrays.append(pa.array([path] * len(at), pa.string()))
            elif f.name not in columns:
                arrays.append(pa.nulls(len(at), kind))
            else:
                x = columns[f.name]
                arrays.append((x.take(pa.array(at)) if isinstance(x, pa.Array) else pa.array(x[at])).cast(kind))
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema.fields])


class Pushed:
    """Comparisons of plain columns with a value are taken over from the query."""

    def pushFilters(self, filters):
        for f in filters:
            values = list(f.value) if isinstance(f, D.In) else [f.value] if type(f) in COMPARE else []
            whole = not isinstance(f, D.In) or all(v == v for v in values)
            if (values and whole or isinstance(f, D.IsNotNull)) and None not in values and f.attribute[0] in self.plain and len(f.attribute) == 1:
                self.taken.append(f)
            else:
                yield f


def pushed(reader: type[Filtered], schema: T.StructType, options) -> Filtered:
    """A reader, one that takes filters over if the option ``pushdown`` is true."""
    if str(options.get("pushdown", "false")).lower() == "true":
        reader = type(f"{reader.__name__}Pushed", (Pushed, reader), {})
    return reader(schema, options)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# PLY


@dataclass
class Element:
    """A table of a PLY file: name, records, and (property, type, type of the count of a list or "")."""

    name: str
    count: int
    properties: list[tuple[str, str, str]]

    @property
    def flat(self) -> bool:
        return not any(c for _, _, c in self.properties)


def ply_header(path: str) -> tuple[str, list[Element], int]:
    """(form, elements, bytes of the header); form: ascii, < or >."""
    where, at = opened(path)
    with where.open_input_file(at) as f:
        data = b""
        while b"end_header" not in data or not data.endswith(b"\n") and b"\n" not in data[data.index(b"end_header") :]:
            more = f.read(1 << 16)
            if not more:
                raise ValueError(f"{path}: no PLY header")
            data += more
    end = data.index(b"\n", data.index(b"end_header")) + 1
    lines = data[:end].decode("ascii").split("\n")
    if lines[0].strip() != "ply":
        raise ValueError(f"{path}: not a PLY file")
    form, out = "ascii", []
    for line in lines:
        w = line.split()
        if w[:1] == ["format"]:
            form = {"ascii": "ascii", "binary_little_endian": "<", "binary_big_endian": ">"}[w[1]]
        elif w[:1] == ["element"]:
            out.append(Element(w[1], int(w[2]), []))
        elif w[:2] == ["property", "list"]:
            out[-1].properties.append((w[4], KINDS[w[3]], KINDS[w[2]]))
        elif w[:1] == ["property"]:
            out[-1].properties.append((w[2], KINDS[w[1]], ""))
    return form, out, end


def _lists(data: bytes, order: str, e: Element, at: int, n: int) -> tuple[dict[str, list], int]:
    """``n`` records with lists from byte ``at`` on, and where they end; IndexError if ``data`` ends before."""
    out: dict[str, list] = {name: [] for name, _, _ in e.properties}
    for _ in range(n):
        for name, kind, count in e.properties:
            k = 1
            if count:
                if at + np.dtype(count).itemsize > len(data):
                    raise IndexError
                k = int(np.frombuffer(data, order + count, 1, at)[0])
                at += np.dtype(count).itemsize
            if at + k * np.dtype(kind).itemsize > len(data):
                raise IndexError
            v = np.frombuffer(data, order + kind, k, at)
            at += v.nbytes
            out[name].append(v.tolist() if count else v[0].item())
    return out, at


class PlyReader(Filtered):
    """An element of PLY files (option ``element``, vertex if not said). Records of one width are cut anywhere, and a filter on ``nth``, the record's place, limits what
    is read; elements with lists, and text files, are read by one task each, a block at a time."""

    def partitions(self) -> Sequence[Span]:
        out, (lo, hi) = [], self.bounds("nth")
        for path, _ in listed(self.path, [".ply"]):
            if not self.passes(path):
                continue
            form, elements, at = ply_header(self._uri(path))
            for e in elements:
                if e.name == self.options.get("element", "vertex"):
                    if form == "ascii" or not e.flat or not all(x.flat for x in elements[: elements.index(e)]):
                        out.append(Span(path, at, 0, e.count))
                    else:
                        width = sum(np.dtype(k).itemsize for _, k, _ in e.properties)
                        step = max(1, self.bytes // max(1, width))
                        first, last = int(max(0, lo)), int(min(e.count, hi + 1))
                        out += [Span(path, at + i * width, i, min(i + step, last)) for i in range(first, last, step)]
                    break
                if e.flat:
                    at += e.count * sum(np.dtype(k).itemsize for _, k, _ in e.properties)
        return out or [Span("", 0, 0, 0)]

    def _uri(self, path: str) -> str:
        """A file of the folder, in the file system of the folder."""
        where, at = opened(self.path)
        return path if isinstance(where, pafs.LocalFileSystem) else self.path[: len(self.path) - len(at)] + path

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        form, elements, start = ply_header(self._uri(partition.path))
        e = next(x for x in elements if x.name == self.options.get("element", "vertex"))
        where, _ = opened(self.path)
        with where.open_input_file(partition.path) as f:
            if form == "ascii":
                yield from self._text(f, partition, start, elements, e)
            elif e.flat and all(x.flat for x in elements[: elements.index(e)]):
                yield from self._fixed(f, partition, form, e)
            else:
                yield from self._ragged(f, partition, form, elements, e, start)

    def _fixed(self, f, span: Span, order: str, e: Element) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([(n, order + k) for n, k, _ in e.properties])
        f.seek(span.at)
        step = max(1, BLOCK_BYTES // kind.itemsize)
        for i in range(span.first, span.last, step):
            n = min(step, span.last - i)
            a = np.frombuffer(f.read(n * kind.itemsize), kind)
            if len(a) < n:
                raise ValueError(f"{span.path} ends early")
            columns = {"nth": np.arange(i, i + n), **{name: a[name].astype(k) for name, k, _ in e.properties}}
            yield self.batch(span.path, columns, self.kept(columns, n))

    def _ragged(self, f, span: Span, order: str, elements: list[Element], e: Element, start: int) -> Iterator[pa.RecordBatch]:
        f.seek(start)
        data, at = b"", 0
        for x in elements[: elements.index(e) + 1]:
            done = 0
            while done < x.count:
                n = min(1024, x.count - done)
                try:
                    rows, at = _lists(data, order, x, at, n)
                except IndexError:
                    more = f.read(BLOCK_BYTES)
                    if not more:
                        raise ValueError(f"{span.path} ends early") from None
                    data, at = data[at:] + more, 0
                    continue
                if x is e:
                    yield self._rows(span.path, rows, done, n, e)
                done += n

    def _text(self, f, span: Span, start: int, elements: list[Element], e: Element) -> Iterator[pa.RecordBatch]:
        f.seek(start)
        lines = io.TextIOWrapper(io.BufferedReader(_Raw(f), BLOCK_BYTES), "ascii")
        for x in elements[: elements.index(e) + 1]:
            for done in range(0, x.count, 4096):
                n = min(4096, x.count - done)
                words = [lines.readline().split() for _ in range(n)]
                if x is not e:
                    continue
                rows: dict[str, list] = {name: [] for name, _, _ in e.properties}
                for w in words:
                    i = 0
                    for name, kind, count in e.properties:
                        read = float if kind[0] == "f" else int
                        k = int(w[i]) if count else 1
                        i += bool(count)
                        rows[name].append([read(v) for v in w[i : i + k]] if count else read(w[i]))
                        i += k
                yield self._rows(span.path, rows, done, n, e)

    def _rows(self, path: str, rows: dict[str, list], done: int, n: int, e: Element) -> pa.RecordBatch:
        columns: dict = {"nth": np.arange(done, done + n)}
        for name, kind, count in e.properties:
            columns[name] = pa.array([np.array(v, kind) for v in rows[name]], pa.list_(pa.from_numpy_dtype(np.dtype(kind)))) if count else np.array(rows[name], kind)
        return self.batch(path, columns, self.kept({k: v for k, v in columns.items() if isinstance(v, np.ndarray)}, n))


class _Raw(io.RawIOBase):
    """An Arrow file as a raw Python stream."""

    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def readinto(self, b):
        got = self.f.read(len(b))
        b[: len(got)] = got
        return len(got)


class Ply(D.DataSource):
    """``path`` (a file, or a folder of .ply files), ``element``, ``partitionBytes``. Columns: path, nth and the element's properties (those of the first file)."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        for path, _ in listed(self.options["path"], [".ply"]):
            _, elements, _ = ply_header(PlyReader(T.StructType(), self.options)._uri(path))
            e = next((x for x in elements if x.name == self.options.get("element", "vertex")), None)
            if e:
                return "path string, nth bigint, " + ", ".join(f"`{n}` {'array<' + SPARK[k] + '>' if c else SPARK[k]}" for n, k, c in e.properties)
        raise ValueError("no PLY file with this element")

    def reader(self, schema):
        return pushed(PlyReader, schema, self.options)

    def writer(self, schema, overwrite):
        return PlyWriter(schema, dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite):
        return PlyStreamWriter(schema, dict(self.options), overwrite)


# points of a structure-from-motion model


POINT = struct.Struct("<QdddBBBdQ")
POINT_HEAD = np.dtype([("id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("error", "<f8"), ("length", "<u8")])
TRACK = "array<struct<image_id:int,point2d_idx:int>>"


class PointsReader(Filtered):
    """Points of binary model files. Records have no fixed width and the format no index, so the planner hops from record to record through a window
    of ``BLOCK_BYTES`` and keeps one offset for each ``partitionBytes``; a file below that isn't looked at."""

    def partitions(self) -> Sequence[Span]:
        where, _ = opened(self.path)
        out = []
        for path, size in listed(self.path, [".bin"]):
            if not self.passes(path):
                continue
            with where.open_input_file(path) as f:
                (n,) = struct.unpack("<Q", f.read(8))
                cuts = [(8, 0)]
                if size > self.bytes:
                    at, window, begin = 8, b"", 8
                    for i in range(n):
                        if at - cuts[-1][0] >= self.bytes:
                            cuts.append((at, i))
                        if at + POINT.size > begin + len(window):
                            f.seek(at)
                            begin, window = at, f.read(min(BLOCK_BYTES, max(POINT.size, self.bytes)))
                        (k,) = struct.unpack_from("<Q", window, at - begin + POINT.size - 8)
                        at += POINT.size + 8 * k
                out += [Span(path, at, i, j) for (at, i), (_, j) in zip(cuts, [*cuts[1:], (0, n)], strict=True)]
        return out or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = opened(self.path)
        with where.open_input_file(partition.path) as f:
            f.seek(partition.at)
            data, at, i = b"", 0, partition.first
            while i < partition.last:
                heads, tracks, sizes = [], [], []
                while i < partition.last:
                    if at + POINT.size > len(data):
                        break
                    (k,) = struct.unpack_from("<Q", data, at + POINT.size - 8)
                    if at + POINT.size + 8 * k > len(data):
                        break
                    heads.append(data[at : at + POINT.size])
                    tracks.append(data[at + POINT.size : at + POINT.size + 8 * k])
                    sizes.append(k)
                    at += POINT.size + 8 * k
                    i += 1
                if heads:
                    yield self._rows(partition.path, heads, tracks, sizes)
                if i < partition.last:
                    more = f.read(BLOCK_BYTES)
                    if not more:
                        raise ValueError(f"{partition.path} ends early")
                    data, at = data[at:] + more, 0

    def _rows(self, path: str, heads: list[bytes], tracks: list[bytes], sizes: list[int]) -> pa.RecordBatch:
        a = np.frombuffer(b"".join(heads), POINT_HEAD)
        pairs = np.frombuffer(b"".join(tracks), "<i4").reshape(-1, 2)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        track = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["image_id", "point2d_idx"]))
        columns = {n: a[n].astype(a[n].dtype.newbyteorder("=")) for n in POINT_HEAD.names}
        columns |= {"id": columns["id"].astype(np.int64), "length": columns["length"].astype(np.int64)}
        return self.batch(path, columns | {"track": track}, self.kept(columns, len(a)))


class Points(D.DataSource):
    """``path`` (a points3D.bin, or a folder of such files), ``partitionBytes``."""

    @classmethod
    def name(cls):
        return "points3d"

    def schema(self):
        return f"path string, id bigint, x double, y double, z double, red int, green int, blue int, error double, track {TRACK}"

    def reader(self, schema):
        return pushed(PointsReader, schema, self.options)

    def writer(self, schema, overwrite):
        return PointsWriter(schema, dict(self.options), overwrite)


# NPZ


def npz_members(f) -> dict[str, tuple[int, bool, np.dtype, tuple[int, ...]]]:
    """For each array of an archive: where its values begin (in the file, or in the member if that is deflated), whether they are stored as they are, type and shape."""
    out = {}
    with zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if info.filename.endswith(".npy"):
                with z.open(info) as m:
                    version = np.lib.format.read_magic(m)
                    shape, fortran, kind = np.lib.format.read_array_header_1_0(m) if version == (1, 0) else np.lib.format.read_array_header_2_0(m)
                    head = m.tell()
                if fortran and len(shape) > 1 or kind.hasobject:
                    raise ValueError(f"{info.filename}: only row-major arrays of plain values are read")
                stored = info.compress_type == zipfile.ZIP_STORED
                if stored:  # after the member's local header
                    f.seek(info.header_offset + 26)
                    head += info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
                out[info.filename[:-4]] = (head, stored, kind, shape)
    return out


class NpzReader(Filtered):
    """Rows along the first ``axes`` axes (1 if not said) of the arrays of an archive that have the same extent there. Stored arrays are cut at rows; a deflated one is
    inflated up to the rows wanted, a block at a time. Nothing is unpickled."""

    def partitions(self) -> Sequence[Span]:
        where, _ = opened(self.path)
        out, (lo, hi) = [], self.bounds("nth")
        for path, _ in listed(self.path, [".npz"]):
            if self.passes(path):
                with where.open_input_file(path) as f:
                    arrays = self._arrays(npz_members(f))
                rows = self._rows_of(arrays)
                width = sum(int(np.prod(s[self._axes() :], dtype=np.int64)) * k.itemsize for _, _, k, s in arrays.values())
                step = max(1, self.bytes // max(1, width))
                first, last = int(max(0, lo)), int(min(rows, hi + 1))
                out += [Span(path, 0, i, min(i + step, last)) for i in range(first, last, step)]
        return out or [Span("", 0, 0, 0)]

    def _axes(self) -> int:
        return int(self.options.get("axes", 1))

    def _arrays(self, members):
        return {n: m for n, m in members.items() if n in {f.name for f in self.schema.fields}}

    def _rows_of(self, arrays) -> int:
        extents = {s[: self._axes()] for _, _, _, s in arrays.values()}
        if len(extents) > 1:
            raise ValueError(f"arrays of different extents: {sorted(extents)}")
        return int(np.prod(extents.pop(), dtype=np.int64)) if extents else 0

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = opened(self.path)
        with where.open_input_file(partition.path) as f:
            arrays = self._arrays(npz_members(f))
        streams = {n: self._values(where, partition.path, n, m, partition.first) for n, m in arrays.items()}
        width = sum(int(np.prod(s[self._axes() :], dtype=np.int64)) * k.itemsize for _, _, k, s in arrays.values())
        step = max(1, BLOCK_BYTES // max(1, width))
        extent = next(iter(arrays.values()))[3][: self._axes()] if arrays else ()
        for i in range(partition.first, partition.last, step):
            n = min(step, partition.last - i)
            nth = np.arange(i, i + n)
            columns: dict = {"nth": nth, **{f"i{a}": x for a, x in enumerate(np.unravel_index(nth, extent))}}
            for name, (_, _, kind, shape) in arrays.items():
                per = int(np.prod(shape[self._axes() :], dtype=np.int64))
                a = np.frombuffer(streams[name](n * per * kind.itemsize), kind).astype(kind.newbyteorder("="))
                columns[name] = a if len(shape) == self._axes() else pa.FixedSizeListArray.from_arrays(pa.array(a), per) if per else pa.array([[]] * n, pa.list_(pa.from_numpy_dtype(a.dtype)))
            yield self.batch(partition.path, columns, self.kept({k: v for k, v in columns.items() if isinstance(v, np.ndarray)}, n))

    def _values(self, where, path: str, name: str, member, first: int):
        """A function that reads the next bytes of an array's values, from row ``first`` on."""
        head, stored, kind, shape = member
        skip = first * int(np.prod(shape[self._axes() :], dtype=np.int64)) * kind.itemsize
        f = where.open_input_file(path)
        if stored:
            f.seek(head + skip)
            return f.read
        m = zipfile.ZipFile(f).open(f"{name}.npy")
        left = head + skip
        while left:
            got = m.read(min(left, BLOCK_BYTES))
            if not got:
                raise ValueError(f"{path}: {name} ends early")
            left -= len(got)
        return m.read


class Npz(D.DataSource):
    """``path`` (an archive, or a folder of .npz files), ``axes``, ``partitionBytes``. Columns: path, nth, i0 ... (the place along the axes) and the arrays of the first
    archive that have as many axes at least; an array with more is an array column, row-major."""

    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        path = listed(self.options["path"], [".npz"])[0][0]
        axes = int(self.options.get("axes", 1))
        with opened(self.options["path"])[0].open_input_file(path) as f:
            members = npz_members(f)
        kind = lambda k, s: SPARK[k.newbyteorder("=").str[1:]] if len(s) == axes else f"array<{SPARK[k.newbyteorder('=').str[1:]]}>"
        return "path string, nth bigint, " + ", ".join([*(f"i{a} bigint" for a in range(axes)), *(f"`{n}` {kind(k, s)}" for n, (_, _, k, s) in members.items() if len(s) >= axes)])

    def reader(self, schema):
        return pushed(NpzReader, schema, self.options)


# writers


@dataclass
class Written(D.WriterCommitMessage):
    """What a task has written: a file of records without a header, and their number."""

    path: str
    count: int
    partition: int


class RecordWriter(D.DataSourceArrowWriter):
    """Tasks write records to files of their own in a hidden folder; the commit puts a header with the count in front. With the option ``single`` all become one file at ``path``,
    joined in the order of the tasks through a small buffer; else each task's file goes into the folder ``path``."""

    suffix = ""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"].rstrip("/"), overwrite
        self.single = options.get("single", "false").lower() == "true"
        self.hold = f"{self.path}.__writing-{uuid.uuid4().hex}"
        where, at = opened(self.path)
        if self.single and not overwrite and where.get_file_info(at).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)
        hold_in, held = opened(self.hold)
        hold_in.create_dir(held, recursive=True)  # here and not by the tasks: one that runs on after an abort finds no place to write to

    def header(self, count: int) -> bytes:
        raise NotImplementedError

    def body(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, at = opened(self.hold)
        t = TaskContext.get()
        own, n = f"{at}/{t.partitionId():05d}-{t.taskAttemptId()}", 0
        try:
            with where.open_output_stream(own) as f:
                for batch in iterator:
                    f.write(self.body(batch))
                    n += batch.num_rows
        except BaseException:
            if where.get_file_info(own).is_file:
                where.delete_file(own)
            raise
        return Written(own, n, t.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        self._place(messages, self.path)

    def _place(self, messages: list[Written | None], target: str, name: str = "part") -> None:
        where, at = opened(target)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if not self.single:
            where.create_dir(at, recursive=True)
            if self.overwrite:
                for old, _ in listed(target, [self.suffix]):
                    where.delete_file(old)
        files = [(f"{at}", parts)] if self.single else [(f"{at}/{name}-{m.partition:05d}-{self.hold[-8:]}{self.suffix}", [m]) for m in parts if m.count or len(parts) == 1]
        for path, some in files:
            whole = f"{opened(self.hold)[1]}/whole"
            with where.open_output_stream(whole) as out:
                out.write(self.header(sum(m.count for m in some)))
                for m in some:
                    with where.open_input_stream(m.path) as f:
                        while block := f.read(BLOCK_BYTES):
                            out.write(block)
            where.move(whole, path)
        where.delete_dir(opened(self.hold)[1])

    def abort(self, messages: list[Written | None]) -> None:
        where, at = opened(self.hold)
        if where.get_file_info(at).type == pafs.FileType.Directory:
            where.delete_dir(at)


#: Types of columns as those of a PLY file.
PLY_KINDS = {T.ByteType: ("char", "i1"), T.ShortType: ("short", "i2"), T.IntegerType: ("int", "i4"), T.LongType: ("double", "f8"), T.FloatType: ("float", "f4"), T.DoubleType: ("double", "f8"), T.BooleanType: ("uchar", "u1")}


class PlyWriter(RecordWriter):
    """Columns are the properties of the vertices: bytes, shorts, integers, floats and doubles as such, long as double, true and false as 1 and 0. Columns named in the option
    ``bytes`` (red, green, blue if not said) are unsigned bytes; ``path`` and ``nth`` are left out. Null is NaN, and an error where the type has none."""

    suffix = ".ply"

    def __init__(self, schema, options, overwrite):
        small = [x.strip() for x in options.get("bytes", "red,green,blue").split(",")]
        self.kinds = []
        for f in schema.fields:
            if f.name not in ("path", "nth"):
                if type(f.dataType) not in PLY_KINDS or not f.name or any(c.isspace() for c in f.name):
                    raise ValueError(f"column {f.name!r} of {f.dataType.simpleString()} is no property")
                self.kinds.append((f.name, *(("uchar", "u1") if f.name in small else PLY_KINDS[type(f.dataType)])))
        super().__init__(schema, options, overwrite)

    def header(self, count: int) -> bytes:
        return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {count}", *[f"property {k} {n}" for n, k, _ in self.kinds], "end_header", ""]).encode("ascii")

    def body(self, batch: pa.RecordBatch) -> bytes:
        a = np.zeros(batch.num_rows, np.dtype([(n, "<" + k) for n, _, k in self.kinds]))
        for name, _, kind in self.kinds:
            x = batch.column(name)
            if x.null_count and kind[0] != "f":
                raise ValueError(f"{name} is null, and {kind} has no value for it")
            a[name] = x.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) if kind[0] == "f" else x.to_numpy(zero_copy_only=False)
        return a.tobytes()


class PointsWriter(RecordWriter):
    """Points of a model, as ``spark.read.format("points3d")`` gives them; a null track is empty."""

    suffix = ".bin"

    def header(self, count: int) -> bytes:
        return struct.pack("<Q", count)

    def body(self, batch: pa.RecordBatch) -> bytes:
        columns = [batch.column(n).to_pylist() for n in ("id", "x", "y", "z", "red", "green", "blue", "error")]
        out = []
        for row, track in zip(zip(*columns, strict=True), batch.column("track").to_pylist(), strict=True):
            out.append(POINT.pack(*row, len(track or ())) + b"".join(struct.pack("<ii", t["image_id"], t["point2d_idx"]) for t in track or ()))
        return b"".join(out)


class PlyStreamWriter(D.DataSourceStreamArrowWriter):
    """Each batch's files carry its number; a batch that is written again replaces them, so every row is there once."""

    def __init__(self, schema, options, overwrite):
        self.inner = PlyWriter(schema, options | {"single": "false"}, False)

    def write(self, iterator):
        return self.inner.write(iterator)

    def commit(self, messages, batchId: int) -> None:
        where, at = opened(self.inner.path)
        name = f"batch-{batchId:09d}"
        if where.get_file_info(at).type == pafs.FileType.Directory:
            for old, _ in listed(self.inner.path, [".ply"]):
                if old.rpartition("/")[2].startswith(name):
                    where.delete_file(old)
        self.inner._place(messages, self.inner.path, name)

    def abort(self, messages, batchId: int) -> None:
        self.inner.abort(messages)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let filters be pushed into them."""
    from .. import session

    session.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Ply, Points, Npz):
        spark.dataSource.register(source)

