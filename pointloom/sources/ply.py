"""PLY vertex tables (ascii and little-endian binary), read from whole files in parallel."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scalar types of the format, fixed values.
KINDS = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse(data: bytes) -> pd.DataFrame:
    """The vertex element of a PLY file."""
    at = data.index(b"end_header\n") + len(b"end_header\n")
    lines = data[:at].decode("ascii").splitlines()
    if lines[0] != "ply":
        raise ValueError("not a PLY file")
    form, n, fields, inside = "ascii", 0, [], False
    for line in lines[1:]:
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            fields.append((w[2], KINDS[w[1]]))
    if form == "ascii":
        rows = [r.split() for r in data[at:].decode("ascii").splitlines()[:n]]
        return pd.DataFrame({name: np.array([r[i] for r in rows]).astype(kind) if rows else np.zeros(0, kind) for i, (name, kind) in enumerate(fields)})
    order = "<" if form == "binary_little_endian" else ">"
    a = np.frombuffer(data, np.dtype([(x, order + k) for x, k in fields]), n, at)
    return pd.DataFrame({x: a[x].astype(k) for x, k in fields})


def render(rows: pd.DataFrame) -> bytes:
    """A binary PLY file: byte columns stay bytes, all others are 4-byte floats."""
    kinds = [(c, "u1" if rows[c].dtype == np.uint8 else "<f4") for c in rows.columns]
    a = np.zeros(len(rows), np.dtype(kinds))
    for x, _ in kinds:
        a[x] = rows[x]
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *[f"property {'uchar' if k == 'u1' else 'float'} {x}" for x, k in kinds], "end_header", ""]
    return "\n".join(head).encode("ascii") + a.tobytes()


def numbered(columns: list[str], prefix: str) -> list[str]:
    """Columns ``prefix``N by number, so that 10 follows 9."""
    return sorted((c for c in columns if re.fullmatch(re.escape(prefix) + r"\d+", c)), key=lambda c: int(c[len(prefix) :]))


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, red, green, blue): colours in [0, 1]."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                v = parse(bytes(data))
                yield pd.DataFrame({"path": p, **{c: v[c].astype(float) for c in "xyz"}, **{c: v[c].astype(float) / 255 for c in ("red", "green", "blue")}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x double, y double, z double, red double, green double, blue double")


def read_splats(spark: SparkSession, path: str, rest: int | None = None) -> DataFrame:
    """(path, gid, x, y, z, f_dc, f_rest, opacity_logit, log_scale, rot); ``rest``: the width that f_rest must have."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                v = parse(bytes(data))
                names = {k: numbered(list(v.columns), k) for k in ("f_dc_", "f_rest_", "scale_", "rot_")}
                if rest is not None and len(names["f_rest_"]) != rest:
                    raise ValueError(f"{len(names['f_rest_'])} f_rest columns; {rest} are needed")
                pack = lambda k: list(v[names[k]].to_numpy("f4")) if names[k] else [np.zeros(0, "f4")] * len(v)  # noqa: E731, B023
                yield pd.DataFrame({"path": p, "gid": np.arange(len(v)), "x": v["x"], "y": v["y"], "z": v["z"], "f_dc": pack("f_dc_"), "f_rest": pack("f_rest_"), "opacity_logit": v["opacity"], "log_scale": pack("scale_"), "rot": pack("rot_")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, gid long, x float, y float, z float, f_dc array<float>, f_rest array<float>, opacity_logit float, log_scale array<float>, rot array<float>")


def flatten_splats(splats: DataFrame, dc: int, rest: int, scales: int) -> DataFrame:
    """The flat columns that a splat file has."""
    c = F.col
    return splats.select("x", "y", "z", *[F.lit(0.0).cast("float").alias(n) for n in ("nx", "ny", "nz")], *[c("f_dc")[i].alias(f"f_dc_{i}") for i in range(dc)], *[c("f_rest")[i].alias(f"f_rest_{i}") for i in range(rest)], c("opacity_logit").alias("opacity"), *[c("log_scale")[i].alias(f"scale_{i}") for i in range(scales)], *[c("rot")[i].alias(f"rot_{i}") for i in range(4)])


def files(rows: DataFrame, key: str) -> DataFrame:
    """(key, content): one PLY file for each key, as bytes that any sink can write; rows of a key must fit one task, as its file must."""
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        body = pdf.drop(columns=[key])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [render(body.astype({c: np.uint8 for c in ("red", "green", "blue") if c in body}))]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, content binary")
