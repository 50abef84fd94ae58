"""Token-id output: canonical length-limited Huffman code, independent blocks with bit-offset checkpoints, table-driven decoding.

A file is a folder of Parquet tables, so that any store that Spark reaches holds it: ``codebook`` (one row: the code length of each
id, a byte each, deflated) and ``blocks`` (one row a block, in ascending order of ``part`` and ``block``). A block's image, little-endian::

    magic b"PLH2", crc32 uint32 of all that follows, documents uint32, ids uint32, checkpoints uint32
    doc_id int64 of each document; ids of each document, uint32
    bit offset uint64 of each ``EVERY``-th id; bits of the codes, most significant first, zero-padded

Each block can be decoded alone, from any checkpoint, with the codebook.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, tokens, work

MAGIC, EVERY, MAX_BITS = b"PLH2", 512, 18
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 19


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # each level's list: the single ids merged with pairs of the level below; how many of each prefix are single ids
    level, singles = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        singles.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for mark in reversed(singles):
        k = int(mark[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    per = np.bincount(lengths[order], minlength=65)
    at = 0
    for n in range(1, 65):
        code <<= n - last
        last = n
        k = int(per[n])
        codes[order[at : at + k]] = np.arange(code, code + k, dtype=np.uint64)
        code, at = code + k, at + k
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every possible next ``limit`` bits."""
    ids, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (limit - lengths[order].astype(np.int64))
    n = int(span.sum())
    ids[:n], bits[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` and the bit offset of each ``EVERY``-th."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(end) else 0
    word, shift = at >> 6, 64 - (at & 63) - n
    c = codes[ids]
    high = np.where(shift >= 0, c << np.maximum(shift, 0).astype(np.uint64), c >> np.maximum(-shift, 0).astype(np.uint64))
    out = np.zeros((total + 63) // 64 + 1, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(shift < 0)  # one code at most runs over each word's end
        out[word[over] + 1] |= c[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], at[::EVERY].astype(np.uint64)


def unpack(data: bytes, starts: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = MAX_BITS) -> np.ndarray:
    """``n`` ids from ``data``; all checkpoints' runs are decoded side by side."""
    ids, bits = table
    if not n:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]  # 32 bits from each byte
    at, lanes = starts.astype(np.int64), len(starts)
    out = np.zeros((EVERY, lanes), np.uint32)
    mask, down = np.uint32((1 << limit) - 1), 32 - limit
    for k in range(EVERY):
        live = lanes if k < n - (lanes - 1) * EVERY else lanes - 1
        a = at[:live]
        x = (window[a >> 3] >> (down - (a & 7)).astype(np.uint32)) & mask
        out[k, :live] = ids[x]
        at[:live] = a + bits[x]
    return out.T.reshape(-1)[:n]


def write_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    data, marks = pack(ids, codes, lengths)
    body = b"".join([struct.pack("<3I", len(doc_ids), len(ids), len(marks)), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), marks.astype("<u8").tobytes(), data])
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def read_block(image: bytes, table: tuple[np.ndarray, np.ndarray], limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, ids) of a block."""
    if image[:4] != MAGIC:
        raise ValueError("not a block")
    if zlib.crc32(memoryview(image)[8:]) != struct.unpack_from("<I", image, 4)[0]:
        raise ValueError("a block is damaged")
    d, n, m = struct.unpack_from("<3I", image, 8)
    doc_ids = np.frombuffer(image, "<i8", d, 20)
    sizes = np.frombuffer(image, "<u4", d, 20 + 8 * d)
    marks = np.frombuffer(image, "<u8", m, 20 + 12 * d)
    return doc_ids, sizes, unpack(image[20 + 12 * d + 8 * m :], marks, n, table, limit)


def write_ids(documents: DataFrame, path: str, closing: int = 1, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``documents`` (doc_id, text) and write the file ``path`` in ascending order of doc_id.

    Null or empty text: only the closing id. A null doc_id stands for the smallest long and comes first; repeated ids keep every row, in
    the order of their ids' bytes; an empty table gives a file without blocks; other columns are not read. Global counts are a sum over
    all documents; only they (one number for each id of the vocabulary) reach the driver. Very long texts are read whole and are blocks of their
    own. Codes have ``MAX_BITS`` at most, or as many as the vocabulary needs.
    """
    spark, vocab = documents.sparkSession, vocabulary or tokens.vocabulary_path()
    size = max(tokens.vocabulary_size(vocab), closing + 1)
    kind, bits = "<u2" if size <= 65536 else "<u4", max(MAX_BITS, (size - 1).bit_length())
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))

    def encode(batches):
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, hi, ids, sizes in tokens.encode_documents(batch.column(1), vocab, closing):
                offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                wide = ids.astype(kind)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offs * wide.itemsize), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), binary.cast(pa.binary())], ["doc_id", "ids"])

    raw, raw_path = work.store(documents.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textkit.frugal(encode, True), "doc_id long, ids binary"), "ids")

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in raw.select("ids").mapInArrow(textkit.frugal(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts, bits)
    spark.createDataFrame([(bytearray(zlib.compress(lengths.tobytes())), bits)], "lengths binary, max_bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def blocks(batches):
        from pyspark import TaskContext

        codes, sizes_of = shared.value
        part, block, held, docs, n, before = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def close():
            sizes = np.fromiter((len(x) for x in held), np.int64, len(held))
            ids = np.concatenate(held)
            image = write_block(np.array(docs, np.int64), sizes, ids, codes, sizes_of)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([before], pa.int64()), pa.array([image], pa.binary())], ["part", "block", "n_docs", "n_ids", "ids_before", "image"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), kind)
                if n and n + len(ids) > block_ids:
                    yield close()
                    block, held, docs, n, before = block + 1, [], [], 0, before + n
                held.append(ids)
                docs.append(d)
                n += len(ids)
        if n:
            yield close()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = raw.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(textkit.frugal(blocks), "part int, block int, n_docs long, n_ids long, ids_before long, image binary").write.parquet(f"{path}/blocks")
    work.drop(spark, raw_path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary uint32) of every document of a file, decoded block by block.

    ``start``: ids of all documents before it in the file. Only the ids a partition holds reach the driver, one number each.
    """
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths, limit = np.frombuffer(zlib.decompress(bytes(book.lengths)), np.uint8), book.max_bits
    blocks = spark.read.schema("part int, block int, n_docs long, n_ids long, ids_before long, image binary").parquet(f"{path}/blocks")
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r.part], total = total, total + r.n
    shared = spark.sparkContext.broadcast((lengths, before))

    def decode(batches):
        own, parts = shared.value
        table = decode_table(own, limit)
        for batch in batches:
            for part, ahead, image in zip(*(batch.column(i) for i in range(3)), strict=True):
                docs, n, ids = read_block(image.as_py(), table, limit)
                ends = np.cumsum(n.astype(np.int64))
                wide = np.ascontiguousarray(ids.astype("<u4"))
                view = memoryview(wide).cast("B")
                crc = [zlib.crc32(view[4 * (z - k) : 4 * z]) for k, z in zip(n.tolist(), ends.tolist(), strict=True)]
                offs = np.concatenate([[0], 4 * ends]).astype(np.int64)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(offs), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts[part.as_py()] + ahead.as_py() + ends - n, pa.int64()), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()), binary.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.select("part", "ids_before", "image").mapInArrow(textkit.frugal(decode), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work.table_path(spark, "huffman")
    write_ids(work.read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return work.store(read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32"), "read")[0]
