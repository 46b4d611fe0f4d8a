"""Media payloads stored as content-defined chunks, each distinct chunk once.

A payload (a text's UTF-8 bytes, filled up with 255 to a multiple of ``UNIT``) is cut
where a rolling gear hash of its last 32 bytes has ``MASK`` bits zero, between ``LEAST``
and ``MOST`` bytes after the last cut. A payload's manifest is its ordered list of
chunk digests and lengths.

Storing takes two passes over the texts, which stay where they are read:
1. Manifests only. Equal payloads are one object, kept by the row with the smallest
   id; Spark joins on chunk digests find the chunks that several objects share, and
   the object that stores each of them.
2. Bytes. An object's row has its manifest and the bytes of chunks that no other
   object has; shared chunks are rows of a table of their own, each written once.
Reading back puts together objects without shared chunks where they are read; only
the others are joined with the shared chunks. Every chunk and payload is verified
against its digest.

The stored form of an object is its manifest, followed by its distinct chunks in order
of appearance; ``media_bytes`` and ``media_sha256`` are of these bytes.

Defined results: null and empty texts are one unit of 255s; repeated rows and equal
texts get equal values and are stored once (rows equal in id and text: once each, read
back as one); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import column, flat, slices
from spanlake.llm.tables import mapped, split_by_keys, write_scratch
from spanlake.session import scratch_path

UNIT, LEAST, MOST, MASK = 576, 1024, 16_384, (1 << 12) - 1 << 20
MAGIC = b"CDC1"
DIGEST = 32
#: Gear values: a fixed random number for each byte.
GEAR = np.random.Generator(np.random.PCG64(576)).integers(0, 1 << 32, 256, dtype=np.uint32)

MANIFESTS = "doc_id long, row_hash long, object binary, n_bytes long, digests array<binary>, lengths array<int>"
STORED = "object binary, manifest binary, own binary, n_shared int"
FEATURES = "object binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payloads(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, lengths without the filling) of the padded payloads."""
    raw, offsets = flat(values)
    n = np.diff(offsets)
    full = np.maximum(-(-n // UNIT), 1) * UNIT
    at = np.concatenate([[0], np.cumsum(full)])
    data = np.full(int(at[-1]), 255, np.uint8)
    data[np.repeat(at[:-1] - offsets[:-1], n) + np.arange(len(raw))] = raw
    return data, at, n


def cut(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ends of each payload's chunks, counted from its start."""
    # The gear hash h = 2 h + gear[byte] forgets what is 32 bytes back: sums of 1, 2, 4, ... bytes.
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero((h & np.uint32(MASK)) == 0) + 1
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        # The first 31 bytes of a payload also hash what stands before it; cuts come later than that.
        mine = (marks[np.searchsorted(marks, lo) : np.searchsorted(marks, hi, "right")] - lo).tolist()
        ends, last = [], 0
        for m in mine:
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST and m < hi - lo:
                ends.append(m)
                last = m
        while hi - lo - last > MOST:
            last += MOST
            ends.append(last)
        out.append(np.array([*ends, hi - lo]))
    return out


def _described(values: pa.Array):
    """Per row: (payload view, ends of chunks, digests of chunks, object digest, length unpadded)."""
    data, at, n = payloads(values)
    view = memoryview(data)
    for i, ends in enumerate(cut(data, at)):
        body = view[at[i] : at[i + 1]]
        bounds = [0, *ends.tolist()]
        digests = [hashlib.sha256(body[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield body, bounds, digests, hashlib.sha256(body).digest(), int(n[i])


def manifest(length: int, digests: list[bytes], sizes: list[int]) -> bytes:
    return struct.pack("<4sQI", MAGIC, length, len(sizes)) + b"".join(d + struct.pack("<I", s) for d, s in zip(digests, sizes, strict=True))


def parsed(data: bytes) -> tuple[int, list[bytes], list[int]]:
    magic, length, n = struct.unpack_from("<4sQI", data)
    if magic != MAGIC:
        raise ValueError("no manifest")
    at = range(16, 16 + n * (DIGEST + 4), DIGEST + 4)
    return length, [data[i : i + DIGEST] for i in at], [struct.unpack_from("<I", data, i + DIGEST)[0] for i in at]


def _manifests(batches):
    for batch in slices(batches):
        rows = [(o, n, d, np.diff(b).tolist()) for _, b, d, o, n in _described(column(batch, "text"))]
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id").cast(pa.int64()), column(batch, "row_hash"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.binary())), pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            ],
            names=["doc_id", "row_hash", "object", "n_bytes", "digests", "lengths"],
        )


def _stored(batches):
    """Objects and shared chunks of the rows that keep any, in one layout: a chunk has no manifest."""
    for batch in slices(batches):
        keeps, shared, gives = (column(batch, c).to_pylist() for c in ("keeps", "shared", "gives"))
        objects, manifests, own, counts = [], [], [], []
        for i, (body, b, digests, name, n) in enumerate(_described(column(batch, "text"))):
            if not keeps[i] or column(batch, "object")[i].as_py() not in (None, name):
                continue
            common, given = set(shared[i] or ()), set(gives[i] or ())
            private, seen = [], set()
            for k, d in enumerate(digests):
                if k in common or d in seen:
                    continue
                seen.add(d)
                private.append(body[b[k] : b[k + 1]])
            objects.append(name)
            manifests.append(manifest(n, digests, np.diff(b).tolist()))
            own.append(b"".join(private))
            counts.append(len(common))
            for k in sorted(given):
                objects.append(digests[k])
                manifests.append(None)
                own.append(bytes(body[b[k] : b[k + 1]]))
                counts.append(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(objects, pa.binary()), pa.array(manifests, pa.binary()), pa.array(own, pa.binary()), pa.array(counts, pa.int32())],
            names=["object", "manifest", "own", "n_shared"],
        )


def write(docs: DataFrame, path: str) -> DataFrame:
    """Stores the payloads under ``path``; returns (doc_id, object, n_bytes) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_hash"))
    rows = write_scratch(mapped(texts, _manifests, MANIFESTS), "manifests")
    # One row per distinct payload: the row that keeps it, and its chunks.
    objects = rows.groupBy("object").agg(F.min("doc_id").alias("keeper"), F.first("digests").alias("digests"))
    objects = write_scratch(objects, "objects")
    uses = objects.select("object", "keeper", F.posexplode("digests").alias("place", "digest"))
    chunks = uses.groupBy("digest").agg(
        F.min("object").alias("a"), F.max("object").alias("b"), F.min(F.struct("object", "place")).alias("giver")
    ).where("a != b")
    # Written tables on both sides of these joins: a digest that very many objects share is then split.
    chunks = write_scratch(chunks.select("digest", "giver"), "shared-chunks")
    shared = uses.join(chunks, "digest")
    gives = (F.col("giver")["object"] == F.col("object")) & (F.col("giver")["place"] == F.col("place"))
    plan = shared.groupBy("object").agg(F.collect_list("place").alias("shared"), F.collect_list(F.when(gives, F.col("place"))).alias("gives"))
    # Rows that differ from the rule "kept, nothing shared": copies of kept payloads, and objects with shared chunks.
    kept = write_scratch(objects.select("object", "keeper").join(plan, "object", "left"), "kept")
    odd = rows.select("doc_id", "row_hash", "object").join(kept, "object").withColumn("keeps", F.col("doc_id").eqNullSafe(F.col("keeper")))
    odd = odd.where("NOT keeps OR shared IS NOT NULL").select(
        F.col("doc_id").alias("odd_id"), F.col("row_hash").alias("odd_hash"), "object", "keeps", "shared", "gives"
    )
    odd = write_scratch(odd.distinct(), "decisions")
    # Keyed by id and text, so that rows with one id and several texts stay apart.
    stay, asked = split_by_keys(texts, F.col("r.row_hash"), odd.select("odd_hash"))
    asked = asked.join(odd.hint("merge"), (F.col("row_hash") == F.col("odd_hash")) & F.col("doc_id").eqNullSafe(F.col("odd_id")), "left")
    asked = asked.select("text", "object", F.coalesce("keeps", F.lit(True)).alias("keeps"), "shared", "gives")
    none = lambda c: F.lit(None).cast(asked.schema[c].dataType).alias(c)
    planned = stay.select("text", none("object"), F.lit(True).alias("keeps"), none("shared"), none("gives")).unionByName(asked)
    mapped(planned, _stored, STORED).write.option("compression", "zstd").parquet(path)
    return rows.select("doc_id", "object", "n_bytes")


def _featured(batches):
    """Rebuilds payloads from manifest, own bytes and the shared chunks that came along, and describes them."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            out = [_feature(*row) for row in zip(*(column(part, c).to_pylist() for c in ("object", "manifest", "own", "chunks")), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=_FEATURE_SCHEMA)


def _feature(name: bytes, header: bytes, own: bytes, chunks: list[dict] | None) -> dict:
    length, digests, sizes = parsed(header)
    known = {c["digest"]: c["body"] for c in chunks or ()}
    at = 0
    for d, n in zip(digests, sizes, strict=True):
        if d not in known:
            known[d] = own[at : at + n]
            at += n
    if at != len(own) or any(hashlib.sha256(known[d]).digest() != d for d in set(digests)):
        raise ValueError(f"chunks of {name.hex()} are not what its manifest lists")
    payload = b"".join(known[d] for d in digests)
    if hashlib.sha256(payload).digest() != name:
        raise ValueError(f"payload {name.hex()} is not what was stored")
    media = header + b"".join(known[d] for d in dict.fromkeys(digests))
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples >> 4, minlength=16)
    return {
        "object": name,
        "payload_bytes": len(payload),
        "payload_sha256": name.hex(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"chunks={len(sizes)};distinct={len(set(digests))};longest={max(sizes)};mean={samples.mean():.4f};histogram={','.join(map(str, counts))}",
    }


_FEATURE_SCHEMA = pa.schema(
    [("object", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _references(batches):
    """(object, digest) of the chunks that objects share with others: those without own bytes are asked for."""
    for batch in batches:
        objects, digests = [], []
        for name, header in zip(column(batch, "object").to_pylist(), column(batch, "manifest").to_pylist(), strict=True):
            for d in dict.fromkeys(parsed(header)[1]):
                objects.append(name)
                digests.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(objects, pa.binary()), pa.array(digests, pa.binary())], names=["object", "digest"])


def read(spark, path: str) -> DataFrame:
    """One row of features per stored object, from the stored bytes."""
    stored = spark.read.schema(STORED).parquet(path)
    objects = stored.where("manifest IS NOT NULL")
    alone = objects.where("n_shared = 0").withColumn("chunks", F.lit(None).cast("array<struct<digest: binary, body: binary>>"))
    sharing = objects.where("n_shared > 0")
    bodies = stored.where("manifest IS NULL").select(F.col("object").alias("digest"), F.col("own").alias("body"))
    wanted = mapped(sharing.select("object", "manifest"), _references, "object binary, digest binary")
    fetched = wanted.join(bodies, "digest").groupBy("object").agg(F.collect_list(F.struct("digest", "body")).alias("chunks"))  # an object's chunks
    joined = sharing.join(fetched, "object")
    columns = ["object", "manifest", "own", "chunks"]
    return mapped(alone.select(columns), _featured, FEATURES).unionByName(mapped(joined.select(columns), _featured, FEATURES))


def media(docs: DataFrame) -> DataFrame:
    """Stores every document's payload and reads it back: one row per document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    rows = write(docs, path)
    found = write_scratch(read(spark, path).dropDuplicates(["object"]), "features")
    return rows.join(found, "object").drop("object")
