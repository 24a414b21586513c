"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed order.

The texts of an input partition follow each other as one stream of token ids, each text
behind the other's end mark, and the stream is cut into sequences of `length`; only the last one of a
partition is padded. Ids are those of a BPE vocabulary, two bytes each, or, without one, the
text's UTF-8 bytes, one byte each (a byte-level vocabulary; 0xFE and 0xFF, which UTF-8 never
holds, end a text and pad). The sequences are numbered through by partition and place, and
a keyed Feistel permutation with cycle-walking gives each number its slot in
[0, sequences). Slot s lies in shard s // records, at byte (s % records) * stride: each
shard is a range of slots, is written by one task in the order of slots, and is renamed to
its name when it is whole, so that a task that is run again leaves the same file. A reader
finds any slot by arithmetic and resumes anywhere.

Texts are encoded once: a first pass writes the sequences to a table in the
shared folder, with their partition and place. The numbers come from that table's counts (one small
row per input partition is all that comes to the driver), and its rows are what is permuted.

Null and empty texts have no token and no end mark. Repeated rows are texts of their own.
An empty table gives no shard. Other columns aren't read.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .common import arrow_map, shared_folder, small_batches, written
from .permute import permute



def kind_of(vocabulary: str | None) -> tuple[str, int]:
    """Array type of ids, and what pads; the number below ends a text."""
    return ("<u2", 0xFFFF) if vocabulary else ("u1", 0xFF)


def ids_of(texts: list[str | None], vocabulary: str | None) -> list[bytes]:
    """The ids of each text with its end mark, as bytes."""
    kind, pad = kind_of(vocabulary)
    if vocabulary is None:
        each = [(t or "").encode() for t in texts]
    else:
        each = [x.astype(kind).tobytes() for x in codec(vocabulary).ids_all([t or "" for t in texts], chunked=False, at_once=8 << 20)]
    end = np.array([pad - 1], kind).tobytes()
    return [e + end if e else e for e in each]


def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it, so that drivers, executors and readers open the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def open_folder(uri: str):
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def read_slots(uri: str, start: int, count: int, length: int, records: int, vocabulary: str | None = None):
    """The ids of `count` slots from `start` on, read in sequence."""
    (fs, root), (kind, pad) = open_folder(uri), kind_of(vocabulary)
    stride, slot = np.dtype(kind).itemsize * length, start
    while slot < start + count:
        shard, place = divmod(slot, records)
        here = min(records - place, start + count - slot)
        with fs.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(place * stride)
            rows = np.frombuffer(f.read(here * stride), kind).reshape(here, length)
        for row in rows:
            yield row[row != pad]
        slot += here


def materialise(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None, length: int = 1024, records: int = 8192, key: int = 1, most_writers: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards to folder (a new one in the shared folder by default); part, seq_no (the place in its partition's stream), slot, shard, position (bytes), n_tokens and doc_ids (whose tokens it has, in order) of every sequence."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder or f"{shared_folder(spark)}/linkloom/shards-{uuid.uuid4().hex}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _write(rows, vocabulary, folder, length, records, key, most_writers)


def _write(rows: DataFrame, vocabulary: str | None, folder: str, length: int, records: int, key: int, most_writers: int) -> DataFrame:
    spark = rows.sparkSession
    kind, pad = kind_of(vocabulary)
    stride = np.dtype(kind).itemsize * length

    def encode(batches):
        pid, done, rest, rest_ids = TaskContext.get().partitionId(), 0, b"", []

        def cut(raw: bytes, ends: list[tuple[int, int | None]], k: int) -> dict:
            """The first k sequences of raw; ends: where each text's tokens end, and its id."""
            docs, first = [], 0
            for i in range(k):
                last = first
                while last < len(ends) - 1 and ends[last][0] < (i + 1) * stride:
                    last += 1
                docs.append([d for _, d in ends[first : last + 1]])
                first = last + (ends[last][0] <= (i + 1) * stride)
            payload = [raw[i * stride : (i + 1) * stride] for i in range(k)]
            return {"part": np.full(k, pid), "seq_no": np.arange(done, done + k), "payload": payload, "doc_ids": docs}

        for batch in batches:
            ids, each = batch.column("doc_id").to_pylist(), ids_of(batch.column("text").to_pylist(), vocabulary)
            raw, ends, at = rest + b"".join(each), list(rest_ids), len(rest)
            for d, x in zip(ids, each, strict=True):
                if x:
                    at += len(x)
                    ends.append((at, d))
            k = len(raw) // stride
            yield cut(raw, ends, k)
            done += k
            rest, rest_ids = raw[k * stride :], [(e - k * stride, d) for e, d in ends if e > k * stride]
        if rest:
            yield cut(rest + np.full((stride - len(rest)) * length // stride, pad, kind).tobytes(), rest_ids, 1)

    table = written(arrow_map(rows, encode, "part int, seq_no long, payload binary, doc_ids array<long>"), "sequences")
    counts = sorted(table.groupBy("part").count().collect())
    offsets = np.zeros(counts[-1]["part"] + 1 if counts else 0, np.int64)
    total = 0
    for r in counts:
        offsets[r["part"]] = total
        total += r["count"]

    def place(batches):
        pack = pa.Codec("zstd", 3)
        for batch in batches:
            slots = permute(offsets[batch.column("part").to_numpy()] + batch.column("seq_no").to_numpy(), total, key)
            payload = [pack.compress(x, asbytes=True) for x in batch.column("payload").to_pylist()]
            yield {c: batch.column(c) for c in ("part", "seq_no", "doc_ids")} | {"payload": payload, "slot": slots, "shard": slots // records}

    # A shard's slots are a range, and a shard goes to one task; there are as many tasks as shards, or most_writers with several shards each.
    width = max(1, min(most_writers, -(-total // records)))
    placed = arrow_map(table, place, "part int, seq_no long, slot long, shard long, payload binary, doc_ids array<long>").repartition(width, "shard").sortWithinPartitions("shard", "slot")

    def write(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        now, out, name = None, None, None

        def close():
            out.close()
            fs.move(name, f"{root}/{shard_name(now)}")

        for batch in batches:
            shards, payload = batch.column("shard").to_numpy(), [pa.decompress(x, stride, "zstd", asbytes=True) for x in batch.column("payload").to_pylist()]
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != now:
                    if out is not None:
                        close()
                    now, name = int(shards[a]), f"{root}/.{shard_name(int(shards[a]))}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                out.write(b"".join(payload[a:b]))
            joined = np.frombuffer(b"".join(payload), kind).reshape(-1, length)
            slots = batch.column("slot").to_numpy()
            yield {"part": batch.column("part"), "seq_no": batch.column("seq_no"), "slot": slots, "shard": shards, "position": slots % records * stride, "n_tokens": (joined != pad).sum(1), "doc_ids": batch.column("doc_ids")}
        if out is not None:
            close()

    return written(arrow_map(placed, write, "part int, seq_no long, slot long, shard long, position long, n_tokens long, doc_ids array<long>"), "manifest")
