"""Token-ID output in patched frame-of-reference blocks.

A shard is one payload. Header (little-endian): magic, block length, number of ids, number of blocks,
then the start of every block's bytes. A block: least id (u32), width in bits (u8), number of
exceptions (u16), the ids less the least one packed at that width, then the exceptions' positions (u16)
and full differences (u32). The width is the smallest that fits a percentile of the block; what doesn't
fit is an exception, so one rare id doesn't widen the whole block.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC, BLOCK, PERCENTILE, END = b"PFOR", 1024, 95.0, 2
_HEAD, _BLOCK = struct.Struct("<4sHQI"), struct.Struct("<IBH")


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """ids (below 2**32) as one payload."""
    ids = np.asarray(ids, dtype=np.uint32)
    parts, starts, at = [], [], 0
    for first in range(0, len(ids), block):
        values = ids[first : first + block]
        low = values.min()
        d = values - low
        k = min(len(d) - 1, int(np.ceil(len(d) * percentile / 100)) - 1)
        width = int(np.partition(d, k)[k]).bit_length()
        odd = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        inside = d if not len(odd) else np.where(d >> np.uint32(width), 0, d).astype(np.uint32)
        packed = b""
        if width:
            bits = np.unpackbits(inside.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
            packed = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
        part = b"".join((_BLOCK.pack(int(low), width, len(odd)), packed, odd.astype("<u2").tobytes(), d[odd].astype("<u4").tobytes()))
        starts.append(at)
        at += len(part)
        parts.append(part)
    return b"".join((_HEAD.pack(MAGIC, block, len(ids), len(parts)), np.array(starts, "<u8").tobytes(), *parts))


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids start to stop (all, by default) of a payload; only their blocks are read, by the index."""
    magic, block, n, blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    stop = n if stop is None else min(stop, n)
    starts = np.frombuffer(payload, "<u8", blocks, _HEAD.size).tolist()
    base, out = _HEAD.size + 8 * blocks, []
    padded = payload + bytes(8)
    windows, bits_at = np.ndarray(len(payload), "<u8", padded, strides=(1,)), np.arange(block)
    if start >= stop:
        return np.zeros(0, np.uint32)
    for b in range(start // block, -(-stop // block)):
        at, count = base + starts[b], min(block, n - b * block)
        low, width, odd = _BLOCK.unpack_from(payload, at)
        at += _BLOCK.size
        size = -(-count * width // 8)
        values = np.zeros(count, np.uint32)
        if width:  # each value lies within the eight bytes from its first one on
            bit = bits_at[:count] * width
            values = ((windows[at + (bit >> 3)] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        at += size
        if odd:
            values[np.frombuffer(payload, "<u2", odd, at)] = np.frombuffer(payload, "<u4", odd, at + 2 * odd)
        out.append(values + np.uint32(low))
    ids = np.concatenate(out)
    first = start // block * block
    return ids[start - first : stop - first]


#: What a tokenizer file must say for the stretches between ASCII white space to be apart.
APART = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: A run of letters that stay one letter each under NFC and lower case, and a mark that is then a token of its own.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


class Encoder:
    """The tokenizer file's ids of whole texts.

    Under the settings APART, NFC and lower case never look across a space and no token holds one. So each distinct
    stretch between ASCII white space goes through the library once, and the ids of a text are those of its stretches
    in a row; Arrow splits the texts and numbers their stretches. Stretches of _PLAIN go to the library's model
    directly, in the letters that its normaliser and pre-tokenizer make of each letter. Texts for files with other
    settings go through the library whole."""

    def __init__(self, path: str, most_stretches: int = 800_000, most_ids: int = 16_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, so the library's threads only wait for each other
        self.model = Tokenizer.from_file(path)
        assert self.model.get_vocab_size() <= 1 << 16
        said = json.loads(self.model.to_str())
        self.apart = (said["normalizer"], said["pre_tokenizer"]) == APART and said["post_processor"] is None
        if self.apart:
            letters = filter(_PLAIN.fullmatch, map(chr, range(256)))
            made = {c: self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(c)) for c in letters}
            self.letters = {ord(c): pieces[0][0] for c, pieces in made.items()}
            self.marks = {m: self.model.encode(m, add_special_tokens=False).ids if m else [] for m in ("", ",", ".")}
        self.most_stretches, self.most_ids = most_stretches, most_ids
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts, self.counts = (np.zeros(0, t) for t in ("<u2", np.int64, np.int64))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in self.model.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def _library(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All stretches' ids in a row, and how many each has."""
        plain, letters, marks, tokenize = _PLAIN.fullmatch, self.letters, self.marks, self.model.model.tokenize
        split = [plain(w) for w in stretches]
        others = iter(self._whole([w for w, m in zip(stretches, split) if m is None]))
        ids, counts = array("H"), array("q")
        for m in split:
            got = next(others) if m is None else [t.id for t in tokenize(m[1].translate(letters))] + marks[m[2]]
            ids.extend(got)
            counts.append(len(got))
        return np.frombuffer(ids, "<u2"), np.frombuffer(counts, np.int64)

    def _slots(self, stretches: list[str]) -> np.ndarray:
        """Places of distinct stretches in starts and counts; those not seen before are encoded."""
        got = [*map(self.slot.get, stretches)]
        missing = [w for w, g in zip(stretches, got) if g is None]
        if not missing:
            return np.array(got, np.int64)
        if len(self.slot) + len(missing) > self.most_stretches or len(self.ids) > self.most_ids:
            self._clear()
            missing = stretches
        ids, counts = self._library(missing)
        self.slot.update(zip(missing, range(len(self.starts), len(self.starts) + len(missing))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(self.slot.__getitem__, stretches), np.int64, len(stretches))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has."""
        if not self.apart:
            whole = self._whole(texts.to_pylist())
            return np.array([i for ids in whole for i in ids], "<u2"), np.array([len(ids) for ids in whole], np.int64)
        split = pc.ascii_split_whitespace(texts)
        each = split.flatten().dictionary_encode()
        if not len(each):
            return np.zeros(0, "<u2"), np.zeros(len(texts), np.int64)
        slots = self._slots(each.dictionary.to_pylist())[each.indices.to_numpy()]
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        at = np.repeat((self.starts[slots] - (ends - counts)).astype(np.int32), counts)
        at += np.arange(len(at), dtype=np.int32)
        text_ends = np.append(0, ends)[np.cumsum(pc.list_value_length(split).to_numpy())]
        return self.ids[at], np.diff(text_ends, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(batch: pa.RecordBatch, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of some size bytes of text, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", ids_per_shard: int = 1 << 20, end: int = END, partitions: int | None = None) -> None:
    """Encode docs and write their ids, in ascending key order (null first), as a table of shards in folder.

    Columns: part (0, 1, ... in key order), shard (within part), keys and n_tokens (arrays, one entry a
    document, the end id included), payload. A shard holds whole documents and ends once it has
    ids_per_shard ids. Rows of equal keys are ordered by a hash of the text, then the text. Null texts are
    empty: only the end id."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "key", "hash").sortWithinPartitions("key", "hash", "text").select("key", "text", F.spark_partition_id().alias("part"))
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("keys", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shard, part, held, size = encoder(tokenizer), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held, size
            keys, counts, ids = zip(*held)
            row = {"part": part, "shard": shard, "keys": pa.concat_arrays(keys).to_pylist(), "n_tokens": np.concatenate(counts), "payload": pack(np.concatenate(ids))}
            shard, held, size = shard + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for some in _pieces(batch):
                part, keys = some.column("part")[0].as_py(), some.column("key")
                ids, counts = model.encode(some.column("text"))
                ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
                while len(counts):
                    take = min(int(np.searchsorted(size + np.cumsum(counts), ids_per_shard)) + 1, len(counts))
                    n_ids = int(counts[:take].sum())
                    held.append((keys[:take], counts[:take], ids[:n_ids]))
                    keys, counts, ids, size = keys[take:], counts[take:], ids[n_ids:], size + n_ids
                    if size >= ids_per_shard:
                        yield flush()
        if held:
            yield flush()

    ordered.mapInArrow(run, "part int, shard int, keys array<long>, n_tokens array<int>, payload binary").write.parquet(folder)


def read_documents(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a table of shards: the documents (part, shard, key, begin within the shard, n_tokens, ids as little-endian
    unsigned 32-bit integers), and the shards' starts (part, shard, shard_start: ids of all shards before it).

    A document starts at shard_start + begin. Only a line of totals per shard takes part in the running sum,
    within parts first and then over the parts, of which there are as many as the writer had partitions."""
    totals = shards.select("part", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("part_n"))
    first = parts.select("part", (F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n")).alias("part_start"))
    offsets = totals.withColumn("in_part", F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).join(first, "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("shard_start"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, shard, keys, n, payload in zip(frame["part"], frame["shard"], frame["keys"], frame["n_tokens"], frame["payload"]):
                ids, ends = unpack(payload).astype("<u4"), np.cumsum(n)
                begins = ends - n
                key = pd.array([None if pd.isna(k) else int(k) for k in keys], dtype="Int64")
                for at in range(0, len(n), 256):
                    some = slice(at, at + 256)
                    yield pd.DataFrame({"part": part, "shard": shard, "key": key[some], "begin": begins[some], "n_tokens": np.asarray(n[some], np.int64), "ids": [ids[b:e].tobytes() for b, e in zip(begins[some], ends[some])]})

    rows = shards.mapInPandas(run, "part int, shard int, key long, begin long, n_tokens long, ids binary")
    return rows, offsets
