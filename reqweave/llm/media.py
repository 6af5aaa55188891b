"""Media columns: payloads stored as sound files, in content-defined chunks that are kept once.

A payload becomes a WAV file of 8-bit samples. A rolling gear hash cuts the file where
its content says so, so equal passages give equal chunks wherever they are. Chunks
that occur once stay in the row of their file; of chunks that occur more often,
one occurrence is kept in a chunk table, found by joins on their digests, and the files
hold references. A file is read back by its ordered chunk list, every shared chunk and the
whole file verified by digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work, lean

UNIT, FILL = 576, 255
RATE = 8000
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 8192, 11
#: Bits of the filter that tells which chunks may be shared: for each shared chunk, and at most (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
BLOCK = 4 << 20


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes and bytes 255 (which UTF-8 never has) up to a positive multiple of 576."""
    data = (text or "").encode()
    return data + bytes([FILL]) * (-len(data) % UNIT or (UNIT if not data else 0))


def to_wav(payload: bytes) -> bytes:
    """A WAV file, one channel of unsigned 8-bit samples: the payload's bytes."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file of that kind."""
    riff, size, wave = struct.unpack_from("<4sI4s", media)
    if riff != b"RIFF" or wave != b"WAVE" or size != len(media) - 8:
        raise ValueError("not a WAV file, or cut short")
    at = 12
    while True:
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def gear_table() -> np.ndarray:
    """A random-looking number for each byte, by a mixing rule."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype(np.uint32)


GEAR = gear_table()


def _candidates(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where the top bits of the gear hash, which rolls over 32 bytes, are zero."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def _ends(candidates: list[int], length: int) -> list[int]:
    out, start, i = [], 0, 0
    while length - start > MIN_CHUNK:
        while i < len(candidates) and candidates[i] < start + MIN_CHUNK:
            i += 1
        end = min(candidates[i] if i < len(candidates) else length, start + MAX_CHUNK, length)
        out.append(end)
        start = end
    if start < length:
        out.append(length)
    return out


def chunked(files: list[bytes]) -> list[list[bytes]]:
    """The chunks of each file. Files are hashed together; as no chunk ends in a file's first 512 bytes, neighbours don't matter."""
    out: list[list[bytes]] = []
    at = 0
    while at < len(files):
        upto, total = at, 0
        while upto < len(files) and (upto == at or total + len(files[upto]) <= BLOCK):
            total += len(files[upto])
            upto += 1
        found = _candidates(np.frombuffer(b"".join(files[at:upto]), np.uint8))
        start = 0
        for f in files[at:upto]:
            a, b = np.searchsorted(found, (start + 1, start + len(f)))
            cuts = _ends((found[a:b] - start).tolist(), len(f))
            out.append([f[x:y] for x, y in zip([0, *cuts], cuts)])
            start += len(f)
        at = upto
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


class MaybeShared:
    """A Bloom filter of digests: two bits each, taken from the digest itself.

    It has ``BITS_EACH`` bits for each digest, up to ``MOST_BITS`` (eight million digests); with more it grows no more,
    so more chunks that are not shared are taken for shared ones, which costs space only.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.size = words, 64 * len(words)

    @staticmethod
    def bits(digests: DataFrame, size: int) -> DataFrame:
        """(word, bits) of the filter of ``size`` bits that holds ``digests``."""
        number = lambda at: F.conv(F.hex(F.substring("digest", at, 4)), 16, 10).cast("long") % size
        places = digests.select(F.explode(F.array(number(1), number(5))).alias("at"))
        bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
        return places.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))

    @classmethod
    def of(cls, digests: DataFrame) -> MaybeShared:
        size = min(MOST_BITS, 1 << max(10, (BITS_EACH * digests.count()).bit_length()))
        words = np.zeros(size // 64, np.int64)
        table = cls.bits(digests, size).toArrow()  # size / 64 rows at most
        words[table["word"].to_numpy()] = table["bits"].to_numpy()
        return cls(words.view(np.uint64))

    def __contains__(self, d: bytes) -> bool:
        return all(int(self.words[at >> 6]) >> (at & 63) & 1 for at in (int.from_bytes(d[i : i + 4], "big") % self.size for i in (0, 4)))


@dataclass
class Store:
    """files: (rid, id, sha, parts: the ordered chunk list, with the bytes of those that are kept here); chunks: (digest, data)."""

    work: Work
    files: DataFrame
    chunks: DataFrame


_PART = pa.struct([("digest", pa.binary()), ("data", pa.binary())])
_STORED = "kind string, seq long, id long, sha string, parts array<struct<digest: binary, data: binary>>, pos int, digest binary, data binary"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Writes the media of every row (null texts: empty) to the shared folder.

    Chunks that the filter takes for shared by mistake are stored like shared ones, so the filter's errors cost
    space and nothing else. Ids may be null or repeated: files are told apart by their place in the table.
    """
    work = Work(docs.sparkSession, "media")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                texts = whole.column(0).slice(at, 512).to_pylist()
                found = [digest(c) for f in chunked([to_wav(payload_of(t)) for t in texts]) for c in f]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    shared = rows.select("text").mapInArrow(lean(digests), "digest binary").groupBy("digest").count().where("count > 1")
    words = MaybeShared.of(work.save(shared.select("digest"), "shared")).words
    work.keep_only()
    sent = docs.sparkSession.sparkContext.broadcast(words.tobytes())  # MOST_BITS / 8 bytes at most

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = MaybeShared(np.frombuffer(sent.value, np.uint64))
        seq, given = 0, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                files = [to_wav(payload_of(t)) for t in batch.column(1).to_pylist()]
                out: list[tuple] = []
                for i, f, chunks in zip(batch.column(0).to_pylist(), files, chunked(files)):
                    parts = []
                    for pos, c in enumerate(chunks):
                        d = digest(c)
                        parts.append({"digest": d, "data": None if d in maybe else c})
                        if parts[-1]["data"] is None and d not in given:  # a task gives each chunk once
                            given.add(d)
                            out.append(("chunk", seq, None, None, None, pos, d, c))
                    out.append(("file", seq, i, hashlib.sha256(f).hexdigest(), parts, None, None, None))
                    seq += 1
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(_PART), pa.int32(), pa.binary(), pa.binary()]
                names = ["kind", "seq", "id", "sha", "parts", "pos", "digest", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    # the file's number: its place among the files of its partition, and the partition's number
    rid = F.shiftleft(F.spark_partition_id().cast("long"), 40).bitwiseOR(F.col("seq"))
    written = work.save(rows.mapInArrow(lean(stored), _STORED).withColumn("rid", rid).drop("seq"), "written", by="kind")
    spots = written.where("kind = 'chunk'")
    first = spots.groupBy("digest").agg(F.min(F.struct("rid", "pos")).alias("at")).select("digest", "at.rid", "at.pos")
    chunks = work.save(spots.join(first, ["digest", "rid", "pos"]).select("digest", "data"), "chunks")
    work.drop("written/kind=chunk")
    return Store(work, written.where("kind = 'file'").select("rid", "id", "sha", "parts"), chunks)


def load(stored: Store) -> DataFrame:
    """(id, media, sha, n_chunks): every file put together from its chunk list and verified.

    Only files with references take part in a join; a chunk that very many files share makes a
    skewed join, whose large side Spark splits.
    """
    files = stored.files.withColumn("refs", F.size(F.filter("parts", lambda p: p["data"].isNull())))
    place = files.where("refs > 0").select("rid", F.posexplode("parts").alias("pos", "part")).where("part.data is null")
    wanted = place.select("rid", "pos", F.col("part.digest").alias("digest"))
    fetched = wanted.join(stored.chunks, "digest").groupBy("rid").agg(F.collect_list(F.struct("pos", "data")).alias("got"))
    partial = files.where("refs > 0").join(fetched, "rid").select("id", "sha", "parts", "got")
    none = F.lit(None).cast("array<struct<pos: int, data: binary>>")
    whole = files.where("refs = 0").select("id", "sha", "parts", none.alias("got"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                media, counts = [], []
                for sha, parts, got in zip(*(batch.column(c).to_pylist() for c in ("sha", "parts", "got"))):
                    fetched = {g["pos"]: g["data"] for g in got or ()}
                    data = []
                    for pos, p in enumerate(parts):
                        c = p["data"] if p["data"] is not None else fetched[pos]
                        if p["data"] is None and digest(c) != p["digest"]:
                            raise ValueError(f"chunk {pos} is not what was stored")
                        data.append(c)
                    media.append(b"".join(data))
                    counts.append(len(parts))
                    if hashlib.sha256(media[-1]).hexdigest() != sha:
                        raise ValueError("the file is not what was stored")
                cols = [batch.column("id"), pa.array(media, pa.binary()), batch.column("sha"), pa.array(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "media", "sha", "n_chunks"])

    return whole.unionByName(partial).mapInArrow(lean(run), "id long, media binary, sha string, n_chunks int")


_MEASURED = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def feature(payload: bytes) -> str:
    """Of the samples around their middle: mean and root mean square in thousandths, crossings of the middle, peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = int((float((x * x).sum()) / len(x)) ** 0.5 * 1000)
    return f"mean={int(x.sum()) * 1000 // len(x)};rms={rms};crossings={crossings};peak={int(np.abs(x).max())}"


def measure(media: DataFrame) -> DataFrame:
    """Payload, sizes, digests and features of media as ``load`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _MEASURED.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in _MEASURED.split(", ")]
        for big in batches:
            for at in range(0, big.num_rows, 512):
                out = []
                for i, m, n in zip(*(big.column(c).slice(at, 512).to_pylist() for c in ("id", "media", "n_chunks"))):
                    p = from_wav(m)
                    n_bytes = len(p.rstrip(bytes([FILL])))
                    out.append((i, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return media.mapInArrow(lean(run), _MEASURED)
