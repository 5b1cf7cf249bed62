"""Token ids in packed binary files.

Every id takes the fewest bits that hold the vocabulary. A shard file is

    magic "TKPK", version, bits, block size, documents, tokens      (little-endian, 40 bytes)
    blocks of BLOCK ids, each padded to whole bytes: block k starts at HEADER + k * block bytes
    document index: for each document its first id and id count     (two uint64)
    offsets of the blocks                                           (uint64 each)
    footer: place of the document index, place of the block offsets (two uint64)

so any range of ids is read by seeking to its blocks and unpacked by numpy without a loop over ids. Shards follow
each other in ascending doc_id order; shard_base gives the ids before each.

Shape: documents are range-partitioned by doc_id (ties by text hash, so one id repeated many times still spreads),
sorted within partitions, encoded after the shuffle and written by the task that holds them, under a name of its
own that is renamed when complete: a task that is run again replaces its file by an equal one. The driver sees one
row per shard.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean, put_in_place, shared_folder, slices, text_array

MAGIC, VERSION = b"TKPK", 1
HEADER = struct.Struct("<4sHHQQQQ")
FOOTER = struct.Struct("<QQ")
#: Ids in a block; a multiple of 8, so that every block is whole bytes.
BLOCK = 1 << 16
END_ID = 2
#: Text bytes that one shard holds, about; it sets the number of shards.
SHARD_BYTES = 32 << 20
#: Pieces kept encoded by a worker; once full, further ones are encoded whenever they occur.
KEPT_PIECES = 400_000
#: Text bytes that are encoded at a time: what is no longer kept is encoded once in each.
STEP_BYTES = 6 << 20
#: Characters of a piece above which it is not kept, so that what is kept is bounded in bytes as well.
LONG_PIECE = 64
#: Pieces that go to the library in one text.
JOINED_PIECES = 1000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell `vocabulary` ids apart."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian bit fields, padded to whole bytes."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    one_by_one = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(one_by_one.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """n ids from the start of packed bytes, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    one_by_one = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), dtype=np.uint8)
    full[:, :bits] = one_by_one
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


class ShardWriter:
    """Writes documents to one shard, a block at a time; memory is one block and the document index."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.place, self.tokens, self.index, self.blocks = HEADER.size, 0, [], []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        out.write(HEADER.pack(MAGIC, VERSION, bits, BLOCK, 0, 0, 0))  # the counts are known at the end: the header there holds them

    def add(self, ids: np.ndarray) -> None:
        self.index.append((self.tokens, len(ids)))
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        while self.n_waiting >= BLOCK:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(joined[k : k + BLOCK])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        at_index = self.place
        self.out.write(np.array(self.index, dtype="<u8").reshape(-1, 2).tobytes())
        at_blocks = at_index + 16 * len(self.index)
        self.out.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.out.write(HEADER.pack(MAGIC, VERSION, self.bits, BLOCK, len(self.index), self.tokens, len(self.blocks)))
        self.out.write(FOOTER.pack(at_index, at_blocks))
        self.out.close()


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size - HEADER.size)
        tail = source.read(FOOTER.size + HEADER.size)
        magic, version, self.bits, self.block, self.documents, self.tokens, n_blocks = HEADER.unpack(tail[: HEADER.size])
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a packed token file")
        at_index, at_blocks = FOOTER.unpack(tail[HEADER.size :])
        source.seek(at_index)
        self.index = np.frombuffer(source.read(16 * self.documents), dtype="<u8").reshape(-1, 2)
        source.seek(at_blocks)
        self.blocks = np.append(np.frombuffer(source.read(8 * n_blocks), dtype="<u8"), np.uint64(at_index)).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        self.source.seek(int(self.blocks[first]))
        data = self.source.read(int(self.blocks[last + 1] - self.blocks[first]))
        held = min((last + 1) * self.block, self.tokens) - first * self.block
        return unpack(data, self.bits, held)[start - first * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        start, n = self.index[k].tolist()
        return self.ids(start, n)

    def runs(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids), in runs of about `most` ids."""
        k, ends = 0, self.index.sum(axis=1).astype(np.int64)
        while k < self.documents:
            start = int(self.index[k, 0])
            stop = max(k + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield k, stop, self.ids(start, int(ends[stop - 1]) - start)
            k = stop


_ODD_SPACE = re.compile(r"\s ")
_SPACE_FIRST = re.compile(r" (?:\s|\Z)")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """Ids of whole texts by the tokenizers library, with a memory of the pieces between spaces.

    The tokenizer's own pattern starts a new token at every space that follows a character other than white space,
    so the ids of a text are the ids of the pieces that begin there, one after another; each distinct piece goes to
    the library once. That holds only for a byte-level pre-tokenizer without a normaliser or other rules, which is
    checked; any other tokenizer, and any text that holds one of its added tokens, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        import json

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer") and not said.get("post_processor")
        self.added = [x["content"] for x in said.get("added_tokens", [])]
        self.kept: dict[str, bytes] = {}
        self.spaced = np.zeros(self.vocabulary, dtype=bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spaced[k] = token.startswith("\u0120")  # how a byte-level vocabulary writes a space

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, names: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each given without the space that it begins with. Pieces go to the library joined,
        as the space before a name that does not begin with white space always begins a token: the ids that begin
        with a space then tell where each piece begins. Other names, and any run whose count disagrees, go one by one."""
        out: list[bytes] = []
        for low in range(0, len(names), JOINED_PIECES):
            run = names[low : low + JOINED_PIECES]
            text = " " + " ".join(run)
            if _SPACE_FIRST.search(text):
                some = [k for k, x in enumerate(run) if not x or x[0].isspace()]
                other = dict(zip(some, self._whole([" " + run[k] for k in some]), strict=True))
                rest = iter(self._spaced([x for k, x in enumerate(run) if k not in other]))
                out += [other[k] if k in other else next(rest) for k in range(len(run))]
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(run):
                out += self._whole([" " + x for x in run])
                continue
            data, cuts = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
            out += [data[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        cut: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or any(x in text for x in self.added):
                whole.append(k)
            elif _ODD_SPACE.search(text):
                cut.append((k, _BEFORE_SPACE.split(text)))
            else:
                plain.append(k)
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        firsts = [texts[k].partition(" ")[0] for k in plain]
        others: dict[str, bytes] = {"": b""}
        fresh = list({x for x in firsts if x}.union(*(pieces for _, pieces in cut)))
        others.update(zip(fresh, self._whole(fresh), strict=True))
        if plain:
            for k, first, ids in zip(plain, firsts, self._by_names([texts[k] for k in plain]), strict=True):
                out[k] = others[first] + ids
        for k, pieces in cut:
            out[k] = b"".join(map(others.__getitem__, pieces))
        return out

    def _by_names(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text without its first piece. Names are told apart in arrays, and only distinct ones are looked
        up; the ids of all texts are then one gathering from those of the names."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")
        names = joined[0].as_py().split(" ")  # no name holds a space
        missing = [x for x in names if x not in self.kept]
        self.kept.update(zip(missing, self._spaced(missing), strict=True))
        held = list(map(self.kept.__getitem__, names))
        ids = np.frombuffer(b"".join(held), dtype="<u4")
        many = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        begins = np.cumsum(many) - many
        code = coded.indices.to_numpy()
        first = split.offsets.to_numpy().astype(np.int64)
        many, begins = many[code], begins[code]
        many[first[:-1] - first[0]] = 0  # the texts' first pieces
        ends = np.cumsum(many)
        data = ids[np.repeat(begins - ends + many, many) + np.arange(len(code) and ends[-1])].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[first - first[0]]).tolist()
        room = max(0, KEPT_PIECES - len(self.kept) + len(missing))
        for k, x in enumerate(missing):
            if k >= room or len(x) > LONG_PIECE:
                del self.kept[x]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield data[low:high]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> tuple[str, list[dict]]:
    """Encodes every document, appends end_id, and writes shards in ascending doc_id order.

    Returns the folder and one record per shard, in order: path, documents, tokens, shard_base. Null texts are empty
    texts: the end id alone. Very long texts are encoded whole. Null doc_ids come first; rows of one doc_id stand in order
    of their texts' hashes, and repeated rows are written each; a table without rows gives no shard; other columns,
    whatever their names, are not read. The files stay until the folder is removed.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    store, inside = fs.FileSystem.from_uri(folder)
    store.create_dir(inside)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    tie = F.xxhash64("text")
    dealt = slim.withColumn("tie", tie).repartitionByRange(int(shards), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        writer = path = hidden = None
        enc = encoder(tokenizer)
        bits = bits_for(enc.vocabulary)
        last = np.array([end_id], dtype="<u4")
        ids_of: list[pa.Array] = []
        place, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            if writer is None and batch.num_rows:
                path = f"{at}/shard-{number:06d}"
                hidden = f"{at}/.shard-{number:06d}-{uuid.uuid4().hex}"
                writer = ShardWriter(place.open_output_stream(hidden), bits)
            texts = text_array(batch)
            for a, b in slices(texts, STEP_BYTES):
                for ids in enc.encode(texts.slice(a, b - a).to_pylist()):
                    writer.add(np.concatenate([np.frombuffer(ids, dtype="<u4"), last]))
            ids_of.append(batch.column(0))
        if writer is not None:
            writer.close()
            with place.open_output_stream(hidden + ".ids") as f, pa.ipc.new_stream(f, pa.schema([("doc_id", ids_of[0].type)])) as s:
                for x in ids_of:
                    s.write_batch(pa.record_batch([x], ["doc_id"]))
            put_in_place(place, hidden + ".ids", path + ".ids")
            put_in_place(place, hidden, path + ".bin")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([f"{folder}/shard-{number:06d}"]), pa.array([len(writer.index)], pa.int64()), pa.array([writer.tokens], pa.int64())], ["number", "path", "documents", "tokens"])

    rows = sorted(dealt.mapInArrow(lean(write, keep_pieces=True), "number long, path string, documents long, tokens long").collect())
    out, base = [], 0
    for r in rows:
        out.append({"path": r.path, "documents": r.documents, "tokens": r.tokens, "shard_base": base, "doc_id": kind})
        base += r.tokens
    return folder, out


def read_tokens(spark, shards: list[dict], with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked, ids. No shards give no rows."""
    kind = shards[0]["doc_id"] if shards else "bigint"
    plan = [(x["path"], x["shard_base"]) for x in shards]
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for number in batch.column(0).to_pylist():
                path, base = plan[number]
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at + ".ids") as f:
                    doc_ids = pa.ipc.open_stream(f).read_all().combine_chunks().column(0)
                doc_ids = doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
                with store.open_input_file(at + ".bin") as f:
                    shard = ShardReader(f)
                    for a, b, ids in shard.runs():
                        places = shard.index[a:b].astype(np.int64)
                        whole = ids.astype("<u4").tobytes()
                        cuts = (places[:, 0] - places[0, 0]).tolist()
                        crc = [zlib.crc32(whole[4 * c : 4 * (c + n)]) for c, n in zip(cuts, places[:, 1].tolist(), strict=True)]
                        columns = [doc_ids.slice(a, b - a), pa.array(places[:, 0] + base), pa.array(places[:, 1]), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.array([ids[c : c + n].astype(np.int64) for c, n in zip(cuts, places[:, 1].tolist(), strict=True)], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, schema_names(with_ids))

    n = len(plan)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(lean(read, keep_pieces=True), schema)


def schema_names(with_ids: bool) -> list[str]:
    return ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files and returns what is read back from them, one row per document."""
    _, shards = write_tokens(docs, tokenizer, end_id=end_id)
    if not shards:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return read_tokens(docs.sparkSession, shards)
