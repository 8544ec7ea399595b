"""Token-ID output: tokenise, write patched frame-of-reference blocks, read them back.

Documents are dealt by ranges of doc_id and sorted, so partition order is document order. Each task tokenises its
documents and writes rows called segments (about SEGMENT ids, always whole documents). A segment's payload is a run of
blocks of BLOCK ids. A block is

    <I least id> <H count> <B width> <H exceptions> packed ids | exception positions <H> | exception values <I>

where id - least is packed in ``width`` bits, least significant bit first; the width covers the PERCENTILE share of
the block and what does not fit is in the exception list (its packed bits are 0). ``block_starts`` indexes the byte
where each block begins, so any block can be read alone. Segments are rows of a Parquet table in the shared folder:
Spark's commit protocol makes the files whole even if executors are lost while they write.

The words of a text between ASCII white space are independent for this tokenizer (it drops white space and no pair is
merged across it), so each distinct word of a batch is encoded once.

Defined results
* null and empty texts are one id, the end id; null doc_id comes first; rows of equal doc_id follow each other in the
  order of a hash of their text; an empty table gives no rows; extra columns are not written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.text import text_slices
from quillstone.session import shared_path

BLOCK = 1024
SEGMENT = 1 << 16
PERCENTILE = 0.9
RUN = 256
KEPT_WORDS = 400_000
TEXT_BYTES = 8_000_000
HEAD = "<IHBH"


def pack(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width as a bit string, least significant bit first."""
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * width).reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4").astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, bytes]:
    """The payload of the ids, and where its blocks begin as little-endian unsigned 32-bit integers."""
    out, starts, at = [], [], 0
    for i in range(0, len(ids), block):
        some = ids[i : i + block].astype(np.uint32)
        least = int(some.min())
        rest = some - np.uint32(least)
        k = min(len(rest) - 1, int(np.ceil(percentile * len(rest))) - 1)
        width = int(np.partition(rest, k)[k]).bit_length()
        odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        values = rest[odd]
        rest[odd] = 0
        one = struct.pack(HEAD, least, len(some), width, len(odd)) + pack(rest, width) + odd.astype("<u2").tobytes() + values.astype("<u4").tobytes()
        starts.append(at)
        out.append(one)
        at += len(one)
    return b"".join(out), np.array(starts, "<u4").tobytes()


def decode_block(payload: bytes, at: int) -> np.ndarray:
    least, count, width, n_odd = struct.unpack_from(HEAD, payload, at)
    at += struct.calcsize(HEAD)
    size = (count * width + 7) // 8
    rest = unpack(payload[at : at + size], count, width)
    at += size
    odd = np.frombuffer(payload, "<u2", n_odd, at)
    rest[odd] = np.frombuffer(payload, "<u4", n_odd, at + 2 * n_odd)
    return rest + np.uint32(least)


def decode_blocks(payload: bytes, block_starts: bytes) -> np.ndarray:
    starts = np.frombuffer(block_starts, "<u4")
    return np.concatenate([decode_block(payload, int(at)) for at in starts]) if len(starts) else np.zeros(0, np.uint32)


class WordEncoder:
    """Ids of whole texts, each distinct word encoded once; about KEPT_WORDS words are kept from slice to slice.

    Words are encoded RUN at a time. Words of letters only are parted by spaces: each is one pre-token, so it ends with
    the vocabulary's mark of a word's end. Others are parted by a special token of the tokenizer: it is cut out before
    anything else is done, so the words around it do not see each other, and its id shows where a word ends.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(tokenizer_json), end_id
        marks = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, int] = {}  # word -> its place in lengths; values holds the ids of all kept words
        self.lengths, self.values = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.mark = next(((i, t.content) for i, t in marks.items() if t.special and not (t.lstrip or t.rstrip)), None)

    def words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, the number of ids of each, and the ids of all one after another."""
        mark, text = self.mark or (0, "")
        order, lengths, values = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]

        def alone(some: list[str]) -> None:
            for w in some:
                values.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
                lengths.append(np.array([len(values[-1])], np.int64))
                order.append(w)

        def runs(some: list[str], between: str, is_end, with_end: int) -> list[str]:
            """Encodes words in runs; the words of runs that do not come apart as they should are returned."""
            cut = [some[i : i + RUN] for i in range(0, len(some), RUN)]
            found = self.tokenizer.encode_batch_fast([between.join([*c, ""]) for c in cut], add_special_tokens=False)
            bad = []
            for c, e in zip(cut, found, strict=True):
                ids = np.array(e.ids, np.uint32)
                end = is_end(ids)
                ends = np.flatnonzero(end)
                if len(ends) != len(c):
                    bad += c
                    continue
                order.extend(c)
                lengths.append(np.diff(ends, prepend=-1) - 1 + with_end)
                values.append(ids if with_end else ids[~end])
            return bad

        letters, others, odd = [], [], []
        for w in words:
            (letters if w.isalpha() and (w.isascii() or w.lower().isalpha()) else odd if not text or text in w else others).append(w)
        others += runs(letters, " ", lambda ids: self.ends_word[ids], 1)
        odd += runs(others, text, lambda ids: ids == mark, 0) if text else others
        alone(odd)
        return order, np.concatenate(lengths), np.concatenate(values)

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words are in the returned lengths and ids: kept words first, then those encoded for now."""
        kept, lengths, values = self.kept, self.lengths, self.values
        new = [w for w in words if w not in kept]
        if new:
            order, more, ids = self.words(new)
            lengths, values = np.append(lengths, more), np.append(values, ids)
            fresh = dict(zip(order, range(len(self.lengths), len(lengths)), strict=True))
            if len(kept) < KEPT_WORDS:  # the words of the first texts, frequent ones among them
                kept.update(fresh)
                self.lengths, self.values = lengths, values
            else:
                where = [kept.get(w, -1) for w in words]
                return np.array([fresh[w] if i < 0 else i for w, i in zip(words, where, strict=True)], np.int64), lengths, values
        return np.fromiter(map(kept.__getitem__, words), np.int64, len(words)), lengths, values

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, an end id after each, and the number of ids of each."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        where, lengths, values = self.places(coded.dictionary.to_pylist())
        codes = where[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        n_words = len(lengths)
        lengths, values = np.append(lengths, 1), np.append(values, np.uint32(self.end_id))
        firsts = np.cumsum(lengths) - lengths
        ends = np.cumsum(per_text)
        codes = np.insert(codes, ends, n_words)  # the end id after the last word of each text
        each = lengths[codes]
        upto = np.cumsum(each)
        where = np.repeat(firsts[codes] - (upto - each), each)
        where += np.arange(len(where))
        last = ends + np.arange(len(ends))  # the place of each text's end code
        return values[where], np.diff(upto[last], prepend=0)


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, partitions: int | None = None, slice_bytes: int = TEXT_BYTES) -> None:
    """Writes the ids of all texts in ascending doc_id order as a table of segments at path.

    slice_bytes: of text that a worker encodes at once; less takes less memory and more time, the ids are the same.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast({"file": f.read()})  # the vocabulary file, a fixed size
    key = docs.schema["doc_id"].dataType
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = f"part int, seg int, start_in_part long, n_tokens long, doc_ids array<{key.simpleString()}>, lengths array<int>, payload binary, block_starts binary"

    def segments(batches):
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), model.value
        # a worker keeps a broadcast's value, so its later tasks find the encoder and the words it knows
        encoder = state.get("encoder") or state.setdefault("encoder", WordEncoder(state["file"], end_id))
        seg = start = 0
        doc_ids, lengths, held = [], [], []

        def flush():
            nonlocal seg, start, doc_ids, lengths, held
            ids = np.concatenate(held)
            payload, starts = encode_blocks(ids)
            cells = [[part], [seg], [start], [len(ids)], [doc_ids], [lengths], [payload], [starts]]
            seg, start = seg + 1, start + len(ids)
            doc_ids, lengths, held = [], [], []
            return cells

        def out(cells):
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = ["part", "seg", "start_in_part", "n_tokens", "doc_ids", "lengths", "payload", "block_starts"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

        id_type, size = None, 0
        for batch in text_slices(batches, "text", slice_bytes):
            id_type = batch.column("doc_id").type
            ids, counts = encoder.texts(batch.column("text"))
            keys, at = batch.column("doc_id").to_pylist(), 0
            ends = np.cumsum(counts)
            first = 0
            while first < len(keys):  # whole documents up to SEGMENT ids
                last = max(first + 1, int(np.searchsorted(ends, at + SEGMENT - size, "right")))
                doc_ids += keys[first:last]
                lengths += counts[first:last].tolist()
                held.append(ids[at : ends[last - 1]])
                size += int(ends[last - 1]) - at
                first, at = last, int(ends[last - 1])
                if first < len(keys) or size >= SEGMENT:
                    yield out(flush())
                    size = 0
        if doc_ids:
            yield out(flush())

    dealt.mapInArrow(segments, schema).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files at path."""
    table = spark.read.parquet(path)
    key = table.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"part int, doc_id {key}, start_in_part long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["payload"], row["block_starts"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw, places = memoryview(ids.tobytes()), (ends * 4).tolist()
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip([0, *places], places, strict=False)]
                cells = [
                    pa.array([row["part"]] * len(lengths), pa.int32()),
                    pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(row["start_in_part"] + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cells, names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32", "ids"][: len(cells)])

    read = table.mapInArrow(documents, schema)
    # one row a written partition
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select(F.col("part"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    joined = read.join(F.broadcast(before), "part")
    return joined.select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"][: int(with_ids)])


def token_output(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, path: str | None = None, slice_bytes: int = TEXT_BYTES) -> DataFrame:
    """Writes the ids of docs to path (a fresh place in the shared folder if None) and reads the digests back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-blocks")
    write_token_blocks(docs, path, tokenizer_path, end_id, slice_bytes=slice_bytes)
    return read_token_blocks(spark, path)


def op9_token_blocks(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, written and read back."""
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
