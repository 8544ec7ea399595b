"""Language-model scores by prediction by partial matching (PPM, escape method C with exclusions) over bytes.

The symbols are the 256 bytes and an end. The context trie of order ORDER is the table of all strings of ORDER bytes
and a symbol in the training texts with their counts; shorter contexts are its marginals, so one aggregation gathers
the whole model. Texts are preceded by ORDER zero bytes, so every symbol has a full context.

In a context with n occurrences of d different symbols, a symbol seen c times has probability c / (n + d) and the
escape to the next shorter context has d / (n + d). The symbols of a context are all seen in its shorter ones too, so
what is excluded there is just what was seen in the context left last: the counts after exclusion, n - x and d - dx,
belong to the longer context alone. They are one sum a context, no list of symbols is ever built, and a string needs
one look at each level. Below order 0 the symbols that are not excluded share the rest evenly. The model is
pretrained and static, so the probability belongs to the string: it is worked out once for every string that occurs in
any text, and a text's score is the sum over its symbols. The strings are gathered from all texts together with the
training counts, and grow with the corpus.

The table of probabilities reaches the scoring tasks in blocks of at most BLOCK strings, split by hash. With more than
one block each gets a narrow pass of its own over the documents whose partial scores are written before the next block
is sent, so a task holds one block and the driver one block, however large the table is.

Base scores need the training count of every word. Words that make up at least 1 / FREQUENT of the training tokens are
at most FREQUENT, and are broadcast; the others are joined by a shuffle of (document, word, times) rows.

Defined results
* null and empty texts are scored as an end alone; without training texts the model is the uniform one;
* batches are read in slices of bounded text, and a text of any length is cut into pieces of PIECE bytes that overlap
  by a context, so memory follows neither; what a slice took goes back before the next one;
* rows of equal doc_id and text get equal scores; a null doc_id is held out of training by no rule, so it is learnt
  from; an empty table gives no rows; extra columns of any name pass through, but for those called like an output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.text import LOWER, raw_bytes, split_words, text_slices, translated
from quillstone.session import forget, shared_dir, written

ORDER = 5
#: A symbol takes the low bits of a key, its context the ones above.
SYMBOL = 9
END = 256
SYMBOLS = 257
BLOCK = 2_000_000
PIECE = 250_000
#: Distinct strings that a task gathers before it hands them on, and the rows of a batch in which it does.
HELD = 500_000
HANDED = 100_000
FREQUENT = 200_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def keys_of(line: np.ndarray) -> np.ndarray:
    """The key of every place of line from ORDER on: the ORDER bytes before it and the byte itself."""
    n = len(line) - ORDER
    key = np.zeros(n, np.uint64)
    for j in range(ORDER):
        key <<= np.uint64(8)
        key |= line[j : j + n]
    key <<= np.uint64(SYMBOL)
    key |= line[ORDER:]
    return key


def byte_strings(texts: pa.Array):
    """Pieces of texts of about PIECE bytes: (first text, symbols of each of the piece's texts, a key a symbol).

    A text longer than a piece is cut into several of its own, each with the bytes before it as context.
    """
    ends, data = raw_bytes(translated(texts, LOWER))
    ends, raw = ends.astype(np.int64), np.frombuffer(data, np.uint8)
    n, i = len(ends) - 1, 0
    while i < n:
        last = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1)
        if ends[last] - ends[i] <= PIECE:
            sizes = np.diff(ends[i : last + 1])
            starts = np.cumsum(sizes + ORDER + 1) - (sizes + ORDER + 1)
            line = np.zeros(int((sizes + ORDER + 1).sum()), np.uint8)
            symbol = np.ones(len(line), bool)
            pads = (starts[:, None] + np.arange(ORDER)).ravel()
            symbol[pads] = False
            is_byte = symbol.copy()
            is_byte[starts + ORDER + sizes] = False
            line[is_byte] = raw[ends[i] : ends[last]]
            keys = keys_of(line)
            keys[starts + sizes] += np.uint64(END)  # the end is not the zero byte
            yield i, sizes + 1, keys[symbol[ORDER:]]
        else:
            own = raw[ends[i] : ends[i + 1]]
            for a in range(0, len(own), PIECE):
                b = min(len(own), a + PIECE)
                before = own[max(0, a - ORDER) : a]
                line = np.concatenate([np.zeros(ORDER - len(before), np.uint8), before, own[a:b], np.zeros(int(b == len(own)), np.uint8)])
                keys = keys_of(line)
                if b == len(own):
                    keys[-1] += np.uint64(END)
                yield i, np.array([len(keys)]), keys
        i = last


def merged_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key once, with the sum of its n."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def string_counts(docs: DataFrame) -> DataFrame:
    """key, n_train (0 for strings of held-out texts only) of all strings of all texts; docs: text, is_train."""

    def handed(keys, n):
        for a in range(0, len(keys), HANDED):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + HANDED].astype(np.int64)), pa.array(n[a : a + HANDED])], names=["key", "n"])

    def count(batches):
        held, more = [], 0  # more: rows beyond those that were merged last
        for batch in text_slices(batches):
            train = batch.column("is_train").to_numpy(zero_copy_only=False).astype(bool)
            for first, symbols, keys in byte_strings(batch.column("text")):
                # the training mark as the lowest bit: one sort counts both
                both = (keys << np.uint64(1)) | np.repeat(train[first : first + len(symbols)], symbols)
                both.sort()
                starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                times, some = np.diff(starts, append=len(both)), both[starts]
                held.append(merged_counts(some >> np.uint64(1), np.where(some & np.uint64(1), times, 0)))
                more += len(held[-1][0])
                if more > HELD // 2:
                    held, more = [merged_counts(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
                    if len(held[0][0]) > HELD:
                        yield from handed(*held.pop())
        if held:
            yield from handed(*merged_counts(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return docs.select("text", "is_train").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n_train"))


def at_order(key: Column, order: int) -> Column:
    """The key with the last order bytes of its context only."""
    return key.bitwiseAND(F.lit((1 << (8 * order + SYMBOL)) - 1))


def context(key: Column) -> Column:
    return F.shiftright(key, SYMBOL)


def probabilities(strings: DataFrame) -> DataFrame:
    """key, logp: the model's log10 probability of each string's symbol after its context; strings: key, n_train.

    Most strings are found in their longest context and are done at once; the others take their own count, and the
    counts of their context after exclusion, from one level after another.
    """
    table = written(strings.where("n_train > 0").select("key", F.col("n_train").alias("c")), f"ppm{ORDER}")
    total = lambda t, n, d: t.groupBy(context(F.col("key")).alias("ctx")).agg(F.sum("c").alias(n), F.count(F.lit(1)).alias(d))
    rows = strings.withColumn("ctx", context(F.col("key"))).join(total(table, "n", "d"), "ctx", "left").select("key", "n_train", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(0)).alias("d"), F.lit(0.0).alias("logp"))
    rows = written(rows.withColumnRenamed("n_train", "own"), f"level{ORDER}")
    levels, done, tables = [rows], [], [table]
    for k in range(ORDER - 1, -2, -1):
        whole = F.col("n") + F.col("d")
        done.append(rows.where("own > 0").select("key", (F.col("logp") + F.log10(F.col("own") / whole)).alias("logp")))
        left = rows.where("own = 0").select("key", (F.col("logp") + F.when(F.col("d") > 0, F.log10(F.col("d") / whole)).otherwise(0.0)).alias("logp"))
        if k < 0:
            break
        longer = tables[-1]
        table = written(longer.groupBy(at_order(F.col("key"), k).alias("key")).agg(F.sum("c").alias("c")), f"ppm{k}")
        # what the symbols of the longer context count for in the shorter one
        inner = longer.select(context(F.col("key")).alias("long"), at_order(F.col("key"), k).alias("key")).join(table, "key")
        gone = inner.groupBy("long").agg(F.sum("c").alias("x"), F.count(F.lit(1)).alias("dx"))
        left = left.withColumns({"_at": at_order(F.col("key"), k), "long": context(at_order(F.col("key"), k + 1)), "ctx": context(at_order(F.col("key"), k))})
        left = left.join(table.select(F.col("key").alias("_at"), "c"), "_at", "left").join(gone, "long", "left").join(total(table, "n", "d"), "ctx", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        rows = written(left.select("key", zero("c").alias("own"), (zero("n") - zero("x")).alias("n"), (zero("d") - zero("dx")).alias("d"), "logp"), f"level{k}")
        levels.append(rows)
        tables.append(table)
    seen = tables[-1].count()  # order 0: one row a symbol
    done.append(left.select("key", (F.col("logp") - F.lit(float(np.log10(max(1, SYMBOLS - seen))))).alias("logp")))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    model = written(every, "model")
    forget(*levels, *tables)
    return model


def open_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A hash table with linear probing as two arrays; unused places hold the key 2**64 - 1."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, out = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits)
    at = (keys * MULTIPLIER) >> np.uint64(64 - bits)
    left = np.arange(len(keys))
    while len(left):
        place = at[left].astype(np.int64)
        free = slots[place] == np.uint64(2**64 - 1)
        _, first = np.unique(place[free], return_index=True)
        won = left[free][first]
        slots[at[won].astype(np.int64)], out[at[won].astype(np.int64)] = keys[won], values[won]
        rest = np.ones(len(left), bool)
        rest[np.flatnonzero(free)[first]] = False
        left = left[rest]
        at[left] = (at[left] + np.uint64(1)) & np.uint64((1 << bits) - 1)
    return slots, out, bits


def looked_up(keys: np.ndarray, slots: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """The keys' values, 0 for keys that are not in the table."""
    at = ((keys * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
    held = slots[at]
    found = np.where(held == keys, values[at], 0.0)
    left = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
    while len(left):
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
        held = slots[at[left]]
        hit = held == keys[left]
        found[left[hit]] = values[at[left[hit]]]
        left = left[~hit & (held != np.uint64(2**64 - 1))]
    return found


def model_scores(docs: DataFrame, table: DataFrame) -> DataFrame:
    """row, score: the log10 probability of the text; docs: row (equal rows share it), text; table: key, logp."""
    spark = docs.sparkSession
    blocks = max(1, -(-table.count() // BLOCK))
    key = docs.schema["row"].dataType.simpleString()
    parts = []
    for b in range(blocks):
        some = table if blocks == 1 else table.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        got = some.select("key", "logp").toArrow()  # about BLOCK numbers
        sent = spark.sparkContext.broadcast(open_table(got.column("key").to_numpy().astype(np.uint64), got.column("logp").to_numpy()))
        del got

        def add(batches, sent=sent):
            slots, values, bits = sent.value
            for batch in text_slices(batches):
                score = np.zeros(batch.num_rows)
                for first, symbols, keys in byte_strings(batch.column("text")):
                    score[first : first + len(symbols)] += np.add.reduceat(looked_up(keys, slots, values, bits), np.cumsum(symbols) - symbols)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

        part = written(docs.select("row", "text").mapInArrow(add, f"row {key}, score double"), f"scores{b}")
        sent.unpersist()
        parts.append(part.withColumn("_block", F.lit(b)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.dropDuplicates(["row", "_block"]).groupBy("row").agg(F.sum("score").alias("score"))


def word_counts(docs: DataFrame) -> DataFrame:
    """token, c: the words of the training texts; an end a text is counted by its number of rows. docs: text, is_train."""

    def count(batches):
        for batch in text_slices(batches):
            train = batch.filter(batch.column("is_train"))
            _, words = split_words(train.column("text"))
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["token", "c"])

    return docs.select("text", "is_train").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def base_scores(docs: DataFrame) -> tuple[DataFrame, int]:
    """row, n_tokens, n_known, base_score of each different row, and the training tokens; docs: row, text, is_train."""
    spark = docs.sparkSession
    counts = written(word_counts(docs), "words")
    words, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_train = docs.where("is_train").count()
    total, kinds = (words or 0) + n_train, distinct + (n_train > 0)
    log_of = lambda c: np.log10((np.asarray(c, np.float64) + 0.5) / (total + 0.5 * (kinds + 1)))
    least = max(1, -(-total // FREQUENT))
    often = counts.where(F.col("c") >= least).toArrow()  # at most FREQUENT of them
    sent = spark.sparkContext.broadcast((often.column("token").combine_chunks(), log_of(often.column("c").to_numpy())))
    end, unknown, all_known = float(log_of(n_train)), float(log_of(0)), least == 1

    def add(batches):
        import pyarrow.compute as pc

        tokens, logs = sent.value
        for batch in text_slices(batches):
            n, found = split_words(batch.column("text"))
            coded = found.dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=tokens.cast(coded.dictionary.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            where = place[codes] if len(codes) else codes
            owner = np.repeat(np.arange(len(n)), n)
            known = where >= 0
            score = np.bincount(owner[known], logs[where[known]], minlength=len(n)) + end
            n_known = np.bincount(owner[known], minlength=len(n)) + (n_train > 0)
            # words that are not frequent, each with how often the text has it
            pairs, times = np.unique(owner[~known] * max(1, len(coded.dictionary)) + codes[~known], return_counts=True)
            texts, rare = pairs // max(1, len(coded.dictionary)), pairs % max(1, len(coded.dictionary))
            if all_known:
                score += np.bincount(texts, times * unknown, minlength=len(n))
                texts, rare, times = texts[:0], rare[:0], times[:0]
            offsets = pa.array(np.searchsorted(texts, np.arange(len(n) + 1)), pa.int32())
            kind = pa.struct([("token", pa.string()), ("times", pa.int64())])
            items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(rare)).cast(pa.string()), pa.array(times, pa.int64())], fields=list(kind))
            cells = [pa.array(n + 1), pa.array(n_known.astype(np.int64)), pa.array(score), pa.ListArray.from_arrays(offsets, items)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cells], names=["row", "n_tokens", "n_known", "base_score", "rare"])

    key = docs.schema["row"].dataType.simpleString()
    first = written(docs.select("row", "text").mapInArrow(add, f"row {key}, n_tokens long, n_known long, base_score double, rare array<struct<token:string,times:long>>"), "base")
    first = first.dropDuplicates(["row"])  # equal rows share their sums: one row of each is enough
    kept = ["row", "n_tokens", "n_known", "base_score"]
    if all_known:
        return first.select(*kept), total
    log10_of = lambda c: F.log10((c + 0.5) / F.lit(total + 0.5 * (kinds + 1)))
    rare = first.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
    joined = rare.join(counts.where(F.col("c") < least), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * log10_of(F.col("c"))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    more = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return first.select(*kept).join(sums, "row", "left").select("row", "n_tokens", more("n_known", "known"), more("base_score", "more")), total


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score; train: which rows to learn from."""
    shared_dir(docs.sparkSession)
    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    marked = docs.select(F.struct(*[c for c in docs.columns if c not in (*out, "text")]).alias("kept"), "text", F.coalesce(train, F.lit(True)).alias("is_train"))
    # the columns of the caller stay in one struct, so no name of theirs can meet one of ours
    row = F.struct(F.xxhash64("kept", "text").alias("a"), F.xxhash64("text", "kept").alias("b"))
    narrow = marked.select(row.alias("row"), "text", "is_train")
    strings = written(string_counts(marked), "strings")
    model = probabilities(strings)
    forget(strings)
    scores = model_scores(narrow, model)
    base, total = base_scores(narrow)
    ids = marked.select("kept", row.alias("row"))
    whole = ids.join(base, "row").join(scores, "row")
    return whole.select("kept.*", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt where crc32(doc_id) mod 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    found = score_texts(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
