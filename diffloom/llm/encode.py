"""Encoding of a corpus with a public byte-level BPE vocabulary by a global distinct-word shuffle.

Texts are cut into pre-tokens with positions; each distinct pre-token of the corpus is encoded once; the ids are joined
back and put together by position. Texts are held in chunks: within a chunk a position is the number of a word of the
chunk, so what is shuffled is each chunk's distinct words, not every occurrence. Decoding joins the table of token bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.operators.skew import dictionary_join, hot_keys
from diffloom.session import staged

#: Pre-tokens and rows from which a chunk is closed; one longer text is a chunk of its own.
CHUNK_TOKENS, CHUNK_ROWS = 250_000, 4096
_loaded: dict = {}


def _path(vocabulary: str | None) -> str:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(path: str):
    """The vocabulary's encoder, once per Python worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    return _loaded[path]


class _Numbers(dict):
    """Word -> its number, given in order of first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(chunk, rows, keys, lengths, places, words): texts as numbers of their chunk's distinct pre-tokens, in order.

    ``rows`` tell rows apart even where ``keys`` repeat or are null; ``lengths`` is the number of pre-tokens of each row,
    0 for a null or empty text; ``places`` are the numbers of all rows end to end, two or four bytes each.
    """

    def cut(batches):
        import public_tokenizers
        import regex

        find = regex.compile(public_tokenizers.PATTERN).findall
        rows, keys, lengths, places, numbers = [], [], [], [], _Numbers()

        def chunk() -> pa.RecordBatch:
            flat = np.array(places, np.uint16 if len(numbers) <= 1 << 16 else np.uint32)
            one = [[rows[0]], [rows], [keys], [lengths], [flat.tobytes()], [list(numbers)]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(one, schema)], schema=schema)

        schema = None
        for b in batches:
            schema = schema or pa.schema([("chunk", pa.int64()), ("rows", pa.list_(pa.int64())), ("keys", pa.list_(b.column(1).type)), ("lengths", pa.list_(pa.int32())), ("places", pa.binary()), ("words", pa.list_(pa.string()))])
            for r, k, t in zip(*(c.to_pylist() for c in b.columns)):
                found = find(t) if t else []
                if rows and (len(rows) >= CHUNK_ROWS or len(places) + len(found) > CHUNK_TOKENS):
                    yield chunk()
                    rows, keys, lengths, places, numbers = [], [], [], [], _Numbers()
                rows.append(r)
                keys.append(k)
                lengths.append(len(found))
                places.extend(map(numbers.__getitem__, found))
        if rows:
            yield chunk()

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key), F.col(text))
    return source.mapInArrow(cut, f"chunk bigint, rows array<bigint>, keys array<{kind}>, lengths array<int>, places binary, words array<string>")


def encoded_words(words: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(word, n, ids) from distinct (word, n): each word is encoded once, wherever it occurs."""
    path = _path(vocabulary)

    def encode(batches):
        one = _encoding(path)._encode_single_piece
        for b in batches:
            ids = [one(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(encode, "word string, n bigint, ids array<int>")


def _joined(docs: DataFrame, text: str, key: str, vocabulary: str | None, value) -> DataFrame:
    """Chunks (rows, keys, lengths, places) with ``values``: what ``value`` makes of the ids of each of their words."""
    held = staged(chunks(docs, text, key), "chunks")
    counted = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = staged(encoded_words(counted, vocabulary), "words")
    hot = hot_keys(words, "word", "n", words.agg(F.sum("n")).first()[0] or 0)
    at = held.select("chunk", F.posexplode("words").alias("place", "word"))
    found = dictionary_join(at, words.select("word", value.alias("value")), "word", "chunk", hot)
    per = found.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    return held.drop("words").join(per, "chunk", "left").select("rows", "keys", "lengths", "places", "values")


def _each(b: pa.RecordBatch) -> Iterator[tuple]:
    """(rows, keys, lengths, places, values) of each chunk of a batch, as Arrow or numpy arrays."""
    for i in range(b.num_rows):
        rows, keys = (b.column(c)[i].values for c in (0, 1))
        lengths = b.column(2)[i].values.to_numpy()
        n, raw = int(lengths.sum()), b.column(3)[i].as_py()
        places = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)
        yield rows, keys, lengths, places, b.column(4)[i].values


def token_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): one row per row of ``docs``; null and empty texts give the empty list, blank texts are encoded."""

    def run(batches):
        for b in batches:
            for _, keys, lengths, places, values in _each(b):
                ends, flat = np.zeros(len(keys) + 1, np.int32), np.empty(0, np.int32)
                if len(places):
                    starts, flat = values.offsets.to_numpy(), values.values.to_numpy()
                    sizes = np.diff(starts)[places]
                    done = np.concatenate(([0], np.cumsum(sizes)))
                    flat = flat[np.repeat(starts[places] - done[:-1], sizes) + np.arange(done[-1])]
                    ends[1:] = done[np.cumsum(lengths)]
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return _joined(docs, text, key, vocabulary, F.col("ids")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(row_id, key, size): the number of ids of each row of ``docs``, without putting the ids together."""

    def run(batches):
        for b in batches:
            for rows, keys, lengths, places, values in _each(b):
                done = np.concatenate(([0], np.cumsum(values.to_numpy()[places].astype(np.int64)))) if len(places) else np.zeros(1, np.int64)
                size = np.diff(np.concatenate(([0], done[np.cumsum(lengths)])))
                yield pa.RecordBatch.from_arrays([rows, keys, pa.array(size, pa.int64())], names=["row_id", key, "size"])

    kind = docs.schema[key].dataType.simpleString()
    return _joined(docs, text, key, vocabulary, F.size("ids")).mapInArrow(run, f"row_id bigint, {key} {kind}, size bigint")


def token_bytes(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(id, hex): the bytes of each token; its size is the vocabulary's (50,256 rows), whatever the corpus."""
    return spark.createDataFrame([(i, b.hex()) for b, i in _ranks(_path(vocabulary)).items()], "id int, hex string")


def decode_ids(encoded: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, text): ids turned back into text by a join with the token bytes; the empty list gives the empty text.

    ``encoded`` has one row per key.
    """
    at = encoded.select(key, F.posexplode_outer("ids").alias("p", "id"))
    b = at.join(F.broadcast(token_bytes(encoded.sparkSession, vocabulary)), "id", "left")
    hexed = b.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "hex")))), lambda x: x["hex"]), "").alias("_hex"))
    return hexed.select(key, F.decode(F.unhex("_hex"), "UTF-8").alias("text"))
