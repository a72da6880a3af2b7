"""Packing by power-of-two decomposition: binary pieces of each document, bucketed by equal length."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import text_batches, written
from planlens.operators.ordered import row_numbers

LENGTH = 1024
CACHED_TOKENS = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, text_hash long"


class Known(dict):
    """Packed ids by key, worked out on first use and forgotten when there are too many."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED_TOKENS:
            self.clear()
        self[key] = out = self.make(key)
        return out


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> little-endian 32-bit ids, equal to those of the tokenizer on the whole text.

    The vocabulary's ids are its merge ranks, so tiktoken, which is several times faster on rare words, gives the ids
    of the pre-tokens.  A space or line end between two characters that are not white space always parts
    pre-tokens; what stands between such is looked up whole.  Texts with a special token go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(letters[c] for c in w): i for w, i in tokenizer.get_vocab(with_added_tokens=False).items() if w not in special}
    ids = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blanks = re.compile(r"\s\s").search
    parts = lambda text: array("I", ids(text)).tobytes()
    first, spaced, line_end = Known(parts), Known(lambda w: parts(" " + w)), parts("\n")

    def line(text: str) -> bytes:
        words = text.split(" ")
        return first[words[0]] + b"".join(map(spaced.__getitem__, words[1:]))

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return parts(text) if blanks(text) else line_end.join(map(line, text.split("\n")))

    return encode


def binary_lengths(n: int, most: int = LENGTH) -> list[int]:
    """n as whole sequences of ``most``, then its binary digits from the largest."""
    return [most] * (n // most) + [1 << k for k in reversed(range(most.bit_length() - 1)) if n % most >> k & 1]


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """The pieces of each document: its ids and a closing 0, cut into power-of-two lengths."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for b in batches:
            ids, starts, lengths, crcs, totals, hashes = [], [], [], [], [], []
            for doc, text, h in zip(*(c.to_pylist() for c in b.columns)):
                data = encode(text or "") + b"\0\0\0\0"
                at = 0
                for n in binary_lengths(len(data) // 4, length):
                    ids.append(doc), starts.append(at), lengths.append(n), totals.append(len(data) // 4), hashes.append(h)
                    crcs.append(zlib.crc32(data[4 * at:4 * (at + n)]))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs, totals, hashes)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Every piece is a sequence of its own, of a power-of-two length, so there is no padding and no sequence
    crosses documents.  Sequences are numbered bucket by bucket, the longest first, within a bucket by doc_id, text and
    start: a bucket of equal lengths is a range of ids.  Null texts count as empty and give the closing id
    alone; repeated rows give pieces of their own; rows without doc_id keep a null there.
    """
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    cut = written(pieces(docs, tokenizer_path, length), "pieces")
    cut = cut.withColumns({"no_id": F.col("doc_id").isNull().cast("int"), "id": F.coalesce("doc_id", F.lit(0))})
    numbered = row_numbers(cut, ["-length", "no_id", "id", "text_hash", "start"], out="n")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("n") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
