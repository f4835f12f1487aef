"""Packing: documents into sequences of fixed length, first-fit decreasing over a tournament tree.

A document's tokens are cut at multiples of the sequence length and the pieces are packed, those of full length
first, which leave no room beside them.  Rows are dealt at random (by hash of id and place, so equal rows part)
into groups of a bounded expected size and every group is packed on its own, so no task sees more than that.
The place is that in the files as they are split, so another split gives other sequence ids and the same pieces.
Only lengths and checksums are shuffled, never ids.

Defined cases: null or empty text is the end token alone; repeated rows are packed each on their own; a null
id is an id like any other; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import table, text_of

SEQUENCE = 1024
DOCS_PER_GROUP = 4096
END_ID = 0
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


class TournamentTree:
    """Free room of bins; the root holds the largest.  first(n) is the leftmost bin with room for n."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.best = [room] * (2 * self.leaves)

    def first(self, n: int) -> int:
        at, best = 1, self.best
        while at < self.leaves:
            at *= 2
            if best[at] < n:
                at += 1
        return at - self.leaves

    def take(self, which: int, n: int) -> int:
        """Takes n from the bin and gives the room it had."""
        at, best = which + self.leaves, self.best
        had = best[at]
        best[at] = had - n
        at //= 2
        while at:
            new = max(best[2 * at], best[2 * at + 1])
            if best[at] == new:
                break
            best[at] = new
            at //= 2
        return had


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every item; items are at most size long."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree = TournamentTree(len(lengths), size)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        bins[i] = tree.first(lengths[i])
        offsets[i] = size - tree.take(bins[i], lengths[i])
    return bins, offsets


@lru_cache(maxsize=2)
def encoder(name: str):
    """texts -> lists of ids, as the tokenizer file of that name gives them without special tokens added.

    Where the same vocabulary lies beside it as ranks, its faster reader is used; the ids are the same, the
    written-out special token in a text included."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    try:
        import base64

        import tiktoken

        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        ranked = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [ranked.encode(t, allowed_special="all") for t in texts]
    except (ImportError, OSError):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def pieces(docs: DataFrame, size: int, tokenizer: str) -> DataFrame:
    """docs: doc_id (as text, since numbers beside a null would come as floats), text, deal.  One row for each
    piece, with its group."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 512):
                out = []
                part = batch.iloc[at : at + 512]
                for doc_id, deal, ids in zip(part["doc_id"], part["deal"], encode(part["text"].tolist()), strict=True):
                    ids.append(END_ID)
                    whole = np.array(ids, dtype="<u4")
                    for start in range(0, len(whole), size):
                        own = whole[start : start + size]
                        out.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(whole), int(deal)))
                yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.mapInPandas(cut_up, f"{PIECES}, deal long")


def pack(docs: DataFrame, size: int = SEQUENCE, docs_per_group: int = DOCS_PER_GROUP, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    groups = max(1, -(-docs.count() // docs_per_group))
    dealt = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64(F.lit("deal"), "doc_id", F.monotonically_increasing_id()), F.lit(groups)))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32", "length"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].tolist(), size)
        return group.assign(sequence_id=np.array(bins, dtype="int64") + (int(key[0]) << 32), offset=np.array(offsets, dtype="int64")).drop(columns="deal")

    packed = pieces(dealt, size, tokenizer).groupBy("deal").applyInPandas(fill, f"{PIECES}, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
