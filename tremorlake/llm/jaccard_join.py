"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

1. One scan takes every document's shingle set (sorted 64-bit hashes), its key, its size, a bitmap signature,
   and counts shingles that are frequent within a slice; the most frequent of all (a table of fixed size) only
   decide in which order a set's shingles are listed: rare ones first.
2. Documents of equal sets are one from here on.  Two sets that link must share a shingle in their prefixes
   (the first 1 - num / den of the order and one).  A tile is a size band and a shingle; sets
   meet in the tiles of their prefixes, in bands of sizes within a factor of two and their upper neighbours.
3. In every tile the set with the fewest shingles before the tile's leads.  Leader and members are compared:
   sizes and positions, then the bitmaps (a bit set on one side only is an element of that side only, which
   bounds the overlap from above), then the arrays.  What links becomes components.
4. In tiles that still hold several components, each set outside the tile's largest component is compared
   with the sets of other components in the same way.  After that no link between different components is
   left, and links within one change nothing.

So a group of thousands of near copies costs a few comparisons a member, not all pairs, and no group is ever
gathered in a task: tiles are joined, and AQE splits large ones.

Defined cases: null or empty text and text without words has an empty set and links with nothing; rows with
one id are judged each by its own text; rows with a null id take the component of an equal text with an id, else null;
an empty table gives none; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.llm.bitmaps import bitmap_subquery, possible
from tremorlake.llm.common import cut, discard, gathered, table, text_of, written
from tremorlake.llm.components import connected_components
from tremorlake.llm.shingles import in_slices, mix, shingle_sets

#: Shingles whose frequency is known when prefixes are ordered.  It bounds a table, not the result.
FREQUENT = 1 << 15
#: Shingles of different sets that are counted together, and the least count that is passed on.
SLICE, LEAST = 2_000_000, 2
#: Longs of the bitmap of a set of n shingles: a power of two, two bits a shingle, within these bounds.
SIGNATURE_WORDS = (4, 256)
FACTS = "frequent boolean, doc_id string, mark long, k1 long, k2 long, n long, signature array<long>"
TILES = "tile long, k1 long, k2 long, n long, pos int, low boolean"


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    from xxhash import xxh3_128_intdigest

    whole = xxh3_128_intdigest(hashes.tobytes())
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(whole >> 64), signed(whole & ((1 << 64) - 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    low, high = SIGNATURE_WORDS
    words = min(high, max(low, 1 << (max(1, len(hashes)) * 2 // 64).bit_length()))
    bits = np.zeros(words * 64, np.uint8)
    bits[(hashes & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def facts_of(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document, and rows of frequent shingles with their counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def counted() -> pd.DataFrame:
            all_of = np.concatenate(list(pending.values()))
            pending.clear()
            all_of.sort()
            first = np.flatnonzero(np.concatenate([[True], all_of[1:] != all_of[:-1]]))
            n = np.diff(np.append(first, len(all_of)))
            found, n = all_of[first[n >= LEAST]], n[n >= LEAST]
            return pd.DataFrame({"frequent": True, "doc_id": None, "mark": 0, "k1": found.view(np.int64), "k2": 0, "n": n, "signature": None})

        for batch in batches:
            for at, texts in in_slices(batch["text"].tolist()):
                rows = []
                for i, hashes in enumerate(shingle_sets(texts, k)):
                    key = set_key(hashes)
                    rows.append((False, batch["doc_id"].iloc[at + i], batch["mark"].iloc[at + i], *key, len(hashes), signature(hashes)))
                    if key not in pending:  # copies count once
                        pending[key] = hashes
                        size += len(hashes)
                yield pd.DataFrame(rows, columns=["frequent", "doc_id", "mark", "k1", "k2", "n", "signature"])
                if size >= SLICE:
                    yield counted()
                    size = 0
        if pending:
            yield counted()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return written(rows.mapInPandas(scan, FACTS), "shingle_facts")


def frequent_shingles(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and their rank by count: at most FREQUENT rows."""
    counts = facts.where("frequent").groupBy("k1").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "k1").limit(FREQUENT).toPandas()
    hashes = top["k1"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["n"].to_numpy(np.int64)[order]


def prefix(hashes: np.ndarray, length: int, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order: unknown ones by hash, then known ones by count."""
    if not len(known):
        return hashes[:length]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    often = known[at] == hashes
    rare = hashes[~often][:length]
    if len(rare) == length:
        return rare
    rest = np.flatnonzero(often)
    return np.concatenate([rare, hashes[rest[np.argsort(counts[at[rest]], kind="stable")]][: length - len(rare)]])


def tiles_of(docs: DataFrame, k: int, num: int, den: int, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The tiles of each document; pos: how many of its shingles come before this one in the order; low: in the band below."""
    smallest = -(-num // (den - num)) if den > num else 1 << 62

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in in_slices(batch["text"].tolist()):
                parts: list[tuple] = []
                for hashes in shingle_sets(texts, k):
                    n = len(hashes)
                    if n < smallest:  # such a set links with equal ones only
                        continue
                    least = -(-num * n // den)
                    tokens = prefix(hashes, n - least + 1, known, counts)
                    band = n.bit_length()
                    key = set_key(hashes)
                    parts.append((mix(tokens + np.uint64(band)), key, n, np.arange(len(tokens), dtype=np.int32), False))
                    if least < 1 << (band - 1):  # a smaller partner may stand in the band below
                        parts.append((mix(tokens + np.uint64(band - 1)), key, n, np.arange(len(tokens), dtype=np.int32), True))
                if parts:
                    sizes = [len(p[0]) for p in parts]
                    yield pd.DataFrame({
                        "tile": np.concatenate([p[0] for p in parts]).view(np.int64),
                        "k1": np.repeat(np.array([p[1][0] for p in parts], np.int64), sizes),
                        "k2": np.repeat(np.array([p[1][1] for p in parts], np.int64), sizes),
                        "n": np.repeat(np.array([p[2] for p in parts], np.int64), sizes),
                        "pos": np.concatenate([p[3] for p in parts]),
                        "low": np.repeat(np.array([p[4] for p in parts], bool), sizes),
                    })

    return written(docs.select("text").mapInPandas(scan, TILES), "tiles")


def shared_tiles(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """tile, id, n, pos, prev: rows of tiles in which different sets meet; prev is the set's tile before, if it has one."""
    met = cut(gathered(tiles.groupBy("tile").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("tile")))
    marks, bits = bitmap_subquery(met.select(F.xxhash64("tile").alias("h")))
    some = tiles.where(possible(F.xxhash64("tile"), marks, bits)).join(met, "tile", "left_semi").distinct()
    known = some.join(sets.select("k1", "k2", "n", "id"), ["k1", "k2", "n"])
    before = F.lag("tile").over(Window.partitionBy("id", "low").orderBy("pos"))  # no more rows than the prefix is long
    return written(gathered(known.select("tile", "id", "n", "pos", before.alias("prev"))), "met")


def folded(a: Column, size: Column) -> Column:
    """The signature as one of half as many longs, where it is longer than size."""
    half = F.floor(F.size(a) / 2).cast("int")
    return F.when(F.size(a) > size, F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseOR(y))).otherwise(a)


def only_in(a: Column, b: Column) -> Column:
    """Bits of a that b has not: so many elements of a, at least, are not in b."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def placed_to_link(num: int, den: int) -> Column:
    """Of two rows a, b (n, pos, prev, id) of one tile.

    In the tile of the first shingle that two sets share, what they share stands at or behind it in both, and
    that bounds it.  A later tile need not be looked at: where both came from the same tile, this isn't the first."""
    sizes = den * F.least("a.n", "b.n") >= num * F.greatest("a.n", "b.n")
    behind = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    first = F.coalesce(F.col("a.prev") != F.col("b.prev"), F.lit(True))
    return sizes & first & ((num + den) * behind >= num * (F.col("a.n") + F.col("b.n")))


def may_link(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b that sizes and signatures don't rule out; no pair that links is refused."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    na, nb, sa, sb = (F.col(c) for c in ("na", "nb", "sa", "sb"))
    # sizes this near, the signatures differ by one halving at most
    fa, fb = folded(sa, F.size(sb)), folded(sb, F.size(sa))
    most = F.least(na - only_in(fa, fb), nb - only_in(fb, fa))
    return cut(gathered(both.where((den * F.least(na, nb) >= num * F.greatest(na, nb)) & (den * most >= num * (na + nb - most))).select("a", "b")))


def linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b of the pairs whose sets link, by intersection of their sorted arrays."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = cut(gathered(ids.join(sets.select("id", "doc", "k1", "k2"), "id")))
    marks, bits = bitmap_subquery(ids.select(F.xxhash64("doc").alias("h")))
    texts = docs.where(possible(F.xxhash64("doc_id"), marks, bits)).join(ids, F.col("doc_id") == F.col("doc")).select("id", "k1", "k2", "text")

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, part in in_slices(batch["text"].tolist()):
                own = batch.iloc[at : at + len(part)]
                # rows with one doc_id can have several sets
                found = [(i, h.view(np.int64)) for i, k1, k2, h in zip(own["id"], own["k1"], own["k2"], shingle_sets(part, k), strict=True) if set_key(h) == (k1, k2)]
                yield pd.DataFrame(found, columns=["id", "hashes"])

    known = texts.mapInPandas(arrays, "id long, hashes array<long>")
    left = known.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
    right = known.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                x, y = x.view(np.uint64), y.view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    return cut(gathered(both.mapInPandas(same, "a long, b long").distinct()))


def links_of(met: DataFrame, docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node, component over links that suffice to connect whatever all links connect."""
    ordered = lambda: (F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    side = F.struct("pos", "n", "id", "prev")
    # the set with the fewest shingles of its own before the tile's is nearest to all others
    first = met.groupBy("tile").agg(F.min(side).alias("a")).withColumnRenamed("tile", "of").withColumn("i", F.xxhash64("of"))
    rows = met.select("tile", side.alias("b")).withColumn("j", F.xxhash64("tile"))
    pairs = rows.join(first, (F.col("tile") == F.col("of")) & (F.col("i") == F.col("j")) & (F.col("a.id") != F.col("b.id")) & placed_to_link(num, den))
    pairs = cut(gathered(pairs.select(*ordered()).distinct()))
    links = linked(may_link(pairs, sets, num, den), docs, sets, k, num, den)
    now = connected_components(links)
    # tiles in which components are still to be told apart
    placed = met.join(now, F.col("id") == F.col("node"), "left").select("tile", "id", "n", "pos", "prev", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("tile").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low <> high and size > 2")
    several = several.select(F.col("tile").alias("of"), F.xxhash64("tile").alias("j"))
    # the derived keys make both sides plain exchanges, whose hot keys AQE can split
    placed = cut(gathered(placed.withColumn("i", F.xxhash64("tile")).join(several, (F.col("tile") == F.col("of")) & (F.col("i") == F.col("j")), "left_semi")))
    largest = placed.groupBy("tile", "c").agg(F.count("*").alias("size")).groupBy("tile").agg(F.max(F.struct("size", "c")).alias("most"))
    largest = largest.select(F.col("tile").alias("of"), F.xxhash64("tile").alias("j"), F.col("most.c").alias("most"))
    outside = cut(gathered(placed.join(largest, (F.col("tile") == F.col("of")) & (F.col("i") == F.col("j")) & (F.col("c") != F.col("most"))).select("tile", "c", side.alias("a"))))
    others = placed.select(F.col("tile").alias("of"), F.col("c").alias("d"), side.alias("b"))
    more = outside.join(others, (F.col("of") == F.col("tile")) & (F.col("c") != F.col("d")) & placed_to_link(num, den))
    more = may_link(more.select(*ordered()).distinct().join(pairs, ["a", "b"], "left_anti"), sets, num, den)
    if more.isEmpty():
        return now
    return connected_components(links.unionByName(linked(more, docs, sets, k, num, den)))


def marked_classes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (the text's hash), n_shingles, component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    facts = facts_of(docs, k)
    known, counts = frequent_shingles(facts)
    rows = facts.where("not frequent").select(F.col("doc_id").cast("long").alias("doc_id"), "mark", "k1", "k2", "n", "signature")
    sets = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"))
    sets = cut(gathered(sets.where("doc is not null").withColumn("id", F.xxhash64("k1", "k2"))))
    tiles = tiles_of(docs, k, num, den, known, counts)
    met = shared_tiles(tiles, sets)
    discard(tiles)
    now = links_of(met, docs, sets, k, num, den)
    placed = sets.join(now, F.col("id") == F.col("node"), "left").select("k1", "k2", "doc", F.coalesce("component", "id").alias("of"))
    # the derived keys make both sides plain exchanges, whose hot keys AQE can split
    least = placed.groupBy("of").agg(F.min("doc").alias("c")).select(F.col("of").alias("_of"), "c", F.xxhash64("of").alias("_i"))
    named = placed.withColumn("i", F.xxhash64("of")).join(least, (F.col("i") == F.col("_i")) & (F.col("of") == F.col("_of"))).select("k1", "k2", "c", F.xxhash64("k1", "k2").alias("j"))
    own = rows.select("doc_id", "mark", "n", F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.xxhash64("k1", "k2").alias("i"))
    out = own.join(named, (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2")) & (F.col("i") == F.col("j")), "left")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link when den * intersection >= num * union."""
    return marked_classes(docs, k, num, den, id_col, text_col).drop("mark")


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that of the smallest id; all columns as they were.  Null ids stay.

    A row goes by its id and its text, so another text under the same id stays."""
    gone = marked_classes(docs, k, num, den, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text_of(text_col)).alias("own_mark"))
    return marked.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_mark") == F.col("gone_mark")), "left_anti").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


#: All pairs that share a shingle, and what they reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 90 * (i.n + j.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)
"""
