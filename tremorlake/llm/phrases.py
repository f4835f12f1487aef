"""Phrase mining: collocations of two to five words, with exact counts.

Texts become chunks of bounded length, coded by their own words, in one pass.  Words that are frequent in their
language get numbers over the whole corpus; a chunk learns the numbers of its words by a join, so no task holds
the dictionary.  Pieces break at every other word, since no frequent phrase holds one.  The numbers from each
position on are packed into a binary key of fixed width, zeros behind a piece's end.  A chunk's keys are
radix-sorted and counted by runs, dealt by ranges, sorted and counted again: of keys in order all shorter
phrases are runs of prefixes, and only runs that touch the edge of a range meet those of its neighbours.
Pairs are counted first.  Longer keys start only where two frequent pairs follow each other and end with the
last of them; a bitmap tells pairs, and one that it lets through by mistake is dropped by its count.

Memory: a chunk, and the distinct keys of a range (rows_per_range on average); copies of one key are added up as
they come, so a hot one doesn't count.  Words and phrases of any frequency take part, in whole texts.

Defined cases: null text is empty and gives nothing; a null lang is `und`; repeated rows count as often as
they stand there; words of any length are words; an empty table gives no phrase; of columns only lang and
text are read.  Ties in score and count go by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.llm.bitmaps import bitmap_subquery, possible
from tremorlake.llm.common import cut, discard, table, text_of, written
from tremorlake.operators.temporal import numbered

#: Words of the longest phrase.
LONGEST = 5
MIN_COUNT = 100
TOP = 2000
CHUNK_WORDS = 1 << 21
#: Distinct words that a task keeps for one language.
MOST_CODES = 1 << 20
ROWS_PER_RANGE = 4_000_000

#: Every mark that ends a piece becomes a full stop; no word holds one then.
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
#: Bytes that are split at once.
_BLOCK = 1 << 22
_CHUNK = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("starts", pa.int64())])
_KEYS = pa.schema([("key", pa.binary()), ("n", pa.int64())])


class Codes(dict):
    """word -> number by first sight; the piece's end is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunker:
    """Coded words of one language, given out in chunks.

    A chunk that ends within a piece goes on for the words that its last phrases need; no phrase starts there."""

    def __init__(self, size: int):
        self.size, self.codes, self.parts, self.length = size, Codes(), [], 0

    def add(self, text: bytes) -> Iterator[tuple]:
        marked = text.lower().translate(_MARKS).replace(b".", b" . ")
        at = 0
        while at < len(marked):
            end = at + _BLOCK
            if end < len(marked):  # back to the last blank, or on to the next one in a very long word
                back = max(marked.rfind(b" ", at, end), marked.rfind(b"\t", at, end))
                ahead = [x for x in (marked.find(b" ", end), marked.find(b"\t", end)) if x >= 0]
                end = back if back > at else min(ahead, default=len(marked))
            self._append(marked[at:end].split())
            at = end
            while self.length >= self.size + LONGEST:
                yield self._chunk(self.size)
        self._append([b"."])

    def _append(self, words: list[bytes]) -> None:
        if words:
            self.parts.append(np.fromiter(map(self.codes.__getitem__, words), dtype=np.uint32, count=len(words)))
            self.length += len(words)

    def _chunk(self, starts: int) -> tuple:
        """words, counts, codes (with the local number 0 for ends), starts."""
        whole = np.concatenate(self.parts)
        own = whole[: starts + LONGEST - 1]
        self.parts, self.length = [whole[starts:]], len(whole) - starts
        seen = np.zeros(len(self.codes), dtype=bool)
        seen[own] = True
        seen[0] = True
        local = np.cumsum(seen, dtype=np.uint32) - np.uint32(1)
        names = list(self.codes)
        present = np.flatnonzero(seen)
        counts = np.bincount(local[own[:starts]], minlength=len(present))
        return [names[i] for i in present[1:]], counts[1:], local[own].astype("<u4").tobytes(), starts

    def rest(self) -> Iterator[tuple]:
        while self.length:
            yield self._chunk(min(self.length, self.size))
        self.codes = Codes()


def coded(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs: lang, text.  chunk, lang, words, counts, codes, starts."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: dict[str, Chunker] = {}

        def row(lang: str, chunk: tuple) -> pa.RecordBatch:
            nonlocal number
            words, counts, codes, starts = chunk
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([codes], pa.binary()), pa.array([starts], pa.int64())], schema=_CHUNK)

        for batch in batches:
            texts = batch.column("text")
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                own = open_.get(lang)
                if own is None:
                    own = open_[lang] = Chunker(chunk_words)
                for chunk in own.add(text.as_py()):
                    yield row(lang, chunk)
                if len(own.codes) > MOST_CODES:
                    yield from (row(lang, c) for c in own.rest())
            # many languages share the room of a few
            if sum(c.length for c in open_.values()) > 2 * chunk_words:
                for lang, own in open_.items():
                    yield from (row(lang, c) for c in own.rest())
                open_ = {}
        for lang, own in open_.items():
            yield from (row(lang, c) for c in own.rest())

    return docs.mapInArrow(code, "chunk long, lang string, words array<binary>, counts array<long>, codes binary, starts long")


def radix_runs(digits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of 16-bit digits in order, with the sums of their counts.

    lexsort goes from the last digit to the first by stable sorts, which are radix sorts for 16 bits."""
    if not len(digits):
        return digits, counts
    order = np.lexsort(digits.T[::-1])
    digits, counts = digits[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (digits[1:] != digits[:-1]).any(axis=1)]))
    return digits[first], np.add.reduceat(counts, first)


def to_digits(ids: np.ndarray, width: int) -> np.ndarray:
    """ids (n, size) -> (n, size * width / 2) 16-bit digits, the highest first."""
    parts = [(ids >> ids.dtype.type(16 * (width // 2 - 1 - d))).astype(np.uint16) for d in range(width // 2)]
    return np.stack(parts, axis=2).reshape(len(ids), -1)


def to_batch(digits: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    size = digits.shape[1] * 2
    offsets = np.arange(len(digits) + 1, dtype=np.int32) * size
    packed = pa.Array.from_buffers(pa.binary(), len(digits), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(digits.astype(">u2").tobytes())])
    return pa.RecordBatch.from_arrays([packed, pa.array(counts, pa.int64())], schema=_KEYS)


def from_batch(batch: pa.RecordBatch, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    whole = b"".join(batch.column("key").to_pylist())
    return np.frombuffer(whole, dtype=">u2").reshape(-1, size * width // 2).astype(np.uint16), np.asarray(batch.column("n").to_numpy(zero_copy_only=False), dtype=np.int64)


def encoded(chunks: DataFrame, dictionary: DataFrame, width: int) -> DataFrame:
    """ids (little-endian, 4 bytes up to a width of 4, else 8) and starts of every chunk; other words and ends are 0.

    Words that a bitmap rules out don't take part in the join; a full one lets all through."""
    marks, bits = bitmap_subquery(dictionary.select(F.xxhash64("lang", "word").alias("h")))
    listed = chunks.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).where(possible(F.xxhash64("lang", "word"), marks, bits))
    known = listed.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list("pos").alias("pos"), F.collect_list("id").alias("ids"))
    both = chunks.select("chunk", "codes", "starts", F.size("words").alias("words")).join(known, "chunk")
    kind = "<u4" if width <= 4 else "<u8"
    schema = pa.schema([("ids", pa.binary()), ("starts", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pos, ids, codes, starts, words = (batch.column(c)[i] for c in ("pos", "ids", "codes", "starts", "words"))
                number = np.zeros(words.as_py() + 1, dtype=kind)
                number[np.asarray(pos.values) + 1] = np.asarray(ids.values)
                sequence = number[np.frombuffer(codes.as_py(), dtype="<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([sequence.tobytes()], pa.binary()), pa.array([starts.as_py()], pa.int64())], schema=schema)

    return both.mapInArrow(encode, "ids binary, starts long")


def pair_hash(a: Column | np.ndarray, b: Column | np.ndarray, both: Callable, right: Callable) -> Column | np.ndarray:
    """The same 62 bits of two numbers in SQL and in numpy, given their bitwise and, and shift to the right."""
    mask = (1 << 31) - 1
    a, b = both(a, mask), both(b, mask)
    low = both(right(a * 2_654_435_761, 20) + right(b * 2_246_822_519, 13), mask)
    high = both(right(a * 3_266_489_917, 11) + right(b * 668_265_263, 17), mask)
    return low + high * (1 << 32)


def keys(sequences: DataFrame, width: int, size: int, least: int, marks: tuple[Column, int] | None = None) -> DataFrame:
    """key, n: of every chunk its distinct keys of size numbers, of which least are words, and how often they
    stand there.  With marks, a bitmap of pairs, keys end where the next two words are none of them."""
    kind = "<u4" if width <= 4 else "<u8"
    bits = marks[1] if marks else None
    told = sequences.select("ids", "starts", marks[0].alias("marks")) if marks else sequences.select("ids", "starts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sequence, n = np.frombuffer(batch.column("ids")[i].as_py(), dtype=kind), batch.column("starts")[i].as_py()
                sequence = np.concatenate([sequence, np.zeros(max(0, n + LONGEST - len(sequence)), dtype=kind)])
                joined = (sequence[:-1] > 0) & (sequence[1:] > 0)
                if bits is not None:
                    pairs = np.flatnonzero(joined)
                    h = pair_hash(sequence[pairs].astype(np.int64), sequence[pairs + 1].astype(np.int64), np.bitwise_and, np.right_shift)
                    words = np.asarray(batch.column("marks")[i].values).view(np.uint64)
                    for spot in (h & ((1 << bits) - 1), (h >> 32) & ((1 << bits) - 1)):
                        joined[pairs] &= (words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
                begin = joined[:n].copy()
                for k in range(1, least - 1):
                    begin &= joined[k : n + k]
                begin = np.flatnonzero(begin)
                for at in range(0, len(begin), 1 << 20):
                    own = begin[at : at + (1 << 20)]
                    wide = np.zeros((len(own), size), dtype=kind)
                    alive = np.ones(len(own), dtype=bool)
                    wide[:, 0] = sequence[own]
                    for k in range(1, size):
                        alive &= joined[own + k - 1]
                        wide[alive, k] = sequence[own[alive] + k]
                    yield to_batch(*radix_runs(to_digits(wide, width), np.ones(len(own), dtype=np.int64)))

    return told.mapInArrow(pack, "key binary, n long")


def prefix_runs(digits: np.ndarray, counts: np.ndarray, width: int, shortest: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of each length and their counts, of distinct keys in order: runs of prefixes.

    Runs at either end may go on in the next range and are given whatever their count is."""
    half = width // 2
    for words in range(shortest, digits.shape[1] // half + 1):
        own = digits[:, : words * half]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
        sums = np.add.reduceat(counts, first)
        keep = sums >= least
        keep[[0, -1]] = True
        keep &= (own[first, -half:] > 0).any(axis=1)  # the piece has so many words
        out = np.zeros((int(keep.sum()), digits.shape[1]), dtype=np.uint16)
        out[:, : words * half] = own[first[keep]]
        yield out, sums[keep]


def counted(found: DataFrame, width: int, size: int, shortest: int, least: int, ranges: int) -> DataFrame:
    """key, a: phrases of shortest to size words that stand there at least so often; shorter ones end in zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        rows = settled = 0
        for batch in batches:
            waiting.append(from_batch(batch, width, size))
            rows += batch.num_rows
            # sorted anew whenever as many came in as there were, so repeated keys never pile up
            if rows > max(1 << 20, 2 * settled):
                waiting = [radix_runs(np.concatenate([d for d, _ in waiting]), np.concatenate([c for _, c in waiting]))]
                rows = settled = len(waiting[0][0])
        if not rows:
            return
        digits, counts = radix_runs(np.concatenate([d for d, _ in waiting]), np.concatenate([c for _, c in waiting]))
        for told in prefix_runs(digits, counts, width, shortest, least):
            if len(told[0]):
                yield to_batch(*told)

    runs = found.repartitionByRange(ranges, "key").mapInArrow(count, "key binary, n long")
    return runs.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _padded(part: str, width: int) -> Column:
    return F.expr(f"rpad({part}, {LONGEST * width}, X'00')")


def best_cuts(found: DataFrame, dictionary: DataFrame, width: int) -> DataFrame:
    """key, words, a, lang, n, l, r, score: each candidate at the cut that scores least, of ties the first."""
    known = found.select(F.col("key").alias("part"), F.col("a").alias("f")).unionByName(dictionary.select(_padded("code", width).alias("part"), F.col("c").alias("f")))
    cuts = found.select("key", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("left"), _padded(f"substring(key, 1, k * {width})", width).alias("part")), F.struct(F.lit(False).alias("left"), _padded(f"substring(key, k * {width} + 1, {LONGEST * width})", width).alias("part")))
    each = cuts.select("key", "k", F.inline(sides)).join(known, "part")
    both = each.groupBy("key", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    first = dictionary.select(F.col("code").alias("first"), "lang", "n")
    named = found.withColumn("first", F.expr(f"substring(key, 1, {width})")).join(first, "first").drop("first")
    score = F.expr("cast(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = named.join(both, "key").withColumn("score", score.cast("long"))
    least = scored.groupBy("key", "words", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    return least.select("key", "words", "a", "lang", "n", "least.l", "least.r", "least.score")


def uncovered(scored: DataFrame, found: DataFrame, width: int, share: int) -> DataFrame:
    """Candidates that no longer one holds with share percent of their count."""
    spots = F.expr("flatten(transform(sequence(2, words - 1), j -> transform(sequence(0, words - j), i -> struct(i, j))))")
    inner = found.where("words > 2").select("key", "a", F.inline(spots))
    held = inner.select(_padded(f"substring(key, i * {width} + 1, j * {width})", width).alias("held"), "a").groupBy("held").agg(F.max("a").alias("longer"))
    both = scored.join(held, F.col("key") == F.col("held"), "left")
    return both.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("held", "longer")


def spelled(rows: DataFrame, dictionary: DataFrame, width: int) -> DataFrame:
    """rows with the phrase as text in place of the key."""
    ids = rows.select("key", F.posexplode(F.expr(f"transform(sequence(0, words - 1), i -> substring(key, i * {width} + 1, {width}))")).alias("i", "code"))
    words = ids.join(dictionary.select("code", "word"), "code").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", F.col("word").cast("string").alias("word")))).alias("w"))
    return rows.join(words.select("key", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase")), "key").drop("key")


def best_of_each(rows: DataFrame, dictionary: DataFrame, width: int, top: int) -> DataFrame:
    """The first of each language, ranked within hashed parts of a language before the parts meet."""
    parts = max(1, ceil(sqrt(rows.count() / top)))
    placed = rows.withColumn("part", F.pmod(F.crc32("key"), F.lit(parts)))
    leading = F.rank().over(Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a")))
    likely = cut(spelled(placed.withColumn("at", leading).where(F.col("at") <= top).drop("at"), dictionary, width))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    few = likely.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, covered_share: int = 100, lang_col: str = "lang", text_col: str = "text", chunk_words: int = CHUNK_WORDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases by score.

    chunk_words and rows_per_range set how much a task holds and change no result."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    chunks = written(coded(rows, chunk_words), "phrase_chunks")
    counts = chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).toDF("lang", "word", "c").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    totals = chunks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n"))
    frequent = numbered(counts.where(F.col("c") >= min_count), ["lang", "word"], "id").withColumn("id", F.col("id") + 1)
    words = frequent.agg(F.max("id")).first()[0] or 0
    width = max(2, 2 * ceil(words.bit_length() / 16))
    code = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    dictionary = cut(frequent.join(totals, "lang").select("lang", "word", "c", "n", "id", code.alias("code")))
    positions = chunks.agg(F.sum("starts")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(positions / rows_per_range))
    sequences = written(encoded(chunks, dictionary, width), "phrase_ids")
    discard(chunks)
    pairs = cut(counted(keys(sequences, width, 2, 2), width, 2, 2, min_count, ranges))
    number = lambda k: F.conv(F.hex(F.expr(f"substring(key, {k * width + 1}, {width})")), 16, 10).cast("long")
    hashes = pairs.select(pair_hash(number(0), number(1), lambda x, m: x.bitwiseAND(F.lit(m).cast("long")), F.shiftright).alias("h"))
    longer = counted(keys(sequences, width, LONGEST, 3, bitmap_subquery(hashes)), width, LONGEST, 3, min_count, ranges)
    found = pairs.select(_padded("key", width).alias("key"), "a").unionByName(longer)
    length = sum((F.expr(f"substring(key, {i * width + 1}, {width})") != F.lit(bytearray(width))).cast("int") for i in range(LONGEST))
    found = cut(found.withColumn("words", length))
    discard(sequences)
    scored = cut(uncovered(best_cuts(found, dictionary, width), found, width, covered_share))
    return best_of_each(scored, dictionary, width, top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1 : k], ' ') AS p, array_to_string(ws[k + 1 : m], ' ') AS q
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scores AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, n,
    (1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.p JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.q
  JOIN totals ON totals.lang = cuts.lang),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
