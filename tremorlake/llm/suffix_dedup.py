"""Suffix-array dedup: repeated byte strings by bucket-pointer refinement of sampled suffixes.

Any string of LENGTH bytes holds, among its q-grams, one of the smallest hash; equal strings hold it at the
same offset.  So only suffixes that start at such anchors (about two in LENGTH - Q) take part.

1. Anchors fall into initial buckets by their q-gram.  Buckets of one are done.
2. An anchor's context is all that a string around it could cover.  Anchors whose whole contexts are equal
   are done too: everything in them repeats.  Of equal contexts one goes on.
3. Remaining buckets are refined by the bucket numbers of later offsets, recursively: the numbers that tell n
   bytes apart, looked up n bytes further on, tell 2n apart.  That sorts what follows the q-gram and, read
   backwards, what precedes it, and so says which strings of LENGTH bytes repeat.
4. The spans are carried to each anchor of that context, merged per text and cut out.

A bucket that is too large for a task is refined in the cluster first, round by round, each bucket of a round
made of the last one's and of more bytes around it (split_large), until the buckets fit.  Texts that are equal
as a whole are one text with a count; if it is 2 or more, all its strings repeat.  Q-grams, contexts and the
buckets of the cluster's rounds are compared by 64-bit hashes, the rest by bytes.

Defined cases: null or empty text has 0 bytes and loses none; texts under LENGTH bytes lose none; repeated
rows are copies of each other; overlapping occurrences count; an empty table gives none; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.bitmaps import bitmap_subquery, possible
from tremorlake.llm.common import cut, discard, gathered, table, text_of, written
from tremorlake.llm.shingles import GAP, mix, prefix_sums, span_hashes

LENGTH = 200
Q = 48
#: Contexts of one bucket that a task refines (some 400 bytes each); larger buckets are split in the cluster first.
MOST = 10_000
#: Contexts that are refined together, about.
TOGETHER = 5_000


def sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """Best of every width values in a row, by prefixes and suffixes of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = best.accumulate(padded, 1).ravel()
    back = best.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return best(back[:m], ahead[width - 1 : width - 1 + m])


def slices_of_bytes(raw: list[bytes], size: int = 250_000) -> Iterator[tuple[int, list[bytes]]]:
    at, total = 0, 0
    for i, r in enumerate(raw):
        if i > at and total + len(r) > size:
            yield at, raw[at:i]
            at, total = i, 0
        total += len(r)
    if at < len(raw):
        yield at, raw[at:]


def anchors(raw: list[bytes], length: int, q: int) -> tuple[np.ndarray, ...]:
    """Of texts in one buffer: index of text, position, q-gram's hash, bytes to the left and right in the context, context's hash."""
    data = np.frombuffer(GAP.join(raw) + GAP, np.uint8)
    sizes = np.array([len(r) for r in raw])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    width = length - q + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    sums = prefix_sums(data)
    at = np.arange(len(data) - q + 1)
    grams = span_hashes(sums, at, at + q) | np.uint64(1)
    least = sliding(grams, width, np.minimum, np.iinfo(np.uint64).max)
    # strings that reach over a text's end are none
    valid = np.zeros(len(least), bool)
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= length:
            valid[s : s + n - length + 1] = True
    least[~valid] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    found = np.flatnonzero(sliding(padded, width, np.maximum, 0) == grams)
    text = np.searchsorted(starts, found, side="right") - 1
    left = np.minimum(width - 1, found - starts[text])
    right = np.minimum(length, starts[text] + sizes[text] - found)
    context = mix(span_hashes(sums, found - left, found + right) + (left * 1000 + right).astype(np.uint64))
    return text, found - starts[text], grams[found], left, right, context


ANCHORS = "key long, n long, pos long, gram long, l int, r int, context long"


def anchors_of(texts: DataFrame, length: int, q: int) -> DataFrame:
    """texts: key, n, text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for at, part in slices_of_bytes(raw):
                text, pos, gram, left, right, context = anchors(part, length, q)
                own = batch.iloc[at : at + len(part)]
                yield pd.DataFrame({"key": own["key"].to_numpy()[text], "n": own["n"].to_numpy()[text], "pos": pos, "gram": gram.view(np.int64), "l": left, "r": right, "context": context.view(np.int64)})

    return written(texts.where(F.col("n") >= length).select("key", "n", "text").mapInPandas(scan, ANCHORS), "anchors")


def context_matrix(blobs: list[bytes], lefts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by column, the anchor at column length - q, and the first and last column at which a whole string starts."""
    width = length - q
    raw = np.zeros((len(blobs), width + length), np.uint8)
    first = width - np.asarray(lefts, np.int64)
    for i, (b, at) in enumerate(zip(blobs, first.tolist(), strict=True)):
        raw[i, at : at + len(b)] = np.frombuffer(b, np.uint8)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    return raw, first, first + sizes - length


def numbered(values: np.ndarray) -> np.ndarray:
    """Bucket numbers: equal values, equal numbers, in sorted order."""
    return np.unique(values, return_inverse=True)[1].reshape(values.shape).astype(np.int64)


def suffix_order(bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each bucket in the order of their bytes, and how many bytes each has in common with the row before it.

    All eight-byte offsets of all rows get bucket numbers; a bucket is refined by the number of the offset that
    lies as far behind as the bucket already tells apart, so the numbers just made serve again for twice the width."""
    m, n = side.shape
    wide = np.zeros((m, -(-n // 8) * 8), np.uint8)
    wide[:, :n] = side
    number = numbered(wide.view(">u8").astype(np.uint64))
    span = 1
    while span < number.shape[1]:
        later = np.zeros_like(number)
        later[:, :-span] = number[:, span:] + 1
        number = numbered(number * (int(number.max()) + 2) + later)
        span *= 2
    order = np.lexsort((number[:, 0], bucket))
    same = side[order[1:]] == side[order[:-1]]
    common = np.where(same.all(1), n, same.argmin(1))
    common[bucket[order[1:]] != bucket[order[:-1]]] = -1
    return order, common


def refine(bucket: np.ndarray, raw: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, q: int) -> np.ndarray:
    """repeated[i, d]: the string of context i that starts at column d stands in another context of its bucket too.

    What lies behind the anchor and, read backwards, what lies before it are sorted within the buckets.  Contexts
    that share a string at column d share d bytes behind and width - d bytes before, so at each column two runs
    of neighbours - one in either order - give the final buckets."""
    width, m = length - q, len(bucket)
    repeated = np.zeros((m, width + 1), bool)
    if m < 2:
        return repeated
    bucket = numbered(bucket)
    orders = [suffix_order(bucket, raw[:, length:]), suffix_order(bucket, raw[:, width - 1 :: -1] if width else raw[:, :0])]
    most = np.zeros(m, np.int64)  # of a context with any other of its bucket, on both sides
    for order, common in orders:
        best = np.concatenate([[-1], common])
        best = np.maximum(best, np.concatenate([common, [-1]]))
        most[order] += best
    alive = most >= width
    classes = np.zeros(m, np.int64)
    for d in range(width + 1):
        rows = np.flatnonzero(alive & (first <= d) & (d <= last))
        if len(rows) < 2:
            continue
        key = np.zeros(len(rows), np.int64)
        for (order, common), depth in zip(orders, (d, width - d), strict=True):
            classes[order[0]] = 0
            classes[order[1:]] = np.cumsum(common < depth)
            key = key * m + classes[rows]
        final = numbered(key)
        repeated[rows[np.bincount(final)[final] > 1], d] = True
    return repeated


def spans_of(repeated: np.ndarray, length: int, q: int) -> tuple[list[list[int]], list[list[int]]]:
    """Unions of the repeated strings of each context, relative to its anchor."""
    width = length - q
    starts, ends = [], []
    for row in repeated:
        at = np.flatnonzero(row)
        if not len(at):
            starts.append([])
            ends.append([])
            continue
        new = np.flatnonzero(np.diff(at) > length)
        starts.append((at[np.concatenate([[0], new + 1])] - width).tolist())
        ends.append((at[np.concatenate([new, [len(at) - 1]])] + length - width).tolist())
    return starts, ends


SPANS = "gram long, context long, starts array<long>, ends array<long>"
CONTEXTS = "gram long, context long, size long, l int, bytes binary"


def in_tasks(contexts: DataFrame, groups: int, length: int, q: int) -> DataFrame:
    """Spans that repeat, relative to the anchor.  contexts: bucket, size, low, high, gram, context, l, bytes; only
    strings that start within low to high count.  Small buckets come together, larger ones have a task of their own."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        raw, first, last = context_matrix(list(group["bytes"]), group["l"].to_numpy(), length, q)
        first, last = np.maximum(first, group["low"].to_numpy()), np.minimum(last, group["high"].to_numpy())
        starts, ends = spans_of(refine(group["bucket"].to_numpy(), raw, first, last, length, q), length, q)
        out = pd.DataFrame({"gram": group["gram"], "context": group["context"], "starts": starts, "ends": ends})
        return out[[len(s) > 0 for s in starts]]

    deal = F.when(F.col("size") < TOGETHER // 4, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket"))
    return contexts.withColumn("deal", deal).groupBy("deal").applyInPandas(run, SPANS)


def split_large(large: DataFrame, most: int, length: int, q: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Refines buckets of more than most contexts in the cluster, until what is left of them fits in a task.

    large: gram, context, l, bytes.  The strings that start at the columns low to high all hold the same core, so
    halving that range makes the core longer: the core's bucket within the last one is the next bucket.  Of equal
    bytes for the whole range one goes on, and all of them repeat there.  Buckets of one are done.  At one column
    core and whole are the same, so the rounds end, whatever the data.  Gives what repeats, and contexts for in_tasks."""
    width = length - q
    first = width - F.col("l")
    last = first + F.octet_length("bytes") - length
    told, ready = [], []
    now = large.select("gram", "context", F.col("gram").alias("bucket"), F.lit(0).alias("low"), F.lit(width).alias("high"))
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))
        each = now.join(large, ["gram", "context"]).select("*", F.explode(halves).alias("x")).withColumns({"low": F.col("x.a"), "high": F.col("x.b")})
        each = each.withColumns({"s": F.greatest("low", first), "e": F.least("high", last)}).where("s <= e")
        core = F.expr("substring(bytes, high - s0 + 1, low + len - high)".replace("s0", f"({width} - l)").replace("len", str(length)))
        whole = F.expr("substring(bytes, s - s0 + 1, e + len - s)".replace("s0", f"({width} - l)").replace("len", str(length)))
        each = each.withColumn("next", F.xxhash64("bucket", "low", "high", core)).withColumn("same", F.xxhash64("next", "s", "e", whole))
        each = written(gathered(each.select("gram", "context", "next", "same", "low", "high", "s", "e")), "split")
        kinds = each.groupBy("next", "same").agg(F.count("*").alias("c"), F.min(F.struct("gram", "context", "low", "high")).alias("one"))
        kinds = cut(gathered(kinds))
        twice = kinds.where("c > 1").select(F.col("next").alias("_next"), F.col("same").alias("_same"), F.xxhash64("next", "same").alias("j"))
        both = each.withColumn("i", F.xxhash64("next", "same")).join(twice, (F.col("i") == F.col("j")) & (F.col("next") == F.col("_next")) & (F.col("same") == F.col("_same")), "left_semi")
        told.append(both.select("gram", "context", F.array((F.col("s") - width).cast("long")).alias("starts"), F.array((F.col("e") + q).cast("long")).alias("ends")))
        sizes = kinds.groupBy("next").agg(F.count("*").alias("size"), F.count_if(F.col("c") == 1).alias("open")).where("size > 1 and open > 0")
        sizes = sizes.select(F.col("next").alias("bucket"), "size", F.xxhash64("next").alias("j"))
        left = kinds.select("next", "one.*", F.xxhash64("next").alias("i")).join(sizes, (F.col("i") == F.col("j")) & (F.col("next") == F.col("bucket")))
        left = cut(gathered(left.select("gram", "context", "bucket", "size", "low", "high")))
        ready.append(left.where(F.col("size") <= most).join(large, ["gram", "context"]))
        now = left.where(F.col("size") > most).drop("size")
        if now.isEmpty():
            return told, ready


def with_bytes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted: gram, context, size, key, n, pos, l, r.  Adds the bytes, taken from one of equal texts.

    Equal texts become one within the tasks that read them, before any of them are brought together."""
    listed = wanted.groupBy("key", "n").agg(F.collect_list(F.struct("gram", "context", "size", "pos", "l", "r")).alias("places"))
    listed = cut(gathered(listed))
    marks, bits = bitmap_subquery(listed.select(F.xxhash64("key").alias("h")))
    one = texts.where(possible(F.xxhash64("key"), marks, bits)).dropDuplicates(["key", "n"])
    some = one.join(listed, ["key", "n"]).select("text", "places")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            bounds, flat = places.offsets.to_numpy(), places.values
            fields = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "context", "size", "pos", "l", "r")}
            for i in range(len(batch)):
                raw = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                for a in range(bounds[i], bounds[i + 1], 2_000):  # places of one text, a few at a time
                    own = {c: v[a : min(a + 2_000, bounds[i + 1])] for c, v in fields.items()}
                    starts, ends = own["pos"] - own["l"], own["pos"] + own["r"]
                    taken = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own["gram"]), pa.array(own["context"]), pa.array(own["size"]), pa.array(own["l"], pa.int32()), pa.array(taken, pa.binary())], ["gram", "context", "size", "l", "bytes"])

    return gathered(some).mapInArrow(take, CONTEXTS)


def refined(wanted: DataFrame, texts: DataFrame, most: int, length: int, q: int) -> DataFrame:
    """Spans that repeat, relative to the anchor, of the contexts of all buckets.  wanted: see with_bytes."""
    n, largest = wanted.agg(F.count("*"), F.max("size")).first()
    groups = max(1, -(-int(n) // TOGETHER))
    whole = lambda frame: frame.withColumns({"bucket": F.col("gram"), "low": F.lit(0), "high": F.lit(length - q)})
    columns = ["bucket", "size", "low", "high", "gram", "context", "l", "bytes"]
    told, ready = [], [whole(with_bytes(wanted.where(F.col("size") <= most), texts)).select(columns)]
    if largest is not None and largest > most:
        large = written(with_bytes(wanted.where(F.col("size") > most), texts).drop("size"), "large")
        told, more = split_large(large, most, length, q)
        ready += [m.select(columns) for m in more]
    out = in_tasks(reduce(DataFrame.unionByName, ready), groups, length, q)
    return reduce(DataFrame.unionByName, told, out)


def repeated_spans(texts: DataFrame, length: int, q: int, most: int) -> DataFrame:
    """key, n, spans: array of (s, e), not merged.  texts: key, n, text, one row or more a text."""
    all_anchors = anchors_of(texts, length, q)
    spot = F.xxhash64("key", "n", "pos")
    buckets = all_anchors.groupBy("gram").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low <> high").select("gram")
    buckets = cut(gathered(buckets.select(F.col("gram").alias("of"), F.xxhash64("gram").alias("j"))))
    marks, bits = bitmap_subquery(buckets.select(F.col("j").alias("h")))
    some = all_anchors.withColumn("i", F.xxhash64("gram")).where(possible(F.col("i"), marks, bits))
    # the derived key makes both sides plain exchanges, whose hot keys AQE can split
    placed = some.join(buckets, (F.col("gram") == F.col("of")) & (F.col("i") == F.col("j")), "left_semi").drop("i").distinct()
    placed = written(gathered(placed), "placed")
    discard(all_anchors)
    # one of equal contexts goes on; its count says whether it is done
    kinds = placed.groupBy("gram", "context").agg(F.count("*").alias("c"), F.min(F.struct("key", "n", "pos", "l", "r")).alias("p"))
    kinds = written(gathered(kinds.select("gram", "context", "c", "p.*")), "kinds")
    # buckets in which every context is done need no refinement
    sizes = kinds.groupBy("gram").agg(F.count("*").alias("size"), F.count_if(F.col("c") == 1).alias("open")).where("size > 1 and open > 0")
    wanted = kinds.join(sizes.select(F.col("gram").alias("of"), "size", F.xxhash64("gram").alias("j")), (F.col("gram") == F.col("of")) & (F.xxhash64("gram") == F.col("j")))
    some = refined(cut(gathered(wanted.select("gram", "context", "size", "key", "n", "pos", "l", "r"))), texts, most, length, q)
    whole = kinds.where("c > 1").select("gram", "context", F.array(-F.col("l").cast("long")).alias("starts"), F.array(F.col("r").cast("long")).alias("ends"))
    told = whole.unionByName(some).withColumns({"_gram": F.col("gram"), "_context": F.col("context"), "j": F.xxhash64("gram", "context")}).select("_gram", "_context", "j", "starts", "ends")
    at = placed.withColumn("i", F.xxhash64("gram", "context")).join(told, (F.col("i") == F.col("j")) & (F.col("gram") == F.col("_gram")) & (F.col("context") == F.col("_context")))
    each = at.select("key", "n", F.explode(F.arrays_zip("starts", "ends")).alias("x"), "pos").select("key", "n", (F.col("pos") + F.col("x.starts")).alias("s"), (F.col("pos") + F.col("x.ends")).alias("e"))
    return written(gathered(each.groupBy("key", "n").agg(F.collect_set(F.struct("s", "e")).alias("spans"))), "spans")


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((int(x["s"]), int(x["e"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay) of every row."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"key": F.xxhash64("text"), "n": F.octet_length("text").cast("long")})
    spans = repeated_spans(rows.select("key", "n", "text"), length, q, most)
    copies = rows.where(F.col("n") >= length).groupBy("key", "n").agg(F.count("*").alias("copies")).where("copies > 1").select("key", "n", F.lit(True).alias("whole"))
    told = cut(gathered(spans.join(copies, ["key", "n"], "full_outer")))
    marks, bits = bitmap_subquery(told.select(F.xxhash64("key").alias("h")))
    touched = possible(F.xxhash64("key"), marks, bits)
    whole = F.coalesce("whole", F.lit(False))
    told = told.select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.when(~whole, F.col("spans")).alias("spans"), whole.alias("whole"), F.xxhash64("key").alias("j"))
    joined = rows.where(touched).withColumn("i", F.xxhash64("key")).join(told, (F.col("i") == F.col("j")) & (F.col("key") == F.col("_key")) & (F.col("n") == F.col("_n")), "left")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans, whole in zip(batch["doc_id"], batch["text"], batch["spans"], batch["whole"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone = [(0, len(raw))] if whole is True or whole == 1 else merged(spans) if spans is not None else []
                kept, at = [], 0
                for s, e in gone:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(e - s for s, e in gone), len(gone), b"".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary"
    changed = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans", "whole").mapInPandas(cut_out, schema)
    same = rows.where(~touched).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    both = changed.unionByName(same)
    return both.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 200 bytes as hex; its 128-bit hash stands for it.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 400)) AS m
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM d WHERE len(h) >= 400)),
t AS (SELECT doc_id, s FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
i AS (SELECT doc_id, s, sum(CASE WHEN s - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS island
  FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM t)),
x AS (SELECT doc_id, island, min(s) AS a, max(s) + 200 AS b FROM i GROUP BY ALL),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
k AS (SELECT y.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail
  FROM y JOIN d USING (doc_id) GROUP BY y.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
