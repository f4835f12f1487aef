"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

One scan of the documents takes their words, tests each shingle of up to three words against a bitmap of the
benchmark's shingles (of fixed largest size; a false hit costs time, never a result) and keeps the maximal
runs of possible shingles.  Over those runs, shingles are counted and so ordered by rarity.  A window must
be contained whole, so a prefix of one token suffices: its rarest shingle joins the runs.  The bounds on
length and position - the window must lie within the run with its token at that offset - and the exact
comparison of all words settle each candidate.

Defined cases: null text or item has no words; an item of fewer words than a window is one window, one of
none is skipped, as is one with a null id; repeated items count once; a document without words has n_words 0
and is not contaminated; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.bitmaps import bitmap_longs, possible
from tremorlake.llm.common import ascii_lower, cut, table, text_of

WINDOW = 13
SHINGLE = 3
#: Largest bitmap: 2**20 bits.  It stands in the plan as a literal, for a lambda may hold no subquery.
BITMAP_BITS = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingle_hash(words: Column | str, at: Column, g: int) -> Column:
    """Of the g words from position at (from 0)."""
    words = F.col(words) if isinstance(words, str) else words
    return F.xxhash64(*[words[at + k] for k in range(g)])


def positions(words: str, g: int) -> Column:
    n = F.size(words)
    return F.when(n >= g, F.sequence(F.lit(0), n - g)).otherwise(F.array().cast("array<int>"))


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, words, g: the windows of every item, each once an item."""
    told = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words_of(text_of(text_col)).alias("all"))
    told = told.where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    each = told.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, window))).alias("words")).distinct()
    return each.withColumn("g", F.least(F.size("words"), F.lit(SHINGLE)))


def bitmap(shingles: DataFrame, bits: int) -> Column:
    """A literal array of longs in which two bits of each shingle hash h are set.  At most 2**(bits - 6) rows come to the driver."""
    filled = {int(k): int(v) for k, v in bitmap_longs(shingles, bits).collect()}
    text = ",".join(str(filled.get(k, 0)) for k in range(1 << (bits - 6)))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def shingles_of(words: str, g: int) -> Column:
    return F.transform(positions(words, g), lambda i: shingle_hash(words, i, g))


# Spark counts a lambda's parameters, so what a lambda needs comes by closure.
def _is_possible(words: str, g: int, marks: Column, bits: int):
    return lambda i: possible(shingle_hash(words, i, g), marks, bits)


def _runs(hits: str, words: str, g: int) -> Column:
    """Maximal runs of consecutive hits as (start, words)."""
    starts = F.filter(hits, lambda x, i: (i == 0) | (F.get(F.col(hits), i - 1) < x - 1))
    ends = F.filter(hits, lambda x, i: (i == F.size(hits) - 1) | (F.get(F.col(hits), i + 1) > x + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), F.slice(words, s + 1, e - s + g).alias("words")))


def scan(docs: DataFrame, by_size: dict[int, tuple[Column, int]], id_col: str, text_col: str) -> DataFrame:
    """row_id, doc_id, mark, n_words and for each shingle size runs_g: array of (start, words).  Written down."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("row_id", "doc_id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("words"))
    for g, (marks, bits) in by_size.items():
        rows = rows.withColumn(f"hits_{g}", F.filter(positions("words", g), _is_possible("words", g, marks, bits)))
    kept = ["row_id", "doc_id", "mark", F.size("words").cast("long").alias("n_words")]
    for g in by_size:
        kept.append(_runs(f"hits_{g}", "words", g).alias(f"runs_{g}"))
    return cut(rows.select(*kept))


def occurrences(scanned: DataFrame, windows: DataFrame, g: int, window: int) -> DataFrame:
    """row_id, first, n, words: every place where a window stands, words being the window's."""
    runs = scanned.select("row_id", F.explode(f"runs_{g}").alias("run")).select("row_id", "run.start", F.col("run.words").alias("words"))
    # no more context than a window needs on either side of the token
    near = lambda i: F.struct(
        i.alias("at"),
        shingle_hash("words", i, g).alias("h"),
        F.greatest(i - (window - 1), F.lit(0)).alias("from"),
        F.slice("words", F.greatest(i - (window - 1), F.lit(0)) + 1, 2 * window).alias("around"),
    )
    tokens = runs.select("row_id", "start", F.explode(F.transform(positions("words", g), near)).alias("t")).select("row_id", "start", "t.*")
    distinct = windows.where(F.col("g") == g).select("words").distinct()
    members = distinct.select("words", F.posexplode(shingles_of("words", g)).alias("off", "h"))
    counts = tokens.groupBy("h").agg(F.count("*").alias("n"))
    # shingles that no document has: the window stands nowhere; the inner join of its rarest one finds nothing
    ordered = members.join(counts, "h", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("rarest"))
    prefix = ordered.where("rarest.n > 0").select(F.col("words").alias("window"), F.col("rarest.h").alias("h"), F.col("rarest.off").alias("off"))
    met = tokens.join(prefix, "h").withColumn("lead", F.col("at") - F.col("off") - F.col("from"))
    fits = met.where((F.col("lead") >= 0) & (F.col("lead") + F.size("window") <= F.size("around")))
    sure = fits.where(F.slice("around", F.col("lead") + 1, F.size("window")) == F.col("window"))
    return sure.select("row_id", (F.col("start") + F.col("at") - F.col("off")).alias("first"), F.size("window").alias("n"), F.col("window").alias("words"))


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    windows = cut(windows_of(items, window, item_col, item_text))
    sizes = sorted(r[0] for r in windows.select("g").distinct().collect())  # of 1, 2 and 3
    by_size = {}
    for g in sizes:
        shingles = windows.where(F.col("g") == g).select(F.explode(shingles_of("words", g)).alias("h")).distinct()
        bits = min(BITMAP_BITS, max(10, (64 * shingles.count()).bit_length()))
        by_size[g] = (bitmap(shingles, bits), bits)
    scanned = scan(docs, by_size, id_col, text_col)
    if not sizes:
        found = scanned.select("row_id").limit(0).select("row_id", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"))
    else:
        places = None
        for g in sizes:
            part = occurrences(scanned, windows, g, window)
            places = part if places is None else places.unionByName(part)
        places = cut(places)  # read twice
        spans = places.select("row_id", "first", "n").distinct().groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"))
        start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
        step = lambda a, s: F.struct(
            (a["hit"] + F.greatest(s["first"] + s["n"] - F.greatest(s["first"], a["end"]), F.lit(0))).cast("long").alias("hit"),
            F.greatest(a["end"], s["first"] + s["n"]).cast("long").alias("end"),
        )
        hit = spans.select("row_id", F.aggregate("spans", start, step)["hit"].alias("n_hit"))
        of = places.select("row_id", "words").distinct().join(windows.select("words", "item_id"), "words").select("row_id", "item_id").distinct()
        named = of.groupBy("row_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
        named = named.select("row_id", F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("items"))
        found = hit.join(named, "row_id")
    out = scanned.select("row_id", "doc_id", "mark", "n_words").join(found, "row_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns as they were."""
    bad = judge(docs, items, id_col=id_col, text_col=text_col).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark"))
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(text_of(text_col)).alias("own_mark"))
    return marked.join(bad, (F.col("own_mark") == F.col("bad_mark")) & F.col("own_id").eqNullSafe(F.col("bad_id")), "left_anti").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 12], ' ') AS g, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT dg.doc_id, dg.s, dg.n, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
