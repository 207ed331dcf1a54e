"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

1. Count, over all documents, every word that occurs in the benchmark.
2. Of each window of an item (WINDOW consecutive words; the whole item if it is shorter) mark the RAREST positions.
3. Store the postings (word, document, position) of the marked words, for all documents.
4. Shift each posting by the item position of its word. Shifted postings of one occurrence agree, so intersecting the
   lists is a count per (document, item, shift); a window can only occur where all its marked positions agree.
5. Check these places word by word and add up the windows that occur.

Near matches are found with the same postings, per window too: its TERMS rarest different words (all, if it has fewer)
must stand in any order within a stretch of WITHIN words. Each posting of a set's rarest word is a candidate; the
other words' postings near it narrow, one word after the other, where the stretch can begin. A word that is in no
document is no term, and a window with too few words that are in any has no near match.

The benchmark's words are broadcast if there are at most BROADCAST_ROWS of them, and joined by shuffle otherwise; the
same holds for the places to check and the hits, if they have at most BROADCAST_WORDS words.
A document is known by (doc_id, hash of its text): rows with the same id and text have the same result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW, WITHIN, TERMS = 10, 20, 4
RAREST, BROADCAST_ROWS, BROADCAST_WORDS = 3, 200_000, 1_000_000
PATTERN, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The matches of PATTERN with A-Z lower-cased: the pieces between BETWEEN that are not empty. A text of ASCII only,
    as many bytes as characters, takes the quick way to lower case."""
    t = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, BETWEEN), "")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small: few rows and, where it holds whole items, few words."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df
    return _if_small(df, df.agg(F.sum(F.size("item"))).first()[0] or 0) if "item" in df.columns else F.broadcast(df)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _items(items: DataFrame, window: int) -> DataFrame:
    got = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item")).where("size(item) > 0").distinct()
    return materialise(got.withColumn("iid", F.monotonically_increasing_id()).withColumn("span", F.least(F.size("item"), F.lit(window))), "items")


def _postings(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every occurrence of the chosen words: word, k1, k2, pos."""
    every = keyed.select("k1", "k2", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return every.join(_small(chosen.select("word").distinct()), "word")


def _counted(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """Per item position: iid, span, n, p, word, df (how often the word occurs in all documents)."""
    terms = materialise(items.select("iid", "span", F.size("item").alias("n"), F.posexplode("item").alias("p", "word")), "terms")
    seen = keyed.select(F.explode(words(F.col("text"))).alias("word")).join(_small(terms.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("df"))
    return terms.join(materialise(seen, "counts"), "word", "left").na.fill(0, ["df"])


def _windows(counted: DataFrame) -> DataFrame:
    """counted once for each window, starting at s, that the position is in."""
    return counted.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("span") + 1), F.least(F.col("p"), F.col("n") - F.col("span")))))


def _rarest(counted: DataFrame) -> DataFrame:
    """The RAREST positions of each window all of whose words occur: iid, span, p, word."""
    own = _windows(counted)
    w = Window.partitionBy("iid", "s")
    ranked = own.withColumn("least", F.min("df").over(w)).withColumn("rank", F.row_number().over(w.orderBy("df", "p")))
    return materialise(ranked.where((F.col("least") > 0) & (F.col("rank") <= RAREST)).select("iid", "span", "p", "word").distinct(), "rarest")


def _places(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Shifts at which enough marked positions of an item agree: k1, k2, iid, shift."""
    shifted = postings.join(_small(chosen), "word").select("k1", "k2", "iid", "span", (F.col("pos") - F.col("p")).alias("shift"))
    return shifted.groupBy("k1", "k2", "iid", "span", "shift").agg(F.count("*").alias("n")).where(F.col("n") >= F.least(F.col("span"), F.lit(RAREST))).drop("n", "span")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of docs: doc_id, row (a struct of all its columns), n_words, n_hit, items (ids of the items with occurring windows, sorted as
    strings), spans (array of hit word positions). Null texts have no words and no hits; items without words have no
    windows; an item id that is null is not listed, its windows count. Repeated rows are kept; an empty benchmark hits
    nothing. docs needs doc_id and text, benchmark item_id and text; what the caller drops of row is not read.
    """
    keyed, items = _keyed(docs), _items(benchmark, window)
    chosen = _rarest(_counted(keyed, items))
    return _exact(keyed, items, chosen, materialise(_postings(keyed, chosen), "postings")).drop("k1", "k2")


def _exact(keyed: DataFrame, items: DataFrame, chosen: DataFrame, index: DataFrame) -> DataFrame:
    """contaminated from the postings, with k1 and k2."""
    places = _places(index, chosen).join(_small(items), "iid")
    found = materialise(places.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "item", "span", "shift")).alias("places")), "places")
    size = found.agg(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda n, x: n + F.size(x["item"])))).first()[0] or 0
    # each explode is also a barrier: what is below it is computed once per row, not once per element
    each = keyed.join(_if_small(found, size), ["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("w"), F.explode("places").alias("x"))
    bits = F.array_join(F.transform("x.item", lambda t, p: F.when(F.get(F.col("w"), F.col("x.shift") + p) == t, "1").otherwise("0")), "")
    compared = each.select("k1", "k2", "x.item_id", "x.span", "x.shift", bits.alias("bits"))
    starts = compared.select("*", F.explode(F.sequence(F.lit(0), F.length("bits") - F.col("span"))).alias("s"))
    occurs = starts.where(F.substring(F.col("bits"), F.col("s") + 1, F.col("span")) == F.repeat(F.lit("1"), F.col("span")))
    covered = F.sequence(F.col("shift") + F.col("s"), F.col("shift") + F.col("s") + F.col("span") - 1)
    hits = occurs.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = materialise(hits, "hits")
    size = hits.agg(F.sum(F.size("spans"))).first()[0] or 0
    out = keyed.select("doc_id", "k1", "k2", "row", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(_if_small(hits, size), ["k1", "k2"], "left")
    return out.select("doc_id", "k1", "k2", "row", "n_words", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _if_small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_WORDS else df


def _sets(counted: DataFrame, terms: int) -> DataFrame:
    """The different sets of rarest words of each item's windows: sid, iid, words (rarest first)."""
    each = _windows(counted).groupBy("iid", "s").agg(F.array_sort(F.collect_set(F.struct("df", "word"))).alias("w"))
    seen = each.select("iid", F.least(F.size("w"), F.lit(terms)).alias("need"), F.filter("w", lambda x: x["df"] > 0)["word"].alias("w"))
    sets = seen.where("size(w) >= need").select("iid", F.slice("w", 1, F.col("need")).alias("words")).distinct()
    return materialise(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")


def _near(index: DataFrame, sets: DataFrame, within: int) -> DataFrame:
    """Postings of the sets' rarest words with the other words near: k1, k2, sid, x (the position), starts.

    Bit o of starts: a stretch of within words that has every word begins at x - within + 1 + o with one of them.
    """
    if not 0 < within < 63:
        raise ValueError("within must be from 1 to 62")
    first = F.lit(within - 1)
    got = index.join(_small(sets.select("sid", F.col("words")[0].alias("word"))), "word").select("k1", "k2", "sid", F.col("pos").alias("x"))
    got = materialise(got.distinct().withColumns({"fits": F.lit((1 << within) - 1).cast("long"), "begins": F.lit(1 << (within - 1)).cast("long")}), "near")
    size = sets.select("sid", F.size("words").alias("n"))
    for k in range(1, sets.agg(F.max(F.size("words"))).first()[0] or 0):
        want = sets.where(F.size("words") > k).select("sid", F.col("words")[k].alias("word"))
        bucket = lambda pos: F.floor(pos / (2 * within))
        ask = got.join(_small(want), "sid").withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("x") - first), bucket(F.col("x") + first)))))
        have = index.join(_small(want.select("word").distinct()), "word").select("k1", "k2", "word", "pos", bucket(F.col("pos")).alias("bucket"))
        met = have.join(_small(ask), ["k1", "k2", "word", "bucket"]).where(F.abs(F.col("pos") - F.col("x")) < within).withColumn("o", F.col("pos") - F.col("x") + first)
        # the stretches with the word at o begin at o - within + 1 to o
        fits = F.expr(f"(shiftleft(1L, least(o, {within - 1}) + 1) - 1) & ~(shiftleft(1L, greatest(o - {within - 1}, 0)) - 1)")
        begins = F.expr(f"if(o < {within}, shiftleft(1L, o), 0L)")
        met = met.groupBy("k1", "k2", "sid", "x", "fits", "begins").agg(F.bit_or(fits).alias("f"), F.bit_or(begins).alias("b"))
        met = met.select("k1", "k2", "sid", "x", F.expr("fits & f").alias("fits"), F.expr("begins | b").alias("begins")).where("fits <> 0")
        over = got.join(_small(size.where(F.col("n") <= k).select("sid")), "sid", "left_semi")
        got = materialise(met.unionByName(over), "near")
    return got.select("k1", "k2", "sid", "x", F.expr("fits & begins").alias("starts")).where("starts <> 0")


def proximity(docs: DataFrame, benchmark: DataFrame, within: int = WITHIN, terms: int = TERMS) -> DataFrame:
    """Near matches: (k1, k2, item_id, pos, n_terms), the places where the rarest terms of a window of the item stand in
    any order within a stretch of words; k1 is the doc_id (-1 for null), k2 the hash of its text."""
    keyed, items = _keyed(docs), _items(benchmark, WINDOW)
    sets = _sets(_counted(keyed, items), terms)
    index = materialise(_postings(keyed, sets.select(F.explode("words").alias("word"))), "postings")
    got = _near(index, sets, within).join(_small(sets), "sid").join(_small(items.select("iid", "item_id")), "iid")
    each = got.select("*", F.explode(F.sequence(F.lit(0), F.lit(within - 1))).alias("o")).where(F.expr("shiftright(starts, o) & 1") == 1)
    return each.select("k1", "k2", "item_id", (F.col("x") - within + 1 + F.col("o")).alias("pos"), F.size("words").alias("n_terms")).distinct()


def phrase_and_proximity(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contaminated, and in the same rows near (some window has a near match) and near_items (ids of the items with
    one, sorted as strings), both from one index. An item that occurs is near too."""
    keyed, items = _keyed(docs), _items(benchmark, WINDOW)
    counted = _counted(keyed, items)
    chosen, sets = _rarest(counted), _sets(counted, TERMS)
    index = materialise(_postings(keyed, chosen.select("word").unionByName(sets.select(F.explode("words").alias("word")))), "postings")
    pairs = _near(index, sets, WITHIN).select("k1", "k2", "sid").distinct().join(_small(sets.select("sid", "iid")), "sid").join(_small(items.select("iid", "item_id")), "iid")
    near = materialise(pairs.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("near_items")), "near")
    size = near.agg(F.sum(F.size("near_items") + 1)).first()[0] or 0
    out = _exact(keyed, items, chosen, index).join(_if_small(near, size), ["k1", "k2"], "left").drop("k1", "k2")
    return out.withColumns({"near": F.col("near_items").isNotNull(), "near_items": F.coalesce("near_items", F.array().cast("array<string>"))})


def _report(got: DataFrame) -> list[Column]:
    n = F.size("spans").cast("long")
    return [got["doc_id"], got["n_words"], n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated")]


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(*_report(got))


def op4_phrase_and_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_positional_index, n_near, near_sha256 and near. A query of its own, as the SQL of the other
    has the exact windows only."""
    got = phrase_and_proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(*_report(got), F.size("near_items").cast("long").alias("n_near"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"), "near")


ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, list_slice(w, s + 1, s + l) AS q FROM i, unnest(range(0, len(w) - l + 1)) t(s)),
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT uid, p, l, list_slice(w, p + 1, p + l) AS q FROM d, (SELECT DISTINCT l FROM win), unnest(range(0, greatest(0, len(w) - l + 1))) t(p)),
h AS (SELECT uid, p, l, item_id FROM dw JOIN win USING (l, q)),
n AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(range(p, p + l)) AS x FROM h) GROUP BY uid),
m AS (SELECT uid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (uid) LEFT JOIN m USING (uid)
"""
