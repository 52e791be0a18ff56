"""Benchmark decontamination: prefix-filtered set join of documents with item-sized windows, in JVM functions alone.

A window is so many consecutive words of an item, or the whole of a shorter one. As a set of its shingles (SHINGLE words
each, or the window's own words if it has fewer) it must lie in the document whole, so one shingle, the rarest, is a
sufficient prefix: shingles are ordered by their number of occurrences in all documents, and only documents with a window's rarest one can hold
it. Neighbouring windows mostly share their rarest shingle, so they are kept together: an anchor is a shingle at a place
of an item with the range of windows whose rarest it is, and the words of these windows. Where an anchor's shingle stands in a document,
bounds on length and place come first: some of the windows must begin at the document's start or later and end within it. Then the
words to the left and right of it are compared with the item's, which tells exactly which windows lie there.

Two passes over the documents, one for the counts, one for the join. Both look shingles up in a broadcast table while
it has at most BROADCAST_ROWS rows. Beyond that, hashes, row numbers and places are joined by shuffle, and documents with a
common shingle are read again for the comparison. Hashes never decide: the anchor's words are compared too.

Edge cases: null or empty texts have no words: such a document is clean, such an item has no window. A null item id
counts as the empty text. Equal item ids are named and counted once. Items of equal words are one class, which is joined
once. Repeated documents need nothing, each row is judged alone. Empty tables give no rows, or all documents clean.
Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, with_rid, written

WINDOW, SHINGLE = 10, 3
#: Rows of the largest table of shingles or anchors that is broadcast (some 300 bytes each).
BROADCAST_ROWS = 200_000
# Words of the contract.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    c = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))


def key_of(words: str, at: Column, size: int) -> Column:
    """Hash of the shingle of so many words from the place on."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def classes_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """A row for each word sequence of items: class, words, size of its windows and of their shingles, item ids."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = items.select(name.alias("item"), words_of(text_col).alias("item_words")).where(F.size("item_words") > 0)
    rows = rows.groupBy("item_words").agg(F.collect_set("item").alias("items")).withColumn("class", F.monotonically_increasing_id())
    size = F.least(F.lit(window), F.size("item_words"))
    return written(rows.withColumns({"window": size, "width": F.least(F.lit(SHINGLE), size)}), "classes")


def shingles_of(classes: DataFrame, widths: list[int]) -> DataFrame:
    """class, place (from 0) and key of every shingle of the items."""
    place = F.posexplode("item_words").alias("place", "word")
    rows = classes.select("class", "item_words", "width", place).where("place + width <= size(item_words)")
    key = reduce(lambda c, w: c.when(F.col("width") == w, key_of("item_words", F.col("place"), w)), widths, F)
    return rows.select("class", "place", key.alias("key"))


def places_of(docs: DataFrame, widths: list[int]) -> DataFrame:
    """A row for every word of the documents, and for each width: place and key, which is null for shingles beyond the end.

    A document without words has one row, without a place.
    """
    rows = docs.select("*", F.posexplode_outer("words").alias("place", "word")).drop("word")
    keys = [F.when(F.col("place") + w <= F.col("n_words"), key_of("words", F.col("place"), w)) for w in widths]
    return rows.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))


def anchors_of(classes: DataFrame, shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """key, class, width, window, the item's words that its windows cover, place of the anchor in these, and windows less one."""
    ranked = shingles.join(counts, "key", "left").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("place", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place").alias("rank")))).alias("all"))
    rows = classes.join(ranked, "class")
    inside = F.col("window") - F.col("width") + 1
    rarest = F.transform(F.sequence(F.lit(1), F.size("item_words") - F.col("window") + 1), lambda s: F.array_min(F.slice(F.col("all.rank"), s, inside)))
    rows = rows.select("class", "item_words", "width", "window", F.posexplode(rarest).alias("start", "rank"))
    rows = rows.groupBy("class", "width", "window", F.col("rank.key").alias("key"), F.col("rank.place").alias("at")).agg(F.min("start").alias("low"), F.max("start").alias("high"), F.first("item_words").alias("item_words"))
    part = F.slice("item_words", F.col("low") + 1, F.col("high") - F.col("low") + F.col("window"))
    return rows.select("key", "class", "width", "window", part.alias("part"), (F.col("at") - F.col("low")).alias("at"), (F.col("high") - F.col("low")).alias("more"))


def agreeing(ours: Column, theirs: Column) -> Column:
    """How many words of theirs, from the first on, ours has too."""
    apart = F.array_position(F.zip_with(ours, theirs, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(apart == 0, F.size(theirs)).otherwise(apart.cast("int") - 1)


def compared(rows: DataFrame) -> DataFrame:
    """rows (a document's words and a place, with an anchor) with span: the words that windows cover there, null for none."""
    place, at, window, width, more = map(F.col, ("place", "at", "window", "width", "more"))
    bounds = (place - at + more >= 0) & (place - at + window <= F.col("n_words"))
    back = F.least(at, place)
    same = F.slice("words", place + 1, width) == F.slice("part", at + 1, width)
    left = agreeing(F.reverse(F.slice("words", place - back + 1, back)), F.reverse(F.slice("part", F.lit(1), at)))
    beyond = F.size("part") - at - width
    right = agreeing(F.slice("words", place + width + 1, beyond), F.slice("part", at + width + 1, beyond))
    rows = rows.withColumns({"left": F.when(bounds & same, left), "right": F.when(bounds & same, right)})
    rows = rows.withColumns({"low": F.greatest(F.lit(0), at - F.col("left")), "high": F.least(more, at + width + F.col("right") - window)})
    span = F.struct((place - at + F.col("low")).alias("low"), (place - at + F.col("high") + window).alias("high"))
    return rows.withColumn("span", F.when(F.col("left").isNotNull() & (F.col("low") <= F.col("high")), span))


def covered() -> Column:
    """Words that the spans of a row cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["high"] - F.greatest(s["low"], a["end"]))).alias("n"), F.greatest(a["end"], s["high"]).alias("end"))
    return F.aggregate(F.sort_array("spans"), zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Words, hit words and items found in each document."""
    classes = classes_of(items, item_col, item_text, window)
    widths = sorted(r["width"] for r in classes.select("width").distinct().collect()) or [1]  # SHINGLE numbers at most
    shingles = shingles_of(classes, widths)
    few = shingles.count() <= broadcast_rows
    near = F.broadcast if few else lambda df: df
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()) if few else with_rid(rows, "rid")
    texts = rows.select("rid", "id", words_of("text").alias("words")).withColumn("n_words", F.size("words"))
    counts = places_of(texts.select("words", "n_words"), widths).select("key").join(near(shingles.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("n"))
    anchors = written(anchors_of(classes, shingles, counts), "anchors")
    places = places_of(texts, widths)
    if few:
        first = F.coalesce("place", F.lit(0)) == 0  # stays without an anchor, so that each document has a row
        met = places.join(near(anchors), "key", "left").where(F.col("class").isNotNull() | first)
    else:
        hit = places.select("rid", "place", "key").join(anchors.select("key").distinct(), "key", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("place", "key")).alias("hits"))
        met = texts.join(hit, "rid", "left").select("*", F.inline_outer("hits")).drop("hits").join(anchors, "key", "left")
    found = compared(met).groupBy("rid", "id", "n_words")
    found = found.agg(F.collect_set("span").alias("spans"), F.sort_array(F.collect_set(F.when(F.col("span").isNotNull(), F.col("class")))).alias("found"))
    found = written(found.select("id", "n_words", "found", F.when(F.size("spans") > 0, covered()).otherwise(0).alias("n_hit")), "found")
    sets = found.where("n_hit > 0").select("found").distinct().select("found", F.explode("found").alias("class")).join(classes.select("class", "items"), "class")
    sets = sets.groupBy("found").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("names"))
    sets = sets.select("found", F.size("names").alias("n"), F.sha2(F.concat_ws(",", "names"), 256).alias("sha"))
    dirty = found.where("n_hit > 0").join(sets, "found").select("id", "n_words", "n_hit", "n", "sha")
    clean = found.where("n_hit = 0").select("id", "n_words", "n_hit", F.lit(0).alias("n"), F.sha2(F.lit(""), 256).alias("sha"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return dirty.union(clean).select(F.col("id").alias(id_col), long("n_words", "n_words"), long("n_hit", "n_hit"), long("n", "n_items"), F.col("sha").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS}') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS}') AS w FROM benchmark),
own AS (SELECT DISTINCT item, l, array_to_string(w[s:s + l - 1], ' ') AS g FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM (SELECT *, least({WINDOW}, len(w)) AS l FROM i WHERE len(w) > 0))),
doc AS (SELECT r, p, l, array_to_string(w[p:p + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM own) WHERE len(w) >= l)),
hit AS MATERIALIZED (SELECT DISTINCT r, item, p, l FROM doc JOIN own USING (l, g)),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + l)) AS q FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, cov.n IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN named USING (r)
"""
