"""Operator 3, line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A text's lines are its \\n-split parts; a line's words are its runs without ASCII white space, and two lines are
equal if their words are. The earliest line (smallest doc_id, then place) stays. A later line goes if it equals
an earlier one (from MIN_WORDS words on), or if an earlier one is within one edit of it: one word put in, left
out or changed (from NEAR_WORDS words on; shorter lines are too easily near by chance).

1. Lines of equal words are one distinct line, with its earliest place.
2. Only distinct lines that can have a near one go on. An edit leaves the first k words or the last k words as
   they are, so both lines share the hash of a head or tail of k words, k the power of two below half the length.
3. Those emit their deletion neighbourhood as hashed keys: the line with a gap in place of each word, and with a
   gap between any two. Lines of one key are within one edit of each other, all of them; hence each is joined
   with the key's earliest line alone, and a key that thousands of lines share makes thousands of rows, not
   millions. A key is a hash of the gap's place, the length, and two sums: of the words before the gap, each
   hashed with its place from the start, and of those after it, each with its place from the end. So texts of
   other words or of another order share no key, and a line of n words takes n log n steps for all its keys.
4. Each joined pair's edit distance is verified on the words.

Cases: a null text stays null; lines without words always stay. Rows
with a null doc_id come last in the order. Repeated rows (one doc_id, one text) are one document: they keep the
same lines. An empty table gives an empty result. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import sent, written

MIN_WORDS, NEAR_WORDS = 1, 5
#: A line is hot if it is more than this part of all lines.
HOT_LINES = 10_000

_FIRST, _LAST = 11, 13  # seeds of hashes with a place from the start and from the end


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def _key(df_text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(df_text), F.lit("")), F.col(df_text).isNull())


def _lines(documents: DataFrame, least: int) -> DataFrame:
    """doc_id, doc_key, line_no, words, line (128 bits of hashes of the words) of each line with least words or more."""
    rows = documents.select("doc_id", _key().alias("doc_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "_line"))
    rows = rows.select("doc_id", "doc_key", "line_no", _words(F.col("_line")).alias("words")).where(F.size("words") >= least)
    return rows.select("*", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(_FIRST), F.col("words")).alias("h2"))


def _parts(n: Column, words: Column, near: int) -> Column:
    """Hashes of the line's heads and tails of k words, for its own k and that of a line one word shorter."""
    power = lambda x: F.pow(F.lit(2), F.length(F.bin(F.floor(x / 2))) - 1).cast("int")
    found = []
    for k in (power(n), power(n - 1)):
        found += [F.struct(F.xxhash64(F.lit(0), k, F.slice(words, F.lit(1), k)).alias("part"), k.alias("head"), F.lit(0).alias("tail")), F.struct(F.xxhash64(F.lit(1), k, F.slice(words, n - k + 1, k)).alias("part"), F.lit(0).alias("head"), k.alias("tail"))]
    return F.when(n >= near, F.array_distinct(F.array(*found)))


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """key, node: the keys of each line's gapped forms; lines: node, words, head, tail.

    A line whose head of that many words is shared can have an edit after it, one whose tail is shared before it.
    """
    hashed = lines.select("node", "head", "tail", F.size("words").alias("n"), F.transform("words", lambda w, i: F.xxhash64(F.lit(_FIRST), i, w)).alias("a"), F.transform(F.reverse("words"), lambda w, i: F.xxhash64(F.lit(_LAST), i, w)).alias("b"))
    none = F.array(F.lit(0).cast("long"))
    both = hashed.select("node", "head", "tail", "n", F.concat(none, _scan("a")).alias("a"), F.reverse(F.concat(none, _scan("b"))).alias("b"))
    n = F.col("n")
    changed, added = F.arrays_zip(F.slice("a", F.lit(1), n).alias("a"), F.slice("b", F.lit(2), n).alias("b")), F.arrays_zip("a", "b")
    able = ((F.col("head") > 0) & (F.col("at") >= F.col("head"))) | ((F.col("tail") > 0) & (F.col("at") < n - F.col("tail") + F.col("more")))
    one = both.select("node", "head", "tail", "n", F.lit(0).alias("more"), F.posexplode(changed).alias("at", "x")).where(able)
    two = both.select("node", "head", "tail", "n", F.lit(1).alias("more"), F.posexplode(added).alias("at", "x")).where(able)
    key = F.xxhash64(n + F.col("more"), "at", "x.a", "x.b").alias("key")
    return one.select(key, "node").union(two.select(key, "node"))


def _scan(column: str) -> Column:
    """The exclusive or of each number of an array and all before it, in steps of 1, 2, 4 and so on."""
    n = F.size(column)

    def step(x: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(x, F.concat(F.array_repeat(F.lit(0).cast("long"), by), F.slice(x, F.lit(1), n - by)), lambda u, v: u.bitwiseXOR(v))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1), F.col(column), step)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one edit."""

    def left_out(short: Column, long: Column) -> Column:
        n = F.size(short)
        differ = F.array_position(F.zip_with(short, F.slice(long, F.lit(1), n), lambda x, y: x != y), True)
        at = F.when(differ > 0, differ).otherwise(n + 1).cast("int")
        return F.slice(short, at, n) == F.slice(long, at + 1, n)

    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) <= 1
    return F.when(F.size(a) == F.size(b), changed).when(F.size(a) + 1 == F.size(b), left_out(a, b)).when(F.size(a) == F.size(b) + 1, left_out(b, a)).otherwise(False)


def dropped_lines(documents: DataFrame, least: int = MIN_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """doc_id, doc_key, line_no, near, of: the lines to drop of documents (doc_id, text), and the place of the earlier line."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    marks = written(_lines(documents, least).select("doc_id", "doc_key", "line_no", "h1", "h2", _parts(F.size("words"), F.col("words"), near).alias("parts")))
    earliest = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "line_no", "doc_key")).alias("place")
    distinct = written(marks.groupBy("h1", "h2").agg(earliest, F.count(F.lit(1)).alias("times")))

    # lines with a head or a tail in common with another line, and how long these are
    parts = marks.select("h1", "h2", F.explode("parts").alias("p")).select("h1", "h2", "p.part", "p.head", "p.tail")
    shared = parts.groupBy("part").agg(F.min("h1").alias("_a"), F.max("h1").alias("_b")).where("_a <> _b").select("part")
    able = parts.join(shared, "part", "left_semi").groupBy("h1", "h2").agg(F.min(F.when(F.col("head") > 0, F.col("head"))).alias("head"), F.min(F.when(F.col("tail") > 0, F.col("tail"))).alias("tail"))
    able = able.join(distinct, ["h1", "h2"]).select("h1", "h2", "place", F.coalesce("head", F.lit(0)).alias("head"), F.coalesce("tail", F.lit(0)).alias("tail"))
    # numbered in the order of their places
    able = written(able.repartitionByRange("place").sortWithinPartitions("place").withColumn("node", F.monotonically_increasing_id()))
    homes = able.groupBy(F.col("place.doc_id").alias("_d"), F.col("place.doc_key").alias("_k")).agg(F.collect_list(F.struct(F.col("place.line_no").alias("line_no"), "node", "head", "tail")).alias("wanted"))
    texts = documents.select("doc_id", _key().alias("doc_key"), "text")
    at_home = texts.join(sent(homes), texts.doc_id.eqNullSafe(F.col("_d")) & (F.col("doc_key") == F.col("_k")))
    asked = at_home.select(F.split("text", "\n").alias("split"), F.explode("wanted").alias("w")).select("w.node", "w.head", "w.tail", _words(F.element_at("split", F.col("w.line_no") + 1)).alias("words"))
    able_words = written(asked.dropDuplicates(["node"]))

    keys = written(_neighbourhood(able_words))
    leads = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("_last")).where("lead <> _last").select("key", "lead")
    pairs = keys.join(leads, "key").where("node <> lead").select("node", "lead").distinct()
    one, two = able_words.select("node", F.col("words").alias("_a")), able_words.select(F.col("node").alias("lead"), F.col("words").alias("_b"))
    verified = pairs.join(one, "node").join(two, "lead").where(_one_edit(F.col("_a"), F.col("_b"))).groupBy("node").agg(F.min("lead").alias("lead"))
    places = able.select(F.col("node").alias("lead"), F.col("place").alias("earlier"))
    verified = verified.join(able.select("node", "h1", "h2"), "node").join(places, "lead").select("h1", "h2", "earlier")

    verdicts = distinct.join(verified, ["h1", "h2"], "left").where("times > 1 or earlier is not null").select("h1", "h2", "place", "earlier", "times")
    places = marks.drop("parts")
    # at most HOT_LINES lines can have that many copies; their copies aren't gathered
    many = max(1000, places.count() // HOT_LINES)
    hot = F.broadcast(verdicts.where(F.col("times") > many))
    cold = places.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(verdicts.where(F.col("times") <= many), ["h1", "h2"])
    gone = places.join(hot, ["h1", "h2"]).unionByName(cold)
    here = ~F.col("place.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("place.line_no") != F.col("line_no"))
    gone = gone.where(F.col("earlier").isNotNull() | here)
    return gone.select("doc_id", "doc_key", "line_no", F.col("earlier").isNotNull().alias("near"), F.coalesce("earlier", "place").alias("of"))


def deduped(documents: DataFrame, least: int = MIN_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """row (documents' own columns, with the later copies of lines taken out of text), n_lines, n_exact, n_near: counts of lines."""
    by_document = sent(dropped_lines(documents, least, near).groupBy(F.col("doc_id").alias("of_id"), F.col("doc_key").alias("of_key")).agg(
        F.array_sort(F.collect_set("line_no")).alias("gone"), F.count_distinct(F.when(~F.col("near"), F.col("line_no"))).alias("n_exact"), F.count_distinct(F.when(F.col("near"), F.col("line_no"))).alias("n_near")
    ))
    # the other columns travel in a struct, so that none can clash
    held = documents.select(F.struct(*documents.columns).alias("held"), F.col("doc_id").cast("long").alias("mine"), _key().alias("my_key"))
    both = held.join(by_document, F.col("mine").eqNullSafe(F.col("of_id")) & (F.col("my_key") == F.col("of_key")), "left").withColumn("split", F.split("held.text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("held.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("split", i + 1)), "\n"))
    row = F.struct(*[text.alias(c) if c == "text" else F.col("held").getField(c).alias(c) for c in documents.columns])
    return both.select(row.alias("row"), F.size("split").alias("n_lines"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """documents with the later copies of lines taken out of text; its columns and no others."""
    return deduped(documents).select("row.*")
