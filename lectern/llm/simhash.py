"""SimHash fingerprints with permuted block tables, by DataFrame functions alone.

The terms of a text are its runs of five words, letters in lower case (all its
words, if it has fewer). Each term's 128-bit hash votes on the signed bits as
often as the term stands in the text: that is its weight. Votes for two bits
share one long: bit k in the lower half, bit k + 32 in the upper, so 64 sums
make a fingerprint of 128 bits.

Two fingerprints within a Hamming radius r agree on one of r + 1 blocks of bits
at least; a table for each block, with that block moved to the front, finds all
of them by an equi-join. Blocks that many fingerprints share are joined on a
second block of the rest as well, so a hot block doesn't give all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, checkpointed, dropped, whole_text

HALVES = 0x0000000100000001
BITS = 128
WORDS = 5
#: Fingerprints at most so many bits apart count as near.
RADIUS = 3
#: Ids are put in order in blocks of about so many.
BLOCK_DOCS = 65_536
#: Blocks of bits that over so many fingerprints share are joined on a second block too.
HOT_BLOCK = 200


def terms(text: Column) -> Column:
    """A hash for each run of WORDS words; of all words, if there are fewer; none without words."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        short = F.filter(F.array(F.xxhash64(h)), lambda _: F.size(h) > 0)
        return F.when(F.size(h) < WORDS, short).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (WORDS - 1))), lambda i: F.xxhash64(F.slice(h, i, WORDS))))

    # one element, so that the words are hashed once and not for each use
    return F.flatten(F.transform(F.array(hashes), runs))


def _votes(term: Column) -> list[Column]:
    out = []
    for half, seeded in enumerate((term, F.xxhash64(F.lit(2), term))):
        for k in range(32):
            out.append(F.sum(F.shiftrightunsigned(seeded, k).bitwiseAND(F.lit(HALVES))).alias(f"v{32 * half + k}"))
    return [*out, F.count(term).alias("weight")]


def _signed(half: int) -> Column:
    """64 bits of a fingerprint: those that got over half of the weight."""
    word = F.lit(0).cast("long")
    for k in range(32):
        v, total = F.coalesce(F.col(f"v{32 * half + k}"), F.lit(0)), F.coalesce("weight", F.lit(0))
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
        word = word + F.when(2 * low > total, F.lit(1 << k).cast("long")).otherwise(0)
        word = word.bitwiseOR(F.when(2 * high > total, F.expr(f"shiftleft(1L, {k + 32})")).otherwise(F.lit(0).cast("long")))
    return F.when(F.col("weight") > 0, word).otherwise(F.lit(0).cast("long"))


def spelled(print_: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(print_["hi"]), 16, "0"), F.lpad(F.hex(print_["lo"]), 16, "0")))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two structs (hi, lo) differ."""
    return F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, print struct<hi, lo> of (keys, text). One row of texts for each value of keys; the aggregation runs where these rows are if they are partitioned by some of the keys."""
    voted = texts.select(*keys, F.explode_outer(terms(F.col("text"))).alias("term")).groupBy(*keys).agg(*_votes(F.col("term")))
    return voted.select(*keys, F.struct(_signed(1).alias("hi"), _signed(0).alias("lo")).alias("print"))


def ring(rows: DataFrame) -> DataFrame:
    """doc_id, key, n_chars, copies, and the next (next_id, next_key) and the one before (prior_id, prior_key, prior_chars) of rows (doc_id, key, n_chars).

    Rows with one id follow each other by their key; after the last comes the
    first. Only ids and digests are put in order: blocks of about equal numbers
    of rows, whatever the ids are; within a block a window finds the
    neighbours, and between blocks a row for each block does.
    """
    own = rows.groupBy("doc_id", "key").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    blocks = max(1, rows.count() // BLOCK_DOCS)
    dealt = checkpointed(own.repartitionByRange(blocks, "doc_id", "key").withColumn("block", F.spark_partition_id()))
    who = F.struct("doc_id", "key", "n_chars")
    ends = dealt.groupBy("block").agg(F.min(who).alias("first"), F.max(who).alias("last"))
    each = Window.partitionBy(F.lit(0)).orderBy("block")  # a row for each block
    around = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "block",
        F.coalesce(F.lead("first").over(each), F.first("first").over(around)).alias("after"),
        F.coalesce(F.lag("last").over(each), F.last("last").over(around)).alias("ahead"),
    )
    inside = Window.partitionBy("block").orderBy("doc_id", "key")
    placed = dealt.withColumns({"next": F.lead(who).over(inside), "prior": F.lag(who).over(inside)}).join(ends, "block")
    placed = placed.withColumns({"next": F.coalesce("next", "after"), "prior": F.coalesce("prior", "ahead")})
    placed = placed.select(
        "doc_id", "key", "n_chars", "copies", F.col("next.doc_id").alias("next_id"), F.col("next.key").alias("next_key"),
        F.col("prior.doc_id").alias("prior_id"), F.col("prior.key").alias("prior_key"), F.col("prior.n_chars").alias("prior_chars"),
    )
    order = checkpointed(placed)
    dropped(dealt)
    return order


def _quarter(n: Column) -> Column:
    return F.floor(n / 4).cast("int")


def _edited(ahead: Column) -> Column:
    return F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), ahead)


def edited(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of each row.

    The edited text has its last quarter replaced by the start of the next
    document. n_near: of documents whose id is divisible by 20, how many other
    rows have a fingerprint within the radius; null of the others. Null text
    counts as empty. Rows with one id follow each other by a digest of their
    text, and each of several equal rows but the last has the text itself as its
    next. A row without an id has no next document: its edited text is its own,
    and near_next is null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumns({"key": F.unhex(F.md5("text")), "n_chars": F.length("text").cast("long")})
    named = rows.where("doc_id is not null")
    order = ring(named.select("doc_id", "key", "n_chars"))
    own = named.select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"])
    starts = own.join(order.select("doc_id", "key", "prior_id", "prior_key", "prior_chars"), ["doc_id", "key"])
    starts = starts.select(F.col("prior_id").alias("doc_id"), F.col("prior_key").alias("key"), F.substring("text", F.lit(1), _quarter(F.col("prior_chars"))).alias("ahead"))
    whole = own.join(order.select("doc_id", "key", "n_chars", "copies", "next_id", "next_key"), ["doc_id", "key"]).join(starts, ["doc_id", "key"])
    side = lambda k, text, digest: F.struct(F.lit(k).alias("side"), text.alias("text"), digest.alias("sha"))
    none = F.lit(None).cast("string")
    last, again = _edited(F.col("ahead")), _edited(F.substring("text", F.lit(1), _quarter(F.col("n_chars"))))
    sides = F.array(side(0, F.col("text"), none), side(1, last, F.sha2(last, 256)), F.when(F.col("copies") > 1, side(2, again, F.sha2(again, 256))))
    keys = ["doc_id", "key", "n_chars", "copies", "next_id", "next_key", "side", "sha"]
    texts = whole.select(*keys[:-2], F.explode(F.array_compact(sides)).alias("s")).select(*keys[:-2], F.col("s.side").alias("side"), F.col("s.sha").alias("sha"), F.col("s.text").alias("text"))
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    wide = {"a": (0, "print"), "e": (1, "print"), "i": (2, "print"), "sha_e": (1, "sha"), "sha_i": (2, "sha")}
    prints = fingerprints(texts, keys).groupBy(*keys[:-2]).agg(*(of(k, c).alias(name) for name, (k, c) in wide.items()))
    prints = checkpointed(prints)

    after = prints.select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), F.col("a").alias("b"))
    each = prints.join(after, ["next_id", "next_key"])
    cases = lambda own, sha, next_: F.struct(own.alias("e"), sha.alias("sha"), next_.alias("b"))
    repeated = F.transform(F.filter(F.sequence(F.lit(1), F.col("copies")), lambda c: c > 1), lambda _: cases(F.col("i"), F.col("sha_i"), F.col("a")))
    each = each.select("doc_id", "n_chars", "a", F.explode(F.concat(F.array(cases(F.col("e"), F.col("sha_e"), F.col("b"))), repeated)).alias("c")).select("doc_id", "n_chars", "a", "c.*")

    nameless = rows.where("doc_id is null").groupBy("key").agg(F.first("text").alias("text"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    nameless = nameless.withColumn("sha", F.sha2("text", 256))
    alone = fingerprints(nameless, ["key", "n_chars", "copies", "sha"]).select(
        F.lit(None).cast("long").alias("doc_id"), "n_chars", F.col("print").alias("a"), F.col("print").alias("e"), "sha", F.lit(None).cast(each.schema["b"].dataType).alias("b"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    )
    every = checkpointed(each.unionByName(alone.drop("copy")).withColumn("fingerprint", spelled(F.col("a"))))
    dropped(order, prints)
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    counts = near_counts(every.where(asked).select("fingerprint"), every.select("fingerprint"), radius)
    found = every.join(counts, "fingerprint", "left")
    return found.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", spelled(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"), F.when(asked, F.col("near") - 1).alias("n_near"),
    )


def _blocks(n: int) -> list[tuple[int, int]]:
    """n blocks of bits as (first bit, bits)."""
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _tables(prints: DataFrame, radius: int) -> DataFrame:
    """A row for each distinct fingerprint and table: t, key (the block moved to the front), rest (the other bits)."""
    bits = F.concat(*(F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(4)))
    own = prints.where("fingerprint is not null").select("fingerprint").distinct().withColumn("bits", bits)
    block = lambda t, f, n: F.struct(F.lit(t).alias("t"), F.substring("bits", f + 1, n).alias("key"), F.concat(F.substring("bits", 1, f), F.substring("bits", f + n + 1, BITS)).alias("rest"))
    tables = F.array(*(block(t, f, n) for t, (f, n) in enumerate(_blocks(radius + 1))))
    return own.select("fingerprint", F.explode(tables).alias("x")).select("fingerprint", "x.*")


def near_pairs(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """a, b, apart: each fingerprint (hex strings) of queries with every one of prints at most radius bits apart, itself too if it is there."""
    left, right = _tables(queries, radius), _tables(prints, radius)
    listed = right.groupBy("t", "key").agg(F.count("*").alias("count"))
    width = BITS - BITS // (radius + 1) - 1
    step = max(1, width // (radius + 1))
    second = F.array(*(F.struct(F.lit(u).alias("u"), F.substring("rest", 1 + u * step, step).alias("deep")) for u in range(radius + 1)))
    none = F.array(F.struct(F.lit(-1).alias("u"), F.lit("").alias("deep")))
    deeper = F.explode(F.when(F.col("count") > HOT_BLOCK, second).otherwise(none)).alias("y")
    keyed = lambda side, name: side.join(listed, ["t", "key"]).select(F.col("fingerprint").alias(name), "t", "key", deeper).select(name, "t", "key", "y.*")
    word = lambda c, k: F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("long")
    apart = sum((F.bit_count(word(F.col("a"), k).bitwiseXOR(word(F.col("b"), k))) for k in range(4)), F.lit(0))
    pairs = keyed(left, "a").join(keyed(right, "b"), ["t", "key", "u", "deep"])
    return pairs.withColumn("apart", apart).where(F.col("apart") <= radius).select("a", "b", "apart").distinct()


def within_radius(prints: DataFrame, radius: int) -> DataFrame:
    """a, b, apart: all pairs a < b of distinct fingerprints (hex strings) at most radius bits apart. prints: fingerprint."""
    return near_pairs(prints, prints, radius).where("a < b")


def near_counts(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """fingerprint, near: how many rows of prints lie within the radius of each distinct fingerprint of queries."""
    rows = prints.groupBy(F.col("fingerprint").alias("b")).agg(F.count("*").alias("rows"))
    return near_pairs(queries, prints, radius).join(rows, "b").groupBy(F.col("a").alias("fingerprint")).agg(F.sum("rows").alias("near"))
