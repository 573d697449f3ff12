"""N-gram Jaccard join by grouped prefixes.

Each document is the set of its distinct word shingles. Equal sets are one
class. Sets are ordered by one global order, and two sets that reach the
threshold share one of their first shingles (the prefix). First in the order
come shingles that are known to stand in one document only: those of a quarter
of the hash space that a filter of the repeated ones there doesn't hold. They
can't be shared, so they need no posting. Frequent shingles come last.
Classes with the same prefix and size form one group; groups that share a
prefix shingle are paired if their sizes and the shingle's places in the order
leave enough to share, and pairs are expanded to their members and verified on
the whole sets.

Only links that can join two components are looked for, so a large group of
near copies gives no square of pairs: first every member is held against one
pivot of its group and every group against its neighbour and a pivot in each
prefix shingle's list; where lists still hold many pairs of different components,
their documents are held against a few pivots of each list in some turns; then
all pairs in those lists whose members still lie in different components. A pair is verified if its parity sketches, whose Hamming
distance bounds the sets' difference from below, allow the link. Nothing is
capped: every pair of documents that is left out is already connected or can't
reach the threshold.

Postings hold a shingle, its place, an id and a size; sketches and sets are
joined to pairs only, and tables between steps are deleted after their last reader.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.bloom import filters, holds, size_for, words_in
from lectern.llm.common import checkpointed, dropped, whole_text, with_struct
from lectern.llm.graph import components
from lectern.llm.hashing import lower_ascii, shingle_set, word_hashes

#: A shingle in over one of so many documents (and in FREQUENT_LEAST) goes last in the order, so the list of such shingles is bounded by this times the mean set size.
FREQUENT_SHARE, FREQUENT_LEAST = 1000, 8
#: A batch counts a shingle for that list if so many of its documents have it, and half of FREQUENT_SHARE's part of them.
MARKED_LEAST = 3
#: Shingles of one part in so many of the hash space are counted.
COUNTED_PART = 4
#: While lists hold over so many pairs of different components for each of their rows, documents are first held against a few pivots of each list.
MANY_PAIRS, PIVOTS, TURNS = 8, 4, 2
#: 64-bit words of a document's sketch, and of the folded one that rows of lists carry.
SKETCH_WORDS, FOLDED_WORDS = 32, 4


def _sets(texts: pd.Series, k: int) -> Iterator[np.ndarray]:
    for words in word_hashes([lower_ascii(t) for t in texts]):
        yield shingle_set(words, k)


def _smaller(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches of so many rows at most, which bounds what a task holds."""
    return (batch.iloc[at : at + rows] for batch in batches for at in range(0, len(batch), rows))


def _counted(h: np.ndarray) -> np.ndarray:
    """The part of the hash space whose shingles are counted over all documents."""
    return (h >> np.uint64(40)) % np.uint64(COUNTED_PART) == 0


def shingle_order(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(filter of the counted shingles that several documents have, sorted frequent shingles).

    The first is exact for shingles it doesn't hold. The second lists shingles
    that are frequent within some batch and, by the counts of the batches that
    marked them, among all documents; any fixed list gives right results, and a
    good one short posting lists.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _smaller(batches, 4000):
            sets = list(_sets(batch["text"], k))
            found, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            frequent = n >= max(MARKED_LEAST, len(sets) // (2 * FREQUENT_SHARE))
            few, none = np.minimum(n, 2), np.zeros(len(n), np.int64)
            for part, own, marked in ((_counted(found), few, none), (frequent, none, n)):
                yield pd.DataFrame({"h": found[part].astype(np.int64), "n": own[part].astype(np.int8), "marked": marked[part].astype(np.int64)})

    total = docs.count()
    most = max(FREQUENT_LEAST, total // FREQUENT_SHARE)
    counts = docs.mapInPandas(count, "h long, n byte, marked long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("marked").alias("marked"))
    counts = checkpointed(counts.where((F.col("n") > 1) | (F.col("marked") > most)))
    (repeated,) = filters(counts.where("n > 1"), size_for(words_in(docs) // (4 * COUNTED_PART)), repeated=F.lit(True))
    rows = counts.where(F.col("marked") > most).select("h").toPandas()  # each stands in over one of FREQUENT_SHARE documents, so there are at most FREQUENT_SHARE times the mean set size
    dropped(counts)
    return repeated, np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def prefix_size(n: int, percent: int) -> int:
    """Of two sets that reach the threshold, each has a shared shingle among its first n - ceil(percent * n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 64 * SKETCH_WORDS cells: sets differ in at least as many shingles as sketches in bits."""
    bits = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The row's columns and n (shingles), set_key, group_key, skipped (shingles of the prefix that nothing else has), prefix (the others), sketch."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, k))

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        repeated, frequent = order.value
        for texts in batches:
            rows = []
            for s in _sets(texts, k):
                if not len(s):
                    rows.append((0, None, None, 0, [], []))
                    continue
                at = np.searchsorted(frequent, s)
                rare = frequent[np.minimum(at, len(frequent) - 1)] != s if len(frequent) else np.ones(len(s), bool)
                single = rare & _counted(s) & ~holds(repeated, s)
                size, alone = prefix_size(len(s), percent), int(single.sum())
                posted = np.concatenate([s[rare & ~single], s[~rare]])[: max(0, size - alone)]
                prefix = np.concatenate([s[single][:size], posted])
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                group = hashlib.blake2b(prefix.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest()
                rows.append((len(s), key, group, alone, posted.astype(np.int64), sketch(s)))
            yield pd.DataFrame(rows, columns=["n", "set_key", "group_key", "skipped", "prefix", "sketch"])

    schema = "n long, set_key binary, group_key binary, skipped int, prefix array<long>, sketch array<long>"
    return with_struct(docs, sign, schema, "text").drop("text")


def _can_reach(percent: int) -> Column:
    """Sizes na, nb of two different sets allow the threshold; of equal sizes at most all shingles but one are shared."""
    apart = (F.col("na") != F.col("nb")) | ((F.col("na") - 1) * 100 >= (F.col("na") + 1) * percent)
    return (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent) & apart


def _enough_left(percent: int) -> Column:
    """If the shingle in places ia, ib is the first that two sets share, what stands from there on suffices for the threshold."""
    return F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _folded() -> list[Column]:
    """The sketch with fewer cells, as columns f0, ...: parities of joined cells."""
    out = []
    for j in range(FOLDED_WORDS):
        word = F.col("sketch")[j]
        for k in range(j + FOLDED_WORDS, SKETCH_WORDS, FOLDED_WORDS):
            word = word.bitwiseXOR(F.col("sketch")[k])
        out.append(word.alias(f"f{j}"))
    return out


FOLDED = [f"f{j}" for j in range(FOLDED_WORDS)]


def _side(x: str, source: str = "") -> list[Column]:
    """A document of a pair, as columns named by its side: id, size, place, label, folded sketch."""
    names = {"doc_id": x, "n": f"n{x}", "place": f"i{x}", "label": f"l{x}"} | {f: f"{f}{x}" for f in FOLDED}
    return [F.col(source + c).alias(name) for c, name in names.items()]


def _folds_allow(percent: int) -> Column:
    apart = sum((F.bit_count(F.col(f"{f}a").bitwiseXOR(F.col(f"{f}b"))) for f in FOLDED), F.lit(0))
    return apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the link: difference <= (|a| + |b|) (100 - percent) / (100 + percent) whenever they reach the threshold."""
    left = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart = sum((F.bit_count(F.col("sa")[j].bitwiseXOR(F.col("sb")[j])) for j in range(SKETCH_WORDS)), F.lit(0))
    near = pairs.join(left, "a").join(right, "b").where(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    return near.select("a", "b").distinct()


def _whole_sets(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles of members (doc_id, set_key), from the texts."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _smaller(batches, 1000):
            sets = list(_sets(batch["text"], k))
            right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key for s, key in zip(sets, batch["set_key"], strict=True)]
            out = batch[["doc_id", "set_key"]].assign(shingles=[s.astype(np.int64) for s in sets])
            yield out[right]

    id_type = members.schema["doc_id"].dataType.simpleString()
    built = members.join(texts.where("doc_id is not null"), "doc_id").mapInPandas(build, f"doc_id {id_type}, set_key binary, shingles array<long>")
    return built.dropDuplicates(["doc_id", "set_key"]).select("doc_id", "shingles")  # an id may stand on several rows


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xs"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("ys"))
    shared = F.size(F.array_intersect("xs", "ys"))
    union = F.size("xs") + F.size("ys") - shared
    return pairs.join(left, "a").join(right, "b").where(shared * 100 >= union * percent).select("a", "b").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near_in_lists(listed: DataFrame, percent: int) -> DataFrame:
    """Of each shingle's list, every group with the one before it by size, and with the smallest whose size allows a link."""
    size = F.floor(F.log("n") * 1000).cast("int")
    reach = int(np.ceil(1000 * np.log(100 / percent))) + 1
    by_size = W.partitionBy("token").orderBy("size")
    other = F.struct("pivot", "n", "place")
    near = listed.withColumn("size", size).withColumns({"before": F.lag(other).over(W.partitionBy("token").orderBy("size", "pivot")), "first": F.first(other).over(by_size.rangeBetween(-reach, 0))})
    star = near.select(F.col("pivot").alias("a"), F.col("n").alias("na"), F.col("place").alias("ia"), F.explode(F.array("before", "first")).alias("o"))
    star = star.select("a", "na", "ia", F.col("o.pivot").alias("b"), F.col("o.n").alias("nb"), F.col("o.place").alias("ib"))
    return star.where(_can_reach(percent) & _enough_left(percent)).select("a", "b")


def _apart_in_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with different labels that share a list. rows: token, place, n, doc_id, label and folded sketches.

    Which sizes and places of a list go together is settled first, so that documents whose sizes and places can't link are never paired.
    """
    kinds = rows.select("token", "n", "place").distinct()
    one = kinds.select("token", F.col("n").alias("na"), F.col("place").alias("ia"))
    two = kinds.select("token", F.col("n").alias("nb"), F.col("place").alias("ib"))
    fit = one.join(two, "token").where(_can_reach(percent) & _enough_left(percent) & ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("ia") <= F.col("ib"))))
    left, right = rows.select("token", *_side("a")), rows.select("token", *_side("b"))
    both = fit.join(left, ["token", "na", "ia"]).join(right, ["token", "nb", "ib"])
    return both.where((F.col("la") != F.col("lb")) & _folds_allow(percent)).select("a", "b")


def _mixed(rows: DataFrame, by: str) -> DataFrame:
    """The values of `by` whose rows have several labels."""
    return rows.groupBy(by).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select(by)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """pivot, doc_id, n, label and folded sketch of the members of open groups, as a table."""
    found = members.select("pivot", "doc_id", "n", *_folded()).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return checkpointed(found.select("pivot", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"), *FOLDED))


def _mixed_lists(listed: DataFrame, label: DataFrame) -> DataFrame:
    """token, place, n, doc_id, label and folded sketch of the rows of lists that hold several components, as a table."""
    by_token = listed.select("token", "place", "pivot").join(label, "pivot").drop("pivot")
    return checkpointed(by_token.join(_mixed(by_token, "token"), "token"))


def _many_pairs(lists: DataFrame) -> bool:
    """Whether the lists hold many more pairs of different components than rows."""
    same = lists.groupBy("token", "label").agg(F.count("*").cast("double").alias("c"))
    per = same.groupBy("token").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    total = per.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n") - F.col("squares")).alias("pairs")).first()
    return (total["pairs"] or 0) / 2 > MANY_PAIRS * (total["rows"] or 0)


def _with_pivots(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b): each document of a list with PIVOTS documents that a hash of the ids picks there, others in each turn."""
    who = F.struct("doc_id", "n", "place", "label", *FOLDED)
    picked = lists.groupBy("token").agg(*(F.min_by(who, F.xxhash64("doc_id", F.lit(turn * PIVOTS + k))).alias(f"p{k}") for k in range(PIVOTS)))
    each = lists.join(picked.select("token", F.explode(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("p")), "token")
    each = each.select(*_side("a"), *_side("b", "p."))
    return each.where((F.col("la") != F.col("lb")) & _can_reach(percent) & _enough_left(percent) & _folds_allow(percent)).select("a", "b")


def links(docs: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows has doc_id, n_shingles, class (smallest doc_id with the same set) of each row;
    labels has node, component of the classes that link with others. Rows without an id or without words link with nothing.
    If an id stands on several rows, all their sets are that document's."""
    texts = docs.select("doc_id", whole_text().alias("text"))
    signed = checkpointed(signatures(texts, k, percent))
    known = signed.where("doc_id is not null and set_key is not null")
    parts = [F.first(c).alias(c) for c in ("n", "group_key", "skipped", "prefix", "sketch")]
    classes = checkpointed(known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *parts))
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(classes.select("set_key", F.col("doc_id").alias("class")), "set_key", "left")
    rows = checkpointed(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")))
    ids = rows.where("class is not null").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("m"), F.collect_set("class").alias("all"))
    same_id = ids.where("a <> m").select("a", F.explode("all").alias("b"))
    dropped(signed)

    # groups, and those that share a prefix shingle with others
    groups = classes.groupBy("group_key").agg(F.min("doc_id").alias("pivot"), F.first("n").alias("n"), F.first("skipped").alias("skipped"), F.first("prefix").alias("prefix"), F.count("*").alias("members"))
    groups = checkpointed(groups)
    postings = groups.select(F.posexplode("prefix").alias("at", "token"), "pivot", "n", "skipped").select("token", (F.col("at") + F.col("skipped")).alias("place"), "pivot", "n")
    several = F.count("*").over(W.partitionBy("token"))
    listed = checkpointed(postings.withColumn("several", several).where("several > 1").drop("several"))
    open_groups = listed.select("pivot").union(groups.where("members > 1").select("pivot")).distinct()
    in_group = classes.join(groups.join(open_groups, "pivot").select("group_key", "pivot"), "group_key")
    members = checkpointed(in_group.select("pivot", "doc_id", "set_key", "n", "sketch"))
    dropped(groups, classes)
    sets = checkpointed(_whole_sets(members.select("doc_id", "set_key"), texts, k))
    sketches = members.select("doc_id", "n", "sketch")

    inside = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    pairs = checkpointed(_plausible(_ordered(_near_in_lists(listed, percent).union(inside)), sketches, percent))
    edges = checkpointed(_verified(pairs, sets, percent).union(same_id))
    labels = components(edges)

    # what may still link different components
    label = _labelled(members, labels)
    lists = _mixed_lists(listed, label)
    for turn in range(TURNS):
        if not _many_pairs(lists):
            break
        near = _ordered(_with_pivots(lists, turn, percent))
        found = checkpointed(_verified(_plausible(near, sketches, percent), sets, percent))
        if found.isEmpty():
            break
        first, labels = labels, components(labels.toDF("a", "b").union(found))
        dropped(first, label, lists, found)
        label = _labelled(members, labels)
        lists = _mixed_lists(listed, label)
    split = label.join(_mixed(label, "pivot"), "pivot")
    side = lambda x: split.select("pivot", F.col("doc_id").alias(x), F.col("label").alias(f"l{x}"))
    in_groups = side("a").join(side("b"), "pivot").where("la <> lb").select("a", "b")
    rest = checkpointed(_ordered(_apart_in_lists(lists, percent).union(in_groups)))
    likely = checkpointed(_plausible(rest, sketches, percent))
    more = checkpointed(_verified(likely, sets, percent))
    if not more.isEmpty():
        first, labels = labels, components(labels.toDF("a", "b").union(more))
        dropped(first)
    dropped(listed, members, sets, pairs, edges, label, lists, rest, likely, more)
    return rows, labels


def connected(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; a row that links with nothing has its own id, one without an id null."""
    rows, labels = links(docs, k, percent)
    named = rows.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))


#: The same by counting shared shingles of all pairs, for documents whose ids don't repeat.
ORACLE = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM d),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets WHERE doc_id IS NOT NULL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE 100 * n >= 90 * (na + nb - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = sets.doc_id), doc_id)) AS component_id FROM sets"""
