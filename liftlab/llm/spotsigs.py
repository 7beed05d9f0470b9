"""SpotSigs document fingerprints: spot signatures, compared by pruned Jaccard.

A spot is an anchor word with the chain of the next CHAIN content words after it
(content words are those outside the list of common words). Anchors are the
common words; as texts in other languages have none of them, content words
whose hash is divisible by SAMPLED are anchors too. A text's signature is the sorted
set of its hashed spots, its fingerprint a digest of that set.

``near_signatures`` finds all pairs of signatures of a wanted likeness. Equal ones are one
row. Signatures fall into classes by set length and meet in their own class and
its neighbour, by the rarest spots alone (a prefix long enough that two alike sets share one
of them); pairs are dismissed by their lengths, then by the overlap that can still
follow the shared spot, and only the rest are intersected. The registered query
gives the likeness of set pairs, however small: no threshold, so nothing to prune.

DataFrame functions only. Words are runs of letters and digits, lower-cased.

Defined cases. Null text is the empty text. A text without words has the empty
signature, which is alike (1.0) to the empty one only. A text without a spot
takes every word as an anchor, and a text of one word has that word alone as its spot.
Equal texts have equal signatures. Repeated rows are neighbours of each other; rows without
doc_id come first in the order; ties of doc_id are ordered by a hash of the
text. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlab.llm.common import ranked, shuffle_partitions, stored, table

CHAIN = 2
SAMPLED = 16
#: Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or "
    "she that the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für im "
    "ist mit nach nicht sich sie sind über um und von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous ou "
    "par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos era esta este fue ha las lo los más muy no o para pero por se "
    "si sin su sus también una y ya").split()
#: Buckets of neighbouring documents per shuffle partition.
BUCKETS_PER_PARTITION = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_signature(df: DataFrame, text: str, signature: str, chain: int = CHAIN) -> DataFrame:
    """Add the sorted array of a text's spot hashes."""
    common = lambda w: w.isin(COMMON_WORDS)
    w, content, at = f"_{signature}_words", f"_{signature}_content", f"_{signature}_at"

    def spot(anchor: Column, first: Column) -> Column:
        """Hash of an anchor and the content words from place ``first``; null without any."""
        following = [F.get(F.col(content), first + k) for k in range(chain)]
        return F.when(following[0].isNotNull(), F.xxhash64(anchor, *following))

    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumns({
        content: F.filter(w, lambda x: ~common(x)),
        at: F.filter(F.transform(w, lambda x, i: F.when(common(x), i)), lambda i: i.isNotNull())})
    # The j-th common word, at place i, has i - j content words before it.
    after_common = F.transform(at, lambda i, j: spot(F.get(F.col(w), i), i - j))
    after_content = F.transform(content, lambda x, i: F.when(
        F.pmod(F.xxhash64(x), F.lit(SAMPLED)) == 0, spot(x, i + 1)))
    df = df.withColumn(signature, F.array_compact(F.concat(after_common, after_content)))
    every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, chain + 1)]))
    df = df.withColumn(signature, F.when(F.size(signature) > 0, F.col(signature)).otherwise(every))
    return df.withColumn(signature, F.array_sort(F.array_distinct(signature))).drop(w, content, at)


def fingerprint(signature: Column) -> Column:
    """Digest of a signature: equal for equal sets."""
    return F.md5(F.array_join(F.transform(signature, lambda h: F.hex(h)), " ").cast("binary"))


def length_class(size: Column, threshold: float) -> Column:
    """Sets whose likeness can reach ``threshold`` are in one class or in neighbouring classes."""
    # A size that is a power of 1 / threshold is not to fall below its class by rounding.
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + 1e-9)


def likeness(a: str, b: str, threshold: float = 0.0) -> Column:
    """Jaccard of two signature columns; 0.0 where the lengths rule ``threshold`` out."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    exact = F.when((na == 0) & (nb == 0), 1.0).otherwise(both / (na + nb - both))
    if threshold <= 0:
        return exact
    far = F.abs(length_class(na, threshold) - length_class(nb, threshold)) > 1
    short = F.least(na, nb) < threshold * F.greatest(na, nb)
    return F.when(far | short, 0.0).otherwise(F.when(exact >= threshold, exact).otherwise(0.0))


def near_signatures(signatures: DataFrame, threshold: float) -> DataFrame:
    """(signature) -> (fingerprint, other, likeness): pairs of distinct sets, each once.

    ``threshold`` is above 0 and below 1. Documents of one fingerprint are alike
    (1.0) and not listed; join them by fingerprint. The empty set is like no other.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    sets = signatures.select(fingerprint(F.col("signature")).alias("id"), "signature").where(F.size("signature") > 0)
    sets = stored(sets.groupBy("id").agg(F.first("signature").alias("signature")), "spot-sets")
    spots = sets.select("id", F.size("signature").alias("n"), F.explode("signature").alias("spot"))
    often = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("often"))
    rare_first = F.sort_array(F.collect_list(F.struct("often", "spot")))
    # Two sets of at least this likeness share a spot among the first n - ceil(t * n) + 1 of each.
    first = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    prefix = (spots.join(often, "spot").groupBy("id", "n").agg(rare_first.alias("all"))
              .select("id", "n", F.posexplode(F.slice("all", F.lit(1), first)).alias("at", "s")))
    prefix = stored(prefix.select("id", "n", "at", "s.spot", length_class(F.col("n"), threshold).alias("class")),
                    "spot-prefixes")
    small = prefix.select(*[F.col(c).alias(f"_{c}") for c in ("id", "n", "at", "spot")],
                          F.explode(F.array("class", F.col("class") + 1)).alias("_class"))
    met = small.join(prefix, (F.col("_spot") == F.col("spot")) & (F.col("_class") == F.col("class")))
    in_order = (F.col("_n") < F.col("n")) | ((F.col("_n") == F.col("n")) & (F.col("_id") < F.col("id")))
    most = (F.least("_at", "at") + F.least(F.col("_n") - F.col("_at"), F.col("n") - F.col("at")))
    need = (F.col("_n") + F.col("n")) * (threshold / (1 + threshold)) - 1e-9
    met = met.where(in_order & (F.col("_n") >= F.col("n") * threshold - 1e-9) & (most >= need))
    pairs = met.select("_id", "id").distinct()
    one = sets.select(F.col("id").alias("_id"), F.col("signature").alias("_signature"))
    return (pairs.join(one, "_id").join(sets, "id")
            .withColumn("likeness", likeness("_signature", "signature", threshold)).where(F.col("likeness") > 0)
            .select(F.least("_id", "id").alias("fingerprint"), F.greatest("_id", "id").alias("other"), "likeness"))


def with_next(docs: DataFrame, buckets_per_partition: int = BUCKETS_PER_PARTITION) -> DataFrame:
    """(doc_id, text, signature) plus next_text and next_signature of the following document.

    The order is (doc_id, hash of the text); after the last comes the first. A narrow
    sort finds the first key of every bucket of neighbouring documents; the texts then
    move once, to their bucket, and each bucket's first document also goes to the end
    of the bucket before. The keys that reach the driver are as many as buckets.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_hash", F.xxhash64("text"))
    keys = stored(base.select("doc_id", "_hash").distinct(), "spot-keys")
    total, n = keys.count(), shuffle_partitions(spark) * buckets_per_partition
    step = max(1, -(-total // n))
    heads = ranked(keys, ["doc_id", "_hash"], "spot-order", "_number").where(
        F.col("_number") % step == 0).orderBy("_number").collect()
    key = F.struct("doc_id", "_hash")
    # One literal, however many heads: the plan holds no expression per head.
    heads = F.from_json(F.lit(json.dumps([{"doc_id": r["doc_id"], "_hash": r["_hash"]} for r in heads])),
                        "array<struct<doc_id: bigint, _hash: bigint>>")
    count = -(-total // step)
    steps = [1 << i for i in range(max(count, 1).bit_length() - 1, -1, -1)]
    # Binary search for the last head that is not above the key.
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(-1), lambda pos, s: pos + F.when(
        (pos + s < count) & (F.get(F.col("_heads"), pos + s) <= F.col("_key")), s).otherwise(0))
    rows = base.withColumns({"_heads": heads, "_key": key}).withColumn("_bucket", bucket)
    is_head = F.get(F.col("_heads"), F.col("_bucket")) == F.col("_key")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(max(count, 1))).alias("bucket"),
                      F.lit(True).alias("guest"))
    rows = rows.select("doc_id", "text", "_hash",
                       F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own))).alias("_to"))
    rows = rows.select("doc_id", "text", "_hash", "_to.bucket", "_to.guest").repartition(
        shuffle_partitions(spark), "bucket")
    rows = with_signature(rows, "text", "signature")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "_hash")
    return (rows.withColumns({"next_text": F.lead("text").over(order),
                              "next_signature": F.lead("signature").over(order)})
            .where(~F.col("guest")).drop("guest", "bucket", "_hash"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    docs = docs.withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half),
                      F.substring("next_text", F.lit(1), half))
    docs = with_signature(docs.withColumn("edited", edited).drop("text", "next_text"), "edited", "edited_signature")
    return docs.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
        F.size("signature").cast("long").alias("n_spots"))
