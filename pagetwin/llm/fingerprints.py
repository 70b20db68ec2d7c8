"""Canonical exact fingerprints with DataFrame functions only.

Canonical form: NFKC, full case folding, NFKC again, runs of white space as one space, trimmed. The
digest is 128 bits of xxhash64. Inside every bucket of equal digests the canonical bytes of documents are
compared, and those of edited texts by their SHA-256, as they are not written anywhere; a bucket that holds
different ones gets SHA-256 of the canonical text behind its digests. So two fingerprints are equal exactly
when the canonical texts are, and likeness is 1 or 0.

Defined results: null text counts as empty; null doc_ids sort first; rows of equal doc_id sort by
their text; a single row is its own next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.llm.rows import narrow, wide_hash
from pagetwin.session import Scratch

#: Rows wanted in a bucket of the ordering, and the most buckets; their list is sent to every executor.
BUCKET_ROWS, MAX_BUCKETS, MAX_BOUNDS = 512, 200_000, 512
#: Digests with several documents that are broadcast at most; beyond, the join is shuffled.
BROADCAST_KEYS = 500_000


def canonical(c: Column) -> Column:
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(c), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def digest(canon: Column, bits: int = 128) -> Column:
    """Unverified digest. Fewer bits only serve tests of the verification."""
    return wide_hash(canon, salt=1) if bits >= 128 else F.hex(F.pmod(F.xxhash64(canon), F.lit(1 << bits)))


def _bounds(docs: DataFrame) -> tuple[list[int], int]:
    """Split points of doc_id into ranges of about equal rows, and the equal parts of each range."""
    n = docs.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    ranges = min(MAX_BOUNDS, buckets)
    marks = [k / ranges for k in range(ranges + 1)]
    got = docs.agg(F.percentile_approx("doc_id", marks, 4 * MAX_BOUNDS).alias("q")).first()["q"] or []
    return sorted(set(got)), -(-buckets // ranges)


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs with `bucket`, which never decreases with doc_id."""
    bounds, parts = _bounds(docs)
    if not bounds:
        return docs.withColumn("bucket", F.lit(-1).cast("long"))
    marks = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    at = F.size(F.filter(marks, lambda b: b <= F.col("doc_id"))).cast("long")
    lo, hi = F.get(marks, F.col("at") - 1), F.get(marks, F.col("at"))
    inside = F.coalesce(F.floor((F.col("doc_id") - lo) * parts / (hi - lo)), F.lit(0)) if parts > 1 else F.lit(0)
    out = docs.withColumn("at", at).withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("at") * parts + F.least(inside, F.lit(parts - 1))).cast("long"))
    return out.drop("at")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest) with next_text and next_digest of the next row by doc_id; the last row's next is the first.

    Each text is shuffled once. The first rows of every bucket are also sent to the bucket before, so no
    window spans the whole table.
    """
    spark = docs.sparkSession
    bucketed = _bucketed(docs)
    found = sorted(bucketed.groupBy("bucket").agg(F.min("doc_id").alias("first_id")).collect())  # at most MAX_BUCKETS + 2 rows
    before = spark.createDataFrame([(r["bucket"], r["first_id"], found[k - 1]["bucket"]) for k, r in enumerate(found)], "bucket long, first_id long, before long")
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("before").alias("to"), F.lit(True).alias("ghost"))
    sent = bucketed.join(F.broadcast(before), "bucket").withColumn("sent", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(own, copy)).otherwise(F.array(own))))
    rows = sent.select("doc_id", "text", "digest", F.col("sent.to").alias("bucket"), F.col("sent.ghost").alias("ghost"))
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "digest", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_digest", F.lead("digest").over(order)).where("not ghost").drop("ghost", "bucket")


def _clashes(docs: DataFrame, base: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """Digests under which different canonical bytes lie."""
    shared = scratch.table(base.groupBy("fingerprint").count().where("count > 1").select(F.col("fingerprint").alias("digest")))
    keys = F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared
    canon = docs.select(canonical(F.col("text")).alias("canon")).select("canon", digest(F.col("canon"), bits).alias("digest"))
    same = canon.join(keys, "digest", "left_semi").groupBy("digest").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    # Edited texts with each other and with documents: their digests are counted with map-side combining.
    all_ = base.select(F.explode(F.array(F.struct(F.col("fingerprint").alias("digest"), "sha"), F.struct(F.col("edited_fingerprint").alias("digest"), F.col("edited_sha").alias("sha")))).alias("x")).select("x.*")
    mixed = all_.groupBy("digest").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
    return scratch.table(same.where("lo <> hi").select("digest").union(mixed.where("lo <> hi").select("digest")).distinct())


def _measured(rows: DataFrame, bits: int) -> DataFrame:
    pairs = with_next(rows.withColumn("digest", digest(canonical(F.col("text")), bits)))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    made = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    made = made.withColumn("edited_digest", digest(F.col("edited_canon"), bits))
    text_canon = canonical(F.col("text"))
    # Bytes are compared only where digests agree.
    near_edited = F.when(F.col("digest") == F.col("edited_digest"), (text_canon == F.col("edited_canon")).cast("double")).otherwise(F.lit(0.0))
    near_next = F.when(F.col("digest") == F.col("next_digest"), (text_canon == canonical(F.col("next_text"))).cast("double")).otherwise(F.lit(0.0))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("digest").alias("fingerprint"),
        F.col("edited_digest").alias("edited_fingerprint"),
        near_edited.alias("near_edited"),
        near_next.alias("near_next"),
        F.unhex(F.sha2(text_canon.cast("binary"), 256)).alias("sha"),
        F.unhex(F.sha2(F.col("edited_canon").cast("binary"), 256)).alias("edited_sha"),
    )


def fingerprint_documents(docs: DataFrame, digest_bits: int = 128) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = narrow(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    scratch = Scratch(docs.sparkSession, "fingerprints")
    base = scratch.table(_measured(rows, digest_bits))
    clashes = _clashes(rows, base, scratch, digest_bits)
    if clashes.isEmpty():
        return base.drop("sha", "edited_sha")
    marked = base
    for name, sha in (("fingerprint", "sha"), ("edited_fingerprint", "edited_sha")):
        keys = clashes.select(F.col("digest").alias(name), F.lit(True).alias("clash"))
        marked = marked.join(keys, name, "left").withColumn(name, F.when(F.col("clash"), F.concat_ws("-", name, F.lower(F.hex(sha)))).otherwise(F.col(name))).drop("clash")
    return marked.select(*(c for c in base.columns if c not in ("sha", "edited_sha")))
