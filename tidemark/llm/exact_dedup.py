"""Exact deduplication with an extendible-hash index on shared files. DataFrame functions only.

Every text has a 64-bit hash; its first bits are its prefix. The directory has one slot for each prefix of its depth and
starts with one; while a bucket is overfull (more than ``bucket_capacity`` distinct hashes), it splits on the next bit, and
if its own depth is the directory's, the directory doubles first. Sizes of buckets come from one histogram of prefixes of
a bounded number of bits; a bucket that has used all these bits stays overfull, and its chains lie in the same files. The
directory is a file in the shared folder.

Rows are routed through the directory. Copies are combined before they move: an entry holds the count and the largest id
of the rows of one text and one of ``SALTS`` parts, so that a group of any size is a few entries. Entries are written to
bucket files, by key ranges of hashes: a file holds whole buckets, and the task that owns it reads no other. There the
owner walks the chain of entries with the same hash, in the order of length, SHA-256 and text, and compares each entry's
bytes with those before it; equal ones are one group. Texts whose hash no other row has, as told by a bitmap of hashes that
recur, are alone in their chain and travel without bytes. Every document then looks up its entry by its slot, hash and part
for the group's size and largest id; an entry that is missing is an error.

Cases: null text counts as empty; empty texts are equal to each other; among rows with the same largest id all stay;
rows with a null id are counted, and stay only where their whole group has no id; texts that differ under equal hashes
are told apart by their bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm.common import body, default_partitions

#: Bits of the hash that the directory may use: it has 65,536 slots at most, which bounds what is broadcast.
MAX_DEPTH = 16
#: The bitmap of hashes that recur has 2**28 bits (32 MB) at most, and 16 for each such hash where that is less.
FILTER_BITS, FILTER_SHARE = 28, 16
#: Parts into which the rows of a text are dealt before they are combined.
SALTS = 16
ENTRY = ["bucket", "k", "len", "sha", "salt"]


def grow(histogram: dict[int, int], bits: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """The directory's depth, and for each of its slots the bucket (its first prefix of ``bits`` bits) and its depth."""
    sums = [0]
    for prefix in range(1 << bits):
        sums.append(sums[-1] + histogram.get(prefix, 0))
    slots, depth = [(0, 0)], 0
    while over := {b for b, d in slots if d < bits and sums[b + (1 << (bits - d))] - sums[b] > capacity}:
        if any(d == depth for b, d in slots if b in over):
            slots, depth = [slot for slot in slots for _ in range(2)], depth + 1
        # a slot's new bucket starts at the slot's own first bits
        slots = [((i >> (depth - d - 1)) << (bits - d - 1), d + 1) if b in over and d < depth else (b, d) for i, (b, d) in enumerate(slots)]
    return depth, slots


def directory(keys: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """The depth, and (slot, bucket, depth) from its file; ``keys`` has the distinct hashes k."""
    spark = keys.sparkSession
    bits = min(MAX_DEPTH, (keys.count() // capacity).bit_length() + 4)
    histogram = keys.groupBy(_slot(bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()  # 65,536 rows at most
    depth, slots = grow({r.prefix: r.n for r in histogram}, bits, capacity)
    values = ", ".join(f"({i}L, {b}, {d})" for i, (b, d) in enumerate(slots))
    path = session.shared_path(spark, "extendible-directory")
    spark.sql(f"SELECT * FROM VALUES {values} AS t(slot, bucket, depth)").coalesce(1).write.parquet(path)
    return depth, spark.read.parquet(path)


def _slot(depth: int):
    """The first ``depth`` bits of the hash."""
    return F.shiftrightunsigned(F.col("k"), 64 - depth) if depth else F.lit(0).cast("long")


def routed(rows: DataFrame, found: tuple[int, DataFrame]) -> DataFrame:
    """``rows`` with the bucket that the directory has for them."""
    depth, slots = found
    return rows.withColumn("slot", _slot(depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")


def recurring(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``recurs``: true where another row may have the same hash. A bitmap of bounded size is broadcast."""
    shared = keys.filter("n > 1")
    bits = min(FILTER_BITS, max(15, (FILTER_SHARE * shared.count()).bit_length()))
    # pages hold 32,768 bits; page numbers and positions are regular from key 1 on
    key = F.shiftrightunsigned(F.col("k"), 64 - bits) + 1
    pages = shared.select(F.bitmap_bucket_number(key).alias("page"), F.bitmap_bit_position(key).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    probe = rows.withColumn("page", F.bitmap_bucket_number(key)).withColumn("bit", F.bitmap_bit_position(key))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) != 0
    return probe.join(F.broadcast(pages), "page", "left").withColumn("recurs", F.coalesce(hit, F.lit(False))).drop("page", "bit", "bits")


def write_buckets(entries: DataFrame) -> DataFrame:
    """``entries`` written to bucket files in the shared folder, and read from them by their owners."""
    spark: SparkSession = entries.sparkSession
    files, name = default_partitions(spark), f"extendible_{uuid.uuid4().hex}"
    path = session.shared_path(spark, "extendible-hash")
    entries.repartition(files, "bucket").write.bucketBy(files, "bucket").sortBy("bucket", "k").option("path", path).saveAsTable(name)
    index = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay
    return index


def walk_chains(index: DataFrame) -> DataFrame:
    """(bucket, k, len, sha, salt, text, n, top, clash) for each entry: the count and largest id of its text.

    text numbers the different texts of a chain; clash is true where texts that differ have the same hashes.
    """
    chain = Window.partitionBy("bucket", "k").orderBy("len", "sha", "body", "salt")
    same = [F.col(c).eqNullSafe(F.lag(c).over(chain)) for c in ("len", "sha", "body")]
    steps = index.withColumn("fresh", F.when(same[0] & same[1] & same[2], 0).otherwise(1))
    numbered = steps.withColumn("text", F.sum("fresh").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    group, hashes = Window.partitionBy("bucket", "k", "text"), Window.partitionBy("bucket", "k", "len", "sha")
    clash = F.max("text").over(hashes) != F.min("text").over(hashes)
    return numbered.select(*ENTRY, "body", "text", F.sum("n").over(group).alias("n"), F.max("top").over(group).alias("top"), clash.alias("clash"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 4096) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``; the largest id stays."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body(f"`{text_col}`").alias("body")).withColumn("salt", salt)
    texts = texts.withColumns({"k": F.xxhash64("body"), "sha": F.unhex(F.sha2("body", 256)), "len": F.octet_length("body")})
    rows = session.cut(texts.select("doc_id", "k", "len", "sha", "salt"))
    keys = session.cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    slots = directory(keys, bucket_capacity)

    carried = recurring(routed(texts, slots), keys).withColumn("body", F.when(F.col("recurs"), F.col("body")))
    entries = carried.groupBy(*ENTRY, "body").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    index = walk_chains(write_buckets(entries))
    answers = session.cut(index.select(*ENTRY, "n", "top", "clash").distinct())

    lost = F.raise_error(F.lit("the index has no entry of a document")).cast("long")
    found = routed(rows, slots).join(answers.filter("NOT clash"), ENTRY, "left")
    if not (clashes := answers.filter("clash")).isEmpty():
        # texts that differ under equal hashes are looked up by their bytes as well
        slow = clashes.select(*ENTRY).distinct()
        whole = routed(texts, slots).join(slow, ENTRY, "left_semi").join(index.filter("clash").select(*ENTRY, "body", "n", "top"), [*ENTRY, "body"], "left")
        found = found.join(slow, ENTRY, "left_anti").select("doc_id", "sha", "n", "top").unionByName(whole.select("doc_id", "sha", "n", "top"))
    return found.select(
        "doc_id",
        F.col("top").alias("keep_id"),
        F.coalesce("n", lost).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
