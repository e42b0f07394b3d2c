"""Document fingerprints by consistent weighted sampling, JVM-side.

For sample k and a term of weight w, a hash of (term, k) gives r and c from Gamma(2, 1) and b
from [0, 1); then t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The sample is
the (term, t) with the least a. Two texts get the same sample with a probability equal to
the generalised Jaccard similarity of their weights, here the counts of their words.
A gamma value is minus the logarithm of a product of two uniform numbers.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.containment import WORD_BREAKS

SAMPLES = 64


def _unit(u: Column, shift: int) -> Column:
    """26 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(u, shift).bitwiseAND(0x3FFFFFF) + F.lit(1)) * F.lit(1 / 67108866.0)


def _sample(k: int) -> Column:
    """The least (ln a, identity) of a group's terms, packed into one long that orders by ln a."""
    u, v = F.xxhash64("term", F.lit(k)), F.xxhash64("term", F.lit(k + SAMPLES))
    r = -F.ln(_unit(u, 0) * _unit(u, 26))
    ln_c = F.ln(-F.ln(_unit(v, 0) * _unit(v, 26)))
    b = F.shiftrightunsigned(u, 52).bitwiseXOR(F.shiftrightunsigned(v, 52)) * F.lit(1 / 4096.0)
    t = F.floor(F.col("ln_w") / r + b)
    ln_a = ln_c - r * (t - b + 1.0)
    identity = F.col("term").bitwiseXOR(t * 2654435761).bitwiseAND(0xFFFFFF)
    return F.min(F.shiftleft(((ln_a + 100.0) * 16777216.0).cast("long"), 24).bitwiseOR(identity))


def samples(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term long, w) rows, one per term -> keys, s (array of SAMPLES longs), least (the least term)."""
    rows = weights.withColumn("ln_w", F.when(F.col("w") == 1, 0.0).otherwise(F.ln("w")))
    sampled = rows.groupBy(*keys).agg(*[_sample(k).alias(f"s{k}") for k in range(SAMPLES)], F.min("term").alias("least"))
    return sampled.select(*keys, F.array(*[f"s{k}" for k in range(SAMPLES)]).alias("s"), "least")


def _identity(x: Column) -> Column:
    """The 24 bits of a sample that say which (term, t) it is."""
    return x.bitwiseAND(0xFFFFFF)


def fingerprint(s: Column) -> Column:
    """24 bits of each sample as hexadecimal digits; empty for a text without terms."""
    return F.coalesce(F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(_identity(x))), 6, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples, by the bits that the fingerprints show; two texts without terms are alike, one without is like no other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (_identity(x) == _identity(y)).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(SAMPLES))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


_LETTER = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"


def words_of(text: Column) -> Column:
    """Words (A-Z lower-cased), empty ones among them."""
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), WORD_BREAKS)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> part, rn, extra, doc_id, text, next_text, by descending doc_id; after the last comes the first.

    Ids are dealt to ranges; each range also gets the first row of the range that follows it (extra), so that
    the next text is found inside the range. A null doc_id comes last. Rows of one doc_id follow by their text.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("k"))
    # cuts of the ids: a bounded number of longs
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / ranges for i in range(1, ranges)]).alias("c")).first()["c"] or []
    cuts = F.lit(sorted(set(cuts))).cast("array<bigint>") if cuts else F.expr("cast(array() AS array<bigint>)")
    part = F.size(F.filter(cuts, lambda c: c <= F.col("k")))
    heads = [(r["part"], r["k"]) for r in rows.select(part.alias("part"), "k").groupBy("part").agg(F.max("k").alias("k")).orderBy("part").collect()]
    rows = rows.withColumn("part", part)
    if heads:
        # the head of each range also ends the range above it; the topmost one ends the lowest
        above = {k: heads[(i + 1) % len(heads)][0] for i, (_, k) in enumerate(heads)}
        to = F.create_map(*[F.lit(x) for kv in above.items() for x in kv])
        extra = rows.where(F.col("k").isin(*above)).withColumn("part", F.element_at(to, F.col("k")))
        rows = rows.withColumn("extra", F.lit(0)).union(extra.withColumn("extra", F.lit(1)))
    else:
        rows = rows.withColumn("extra", F.lit(0))
    w = Window.partitionBy("part").orderBy("extra", F.desc("k"), "text")
    rows = rows.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    doc_id = F.when(F.col("k") != lowest, F.col("k"))
    return rows.select("part", F.row_number().over(w).alias("rn"), "extra", doc_id.alias("doc_id"), "text", F.lead("text").over(w).alias("next_text"))


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points replaced by as many of the next document's first
    ones. Null texts are empty; a lone document is its own next. One row per row of docs.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", F.when(F.col("extra") == 0, edited))
    # both texts begin alike: the words up to the last break before the edit are counted once for both
    common = F.regexp_extract(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), r"(?s)\A(.*[\x00-\x2F\x3A-\x60\x7B-\x7F])", 1)
    rows = rows.withColumn("common", F.when(F.col("text").rlike(_LETTER) & F.coalesce(F.col("edited").rlike(_LETTER), F.lit(False)), common).otherwise(""))
    begin = F.char_length("common") + 1
    # one lineage from here on: what else a row has to say goes along as terms of its own kinds
    facts = [F.col("extra"), F.col("n_chars"), F.coalesce("doc_id", F.lit(-(1 << 63))), *[F.conv(F.substring("_sha", 15 * k + 1, 15), 16, 10) for k in range(5)]]
    rows = rows.withColumn("_sha", F.coalesce(F.sha2("edited", 256), F.lit("0" * 64)))
    part_of = lambda c: F.substring(c, begin, F.lit(2147483647))
    own = F.when(F.col("text").rlike(_LETTER), words_of(part_of("text"))).otherwise(F.array("text"))
    new = F.when(F.col("edited").rlike(_LETTER), words_of(part_of("edited"))).otherwise(F.array(F.coalesce("edited", F.lit(""))))
    rows = rows.select("part", "rn", "text", "edited", "common", F.array(*[f.cast("string") for f in facts]).alias("facts"), F.explode(F.sequence(F.lit(0), F.lit(2 + len(facts)))).alias("kind"))
    word = F.when(F.col("kind") == 0, own).when(F.col("kind") == 1, new).when(F.col("kind") == 2, words_of(F.col("common"))).otherwise(F.array(F.get("facts", F.col("kind") - 3)))
    terms = rows.select("part", "rn", "kind", F.explode(word).alias("word")).where("word <> ''")
    group = F.greatest(F.col("kind") - 2, F.lit(0))
    terms = terms.select("part", "rn", group.alias("fact"), "kind", F.when(F.col("kind") < 3, F.xxhash64("word")).otherwise(F.expr("try_cast(word AS bigint)")).alias("term"))
    count = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0))
    counted = terms.groupBy("part", "rn", "fact", "term").agg(count(0, 2).alias("w0"), count(1, 2).alias("w1"))
    # a term of equal weight in both texts has the same samples there: it stands in a group for both (2)
    in_groups = F.when(F.col("fact") > 0, F.array(F.struct((F.col("fact") + 2).alias("which"), F.lit(1).cast("bigint").alias("w"))))
    in_groups = in_groups.when(F.col("w0") == F.col("w1"), F.array(F.struct(F.lit(2).alias("which"), F.col("w0").alias("w")))).when(F.col("w1") == 0, F.array(F.struct(F.lit(0).alias("which"), F.col("w0").alias("w")))).when(F.col("w0") == 0, F.array(F.struct(F.lit(1).alias("which"), F.col("w1").alias("w"))))
    in_groups = in_groups.otherwise(F.array(F.struct(F.lit(0).alias("which"), F.col("w0").alias("w")), F.struct(F.lit(1).alias("which"), F.col("w1").alias("w"))))
    weights = counted.select("part", "rn", "term", F.explode(in_groups).alias("g")).select("part", "rn", "term", "g.which", "g.w")
    s = samples(weights, ["part", "rn", "which"])
    fact = [F.max(F.when(F.col("which") == 3 + k, F.col("least"))).alias(f"f{k}") for k in range(len(facts))]
    by_group = [F.first(F.when(F.col("which") == k, F.col("s")), True).alias(f"g{k}") for k in (0, 1, 2)]
    out = s.groupBy("part", "rn").agg(*by_group, *fact)
    both = lambda k: F.when(F.col("g2").isNull(), F.col(f"g{k}")).when(F.col(f"g{k}").isNull(), F.col("g2")).otherwise(F.zip_with(f"g{k}", "g2", lambda x, y: F.least(x, y)))
    out = out.withColumns({"s0": both(0), "s1": both(1)})
    out = out.withColumn("next_s", F.lead("s0").over(Window.partitionBy("part").orderBy("rn"))).where("f0 = 0")
    digits = [F.lpad(F.lower(F.hex(f"f{3 + k}")), 15 if k < 4 else 4, "0") for k in range(5)]
    doc_id = F.when(F.col("f2") != -(1 << 63), F.col("f2"))
    return out.select(doc_id.alias("doc_id"), F.col("f1").alias("n_chars"), F.concat(*digits).alias("edited_sha256"), fingerprint(F.col("s0")).alias("fingerprint"), fingerprint(F.col("s1")).alias("edited_fingerprint"), likeness(F.col("s0"), F.col("s1")).alias("near_edited"), likeness(F.col("s0"), F.col("next_s")).alias("near_next"))
