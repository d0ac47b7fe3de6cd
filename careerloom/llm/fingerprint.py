"""Document fingerprints: threshold-scaled sketches, native expressions only (operator 6).

A sketch holds the hash of every five-word shingle that lies below a fixed fraction of the
hash range. The kept set depends on the shingle alone, so the sketch of two texts together is the
union of their sketches, and likeness and containment are estimated from the hashes that both
or either keep, however unequal the texts. A text none of whose hashes lies below the fraction keeps its least one
instead, so that equal texts are told from others; ``merge`` drops such a hash where the other sketch holds more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle.
WIDTH = 5
#: One in ``2 ** KEEP_BITS`` shingle hashes is kept.
KEEP_BITS = 2
#: Ids of one window that finds each document's successor.
SPAN = 1024


def sketch(text: Column, width: int = WIDTH, keep_bits: int = KEEP_BITS) -> Column:
    """Sorted distinct hashes of the text's shingles below the fixed fraction; the least hash where there is none.

    Words are what white space parts, lower-cased. A text of fewer words than a shingle is one
    shingle; a text without words has an empty sketch.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(width)]))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # a transform over a one-element array binds the hashes once, so they are not computed per use
    return F.flatten(F.transform(F.array(hashed), lambda h: _kept(shingles(h), keep_bits)))


def _kept(all_hashes: Column, keep_bits: int) -> Column:
    bound = (1 << (63 - keep_bits)) - 1
    # hashes are signed: their top bit is dropped, which leaves 63 even bits
    even = F.transform(all_hashes, lambda x: x.bitwiseAND(F.lit((1 << 63) - 1)))
    return F.flatten(F.transform(F.array(even), lambda hs: _below(hs, bound)))


def _below(hs: Column, bound: int) -> Column:
    """The hashes up to the bound, sorted and distinct; the least one where there is none."""
    low = F.filter(hs, lambda x: x <= bound)
    least = F.when(F.size(hs) > 0, F.array(F.array_min(hs))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(low), lambda k: F.when(F.size(k) > 0, F.array_sort(F.array_distinct(k))).otherwise(least)))


def merge(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """The sketch of the union of two sets of shingles, from their sketches."""
    return F.flatten(F.transform(F.array(F.array_union(a, b)), lambda hs: _below(hs, (1 << (63 - keep_bits)) - 1)))


def as_text(kept: Column) -> Column:
    """A sketch as a string: its hashes in order, in hexadecimal, with commas."""
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike, an empty and another are not.

    Kept sets are compared as they are. Texts whose hashes all lie above the fraction compare by their least hash.
    """
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


#: Quantiles that cut the ids; what the driver holds of them, and each row's search among them, is bounded.
MOST_CUTS = 4096
#: Ranges up to which their first ids are broadcast: 32 bytes each. Beyond, they are joined by a shuffle.
BROADCAST_RANGES = 500_000


def _before(cuts: list[int], x: Column) -> Column:
    """How many of the sorted cuts are at most ``x``, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    array = F.lit(cuts).cast("array<bigint>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(array, at + step) <= x, at + step).otherwise(at))


def _ranges(docs: DataFrame, span: int) -> Column:
    """Number of the range of each row of ``docs(doc_id, hash)``: about ``span`` rows, in the order of id, then hash.

    Ids are cut at approximate quantiles, and between them evenly where there are more rows than cuts allow for. Ids that several
    quantiles fall on, and null ids, which come first, are cut by the hash.
    """
    x = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    parts = max(1, min(MOST_CUTS, x["ids"] // span))
    cuts = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    starts = sorted(set(cuts))
    # a part of the hash's range, by its upper bits
    share = lambda many: F.shiftright(F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 44) * many, 20)
    k = _before(starts, F.col("doc_id")) if starts else F.lit(0)
    within = F.lit(0).cast("long")
    if x["ids"] > 2 * span * parts:
        lows, highs = [x["lo"], *starts], [*starts, x["hi"] + 1]
        width = [max(1, -(-(b - a) * parts * span // x["ids"])) for a, b in zip(lows, highs, strict=True)]
        at = lambda values: F.element_at(F.lit(values).cast("array<bigint>"), k + 1)
        within = F.floor((F.col("doc_id") - at(lows)) / at(width)).cast("long")
    within = within + F.lit(1 << 20)
    hot = {v: -(-(cuts.count(v) + 1) * x["ids"] // (parts * span)) for v in starts if cuts.count(v) > 1}
    if hot:
        many = F.try_element_at(F.create_map(*[F.lit(y).cast("long") for kv in hot.items() for y in kv]), F.col("doc_id"))
        within = F.coalesce(share(many), within)
    placed = F.shiftleft((k + 1).cast("long"), 32) + within
    return F.when(F.col("doc_id").isNull(), share(F.lit(-(-(x["n"] - x["ids"]) // span)).cast("long"))).otherwise(placed)


def with_next(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, text, kept, next_text, next_kept``: each document's sketch and the document that follows by id.

    The last is followed by the first; ties in the id are in the order of the text's hash; null ids come first. A range's
    window also gets the first row of the range after it. So rows move once, to their range, and no window holds the whole table.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), "hash")
    number = _ranges(hashed, span)
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).select("doc_id", "text", number.alias("range"), key.alias("key"))
    first = placed.groupBy("range").agg(F.min("key").alias("key")).withColumn("cut", F.shiftright("range", 32))
    # the range before: within a cut, else the last one of the cut before, of which there are few
    ends = first.groupBy("cut").agg(F.max("range").alias("end"))
    ends = ends.select("cut", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("cut")).alias("end"), F.max("end").over(Window.partitionBy(F.lit(0))).alias("last"))
    order = first.withColumn("before", F.lag("range").over(Window.partitionBy("cut").orderBy("range"))).join(F.broadcast(ends), "cut")
    target = order.select("range", "key", F.coalesce("before", "end", "last").alias("before"))
    if docs.count() // span <= BROADCAST_RANGES:
        target = F.broadcast(target)
    heads = placed.join(target, ["range", "key"]).select("doc_id", "text", F.col("before").alias("range"), "key", F.lit(1).alias("from_next"))
    rows = placed.withColumn("from_next", F.lit(0)).union(heads).withColumn("kept", sketch(F.col("text")))
    by = Window.partitionBy("range").orderBy("from_next", "key", "text")
    return rows.select("doc_id", "text", "kept", "from_next", F.lead("text").over(by).alias("next_text"), F.lead("kept").over(by).alias("next_kept")).where("from_next = 0").drop("from_next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)``, of their edited texts, and the likenesses.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text has its last half replaced by the beginning of the next
    document. Null texts count as empty; an empty text has an empty fingerprint, is like
    another empty one (1.0) and unlike any other (0.0). Repeated rows follow each other; rows of one id are in the order of their texts' hashes; a
    single document follows itself; an empty table gives no rows. Further columns are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    edited = F.expr("concat(left(text, char_length(text) - char_length(text) div 2), left(next_text, char_length(text) div 2))")
    made = with_next(base).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "kept", "next_kept")
    made = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "kept", "next_kept", sketch(F.col("edited")).alias("edited_kept"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"), likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )
