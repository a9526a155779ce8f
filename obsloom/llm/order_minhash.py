"""Order MinHash fingerprints of whole texts. DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .layout import NO_KEY, bounds, range_of, texts

BINS = 64  # signatures of a fingerprint
BLANK = " \t\n\r\x0b\x0c"


def fingerprints(rows: DataFrame, by: list[str], text: str = "text", k: int = 3) -> DataFrame:
    """(*by, sketch): Order MinHash of ``text`` for each row, named by ``by``. Rows that are partitioned by a part of ``by`` stay where they are.

    Items are k-mers of words with their occurrence number (the text's end gives shorter ones, so any word makes an item). An item's hash
    picks one of BINS signatures and one of two halves; the minimal item of each half is selected, and a signature hashes its items in
    text order. ``sketch`` holds one long for each signature that has an item: its number, then 32 bits of its hash. A text without words has none."""
    trimmed = F.trim(F.col(text), F.lit(BLANK))
    words = rows.where(trimmed != "").select(*by, F.split(trimmed, "\\s+").alias("_words"))
    grams = words.select(*by, F.posexplode(F.arrays_zip(*[(F.col("_words") if i == 0 else F.slice("_words", i + 1, F.greatest(F.size("_words") - i, F.lit(0)))).alias(f"w{i}")
                                                         for i in range(k)])).alias("_pos", "_gram"))
    grams = grams.select(*by, "_pos", F.xxhash64(*[f"_gram.w{i}" for i in range(k)]).alias("_kmer"))
    # the k-mer leads the sort: its 64 bits settle nearly every comparison
    numbered = grams.withColumn("_occurrence", F.row_number().over(Window.partitionBy("_kmer", *by).orderBy("_pos")))
    item = F.xxhash64("_kmer", "_occurrence")
    packed = F.shiftleft(F.shiftrightunsigned(item, 33), 32).bitwiseOR(F.col("_pos").cast("long"))
    items = numbered.select(*by, F.pmod(item, F.lit(BINS)).cast("int").alias("_bin"), F.shiftright(item, 16).bitwiseAND(F.lit(1).cast("long")).alias("_half"), packed.alias("_item"))
    tops = items.groupBy(*by, "_bin").agg(F.min(F.when(F.col("_half") == 0, F.col("_item"))).alias("a"), F.min(F.when(F.col("_half") == 1, F.col("_item"))).alias("b"))
    low = F.lit((1 << 32) - 1)
    a, b = F.shiftright("a", 32), F.shiftright("b", 32)
    first = F.coalesce(F.col("a").bitwiseAND(low) < F.col("b").bitwiseAND(low), F.lit(True))
    tuple_hash = F.when(first, F.xxhash64(F.lit(0), a, F.lit(1), b)).otherwise(F.xxhash64(F.lit(2), b, F.lit(3), a))
    signed = tops.select(*by, F.shiftleft(F.col("_bin").cast("long"), 32).bitwiseOR(tuple_hash.bitwiseAND(low)).alias("_sig"))
    return signed.groupBy(*by).agg(F.sort_array(F.collect_list("_sig")).alias("sketch"))


def likeness(a: Column, b: Column) -> Column:
    """Equal signatures over signatures that either sketch has; two empty sketches are alike."""
    bins = lambda x: F.transform(x, lambda s: F.shiftright(s, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def spell(sketch: Column) -> Column:
    """Ten hexadecimal digits a signature: two for its number, eight for its hash."""
    return F.array_join(F.transform(sketch, lambda s: F.lower(F.lpad(F.hex(s), 10, "0"))), "")


def edited_fingerprints(docs: DataFrame, k: int = 3, range_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document in ascending doc_id, after
    the last comes the first. Texts are shuffled once, to ranges of doc_id; the first document of a range also goes to the range before
    it, as the successor of that range's last. Null doc_ids come first, rows of one doc_id follow by their text's hash; a null text is empty;
    a single row is its own successor; an empty table gives an empty one."""
    plain = texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(NO_KEY)))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = bounds(plain.select("_key"), "_key", max(1, -(-total // range_bytes)))
    n = max(1, len(cuts))
    here = range_of("_key", cuts or [0])
    # a range that cannot be null keeps the join below from adding a filter to one of the two uses
    own = F.struct(F.coalesce(here, F.lit(0)).alias("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.coalesce(F.pmod(here - 1, F.lit(n)).cast("int"), F.lit(0)).alias("_range"), F.lit(True).alias("_guest"))
    rows = plain.select("doc_id", "_key", "text", F.explode(F.when(F.col("_key").isin(cuts or [0]), F.array(own, guest)).otherwise(F.array(own))).alias("_at"))
    rows = rows.select("doc_id", "_key", "text", "_at.*").repartition(n, "_range")
    order = Window.partitionBy("_range").orderBy("_guest", "_key", F.xxhash64("text"), "text")
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    pairs = rows.withColumn("_row", F.row_number().over(order)).withColumn("_next", F.lead("text").over(order)).select(
        "doc_id", "_range", "_guest", "_row", "text", chars.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)).alias("edited"))
    both = pairs.select("doc_id", "_range", "_row", F.explode(F.when(F.col("_guest"), F.array(F.struct(F.lit(0).alias("_edit"), F.col("text")))).otherwise(
        F.array(F.struct(F.lit(0).alias("_edit"), F.col("text")), F.struct(F.lit(1).alias("_edit"), F.col("edited").alias("text"))))).alias("_v"))
    # doc_id goes along so that both uses of ``rows`` read the same columns and share one shuffle of the texts
    sketches = fingerprints(both.select("_range", "_row", "doc_id", "_v.*"), ["_range", "_row", "doc_id", "_edit"], k=k)
    wide = sketches.groupBy("_range", "_row").agg(F.max(F.when(F.col("_edit") == 0, F.col("sketch"))).alias("own"), F.max(F.when(F.col("_edit") == 1, F.col("sketch"))).alias("edit"))
    empty = F.array().cast("array<bigint>")
    facts = pairs.select("doc_id", "_range", "_guest", "_row", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    joined = facts.join(wide, ["_range", "_row"], "left").select(*facts.columns, F.coalesce("own", empty).alias("own"), F.coalesce("edit", empty).alias("edit"))
    step = Window.partitionBy("_range").orderBy("_row")
    return joined.withColumn("_next", F.coalesce(F.lead("own").over(step), empty)).where(~F.col("_guest")).select(
        "doc_id", "n_chars", "edited_sha256", spell(F.col("own")).alias("fingerprint"), spell(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("_next")).alias("near_next"))
