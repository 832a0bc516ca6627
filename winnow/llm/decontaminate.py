"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of letters, digits and non-ASCII signs, A-Z in lower case. A window is ten words in a
row of a benchmark item, or the whole item when it has fewer. Fingerprints: every five words in a
row get a hash, and from every six such hashes in a row the smallest is kept. Ten equal words hold
the same six hashes, so a shared window always shares a fingerprint (Schleimer, Wilkerson and
Aiken, 2003). Shorter items, which winnowing cannot promise to find, add the hash of the whole item,
looked up at every place.

Fingerprints of documents are joined with those of the items as they are made, and reduced to one
flag per document before any shuffle. Documents with a shared fingerprint are extended: their
windows are compared with the items' windows by 96 bits of hash, and words inside a hit are counted
once. Whether the benchmark is broadcast is Spark's decision by its size; beyond the threshold the
joins shuffle.

Null and empty texts have no words and no hits. Repeated rows get equal rows each; rows with equal
ids and different texts are judged by their own text. Items with equal ids count once, items with a
null id hit but are not listed. No items means no hits. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import lower_ascii, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5


def words_of(text: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def hashed_words(df: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep`, `n_words`, and `w`: a hash of every word."""
    rows = df.select(*keep, words_of(F.col("text")).alias("_words"))
    return rows.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("w"),
    )


def grams(size: int, kind: str = "xxhash64") -> Column:
    """Hash of every `size` words in a row of the hashed words `w`."""
    inside = ", ".join(f"get(w, i + {j})" for j in range(size))
    return F.expr(
        f"CASE WHEN size(w) >= {size} THEN transform(sequence(0, size(w) - {size}), i -> {kind}({inside})) "
        "ELSE array() END"
    )


def fingerprints(df: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep`, `n_words`, `w` and `prints`: the winnowed hashes. Fewer than ten words have none."""
    steps = WINDOW - GRAM + 1
    rows = hashed_words(df, *keep).withColumn("g", grams(GRAM))
    smallest = F.expr(
        f"CASE WHEN size(g) >= {steps} THEN array_distinct(transform(sequence(1, size(g) - {steps - 1}), "
        f"i -> array_min(slice(g, i, {steps})))) ELSE cast(array() AS array<bigint>) END"
    )
    return rows.select(*keep, "n_words", "w", smallest.alias("prints"))


def windows(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """A row for each place and size: `size`, `at`, and two hashes of the words there."""
    parts = []
    for size in sizes:
        pair = F.arrays_zip(grams(size).alias("h"), grams(size, "hash").alias("h2"))
        part = rows.select(*keep, "n_words", F.posexplode(pair).alias("at", "_pair"))
        parts.append(
            part.select(
                *keep, "n_words", F.lit(size).alias("size"), "at", F.col("_pair.h"), F.col("_pair.h2")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, n_items, items (their ids as sorted text)."""
    items = items.select(F.col(item_col).cast("string").alias("item"), "text").distinct()
    spelt = materialize(fingerprints(items, "item"), "leak-items")
    # At most nine sizes below a whole window.
    short = sorted(
        r[0] for r in spelt.where(f"n_words between 1 and {WINDOW - 1}").select(F.col("n_words").cast("int")).distinct().collect()
    )
    sizes = [*short, WINDOW]
    parts = windows(spelt, sizes, "item").where(
        F.when(F.col("n_words") < WINDOW, F.col("size") == F.col("n_words")).otherwise(F.col("size") == WINDOW)
    )
    parts = materialize(parts.select("size", "h", "h2", "item").distinct(), "leak-windows")
    known = spelt.select(F.lit(0).alias("size"), F.explode("prints").alias("print"))
    known = known.unionByName(parts.where(F.col("size") < WINDOW).select("size", F.col("h").alias("print")))
    known = materialize(known.distinct().withColumn("found", F.lit(1)), "leak-prints")

    source = docs.select(F.col(id_col).alias("_id"), "text").withColumn("_text", F.xxhash64("text"))
    rows = fingerprints(source.withColumn("_row", F.monotonically_increasing_id()), "_row", "_id", "_text")
    keys = F.transform("prints", lambda p: F.struct(F.lit(0).alias("size"), p.alias("print")))
    for size in short:
        keys = F.concat(
            keys,
            F.transform(F.array_distinct(grams(size)), lambda p: F.struct(F.lit(size).alias("size"), p.alias("print"))),
        )
    keyed = rows.select("_row", "_id", "_text", "n_words", F.explode_outer(keys).alias("_key"))
    keyed = keyed.select("_row", "_id", "_text", "n_words", "_key.size", "_key.print")
    flagged = materialize(
        keyed.join(known, ["size", "print"], "left")
        .groupBy("_row", "_id", "_text", "n_words")
        .agg(F.max("found").alias("found")),
        "leak-flags",
    )
    suspects = materialize(
        flagged.where("found = 1").select(F.col("_id").alias("_sid"), F.col("_text").alias("_stext")).distinct(),
        "leak-suspects",
    )
    same = source["_id"].eqNullSafe(F.col("_sid")) & (source["_text"] == F.col("_stext"))
    texts = source.join(suspects, same, "left_semi").dropDuplicates(["_id", "_text"])
    places = windows(hashed_words(texts, "_id", "_text"), sizes, "_id", "_text")
    hits = materialize(
        places.join(parts.select("size", "h", "h2").distinct(), ["size", "h", "h2"], "left_semi").select(
            "_id", "_text", "size", "at", "h", "h2"
        ),
        "leak-hits",
    )
    covered = hits.select("_id", "_text", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("word"))
    covered = covered.distinct().groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("_id", "_text", "size", "h", "h2").distinct().join(parts, ["size", "h", "h2"])
    named = named.groupBy("_id", "_text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.join(named, covered["_id"].eqNullSafe(named["_id"]) & (covered["_text"] == named["_text"]))
    found = materialize(
        found.select(covered["_id"].alias("_fid"), covered["_text"].alias("_ftext"), "n_hit", "items"), "leak-found"
    )
    matched = flagged.join(
        found, flagged["_id"].eqNullSafe(F.col("_fid")) & (flagged["_text"] == F.col("_ftext")), "left"
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return matched.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        listed.alias("items"),
    )


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
