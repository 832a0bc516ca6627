"""Personal data: patterns, and terms that disclose the people or accounts they stand beside.

Patterns find e-mail addresses, IP addresses, card numbers (16 to 19 digits that pass Luhn) and phone
numbers (8 to 15 digits), leftmost first, per kind. Each is written so that a long run without a
match costs linear time.

What the patterns find are the protected entities. All words of a text that holds one, outside the
findings themselves, are terms under test, of any length. Over the whole corpus, with a row as the
unit, the disclosure of an entity e by a term t is their pointwise mutual information over the
entity's information content:

    log(N * p / df(e)) / log(N / df(e)),  p = P(e | t)

1 means that every row with the term holds the entity; 0 that they are independent (after Sanchez and
Batet, "C-sanitized", 2016). p is not the plain share df(t, e) / df(t), by which any word that occurs once
would disclose all of its text, but the lower end of its Wilson interval, CONFIDENCE standard errors
wide. What counts as trials are different texts, so copies of one text are no further evidence. One
text alone is evidence too, and weighs more the rarer entity and term are in the corpus: a word seen in
no other text has p = 0.21, which passes GENERALISE once the entity's share of the rows is below
1 / 540. From GENERALISE on a term is replaced by its class, from REMOVE on it is taken out; base findings
always stay. A term goes at all its places in the texts that hold an entity it discloses, and stays in
texts that hold none of them. Kinds of entities are not protected: that a text holds some address is no
one's secret.

Entities that stand in one text only have the same counts with every term of it, so they are one
entity, named after the text. Counts are partial sums per (entity, term), one row each per task. Rows in
between are, for a text, its words times its entities of several texts, plus its words. Tables of one
row a key are joined by `meet`, which sends heavy keys to the rows. Document counts of all words are
summed in each task before they are shuffled.

Null and empty texts have no findings. Repeated rows get equal rows each, and rows with equal ids and
different texts their own. An empty table gives an empty result. Other columns pass through
`sanitised`, and are not read elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import lower_ascii, materialize, parts

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 1.96  # standard errors between the estimate and the bound that is used
GENERALISE = 0.75
REMOVE = 0.9
HEAVY = 10_000  # a key with more than one in HEAVY of the rows is joined by broadcast
SALTS = 16  # a text's rows are dealt to so many groups
LONGEST = 64  # a longer word is counted under its digest

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the run of local signs, not past the match before, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    if not _SIGN.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, found: str) -> str:
    """What two mentions of the same entity have in common."""
    value = found.translate(_LOWER) if kind in ("email", "ip") else _digits(found)
    return hashlib.sha256(f"{kind}:{value}".encode()).hexdigest()[:32]


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word in lower case, start, end) of the words that no finding touches, in order."""
    cuts = sorted((a, b) for _, a, b in spans)
    at, reach = 0, -1
    for m in _WORDS.finditer(text):
        start, end = m.span()
        while at < len(cuts) and cuts[at][0] < end:
            reach = max(reach, cuts[at][1])
            at += 1
        if start >= reach:
            yield m[0].translate(_LOWER), start, end


def term_name(word: str) -> str:
    """What a word is counted as: itself, or the digest of a long one. No word holds a #."""
    return word if len(word) <= LONGEST else "#" + hashlib.sha256(word.encode()).hexdigest()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPOTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("remove", pa.bool_())]))
_SPOTS_DDL = "array<struct<start:bigint,end:bigint,remove:boolean>>"


def scan(docs: DataFrame, id_col: str) -> DataFrame:
    """Per row: id, th (hash of the text), base findings, entities, and the text if it holds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            bases, entities, held = [], [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                spans = base_spans(text)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                entities.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                held.append(text if spans else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["th"],
                    pa.array(bases, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(entities, pa.list_(pa.string())),
                    pa.array(held, pa.string()),
                ],
                names=["id", "th", "base", "entities", "held"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), "text")
    kind = rows.select("id").schema[0].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"id {kind}, th bigint, base array<struct<kind:string,start:bigint,end:bigint>>, "
        "entities array<string>, held string",
    )


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _salt(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")


def meet(rows: DataFrame, table: DataFrame, keys: list[str], n_rows: str) -> DataFrame:
    """Inner join of `rows` with a written table of one short row a key.

    `n_rows` names the column of `table` that says how many of `rows` have the key. Keys of more than one
    in HEAVY of them are fewer than HEAVY, so they are broadcast; the rows of any other key fit a task.
    """
    share = table.agg(F.sum(n_rows).alias("_all")).first()["_all"] or 0
    heavy = F.broadcast(table.where(F.col(n_rows) * HEAVY > share))
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    light = light.join(table.where(F.col(n_rows) * HEAVY <= share), keys)
    return rows.join(heavy, keys).unionByName(light)


def tested_texts(scanned: DataFrame) -> DataFrame:
    """Per different text with entities: th, number of rows, text, those of its entities that other
    texts hold too with their row counts, one for all others, and the distinct terms."""
    texts = scanned.where("held is not null").groupBy("th")
    texts = texts.agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("held").alias("text"))
    texts = materialize(texts, "pii-texts")
    each = texts.select("th", "n", F.explode("entities").alias("entity"))
    shared = each.groupBy("entity").agg(F.sum("n").alias("with_entity"), F.count(F.lit(1)).alias("texts"))
    shared = materialize(shared.where("texts > 1"), "pii-entities")
    of = meet(each.select("th", "entity"), shared, ["entity"], "texts")
    of = of.groupBy("th").agg(F.collect_list(F.struct("entity", "with_entity")).alias("of"))
    own = F.struct(F.concat(F.lit("text:"), F.col("th").cast("string")).alias("entity"), F.col("n").alias("with_entity"))
    others = F.coalesce("of", F.array().cast("array<struct<entity:string,with_entity:bigint>>"))
    every = F.when(F.size(others) < F.size("entities"), F.concat(others, F.array(own))).otherwise(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            terms = [sorted({term_name(w) for w, _, _ in outside(t, base_spans(t))}) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.list_(pa.string()))], names=[*batch.schema.names, "terms"])

    rows = texts.join(of, "th", "left").select("th", "n", "text", every.alias("of"))
    kind = "th bigint, n bigint, text string, of array<struct<entity:string,with_entity:bigint>>, terms array<string>"
    return materialize(rows.mapInArrow(run, kind), "pii-words")


def _pairs(texts: DataFrame) -> DataFrame:
    pairs = texts.select("th", "n", F.explode("of").alias("e"), "terms")
    return pairs.select("th", "n", "e.entity", "e.with_entity", F.explode("terms").alias("term"))


def lower_bound(share: Column, trials: Column) -> Column:
    """Lower end of the Wilson interval of a share."""
    spare = F.lit(CONFIDENCE**2) / trials
    spread = F.sqrt(share * (1 - share) / trials + spare / (4 * trials))
    return (share + spare / 2 - F.lit(CONFIDENCE) * spread) / (1 + spare)


def disclosing(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term, support, disclosure) where the disclosure reaches GENERALISE; support in texts."""
    pair = _pairs(texts).groupBy("entity", "with_entity", "term")
    tested = materialize(pair.agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("support")), "pii-tested")
    total = docs.count()
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_WORD), F.lit(0)))
    # Counted before the join, so that what crosses the shuffle is the vocabulary, whatever terms are tested.
    word = F.col("word")
    name = F.when(F.length(word) <= LONGEST, word).otherwise(F.concat(F.lit("#"), F.sha2(word.cast("binary"), 256)))
    counted = docs.select(F.explode(words).alias("word")).groupBy(name.alias("term")).agg(F.count(F.lit(1)).alias("with_term"))
    terms = materialize(tested.groupBy("term").agg(F.count(F.lit(1)).alias("pairs")), "pii-terms")
    # An inner join: a semi join would be moved below the sum.
    seen = materialize(counted.join(terms, "term"), "pii-vocabulary")
    rows = meet(tested, seen, ["term"], "pairs")
    share = F.least(F.lit(1.0), F.col("together") / F.col("with_term"))
    information = F.log(F.lit(float(total)) / F.col("with_entity"))
    mutual = F.log(F.lit(float(total)) * lower_bound(share, F.col("support") / share) / F.col("with_entity"))
    rows = rows.where(information > 0).select("entity", "term", "support", (mutual / information).alias("disclosure"))
    return rows.where(F.col("disclosure") >= GENERALISE)


def term_spans(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Per row with such terms: id, th, terms (start, end, remove), in order."""
    texts = tested_texts(scanned)
    flagged = materialize(disclosing(docs, texts), "pii-flagged")
    hits = meet(_pairs(texts).select("th", "entity", "term"), flagged, ["entity", "term"], "support")
    hits = hits.groupBy("th", "term").agg((F.max("disclosure") >= REMOVE).alias("remove"))
    hits = hits.groupBy("th").agg(F.collect_list(F.struct("term", "remove")).alias("flagged"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            spots = []
            for text, found in zip(batch["text"].to_pylist(), batch["flagged"].to_pylist()):
                remove = {f["term"]: f["remove"] for f in found}
                named = ((a, b, term_name(w)) for w, a, b in outside(text, base_spans(text)))
                places = ((a, b, remove[t]) for a, b, t in named if t in remove)
                spots.append([dict(zip(("start", "end", "remove"), p)) for p in places])
            yield pa.RecordBatch.from_arrays([batch["th"], pa.array(spots, _SPOTS)], names=["th", "terms"])

    places = texts.select("th", "text").join(hits, "th").select("th", "text", "flagged")
    places = places.mapInArrow(run, f"th bigint, terms {_SPOTS_DDL}")
    # A text that very many rows hold is dealt to several groups by the rows' ids. Places grow with the
    # corpus: never broadcast.
    rows = scanned.where("held is not null").select("id", "th").distinct().select("id", "th", _salt(F.col("id")))
    rows = rows.join(places.select("*", _salts()).hint("merge"), ["th", "salt"])
    return materialize(rows.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "terms"), "pii-spans")


def findings(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, base findings and disclosing terms."""
    scanned = materialize(scan(docs, id_col), "pii-scan")
    terms = term_spans(docs, scanned)
    rows = scanned.join(terms, scanned["id"].eqNullSafe(F.col("_id")) & scanned["th"].eqNullSafe(F.col("_th")), "left")
    none = F.array().cast(_SPOTS_DDL)
    return rows.select(F.col("id").alias(id_col), "base", F.coalesce("terms", none).alias("terms"))


def replaced(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """The text with findings replaced by their kind; terms by their class, or by nothing."""
    cuts = [(a, b, f"[{kind.upper()}]") for kind, a, b in base_spans(text)]
    for a, b, remove in terms:
        word = text[a:b]
        shape = "NUMBER" if word.isdigit() else "NAME" if word[:1].isupper() else "WORD"
        cuts.append((a, b, "" if remove else f"[{shape}]"))
    out, at = [], 0
    for a, b, label in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """`docs` with personal data replaced in the text; every other text and column as it is."""
    scanned = materialize(scan(docs, id_col), "pii-scan")
    terms = term_spans(docs, scanned)
    # The row as one struct: its column names cannot clash with the others.
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.xxhash64("text").alias("_key"))
    rows = rows.join(terms, F.expr("_own <=> _id and _key <=> _th"), "left").select("_row", "terms")
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            texts = [
                None if t is None else replaced(t, [(s["start"], s["end"], s["remove"]) for s in spans or ()])
                for t, spans in zip(batch.column(0).field(place).to_pylist(), batch.column(1).to_pylist())
            ]
            columns = batch.column(0).flatten()
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _texts(spans: str, kind: Callable[[Column], Column]) -> Column:
    """`kind:start:end` of every span."""
    return F.transform(
        spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def pii(docs: DataFrame) -> DataFrame:
    base = _texts("base", lambda s: s["kind"])
    every = F.concat(base, _texts("terms", lambda s: F.lit("term")))
    return findings(docs).select(
        "doc_id",
        *[_count(kind) for kind in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )
