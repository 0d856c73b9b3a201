"""Personal data: pattern spans, and terms whose co-occurrence with them across the corpus gives them away."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.hashing import ALNUM, text_slices, word_hashes, words
from sparkrag.llm.held import let_go
from sparkrag.llm.names import unused
from sparkrag.session import saved

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
NO_ID = -(2**63)
LOWER = {c: c + 32 for c in range(65, 91)}
BLOOM_BITS = 23


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches, leftmost and non-overlapping within a kind, by start, then kind."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            s = m.start()
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, m.end(), 0))
                done = m.end()
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.group().split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def _value(text: str, kind: int) -> str:
    return text.lower() if kind < 2 else re.sub("[^0-9]", "", text)


def _term_hashes(terms: list[str]) -> np.ndarray:
    out = []
    for _, _, data, offsets in text_slices(pa.array(terms, pa.large_string())):
        begin, end, _ = words(data, offsets, ALNUM)
        out.append(word_hashes(data, begin, end, True))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _text_hashes(values: list[str]) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return [x - (x >> 63 << 64) for x in map(xxh3_64_intdigest, values)]


SPANS = "doc_id long, text_key long, spans array<struct<start:long,end:long,kind:string>>, entities array<long>, near array<struct<entity:long,context:long,term:long,first:boolean>>"


def _terms(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of the words of three letters or more that touch no span."""
    covered = bytearray(len(text))
    for s, e, _ in found:
        covered[s:e] = b"\x01" * (e - s)
    return [m.span() for m in TERM.finditer(text) if m.end() - m.start() >= 3 and covered.find(1, *m.span()) < 0]


def _scan(reach: int):
    """Pattern spans of every text, the entities it mentions, and the terms within reach characters of each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            spans, entities, near, all_terms = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text) if text else []
                spans.append([{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in found])
                own = _terms(text, found) if found else []
                starts, ends = [x for x, _ in own], [y for _, y in own]
                rows, pairs = {}, set()
                mentioned = []
                for s, e, k in found:
                    seen = "\x00".join((text[max(0, s - reach):s], text[e:e + reach]))
                    entity, context = _text_hashes([f"{KINDS[k]}:{_value(text[s:e], k)}", seen])
                    mentioned.append(entity)
                    for x, y in own[bisect_left(starts, s - reach):bisect_right(ends, e + reach)]:
                        term = text[x:y].translate(LOWER)
                        if (entity, context, term) not in rows:
                            rows[entity, context, term] = (entity, term) not in pairs
                            pairs.add((entity, term))
                            all_terms.append(term)
                entities.append(list(dict.fromkeys(mentioned)))
                near.append(rows)
            hashes = iter(_term_hashes(all_terms).tolist())
            made = [[{"entity": e, "context": c, "term": next(hashes), "first": first} for (e, c, _), first in rows.items()] for rows in near]
            arrays = [pa.array(x, SCAN_TYPE.field(name).type) for name, x in (("spans", spans), ("entities", entities), ("near", made))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *arrays], names=SCAN_TYPE.names)

    return scan


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_NEAR = pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64()), ("first", pa.bool_())])
SCAN_TYPE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.list_(_SPAN)), ("entities", pa.list_(pa.int64())), ("near", pa.list_(_NEAR))])


def _filter(wanted: DataFrame) -> Broadcast:
    """A filter of fixed size of the wanted terms."""
    spark, bits = wanted.sparkSession, 1 << BLOOM_BITS
    cell = F.pmod(F.col("term"), F.lit(bits))
    maps = (
        wanted.groupBy(F.expr(f"bitmap_bucket_number(pmod(term, {bits}L))").alias("nth"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bitmap")).collect()
    )
    filled = np.zeros(bits + (1 << 16), bool)
    for r in maps:
        own = np.unpackbits(np.frombuffer(bytes(r["bitmap"]), np.uint8), bitorder="little")
        lo = (r["nth"] - 1) * len(own) + 1
        filled[lo:lo + len(own)] = own
    filled[0] = filled[0] or any(r["nth"] == 0 for r in maps)
    return spark.sparkContext.broadcast(np.packbits(filled).tobytes())


def _document_frequencies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """In how many documents each wanted term stands; a filter of fixed size spares the shuffle other words."""
    shared, bits = _filter(wanted), 1 << BLOOM_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            got = []
            for _, _, data, offsets in text_slices(batch.column("text")):
                begin, end, first = words(data, offsets, ALNUM)
                h = word_hashes(data, begin, end, True).view(np.int64)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                ok = kept[np.mod(h, bits)]
                pairs = np.unique(np.stack([h[ok], row[ok]], 1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
                got.append(pairs[:, 0])
            term, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["term", "n"])

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("term_docs"))


def _places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every place of the wanted terms (and of few others) in texts with pattern spans."""
    shared, bits = _filter(wanted), 1 << BLOOM_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        if not kept.any():
            return
        for batch in batches:
            row, own, all_terms = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text and (found := base_spans(text)):
                    at = _terms(text, found)
                    row += [i] * len(at)
                    own += at
                    all_terms += [text[x:y] for x, y in at]
            h = _term_hashes(all_terms)
            ok = np.flatnonzero(kept[np.mod(h, bits)])
            at = np.array(own, np.int64).reshape(-1, 2)[ok]
            taken = pa.array(np.array(row, np.int64)[ok])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), batch.column("text_key").take(taken), pa.array(h[ok]), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["doc_id", "text_key", "term", "start", "end"])

    return docs.mapInArrow(places, "doc_id long, text_key long, term long, start long, end long")


def find(docs: DataFrame, remove_at: float = 0.9, generalise_at: float = 0.75, support: int = 3, reach: int = 80) -> DataFrame:
    """Pattern spans of all whole texts, and spans of terms that disclose what the patterns protect.

    docs needs doc_id (integer) and text; other columns are ignored, whatever their names. A protected entity is the
    value of a pattern match; its contexts are the different passages of reach characters on either side of it. With p
    the shares of rows that mention c, hold t, and hold t near c, the disclosure of entity c by term t is
    PMI(c; t) / IC(c) = log(p(c, t) / (p(c) p(t))) / -log p(c): 1 where the term stands nowhere else. Terms (words of
    three letters or more that lie wholly within reach) in at least support different contexts of the entity are removed
    from remove_at on, generalised from generalise_at on, at every place in whole texts that mention the entity. Counts
    cover all rows and whole texts.

    Returns a row for each input row: doc_id, text_key (a hash of the text), spans (array of start, end, kind in code
    points, by start; kinds email, ip, card, phone, then term and term_general). Null and empty texts have no spans; a
    null doc_id stays null; repeated rows get equal spans, and equal copies count as one context (but as rows in the shares); no rows, no result
    rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    scanned = saved(own.mapInArrow(_scan(reach), SPANS), "pii", compression="zstd")
    near = scanned.select(F.explode("near").alias("x")).select("x.*")
    mentions = scanned.withColumn("doc_key", F.coalesce("doc_id", F.lit(NO_ID))).select("doc_key", "text_key", F.explode("entities").alias("entity"))
    joint = near.groupBy("entity", "term", "context").agg(F.count_if("first").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("both_n"))
    joint = joint.where(F.col("contexts") >= support).join(mentions.groupBy("entity").agg(F.count("*").alias("entity_n")), "entity")
    joint = joint.persist(StorageLevel.DISK_ONLY)
    try:
        frequencies = _document_frequencies(own, joint.select("term").distinct())
        total = docs.select(F.count("*").alias("documents"))
        ratio = F.log(F.col("both_n") * F.col("documents") / (F.col("entity_n") * F.col("term_docs"))) / F.log(F.col("documents") / F.col("entity_n"))
        judged = joint.join(frequencies, "term").crossJoin(F.broadcast(total)).where("documents > entity_n").withColumn("ratio", ratio).where(F.col("ratio") >= generalise_at)
        judged = saved(judged.select("entity", "term", F.when(F.col("ratio") >= remove_at, "term").otherwise("term_general").alias("kind")), "disclosing")
    finally:
        joint.unpersist()
    disclosed = mentions.join(judged, "entity").groupBy("doc_key", "text_key", "term").agg(F.min("kind").alias("kind"))
    placed = _places(own, judged.select("term").distinct()).withColumn("doc_key", F.coalesce("doc_id", F.lit(NO_ID)))
    flagged = placed.join(disclosed, ["doc_key", "text_key", "term"])
    flagged = flagged.groupBy("doc_key", "text_key", "start", "end").agg(F.min("kind").alias("hard"))
    added = flagged.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("start", "end", F.col("hard").alias("kind"))).alias("added"))
    base = scanned.select("doc_id", "text_key", "spans", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_key"))
    both = base.join(added, ["doc_key", "text_key"], "left")
    return both.select("doc_id", "text_key", by_start(F.concat("spans", F.coalesce("added", F.array().cast("array<struct<start:long,end:long,kind:string>>")))).alias("spans"))


def by_start(spans: Column) -> Column:
    """Spans by start, then by kind in the listed order."""
    order = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.lit([*KINDS, "term", "term_general"]), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(order), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "", "term_general": "[TERM]"}


def masked(text: str, spans: list[dict]) -> str:
    """text with pattern spans and generalised terms replaced by their kind, and disclosing terms taken out; where
    spans overlap, the first one covers both."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], MASKS[s["kind"]]]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with all found spans masked in text, and n_chars (where there is one) counted anew; other columns as they
    were. Null text stays null. See find for the rest."""
    doc, key, mark = unused(docs.columns, "doc", "key", "spans")
    found = find(docs, **limits).where(F.size("spans") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(doc), F.col("text_key").alias(key), F.col("spans").alias(mark))
    found = found.dropDuplicates([doc, key])
    left = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: F.xxhash64(F.col("text").cast("string"))})
    joined = left.join(found, [doc, key], "left").drop(doc, key)
    names = list(docs.columns)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans = batch.column(batch.schema.get_field_index(mark)).to_pylist()
            if any(spans):
                texts = [masked(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select(names)

    out = joined.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
