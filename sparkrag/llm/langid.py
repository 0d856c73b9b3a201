"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkrag.llm.hashing import mix
from sparkrag.llm.held import held

#: Characters of an n-gram, bits of a character's number, and the numbers of what is no letter and of unknown letters.
ORDER, BITS, GAP, OTHER = 4, 16, 0, 1
DISCOUNT = 0.75
RESULT = ("lang_pred", "score", "entropy", "rejected")


def _numbers(alphabet: list[str]) -> np.ndarray:
    """The number of each code point: letters alike but for case share one."""
    place = {c: i + 2 for i, c in enumerate(alphabet)}
    table = np.full(0x110000, GAP, np.uint16)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = place.get(low if len(low) == 1 else x, OTHER)
    return table


def _lower(code: np.ndarray, n: int) -> np.ndarray:
    """The last n characters of n-gram codes."""
    return code & np.uint64((1 << BITS * n) - 1)


class CharModels:
    """One Kneser-Ney model of characters for each language, kept in sorted arrays of n-gram hashes.

    The letters of all texts have a number each (the 65,534 commonest, should there be more), and any other letter one
    in common; every language spreads its last share evenly over all of these and the gap, so that a letter it never
    had is as unlikely in one language as in another.
    """

    def __init__(self, texts: list[tuple[str, str]]):
        counts = Counter(c for _, t in texts for c in t.lower() if c.isalpha())
        self.alphabet = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:(1 << BITS) - 2]]
        self.langs = sorted({k for k, _ in texts})
        self.table = _numbers(self.alphabet)
        self.parts = {k: self._fit([t for x, t in texts if x == k]) for k in self.langs}
        self.mean, self.spread, self.limit = ({k: v for k in self.langs} for v in (0.0, 1.0, np.inf))
        told = hashlib.blake2b(repr((self.langs, self.alphabet)).encode())
        for k in self.langs:
            for arrays in self.parts[k]:
                for a in arrays:
                    told.update(a.tobytes())
        self.digest = told.hexdigest()

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-gram codes of texts laid end to end, each begun with gaps, and where each text's begin (one more at the end)."""
        lead = "\n" * (ORDER - 1)
        points = np.frombuffer((lead + lead.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
        start = np.cumsum(length) - length
        s = self.table[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        head = np.zeros(len(s), bool)
        for j in range(ORDER - 1 if len(texts) else 0):
            keep[start + j] = True
            head[start + j] = True
        kept = np.concatenate(([0], np.cumsum(keep & ~head)))
        s, head = s[keep].astype(np.uint64), head[keep]
        code = s.copy()
        for j in range(1, ORDER):
            code[j:] |= s[:-j] << np.uint64(BITS * j)
        return code[~head], kept[np.append(start, len(keep))] if len(texts) else np.zeros(1, np.int64)

    def _fit(self, texts: list[str]) -> list[tuple[np.ndarray, ...]]:
        """By order: sorted hashes of n-grams with discounted counts; sorted hashes of contexts with totals and kinds."""
        code, _ = self.codes(texts)
        gram, count = np.unique(code, return_counts=True)
        out = []
        for n in range(ORDER, 0, -1):
            context, at = np.unique(gram >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.bincount(at, count), np.bincount(at)
            gk, ck = mix(gram), mix(context)
            go, co = np.argsort(gk), np.argsort(ck)
            out.append((gk[go], np.maximum(count - DISCOUNT, 0)[go], ck[co], total[co], kinds[co]))
            if n > 1:  # lower orders count the different characters that stand before
                gram, count = np.unique(_lower(gram, n - 1), return_counts=True)
        return out[::-1]

    def log_probs(self, code: np.ndarray) -> np.ndarray:
        """log probability of each n-gram's last character after the others, by language."""
        out = np.empty((len(code), len(self.langs)))
        for k, lang in enumerate(self.langs):
            p = np.full(len(code), 1 / (len(self.alphabet) + 2))
            for n, (grams, left, contexts, total, kinds) in enumerate(self.parts[lang], 1):
                own = _lower(code, n)
                gk, ck = mix(own), mix(own >> np.uint64(BITS))
                i = np.minimum(np.searchsorted(contexts, ck), len(contexts) - 1)
                j = np.minimum(np.searchsorted(grams, gk), len(grams) - 1)
                given = (np.where(grams[j] == gk, left[j], 0.0) + DISCOUNT * kinds[i] * p) / total[i]
                p = np.where(contexts[i] == ck, given, p)
            out[:, k] = np.log(p)
        return out


class Scorer:
    """Sums the models over texts; looked-up n-grams are remembered in a table of at most table_bytes, whatever the
    number of languages. What it has forgotten is looked up again, so its size changes no score."""

    def __init__(self, models: CharModels, bits: int = 19, table_bytes: int = 96 << 20):
        bits = max(8, min(bits, (table_bytes // (8 * len(models.langs))).bit_length() - 1))
        self.models, self.bits = models, bits
        self.codes = np.zeros(1 << bits, np.uint64)
        self.filled = np.zeros(1 << bits, bool)
        self.values = np.zeros((1 << bits, len(models.langs)))

    def _looked_up(self, code: np.ndarray) -> np.ndarray:
        slot = (mix(code) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.values[slot]
        missing = np.flatnonzero(~self.filled[slot] | (self.codes[slot] != code))
        if len(missing):
            new, at = np.unique(code[missing], return_inverse=True)
            told = self.models.log_probs(new)
            got[missing] = told[at]
            place = (mix(new) >> np.uint64(64 - self.bits)).astype(np.int64)
            place, which = np.unique(place, return_index=True)  # of two for one place the first stays
            self.codes[place], self.values[place], self.filled[place] = new[which], told[which], True
        return got

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character by language, and the number of characters, of each text."""
        code, bounds = self.models.codes(texts)
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(texts)), n)
        sums = np.zeros((len(texts), len(self.models.langs)))
        for lo in range(0, len(code), 1 << 17):
            got, at = self._looked_up(code[lo:lo + (1 << 17)]), row[lo:lo + (1 << 17)]
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(at, got[:, k], len(texts))
        return -sums / np.maximum(n, 1)[:, None], n


def _excess(models: CharModels, best: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By how many spreads of its language a cross-entropy exceeds the usual one; short texts spread wider."""
    mean, spread = (np.array([x[k] for k in models.langs]) for x in (models.mean, models.spread))
    return (low - mean[best]) / (spread[best] * np.sqrt(np.maximum(1, 400 / np.maximum(n, 1))))


def _lettered(texts: list[str]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in texts], bool)


def fit(docs: DataFrame, per_lang: int = 500, chars_per_lang: int = 2_000_000, slack: float = 2.0, most_langs: int = 512) -> CharModels | None:
    """Models fitted on a bounded sample: of each language at most per_lang different labelled texts with a letter, in
    the order of a hash of the text, as long as they have chars_per_lang characters together (the first in any case). Of
    more than most_langs different labels those with most different texts are learned, ties by name.

    Of a language with five texts or more every fifth is kept back, and calibrates rejection: mean and spread of the
    cross-entropies of the texts kept back, and as limit slack times the largest excess among them (see identify).

    docs needs text and lang; null ones teach nothing, and without any the result is None. A hash threshold by the
    language's number of different texts picks the rows before they are ranked, so that no task gathers a language.
    Copies count once; ties are impossible between different texts but for equal hashes, which go by text.
    """
    own = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    own = own.withColumn("place", F.xxhash64("text", F.lit(20240229))).where(F.col("text").rlike(r"\p{L}"))
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("place").alias("different"))
    # sizes has a row for each learned language, of which every task gets a whole model later.
    sizes = sizes.orderBy(F.desc("different"), "lang").limit(most_langs)
    share = F.least(F.lit(1.0), F.lit(3.0 * per_lang) / F.col("different"))
    picked = own.join(F.broadcast(sizes), "lang").where(F.shiftrightunsigned("place", 12) < F.lit(1 << 52) * share).select("lang", "text", "place").distinct()
    order = W.partitionBy("lang").orderBy("place", "text")
    sample = picked.withColumn("nth", F.row_number().over(order)).withColumn("chars", F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    sample = sample.where((F.col("nth") <= per_lang) & ((F.col("chars") <= chars_per_lang) | (F.col("nth") == 1))).select("lang", "text", "nth").collect()
    rows = sorted((r["lang"], r["nth"], r["text"]) for r in sample)
    rows = [r for r, ok in zip(rows, _lettered([t for *_, t in rows]), strict=True) if ok]
    if not rows:
        return None
    many = Counter(k for k, *_ in rows)
    models = CharModels([(k, t) for k, nth, t in rows if many[k] < 5 or nth % 5])
    scorer = Scorer(models)
    for k, lang in enumerate(models.langs):
        own_texts = [t for x, nth, t in rows if x == lang and (many[lang] < 5 or not nth % 5)]
        if not own_texts:
            continue
        h, n = scorer.entropies(own_texts)
        models.mean[lang], models.spread[lang] = float(np.median(h[:, k])), float(max(0.02, h[:, k].std()))
        z = _excess(models, np.full(len(own_texts), k), h[:, k], n)
        models.limit[lang] = max(4.0, slack * float(z.max())) if many[lang] >= 5 else np.inf
    return models


def identify(docs: DataFrame, models: CharModels | None, into: tuple[str, ...] = RESULT) -> DataFrame:
    """The language of every whole text: the model of lowest length-normalised cross-entropy.

    docs needs text; all its columns are returned, and lang, source and doc_id play no part. The results' columns are
    named by into, and replace columns of those names: the language, its score, its cross-entropy in nats a character,
    and whether it is rejected. score is the winner's share, 0 to 1, by the margins between cross-entropies. A text is
    rejected where it has no letter, or where its cross-entropy exceeds the mean of the predicted language by more than
    the limit that texts of that language kept back have set, in spreads (wider for texts under 400 characters).

    Null, empty or letterless text: "und", score 0, null entropy, rejected. Without models every row is such. Ties go to
    the language first by name. Repeated rows are told alike; no rows, no result rows.
    """
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in into}]
    df = docs.select(*kept)
    schema = StructType(list(df.schema.fields))
    for name, kind in zip(into, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = held(("langid", m.digest), lambda: Scorer(m)) if m is not None else None
        for batch in batches:
            at = batch.schema.get_field_index("text")
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
            ends, lo = np.cumsum(size), 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
                part, lo = batch.slice(lo, hi - lo), hi
                more = judge([t or "" for t in part.column(at).to_pylist()], scorer)
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *into])

    def judge(texts: list[str], scorer: Scorer | None) -> list[pa.Array]:
        n = len(texts)
        if scorer is None:
            return [pa.array(["und"] * n), pa.array([0.0] * n), pa.nulls(n, pa.float64()), pa.array([True] * n)]
        m, lettered = scorer.models, _lettered(texts)
        h, chars = scorer.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(n), best]
        score = 1 / np.exp(-(h - low[:, None]) * np.minimum(np.maximum(chars, 1), 40)[:, None]).sum(1)
        far = _excess(m, best, low, chars) > np.array([m.limit[k] for k in m.langs])[best]
        return [
            pa.array([m.langs[b] if x else "und" for b, x in zip(best, lettered, strict=True)]), pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0)),
            pa.array(np.where(lettered, low, np.nan), mask=~lettered), pa.array(~lettered | far)]

    return df.mapInArrow(told, schema)
