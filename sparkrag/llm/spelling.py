"""Spelling variants: words one edit apart, found by a bit-sliced position index."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.session import saved

#: What a run of letters is made of, and how a run is changed for its document.
LETTERS, EVERY = r"[A-Za-zÀ-ÿ]+", 97
MET = "word string, n_near long, form_n long, form string"


class PositionIndex:
    """Words as bits of integers: for each position and letter, the set of words with that letter there; for each length,
    the set of words that long."""

    def __init__(self, words: Iterable[str] = ()):
        self.words: list[str] = []
        self.has: dict[tuple[int, str], int] = defaultdict(int)
        self.long: dict[int, int] = defaultdict(int)
        for word in words:
            bit = 1 << len(self.words)
            self.words.append(word)
            self.long[len(word)] |= bit
            for place in enumerate(word):
                self.has[place] |= bit

    def near(self, word: str) -> list[int]:
        """Numbers of the words exactly one inserted, deleted or replaced code point away from word.

        All words of the index are followed at once, letter by letter of word: `same` holds those that agree so far;
        `other` those with one letter replaced, which go on at the same position; `more` those with a letter more, which
        go on a position later; `less` those with a letter less, a position earlier.
        """
        has, every = self.has.get, (1 << len(self.words)) - 1
        same, other, more, less = every, 0, 0, 0
        for i, letter in enumerate(word):
            here, next_, last = has((i, letter), 0), has((i + 1, letter), 0), has((i - 1, letter), 0)
            other, more, less, same = (other & here) | (same & ~here), (more | same) & next_, (less & last) | same, same & here
            if not (same | other | more | less):
                return []
        m = len(word)
        found = (other & self.long.get(m, 0)) | ((more | same) & self.long.get(m + 1, 0)) | (less & self.long.get(m - 1, 0))
        out = []
        while found:
            bit = found & -found
            out.append(bit.bit_length() - 1)
            found ^= bit
        return out


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = EVERY) -> DataFrame:
    """word and n of all words of at least shortest code points that stand at least least times in the whole texts.

    A word is a maximal run of letters with A-Z lower-cased; where the checksum of doc_id and run is a multiple of every,
    the run loses a letter, chosen by the checksum. Tasks count what they read before anything is shuffled.
    """
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.filter(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"), F.lit(1)), lambda r: F.length(r) >= shortest)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = each.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _buckets(word: Column) -> Column:
    """Where a word meets all words that may be near. Of two words one edit apart, the shorter with m letters, either the
    first m // 2 letters agree or the last m - m // 2 do; a word is the shorter, or equally long, with m its length, and
    the longer with m one less. Equal hashes of different halves only let more words meet."""
    n = F.length(word)

    def halves(m: Column) -> list[Column]:
        first = F.floor(m / 2).cast("int")
        return [F.struct(F.xxhash64(m, F.lit(side), half).alias("bucket"), m.alias("shorter"), F.lit(side == 1).alias("late"))
                for side, half in ((0, F.substring(word, F.lit(1), first)), (1, F.substring(word, n - (m - first) + 1, m - first)))]

    return F.array(*halves(n), *halves(n - 1))


def neighbours(vocabulary: DataFrame, slice_words: int = 4096, task_words: int = 65536) -> DataFrame:
    """word, n_near (words of the vocabulary exactly one edit away), form_n and form of the most frequent of them (ties:
    smallest in code-point order); only words with any.

    vocabulary: word, n, each word once. Words meet in buckets of equal halves; a bucket of more than slice_words words is
    cut into slices, each indexed once for every slice of its words that ask. A bucket's task sends one row for each
    asking word, with its count and its best, not one for each pair. No rows, no result rows.
    """
    entries = vocabulary.select("word", "n", F.explode(_buckets(F.col("word"))).alias("b")).select("word", "n", "b.*")
    entries = saved(entries, "spelling-buckets", compression="zstd")
    sizes = entries.groupBy("bucket", "shorter", "late").agg(F.count("*").alias("size")).where("size > 1")
    slices = F.ceil(F.col("size") / slice_words).cast("int")
    own = entries.join(sizes, ["bucket", "shorter", "late"]).withColumn("slices", slices).withColumn("mine", F.pmod(F.xxhash64("word"), "slices").cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.struct((F.col("mine") * F.col("slices") + j).alias("part"), F.lit(False).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: F.struct((i * F.col("slices") + F.col("mine")).alias("part"), F.lit(True).alias("asks")))
    role = F.when(F.col("slices") == 1, F.array(F.struct(F.lit(0).alias("part"), F.lit(None).cast("boolean").alias("asks")))).otherwise(F.concat(places, asked))
    dealt = own.select("bucket", "shorter", "late", "word", "n", F.explode(role).alias("r")).select("bucket", "shorter", "late", "word", "n", "r.*")
    tasks = max(1, -(-entries.count() // task_words))

    def meet(t: pa.Table) -> pa.Table:
        groups: dict[tuple, tuple[list, list]] = {}
        for bucket, shorter, late, word, n, part, asks in zip(*(t[c].to_pylist() for c in ("bucket", "shorter", "late", "word", "n", "part", "asks")), strict=True):
            index, queries = groups.setdefault((bucket, part, shorter, late), ([], []))
            if asks is not True:
                index.append((word, n))
            if asks is not False:
                queries.append(word)
        out: dict[str, list] = {"word": [], "n_near": [], "form_n": [], "form": []}
        for (_, _, shorter, late), (words, queries) in groups.items():
            index, first = PositionIndex(w for w, _ in words), shorter // 2
            for word in queries:
                # two words that are both the longer meet elsewhere; so do, in a bucket of last halves, those of equal first halves
                near = [words[j] for j in index.near(word) if min(len(words[j][0]), len(word)) == shorter and not (late and words[j][0][:first] == word[:first])]
                if near:
                    form, n = min(near, key=lambda x: (-x[1], x[0]))
                    for c, x in zip(out, (word, len(near), n, form), strict=True):
                        out[c].append(x)
        return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()), "form_n": pa.array(out["form_n"], pa.int64()), "form": pa.array(out["form"], pa.string())})

    met = dealt.groupBy(F.pmod(F.xxhash64("bucket", "part"), F.lit(tasks)).alias("task")).applyInArrow(meet, MET)
    best = F.max_by(F.struct("form_n", "form"), F.struct("form_n", "less"))
    return met.withColumn("less", _falling(F.col("form"))).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form_n", "b.form")


def _falling(word: Column) -> Column:
    """An array that falls as the word rises in code-point order, a word's own beginnings coming first."""
    return F.transform(F.concat(F.transform(F.split(word, ""), lambda c: F.ascii(c)), F.array(F.lit(0))), lambda c: -c)


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word, following form (null at the end) to the last. forms: word, form, without circles.

    Each round doubles how far a pointer reaches, and is written to the shared folder."""
    points = saved(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = points.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        if points.join(ahead, "root", "left_semi").isEmpty():
            return points
        points = saved(points.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, shortest: int = 5, least: int = 3, outweighs: int = 2, **options: int) -> DataFrame:
    """Each word of the documents with the word it is a variant of: word, form, root, n, n_near, form_n.

    docs needs doc_id and text; other columns are ignored, whatever their names. Words and n are those of vocabulary. A
    word's form is its near word (exactly one code point inserted, deleted or replaced) of largest n, ties to the smallest
    in code-point order, if that n is at least outweighs (above 1) times its own; else null, as is form_n. root is the
    last of word, its form, that one's form and so on.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each. Words of any
    length are compared whole. No rows, no result rows.
    """
    words = saved(vocabulary(docs, shortest, least), "vocabulary", compression="zstd")
    near = neighbours(words, **options)
    takes = F.col("form_n") >= outweighs * F.col("n")
    known = saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")), "variants")
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")
