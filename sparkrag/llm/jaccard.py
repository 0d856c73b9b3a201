"""Exact n-gram Jaccard join with adaptive multi-match prefixes, down to connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkrag.llm import blocks as B
from sparkrag.llm.components import connected_components
from sparkrag.llm.hashing import gram_hashes, gram_starts, mix, text_slices, word_hashes, words
from sparkrag.llm.held import let_go
from sparkrag.session import saved

ROW_BITS = 18
KEYS = 8
DEPTH = 8
SKETCH_BITS = 23
STEP = 1024
FILTER_BITS = 24
#: Of a token that more entries share, pairs are made at once if there are no more than entries.
FEW = 32
NARROW, WIDE = 256, 1024
CHUNK = 2048


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes by row, bounds by row); a text of fewer than k words is one
    shingle of its own length, one without words has none."""
    for lo, hi, data, offsets in text_slices(texts):
        begin, end, first = words(data, offsets)
        h = word_hashes(data, begin, end, True)
        at = gram_starts(first, k)
        g = gram_hashes(h, k)[at] if len(at) else np.zeros(0, np.uint64)
        n_words = np.diff(first)
        count = np.maximum(n_words - k + 1, 0)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            count[short] = 1
            full = np.zeros(int(count.sum()), np.uint64)
            bounds = np.concatenate(([0], np.cumsum(count)))
            own = np.zeros(len(full), bool)
            own[bounds[short]] = True
            full[~own] = g
            for size in range(1, k):
                rows = short[n_words[short] == size]
                if len(rows):
                    full[bounds[rows]] = mix(gram_hashes(h, size)[first[rows]] + np.uint64(size))
            g = full
        else:
            bounds = np.concatenate(([0], np.cumsum(count)))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            g[s:e].sort()
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        new[bounds[:-1][count > 0]] = True
        total = np.concatenate(([0], np.cumsum(new)))
        yield lo, hi, g[new], total[bounds]


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _describe(blocks: DataFrame, k: int) -> DataFrame:
    """vid, doc_id, n, two 64-bit sums over the set's hashes, and KEYS min-hashes of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                table = B.from_bytes(payload.as_py())
                parts = []
                for lo, hi, g, bounds in shingle_sets(table["text"], k):
                    n = np.diff(bounds)
                    cols = np.zeros((KEYS + 2, hi - lo), np.uint64)
                    full = np.flatnonzero(n)
                    if len(full):
                        at = bounds[:-1][full]
                        cols[0, full] = np.add.reduceat(mix(g), at)
                        cols[1, full] = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), at)
                        for j in range(KEYS):
                            cols[j + 2, full] = np.minimum.reduceat(mix(g + np.uint64((j + 1) * 0x2545F4914F6CDD1D % 2**64)), at)
                    parts.append((n, cols))
                n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                cols = np.concatenate([p[1] for p in parts], 1).view(np.int64) if parts else np.zeros((KEYS + 2, 0), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((block << ROW_BITS) + np.arange(len(n))), table["doc_id"].combine_chunks(), pa.array(n.astype(np.int64)), pa.array(cols[0]), pa.array(cols[1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * KEYS), pa.array(cols[2:].T.reshape(-1)))],
                    names=["vid", "doc_id", "n", "sig1", "sig2", "keys"])

    return saved(blocks.select("block", "payload").mapInArrow(describe, "vid long, doc_id long, n long, sig1 long, sig2 long, keys array<long>"), "shingle-sets")


def _frequency_sketch(blocks: DataFrame, k: int, ranges: int = 16) -> np.ndarray:
    """Counts c of shingles by hash cell over all documents, as STEP * log2(1 + c): 2**SKETCH_BITS cells of two bytes,
    whatever the input's size."""
    width = (1 << SKETCH_BITS) // ranges

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for payload in batch.column("payload"):
                for _, _, g, _ in shingle_sets(B.from_bytes(payload.as_py())["text"], k):
                    cell, n = np.unique((g >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
                    total[cell] += n.astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"r": pa.array(range(ranges), pa.int32()), "body": pa.array([B.planes(total[r * width:(r + 1) * width]) for r in range(ranges)], pa.binary())})

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for t in parts:
            for body in t["body"].to_pylist():
                total += B.unplanes(body, width, np.uint32)
        yield pa.RecordBatch.from_pydict({"r": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([B.planes((STEP * np.log2(1 + total)).astype(np.uint16))], pa.binary())})

    got = {r["r"]: B.unplanes(bytes(r["body"]), width, np.uint16) for r in blocks.select("payload").mapInArrow(count, "r int, body binary").groupBy("r").applyInArrow(merge, "r int, body binary").collect()}
    return np.concatenate([got[r] for r in range(ranges)]) if got else np.zeros(1 << SKETCH_BITS, np.uint16)


def levels_of(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """By how many powers of two of a unit each cell's count exceeds what chance makes of the usual load, and the unit."""
    parts = np.array_split(counts, 64)  # numpy widens what it counts and looks up, so not all cells at once
    many = np.cumsum(sum(np.bincount(p, minlength=1 << 16) for p in parts))
    each = 2.0 ** (np.arange(1 << 16) / STEP) - 1
    usual = float(each[np.searchsorted(many, many[-1] / 2)])
    unit = 1 + usual**0.5
    level = np.floor(np.log2(1 + np.maximum(each - usual - 3 * usual**0.5, 0) / unit)).astype(np.uint8)
    return np.concatenate([level[p] for p in parts]), unit


def prefix(g: np.ndarray, levels: np.ndarray, unit: float, percent: int) -> tuple[np.ndarray, int]:
    """The tokens of a set's longest prefix in order, and the number of matches it asks for.

    The order is common to all sets: by the level of the estimated frequency, then by hash. A set of n that needs overlap t has an l-match prefix of n - t + l tokens, and two sets that
    reach t share at least l tokens of their l-match prefixes. Of l up to DEPTH, the one of least estimated cost is
    asked for: reading the postings of the prefix beside sets of equal size, and verifying at most that many candidates
    divided by l.
    """
    level = levels[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")  # sets stand sorted by hash
    n, t = len(g), int(_needed(len(g), percent))
    most = min(DEPTH, t)
    own = order[:n - t + most]
    read = np.cumsum((2.0 ** level[own] - 1) * unit + 1)
    like = n + 2 * percent * n // -(100 + percent)  # what a set of n leaves open beside one of its own size
    cost = [read[like + m - 1] * (1 + n / 64 / m) for m in range(1, most + 1)]
    return g[own], 1 + int(np.argmin(cost))


def _entries(blocks: DataFrame, side: DataFrame, k: int, percent: int, buckets: int, levels, unit: float) -> DataFrame:
    """Prefix entries of the class representatives in side (block, vid, part), packed by block and hash bucket."""

    def emit(own: pa.Table, reps: pa.Table) -> pa.Table:
        out = {"bucket": [], "n": [], "docs": [], "tokens": [], "which": [], "places": [], "table": []}
        for payload in own["payload"].to_pylist() if len(reps) else []:
            vids = np.asarray(reps["vid"]).astype(np.int64)
            rank = np.argsort(vids)
            wanted, parts = vids[rank] & ((1 << ROW_BITS) - 1), np.asarray(reps["part"]).astype(np.int64)[rank]
            tokens, which, places, docs, table = [], [], [], [], B.from_bytes(payload)["text"].combine_chunks().take(pa.array(wanted))
            for lo, hi, g, bounds in shingle_sets(table, k):
                for r in range(lo, hi):
                    got, asks = prefix(g[bounds[r - lo]:bounds[r - lo + 1]], levels.value, unit, percent)
                    tokens.append(got)
                    places.append(np.arange(len(got)))
                    which.append(np.full(len(got), r))
                    docs.append((vids[rank[r]], bounds[r - lo + 1] - bounds[r - lo], asks, parts[r]))
            token, place, doc = np.concatenate(tokens), np.concatenate(places), np.concatenate(which)
            table = np.array(docs, np.int64)
            order = np.argsort(token, kind="stable")
            edges = B.bucket_edges(token[order], buckets)
            for b in range(buckets):
                at = np.sort(order[edges[b]:edges[b + 1]])
                if len(at):
                    seen, local = np.unique(doc[at], return_inverse=True)
                    out["bucket"].append(b)
                    out["n"].append(len(at))
                    out["docs"].append(len(seen))
                    out["tokens"].append(token[at].tobytes())
                    out["which"].append(B.planes(np.diff(local, prepend=0).astype(np.uint32)))
                    out["places"].append(B.planes(place[at].astype(np.uint32)))
                    out["table"].append(B.planes(np.ascontiguousarray(table[seen].T).reshape(-1)))
        types = {"bucket": pa.int32(), "n": pa.int32(), "docs": pa.int32()}
        return pa.table({c: pa.array(v, types.get(c, pa.binary())) for c, v in out.items()})

    return B.with_side(blocks.select("block", "payload"), side, emit, "bucket int, n int, docs int, tokens binary, which binary, places binary, table binary")


def _group_pairs(size: np.ndarray, begin: np.ndarray, part: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by token, which stand by rising set size: pairs (earlier, later) of different parts and sizes near enough,
    and the entries of tokens put off.

    A token of g entries gives its pairs at once if they are no more than max(FEW, g), so that all pairs stay in
    proportion to the entries; any other is put off as a whole.
    """
    none = np.zeros(0, np.int64)
    if not len(size):
        return none, none, none
    mixed = np.minimum.reduceat(part, begin) != np.maximum.reduceat(part, begin)
    two = begin[mixed & (size == 2)]
    two = two[n[two] >= _needed(n[two + 1], percent)]
    left, right, later = [two], [two + 1], []
    rest = mixed & (size > 2)
    for s, g in zip(begin[rest].tolist(), size[rest].tolist(), strict=True):
        own, sizes = part[s:s + g], n[s:s + g]
        if g * (g - 1) // 2 > FEW:
            counts = np.unique(own, return_counts=True)[1]
            if (g * g - int((counts * counts).sum())) // 2 > max(FEW, g):
                later.append(np.arange(s, s + g))
                continue
        for j in range(1, g):
            before = np.flatnonzero(own[:j] != own[j])
            before = before[sizes[before] >= _needed(sizes[j], percent)]
            left.append(s + before)
            right.append(np.full(len(before), s + j))
    return np.concatenate(left), np.concatenate(right), np.concatenate(later) if later else none


MATCHES = "token long, a long, b long, shared long, asks long, n long, place long"


def _matches(entries: DataFrame, percent: int) -> DataFrame:
    """What the entries of equal tokens give: pairs (a, b) of representatives of different parts, with the number of
    tokens shared in the prefixes that their sizes call for; and the entries (token, a, n, place, asks) of tokens put
    off.

    Two sets of m and n that overlap in o share at least l of their first m - o + l and n - o + l tokens. l is what the
    larger set asks for, o the least overlap of similar sets of these sizes.
    """

    def match(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, base = {"token": [], "doc": [], "place": []}, 0
        tables = []
        for t in rows:
            for r in t.to_pylist():
                cols["token"].append(np.frombuffer(r["tokens"], np.uint64))
                cols["doc"].append(np.cumsum(B.unplanes(r["which"], r["n"], np.uint32)) + base)
                cols["place"].append(B.unplanes(r["places"], r["n"], np.uint32))
                tables.append(B.unplanes(r["table"], 4 * r["docs"], np.int64).reshape(4, -1))
                base += r["docs"]
        token, doc, place = (np.concatenate(cols[c]).astype(d) for c, d in (("token", np.uint64), ("doc", np.int64), ("place", np.int64)))
        vid, n, asks, part = np.concatenate(tables, 1)
        order = np.argsort(token, kind="stable")
        ranked = token[order]
        start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        size = np.diff(np.append(start, len(ranked)))
        order = order[np.repeat(size > 1, size)]
        size = size[size > 1]
        order = order[np.lexsort((vid[doc[order]], n[doc[order]], np.repeat(np.arange(len(size)), size)))]
        token, doc, place = token[order].view(np.int64), doc[order], place[order]
        a, b, later = _group_pairs(size, np.cumsum(size) - size, part[doc], n[doc], percent)
        x, y = doc[a], doc[b]
        open_ = asks[y] + percent * (n[x] + n[y]) // -(100 + percent)  # l - o
        ok = (place[a] < n[x] + open_) & (place[b] < n[y] + open_)
        pair, count = np.unique(x[ok] << np.int64(32) | y[ok], return_counts=True)
        x, y = pair >> np.int64(32), pair & np.int64(2**32 - 1)
        for lo in range(0, len(pair), 1 << 16):
            i, j = x[lo:lo + (1 << 16)], y[lo:lo + (1 << 16)]
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(vid[i]), pa.array(vid[j]), pa.array(count[lo:lo + len(i)].astype(np.int64)), pa.array(asks[j]), none, none], names=MATCH_NAMES)
        for lo in range(0, len(later), 1 << 16):
            at = later[lo:lo + (1 << 16)]
            i, none = doc[at], pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(vid[i]), none, none, pa.array(asks[i]), pa.array(n[i]), pa.array(place[at])], names=MATCH_NAMES)

    return saved(entries.groupBy("bucket").applyInArrow(match, MATCHES), "matches")


MATCH_NAMES = [c.split()[0] for c in MATCHES.split(", ")]


def _parts_of(df: DataFrame, parts: DataFrame, column: str, name: str) -> DataFrame:
    """df with the part of the representatives in a column; one that is linked with none is a part of its own."""
    known = parts.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return df.join(known, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts after more links between representatives."""
    ends = _parts_of(_parts_of(links, parts, "a", "x"), parts, "b", "y")
    more = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = parts.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return saved(moved.union(more.join(parts, "node", "left_anti").select("node", "root")), "parts")


def sketch(g: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of NARROW cells (WIDE for more than 400 hashes); nothing if a cell
    holds over 255. The sum of the smaller counts of two sets is at least their overlap."""
    counts = np.bincount((g >> np.uint64(64 - (WIDE if len(g) > 400 else NARROW).bit_length() + 1)).astype(np.int64), minlength=WIDE if len(g) > 400 else NARROW)
    return counts.astype(np.uint8).tobytes() if len(g) and counts.max() < 256 else b""


def _cells(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of width cells: wider ones are folded, what is missing counts as full."""
    out = np.full((len(sketches), width), np.iinfo(np.uint16).max if width == NARROW else 255, np.uint16 if width == NARROW else np.uint8)
    for size in (NARROW, WIDE):
        at = [i for i, x in enumerate(sketches) if len(x) == size]
        if at and size >= width:
            rows = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), width, -1)
            out[at] = rows.sum(2) if size > width else rows[:, :, 0]
    return out


def _likely(left: dict, right: dict, largest: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of left, rows of right, room) of the entries of one token that lie in different parts, stand in the prefixes
    that their sizes call for, and may overlap enough by their sketches; room: by how much of the least overlap. Of two
    entries outside the largest part, the one of smaller vid is taken as left."""
    wide = [np.array([len(x) == WIDE for x in side["sketch"]], bool) for side in (left, right)]
    narrow_l, narrow_r = (_cells(side["sketch"], NARROW) for side in (left, right))
    wide_r = _cells(right["sketch"], WIDE) if wide[1].any() else None
    for i, (vid, n, part, place, asks) in enumerate(zip(*(left[c].tolist() for c in ("vid", "n", "part", "place", "asks")), strict=True)):
        m = right["n"]
        need = -(-percent * (n + m) // (100 + percent))
        larger = (m > n) | (m == n) & (right["vid"] > vid)
        l = np.where(larger, right["asks"], asks)  # noqa: E741
        ok = (right["part"] != part) & ((right["part"] == largest) | (right["vid"] > vid)) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
        ok &= (place < n - need + l) & (right["place"] < m - need + l)
        at = np.flatnonzero(ok)
        for lo in range(0, len(at), 4096):
            some = at[lo:lo + 4096]
            most = np.minimum(narrow_r[some], narrow_l[i]).sum(1, dtype=np.int64)
            some, most = some[most >= need[some]], most[most >= need[some]]
            if wide[0][i] and len(some) and wide[1][some].any():
                both = wide[1][some]
                most[both] = np.minimum(wide_r[some[both]], np.frombuffer(left["sketch"][i], np.uint8)).sum(1, dtype=np.int64)
                some, most = some[most >= need[some]], most[most >= need[some]]
            if len(some):
                yield i, some, most / need[some]


def _crowded(put_off: DataFrame, parts: DataFrame, percent: int, every: bool) -> DataFrame:
    """Likely pairs (a, b) among the sets that share tokens put off: all pairs between different parts, or the best two
    of each set outside its token's largest part. Tokens with many entries are dealt out by chunks of both sides."""
    own = _parts_of(put_off, parts, "vid", "part")
    tokens = own.groupBy("token", "part").agg(F.count("*").alias("many")).groupBy("token").agg(
        F.max_by("part", F.struct("many", "part")).alias("largest"), F.count("*").alias("parts"), F.sum("many").alias("g"), (F.sum("many") - F.max("many")).alias("outside"))
    tokens = saved(tokens.where("parts > 1").select("token", "largest", F.ceil(F.col("outside") / CHUNK).alias("rows"), F.ceil(F.col("g") / (4 * CHUNK)).alias("columns")), "tokens-left")
    entry = ["vid", "n", "place", "asks", "part", "largest", "sketch"]

    def likely(table: pa.Table, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [{c: x[c].to_pylist() if c == "sketch" else x[c].to_numpy() for c in entry} for x in (left, right)]
        out = {"x": [], "y": [], "room": []}
        for i, at, room in _likely(*sides, int(table["largest"][0].as_py()), percent):
            if not every and len(at) > 2:
                best = np.lexsort((sides[1]["vid"][at], -room))[:2]
                at, room = at[best], room[best]
            out["x"].append(np.full(len(at), sides[0]["vid"][i]))
            out["y"].append(sides[1]["vid"][at])
            out["room"].append(room)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, t) for (c, v), t in zip(out.items(), (np.int64, np.int64, float), strict=True)})

    def whole(table: pa.Table) -> pa.Table:
        return likely(table, table.filter(pc.not_equal(table["part"], table["largest"])), table)

    def chunk(table: pa.Table) -> pa.Table:
        return likely(table, table.filter(table["is_left"]), table.filter(pc.invert(table["is_left"])))

    found = "x long, y long, room double"
    few = "rows = 1 and columns = 1"
    met = own.join(tokens.where(few), "token").select("token", *entry).groupBy("token").applyInArrow(whole, found)
    if not tokens.where(f"not ({few})").isEmpty():
        many = own.join(tokens.where(f"not ({few})"), "token")
        nth = lambda n: F.pmod(F.xxhash64("vid"), F.col(n))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = many.where("part <> largest").select("token", nth("rows").alias("i"), upto("columns").alias("j"), F.lit(True).alias("is_left"), *entry)
        right = many.select("token", upto("rows").alias("i"), nth("columns").alias("j"), F.lit(False).alias("is_left"), *entry)
        met = met.union(left.union(right).groupBy("token", "i", "j").applyInArrow(chunk, found))
    met = met.groupBy("x", "y").agg(F.max("room").alias("room"))
    if not every:
        met = met.withColumn("nth", F.row_number().over(W.partitionBy("x").orderBy(F.desc("room"), "y"))).where("nth <= 2")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sparse(matches: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different parts that share as many tokens as are asked for, none of them put off."""
    met = matches.where("token is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("asks").alias("asks")).where("shared >= asks")
    return _parts_of(_parts_of(met.select("a", "b"), parts, "a", "x"), parts, "b", "y").where("x <> y").select("a", "b")


def _read_rows(blocks: DataFrame, vids: DataFrame, label: str, schema: str, fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """vid and what fn makes of the texts of the documents named (vid); a filter of fixed size spares most others."""
    spark, bits = blocks.sparkSession, 1 << FILTER_BITS
    vids = vids.select(F.pmod(F.xxhash64("vid"), F.lit(bits)).alias("cell"))
    maps = vids.groupBy(F.expr("bitmap_bucket_number(cell + 1)").alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bitmap")).collect()
    filled = np.zeros(bits + (1 << 16), bool)
    for r in maps:
        own = np.unpackbits(np.frombuffer(bytes(r["bitmap"]), np.uint8), bitorder="little").astype(bool)
        filled[(r["nth"] - 1) * len(own):r["nth"] * len(own)] = own
    shared = spark.sparkContext.broadcast(np.packbits(filled).tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for payload, cells, vid in zip(batch.column("payload"), batch.column("cells"), batch.column("vids"), strict=True):
                c = np.asarray(cells.values)
                at = np.flatnonzero(kept[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1)
                if len(at):
                    table = B.from_bytes(payload.as_py())
                    for lo in range(0, len(at), 512):
                        some = pa.array(at[lo:lo + 512])
                        yield pa.RecordBatch.from_arrays([vid.values.take(some), fn(table["text"].combine_chunks().take(some))], names=["vid", label])

    vids_of = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda r: F.shiftleft("block", ROW_BITS) + r)
    own = blocks.where("n > 0").select("payload", vids_of.alias("vids")).withColumn("cells", F.transform("vids", lambda v: F.pmod(F.xxhash64(v), F.lit(bits))))
    return saved(own.mapInArrow(read, f"vid long, {label} {schema}"), f"pair-{label}", compression="zstd")


def _texts(blocks: DataFrame, vids: DataFrame) -> DataFrame:
    return _read_rows(blocks, vids, "text", "string", lambda texts: texts)


def _sketches(blocks: DataFrame, vids: DataFrame, k: int) -> DataFrame:
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(g[s:e]) for _, _, g, b in shingle_sets(texts, k) for s, e in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)], pa.binary())

    return _read_rows(blocks, vids, "sketch", "binary", told)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("vid")).union(pairs.select("b"))


def _verified(blocks: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity."""
    texts = _texts(blocks, _ends(pairs))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = sum(np.asarray(pc.binary_length(whole.column(c))).astype(np.int64) for c in ("ta", "tb"))
            ends, lo = np.cumsum(size), 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (4 << 20), "right")))
                batch, lo = whole.slice(lo, hi - lo), hi
                sets = []
                for side in ("ta", "tb"):
                    own = []
                    for _, _, g, bounds in shingle_sets(batch.column(side), k):
                        own += [g[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    sets.append(own)
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = np.concatenate((x, y))
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    keep.append(len(both) > 0 and 100 * inter >= percent * (len(both) - inter))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.join(texts.select(F.col("vid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("vid").alias("b"), F.col("text").alias("tb")), "b")
    return saved(joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "similar")


def _linked(blocks: DataFrame, k: int, percent: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(vid, doc_id, n, root) of all rows with shingles, and (vid, doc_id, n) of those without."""
    sets = _describe(blocks, k)
    classes = sets.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min_by(F.struct("vid", "keys"), "vid").alias("x"))
    classes = saved(classes.select("sig1", "sig2", "n", F.col("x.vid").alias("node"), F.col("x.keys").alias("keys")), "classes")

    keyed = classes.select("node", "n", F.posexplode("keys").alias("j", "key"))
    # Hubs of a min-hash: the class whose min-hashes are the commonest, most like an original, and one at random. Similar
    # sets share most min-hashes; the rare ones with fewer than three in common are left to the prefixes.
    many = saved(keyed.groupBy("j", "key").agg(F.count("*").alias("many")).where("many > 1"), "min-hashes")
    common = keyed.join(many, ["j", "key"])
    usual = common.groupBy("node").agg(F.sum("many").alias("usual"))
    ranked = saved(common.join(usual, "node").select("j", "key", "node", "n", "usual"), "keyed")
    random = F.xxhash64("node", "j")
    hubs = ranked.groupBy("j", "key").agg(
        F.min(F.struct((-F.col("usual")).alias("u"), "node", "n")).alias("h0"), F.min(F.struct(random.alias("r"), "node", "n")).alias("h1"))
    hubs = saved(hubs.select("j", "key", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "h0.node", "h0.n"), F.struct(F.lit(1).alias("kind"), "h1.node", "h1.n"))).alias("h")).select("j", "key", "h.kind", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    near = ranked.join(hubs, ["j", "key"]).where((F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")))
    near = saved(near.select("node", "hub", "kind"), "near-hubs").groupBy("node", "hub", "kind").agg(F.count("*").alias("equal")).where("equal > 2")
    best = near.withColumn("nth", F.row_number().over(W.partitionBy("node", "kind").orderBy(F.desc("equal"), "hub"))).where("nth = 1")
    pairs = saved(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "hub-pairs")
    parts = saved(connected_components(_verified(blocks, pairs, k, percent)), "parts")

    levels, unit = levels_of(_frequency_sketch(blocks, k))
    shared = blocks.sparkSession.sparkContext.broadcast(levels)
    side = classes.select("node").join(parts, "node", "left").select(F.shiftright("node", ROW_BITS).alias("block"), F.col("node").alias("vid"), F.coalesce("root", "node").alias("part"))
    entries = _entries(blocks, side, k, percent, B.bucket_count(blocks, bucket_bytes), shared, unit)
    matches = _matches(entries, percent)
    put_off = matches.where("token is not null").withColumnRenamed("a", "vid").select("token", "vid", "n", "place", "asks")
    put_off = saved(put_off.join(_sketches(blocks, put_off.select("vid"), k), "vid"), "sketched")
    for every in (False, True):
        pairs = _crowded(put_off, parts, percent, every)
        if every:
            pairs = pairs.union(_sparse(matches, parts)).distinct()
        parts = _merged(parts, _verified(blocks, saved(pairs, "candidates"), k, percent))
    roots = parts
    named = classes.select("sig1", "sig2", F.col("n").alias("size"), "node").join(roots, "node", "left").select("sig1", "sig2", "size", F.coalesce("root", "node").alias("root"))
    named = saved(named, "named")
    own = sets.select("vid", "doc_id", "n", "sig1", "sig2")
    linked = saved(own.where("n > 0").withColumn("size", F.col("n")).join(named, ["sig1", "sig2", "size"]).select("vid", "doc_id", "n", "root"), "linked")
    return linked, own.where("n = 0").select("vid", "doc_id", "n")


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 75, bucket_bytes: int = 6 << 20) -> DataFrame:
    """Each row's number of shingles and the group it is linked into: sets of k-word shingles (A-Z lower-cased) whose
    Jaccard similarity is percent / 100 or more are linked.

    docs needs doc_id (integer) and text; other columns are ignored, whatever their names. Equal sets are one class.
    First, classes that share a min-hash are compared with a hub of theirs, which joins most near copies in few
    comparisons. Then all classes meet by multi-match prefixes whose length each sets by estimated cost (see prefix);
    pairs already in one group are left out, as they cannot change it. Tokens that many share are put off: their sets
    meet by sketches that never underestimate an overlap, first each with its likeliest partners, then, in the groups
    so joined, with all that are left. All candidates are verified on whole sets of 64-bit hashes. Returns a row for each input row: doc_id, n_shingles, component_id (smallest doc_id of the group).

    Null, empty and wordless texts have no shingles and are linked with nothing; texts of fewer than k words have one,
    the whole sequence. A null doc_id is linked as any, but never names a group that has another id. Repeated rows are
    copies. No rows, no result rows.
    """
    blocks = B.pack_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    linked, alone = _linked(blocks, k, percent, bucket_bytes)
    lowest = saved(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    out = linked.join(lowest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(alone.select("doc_id", "n", "doc_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 75, bucket_bytes: int = 6 << 20) -> DataFrame:
    """docs with one row of each group of similar_groups: that of the smallest doc_id (null last), the first of repeated
    ones. Rows without shingles all stay. All columns are returned as they were."""
    schema = docs.schema
    blocks = B.pack_blocks(docs)
    linked, alone = _linked(blocks, k, percent, bucket_bytes)
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "vid")).alias("x")).select("x.vid")
    kept = best.union(alone.select("vid")).select(F.shiftright("vid", ROW_BITS).alias("block"), F.col("vid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"))

    def pick(own: pa.Table, rows: pa.Table) -> pa.Table:
        at = pa.array(np.sort(np.asarray(rows["row"]).astype(np.int64)))
        parts = [B.from_bytes(p).take(at) for p in own["payload"].to_pylist()]
        return pa.concat_tables(parts) if parts else to_arrow_schema(schema).empty_table()

    return B.with_side(blocks.select("block", "payload"), kept, pick, schema)
