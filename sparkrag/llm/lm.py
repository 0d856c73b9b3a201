"""Corpus language-model scores by deleted interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.llm import blocks as B
from sparkrag.llm.hashing import mix, text_slices, word_hashes, words
from sparkrag.session import saved

END = np.uint64(0x9D39247E33776D41)
START = np.uint64(0x2AF7398005AAA5C7)
PAIR = np.uint64(0xC6A4A7935BD1E995)
FREQUENCY_BUCKETS = 12
STEPS = 8


def tokens(texts: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, bounds by row): words, A-Z lower-cased, then one end a row."""
    for lo, hi, data, offsets in text_slices(texts, 2 << 20):
        begin, end, first = words(data, offsets)
        h = word_hashes(data, begin, end, True)
        bounds = first + np.arange(len(first))
        out = np.full(bounds[-1], END, np.uint64)
        out[np.arange(len(h)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = h
        yield lo, hi, out, bounds


def bigrams(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context (the token before it, or a start) and the hash of both."""
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[bounds[:-1]] = START
    return context, mix(context * PAIR + token)


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """By powers of two of a context's frequency; bucket 0: never seen."""
    return np.minimum(np.ceil(np.log2(count + 1)), FREQUENCY_BUCKETS - 1).astype(np.int64)


def _grams(table: pa.Table) -> tuple:
    """A block's tokens, contexts and bigrams, and by row their bounds."""
    parts = [(t, *bigrams(t, b), np.diff(b)) for _, _, t, b in tokens(table["text"])]
    token, context, pair = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return token, context, pair, np.concatenate(([0], np.cumsum(np.concatenate([p[3] for p in parts]))))


def _distinct(table: pa.Table) -> tuple:
    """By row the bounds of a block's tokens, and for tokens and for bigrams: their sorted distinct hashes, where each
    occurrence finds its own, and how often each stands in the training rows."""
    token, _, pair, bounds = _grams(table)
    in_train = np.repeat(np.asarray(table["train"].combine_chunks()).astype(bool), np.diff(bounds))
    out = []
    for h in (token, pair):
        distinct, which = np.unique(h, return_inverse=True)
        out.append((distinct, which, np.bincount(which, in_train, len(distinct)).astype(np.int64)))
    return bounds, *out


def _counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts of every block's n-grams, returned by block, kind (1: tokens, 2: bigrams) and bucket, in the order of
    the sorted hashes; with each bucket's number of distinct training tokens."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                *_, single, double = _distinct(B.from_bytes(payload.as_py()))
                for kind, (h, _, n) in ((1, single), (2, double)):
                    edges = B.bucket_edges(h, buckets)
                    parts = [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b + 1] > edges[b]]
                    yield pa.RecordBatch.from_pydict({
                        "kind": pa.array([kind] * len(parts), pa.int32()), "bucket": pa.array([b for b, *_ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int64()),
                        "n": pa.array([int(e - s) for _, s, e in parts], pa.int32()), "hashes": pa.array([B.planes(np.diff(h[s:e], prepend=np.uint64(0))) for _, s, e in parts], pa.binary()),
                        "counts": pa.array([B.planes(n[s:e]) for _, s, e in parts], pa.binary())})

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(r["block"], r["n"], np.cumsum(B.unplanes(r["hashes"], r["n"], np.uint64)), B.unplanes(r["counts"], r["n"], np.int64)) for t in rows for r in t.to_pylist()]
        h = np.concatenate([r[2] for r in held])
        order = np.argsort(h)
        ranked = h[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        begin = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate([r[3] for r in held])[order], begin)
        got = np.empty(len(h), np.int64)
        got[order] = total[np.cumsum(new) - 1]
        cuts = np.concatenate(([0], np.cumsum([r[1] for r in held])))
        for i, r in enumerate(held):
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([r[0]]), "kind": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([r[1]], pa.int32()),
                "counts": pa.array([B.planes(got[cuts[i]:cuts[i + 1]])], pa.binary()), "seen": pa.array([int((total > 0).sum()) if i == 0 else 0])})

    asked = blocks.select("block", "payload").mapInArrow(ask, "kind int, bucket int, block long, n int, hashes binary, counts binary")
    return saved(asked.groupBy("kind", "bucket").applyInArrow(add, "block long, kind int, bucket int, n int, counts binary, seen long"), "counts")


def _bins(p2: np.ndarray, p1: np.ndarray, floor: float) -> np.ndarray:
    """Places of events on a grid of probability ratios, STEPS to a power of two; 0 in a place means none."""
    two = np.where(p2 > 0, 1 + np.clip(np.rint((np.log2(np.maximum(p2, 1e-300)) + 60) * STEPS), 0, 60 * STEPS), 0)
    one = np.where(p1 > 0, 1 + np.clip(np.rint((np.log2(np.maximum(p1, 1e-300)) + 60) * STEPS), 0, 60 * STEPS), 0)
    return (two * (60 * STEPS + 2) + one).astype(np.int64)


def learn_weights(events: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """By frequency bucket the weights of bigram, token and uniform estimates, by expectation-maximisation.

    events: rows of bucket, grid place and number. Buckets without events get the weights of all events.
    """
    side = 60 * STEPS + 2
    two, one = events[:, 1] // side, events[:, 1] % side
    p = np.stack([np.where(x > 0, 2.0 ** ((x - 1) / STEPS - 60), 0.0) for x in (two, one)] + [np.full(len(events), floor)], 1)

    def fit(rows: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p[rows] * w
            share *= (events[rows, 2] / share.sum(1))[:, None]
            w = share.sum(0) / share.sum()
        return w

    every = fit(np.arange(len(events))) if len(events) else np.array([0.5, 0.4, 0.1])
    out = np.tile(every, (FREQUENCY_BUCKETS, 1))
    for b in range(FREQUENCY_BUCKETS):
        rows = np.flatnonzero(events[:, 0] == b) if len(events) else []
        if len(rows) and events[rows, 2].sum() >= 50:
            out[b] = fit(rows)
    return np.maximum(out, 1e-9) / np.maximum(out, 1e-9).sum(1)[:, None]


def score(docs: DataFrame, train: Column, bucket_bytes: int = 16 << 20) -> DataFrame:
    """log10 probabilities of all whole texts under an add-one token model and an interpolated bigram model, both counted
    on the rows where train holds.

    docs needs doc_id (integer) and text (and what train reads); other columns are ignored, whatever their names. Tokens
    are words, A-Z lower-cased, and one end a text. The bigram model mixes c(v, w) / c(v), c(w) / N and 1 / (V + 1) with
    weights by the frequency of the context v, learned by expectation-maximisation on deleted counts: every training
    token is held out in turn, by taking it from the counts that estimate it. The events enter in classes of equal
    bucket and nearly equal probabilities (an eighth of a power of two), so their table has a fixed bound. Counts cover
    all training texts; nothing is capped. Returns a row for each input row: doc_id, train, n_tokens, n_known,
    train_tokens (N), base_score, score.

    Null and empty texts have one token, the end. Null train counts as false; a null doc_id stays null; repeated rows
    are scored and counted each. Without training rows N is 0 and all tokens are equally unlikely. No rows, no result
    rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = B.pack_blocks(own)
    counts = _counts(blocks, B.bucket_count(blocks, bucket_bytes))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                t = B.from_bytes(payload.as_py())
                yield pa.RecordBatch.from_pydict({"rows": pa.array([int(np.asarray(t["train"].combine_chunks()).sum())], pa.int64())})

    starts = blocks.select("payload").mapInArrow(totals, "rows long").agg(F.sum("rows")).first()[0] or 0
    seen = counts.where("kind = 1").agg(F.sum("seen")).first()[0] or 0

    def look_up(mine: pa.Table, told: pa.Table) -> pa.Table:
        out = {c: [] for c in ("doc_id", "train", "n_tokens", "n_known", "pair", "token")}
        for payload in mine["payload"].to_pylist():
            table = B.from_bytes(payload)
            bounds, (_, which1, _), (_, which2, _) = _distinct(table)
            told = told.sort_by([("kind", "ascending"), ("bucket", "ascending")])
            got = {1: [], 2: []}
            for r in told.select(["kind", "n", "counts"]).to_pylist():
                got[r["kind"]].append(B.unplanes(r["counts"], r["n"], np.int64))
            one, two = (np.concatenate(got[k]) for k in (1, 2))
            c1, c2 = one[which1], two[which2]
            out["doc_id"].append(table["doc_id"].combine_chunks())
            out["train"].append(table["train"].combine_chunks())
            out["n_tokens"].append(np.diff(bounds))
            out["n_known"].append(np.add.reduceat((c1 > 0).astype(np.int64), bounds[:-1]))
            for name, x in (("pair", c2), ("token", c1)):
                out[name] += [B.planes(x[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.table({"doc_id": pa.chunked_array(out["doc_id"], pa.int64()), "train": pa.chunked_array(out["train"], pa.bool_()), "n_tokens": pa.array(np.concatenate(out["n_tokens"]).astype(np.int64)),
                         "n_known": pa.array(np.concatenate(out["n_known"])), **{c: pa.array(out[c], pa.binary()) for c in ("pair", "token")}})

    looked = saved(B.with_side(blocks.select("block", "payload"), counts, look_up, "doc_id long, train boolean, n_tokens long, n_known long, pair binary, token binary"), "token-counts", compression="uncompressed")
    n = looked.where("train").agg(F.sum("n_tokens")).first()[0] or 0
    floor = 1 / (seen + 1)

    def parts(r: dict) -> tuple:
        """Counts of each token's bigram, of its context (that of the token before, or of starts), and its own."""
        pair, token = (B.unplanes(r[c], r["n_tokens"], np.int64) for c in ("pair", "token"))
        return pair, np.append(starts, token[:-1]), token

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = (60 * STEPS + 2) ** 2
        total: dict[int, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                pair, context, token = parts(r)
                key = frequency_bucket(context - 1) * side + _bins((pair - 1) / np.maximum(context - 1, 1), (token - 1) / max(n - 1, 1), floor)
                for k, m in zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True):
                    total[k] = total.get(k, 0) + m
        keys = np.fromiter(total, np.int64, len(total))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys // side), "place": pa.array(keys % side), "n": pa.array(list(total.values()), pa.int64())})

    events = looked.where("train").select("n_tokens", "pair", "token").mapInArrow(deleted, "bucket long, place long, n long").groupBy("bucket", "place").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(events[["bucket", "place", "n"]].to_numpy(np.int64), floor)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = [], []
            for r in batch.select(["n_tokens", "pair", "token"]).to_pylist():
                pair, context, token = parts(r)
                base.append(float(np.log10((token + 1) / (n + seen + 1)).sum()))
                w = weights[frequency_bucket(context)]
                known = context > 0
                p2 = np.where(known, pair / np.maximum(context, 1), 0)
                # A context never seen leaves its share to the others.
                p = w[:, 0] * p2 + w[:, 1] * (token / max(n, 1)) + w[:, 2] * floor
                full.append(float(np.log10(p / np.where(known, 1, 1 - w[:, 0])).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "train", "n_tokens", "n_known")), pa.array([n] * len(base), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())],
                                             names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return looked.mapInArrow(finish, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
