"""Removal of repeated byte strings with sharded suffix arrays.

Every string of ``WINDOW`` bytes is represented by its minimizer: the ``GRAM``-byte substring with the least hash, leftmost of
equals, which depends on the string's bytes only.  Consecutive starts with one minimizer form a stretch.

1. A scan counts minimizers; those that stand at one place only cannot lie in a repeated string.  The others go into a filter of
   bounded size, and a second scan passes on only their stretches, with their bytes, sharded by minimizer: all equal strings
   meet in a shard.
2. In a shard, equal stretches are one, and all strings of one that occurs twice are repeated.  Where a minimizer has different
   stretches, their suffixes are sorted by Larsson-Sadakane refinement: ranks by 8 bytes, then doubled, only unsorted groups
   being sorted again; common prefixes of neighbours follow Kasai, once a run of neighbouring pairs.
3. Minimizers in the hottest places are salted over several shards.  The strings still single there meet the other shards'
   sorted ones, range by range, by binary search.
4. Repeated starts become byte ranges, are gathered for each document and cut out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import materialize, slices, table
from spanweave.llm.keyfilter import key_filter
from spanweave.llm.shingles import mix

WINDOW, GRAM = 200, 48
STEP = 1 << 22  # bytes of a text looked at together
SHARD = 8000  # stretches in a shard, about
HOT = 4000  # places of a minimizer beyond which it is salted
SENT = 65_536  # salted minimizers that are broadcast, at most; more are joined
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, r in enumerate((_R, _R_INV)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, r), dtype=np.uint64)])
    return _POWERS[0][:n], _POWERS[1][:n]


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first start, last start) of the stretches of a text's bytes, in order."""
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, len(data) - WINDOW + 1, STEP):
        part = data[base : base + STEP + WINDOW - 1]
        n, w = len(part), WINDOW - GRAM + 1
        up, down = _powers(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        gram = mix((total[GRAM:] - total[: n - GRAM + 1]) * down[: n - GRAM + 1])
        m = len(gram)
        key = np.full(-(-m // w) * w, np.uint64(2**64 - 1))
        key[:m] = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
        rows = key.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        out.append((gram[at[first]], first + base, last + base))
    if not out:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _regroup(rank: np.ndarray, members: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort ``members`` by (rank, low) and split their groups; the sorted members and whether each begins a group."""
    key = (rank[members].astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, members = key[order], members[order]
    return members, np.concatenate([[True], key[1:] != key[:-1]])


def suffix_classes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` sorted by the ``WINDOW`` bytes at them (ties by place), and whether each differs from the one before.

    Larsson-Sadakane: a position's rank is the place of its group in the order; groups of one need no further sorting.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(WINDOW + 64, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys = (keys << np.uint64(8)) | padded[k : n + k]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.zeros(n + WINDOW + 64, np.int64)  # beyond the end: least
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = place + 1
    alone = new & np.concatenate([new[1:], [True]])
    active, h = order[~alone], 8
    while h < 128 and len(active):
        active, new = _regroup(rank, active, rank[active + h])
        # a group keeps its place; its parts follow each other from there
        begin = np.concatenate([[True], rank[active[1:]] != rank[active[:-1]]])
        index = np.arange(len(active))
        offset = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(begin, index, 0))
        rank[active] = rank[active] + offset
        alone = new & np.concatenate([new[1:], [True]])
        active, h = active[~alone], 2 * h
    return _regroup(rank, starts, rank[starts + WINDOW - 128]) if len(starts) else (starts, np.empty(0, bool))


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each sorted start with the one before it, exact up to ``limit`` (Kasai): only the first of a run of pairs that move on together is compared."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    by_place = np.argsort(order[1:], kind="stable") + 1
    here, before = order[by_place], order[by_place - 1]
    leads = np.concatenate([[True], (here[1:] != here[:-1] + 1) | (before[1:] != before[:-1] + 1)])
    lead = np.flatnonzero(leads)
    size = np.diff(np.concatenate([lead, [len(here)]]))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    a, b, depth = here[lead], before[lead], np.zeros(len(lead), np.int64)
    going, most, end = np.arange(len(lead)), limit + size - 1, len(text)
    while len(going):
        x, y = a[going] + depth[going], b[going] + depth[going]
        ok = (x < end) & (y < end) & (depth[going] < most[going])
        going, x, y = going[ok], x[ok], y[ok]
        same = np.ones(len(going), bool)
        for k in range(8):
            same &= (padded[np.minimum(x + k, end)] == padded[np.minimum(y + k, end)]) & (x + k < end) & (y + k < end)
            depth[going[same]] += 1
        going = going[same]
    run = np.repeat(np.arange(len(lead)), size)
    lcp[by_place] = np.maximum(depth[run] - (np.arange(len(here)) - lead[run]), 0)
    return lcp


def _repeated(strings: list[bytes]) -> list[np.ndarray]:
    """For different stretches, which of their starts hold a string that another start has too."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    base = np.cumsum(size) - size
    valid = np.concatenate([np.arange(b, b + n - WINDOW + 1) for b, n in zip(base, size, strict=True)])
    order, _ = suffix_classes(text, valid)
    far = common_prefixes(text, order, WINDOW) >= WINDOW
    twice = far | np.concatenate([far[1:], [False]])
    hit = np.zeros(len(text), bool)
    hit[order] = twice
    return [hit[b : b + n - WINDOW + 1] for b, n in zip(base, size, strict=True)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _minimizers(src: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [stretches(np.frombuffer(t.as_py(), np.uint8))[0] for t in part.column(0)]
                h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    return src.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _shipped(src: DataFrame, kept) -> DataFrame:
    """Stretches of minimizers in the filter: minimizer, document, first start, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows = pa.array(own, pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), part.column(0).take(rows), part.column(1).take(rows), pa.array(start, pa.int64()), pa.array(data, pa.binary())], names=["gram", "k1", "k2", "start", "data"])
            for x in (own, gram, start, data):
                x.clear()
            return made

        own, gram, start, data = [], [], [], []
        for batch in batches:
            for part in slices(batch, 2):
                size = 0
                for i, t in enumerate(part.column(2)):
                    raw = t.as_py()
                    g, first, last = stretches(np.frombuffer(raw, np.uint8))
                    for k in np.flatnonzero(kept.value.has(g)) if len(g) else ():
                        a = int(first[k])
                        own.append(i)
                        gram.append(int(g[k].view(np.int64)))
                        start.append(a)
                        data.append(raw[a : int(last[k]) + WINDOW])
                        size += len(data[-1])
                        if size > 8 << 20:  # periodic texts have a stretch a byte
                            yield out()
                            size = 0
                yield out()

    return src.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, start long, data binary")


def _sharded(rows: DataFrame, hot: DataFrame, shards: int, many: bool) -> DataFrame:
    """Adds shard and salted (the number of shards that a minimizer's stretches are dealt over)."""
    rows = rows.join(hot if many else F.broadcast(hot), "gram", "left").withColumn("salted", F.coalesce("salts", F.lit(1)))
    dealt = F.when(F.col("salted") > 1, 1 + F.pmod(F.xxhash64("k1", "start"), F.col("salted"))).otherwise(0)
    return rows.select(F.pmod(F.pmod("gram", F.lit(shards)) + dealt, F.lit(shards)).alias("shard"), "gram", "salted", "k1", "k2", "start", "data")


PARTS = 64  # hash ranges for each shard that a hot minimizer is salted over
RANGES = "k1 long, k2 long, first long, last long, part long, strings binary"
STRING = np.dtype([("key", np.uint64), ("k1", np.int64), ("k2", np.int64), ("first", np.int64), ("hit", np.bool_)])


def _in_shards(rows: DataFrame) -> DataFrame:
    """Byte ranges of repeated strings; for salted minimizers also the shard's sorted strings, a row for each minimizer and range of hashes (strings not null)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data, gram, salted = group["data"].to_pylist(), group["gram"].to_pylist(), group["salted"].to_pylist()
        k1, k2, start = group["k1"].to_pylist(), group["k2"].to_pylist(), group["start"].to_pylist()
        places: dict[tuple[int, bytes], list[int]] = {}
        for i, key in enumerate(zip(gram, data, strict=True)):
            places.setdefault(key, []).append(i)
        kinds: dict[int, list[bytes]] = {}
        for g, d in places:
            kinds.setdefault(g, []).append(d)
        several = [(g, d) for g, ds in kinds.items() if len(ds) > 1 for d in ds]
        hits = dict(zip(several, _repeated([d for _, d in several]), strict=True)) if several else {}
        out: list[tuple] = []
        known: dict[tuple[int, int], list[np.ndarray]] = {}
        for key, where in places.items():
            n = len(key[1]) - WINDOW + 1
            hit = np.ones(n, bool) if len(where) > 1 else hits.get(key, np.zeros(n, bool))
            for first, last in _runs(hit):
                out += [(k1[i], k2[i], start[i] + first, start[i] + last + WINDOW, None, None) for i in where]
            if salted[where[0]] > 1:  # one place is enough: where there are more, all are repeated anyway
                i, own = where[0], np.empty(n, STRING)
                own["key"] = [xxhash.xxh3_64_intdigest(key[1][j : j + WINDOW]) for j in range(n)]
                own["k1"], own["k2"], own["first"] = k1[i], k2[i], start[i] + np.arange(n)
                own["hit"] = hit
                known.setdefault((key[0], PARTS * salted[i]), []).append(own)
        for (g, count), parts in known.items():
            own = np.sort(np.concatenate(parts), order="key")
            bound = np.searchsorted((own["key"] >> np.uint64(32)) * np.uint64(count) >> np.uint64(32), np.arange(count + 1, dtype=np.uint64))
            out += [(None, None, None, None, xxhash.xxh3_64_intdigest(f"{g} {p}") >> 1, own[a:b].tobytes()) for p, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if a < b]
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("k1", "k2", "first", "last", "part", "strings"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    return rows.groupBy("shard").applyInArrow(run, RANGES)


def _across_shards(sorted_strings: DataFrame) -> DataFrame:
    """Ranges of strings that are single in their shard and stand in others: each shard's sorted strings are looked up in all of them by binary search."""

    def run(group: pa.Table) -> pa.Table:
        shards = [np.frombuffer(x, STRING) for x in group["strings"].to_pylist()]
        merged = np.sort(np.concatenate([s["key"] for s in shards]))
        found = [s[~s["hit"] & (np.searchsorted(merged, s["key"], "right") - np.searchsorted(merged, s["key"], "left") > 1)] for s in shards]
        got = np.sort(np.concatenate(found), order=("k1", "k2", "first"))
        begin = np.ones(len(got), bool)
        begin[1:] = (got["k1"][1:] != got["k1"][:-1]) | (got["k2"][1:] != got["k2"][:-1]) | (got["first"][1:] > got["first"][:-1] + WINDOW)
        end = np.concatenate([begin[1:], np.ones(min(1, len(got)), bool)])
        return pa.table({"k1": got["k1"][begin], "k2": got["k2"][begin], "first": got["first"][begin], "last": got["first"][end] + WINDOW})

    return sorted_strings.groupBy("part").applyInArrow(run, "k1 long, k2 long, first long, last long")


def repeated_ranges(src: DataFrame) -> DataFrame:
    """(k1, k2, ranges): byte ranges, end exclusive, that repeated strings cover in the rows of ``src`` (k1, k2, text as bytes)."""
    grams = materialize(_minimizers(src).where("n > 1"), "minimizers")
    total = grams.agg(F.sum("n")).first()[0] or 0
    sc = src.sparkSession.sparkContext
    kept = sc.broadcast(key_filter(grams.select("gram")))
    hot = grams.where(f"n > {HOT}").select("gram", (F.ceil(F.col("n") / HOT) + 1).alias("salts"))
    hottest = hot.count()
    found = _in_shards(_sharded(_shipped(src, kept), hot, max(1, math.ceil(total / SHARD)), hottest > SENT))
    if hottest:
        found = materialize(found, "ranges")
        found = found.where("strings is null").select("k1", "k2", "first", "last").union(_across_shards(found.where("strings is not null").select("part", "strings")))
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "spans", "kept")) -> DataFrame:
    """Every row's text without the bytes that repeated strings cover: id and the asked outputs (n_bytes, n_removed, n_spans, spans, kept as bytes, kept_sha256).

    Strings are judged on the input; each row is a text of its own, so repeated rows of at least ``WINDOW`` bytes lose all.
    Null texts are empty; null ids pass through; other columns are not read.  An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    all_ = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    all_ = all_.select("id", F.xxhash64("id", F.col("id").isNull()).alias("k1"), F.xxhash64("t").alias("k2"), F.col("t").cast("binary").alias("text"))
    ranges = repeated_ranges(all_.where(f"octet_length(text) >= {WINDOW}").select("k1", "k2", "text"))
    types = {"n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "spans": ("array<struct<first: bigint, last: bigint>>", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), "kept": ("binary", pa.binary()), "kept_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in outputs}
            for t, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = t.as_py()
                spans = _merged([(r["first"], r["last"]) for r in found or ()])
                kept = b"".join(raw[a:b] for a, b in zip([0] + [y for _, y in spans], [x for x, _ in spans] + [len(raw)], strict=True))
                for k, put in cols.items():
                    put.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept": kept}.get(k) if k not in ("spans", "kept_sha256") else hashlib.sha256(kept).hexdigest() if k == "kept_sha256" else [{"first": a, "last": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types[k][1]) for k, v in cols.items())], names=["__id", *outputs])

    out = all_.join(ranges, ["k1", "k2"], "left").select(F.col("id").alias("__id"), "text", "ranges")
    return out.mapInArrow(run, f"__id {kind}, " + ", ".join(f"{k} {types[k][0]}" for k in outputs)).withColumnRenamed("__id", id_col)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of repeated 200-byte strings: counts and digest."""
    return remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
ORACLE_SQL: dict[str, str] = {}
