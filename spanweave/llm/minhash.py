"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One scan makes, for each text, its shingle-set size, a 128-bit key of the set, a MinHash signature and its band keys.
   Texts with equal sets form one class, led by its smallest id; one text of each class goes on.
2. Leaders that share a band key are candidates.  Small buckets give their pairs (at most ``SMALL / 2`` a member).  In larger
   ones members are paired with a few hubs, picked by minimum hash with partial aggregation, so a bucket with a third of all
   rows costs a few pairs a member.  After ``ROUNDS`` such rounds, what still stands apart from its bucket's main component is
   held against every member, block by block, where only a link to another component is given out: no link is lost, and no
   group ever gives all its pairs.
3. A candidate pair is compared batch by batch of signature positions; it is dropped once the posterior probability that its
   similarity reaches the threshold falls below ``MISS``.
4. Survivors are confirmed on full shingle sets with integer arithmetic.  Components join over confirmed links, and over ids
   that have several texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import materialize, slices, table
from spanweave.llm.components import connected_components
from spanweave.llm.shingles import mix, shingle_set

ROWS = 4  # signature positions in a band
BAND_MISS = 1e-6  # chance that a pair at the threshold shares no band
MISS = 1e-6  # chance that pruning drops a pair at or above the threshold
BATCH = 16  # signature positions looked at before each pruning decision
SMALL = 24  # buckets up to this size give all their pairs
HUBS = 3
ROUNDS = 1  # beyond the first
BLOCK = 2000  # members that are held against each other at a time


def bands_for(percent: int) -> int:
    """Bands that keep the chance of a missed pair at the threshold under ``BAND_MISS``."""
    return math.ceil(math.log(BAND_MISS) / math.log(1 - (percent / 100) ** ROWS))


def least_matches(percent: int, size: int) -> list[tuple[int, int]]:
    """(positions seen, fewest matches to go on) after each batch, from the posterior Beta(m + 1, n - m + 1) of a uniform prior."""
    t, out = percent / 100, []
    for n in range(BATCH, size + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS:  # P(Beta(m + 1, n - m + 1) >= t) is the chance of at most m successes in n + 1 trials
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures (32 bits a position) of the sets; of an empty set all ones."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    a = rng.integers(1 << 62, (1 << 64) - 1, size, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, (1 << 64) - 1, size, dtype=np.uint64)
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        for at in range(0, len(s), 4096):  # long sets in pieces, so memory stays bounded
            h = (s[at : at + 4096, None] * a + b) >> np.uint64(32)
            np.minimum(out[i], h.min(0).astype(np.uint32), out=out[i])
    return out


def _profiles(df: DataFrame, id_col: str, text_col: str, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows=512):
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                sig = signatures(sets, bands * ROWS)
                key = np.zeros((len(sets), bands), np.uint64)
                for j in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::ROWS][:, :bands] + np.uint64(j + 1))
                key = mix(key + np.arange(bands, dtype=np.uint64))
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                        pa.array([k if f else None for k, f in zip(key.view(np.int64), full, strict=True)], pa.list_(pa.int64())),
                        pa.array([s.tobytes() if f else None for s, f in zip(sig, full, strict=True)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_key", "bands", "sig"],
                )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>, sig binary")


def _pruned(pairs: DataFrame, sigs: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose signatures leave the threshold likely enough."""
    steps = least_matches(percent, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(k)), np.uint32).reshape(batch.num_rows, size) for k in (2, 3))
            alive, seen, same = np.arange(batch.num_rows), 0, np.zeros(batch.num_rows, np.int32)
            for n, least in steps:
                same[alive] += (x[alive, seen:n] == y[alive, seen:n]).sum(1, dtype=np.int32)
                alive, seen = alive[same[alive] >= least], n
            yield batch.select([0, 1]).take(pa.array(alive))

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    union = len(np.union1d(x, y))
                    if 100 * (len(x) + len(y) - union) >= percent * union:
                        keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _hashes(df: DataFrame) -> DataFrame:
    """(id, hashes) of the rows (id, set_key, text) whose text has that set: an id's other texts are of other classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, rows=512):
                sets = [shingle_set(t.as_py()).tobytes() for t in part.column(2)]
                own = [i for i, (s, k) in enumerate(zip(sets, part.column(1), strict=True)) if xxhash.xxh3_128_digest(s) == k.as_py()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), pa.array([sets[i] for i in own], pa.binary())], names=["id", "hashes"])

    return df.select("id", "set_key", "text").mapInArrow(run, "id long, hashes binary")


def _picked(prefix: str, seed: int) -> list:
    return [F.min_by("id", F.xxhash64(F.lit(seed * 31 + i), "id")).alias(f"{prefix}{i}") for i in range(HUBS)]


def _apart(large: DataFrame, comp: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Members (band, at, id, c: component), and those outside their band's largest component, with members of that as hubs."""
    named = large.select("band", "at", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("band", "at", "id", F.coalesce("component", "id").alias("c"))
    part = named.groupBy("band", "c").agg(F.count("*").alias("n"), *_picked("m", seed))
    main = part.groupBy("band").agg(F.max_by(F.struct("c", *[f"m{i}" for i in range(HUBS)]), F.struct("n", "c")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n_all")).where("parts > 1")
    main = main.select("band", "n_all", F.col("top.c").alias("top"), *[F.col(f"top.m{i}").alias(f"h{i}") for i in range(HUBS)])
    return named, named.join(main, "band").where("c <> top")


def _rest(named: DataFrame, apart: DataFrame, full: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) of members apart with members of other components of their bands, at most one for each component and block.

    Blocks of members meet blocks of members apart.  A pair is looked at in the first band it shares; signatures prune it batch
    by batch; survivors are confirmed on full sets, all of one member's at a time by counting over postings.
    """
    steps = least_matches(percent, size)
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    few = apart.groupBy("band").agg(F.max("n_all").alias("n_all"), F.count("*").alias("n_apart")).select("band", F.ceil(F.col("n_all") / BLOCK).alias("xs"), F.ceil(F.col("n_apart") / BLOCK).alias("ys"))
    x = named.join(few, "band").select("band", "at", "id", "c", dealt(F.col("xs")).alias("x"), F.explode(F.sequence(F.lit(0), (F.col("ys") - 1).cast("int"))).alias("y"), F.lit(0).alias("side"))
    y = apart.select("band", "at", "id", "c").join(few, "band").select("band", "at", "id", "c", F.explode(F.sequence(F.lit(0), (F.col("xs") - 1).cast("int"))).alias("x"), dealt(F.col("ys")).alias("y"), F.lit(1).alias("side"))
    rows = x.union(y).join(full, "id").select(F.xxhash64("band", "x", "y").alias("key"), "at", "id", "c", "side", "sig", "hashes")

    def run(group: pa.Table) -> pa.Table:
        side, ids, comp = (group[k].to_numpy() for k in ("side", "id", "c"))
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, size)
        sets = [np.frombuffer(h, np.uint64) for h in group["hashes"].to_pylist()]
        own = np.flatnonzero(side == 0)
        at, out = group["at"][0].as_py(), []
        length = np.array([len(sets[i]) for i in own])
        words, place = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
        owner = np.repeat(np.arange(len(own)), length)[np.argsort(place, kind="stable")]
        bound = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(words)))])
        for u in np.flatnonzero(side == 1):
            alive = np.flatnonzero(comp[own] != comp[u])
            same = sig[own[alive]] == sig[u]
            shared = same.reshape(len(alive), -1, ROWS).all(2)
            ok = shared[:, at] & ~shared[:, :at].any(1)
            for n, least in steps:
                ok &= same[:, :n].sum(1) >= least
            alive = alive[ok]
            if not len(alive):
                continue
            k = np.searchsorted(words, sets[u])
            k = k[(k < len(words)) & (words[np.minimum(k, len(words) - 1)] == sets[u])]
            posts = np.concatenate([owner[bound[i] : bound[i + 1]] for i in k]) if len(k) else np.empty(0, np.int64)
            both = np.bincount(posts, minlength=len(own))[alive]
            hit = alive[100 * both >= percent * (len(sets[u]) + length[alive] - both)]
            _, first = np.unique(comp[own[hit]], return_index=True)
            out += [(int(ids[u]), int(ids[own[j]])) for j in hit[first]]
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return rows.groupBy("key").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (smallest id reachable over links), kept (its own id is that).

    A link joins texts with 100 * intersection >= ``percent`` * union of their distinct 5-word shingles; a text of fewer words
    is one shingle, and one without words (or null) links with nothing.  Ids are long; repeated ids are one document whose rows
    all stay in the result and which any of its texts links; a null id links with nothing, has a null component and is kept.  Other columns are not read, so
    their names cannot clash.  An empty table gives an empty result.
    """
    bands = bands_for(percent)
    prof = materialize(_profiles(df, id_col, text_col, bands), "profiles")
    # a class is a node of its own, as the least id of several classes can be the same one
    led = prof.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("lead"))
    led = materialize(led.withColumn("node", F.monotonically_increasing_id()), "classes")
    # bands and signature of the leader: any row of the class has the same ones
    of = led.select("lead", F.col("set_key").alias("key"), "node")
    lead = of.join(prof, (F.col("lead") == F.col("id")) & (F.col("key") == F.col("set_key"))).select(F.col("node").alias("id"), "bands").dropDuplicates(["id"])
    member = materialize(lead.select("id", F.posexplode("bands").alias("at", "band")).groupBy("band", "at", "id").agg(F.lit(1).alias("one")).select("band", "at", "id"), "members")
    stat = member.groupBy("band").agg(F.count("*").alias("n"), *_picked("h", 0)).where("n > 1")
    bucket = materialize(member.join(stat, "band"), "buckets")
    cand = bucket.select("id").distinct()
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = of.join(cand.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("lead").alias("id"), F.col("key").alias("set_key"), "node")
    sigs = materialize(asked.join(prof.select("id", "set_key", "sig"), ["id", "set_key"]).select(F.col("node").alias("id"), "sig").dropDuplicates(["id"]), "signatures")
    rows = src.where("id is not null").join(asked, "id").select(F.col("node").alias("id"), "set_key", "text")
    sets = materialize(_hashes(rows).dropDuplicates(["id"]), "sets")
    size = bands * ROWS

    # small buckets: all pairs, a bounded number for each member; larger ones: pairs with hubs
    few = bucket.where(f"n <= {SMALL}").groupBy("band").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = few.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    large = bucket.where(f"n > {SMALL}")
    tried = materialize(few.union(_to_hubs(large)).distinct(), "pairs")
    links = materialize(_confirmed(_pruned(tried, sigs, percent, size), sets, percent), "links")
    comp = connected_components(links)
    if not large.isEmpty():
        for k in range(1, ROUNDS + 1):
            _, apart = _apart(large, materialize(comp, "components"), k)
            new = materialize(_to_hubs(apart).distinct().join(tried, ["a", "b"], "left_anti"), "more_pairs")
            links = links.union(materialize(_confirmed(_pruned(new, sigs, percent, size), sets, percent), "more_links"))
            comp = connected_components(links)
        named, apart = _apart(large, materialize(comp, "components"), ROUNDS + 1)
        links = links.union(materialize(_rest(named, apart, sigs.join(sets, "id"), percent, size), "rest_links"))
        comp = connected_components(links)
    # from classes to ids: links join the classes' leaders, and an id with several texts joins the leaders of all of them
    links = comp.join(led.select("node", F.col("lead").alias("a")), "node").join(led.select(F.col("node").alias("component"), F.col("lead").alias("b")), "component").select("a", "b")
    blank = F.lit(b"")
    several = materialize(prof.where("id is not null").groupBy("id").agg(F.min(F.coalesce("set_key", blank)).alias("x"), F.max(F.coalesce("set_key", blank)).alias("y")).where("x <> y").select("id"), "several")
    texts = prof.where("set_key is not null").join(several, "id", "left_semi").select("id", "set_key").distinct().join(led, "set_key")
    comp = materialize(connected_components(links.union(texts.select("id", "lead"))), "id_components")
    # classes with several members or links carry their component; every other text is its own, one without words its id's
    label = led.join(comp.withColumnRenamed("node", "lead"), "lead", "left").select("set_key", F.coalesce("component", "lead").alias("component_id"))
    bare = several.join(comp.withColumnRenamed("node", "id"), "id").select("id", "component")
    out = prof.select("id", "n_shingles", "set_key").join(label, "set_key", "left").join(bare, "id", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, but for documents that a smaller id of their component stands for.  Null ids stay."""
    found = near_duplicates(df, percent, id_col, text_col)
    return df.join(found.where("not kept").select(F.col(id_col)).distinct(), id_col, "left_anti").select(*df.columns)


def _to_hubs(rows: DataFrame) -> DataFrame:
    """Pairs of each row's id with its bucket's hubs."""
    return rows.select("id", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("h")).where("id <> h").select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}

#: The definition itself: exact links of all pairs that share a shingle, then reachability.
ORACLE_SQL = {
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.g FROM s SEMI JOIN r USING (g)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(node, comp) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, min(c.comp) FROM c JOIN e ON e.a = c.node JOIN recurring.c q ON q.node = e.b WHERE c.comp < q.comp GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id, d.doc_id = c.comp AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id""",
}
