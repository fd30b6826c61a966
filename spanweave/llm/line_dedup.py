"""Line deduplication by a deletion-neighbourhood join.

Lines are word sequences (words end at ASCII white space).  The edit bound is one word inserted, deleted or replaced for lines of
at least ``MIN_WORDS`` words, and none for shorter ones; blank lines never count.  A line goes if an equal line, or one within
the bound, stands earlier (smaller document id, then smaller line number) in the corpus; the earliest stays.

1. One scan gives every line's 128-bit key.  Equal lines meet by key, reduced to their earliest place by partial aggregation.
2. With one edit, either the first or the second half of a line is untouched.  Half keys that several different lines have are
   counted exactly and put into a filter of bits of bounded size; a second scan passes on only lines with such a half.  The
   filter can only let too much through, never too little.
3. A passed line emits all its variants with one word deleted, as hashed keys, and itself.  Equal variants join: two lines with
   the same variant of the same place differ by one replacement; a line that equals a variant of another by one insertion.  Groups
   are reduced to their earliest member before the join, so no group ever gives all its pairs.
4. The edit distance of a line and its earliest partner is verified on their word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import materialize, slices, table
from spanweave.llm.keyfilter import key_filter
from spanweave.llm.shingles import mix

MIN_WORDS = 8  # words from which on lines may differ by one; a parameter, shorter lines go only when equal
_M = np.uint64(0x9E3779B97F4A7C15)


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the first and second halves, for a partner of at most the line's length and for one that is a word longer."""
    n, out = len(words), []
    for longest in (n, n + 1):
        first = (longest - 1) // 2
        second = longest - 1 - first
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[:first]), longest * 2))
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[n - second :]), longest * 2 + 1))
    return out


def deletion_keys(h: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Keys of the sequences left when one word is deleted, by place, and of the whole sequence; ``h``: word hashes."""
    n = len(h)
    with np.errstate(over="ignore"):
        power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _M), dtype=np.uint64)])
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])  # sum of h[i] M^i
        shifted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[1:] * power[: n - 1], dtype=np.uint64)])  # after a deletion, words move down one place
        return mix(before[:n] + (shifted[n - 1] - shifted[:n]) + np.uint64(n - 1) * _M), mix(before[n : n + 1] + np.uint64(n) * _M)[0]


def within_one_edit(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether one insertion, deletion or replacement at most leads from ``x`` to ``y``."""
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    at = int(differ[0]) if len(differ) else n
    if len(x) == len(y):
        return len(differ) <= 1
    longer, shorter = (x, y) if len(x) > len(y) else (y, x)
    return bool((longer[at + 1 :] == shorter[at:]).all())


def _lines(df: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                doc, no, key, halves = [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    for k, line in enumerate((t.as_py() or b"").split(b"\n")):
                        if words := line.split():
                            doc.append(i)
                            no.append(k)
                            key.append(xxhash.xxh3_128_digest(b" ".join(words)))
                            halves.append(np.array(half_keys(words), np.uint64).view(np.int64) if len(words) >= least else None)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(key, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], names=["doc", "no", "key", "halves"])

    return df.mapInArrow(run, "doc long, no int, key binary, halves array<long>")


def _passed(df: DataFrame, shipped, least: int) -> DataFrame:
    """Lines with a half in the filter: key, place and word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                where, keys = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    for k, line in enumerate((t.as_py() or b"").split(b"\n")):
                        words = line.split()
                        if len(words) >= least:
                            where.append((i, k, words))
                            keys.append(half_keys(words))
                doc, no, key, hashes = [], [], [], []
                if where:
                    for j in np.flatnonzero(shipped.value.has(np.array(keys, np.uint64)).any(1)):
                        i, n, words = where[j]
                        doc.append(i)
                        no.append(n)
                        key.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(key, pa.binary()), pa.array(hashes, pa.binary())], names=["doc", "no", "key", "hashes"])

    return df.mapInArrow(run, "doc long, no int, key binary, hashes binary")


def _variants(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                v, place, count = [], [], []
                for h in part.column(2):
                    gone, whole = deletion_keys(np.frombuffer(h.as_py(), np.uint64))
                    v += [gone.view(np.int64), np.array([whole], np.uint64).view(np.int64)]
                    place += [np.arange(len(gone), dtype=np.int32), np.array([-1], np.int32)]
                    count.append(len(gone) + 1)
                if count:
                    own = pa.array(np.repeat(np.arange(part.num_rows), count))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(np.concatenate(v)), pa.array(np.concatenate(place))], names=["doc", "no", "variant", "place"])

    return lines.select("doc", "no", "hashes").mapInArrow(run, "doc long, no int, variant long, place int")


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i in range(batch.num_rows) if within_one_edit(*(np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (1, 2)))]
            yield batch.select([0]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(run, "key binary")


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, nos): numbers, from 0, of the lines that go, for documents that lose any; lines of ``min_words`` words (2 at least) or more go if they are within one word of an earlier one."""
    src = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text")).where("doc is not null")
    lines = materialize(_lines(src, max(2, min_words)), "lines")
    shared = lines.select(F.explode("halves").alias("half"), "key").groupBy("half").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("half")
    shared = materialize(shared, "halves")
    shipped = df.sparkSession.sparkContext.broadcast(key_filter(shared))
    passed = _passed(src, shipped, max(2, min_words)).groupBy("key").agg(F.min(F.struct("doc", "no", "hashes")).alias("f")).select("key", "f.*")
    passed = materialize(passed, "passed")
    var = materialize(_variants(passed).withColumn("at", F.struct("doc", "no")).select("variant", "place", "at"), "variants")
    # same variant, same place: replacement; the group's earliest line is every other one's partner
    group = var.groupBy("variant", "place").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    replaced = var.where("place >= 0").join(group.where("place >= 0 and n > 1").drop("n"), ["variant", "place"]).where("at > least").select("at", F.col("least").alias("with"))
    # a whole line equal to a variant of a longer one: insertion; the line's partner is the earliest longer one, and the other way round
    whole = var.where("place = -1").select("variant", F.col("at").alias("whole"))
    longer = var.where("place >= 0").join(whole, "variant")
    inserted = longer.where("at > whole").select("at", F.col("whole").alias("with")).union(longer.where("at < whole").groupBy("whole").agg(F.min("at").alias("with")).select(F.col("whole").alias("at"), "with"))
    partner = replaced.union(inserted).groupBy("at").agg(F.min("with").alias("with"))
    own = passed.select(F.struct("doc", "no").alias("at"), "key", F.col("hashes").alias("x"))
    pairs = partner.join(own, "at").join(passed.select(F.struct("doc", "no").alias("with"), F.col("hashes").alias("y")), "with").select("key", "x", "y")
    near = materialize(_verified(pairs), "near")
    first = lines.groupBy("key").agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    goes = first.join(near.withColumn("near", F.lit(True)), "key", "full")
    gone = lines.select("key", "doc", "no").join(goes, "key").where("near or struct(doc, no) > first").select("doc", "no")
    return gone.groupBy("doc").agg(F.collect_set("no").alias("nos"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``df`` with its later repeated lines cut out: id, text, n_lines (with words), n_removed (and kept_sha256 with ``digest``).

    Rows of the same id are one document and lose the same lines; a null id keeps its text; a null text stays null, an empty
    one empty.  Other columns are not read, so their names cannot clash.  An empty table gives an empty result.
    """
    gone = removed_lines(df, id_col, text_col, min_words)
    names = ["doc", "text", "n_lines", "n_removed"] + ["kept_sha256"] * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out, counts, cut, sha = [], [], [], []
                for t, nos in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    t, drop = t.as_py(), set(nos or ())
                    lines = (t or b"").split(b"\n")
                    kept = b"\n".join(x for k, x in enumerate(lines) if k not in drop)
                    out.append(None if t is None else kept)
                    counts.append(sum(1 for x in lines if x.strip()))
                    cut.append(len(drop))
                    sha.append(hashlib.sha256(kept).hexdigest())
                cols = [part.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(cut, pa.int64())] + [pa.array(sha, pa.string())] * digest
                if digest:  # the text itself is not asked for
                    cols[1] = pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc long, text string, n_lines long, n_removed long" + ", kept_sha256 string" * digest
    return src.join(gone, "doc", "left").select("doc", "text", "nos").mapInArrow(run, schema).withColumnRenamed("doc", id_col).withColumnRenamed("text", text_col)


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``df`` with repeated lines cut from their texts and ``chars_col``, where there is one, set anew.

    A row all of whose lines with words were cut goes; one that had none before stays as it was, and so does a null text.
    """
    gone = removed_lines(df, id_col, text_col, min_words).select(F.col("doc").alias("__doc"), F.col("nos").alias("__nos"))
    schema, text, chars = df.schema, df.columns.index(text_col), df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                nos = part.column(part.num_columns - 1)
                texts, stays = part.column(text).to_pylist(), np.ones(part.num_rows, bool)
                for i in np.flatnonzero(nos.is_valid().to_numpy(zero_copy_only=False)):
                    drop = set(nos[int(i)].as_py())
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
                    stays[i] = bool(texts[i].encode().split())
                cols = [part.column(k) for k in range(len(schema))]
                cols[text] = pa.array(texts, pa.string())
                if chars is not None:
                    old = cols[chars].to_pylist()
                    cols[chars] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=schema.names).filter(pa.array(stays))

    both = df.join(gone, F.col(id_col) == F.col("__doc"), "left").select(*[df[c] for c in df.columns], "__nos")
    return both.mapInArrow(run, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with repeated lines cut: counts and digest of what stays."""
    return dedup_lines(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_lines", "n_removed", "kept_sha256")


QUERIES = {"op5_line_dedup": op5_line_dedup}

#: The definition itself on whole tables: variants as texts.
ORACLE_SQL = {
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS no FROM documents),
w AS (SELECT doc_id, no, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, no, line, w, array_to_string(w, ' ') AS key FROM w),
d AS (SELECT key, any_value(w) AS w, min({'d': doc_id, 'n': no}) AS first FROM k WHERE len(w) > 0 GROUP BY key),
v AS (SELECT key, first, len(w) AS n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 8)),
s AS (SELECT n, i, v, min(first) AS least FROM v GROUP BY ALL HAVING count(*) > 1),
near AS (
  SELECT v.key FROM v JOIN s USING (n, i, v) WHERE v.first > s.least
  UNION SELECT v.key FROM v JOIN d ON d.key = v.v AND len(d.w) >= 8 WHERE d.first < v.first
  UNION SELECT d.key FROM v JOIN d ON d.key = v.v AND len(d.w) >= 8 WHERE v.first < d.first),
g AS (SELECT k.*, d.key IS NOT NULL AND (n.key IS NOT NULL OR {'d': k.doc_id, 'n': k.no} > d.first) AS gone FROM k LEFT JOIN d ON d.key = k.key LEFT JOIN near n ON n.key = k.key)
SELECT doc_id, count(*) FILTER (len(w) > 0) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
}
