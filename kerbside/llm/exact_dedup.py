"""Exact dedup by composable polynomial fingerprints, confirmed by comparing chunks.

The fingerprint of a byte string b is sum(b[i] * r**i) modulo two primes, with its length. That of a concatenation
follows from its parts: H(a + b) = H(a) + r**len(a) * H(b). So texts are hashed in chunks, side by side, and the chunk
hashes are combined; texts beyond ``huge_chars`` are cut up and hashed on several tasks. Texts of equal fingerprints
are compared chunk by chunk, by an aggregation over the chunks that collapses equal ones before any shuffle.

What moves: fingerprints, and the chunks of texts whose fingerprint is repeated. The ids of these texts, and later of the copies, are broadcast to where
the texts are if they take at most frames.MAX_BROADCAST bytes, which is counted first; beyond that, texts are joined with them by a shuffle.

Defined results. Null text: no fingerprint, never a copy. Empty texts are copies of one another. Rows with a null
doc_id cannot be named: they are neither reported nor dropped. Ids are of any type that has an order. Rows that repeat doc_id and text count as one document,
of which ``drop_copies`` keeps one row; rows that share only doc_id are different documents. Of equal texts the least
doc_id stays. Texts of any length are read whole. No rows give no rows. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import textbytes
from kerbside.llm.frames import col, cut, fresh, ids_for_join

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1540483477)
CHUNK_BYTES = 4096
COMPARE_BYTES = 8192
HUGE_CHARS = 1 << 22

_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int) -> np.ndarray:
    if (base, prime) not in _tables:
        p = [1]
        for _ in range(CHUNK_BYTES):
            p.append(p[-1] * base % prime)
        _tables[base, prime] = np.array(p, np.int64)
    return _tables[base, prime]


def _power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime, by squaring."""
    result, square, left = np.ones(len(exponents), np.int64), base % prime, exponents.copy()
    while left.any():
        result = np.where(left & 1, result * square % prime, result)
        square = square * square % prime
        left >>= 1
    return result


def fingerprints(texts: pa.Array, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash by the first prime, by the second, bytes) of each text."""
    out = np.zeros((3, len(texts)), np.int64)
    for row, data, offsets in textbytes.slices(texts):
        sizes = np.diff(offsets)
        out[2, row : row + len(sizes)] = sizes
        chunks = -(-sizes // CHUNK_BYTES)
        if not chunks.sum():
            continue
        rows = np.repeat(np.arange(len(sizes)), chunks)
        first = np.cumsum(chunks) - chunks
        number = np.arange(len(rows)) - first[rows]
        starts = offsets[rows] + number * CHUNK_BYTES
        within = (np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))).astype(np.int32)
        wide = data.astype(np.int64)
        full = np.flatnonzero(chunks)
        for k, (prime, base) in enumerate(zip(primes, bases, strict=True)):
            powers = _powers(base, prime)
            each = np.add.reduceat(wide * powers[within], starts) % prime
            shifted = each * _power(int(powers[CHUNK_BYTES]), number, prime) % prime
            out[k, row + full] = np.add.reduceat(shifted, first[full]) % prime
    return out[0], out[1], out[2]


def combine(parts: list[tuple[int, int, int]], primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES) -> tuple[int, int, int]:
    """The fingerprint of a concatenation, from those of its parts in order."""
    a = b = n = 0
    for x, y, size in parts:
        a = (a + pow(bases[0], n, primes[0]) * x) % primes[0]
        b = (b + pow(bases[1], n, primes[1]) * y) % primes[1]
        n += size
    return a, b, n


def fingerprint_column(text, primes=PRIMES, bases=BASES):
    """struct<a, b, n> of a text column; null for null text."""

    @F.arrow_udf("struct<a: bigint, b: bigint, n: bigint>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        a, b, n = fingerprints(texts, primes, bases)
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"], mask=texts.is_null())

    return fingerprint(text)


def _bytes(data: str, size: int):
    """The k-th run of size bytes. A binary column is cut in constant time; a string is counted through from its start."""
    return F.expr(f"substring({data}, k * {size} + 1, {size})")


def _huge(docs: DataFrame, doc_id: str, text: str, huge_chars: int, primes, bases) -> DataFrame:
    """Fingerprints of the texts beyond huge_chars; their pieces are spread over all tasks, and each piece's is shifted to its place."""
    size = huge_chars

    @F.arrow_udf("struct<a: bigint, b: bigint, n: bigint>")
    def shifted(pieces: pa.Array, k: pa.Array) -> pa.Array:
        a, b, n = fingerprints(pieces, primes, bases)
        at = k.to_numpy(zero_copy_only=False).astype(np.int64) * size
        a, b = a * _power(bases[0], at, primes[0]) % primes[0], b * _power(bases[1], at, primes[1]) % primes[1]
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    pieces = (
        docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
        .where(F.length("text") > huge_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", F.col("text").cast("binary").alias("data"), F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / size).cast("int"))).alias("k"))
        .select("doc_id", "row", "k", _bytes("data", size).alias("piece"))
        .repartition("row", "k")
        .select("doc_id", "row", shifted("piece", "k").alias("f"))
    )
    total = F.struct((F.sum("f.a") % primes[0]).alias("a"), (F.sum("f.b") % primes[1]).alias("b"), F.sum("f.n").alias("n"))
    return pieces.groupBy("doc_id", "row").agg(total.alias("f")).select("doc_id", "f")


def fingerprint_table(docs: DataFrame, doc_id="doc_id", text="text", huge_chars=HUGE_CHARS, primes=PRIMES, bases=BASES) -> DataFrame:
    """(doc_id, a, b, n) of each row with both; checkpointed, as it is far smaller than the texts and used more than once."""
    small = F.when(F.length(col(docs, text)) <= huge_chars, col(docs, text))
    base = docs.where(col(docs, doc_id).isNotNull() & col(docs, text).isNotNull())
    found = cut(base.select(col(docs, doc_id).alias("doc_id"), fingerprint_column(small, primes, bases).alias("f")))
    known = found.where("f IS NOT NULL")
    if not found.where("f IS NULL").isEmpty():
        known = known.unionByName(cut(_huge(base, doc_id, text, huge_chars, primes, bases)))
    return known.select("doc_id", "f.a", "f.b", "f.n")


def _classes(docs: DataFrame, prints: DataFrame, doc_id: str, text: str, primes, bases) -> DataFrame:
    """(doc_id, a, b, n, duplicate_of, rows) of each document whose text several rows have."""
    once = prints.groupBy("a", "b", "n", "doc_id").agg(F.count("*").alias("rows"))
    groups = once.groupBy("a", "b", "n").agg(F.min("doc_id").alias("duplicate_of"), F.sum("rows").alias("size")).where("size > 1")
    members = cut(once.join(groups, ["a", "b", "n"]).select("doc_id", "a", "b", "n", "duplicate_of", "rows"))

    # Only texts whose fingerprint several rows share are looked at again.
    again = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    keyed = (
        again.join(ids_for_join(members.select("doc_id").distinct(), "doc_id"), "doc_id", "left_semi")
        .withColumn("f", fingerprint_column(F.col("text"), primes, bases))
        .select("doc_id", "text", "f.a", "f.b", "f.n")
    )
    runs = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / COMPARE_BYTES).cast("int"))).alias("k")
    chunks = keyed.select("a", "b", "n", F.col("text").cast("binary").alias("data"), runs).select("a", "b", "n", "k", _bytes("data", COMPARE_BYTES).alias("chunk"))
    kinds = chunks.groupBy("a", "b", "n", "k", "chunk").agg(F.count("*").alias("c")).groupBy("a", "b", "n", "k").agg(F.count("*").alias("kinds"))
    differing = cut(kinds.where("kinds > 1").select("a", "b", "n").distinct())
    if differing.isEmpty():
        return members
    # A true collision: the texts themselves decide.
    exact = keyed.join(differing, ["a", "b", "n"], "left_semi").groupBy("a", "b", "n", "text", "doc_id").agg(F.count("*").alias("rows"))
    least = exact.groupBy("a", "b", "n", "text").agg(F.min("doc_id").alias("duplicate_of"), F.sum("rows").alias("size")).where("size > 1")
    settled = exact.join(least, ["a", "b", "n", "text"]).select("doc_id", "a", "b", "n", "duplicate_of", "rows")
    return members.join(differing, ["a", "b", "n"], "left_anti").unionByName(cut(settled))


def exact_copies(docs: DataFrame, doc_id="doc_id", text="text", huge_chars=HUGE_CHARS, primes=PRIMES, bases=BASES) -> DataFrame:
    """(doc_id, duplicate_of): each document whose text a document of a lesser doc_id has, with the least such doc_id."""
    prints = fingerprint_table(docs, doc_id, text, huge_chars, primes, bases)
    return _classes(docs, prints, doc_id, text, primes, bases).where("doc_id <> duplicate_of").select("doc_id", "duplicate_of").distinct()


def drop_copies(docs: DataFrame, doc_id="doc_id", text="text", huge_chars=HUGE_CHARS, primes=PRIMES, bases=BASES) -> DataFrame:
    """docs with one row for each text; see above for nulls."""
    prints = fingerprint_table(docs, doc_id, text, huge_chars, primes, bases)
    gone = cut(_classes(docs, prints, doc_id, text, primes, bases).where("doc_id <> duplicate_of"))
    i, t = col(docs, doc_id), col(docs, text)
    out, many, its, print_, number = fresh(docs, "_gone", "_several", "_f", "_print", "_number")
    gone_ids = ids_for_join(gone.select(F.col("doc_id").alias(out)), out)
    several = cut(prints.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(many)))
    told = ids_for_join(several, many)
    if several.isEmpty():
        return docs.join(gone_ids, i == F.col(out), "left_anti")
    # Rows of a doc_id that occurs once go by it alone; the others are told apart by their text.
    gone_texts = gone.select(F.col("doc_id").alias(out), F.struct("a", "b", "n").alias(its))
    single = docs.join(told, i == F.col(many), "left_anti").join(gone_ids, i == F.col(out), "left_anti")
    repeated = docs.where(t.isNotNull()).join(told, i == F.col(many), "left_semi")
    repeated = (
        repeated.withColumn(print_, fingerprint_column(col(repeated, text), primes, bases))
        .join(gone_texts, (F.col(f"`{doc_id}`") == F.col(out)) & (F.col(print_) == F.col(its)), "left_anti")
        .withColumn(number, F.row_number().over(Window.partitionBy(f"`{doc_id}`", f"`{text}`").orderBy(F.lit(0))))
        .where(F.col(number) == 1)
        .drop(print_, number)
    )
    untold = docs.where(t.isNull()).join(told, i == F.col(many), "left_semi")
    return single.unionByName(repeated).unionByName(untold)
