"""Near-dedup: SimHash signatures, joined to themselves through binary tries.

A document's signature has 256 bits, the signs of random projections of its bag of words (each word once, and once
more for each doubling of its count). Two documents are near copies if their signatures differ in at most ``BUDGET`` =
31 bits. The search is exact:

* 31 differing bits over two halves leave a half with 15 at most, that one a quarter with 7, and so on: a word of 32 bits with 3, a half word with
  1, a byte with none. So a pair shares a (byte number, byte value) key, and from this byte on, the bits around it, nearest first, have
  budgets that grow with the depth: 1 for the first 16 bits, 3 for 32, 7 for 64. Signatures are filed under their 32 keys.
* Under a key, signatures sorted by the bits in this order are a binary trie: a node is a range. Pairs of nodes go down together, level by
  level, and add up the bits they differ in; a pair beyond the depth's budget is pruned. Pairs of leaves left are checked against the whole budget.
* The keys' counts decide how deep a key is cut up before tasks get it, so that nodes have about ``NODE_ROWS`` signatures whatever
  the input: a task is a pair of nodes at that depth within the budget, and each signature goes to the pairs that its node is in.
* Pairs within one component need no look. Where most of a pair of large nodes is within the budget of one member, the rest alone is compared with
  all: thousands of near copies of one text cost a few rounds, not millions of pairs.

Documents of equal signatures go in as one. In a task, pairs that are found are joined into components at once, and
only each member's link to its component's least member leaves the task. The links of all tasks are joined by alternating large-star and small-star steps.
Groups are the connected components, so a group may hold documents that are linked only through others.

Defined results. Null text and text without a word have no signature and are near copies of nothing. A null doc_id
cannot be named: such rows are neither reported nor dropped. Ids are of any type that has an order. Scripts that write no spaces give one token a run. Texts of any length
are read whole.
Repeated rows, and rows that share a doc_id, are one member each of (doc_id, signature). The least doc_id of a group
stays, with one row. Ties of a projection count as 0 bits. No rows give no rows. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import textbytes
from kerbside.llm.frames import col, cut, fresh, ids_for_join

BITS = 256
BUDGET = 31
BUCKETS = 2048
KEYS = BITS // 8
#: Bits of a trie below its key, the deepest cut of a key, and the budget at each depth: the bits beside the key's byte, then those of its word, then of its quarter.
TRIE_BITS, MAX_CUT = 51, 16
BUDGETS = np.array([0] + [1] * 8 + [3] * 16 + [7] * (TRIE_BITS - 24))
NODE_ROWS = 1 << 20  # 48 MB; a smaller node costs more copies of each signature and saves no comparison
LEAF_PAIRS = 32
DENSE_PAIRS = 1 << 14
FRONTIER = 1 << 16
TRIE_ROWS = 1 << 16
MAX_GROUPS = 1 << (64 - TRIE_BITS)

_projection: list[np.ndarray] = []


def _signs() -> np.ndarray:
    if not _projection:
        _projection.append(np.random.default_rng(20240229).choice(np.float32([-1, 1]), (BUCKETS, BITS)))
    return _projection[0]


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signatures as rows of 32 bytes, whether the text has a word). All sums are of small integers, hence exact in any order."""
    out, known = np.zeros((len(texts), BITS // 8), np.uint8), np.zeros(len(texts), bool)
    for row, data, offsets in textbytes.slices(texts):
        starts, ends = textbytes.runs(textbytes.WORD[data], offsets)
        if not len(starts):
            continue
        rows = textbytes.owner(starts, offsets)
        keys = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (textbytes.span_hashes(data, starts, ends) >> np.uint64(16)))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        weight = np.frexp(counts)[1] * np.where(keys & np.uint64(1), 1, -1)  # 1 + the whole part of log2
        cells = (keys >> np.uint64(48)) * np.uint64(BUCKETS) + ((keys >> np.uint64(1)) & np.uint64(BUCKETS - 1))
        n = len(offsets) - 1
        bags = np.bincount(cells.astype(np.int64), weight, n * BUCKETS).astype(np.float32).reshape(n, BUCKETS)
        out[row : row + n] = np.packbits(bags @ _signs() > 0, axis=1)
        known[row : row + n] = np.bincount(rows, minlength=n) > 0
    return out, known


@F.arrow_udf(T.BinaryType())
def signature(texts: pa.Array) -> pa.Array:
    codes, known = signatures(texts)
    return pa.array([c if k else None for c, k in zip((row.tobytes() for row in codes), known, strict=True)], pa.binary())


def _orders() -> np.ndarray:
    """For each byte of a signature, the eight bytes of its quarter, nearest first."""
    k = np.arange(KEYS)
    half, word = (k >> 1 ^ 1) * 2, (k >> 2 ^ 1) * 4
    return np.stack([k, k ^ 1, half, half + 1, word, word + 1, word + 2, word + 3], axis=1)


def trie_words(numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The TRIE_BITS bits around byte number of each signature."""
    near = np.ascontiguousarray(codes[np.arange(len(codes))[:, None], _orders()[numbers]])
    return (near.view(">u8").ravel().astype(np.uint64) << np.uint64(8)) >> np.uint64(64 - TRIE_BITS)


def trie_pairs(words: np.ndarray, roots: tuple[np.ndarray, ...], depth: int = 0, budgets: np.ndarray = BUDGETS, bits: int = TRIE_BITS, settled=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within the budgets of all depths; may hold a few beyond.

    words: sorted; the lowest bits are the tries', higher ones tell tries apart. roots: node pairs (from, to, from, to, bits they differ in) at depth. settled tells which of large node pairs need no further look.
    """
    stack = [(depth, *roots)]
    while stack:
        depth, a, b, c, d, errors = stack.pop()
        if len(a) > FRONTIER:
            stack += [(depth, *(x[i : i + FRONTIER] for x in (a, b, c, d, errors))) for i in range(0, len(a), FRONTIER)]
            continue
        small = (b - a) * (d - c) <= LEAF_PAIRS
        if settled is not None and (depth in (8, 24) or depth == bits) and not small.all():
            open_ = ~settled(a, b, c, d, depth == bits)
            a, b, c, d, errors, small = (x[open_] for x in (a, b, c, d, errors, small))
        if depth == bits:
            small[:] = True
        if small.any():
            yield from _leaves(a[small], b[small], c[small], d[small])
        if small.all():
            continue
        a, b, c, d, errors = (x[~small] for x in (a, b, c, d, errors))
        shift = np.uint64(bits - 1 - depth)
        low = np.uint64((1 << (bits - depth)) - 1)

        def split(x, _shift=shift, _low=low):  # where the nodes' right children begin
            at = (words[x] & ~_low) | (np.uint64(1) << _shift)
            return np.searchsorted(words, at)

        m, k = split(a), split(c)
        same = a == c
        left, right = (a, m, c, k, errors), (m, b, k, d, errors)
        cross, back = (a, m, k, d, errors + 1), (m, b, c, k, errors + 1)
        parts = [left, right, cross, tuple(x[~same] for x in back)]
        a, b, c, d, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (errors <= budgets[depth + 1]) & (b > a) & (d > c) & ~((a == c) & (b - a < 2))
        stack.append((depth + 1, *(x[keep] for x in (a, b, c, d, errors))))


def _leaves(a, b, c, d) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions between the ranges [a, b) and [c, d), each unordered pair of a range with itself once."""
    a, c, width, sizes = a.astype(np.int32), c.astype(np.int32), (d - c).astype(np.int32), (b - a) * (d - c)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
        s = sizes[at:upto]
        which = np.repeat(np.arange(at, upto, dtype=np.int32), s)
        n = np.arange(s.sum(), dtype=np.int32) - np.repeat((np.cumsum(s) - s).astype(np.int32), s)
        w = width[which]
        i, j = a[which] + n // w, c[which] + n % w
        keep = (a[which] != c[which]) | (i < j)
        yield i[keep], j[keep]
        at = upto


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position linked to each position."""
    root = np.arange(n)
    while len(i):
        x, y = root[i], root[j]
        open_ = x != y
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


class _Linker:
    """Near pairs among signatures, joined into components of positions as they come."""

    def __init__(self, codes: np.ndarray):
        self.whole = np.ascontiguousarray(codes).view(np.uint64).reshape(len(codes), BITS // 64)
        self.root = np.arange(len(codes))

    def check(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.root[i] != self.root[j]
        i, j = i[apart], j[apart]
        if len(i):
            near = np.bitwise_count(self.whole[i] ^ self.whole[j]).sum(axis=1, dtype=np.int64) <= BUDGET
            if near.any():
                self.root = _components(len(self.root), self.root[i[near]], self.root[j[near]])[self.root]

    def distances(self, one: int, members: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.whole[members] ^ self.whole[one]).sum(axis=1, dtype=np.int64)

    def settled(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, last: bool) -> np.ndarray:
        """Which large node pairs are done with: those at the last depth, and those nearly all of whose members are near one."""
        done = np.zeros(len(a), bool)
        for k in np.flatnonzero((b - a) * (d - c) > DENSE_PAIRS):
            members = np.arange(a[k], b[k]) if a[k] == c[k] else np.concatenate([np.arange(a[k], b[k]), np.arange(c[k], d[k])])
            if last or (self.distances(members[0], members) <= BUDGET).mean() > 0.75:
                self.dense(members)
                done[k] = True
        return done

    def dense(self, members: np.ndarray) -> None:
        """All near pairs of members, where pairs within a component count as found. Distances from a pivot rule out the rest: they differ by no more than the two are apart."""
        while len(members) > 1:
            pivot = members[0]
            away = self.distances(pivot, members)
            near = members[away <= BUDGET]
            self.check(np.full(len(near), pivot), near)
            inside = self.root[members] == self.root[pivot]
            order = np.argsort(away[inside], kind="stable")
            with_pivot, reach = members[inside][order], away[inside][order]
            for x, far in zip(members[~inside], away[~inside], strict=True):
                low, high = np.searchsorted(reach, [far - BUDGET, far + BUDGET + 1])
                self.check(np.full(high - low, x), with_pivot[low:high])
            members = members[~inside]


def near_links(pairs: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) links that join the near pairs among signatures filed under node pairs, at most MAX_GROUPS of these."""
    group = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
    number, cut_ = pairs >> 48, pairs >> 32 & 0xFF
    words = (group << np.uint64(TRIE_BITS)) | trie_words(number, codes)
    order = np.lexsort((ids, words))
    ids, codes, words, pairs, cut_ = ids[order], codes[order], words[order], pairs[order], cut_[order]
    linker = _Linker(codes)
    begin = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    end = np.append(begin[1:], len(pairs))
    depths, p, q = cut_[begin], pairs[begin] >> 16 & 0xFFFF, pairs[begin] & 0xFFFF
    for depth in np.unique(depths):
        here = depths == depth
        a, b, own = begin[here], end[here], (p == q)[here]
        # Of two nodes, the second begins where the words have its prefix.
        middle = np.searchsorted(words, (words[a] & ~np.uint64((1 << TRIE_BITS) - 1)) | (q[here].astype(np.uint64) << np.uint64(TRIE_BITS - int(depth))))
        some = np.where(own, b - a > 1, (middle > a) & (middle < b))
        a, b, own, middle = a[some], b[some], own[some], middle[some]
        errors = np.bitwise_count((p ^ q)[here][some]).astype(np.int8)
        for i, j in trie_pairs(words, (a, np.where(own, b, middle), np.where(own, a, middle), b, errors), int(depth), settled=linker.settled):
            few = np.bitwise_count(words[i] ^ words[j]) <= BUDGETS[-1]  # one look that rules out nearly all; a near pair passes under the key that it is found by
            linker.check(i[few], j[few])
    root = linker.root
    linked = np.flatnonzero(root != np.arange(len(root)))
    members = np.union1d(linked, root[linked])
    if not len(members):
        return ids[:0], ids[:0]
    by = np.lexsort((ids[members], root[members]))
    members = members[by]
    starts = np.concatenate(([True], root[members][1:] != root[members][:-1]))
    least = ids[members][np.flatnonzero(starts)][np.cumsum(starts) - 1]
    other = ids[members] != least
    return ids[members][other], least[other]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition that is sorted by node pair; a pair is taken whole, several together up to about TRIE_ROWS rows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def links() -> Iterator[pa.RecordBatch]:
        pairs, ids, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        change = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        for first, last in zip(change[::MAX_GROUPS], [*change[::MAX_GROUPS][1:], len(pairs)], strict=True):
            u, v = near_links(pairs[first:last], ids[first:last], codes[first:last])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if not len(batch):
            continue
        pairs, ids, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _rows_of(batch.column(2))
        if rows >= TRIE_ROWS and pairs[-1] != held[0][0][0]:
            done = int(np.searchsorted(pairs, held[-1][0][-1], "right"))  # the rest of the last pair held
            held.append((pairs[:done], ids[:done], codes[:done]))
            yield from links()
            held, rows = [], 0
            pairs, ids, codes = pairs[done:], ids[done:], codes[done:]
        if len(pairs):
            held.append((pairs, ids, codes))
            rows += len(pairs)
    if rows:
        yield from links()


def _rows_of(codes: pa.Array) -> np.ndarray:
    """A binary column of signatures as rows of bytes."""
    size = BITS // 8
    start = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset] if len(codes) else 0
    return np.frombuffer(codes.buffers()[2], np.uint8)[start : start + len(codes) * size].reshape(-1, size) if len(codes) else np.zeros((0, size), np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many signatures each key has."""
    total = np.zeros(KEYS * 256, np.int64)
    for batch in batches:
        total += np.bincount((_rows_of(batch.column(0)).astype(np.int64) + np.arange(KEYS) * 256).ravel(), minlength=KEYS * 256)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])


def _near_prefixes(bits: int) -> np.ndarray:
    """What a node's prefix of so many bits may differ in from that of another, within the budgets."""
    x = np.arange(1 << bits)
    near = np.bitwise_count(x) <= BUDGETS[bits]
    return x[near & (np.bitwise_count(x >> max(0, bits - 8)) <= BUDGETS[min(bits, 8)])]


def file_under(codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node pair) of each signature: its 32 keys, each cut as deep as cuts says. A pair is byte number, value, cut and two prefixes in one number."""
    rows, pairs = [], []
    for number in range(KEYS):
        keys = codes[:, number].astype(np.int64) + number * 256
        words = trie_words(np.full(len(codes), number), codes).astype(np.int64) if cuts[number * 256 : number * 256 + 256].any() else None
        for cut_ in np.unique(cuts[keys]):
            at = np.flatnonzero(cuts[keys] == cut_)
            mine = words[at] >> (TRIE_BITS - int(cut_)) if cut_ else np.zeros(len(at), np.int64)
            other = mine[:, None] ^ _near_prefixes(int(cut_))
            low, high = np.minimum(mine[:, None], other), np.maximum(mine[:, None], other)
            pairs.append(((keys[at] << 40 | int(cut_) << 32)[:, None] | low << 16 | high).ravel())
            rows.append(np.repeat(at, other.shape[1]))
    return np.concatenate(rows), np.concatenate(pairs)


def _filer(cuts: np.ndarray):
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                codes = _rows_of(part.column(0))
                rows, pairs = file_under(codes, cuts)
                for k in range(0, len(rows), 1 << 17):  # deep cuts make many
                    r = rows[k : k + (1 << 17)]
                    offsets = np.arange(len(r) + 1, dtype=np.int32) * (BITS // 8)
                    column = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes[r]))])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 17)]), part.column(1).take(pa.array(r)), column], ["pair", "id", "code"])

    return file


def components(links: DataFrame) -> DataFrame:
    """(u, v) with v the least document of u's component, for links (u, v) with u > v: large-star and small-star until nothing changes."""
    links = cut(links.distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v")).distinct()
        after = cut(small)
        # Stars alone are left once no center is a member of another star and each member has one center.
        if after.groupBy("u").count().where("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("c")), F.col("v") == F.col("c"), "left_semi").isEmpty():
            return after
        links = after


def _groups(docs: DataFrame, doc_id: str, text: str, node_rows: int) -> DataFrame:
    """(group, doc_id, code, root): each signed document, with the least doc_id of its group; null if it is alone."""
    i = col(docs, doc_id)
    signed = cut(docs.where(i.isNotNull()).select(i.alias("doc_id"), signature(F.lower(col(docs, text))).alias("code")).where("code IS NOT NULL"))
    codes = cut(signed.select("code").distinct().withColumn("id", F.monotonically_increasing_id()))
    counts = codes.mapInArrow(_count, "key bigint, n bigint").groupBy("key").agg(F.sum("n")).collect()  # KEYS x 256 rows at most
    cuts = np.zeros(KEYS * 256, np.int64)
    for key, n in counts:
        cuts[key] = min(MAX_CUT, max(0, (-(-n // node_rows) - 1).bit_length()))
    filed = codes.mapInArrow(_filer(cuts), "pair bigint, id bigint, code binary").repartition("pair").sortWithinPartitions("pair")
    roots = components(filed.mapInArrow(_search, "u bigint, v bigint"))
    # Of the signatures, only the members of groups; documents of one signature are a group by themselves.
    rooted = codes.join(roots, codes.id == roots.u, "left").select("code", F.coalesce("v", "id").alias("group"))
    members = signed.join(rooted, "code")
    least = members.groupBy("group").agg(F.min("doc_id").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(least, "group", "left")


def near_copies(docs: DataFrame, doc_id="doc_id", text="text", node_rows=NODE_ROWS) -> DataFrame:
    """(doc_id, duplicate_of): each document that is not the least of its group of near copies, with that least one."""
    return _groups(docs, doc_id, text, node_rows).where("doc_id <> root").select("doc_id", F.col("root").alias("duplicate_of")).distinct()


def drop_near_copies(docs: DataFrame, doc_id="doc_id", text="text", node_rows=NODE_ROWS) -> DataFrame:
    """docs with one row of each group of near copies; see above for nulls."""
    found, i = _groups(docs, doc_id, text, node_rows), col(docs, doc_id)
    code, number, out, many, its, kept_code = fresh(docs, "_code", "_number", "_gone", "_several", "_id", "_kept")
    found = cut(found)
    gone = ids_for_join(found.where("doc_id <> root").select(F.col("doc_id").alias(out)), out)
    several = cut(docs.where(i.isNotNull()).groupBy(i.alias(many)).agg(F.count("*").alias("c")).where("c > 1").select(many))
    if several.isEmpty():
        return docs.join(gone, i == F.col(out), "left_anti")
    # Rows of a doc_id that occurs once go by it alone. Of a doc_id's rows, a group keeps one of its least doc_id and, for that, the least signature.
    told = ids_for_join(several, many)
    single = docs.join(told, i == F.col(many), "left_anti").join(gone, i == F.col(out), "left_anti")
    stay = found.groupBy("group").agg(F.min(F.struct("doc_id", "code")).alias("k")).select(F.col("k.doc_id").alias(its), F.col("k.code").alias(kept_code))
    repeated = docs.join(told, i == F.col(many), "left_semi").withColumn(code, signature(F.lower(col(docs, text))))
    kept = (
        repeated.where(F.col(code).isNotNull())
        .join(stay, (F.col(f"`{doc_id}`") == F.col(its)) & (F.col(code) == F.col(kept_code)), "left_semi")
        .withColumn(number, F.row_number().over(Window.partitionBy(f"`{doc_id}`", code).orderBy(F.xxhash64(f"`{text}`"))))
        .where(F.col(number) == 1)
        .drop(number)
    )
    return single.unionByName(kept.unionByName(repeated.where(F.col(code).isNull())).drop(code))
