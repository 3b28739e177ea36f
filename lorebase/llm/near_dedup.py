"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation.

1. A pass over whole texts makes each document's set of distinct word shingles and
   from it `n_hashes` MinHash values. Documents with the same words in the same
   order form a class at once, so exact copies cost one narrow join.
2. Classes that agree in all rows of a band meet in that band's bucket. Each bucket
   compares its members with its least member only, so a bucket of g gives g pairs.
3. A pair's signatures are compared batch by batch. After m agreements in n hashes
   the posterior P(similarity >= threshold | m, n), under a uniform prior, is
   P(Bin(n + 1, threshold) <= m); below `miss` the pair is dropped. Survivors are
   confirmed on the full shingle sets.
4. Buckets that still touch several components are finished exactly. Small ones
   compare all pairs of different components (at most `small_bucket` rows each).
   Members of large ones are dealt anew by their rarest shingles: of two linked sets
   both hold a common shingle among the first 100 - `percent` percent of an order from
   rare to frequent, and the smaller set holds it still further in front. A page
   template that very many texts share stands behind, so texts that have only that in
   common never meet, however many they are.
5. Shingles' postings that still touch several components are finished as buckets are:
   small ones pair by pair; members of large ones meet block by block inside tasks, in
   blocks of bounded bytes. Survivors of the signatures are confirmed there on the full
   sets, and only links that join two components of the block leave, fewer than it has
   rows. Blocks of the group's main component don't meet each other, so a group of
   copies stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import comb
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, slices, text_buffer
from .components import components
from .wordhash import SPACE, Words, mix, sequence_hash, windows, words

SHINGLE = 5
ROWS = 8
BANDS = 32
BATCH = 32
BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Counters of the sketch that orders shingles from rare to frequent. The order decides on speed only.
SKETCH = 1 << 20


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(77)
    return r.integers(0, 1 << 32, n, dtype=np.uint32), r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def class_ids(w: Words) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    return sequence_hash(w.hash, w.first[:-1], w.first[1:], 11).view(np.int64)


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where it has fewer words; empty without words."""
    h, whole = windows(w, k)
    short = sequence_hash(w.hash, w.first[:-1], w.first[1:], 23)
    out = []
    for i in range(len(w.first) - 1):
        a, b = w.first[i], w.first[i + 1]
        out.append(np.unique(h[a : b - k + 1]) if b - a >= k else short[i : i + 1] if b > a else h[:0])
    return out


def minhash(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """A row of `n_hashes` 16-bit MinHash values for each set; zeros for an empty one."""
    sig = np.zeros((len(sets), n_hashes), np.uint16)
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    if len(full):
        h = np.concatenate([sets[i] for i in full])
        h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        x, a = _constants(n_hashes)
        for j in range(n_hashes):
            sig[full, j] = np.minimum.reduceat((h ^ x[j]) * a[j], at).astype(np.uint16)
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, k = sig.shape
    keys = np.zeros((n, k // rows), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, : k // rows].astype(np.uint64) + np.uint64(r + 1))
    return mix(keys + np.arange(1, k // rows + 1, dtype=np.uint64)[None, :]).view(np.int64)


@cache
def least_agreements(n_hashes: int, batch: int, threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest agreements whose posterior reaches `miss`."""
    out = []
    for n in range(batch, n_hashes + 1, batch):
        total, m = 0.0, -1
        while m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return tuple(out)


def survives(x: np.ndarray, y: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Rows of x and y (same shape, or broadcast) that no batch rules out."""
    n = x.shape[-1]
    shape = np.broadcast_shapes(x.shape, y.shape)
    x, y = np.broadcast_to(x, shape).reshape(-1, n), np.broadcast_to(y, shape).reshape(-1, n)
    left, agree = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, least in enumerate(least_agreements(n, BATCH, threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        agree = agree + (x[left, part] == y[left, part]).sum(1)
        on = agree >= least
        left, agree = left[on], agree[on]
    out = np.zeros(len(x), bool)
    out[left] = True
    return out.reshape(shape[:-1])


def _signatures(column: pa.Array, n_hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, n_hashes)


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = 85,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = 1e-6,
    small_bucket: int = 32,
    by_text: bool = False,
) -> DataFrame:
    """One row for each row of `documents`: id, n_shingles (set size), component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the least id that links reach. A banded pair at the
    threshold is missed with probability (1 - t^rows)^bands (4e-5 at 0.85, 32 x 8) or
    pruned with about `miss`; no wrong link is made but for collisions of 64-bit
    hashes. Null or wordless texts have an empty set and are linked with nothing.
    Null ids are never a component_id unless the row stands alone. Repeated rows count
    as copies. Null and repeated ids cost what others do, as rows are told apart by id and
    text. Other columns are ignored; an empty table gives an empty result.

    With `by_text` there is instead one row for each id and text that has words: doc_id,
    text_hash (xxhash64 of the text), copies (its rows), kept. Of each group just one is
    kept, that with the least id, and then hash; null ids come last.
    """
    ship(documents.sparkSession)
    n_hashes, t = bands * rows, percent / 100
    key = ["doc_id", "text_hash"]  # ids may be null or repeat: texts are fetched by both
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).select(*key, "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACE)
                sets = shingle_sets(w, shingle)
                size = np.array([len(s) for s in sets], np.int64)
                sig = minhash(sets, n_hashes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in key), pa.array(class_ids(w), mask=size == 0), pa.array(size), pa.array([x.tobytes() for x in sig], pa.binary())], [*key, "cid", "n_shingles", "sig"])

    made = checkpoint(docs.mapInArrow(sketch, ", ".join([*(f"{c} long" for c in key), "cid long, n_shingles long, sig binary"])))
    member = made.select(*key, "cid", "n_shingles")
    reps = checkpoint(made.where("cid IS NOT NULL").groupBy("cid").agg(F.first("sig").alias("sig")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_signatures(batch.column("sig"), n_hashes), rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column("cid")), bands))], ["band", "cid"])

    dealt = reps.mapInArrow(deal, "band long, cid long")
    buckets = dealt.groupBy("band").agg(F.min("cid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    met = checkpoint(dealt.join(buckets, "band"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = survives(_signatures(batch.column("sig_a"), n_hashes), _signatures(batch.column("sig_b"), n_hashes), t, miss)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(on)), batch.column("b").filter(pa.array(on))], ["a", "b"])

    def pruned(pairs: DataFrame) -> DataFrame:
        left, right = reps.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), reps.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(right, "b").join(left, "a").select("a", "sig_a", "b", "sig_b").mapInArrow(compare, "a long, b long")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)  # rows come in the order of a, whose set is made once for its run
        for batch in batches:
            a, text_a = np.asarray(batch.column("a")), batch.column("text_a")
            data, offsets = text_buffer(batch.column("text_b"))
            for i, j in slices(offsets):
                on = []
                for k, y in enumerate(shingle_sets(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shingle), i):
                    if a[k] != last:
                        own, cut = text_buffer(text_a.slice(k, 1))
                        last, held = a[k], shingle_sets(words(own, cut), shingle)[0]
                    both = len(np.intersect1d(held, y, assume_unique=True))
                    on.append(100 * both >= percent * (len(held) + len(y) - both))
                on = pa.array(on, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i).filter(on) for c in "ab"], ["a", "b"])

    stars = met.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    first = checkpoint(pruned(stars))
    # Only texts of classes that share a bucket are needed from here on, one for each class.
    one = member.where("cid IS NOT NULL").groupBy("cid").agg(F.min_by(F.struct(*key), F.xxhash64(*key)).alias("key")).select("cid", "key.*").join(met.select("cid").distinct(), "cid", "left_semi")

    def check_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text is of their class, if two texts of an id had one hash."""
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACE)
                on = pa.array(class_ids(w) == np.asarray(batch.column("cid").slice(i, j - i)))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i).filter(on) for c in ("cid", "text")], ["cid", "text"])

    same = reduce(and_, (docs[c].eqNullSafe(one[c]) for c in key))
    texts = checkpoint(docs.where("text IS NOT NULL").join(one, same).select("cid", "text").mapInArrow(check_class, "cid long, text string").dropDuplicates(["cid"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
        # A bucket's leader is `a` of very many pairs: its text joins last, so that no shuffle repeats it.
        return checkpoint(pairs.join(b, "b").join(a, "a").select("a", "text_a", "b", "text_b").mapInArrow(confirm, "a long, b long"))

    links = confirmed(first)
    comp = components(links)
    live = _unresolved(met, comp)
    if not live.isEmpty():
        small, large = live.where(F.col("n") <= small_bucket), live.where(F.col("n") > small_bucket)
        links = links.union(confirmed(pruned(_fresh_pairs(small))))
        if not large.isEmpty():
            near = _rare_postings(large, texts, shingle, percent)
            few, many = near.where(F.col("n") <= small_bucket), near.where(F.col("n") > small_bucket)
            links = links.union(confirmed(pruned(_posting_pairs(few))))
            if not many.isEmpty():
                links = links.union(_blocks(many, reps, texts, n_hashes, shingle, percent, miss))
        comp = components(links)

    rank = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    own = member.where("cid IS NOT NULL").groupBy("cid").agg(F.min(rank if by_text else "doc_id").alias("low"))
    own = own.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = own.groupBy("comp").agg(F.min("low").alias("component_id"))
    found = own.join(least, "comp").select("cid", "component_id")
    if by_text:
        each = member.where("cid IS NOT NULL").groupBy(*key, "cid").agg(F.count("*").alias("copies"))
        return each.join(found, "cid").select(*key, "copies", (rank == F.col("component_id")).alias("kept"))
    out = member.join(found, "cid", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def _unresolved(met: DataFrame, comp: DataFrame) -> DataFrame:
    """Members, with their components, of buckets that touch more than one."""
    now = checkpoint(met.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    still = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    return checkpoint(now.join(still, "band"))


def _fresh_pairs(small: DataFrame) -> DataFrame:
    """Pairs of different components within small buckets, but for those with the leader, which have been compared."""
    x, y = small.select("band", F.col("cid").alias("a"), F.col("comp").alias("ca")), small.select("band", F.col("cid").alias("b"), F.col("comp").alias("cb"))
    stars = small.where("cid <> leader").select(F.least("leader", "cid").alias("a"), F.greatest("leader", "cid").alias("b"))
    return x.join(y, "band").where("ca <> cb AND a < b").select("a", "b").join(stars, ["a", "b"], "left_anti").distinct()


def _rare_postings(large: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(band, cid, comp, wide, leader, n): postings of shingles in the front of their sets that touch several components.

    Sets stand in an order from rare to frequent shingles, by counters of a sketch. With
    t = percent / 100, linked sets share at least t of each, so both have a common
    shingle among their first (1 - t) n + 1; in the smaller one less than
    (1 - t) / (1 + t) of it stands before ("wide"). A posting without a wide member
    links nothing.
    """
    held = checkpoint(large.select("cid", "comp").distinct().join(texts, "cid"))

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
        data, offsets = text_buffer(batch.column("text"))
        for i, j in slices(offsets):
            yield i, shingle_sets(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shingle)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, part in sets(batch):
                total += np.bincount((np.concatenate(part) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    counted = held.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SKETCH rows at most
    sketch = np.zeros(SKETCH, np.int64)
    sketch[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = large.sparkSession.sparkContext.broadcast(sketch)

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            for i, part in sets(batch):
                size = np.array([len(x) for x in part], np.int64)
                many = size + (-size * percent // 100) + 1  # n - ceil(t n) + 1
                token = [x[np.lexsort((x, sketch[(x % np.uint64(SKETCH)).astype(np.int64)]))[:m]] for x, m in zip(part, many, strict=True)]
                row = np.repeat(np.arange(len(part)), many)
                place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                wide = place * (100 + percent) <= size[row] * (100 - percent)
                take = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), batch.column("cid").take(take), batch.column("comp").take(take), pa.array(wide)], ["band", "cid", "comp", "wide"])

    each = checkpoint(held.mapInArrow(front, "band long, cid long, comp long, wide boolean"))
    live = each.groupBy("band").agg(F.min("cid").alias("leader"), F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("wide").alias("any")).where("lo <> hi AND any")
    return checkpoint(each.join(live.select("band", "leader", "n"), "band"))


def _posting_pairs(few: DataFrame) -> DataFrame:
    """Pairs of different components within small postings, one of them wide."""
    x, y = few.select("band", F.col("cid").alias("a"), F.col("comp").alias("ca"), F.col("wide").alias("wa")), few.select("band", F.col("cid").alias("b"), F.col("comp").alias("cb"), F.col("wide").alias("wb"))
    return x.join(y, "band").where("ca <> cb AND a < b AND (wa OR wb)").select("a", "b").distinct()


class _Forest:
    """Union-find over the components of one block."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _blocks(large: DataFrame, reps: DataFrame, texts: DataFrame, n_hashes: int, shingle: int, percent: int, miss: float) -> DataFrame:
    """Links that join different components of classes that large buckets hold together."""
    group = components(large.select(F.col("leader").alias("a"), F.col("cid").alias("b"))).toDF("cid", "grp")
    inside = checkpoint(large.select("cid", "comp").distinct().join(group, "cid").join(texts, "cid").join(reps, "cid"))
    # A row counts as one of BLOCK, or by its bytes if it is long.
    share = inside.groupBy("grp", "comp").agg(F.sum(F.greatest(F.lit(1 / BLOCK), F.octet_length("text") / BLOCK_BYTES)).alias("size"))
    main = share.groupBy("grp").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("total"))
    main = main.select("grp", F.col("main.comp").alias("main"), F.ceil(F.col("main.size")).alias("nm"), F.ceil(F.round(F.col("total") - F.col("main.size"), 6)).alias("no"))
    is_main, h = F.col("comp") == F.col("main"), F.xxhash64("cid")
    block = F.when(is_main, F.pmod(h, F.col("nm"))).otherwise(F.col("nm") + F.pmod(h, F.greatest("no", F.lit(1))))
    meets = F.when(is_main, F.sequence(F.col("nm"), F.col("nm") + F.col("no") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("nm") + F.col("no") - 1))
    placed = inside.join(main, "grp").where("no > 0").select("cid", "comp", "grp", "sig", "text", block.alias("own"), F.explode(meets).alias("other"))
    placed = placed.select("cid", "comp", "grp", "sig", "text", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def meet(rows: pa.Table) -> pa.Table:
        sig, cid, comp = _signatures(rows.column("sig"), n_hashes), np.asarray(rows.column("cid")), np.asarray(rows.column("comp"))
        own, p, q = np.asarray(rows.column("own")), rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        sets: list[np.ndarray] = []
        data, offsets = text_buffer(rows.column("text"))
        for i, j in slices(offsets):
            sets += shingle_sets(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shingle)
        size = np.array([len(x) for x in sets], np.int64)
        right = np.flatnonzero(own == q)
        # All shingles of the right side in order, and whose they are.
        flat, owner = np.concatenate([sets[k] for k in right]) if len(right) else np.zeros(0, np.uint64), np.repeat(right, size[right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        forest, a, b = _Forest(), [], []
        for i in np.flatnonzero(own == p):
            j = right[(comp[right] != comp[i]) & ((cid[right] > cid[i]) if p == q else True)]
            j = j[survives(sig[i][None, :], sig[j], percent / 100, miss)] if len(j) else j
            if not len(j):
                continue
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(cid))[j]
            for k in j[100 * both >= percent * (size[i] + size[j] - both)]:
                if forest.join(int(comp[i]), int(comp[k])):
                    a.append(cid[i])
                    b.append(cid[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("grp", "p", "q").applyInArrow(meet, "a long, b long")
