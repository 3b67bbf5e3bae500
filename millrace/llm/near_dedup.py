"""Near duplicates by order MinHash, verified by banded alignment.

Words are lower-cased and stripped of punctuation at their ends.  Each of
``SKETCHES`` hash functions picks the ``PICKED`` least of a text's k-mers of
``K`` words, every k-mer labelled with its occurrence, and keeps them in text
order; texts that share one such tuple share a bucket.  A bucket's texts are
candidates; two texts are linked if the edit similarity of their words,
``1 - distance / longer``, is ``SIMILARITY`` or more by a bit-parallel
alignment within the band that this allows.  Classes are the components.

Edited copies lose up to ``K`` k-mers a change.  Two texts that share a
fraction ``j`` of their labelled k-mers, in like order, meet in some bucket
with probability ``1 - (1 - j**2)**32``: 1 - 1e-14 at 0.8, 0.9999 at 0.5,
0.996 at 0.4.

Cost.  Equal texts are one node from the start.  In each bucket every text is
first aligned with one hub (the text that meets most others), so a group of
thousands of copies costs thousands of alignments.  What stays apart in a
bucket after that goes through an exact stage: the bucket is cut by length
into blocks of bounded size, blocks of lengths too far apart never meet, and
inside a task two blocks are compared by an upper bound (common words, with
multiplicity).  Only pairs of different components that pass it are aligned,
each in the first bucket that its texts share, and only links leave the task.
No bucket, group or list of candidates is capped, and no pairs are written but
links.  The rows of a large bucket, of a hub, of a class or of equal texts are
dealt to several tasks wherever they meet their one row (``skew``).

Words are compared by 32 bits of a hash, texts are equal by their MD5.  Two
different words of two texts are taken for one with odds of 2**-32 a pair of
words, which can lower a distance by the places where they stand opposite
each other; two different texts agree in MD5 with odds of 2**-128 a pair.

Defined results: a null text counts as empty; texts without words are linked
only to equal texts; a text under ``K`` words is one k-mer.  Repeated rows and
equal texts share a class.  A class is named by its least doc_id (null if all
its doc_ids are null).  A very long text is sketched and aligned whole; the
band grows with its length.  An empty table gives an empty result.  Columns of
the input may have any names: ``label`` reads two, ``keep_one`` returns all.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.skew import Hot
from millrace.storage import discard, gather, materialize

K = 5
SIMILARITY = 0.8
SKETCHES = 32
PICKED = 2
BLOCK = 512
BINS = 256
#: Texts, or pairs of them, that one task may well read and align.
TEXTS = 1 << 10
_MASK = (1 << 64) - 1
_CACHE = 1 << 18


def text_key(text: Column) -> Column:
    """What makes texts one node: the MD5 of the text itself."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Words:
    """64-bit hashes of a text's normalised words; the cache of words is bounded."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        words = text.lower().split()
        for word in set(words).difference(known):
            bare = word.strip(string.punctuation)
            known[word] = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1 if bare else 0
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        return hashes[hashes != 0]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers with their occurrence numbers, in text order."""
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    joined = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + _mix(words[i : i + n])
    joined = _mix(joined + np.uint64(width))
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if not new.all():
        place = np.arange(n)
        occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
        label = np.empty(n, dtype=np.uint64)
        label[order] = occurrence.astype(np.uint64)
        joined = np.where(label > 0, _mix(joined + label * np.uint64(0xD6E8FEB86659FD93)), joined)
    return joined


_ODD = np.random.default_rng(7).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def order_minhash(labelled: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """One bucket per hash function: the two least k-mers in text order."""
    n = len(labelled)
    out = np.empty(sketches, dtype=np.uint64)
    if n == 0:
        return out[:0]
    group = max(1, (1 << 20) // n)
    for at in range(0, sketches, group):
        odd = _ODD[at : at + group, None]
        values = labelled[None, :] * odd
        values ^= values >> np.uint64(32)
        rows = np.arange(len(values))
        first = values.argmin(axis=1)
        values[rows, first] = np.uint64(_MASK)
        second = values.argmin(axis=1) if n > 1 else first
        early, late = np.minimum(first, second), np.maximum(first, second)
        pair = _mix(labelled[early] + odd[:, 0]) * np.uint64(3) + _mix(labelled[late] ^ odd[:, 0])
        out[at : at + group] = _mix(pair + np.arange(at, at + len(values), dtype=np.uint64))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        buckets = [order_minhash(kmers(words(t.as_py() or ""))).view(np.int64) for t in batch.column(1)]
        offsets = np.r_[0, np.cumsum([len(b) for b in buckets])].astype(np.int32)
        flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "buckets"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        whole = [words(t.as_py() or "") for t in batch.column(1)]
        found = [(w >> np.uint64(16)).astype("<u4") for w in whole]
        signs = [np.sort(order_minhash(kmers(w)).view(np.int64)).tobytes() for w in whole]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(f) for f in found], pa.int32()),
                pa.array([f.tobytes() for f in found], pa.binary()),
                pa.array(signs, pa.binary()),
                pa.array([_histogram(f) for f in found], pa.binary()),
            ],
            names=["key", "n", "words", "signs", "bins"],
        )


def _histogram(words: np.ndarray) -> bytes:
    count = np.bincount(words % BINS, minlength=BINS)
    return count.astype("<u2" if count.max() < 1 << 16 else "<u4").tobytes()


def distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two word sequences if it is at most ``most``, else some number above.

    A band of ``2 * most + 1`` rows slides down one row a column.  Bit ``k`` of the vertical deltas stands for row
    ``column - most + k``; rows up to 0 are filled so that row 0 counts its columns.  The score is followed along
    the diagonal that ends in the last cell, where it grows whenever the diagonal delta isn't 0.
    """
    if len(a) < len(b):
        a, b = b, a
    n = len(b)
    differ = np.nonzero(a[:n] != b)[0]
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    if len(b):
        differ = np.nonzero(a[::-1][: len(b)] != b[::-1])[0]
        end = int(differ[0]) if len(differ) else len(b)
        a, b = a[: len(a) - end], b[: len(b) - end]
    gap = len(a) - len(b)
    if gap > most or not len(b):
        return max(len(a), len(b))
    most = min(most, len(a))
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | (1 << (i + most))
    width = 2 * most + 1
    full, top, diagonal = (1 << width) - 1, 1 << (width - 1), 1 << (most + gap)
    down = (1 << (most + 1)) - 1  # rows whose cell is one less than the cell above
    up = full ^ down
    score = gap
    for column, word in enumerate(b.tolist()):
        up = (up >> 1) | top
        down >>= 1
        equal = (places.get(word, 0) >> column) & full
        level = ((((equal & up) + up) ^ up) | equal | down) & full
        right_up = down | (full & ~(up | level))
        right_down = up & level
        right_up = (right_up << 1) | 1
        right_down <<= 1
        up = (right_down | ~(right_up | level)) & full
        down = right_up & level & full
        if not level & diagonal:
            score += 1
            # every later column adds nothing below zero, so this never shrinks
            if score > most:
                return score
    return score


def allowed(longer: int, similarity: float = SIMILARITY) -> int:
    return int(np.floor((1 - similarity) * longer + 1e-9))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity is at least ``similarity``; common words bound it from above first."""
    longer = max(len(a), len(b))
    most = allowed(longer, similarity)
    if abs(len(a) - len(b)) > most:
        return False
    common = np.minimum(np.bincount(a & 1023, minlength=1024), np.bincount(b & 1023, minlength=1024)).sum()
    return longer - common <= most and distance_within(a, b, most) <= most


def _aligned(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(x).to_pylist() for x in ("a_words", "b_words"))
            keep = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), a table, whose texts are similar, written down; ``a`` may be in any number of them."""
    side = lambda x: texts.select(F.col("key").alias(x), F.col("words").alias(f"{x}_words"))
    hot = Hot(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", "n")
    both = hot.join(pairs.join(side("b"), "b"), side("a"), F.col("b")).select("a", "b", "a_words", "b_words")
    found = both.mapInArrow(_aligned(similarity), "a binary, b binary")
    found = materialize(gather(found, pairs.count(), TEXTS), "near-links")
    discard(pairs.sparkSession, pairs)
    return found


class _Group:
    """The rows of one pair of blocks, and the pairs of its texts that may be similar."""

    def __init__(self, rows: list[tuple], similarity: float):
        self.bucket, low, high = rows[0][0], rows[0][1:3], rows[0][3:5]
        self.same = low == high
        self.left = [r for r in rows if r[5:7] == low]
        self.right = self.left if self.same else [r for r in rows if r[5:7] == high]
        self.similarity = similarity
        self.order = {root: k for k, root in enumerate({r[8] for r in rows})}

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each row on the left the rows on the right in another component that may be similar to it.

        A pair belongs to the first bucket that its texts share, so no pair is looked at twice.
        """
        if not self.left or not self.right:
            return
        n = np.array([r[9] for r in self.right])
        bins = np.stack([_bins(r[10]) for r in self.right])
        signs = np.stack([np.frombuffer(r[11], "<i8") for r in self.right])
        roots = np.array([self.order[r[8]] for r in self.right])
        for x, row in enumerate(self.left):
            longer = np.maximum(row[9], n)
            lost = longer - np.minimum(_bins(row[10]), bins).sum(axis=1)
            ok = (roots != self.order[row[8]]) & (lost <= np.floor((1 - self.similarity) * longer + 1e-9))
            if self.same:
                ok[: x + 1] = False
            found = np.nonzero(ok)[0]
            if len(found):
                sign = np.frombuffer(row[11], "<i8")
                earlier = np.isin(signs[found], sign[sign < self.bucket]) & (signs[found] < self.bucket)
                found = found[~earlier.any(axis=1)]
            if len(found):
                yield x, found


def _bins(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * BINS else "<u4").astype(np.int32)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in runs of equal first five columns; a run is one pair of blocks, so it is bounded."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:5] != row[:5]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _promising(similarity: float):
    """The rows of each run that may be similar to another: (bucket, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            group = _Group(rows, similarity)
            keys = set()
            for x, found in group.candidates():
                keys.add(group.left[x][7])
                keys.update(group.right[y][7] for y in found)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group.bucket] * len(keys), pa.int64()), pa.array(list(keys), pa.binary())], names=["bucket", "key"]
                )

    return run


def _linked(similarity: float):
    """The links of each run: pairs are aligned unless earlier links of the run have joined their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            group = _Group(rows, similarity)
            parent = list(range(len(group.order)))

            def top(k: int, parent=parent) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            out = []
            for x, found in group.candidates():
                one = np.frombuffer(group.left[x][12], "<u4")
                for y in found:
                    r1, r2 = top(group.order[group.left[x][8]]), top(group.order[group.right[y][8]])
                    if r1 != r2 and similar(one, np.frombuffer(group.right[y][12], "<u4"), similarity):
                        parent[r1] = r2
                        out.append((group.left[x][7], group.right[y][7]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _blocked(rows: DataFrame, hot: Hot, texts: DataFrame, similarity: float, *payload: str) -> DataFrame:
    """Deal a bucket's rows, which have the ``salt`` of ``hot``, to pairs of blocks, with what ``texts`` have.

    Blocks are cut within bands of length, such that similar texts lie in the same band or in neighbouring ones.
    A row goes to every pair of blocks that it may find a partner in.
    """
    band = F.floor(F.ln(F.col("n").cast("double")) / float(-np.log(similarity) * (1 + 1e-9))).cast("int")
    rows = rows.withColumn("band", band)
    per_band = rows.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("size"))
    cut = F.struct("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    blocks = per_band.groupBy("bucket").agg(F.map_from_entries(F.collect_list(cut)).alias("blocks"), F.sum("size").alias("size"))
    rows = rows.join(hot.repeat(blocks), ["bucket", "salt"])
    # a bucket that fits in a block is one, whatever the lengths in it
    small = F.col("size") <= BLOCK
    rows = rows.withColumn("band", F.when(small, F.lit(0)).otherwise(F.col("band")))
    count = lambda d: F.when(small, F.lit(int(d == 0))).otherwise(F.coalesce(F.try_element_at("blocks", F.col("band") + d), F.lit(0)))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("key"), count(0)).cast("int"))
    none = F.array().cast("array<struct<lo:int,a:int,hi:int,b:int>>")

    def pairs(d: int, make) -> Column:
        return F.when(count(d) > 0, F.transform(F.sequence(F.lit(0), count(d) - 1), make)).otherwise(none)

    def pair(lo, a, hi, b) -> Column:
        return F.struct(lo.alias("lo"), a.alias("a"), hi.alias("hi"), b.alias("b"))

    here, sub = F.col("band"), F.col("sub")
    own = pairs(0, lambda s: pair(here, F.least(sub, s), here, F.greatest(sub, s)))
    above = pairs(1, lambda s: pair(here, sub, here + 1, s))
    below = pairs(-1, lambda s: pair(here - 1, s, here, sub))
    rows = rows.join(texts.select("key", "bins", "signs", *payload), "key")
    dealt = rows.withColumn("to", F.explode(F.concat(own, above, below)))
    dealt = dealt.select("bucket", "to.lo", "to.a", "to.hi", "to.b", "band", "sub", "key", "root", "n", "bins", "signs", *payload)
    where = ["bucket", "lo", "a", "hi", "b"]
    return dealt.repartition(*where).sortWithinPartitions(*where)


def _apart(members: DataFrame, hot: Hot, texts: DataFrame, tied: DataFrame, similarity: float) -> DataFrame:
    """Links between texts that share a bucket and aren't known to be of a component.

    Texts with the same least ``root`` in ``tied`` are.  A first pass over small signatures finds the texts that may
    have such a link in a bucket at all; a second pass over those texts' words aligns their pairs.
    """
    roots = tied.groupBy("node").agg(F.min("root").alias("root"))
    known = texts.select("key", "n").join(roots, F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce("root", "key").alias("root"))
    placed = members.join(known, "key").select("bucket", "salt", "key", "root", "n")
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    most = members.count()
    rows = materialize(gather(placed.join(hot.repeat(split), ["bucket", "salt"]), most), "near-split")
    hopeful = _blocked(rows, hot, texts, similarity).mapInArrow(_promising(similarity), "bucket long, key binary").distinct()
    hopeful = materialize(gather(hopeful, most), "near-hopeful")
    again = rows.join(hopeful, ["bucket", "key"])
    links = materialize(_blocked(again, hot, texts, similarity, "words").mapInArrow(_linked(similarity), "a binary, b binary"), "near-apart")
    discard(members.sparkSession, rows, hopeful)
    return links


def links(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``node`` and ``root`` of every text (by ``text_key``) that is linked to another; roots themselves have no row."""
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    sketches = keyed.mapInArrow(_sketch, "key binary, buckets array<bigint>").dropDuplicates(["key"])
    sketches = materialize(sketches, "near-sketches")
    nodes = sketches.count()
    all_members = sketches.select(F.explode("buckets").alias("bucket"), "key")
    shared = all_members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(gather(shared, nodes * SKETCHES), "near-buckets")
    hot = Hot(shared, "bucket", "size")
    members = hot.salt(all_members, F.col("key")).join(hot.repeat(shared), ["bucket", "salt"])
    members = materialize(gather(members, nodes * SKETCHES), "near-members")
    wanted = members.select("key").distinct()
    # copies go before the texts are moved for the join
    texts = keyed.dropDuplicates(["key"]).join(wanted, "key", "left_semi").mapInArrow(_words, "key binary, n int, words binary, signs binary, bins binary")
    texts = materialize(gather(texts, nodes, TEXTS), "near-texts")
    fame = members.groupBy("key").agg(F.sum("size").alias("fame"))
    hubs = members.join(fame, "key").groupBy("bucket").agg(F.max(F.struct("fame", "key")).alias("hub"))
    pairs = members.join(hot.repeat(hubs), ["bucket", "salt"]).select(F.col("hub.key").alias("a"), F.col("key").alias("b")).where("a <> b").distinct()
    found = _verify(materialize(gather(pairs, members.count()), "near-pairs"), texts, similarity)
    # what is still to be tied after two rounds costs the next stage some pairs, and the last rounds finish it
    first = components(found, rounds=2, most=found.count())
    more = _apart(members, hot, texts, first, similarity)
    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    roots = components(edges, most=edges.count())
    # the result is a table of its own; nothing reads these any more
    discard(docs.sparkSession, sketches, shared, members, texts, found, first, more)
    return roots


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, Hot]:
    """One row per text key, written down: ``text_key``, ``class_key`` (the class's root), ``class_id`` (its least doc_id) and ``class_docs``; and the keys of many rows."""
    roots = links(docs, text, similarity)
    per_key = docs.select(text_key(F.col(text)).alias("text_key"), F.col(doc_id).alias("doc_id")).groupBy("text_key")
    per_key = per_key.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"))
    per_key = per_key.join(roots, F.col("text_key") == F.col("node"), "left")
    per_key = materialize(per_key.select("text_key", "least", "docs", F.coalesce("root", "text_key").alias("class_key")), "near-keys")
    named = per_key.groupBy("class_key").agg(F.min("least").alias("class_id"), F.sum("docs").alias("class_docs"), F.count(F.lit(1)).alias("keys"))
    hot = Hot(named, "class_key", "keys")
    known = hot.join(per_key.select("text_key", "class_key"), named.drop("keys"), F.col("text_key"))
    known, many = materialize(gather(known, per_key.count()), "near-classes"), Hot(per_key, "text_key", "docs")
    discard(docs.sparkSession, per_key, roots)
    return known, many


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and class_docs of every row."""
    known, many = classes(docs, doc_id, text, similarity)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"))
    return many.join(rows, known, F.col("doc_id")).select("doc_id", "class_id", "class_docs")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near duplicates: of each class the row of least doc_id stays (the least text hash, then row hash, among equals)."""
    boxed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key")
    )
    known, many = classes(docs, doc_id, text, similarity)
    rows = many.join(boxed.select("doc_id", "text_key", F.xxhash64("doc").alias("row")), known, F.col("row"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "row")
    alike = rows.groupBy("class_key", order.alias("first")).agg(F.count(F.lit(1)).alias("alike"))
    first = alike.groupBy("class_key").agg(F.min(F.struct("first", "alike")).alias("m"))
    first = first.select(F.col("m.first.doc_id").alias("k0"), F.col("m.first.text_key").alias("k1"), F.col("m.first.row").alias("k2"), "m.alike")
    on = (F.col("text_key") == F.col("k1")) & F.col("doc_id").eqNullSafe(F.col("k0")) & (F.xxhash64("doc") == F.col("k2"))
    kept = boxed.join(first, on)
    # rows that agree in every column are still there as often as they were given
    several = kept.where("alike > 1").groupBy("text_key").agg(F.first("doc").alias("doc"))
    return kept.where("alike = 1").select("doc.*").union(several.select("doc.*"))
