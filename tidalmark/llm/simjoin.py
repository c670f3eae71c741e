"""N-gram Jaccard join by universe partition.

A document's set holds its distinct shingles of ``n`` words (with fewer words,
the whole sequence as one).  Two documents link when
``100 * |A and B| >= percent * |A or B|``, so that their sets differ by at most
``bound(|A|, |B|)`` shingles.

*Size bands.*  A pair is found in the band of its smaller set; a set is indexed
in its own band and in those below where a partner may be.

*Segments.*  In a band whose sets differ by ``H`` at most, shingles are hashed
into ``m`` segments.  Each segment's subset is a signature; by the pigeonhole
one of ``H + 1`` of them is equal.  Empty segments carry no signature, so
``slack`` further segments make up for as many empty ones, and a set with more
empty ones adds the one-deletion neighbourhoods of its first segments, each of
which stands for two.  ``slack``, or one-deletion neighbourhoods throughout, is
chosen for each band by the expected number of signatures.

*Links.*  Equal sets are one class, whose smallest id stands for it.  Each class
meets the ``hubs`` best connected classes of its buckets (the number of
others in all of a class's buckets says how well it is connected, and a group's
original comes first), one after another, as long as their labels differ; exact
verification on whole sets follows each time, and linked classes get one label.  Buckets that still hold several labels are finished in
one of two exact ways.  Up to ``small`` classes are paired across labels.  In a
larger bucket two linked sets must also share one of their rarest shingles: by
any fixed order of shingles the first ``|A| - overlap + 1`` of either set meet,
and in an order that puts shingles of many sets last, sets that only share a
passage, or are copies of one text too far apart, mostly do not.  Shingles that
only sets of one label have are dropped first, and to the few others parities
of the sets are joined, which drop most of the rest inside the join of pairs.  So no pair inside a
linked group is made, no group is paired out, and no link is lost.

Sets are verified as 64-bit hashes of shingles (two shingles of a pair fall
together with a chance of 1 in 1e13 even in sets of a thousand), kept once for
those that share a signature; a parity sketch of each, a lower bound of the
difference, comes first.  A set's class is a 128-bit digest.

Nulls: a null or empty text has no shingle and links with nothing.  A row with
a null id has its n_shingles, takes part in no link, and its component is null.
Repeated rows are copies of each other; rows that repeat an id with other texts
each get the component of their own text, and two texts that have the same
smallest id count as one.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append, bit_map, bits_at, cut, dealt, discard, freed, parts, quoted, raw, spot, unused

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
PARITIES = 8
#: Bits of the map of ids that are copies.
COPY_BITS = 1 << 24


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int, memo: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(memo) > 200_000:
        memo.clear()
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * STEP + w[i : len(w) - k + 1 + i]
    return np.unique(mixed(h))


def digest(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def bound(a: int, b: int, percent: int) -> int:
    """Shingles in which linked sets of these sizes differ at most."""
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Size bands up to any size, made as needed."""

    def __init__(self, percent: int, ratio: float = 1.6):
        self.percent, self.ratio = percent, ratio
        self.made: list[tuple[int, int, int, int, bool]] = []

    def partner(self, size: int) -> int:
        """The largest size that may link with ``size``."""
        return size * 100 // self.percent

    def upto(self, size: int) -> None:
        while not self.made or self.made[-1][1] < size:
            low = self.made[-1][1] + 1 if self.made else 1
            high = max(low, int(low * self.ratio))
            differ = max(bound(high, s, self.percent) for s in range(high, self.partner(high) + 1))
            self.made.append((low, high, differ, *self.allocation(low, high, differ)))

    @staticmethod
    def allocation(low: int, high: int, differ: int) -> tuple[int, bool]:
        """Segments, and whether all of them have one-deletion neighbourhoods."""
        if differ == 0:
            return 0, False
        middle = (low + high) / 2
        best = (middle + -(-(differ + 1) // 2), -(-(differ + 1) // 2), True)
        for slack in range(6):
            m = differ + 1 + slack
            empty = (1 - 1 / m) ** low
            more = 0.0
            for e in range(slack + 1, min(m, slack + 12)):
                p = comb(m, e) * empty**e * (1 - empty) ** (m - e)
                more += p * (e - slack) * (middle / m + 1)
            if (cost := m + more) < best[0]:
                best = (cost, m, False)
        return best[1], best[2]

    def of(self, size: int) -> list[int]:
        """Bands in which a set of this size is indexed."""
        self.upto(size)
        k = next(i for i, b in enumerate(self.made) if b[1] >= size)
        return [j for j in range(k + 1) if j == k or self.partner(self.made[j][1]) >= size]


def signatures(found: np.ndarray, bands: Bands) -> np.ndarray:
    out = []
    for k in bands.of(len(found)) if len(found) else []:
        _, _, differ, m, everywhere = bands.made[k]
        if not m:
            continue
        seg = ((found >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        value = mixed(found + STEP)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, value)
        full = np.bincount(seg, minlength=m) > 0
        place = (np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32)) * STEP
        emit = full.copy()
        empties, slack = m - int(full.sum()), 0 if everywhere else m - differ - 1
        deep = m if everywhere else 0
        if not everywhere and empties > slack:
            reach = np.flatnonzero(np.cumsum(full) >= empties - slack)
            deep = int(reach[0]) + 1 if len(reach) else m
            if not len(reach):
                out.append(mixed(np.array([(k + 1) << 32], np.uint64) * MIX1))
        if deep:
            emit[:deep] = True
            near = seg < deep
            out.append(mixed((sums[seg[near]] - value[near]) ^ place[seg[near]]))
        out.append(mixed(sums[emit] ^ place[emit]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def described(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, n_shingles and class digest of each row."""

    def kernel():
        memo = Hashes()

        def run(texts):
            sets = [shingles(t, n, memo) for t in raw(texts)]
            return [len(s) for s in sets], [digest(s) if len(s) else None for s in sets]

        return run

    src = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return append(src, ["text"], "n_shingles long, class binary", kernel, ["id"])


def signed(docs: DataFrame, reps: DataFrame, copies: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id and signatures of the rows whose id is in ``reps``, and so not in ``copies``.

    Texts are read once more for them: to keep the signatures of all rows beside
    their digests would take more disk than the reading takes time.  A bit map of
    fixed size says of most rows that they are no copies: they stay where
    they lie, and only the others meet ``reps`` in a join, which decides.
    """
    shared = bits_at(copies, place_of("id"), COPY_BITS)

    def kernel():
        memo, bands, have = Hashes(), Bands(percent), shared.value

        def run(places, texts):
            found = [signatures(shingles(t, n, memo), bands).view(np.int64) for t in raw(texts)]
            at = places.to_numpy()
            return found, pa.array((have[at >> 3] << (at & 7)) & 128 == 0)

        return run

    src = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), place_of(id_col).alias("place"))
    made = append(src.where("id IS NOT NULL AND text IS NOT NULL"), ["place", "text"], "sigs array<long>, alone boolean", kernel, ["id"])
    rows = cut(made)
    met = freed(rows.where("NOT alone").join(reps, "id", "left_semi"))
    return rows.where("alone").union(met).select("id", "sigs")


def place_of(id_col: str) -> Column:
    """An id's place in the bit map of copies."""
    return F.pmod(F.xxhash64(quoted(id_col)), F.lit(COPY_BITS)).cast("int")


def sketch(found: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in a power of two of cells, at least
    twice as many cells as shingles."""
    cells = 1 << max(6, (2 * len(found)).bit_length())
    return np.packbits(np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def parities(found: np.ndarray) -> np.ndarray:
    """The same over 64 * PARITIES cells, as so many 64-bit numbers."""
    bits = np.bincount((found & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(bits).view(np.int64)


def differ(a: str, b: str) -> Column:
    """So many shingles at least are in only one of two sets, by their parities."""
    bits = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(PARITIES)]
    return reduce(Column.__add__, bits)


def apart(x: bytes, y: bytes) -> int:
    """So many shingles at least are in only one of two sets, by their
    sketches: each odd cell of the difference holds one."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int, deals: int) -> list[DataFrame]:
    """id, size, sketch, parities and packed set of the rows whose id is in ``wanted``
    (distinct ids), in ``deals`` parts by id.

    A bit map of fixed size drops most other rows before the shuffle; the
    join decides.  The rows lie by id in as many partitions as the session has
    for shuffles.
    """
    shared = bit_map(wanted, "id")
    src = docs.select(
        quoted(id_col).alias("id"),
        quoted(text_col).alias("text"),
        spot(quoted(id_col)).alias("spot"),
    ).where(F.col("id").isNotNull())
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        memo, have = Hashes(), np.unpackbits(shared.value)
        for batch in batches:
            part = batch.filter(pa.array(have[batch.column(2).to_numpy()] > 0))
            sets = [shingles(t, n, memo) for t in raw(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["id", "size", "sketch", "parity", "set"],
            )

    def made(deal: int) -> DataFrame:
        rows = src.where(F.col("spot") % deals == deal).mapInArrow(run, f"id {kind}, size long, sketch binary, parity array<long>, set binary")
        return rows.repartition(parts(docs), "id").join(wanted, "id", "left_semi")

    return [made(k) for k in range(deals)]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose documents link: sketches, a few bytes in a
    hundred of the sets, first drop pairs that differ too much for certain.

    ``sets`` lie in buckets of their ids, so pairs go to the sets of ``b``, and
    with these to those of ``a``: where few hubs meet many documents, the rows
    are then dealt by the document, and only sets of ``b`` travel.
    """

    def near():
        def run(na, nb, xa, xb):
            sides = zip(na.to_pylist(), nb.to_pylist(), xa.to_pylist(), xb.to_pylist(), strict=True)
            return ([apart(x, y) <= bound(m, k, percent) for m, k, x, y in sides],)

        return run

    def linked():
        def run(a, b):
            out = []
            for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            return (out,)

        return run

    def judged(pairs: DataFrame, columns: dict[str, str], kernel) -> DataFrame:
        inputs = [f"{k}{side}" for k in columns.values() for side in "ab"]
        joined = pairs
        for side in "ba":
            met = sets.select(F.col("id").alias(side), *[F.col(c).alias(f"{k}{side}") for c, k in columns.items()])
            joined = joined.join(met, side)
        return append(joined, inputs, "ok boolean", kernel, ["a", "b"]).where("ok").select("a", "b").distinct()

    close = freed(judged(cut(pairs), {"size": "n", "sketch": "x"}, near))
    return judged(close, {"set": "s"}, linked)


def components(links: DataFrame) -> DataFrame:
    """v and root (its component's smallest node) of every node of the links
    (a, b): smallest neighbouring label, then a jump to the label's label."""
    edges = cut(
        links.select(F.col("a").alias("v"), F.col("b").alias("w"))
        .union(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
        .where("v <> w")
        .distinct()
    )
    labels = cut(edges.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        near = edges.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("root").alias("near"))
        low = cut(labels.join(near, "v").select("v", F.least("root", "near").alias("root"), F.col("root").alias("old")))
        jump = low.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = cut(low.join(jump, "root", "left").select("v", F.coalesce("next", "root").alias("root"), "old"))
        done = new.where("root <> old").isEmpty()
        labels = new.select("v", "root")
        if done:
            return labels


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of two labels."""
    one = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return pairs.join(one, "a").join(two, "b").where("la <> lb").select("a", "b")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, size, label) after joining labels that ``links`` connect."""
    one = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    between = links.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = components(between).select(F.col("v").alias("label"), "root")
    return cut(labels.join(roots, "label", "left").select("id", "size", F.coalesce("root", "label").alias("label")))


def overlap(a: int, b: int, percent: int) -> int:
    """Shingles that linked sets of these sizes share at least."""
    return -(-percent * (a + b) // (100 + percent))


def cells_of(sets: DataFrame, cells: int) -> np.ndarray:
    """How many shingles of ``sets`` fall into each of ``cells`` cells; tasks
    sum first, so the driver gets ``cells`` numbers at most."""

    def run(batches):
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                counts += np.bincount((np.frombuffer(s, np.uint64) % np.uint64(cells)).astype(np.int64), minlength=cells)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["cell", "n"])

    rows = sets.select("set").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def rarest(sets: DataFrame, percent: int, cells: int) -> DataFrame:
    """token, place, id and label for the shingles of each set of which a
    linked set has one: first those of the emptiest cells."""
    shared = sets.sparkSession.sparkContext.broadcast(cells_of(sets, cells))

    def kernel():
        often = shared.value

        def run(packed):
            out = []
            for s in packed.to_pylist():
                found = np.frombuffer(s, np.uint64)
                order = np.lexsort((found, often[(found % np.uint64(cells)).astype(np.int64)]))
                a = len(found)
                first = a - overlap(a, -(-a * percent // 100), percent) + 1
                out.append(found[order[:first]].view(np.int64))
            return (out,)

        return run

    made = append(sets, ["set"], "tokens array<long>", kernel, ["id", "label"])
    return made.select("id", "label", F.posexplode("tokens").alias("place", "token"))


def several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` has rows of more than one label."""
    whole = Window.partitionBy(key)
    low, high = F.min("label").over(whole), F.max("label").over(whole)
    return rows.withColumns({"l0": low, "l1": high}).where("l0 <> l1").drop("l0", "l1")


def shared(kept: DataFrame, deals: int, deal: int) -> DataFrame:
    """sig, id, n and weight of the buckets of several rows, from one of ``deals``
    parts of all signatures: so the shuffle files of one part are on disk at once.

    Signatures that the same rows have make one bucket: linked texts share many
    of theirs, and each would be carried through every later join.  ``sig`` is then
    a hash of the bucket's rows, ``n`` the number of them and ``weight`` that of
    its signatures.  Two buckets of equal hashes become one that holds the rows of
    both, so no pair is lost.
    """
    whole = Window.partitionBy("sig")
    rows = kept.select(F.explode("sigs").alias("sig"), "id").where(F.pmod("sig", F.lit(deals)) == deal)
    met = rows.select(
        "id",
        F.count("*").over(whole).alias("n"),
        F.xxhash64(F.bit_xor(F.xxhash64("id")).over(whole), F.min("id").over(whole), F.max("id").over(whole)).alias("sig"),
    )
    return bucketed(met.where("n > 1").withColumn("weight", F.lit(1).cast("long")))


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (sig, id, n, weight) with one row for each sig and id."""
    return rows.groupBy("sig", "id").agg(F.max("n").alias("n"), F.sum("weight").alias("weight"))


def connected(live: DataFrame, percent: int, hubs: int) -> DataFrame:
    """a, b and place (from 0): each id with the best connected ids of its buckets."""
    near = F.struct((-F.col("others")).alias("o"), "id", "size").alias("hub")
    best = live.groupBy("sig").agg(F.min(near).alias("hub"))
    fits = (F.col("size") * 100 >= F.col("hub.size") * percent) & (F.col("hub.size") * 100 >= F.col("size") * percent)
    return (
        live.join(best, "sig")
        .where((F.col("id") != F.col("hub.id")) & fits)
        .groupBy("id")
        .agg(F.slice(F.array_sort(F.collect_set("hub")), 1, hubs).alias("hubs"))
        .select(F.col("id").alias("a"), F.posexplode("hubs.id").alias("place", "b"))
    )


def remaining(live: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, small: int, cells: int, deals: int) -> DataFrame:
    """Pairs (a, b) across labels that may link."""
    tagged = live.select("sig", "id", "size").join(labels.select("id", "label"), "id")
    labelled = (
        tagged.groupBy("sig")
        .agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("n"))
        .where("l0 <> l1")
        .select("sig", "n")
    )
    rest = cut(tagged.join(labelled, "sig"))
    crowded = cut(rest.where(F.col("n") > small).groupBy("id").agg(F.first("label").alias("label")))

    def ends(rows: DataFrame, key: str, *more: str) -> tuple[DataFrame, DataFrame]:
        sides = [rows.select(key, *[F.col(c).alias(f"{c}_{k}") for c in ("id", "size", "label", "parity", *more)]) for k in "ab"]
        return sides[0], sides[1]

    first = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("id_a") < F.col("id_b")))
    near = differ("parity_a", "parity_b") * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    fits = F.col("size_a") * 100 >= F.col("size_b") * percent
    open_pair = first & (F.col("label_a") != F.col("label_b")) & fits & near
    one, two = ends(rest.where(F.col("n") <= small).join(sets.select("id", "parity"), "id"), "sig")
    few = one.join(two, "sig").where(open_pair)
    tokens = cut(rarest(sets.join(crowded, "id"), percent, cells))
    # Two sets that share so many shingles have one among the first of either that
    # leave so many in it.  Told of the pair, not of a side, it lets one exchange serve both.
    need = F.lit(percent) * (F.col("size_a") + F.col("size_b"))
    leading = [(F.col(f"size_{k}") - F.col(f"place_{k}")) * (100 + percent) >= need for k in "ab"]
    found = [few.select("id_a", "id_b")]
    for deal in range(deals):  # so the shuffle files of one part of the tokens are on disk at once
        # Most tokens are of one set or one label: only the others' rows carry parities.
        met = freed(several(tokens.where(F.pmod("token", F.lit(deals)) == deal), "token"))
        one, two = ends(met.join(sets.select("id", "size", "parity"), "id"), "token", "place")
        many = one.join(two, "token").where(open_pair & leading[0] & leading[1])
        found.append(freed(many.select("id_a", "id_b").distinct()))
    discard(tokens)
    return reduce(DataFrame.union, found).distinct().toDF("a", "b")


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 4,
    percent: int = 85,
    hubs: int = 3,
    small: int = 8,
    cells: int = 1 << 18,
    deals: int = 4,
) -> DataFrame:
    """id, n_shingles and component_id of each row of ``docs``."""
    rows = cut(described(docs, id_col, text_col, n))
    classes = cut(
        rows.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("size"))
    )
    reps = classes.select(F.col("rep").alias("id")).distinct()
    copies = rows.where("class IS NOT NULL AND id IS NOT NULL").select("id").join(reps, "id", "left_anti")
    kept = signed(docs, reps, copies, id_col, text_col, n, percent)
    live = freed(bucketed(reduce(DataFrame.union, [freed(shared(kept, deals, k)) for k in range(deals)])))
    discard(kept)
    others = live.groupBy("id").agg(F.sum(F.col("n") * F.col("weight")).alias("others"))
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.max("size").alias("size"))
    labels = cut(others.join(sizes, "id").select("id", "size", F.col("id").alias("label"), "others"))
    live = freed(live.select("sig", "id").join(labels.select("id", "size", "others"), "id"))
    best = freed(connected(live, percent, hubs))
    with dealt(sets_of(docs, labels.select("id"), id_col, text_col, n, deals), "id") as sets:
        for place in range(hubs):
            found = verified(across(best.where(F.col("place") == place), labels), sets, percent)
            labels = relabelled(labels, freed(found))
        left = remaining(live, labels, sets, percent, small, cells, deals)
        labels = relabelled(labels, cut(verified(left, sets, percent)))
    # A label is some class's representative; the component's id is the smallest.
    small = labels.groupBy("label").agg(F.min("id").alias("component_id"))
    by_class = (
        classes.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
        .join(small, "label", "left")
        .select("class", F.coalesce("component_id", "rep").alias("component_id"))
    )
    return rows.join(by_class, "class", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


def first_of_group(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component.

    Rows that repeat an id are one document, of which the row with the smallest
    text stays.  Rows with a null id stay.
    """
    text_col = options.get("text_col", "text")
    key, place = unused(docs, "key"), unused(docs, "place")
    found = join(docs, id_col, **options).select(quoted(id_col).alias(key), "component_id").where(quoted(key).isNotNull())
    by_id = cut(found.groupBy(key).agg(F.min(F.col("component_id") != F.col(key)).alias("other"), F.count("*").alias("n")))
    cols = [quoted(c) for c in docs.columns]
    gone = by_id.where("other OR n > 1").select(key)
    left = docs.join(gone, quoted(id_col) == F.col(key), "left_anti").select(*cols)
    again = by_id.where("NOT other AND n > 1").select(key)
    if again.isEmpty():
        return left
    order = Window.partitionBy(quoted(id_col)).orderBy(quoted(text_col))
    once = docs.join(again, quoted(id_col) == F.col(key), "left_semi").withColumn(place, F.row_number().over(order))
    return left.unionByName(once.where(F.col(place) == 1).select(*cols))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r AS (SELECT a AS v, a AS m FROM e UNION SELECT e.b AS v, r.m FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       coalesce((SELECT min(m) FROM r WHERE r.v = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
