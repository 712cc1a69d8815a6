"""Operator 8: near-duplicate groups by b-bit MinHash.

1. One pass over the texts: the set of word shingles of each as sorted 64-bit
   hashes, its 128-bit fingerprint, ``PERMUTATIONS`` minima, of which the band
   keys and the low ``BITS`` bits, packed into longs, are kept.
2. Documents with one fingerprint have equal sets: one of them, the smallest
   id, stands for the class. Copies never become pairs.
3. Band keys are grouped. In a small bucket all pairs are candidates; in a
   large one each member meets the bucket's smallest and largest id.
4. Candidates whose bit counts, corrected for chance matches of the low bits,
   rule out the wanted similarity by a wide margin are dropped. First each
   document's best candidate is confirmed on the full sets; then every other
   candidate between two components found so far.
5. Large buckets whose members are still in several components are finished in
   blocks: all members outside the largest component meet all members, in cells
   of bounded size, where common shingles are counted exactly. Only links leave
   a cell. So no pair that shares a band is left out unless one component
   already holds both.

Links are confirmed exactly on the full sets, so there are no false ones. A
pair at similarity s shares no band with probability (1 - s^ROWS)^BANDS: at
most 5e-8 for s >= 0.8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import WORD_RE, as_text, cut, discard, fresh, map_rows, mix64, store

SHINGLE_WORDS = 5
PERCENT = 80              # links: 100 * common >= PERCENT * union
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
BITS = 4                  # low bits kept of each minimum
WORDS64 = PERMUTATIONS * BITS // 64
MARGIN = 0.2              # over five standard errors of the estimate at 0.8
SMALL_BUCKET = 12         # all pairs up to this many members
CELL = 512                # members of a block of a cluster, about
CELL_SHINGLES = 1 << 20   # shingles of a block, about
SLICE = 4096              # shingles in one step of a cell's count
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingle_set(text: str, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text.

    A-Z count as a-z. A text of fewer words is one shingle; one without words
    has none.
    """
    words = WORD_RE.findall(text.translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    ids, distinct = pd.factorize(np.array(words, dtype=object))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct),
                    np.uint64, len(distinct))[ids]
    k = min(n, len(words))
    m = len(words) - k + 1
    out = np.full(m, np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * _FOLD + h[i: i + m])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit value of the set under each permutation."""
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = shingles[at: at + 4096, None]
            best = np.minimum(best, ((part * _A + _B) >> np.uint64(32)).min(axis=0))
    return best


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; different bands don't share keys."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row in mins.reshape(BANDS, ROWS).T:
            key = mix64(key * _FOLD + row)
    return key.view(np.int64)


def pack(mins: np.ndarray) -> np.ndarray:
    """The low bits of all minima, side by side in longs."""
    low = (mins & np.uint64((1 << BITS) - 1)).reshape(WORDS64, -1)
    shifts = np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS)
    return (low << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


_GROUP_MASK = sum(1 << (BITS * k) for k in range(64 // BITS))  # lowest bit of each group
_GROUP_MASK -= (1 << 64) * (_GROUP_MASK >> 63)


def similarity_of(differing: int | Column | np.ndarray):
    """Similarity estimated from the number of minima whose low bits differ.

    Unequal minima agree in their low bits by chance once in 2^BITS.
    """
    chance = 2.0 ** -BITS
    return ((1.0 - differing / float(PERMUTATIONS)) - chance) / (1.0 - chance)


def _differing(a: Column, b: Column) -> Column:
    """Groups of BITS bits in which two packed signatures (arrays of longs) differ."""
    def groups(x: Column) -> Column:
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(F.lit(_GROUP_MASK)))

    return F.aggregate(F.zip_with(a, b, lambda x, y: groups(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """doc_id, n_shingles, fp, sig, bands of every row; the last three null without words."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in frame["text"]:
            s = shingle_set(as_text(t), n)
            if len(s):
                mins = minima(s)
                out.append((len(s), fingerprint(s), pack(mins), band_keys(mins)))
            else:
                out.append((0, None, None, None))
        got = pd.DataFrame(out, columns=["n_shingles", "fp", "sig", "bands"])
        got.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
        return got

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(cols, run, "doc_id long, n_shingles long, fp binary, sig array<long>, bands array<long>")


def connected(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for the nodes of the links (a, b).

    Each round every node moves two steps along smallest neighbours, and the
    links are rewritten between the new places; links within one place go. The
    links shrink fast; the rounds are written as tables in the shared folder.
    """
    spark = links.sparkSession
    edges, edges_at = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                            .where("a <> b").distinct())
    labels, labels_at = None, None
    while True:
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(
            edges.select(F.col("a").alias("node"), F.col("a").alias("near")))
        near = ends.groupBy("node").agg(F.min("near").alias("to"))
        near, near_at = store(near)
        step = near.join(near.toDF("to", "next"), "to").select("node", F.col("next").alias("place"))
        step, step_at = store(step)
        discard(spark, near_at)
        if labels is None:
            labels, labels_at = store(step.select("node", F.col("place").alias("comp")))
        else:
            moved, moved_at = store(labels.join(step.toDF("comp", "place"), "comp", "left")
                                    .select("node", F.coalesce("place", "comp").alias("comp")))
            discard(spark, labels_at)
            labels, labels_at = moved, moved_at
        kept = (edges.join(step.toDF("a", "pa"), "a").join(step.toDF("b", "pb"), "b").where("pa <> pb")
                .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        kept, kept_at = store(kept)
        discard(spark, edges_at)
        discard(spark, step_at)
        edges, edges_at = kept, kept_at
        if not edges.limit(1).count():
            out = cut(labels)
            discard(spark, labels_at)
            discard(spark, edges_at)
            return out


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        linked = []
        for x, y in zip(frame["sa"], frame["sb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * common >= percent * (len(x) + len(y) - common))
        return frame.loc[linked, ["a", "b"]]

    joined = (pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
              .join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a"))
    return map_rows(joined.select("a", "b", "sa", "sb"), run, "a long, b long")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs with their estimate, without those that sizes or estimate rule out."""
    a = reps.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("weight").alias("wa"))
    b = reps.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("weight").alias("wb"))
    sizes = 100 * F.least("wa", "wb") >= percent * F.greatest("wa", "wb")
    est = pairs.join(a, "a").join(b, "b").where(sizes).select(
        "a", "b", similarity_of(_differing(F.col("sa"), F.col("sb"))).alias("est"))
    return est.where(F.col("est") >= percent / 100 - MARGIN)


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    a = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb"))


def _possible(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs of rows (comp, sig, weight) are worth an exact count.

    They lie in different components, their sizes allow the similarity, and
    their bit counts do not rule it out.
    """
    sx, sy = (np.stack(list(s["sig"])).astype(np.int64).view(np.uint64) for s in (x, y))
    mask = np.uint64(_GROUP_MASK & (2**64 - 1))
    diff = np.zeros((len(x), len(y)), np.int16)
    for w in range(WORDS64):
        d = sx[:, w, None] ^ sy[None, :, w]
        step = 1
        while step < BITS:
            d = d | (d >> np.uint64(step))
            step *= 2
        diff += np.bitwise_count(d & mask)
    nx, ny = x["weight"].to_numpy()[:, None], y["weight"].to_numpy()[None, :]
    return ((similarity_of(diff) >= percent / 100 - MARGIN)
            & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
            & (x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]))


def _link_cell(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the rows of x and y, one per pair of components.

    Rows: node, comp, weight, sig, set. Common shingles are counted exactly, as
    a product of 0/1 matrices over slices of the shingles that both sides have.
    """
    possible = _possible(x, y, percent)
    x, y = x[possible.any(axis=1)], y[possible.any(axis=0)]
    if not len(x):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

    def flat(sets) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(s, np.uint64) for s in sets]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    vx, nx = flat(x["set"])
    vy, ny = flat(y["set"])
    both = np.intersect1d(vx, vy)
    common = np.zeros((len(nx), len(ny)), np.float32)

    def within(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.searchsorted(both, values)
        hit = both[np.minimum(col, len(both) - 1)] == values
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    if len(both):
        rx, cx = within(vx, nx)
        ry, cy = within(vy, ny)
        for at in range(0, len(both), SLICE):
            def part(r, c, rows):
                lo, hi = np.searchsorted(c, [at, at + SLICE])
                m = np.zeros((rows, SLICE), np.float32)
                m[r[lo:hi], c[lo:hi] - at] = 1
                return m
            common += part(rx, cx, len(nx)) @ part(ry, cy, len(ny)).T
    common = np.rint(common).astype(np.int64)
    close = 100 * common >= percent * (nx[:, None] + ny[None, :] - common)
    close &= x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]
    k, m = np.nonzero(close)
    links = pd.DataFrame({"a": x["node"].to_numpy()[k], "b": y["node"].to_numpy()[m],
                          "ca": x["comp"].to_numpy()[k], "cb": y["comp"].to_numpy()[m]})
    return links.drop_duplicates(["ca", "cb"])[["a", "b"]]


def _finish(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across the components of each cluster, cell by cell.

    ``members``: cluster, node, comp, sig, weight (shingles). The members outside the
    cluster's largest component meet all members. Both sides are dealt over
    blocks of about CELL members and CELL_SHINGLES shingles, so that a cell is
    small whatever the cluster's size; only links leave a cell.
    """
    k, w = F.count("*").alias("k"), F.sum("weight").alias("w")
    per_comp = members.groupBy("cluster", "comp").agg(k, w)
    sizes = per_comp.groupBy("cluster").agg(
        F.sum("k").alias("n"), F.sum("w").alias("w"),
        F.max_by(F.struct("comp", "k", "w"), F.struct("k", "comp")).alias("main"))

    def blocks(count: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(count / CELL), F.ceil(weight / CELL_SHINGLES)).cast("int")

    sizes = cut(sizes.select(
        "cluster", F.col("main.comp").alias("main"), blocks(F.col("n"), F.col("w")).alias("b_all"),
        blocks(F.col("n") - F.col("main.k"), F.col("w") - F.col("main.w")).alias("b_out"))
        .where("b_out > 0"))
    rows = (members.join(sizes, "cluster").join(sets, "node")
            .withColumns({"h": F.xxhash64("node"), "outside": F.col("comp") != F.col("main")}))
    cell = ["cluster", "i", "j", "node", "comp", "weight", "sig", "set", "left"]
    left = rows.where("outside").withColumns({
        "i": F.pmod("h", F.col("b_out").cast("long")).cast("int"), "left": F.lit(True),
        "j": F.explode(F.sequence(F.lit(0), F.col("b_all") - 1))}).select(cell)
    right = rows.withColumns({
        "j": F.pmod("h", F.col("b_all").cast("long")).cast("int"), "left": F.lit(False),
        "i": F.explode(F.sequence(F.lit(0), F.col("b_out") - 1))}).select(cell)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        is_left = frame["left"].to_numpy(bool)
        if is_left.all() or not is_left.any():
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        return _link_cell(frame[is_left], frame[~is_left], percent)

    return left.unionByName(right).groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable by links, itself included; kept
    marks it. Null, empty and blank texts have no shingles and link with
    nothing. Rows that repeat an id are one document that has the links of all
    of them. A row without id takes no part: component_id null, kept true.
    Other columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    table = cut(signatures(docs, doc_id, text, shingle_words))
    classes = table.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    # a node is a set of shingles, numbered by its fingerprint: an id with several texts has several
    reps = cut(classes.groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("weight"),
        F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
        .withColumn("node", F.xxhash64("fp")))

    members = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    shared = cut(members.join(buckets, "bucket"))  # only members of buckets with company
    small = (shared.where(F.col("n") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_set("node")).alias("m"))
             .select("m", F.posexplode("m").alias("at", "a"))
             .select("a", F.explode(F.slice("m", F.col("at") + 2, SMALL_BUCKET)).alias("b")))
    large = shared.where(F.col("n") > SMALL_BUCKET)
    star = large.select(F.explode(F.array(
        F.struct(F.col("lo").alias("a"), F.col("node").alias("b")),
        F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.*").where("a <> b")
    one_per_node = reps.select("node", "sig", "weight")
    pairs = cut(_estimated(small.unionByName(star).distinct(), one_per_node, percent))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Full sets of the given nodes (distinct), hashed again from a text of each."""
        wanted = cut(nodes.join(reps.select("node", "first"), "node"))
        few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        ids = wanted.select("first").distinct()
        cols = docs.select(F.col(doc_id).cast("long").alias("first"), F.col(text).alias("text"))
        cols = cols.join(F.broadcast(ids) if few else ids, "first")

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            sets = [shingle_set(as_text(t), shingle_words) for t in frame["text"]]
            return pd.DataFrame({"fp": [fingerprint(x) for x in sets], "set": [x.tobytes() for x in sets]})

        # other texts of those ids have other fingerprints; copies are one
        found = map_rows(cols, run, "fp binary, set binary").withColumn("node", F.xxhash64("fp"))
        return found.join(wanted.select("node"), "node").groupBy("node").agg(F.any_value("set").alias("set"))

    # The best candidate of each document first: most groups are whole after it.
    ends = pairs.select("a", "b", "est", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("est", -F.col("a"), -F.col("b"))).alias("p"))
    first = cut(best.select("p.*").distinct())
    sets = cut(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    links = cut(_confirm(first, sets, percent))
    labels = connected(links)
    rest = _between(pairs.join(first, ["a", "b"], "left_anti"), labels)
    links = cut(links.unionByName(_confirm(rest, sets, percent)))
    labels = connected(links)

    # Large buckets in several components. Buckets that share members are
    # finished together, so that no pair is compared once per band.
    placed = large.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = cut(placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                .where("x <> y").select("bucket"))
    if mixed.limit(1).count():
        tied = cut(placed.join(mixed, "bucket").select("lo", "node", "comp").distinct())
        clusters = connected(tied.select(F.col("lo").alias("a"), F.col("node").alias("b")))
        nodes = cut(tied.select("node", "comp").distinct()
                    .join(clusters.withColumnRenamed("comp", "cluster"), "node")
                    .join(one_per_node, "node"))
        links = cut(links.unionByName(_finish(nodes, sets_of(nodes.select("node")), percent)))
        labels = connected(links)

    # An id with several texts ties their components together.
    own = classes.join(reps.select("fp", "node"), "fp").select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    if several.limit(1).count():
        extra = own.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
        labels = connected(links.unionByName(extra))
    placed = reps.select("fp", "node", "first").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    out = table.join(placed.join(smallest, "comp").select("fp", "component_id"), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with the columns of ``docs``, of which one per group stays.

    Of rows that repeat a kept id the one with the smallest digest of all its
    values stays; rows without id all stay.
    """
    found = cut(near_duplicates(docs, doc_id, text, **options).select("doc_id", "kept"))
    gone = found.where("NOT kept").select("doc_id").distinct()
    key, = fresh(docs, "_nd_id")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.withColumn(key, F.col(doc_id).cast("long"))
    gone = gone.withColumnRenamed("doc_id", "_nd_gone")
    rows = rows.join(F.broadcast(gone) if few else gone, rows[key] == F.col("_nd_gone"), "left_anti")
    repeated = cut(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
                   .select(F.col("doc_id").alias("_nd_twice")))
    if repeated.limit(1).count():
        again = rows.join(repeated, rows[key] == F.col("_nd_twice"), "left_semi")
        whole = F.struct(*[F.col(c) for c in rows.columns])
        one = again.groupBy(key).agg(F.min_by(whole, F.md5(F.to_json(whole))).alias("_nd_row")).select("_nd_row.*")
        rows = rows.join(repeated, rows[key] == F.col("_nd_twice"), "left_anti").unionByName(one)
    return rows.select([rows[c] for c in docs.columns])
