"""SimHash near-dedup on a Gray-order hierarchical index.

Fingerprints are made per text (Arrow batches, XXH64 of word shingles, bit majorities). Equal
fingerprints collapse to one node, its smallest id, before any search: copies cost nothing.

All pairs of nodes within `most` differing bits are then searched for. `most`+1 bands of the fingerprint
guarantee that a pair agrees in one band, so each node goes to the bucket of each of its bands. A
bucket is an index: its fingerprints, turned so that the shared band leads, are sorted by Gray rank.
In that order all that share leading bits stand together, so runs are the nodes of a tree whose upper
nodes factor out shared bit patterns. The tree is joined with itself from the top: differences of
upper nodes' patterns accumulate and prune whole groups as soon as they exceed `most`.

Each bucket returns a spanning forest of its links (one row per linked node), never its pairs.
Crowded buckets: one with over `crowd` members is dealt again by bands of its other bits (which again
must agree in one); a bucket still crowded is cut into parts, and each pair of parts is a task of its own.
So no task grows with a bucket, no candidate is dropped, and a hot group is collapsed or split.

Components come from large-star/small-star rounds over the links, each cut by a checkpoint.

Defined results: null or blank texts have fingerprint zero and link like any other; rows with a null
id get a fingerprint and the component of it, but are no nodes; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, join_back, partitions

CROWD = 1024
#: Bits of the tree's levels below the band; finer levels prune earlier.
STEP = 12
#: Pairs of tree nodes that are held at a time on a level (but for those of one pair above).
PAIRS = 250_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit majorities of the XXH64 (seed 42) of the word shingles, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (the 64 bits as a signed long), one row per input row."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in s], dtype=np.uint64).view(np.int64))

    return df.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def gray_rank(a: np.ndarray) -> np.ndarray:
    """Where a bit pattern stands in Gray order: patterns with the same leading bits stand together."""
    for s in (1, 2, 4, 8, 16, 32):
        a = a ^ (a >> np.uint64(s))
    return a


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] of them, for each i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def index_join(group: np.ndarray, fp: np.ndarray, lead: int, most: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a < b) of linked fingerprints of a group. Rows are sorted by group, then by the Gray rank of
    fp, turned so that the `lead` bits that a group shares come first."""
    n = len(fp)
    # levels[k]: first row of each run that shares its bits down to level k; the last level has each fingerprint
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    levels, edge = [np.flatnonzero(new)], lead
    while edge < 64:
        edge = min(64, edge + step)
        new = new.copy()
        new[1:] |= (fp[1:] ^ fp[:-1]) >> np.uint64(64 - edge) != 0
        levels.append(np.flatnonzero(new))
    a = b = np.arange(len(levels[0]))
    acc = np.zeros(len(a), np.int64)
    edge = lead
    out_a, out_b = [], []

    def down(k: int, a: np.ndarray, b: np.ndarray, acc: np.ndarray, edge: int) -> None:
        if k + 1 == len(levels):
            out_a.append(levels[k][a])
            out_b.append(levels[k][b])
            return
        up, low = levels[k], levels[k + 1]
        first = np.searchsorted(low, up)
        count = np.diff(np.append(first, len(low)))
        to = min(64, edge + step)
        mask = np.uint64(((1 << (to - edge)) - 1) << (64 - to))
        pairs = count[a] * count[b]
        cuts = np.searchsorted(np.cumsum(pairs), np.arange(PAIRS, pairs.sum() + PAIRS, PAIRS), side="left") + 1
        at = 0
        for end in [*cuts.tolist(), len(a)]:
            end = min(end, len(a))
            if end <= at:
                continue
            x, y, z = a[at:end], b[at:end], acc[at:end]
            at = end
            cx = _spread(first[x], count[x])
            cy = np.repeat(count[y], count[x])
            right = _spread(np.repeat(first[y], count[x]), cy)
            left, seen = np.repeat(cx, cy), np.repeat(np.repeat(z, count[x]), cy)
            seen = seen + np.bitwise_count((fp[low[left]] ^ fp[low[right]]) & mask)
            ok = (seen <= most) & (left <= right)
            if ok.any():
                down(k + 1, left[ok], right[ok], seen[ok], to)

    down(0, a, b, acc, edge)
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
    keep = a != b
    return a[keep], b[keep]


def near(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's fingerprints, by an index over them: for each row, which of the different ones it has (in Gray order); and a
    table of which of these are within `most` bits of each other."""
    distinct, which = np.unique(fp, return_inverse=True)
    order = np.argsort(gray_rank(distinct))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    a, b = index_join(np.zeros(len(order), np.int64), distinct[order], 0, most)
    close = np.eye(len(order), dtype=bool)
    close[a, b] = close[b, a] = True
    return place[which], close


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row, the smallest row of its component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(before, root):
            break
    return root


def _bands(width: int, n: int) -> list[tuple[int, int]]:
    """(start, bits) of n bands over `width` bits."""
    edges = [round(i * width / n) for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def links(nodes: DataFrame, most: int = 3, crowd: int = CROWD) -> DataFrame:
    """u, v: a spanning forest, bucket by bucket, of the links between nodes (node, fp); fp are distinct."""
    spark = nodes.sparkSession
    bands, parts = _bands(64, most + 1), partitions(spark)

    def turned(turn):  # fp with the band's bits leading
        return F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn)) if turn else F.col("fp")

    first = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(s).alias("turn"), turned(s).alias("t"), F.lit(n).alias("lead")) for s, n in bands])).alias("x"))
    first = first.select("node", "x.*").withColumn("key", F.expr("shiftrightunsigned(t, 64 - lead)"))

    def sized(rows, by):
        return join_back(rows, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), by)

    by = ["turn", "key"]
    level = sized(first.select("node", "turn", "t", "lead", "key"), by)
    calm = level.where(F.col("n") <= crowd).select("node", "t", "lead", F.xxhash64("turn", "key").alias("bucket"), F.col("key").alias("k1"), F.col("turn").alias("k2"), F.lit(0).alias("pair"))
    # crowded: dealt again by bands of the rest (a pair agrees in one of them too)
    rest = []
    for s, n in bands:
        for s2, n2 in _bands(64 - n, most + 1):
            rest.append((s, n, s2, n2))
    again = level.where(F.col("n") > crowd).drop("n")
    sub = again.select("node", "turn", "lead", "key", "t", F.explode(F.array(*[F.lit(i) for i in range(most + 1)])).alias("band"))
    what = F.lit(None).cast("struct<s:int,n:int>")
    for s, n, s2, n2 in rest:
        i = [x for x in rest if x[0] == s].index((s, n, s2, n2))
        what = F.when((F.col("turn") == s) & (F.col("band") == i), F.struct(F.lit(s2).alias("s"), F.lit(n2).alias("n"))).otherwise(what)
    # the sub-band is moved up to stand just behind the band: [band][sub][before sub][after sub]
    sub = sub.withColumn("w", what).select("node", "turn", "lead", "key", "t", "band", F.col("w.s").alias("s2"), F.col("w.n").alias("n2"))
    sub = sub.withColumn("subkey", F.expr("shiftrightunsigned(shiftleft(t, lead + s2), 64 - n2)"))
    sub = sub.withColumn("before", F.expr("CASE WHEN s2 = 0 THEN 0L ELSE shiftrightunsigned(shiftleft(t, lead), 64 - s2) END"))
    sub = sub.withColumn("t2", F.expr("(shiftleft(shiftrightunsigned(t, 64 - lead), 64 - lead)) | shiftleft(subkey, 64 - lead - n2) | CASE WHEN s2 = 0 THEN 0L ELSE shiftleft(before, 64 - lead - n2 - s2) END | CASE WHEN lead + n2 + s2 >= 64 THEN 0L ELSE (t & shiftrightunsigned(-1L, lead + n2 + s2)) END"))
    by2 = ["turn", "key", "band", "subkey"]
    deep = sized(sub.select("node", F.col("t2").alias("t"), (F.col("lead") + F.col("n2")).alias("lead"), F.expr("shiftleft(key, n2) | subkey").alias("k1"), *by2), by2)
    deep = deep.withColumn("bucket", F.xxhash64(*by2)).withColumn("k2", F.col("turn") * 64 + F.col("band"))
    quiet = deep.where(F.col("n") <= crowd).select("node", "t", "lead", "bucket", "k1", "k2", F.lit(0).alias("pair"))
    # still crowded: parts of about crowd/2, and a task for each pair of parts
    full = deep.where(F.col("n") > crowd).withColumn("m", F.ceil(2 * F.col("n") / crowd).cast("int")).withColumn("p", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    full = full.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).where("p <> q")
    full = full.withColumn("pair", F.least("p", "q") * F.col("m") + F.greatest("p", "q"))
    full = full.select("node", "t", "lead", F.xxhash64("bucket", "pair").alias("bucket"), "k1", "k2", "pair")
    rows = calm.unionByName(quiet).unionByName(full).select("bucket", "k1", "k2", "pair", "lead", "node", "t")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(d: pd.DataFrame) -> pd.DataFrame:
            out = []
            for lead, x in d.groupby("lead", sort=False):
                fp = x["t"].to_numpy().view(np.uint64)
                keys = [x[c].to_numpy() for c in ("bucket", "k1", "k2", "pair")]
                order = np.lexsort((gray_rank(fp), *keys[::-1]))
                fp, node = fp[order], x["node"].to_numpy()[order]
                new = np.zeros(len(fp), bool)
                for k in keys:
                    k = k[order]
                    new[1:] |= k[1:] != k[:-1]
                a, b = index_join(np.cumsum(new), fp, int(lead), most)
                root = _forest(len(fp), a, b)
                on = np.flatnonzero(root != np.arange(len(fp)))
                out.append(pd.DataFrame({"u": node[on], "v": node[root[on]]}))
            return pd.concat(out)

        held: list[pd.DataFrame] = []
        size = 0
        for d in batches:  # rows come sorted by bucket: whole buckets are solved together, some 200,000 rows at a time
            held.append(d)
            size += len(d)
            if size < 200_000:
                continue
            all_ = pd.concat(held, ignore_index=True)
            last = all_["bucket"].iloc[-1]
            done = int(np.searchsorted((all_["bucket"] == last).to_numpy(), True))
            if done:
                yield solve(all_.iloc[:done])
            held, size = [all_.iloc[done:]], len(all_) - done
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    spread = rows.repartition(parts, "bucket", "k1", "k2", "pair").sortWithinPartitions("bucket")
    return spread.mapInPandas(search, "u long, v long").distinct()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, root (the smallest node it reaches) for nodes with an edge (u, v); large-star/small-star rounds. most: a number
    that there aren't more edges than, if one is known (it only bears on partitions)."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e if most is None else gathered(e, 64 * most))
    before, n = None, e.count()  # rounds add no links
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(gathered(small.where("u <> v").distinct(), 64 * n))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = cut(fingerprints(df, id_col, text_col, words))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("node")))
    roots = components(links(classes.where("node IS NOT NULL"), most, crowd))
    known = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = join_back(rows, known, ["fp"])  # a hot fingerprint's rows are split
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is their component's smallest (all rows of a null id stay)."""
    stay = near_dedup(df, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__id")).distinct()
    return df.join(stay, df[id_col] == stay["__id"], "left_semi").unionByName(df.where(F.col(id_col).isNull()))
