"""Near-duplicate detection with an LSH forest over MinHash signatures.

Texts become sets of hashed word shingles; documents with equal sets are one class, and all further
work is on classes. A class has a signature of TREES * DEPTH minima. Tree t is the list of all classes
sorted by the signature read cyclically from place t * DEPTH on, so that classes with a long common
prefix stand next to each other. Candidates of a class are its neighbours in each of these orders, as
far as they share DEPTH values at least: REGION / 2 of them on either side. Where few classes share a
prefix, these are all of them; where many do, the order puts those with the longest common prefix
nearest, so depth adapts to how dense a region is. The orders are made by range partitioning, which
cuts a region with many classes into many tasks; what stands at the end of one task meets what stands
at the beginning of the next.

The neighbourhoods go out as runs of at most REGION classes that overlap by half. Runs of a region with
more classes than that get the region's leaders too, which look most like its middle.

Signatures say how similar two classes are about. That only orders the pairs: links are found on whole
sets, in three rounds:

1. each class with its best partner over all runs; components of the links that hold;
2. in runs that hold several components, all pairs across them whose sizes allow a link, the most
   similar first, until the run has nothing left to join;
3. among the classes of regions that are more than one run, where some neighbours were not compared: an
   exact prefix-filter join over the shingles that occur in two components or more.

So components need no list of all pairs in a group of copies. A pair at the threshold is met in one tree
at least with probability 1 - (1 - 0.8 ** 4) ** 24, about 0.999995, however dense its regions are.

Defined results: identifiers are whole numbers or text of their digits, and other text stops the job with Spark's
cast error; null, empty and wordless texts have an empty set and link with nothing; a text with
fewer words than a shingle is one shingle; rows that share an identifier are one document, with the links
of each of its texts, and each row is listed; rows without an identifier are listed without a component,
as kept; an empty table gives an empty result. ``drop_near_duplicates`` leaves one row of each group, of
the rows with the smallest identifier (those without one come last) any; there rows without an identifier
are compared like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage

TREES, DEPTH = 24, 4
SIZE = TREES * DEPTH
#: Minima that an order looks at.
KEY = 12
#: Classes of a run at most.
REGION = 512
#: Classes from the middle of a dense region that are added to each of its runs.
LEADERS = 8
#: Tasks that the rows of one region are spread over at least, where they are joined by region.
SALTS = 64
#: Classes of a block, where all candidates of a cluster are compared in pairs of blocks.
BLOCK = 256

# Fixed odd multipliers and masks of the hash functions, from a seeded generator.
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64)
_WORD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """The sorted hashes of the distinct shingles; bytes.lower() and bytes.split() know ASCII alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(codes) - width + 1)
    total = np.full(n, np.uint64(len(codes) if len(codes) < width else width))
    for j in range(min(width, len(codes))):
        total = total * _WORD + codes[j : j + n]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SIZE minima as 32-bit numbers."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = ((shingles[None, at : at + 2048] ^ _MASK[:, None]) * _TIMES[:, None]) >> np.uint64(32)
        np.minimum(out, part.min(axis=1).astype(np.uint32), out=out)
    return out


def packed(minima: np.ndarray) -> bytes:
    """The lower 16 bits of each minimum, the upper byte first, so that bytes sort as the numbers do."""
    return minima.astype(">u2").tobytes()


def _signatures(width: int):
    @F.pandas_udf("n_shingles long, f1 long, f2 long, sig binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for texts in batches:
            out = []
            for text in texts:
                s = shingle_set(text, width, hashes)
                # equal sets have equal sums of hashes, and equal exclusive ors of other hashes
                f1 = int(s.sum(dtype=np.uint64).astype(np.int64))
                f2 = int(np.bitwise_xor.reduce(_mix(s + _WORD)).astype(np.int64)) if len(s) else 0
                out.append((len(s), f1, f2, packed(signature(s)) if len(s) else None))
            yield pd.DataFrame(out, columns=["n_shingles", "f1", "f2", "sig"])

    return sign


def _sets(width: int):
    @F.pandas_udf("binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Hashes()
        for texts in batches:
            yield pd.Series([shingle_set(t, width, hashes).tobytes() for t in texts])

    return sets


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    @F.pandas_udf("boolean")
    def verify(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(left, right, strict=True)], dtype=bool)

    return verify


def _regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one region (run, block pair) at a time, from batches that are ordered by region."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf["region"].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            key = keys[a]
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _neighbours(region: int):
    """Runs of neighbours from the sorted orders: batches of (key, rep), ordered; a key is the tree and KEY minima."""
    import pyarrow as pa

    half = max(1, region // 2)
    shared = 1 + 2 * DEPTH

    def number(*parts) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(b"".join(parts)) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        edge = lambda t: number(b"edge", t.to_bytes(8, "little", signed=True))
        out: list[tuple] = []

        def close(name: bytes, ids: np.ndarray, begins: bool, ends: bool) -> None:
            """A region, and whether it is the first or last of the task, where it may go on in the next one."""
            n, own = len(ids), number(name)
            dense = n > 2 * half or (n > half and (begins or ends)) or (begins and ends)
            if n > 1:
                for at in range(0, max(1, n - half), half):
                    out.append((own, number(name, ids[at].tobytes()), ids[at : at + 2 * half], dense))
            if begins:
                out.append((own, edge(task - 1), ids[:half], dense))
            if ends:
                out.append((own, edge(task), ids[-half:], dense))

        def flush() -> pa.RecordBatch:
            sizes = [len(ids) for _, _, ids, _ in out]
            columns = [np.repeat(np.array([row[k] for row in out], kind), sizes) for k, kind in ((0, np.int64), (1, np.int64), (3, bool))]
            ids = np.concatenate([row[2] for row in out]) if out else np.empty(0, np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(ids), pa.array(columns[2])], ["region", "run", "rep", "dense"])

        held: list[np.ndarray] = []  # of the region that is open, and its name
        name, begins = b"", True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, 1 + 2 * KEY)[:, :shared]
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and name != keys[a].tobytes():
                    if begins or len(held) > 1 or len(held[0]) > 1:
                        close(name, np.concatenate(held), begins, False)
                    held, begins = [], False
                name = keys[a].tobytes()
                held.append(ids[a:b])
            if len(out) > 1000:
                yield flush()
        if held:
            close(name, np.concatenate(held), begins, True)
        yield flush()

    return run


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The classes that look most like the middle of their part of a region: the commonest value of each minimum."""
    for rows in _regions(batches):
        ids = rows["rep"].to_numpy()
        low = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(len(ids), SIZE)
        middle = np.array([np.bincount(low[:, j], minlength=256).argmax() for j in range(SIZE)], np.uint8)
        like = (low == middle).sum(axis=1)
        lead = np.argsort(-like, kind="stable")[:LEADERS]
        yield pd.DataFrame({"region": rows["region"].iloc[0], "rep": ids[lead], "like": like[lead]})


def _estimates(sigs: np.ndarray) -> np.ndarray:
    """About how similar each pair is, from one byte of each minimum."""
    n = len(sigs)
    same = np.zeros((n, n), np.float32)
    for at in range(0, n, 64):
        same[at : at + 64] = (sigs[at : at + 64, None, :] == sigs[None, :, :]).mean(axis=2)
    return (same - 1 / 256) / (1 - 1 / 256)


def _sizes_fit(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as that."""
    return 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])


def _partners(percent: int):
    """For each class of a region the partner that looks most similar, of those whose size allows a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for rows in _regions(batches):
            ids = rows["rep"].to_numpy()
            sigs = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(len(ids), SIZE)
            near = _estimates(sigs)
            near[~_sizes_fit(rows["n"].to_numpy(), percent)] = -1
            np.fill_diagonal(near, -1)
            best = near.argmax(axis=1)
            out += [(int(ids[i]), int(ids[j]), float(near[i, j])) for i, j in enumerate(best) if near[i, j] > -1]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["rep", "other", "near"])
                out = []
        yield pd.DataFrame(out, columns=["rep", "other", "near"])

    return run


def _apart(percent: int):
    """The classes of a region whose size allows a link to one in another component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _regions(batches):
            comp = rows["comp"].to_numpy()
            odd = _sizes_fit(rows["n"].to_numpy(), percent) & (comp[:, None] != comp[None, :])
            if odd.any():
                yield rows[odd.any(axis=1)]

    return run


def _join(percent: int):
    """Links between components of a region, on whole sets, the most similar first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _regions(batches):
            ids, comp = rows["rep"].to_numpy(), rows["comp"].to_numpy()
            sigs = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(len(ids), SIZE)
            sets = [np.frombuffer(b, np.uint64) for b in rows["set"]]
            near = _estimates(sigs)
            a, b = np.nonzero(np.triu(_sizes_fit(rows["n"].to_numpy(), percent), 1) & (comp[:, None] != comp[None, :]))
            order = np.argsort(-near[a, b], kind="stable")
            top = {int(c): int(c) for c in comp}

            def root(x, top=top):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            found = []
            for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y and similar(sets[i], sets[j], percent):
                    top[max(x, y)] = min(x, y)
                    found.append((int(ids[i]), int(ids[j])))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the links of a task by links to the smallest member of each of its components."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                top[max(x, y)] = min(x, y)
        if len(top) > 1_000_000:
            yield pd.DataFrame([(x, root(x)) for x in top if root(x) != x], columns=["a", "b"])
            top.clear()
    yield pd.DataFrame([(x, root(x)) for x in list(top) if root(x) != x], columns=["a", "b"]).astype("int64")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for links (a, b): comp is the smallest node that can be reached; nodes are those of links.

    Links are first contracted within tasks, then alternating large-star and small-star steps hang every
    node on its smallest neighbour until nothing changes; a step is two joins with an aggregate, and its
    result is a table in the shared folder.
    """
    now = stage(links.filter("a <> b").mapInPandas(_contract, "a long, b long").distinct())

    def both(edges):
        return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    while True:
        ends = both(now)
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ends.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = stage(small)
        # done when every node hangs on one node that hangs on none
        loose = after.groupBy("a").agg(F.countDistinct("b").alias("n")).filter("n > 1").limit(1).count() or after.join(after.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").limit(1).count()
        now = after
        if not loose:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def _forest(reps: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(region, rep) for the runs of all trees, and the classes (rep) of dense regions, if any; reps: rep, sig; short: rep, n, low."""
    twice = F.concat("sig", "sig")
    keys = [F.concat(F.lit(bytes([t])), F.substring(twice, 2 * DEPTH * t + 1, 2 * KEY)) for t in range(TREES)]
    rows = reps.select(F.explode(F.array(*keys)).alias("key"), "rep").repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    found = stage(rows.mapInArrow(_neighbours(REGION), "region long, run long, rep long, dense boolean"))
    runs = found.select(F.col("run").alias("region"), "rep")
    dense = found.filter("dense").select("region").distinct()
    if not dense.limit(1).count():
        return runs, None
    # a dense region may hold a third of all rows, so it meets its name in SALTS places
    named = dense.select("region", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    within = stage(found.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(named, ["region", "salt"], "left_semi").select("region", "run", "rep"))
    parts = within.select("region", "rep").distinct().join(short, "rep").select("region", "rep", "low")
    parts = parts.repartitionByRange("region", "rep").sortWithinPartitions("region", "rep").mapInPandas(_leaders, "region long, rep long, like long")
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("like"), "rep"))
    lead = parts.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).select("region", "rep")
    led = within.select("region", "run").distinct().join(lead, "region").select(F.col("run").alias("region"), "rep")
    return runs.unionByName(led).distinct(), within.select("rep").distinct()


def _cross(percent: int):
    """Links between components in a pair of blocks, on whole sets, of classes that share a shingle of their prefixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _regions(batches):
            ids, comp, own = rows["rep"].to_numpy(), rows["comp"].to_numpy(), rows["own"].to_numpy()
            sets = [np.frombuffer(b, np.uint64) for b in rows["set"]]
            of = np.repeat(np.arange(len(ids)), [len(p) for p in rows["prefix"]])
            shingles = np.concatenate(list(rows["prefix"]))
            order = np.argsort(shingles, kind="stable")
            holders = np.split(of[order], np.flatnonzero(np.diff(shingles[order])) + 1)
            meet = np.zeros((len(ids), len(ids)), bool)
            for h in holders:
                if len(h) > 1:
                    meet[np.ix_(h, h)] = True
            apart = (comp[:, None] != comp[None, :]) & ((own[:, None] != own[None, :]) | (rows["lo"].iloc[0] == rows["hi"].iloc[0]))
            fit = _sizes_fit(np.array([len(x) for x in sets]), percent)
            top = {int(c): int(c) for c in comp}

            def root(x, top=top):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            found = []
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(meet & apart & fit, 1))), strict=True):
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y and similar(sets[i], sets[j], percent):
                    top[max(x, y)] = min(x, y)
                    found.append((int(ids[i]), int(ids[j])))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _across(within: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all components of some classes that have a link; within: rep; comps: node, comp; sets: rep, set.

    Similar sets share a shingle of their prefixes, in any order of shingles. Here those that occur in one
    component alone come first and then the rare ones; the former meet nothing in another component, so
    only the rest counts, and classes with too few others are left out. Classes that hang together by
    shingles of their prefixes are a cluster, and its classes are compared in pairs of blocks within tasks,
    so that no table has a row for each pair. Large components have blocks of their own, which don't meet each other.
    """
    named = within.join(sets, "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"), "set")
    split = F.pandas_udf(lambda s: pd.Series([np.frombuffer(b, np.int64) for b in s]), "array<long>")
    each = named.select("rep", "comp", (F.length("set") / 8).cast("long").alias("n"), F.explode(split("set")).alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("s", "f")
    need = F.ceil(F.col("n") * percent / 100)
    mixed = each.join(often, "s").groupBy("rep", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("m")).filter(F.size("m") >= need)
    posted = stage(mixed.select("rep", "comp", F.slice("m.s", F.lit(1), (F.size("m") - need + 1).cast("int")).alias("prefix")))
    flat = posted.select("rep", "comp", F.explode("prefix").alias("s"))
    hubs = flat.groupBy("s").agg(F.min("rep").alias("hub"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("s", "hub")
    clusters = components(flat.join(hubs, "s").select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("rep"), F.col("comp").alias("cluster"))
    clusters = stage(clusters)
    placed = stage(clusters.join(posted.select("rep", "comp"), "rep"))
    parts = placed.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m")).withColumn("owner", F.when(F.col("m") > BLOCK, F.col("comp")))
    pooled = parts.filter("owner IS NULL").groupBy("cluster").agg(F.sum("m").alias("pool"))
    parts = parts.join(pooled, "cluster", "left").withColumn("k", F.ceil(F.when(F.col("owner").isNull(), F.col("pool")).otherwise(F.col("m")) / BLOCK))
    block = F.xxhash64("owner", F.pmod(F.when(F.col("owner").isNull(), F.xxhash64("comp")).otherwise(F.xxhash64("rep")), F.col("k"))).alias("own")
    placed = stage(placed.join(parts.select("cluster", "comp", "owner", "k"), ["cluster", "comp"]).select("cluster", "rep", "comp", "owner", block))
    blocks = placed.groupBy("cluster", "own").agg(F.max("owner").alias("owner"))
    other = blocks.select("cluster", F.col("own").alias("hi"), F.col("owner").alias("other"))
    pairs = blocks.withColumnRenamed("own", "lo").join(other, "cluster").filter("lo <= hi AND (owner IS NULL OR other IS NULL OR owner <> other)").select("cluster", "lo", "hi")
    met = pairs.select("cluster", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("own"))
    dealt = placed.join(met, ["cluster", "own"]).select("cluster", "lo", "hi", "own", "rep")
    rows = dealt.join(posted, "rep").join(sets, "rep").select(F.xxhash64("cluster", "lo", "hi").alias("region"), "lo", "hi", "own", "rep", "comp", "prefix", "set")
    return rows.repartition("region").sortWithinPartitions("region", "rep").mapInPandas(_cross(percent), "a long, b long")


def _grouped(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, n_shingles, comp) for rows (node, text): comp is the smallest node of the component; rows without a node have none."""
    signed = stage(rows.select("node", _signatures(width)("text").alias("s")).select("node", "s.*"))
    full = signed.filter(F.col("node").isNotNull() & (F.col("n_shingles") > 0))
    classes = stage(full.groupBy("f1", "f2", "n_shingles").agg(F.min("node").alias("rep")))
    low = F.pandas_udf(lambda s: pd.Series([x[1::2] for x in s]), "binary")
    reps = signed.withColumnRenamed("node", "rep").join(classes.select("rep").hint("shuffle_hash"), "rep", "left_semi")
    reps = stage(reps.select("rep", F.col("n_shingles").alias("n"), "sig", low("sig").alias("low")))
    short = reps.select("rep", "n", "low")
    runs, within = _forest(reps.select("rep", "sig"), short)
    runs = stage(runs)

    ordered = lambda df: df.repartition("region").sortWithinPartitions("region", "rep")
    guess = ordered(runs.join(short, "rep")).mapInPandas(_partners(percent), "rep long, other long, near double")
    best = guess.groupBy("rep").agg(F.max(F.struct("near", (-F.col("other")).alias("other"))).alias("m"))
    pairs = stage(best.select(F.least("rep", -F.col("m.other")).alias("a"), F.greatest("rep", -F.col("m.other")).alias("b")).filter("a <> b").distinct())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    wanted = (wanted if within is None else wanted.unionByName(within)).distinct()
    whole = rows.withColumnRenamed("node", "rep").join(wanted.hint("shuffle_hash"), "rep", "left_semi")
    sets = stage(whole.select("rep", _sets(width)("text").alias("set")))
    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", _verify(percent)("sa", "sb").alias("ok")).filter("ok").select("a", "b")
    first = components(held)

    named = runs.join(first.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    apart = stage(ordered(named.join(short, "rep").select("region", "rep", "comp", "n", "low")).mapInPandas(_apart(percent), "region long, rep long, comp long, n long, low binary"))
    more = ordered(apart.join(sets, "rep").select("region", "rep", "comp", "n", "low", "set")).mapInPandas(_join(percent), "a long, b long")
    final = components(first.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    if within is not None:
        rest = _across(within, final, sets, percent)
        final = components(final.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(rest))

    of = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    alone = signed.filter("node IS NULL OR n_shingles = 0")
    return full.join(of, ["f1", "f2", "n_shingles"]).select("node", "n_shingles", "comp").unionByName(alone.select("node", "n_shingles", F.col("node").alias("comp")))


def one_each(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an identifier and none has that of another."""
    ids = docs.select(F.col(id_col).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return not ids.filter("n > 1 OR i IS NULL").limit(1).count()


def _united(found: DataFrame) -> DataFrame:
    """found (node, doc_id, n_shingles, comp) with one component for the rows of one document."""
    found = stage(found)
    least = found.filter("doc_id IS NOT NULL AND comp IS NOT NULL").groupBy("doc_id").agg(F.min("comp").alias("b"))
    links = found.join(least, "doc_id").select(F.col("comp").alias("a"), "b").filter("a <> b").distinct()
    joined = components(links).withColumnRenamed("comp", "top")
    return found.join(joined, found["comp"] == joined["node"], "left").select(found["node"], "doc_id", "n_shingles", F.coalesce("top", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Links join documents whose sets have 100 * intersection >= percent * union.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if one_each(rows, "doc_id"):
        found = _grouped(rows.withColumnRenamed("doc_id", "node"), width, percent)
        return found.select(F.col("node").alias("doc_id"), "n_shingles", F.col("comp").alias("component_id"), (F.col("node") == F.col("comp")).alias("kept"))
    rows = stage(rows.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    found = _grouped(rows.filter("node IS NOT NULL").select("node", "text"), width, percent).join(rows.select("node", "doc_id"), "node")
    found = stage(_united(found))
    names = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = found.join(names, "comp").select("doc_id", "n_shingles", "component_id")
    nameless = rows.filter("node IS NULL").select("doc_id", _signatures(width)("text")["n_shingles"].alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group; columns as they were."""
    own = [f"`{c}`" for c in docs.columns]
    other, row = fresh(docs, "__other"), fresh(docs, "__node")
    if one_each(docs, id_col):
        gone = _grouped(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")), width, percent).filter("node <> comp").select(F.col("node").alias(other))
        return docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(other), "left_anti").select(*own)
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    found = _grouped(docs.select(F.col(row).alias("node"), F.col(text_col).alias("text")), width, percent)
    found = stage(_united(found.join(docs.select(F.col(row).alias("node"), F.col(id_col).cast("long").alias("doc_id")), "node")))
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("m")).select(F.col("m.node").alias(other))
    return docs.join(first.hint("shuffle_hash"), F.col(row) == F.col(other), "left_semi").select(*own)
