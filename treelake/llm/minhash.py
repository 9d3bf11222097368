"""Near-duplicate components by min-max hashing.

Every permutation gives two signature values, the smallest and the largest shingle under it, so 126 hash evaluations
a shingle fill a signature of 252 values; both agree between two sets with probability equal to their Jaccard
similarity.  Values are banded (42 bands of 6): two sets of similarity 0.8 miss all bands with probability 3e-6.
Each band's bucket names candidates, and every link is confirmed on the full shingle sets:

1. sets that are equal collapse to the smallest id;
2. candidate groups: the connected components of "shares a bucket" (ids only).  Every link lies within a group, so
   each set is shipped once, to its group, whatever the number of its buckets and partners;
3. a group whose sets hold at most GROUP_ITEMS shingles is one task's work: an exact similarity self-join over an
   inverted index of the rarest shingles (prefix filter), which passes over pairs already connected;
4. larger groups are worked on bucket by bucket.  Leaders: members of a bucket are compared with its smallest id, then
   those outside the leader's component with the smallest of themselves, twice; that joins copies without listing
   their pairs.  Rest: buckets that still hold several components are compared in blocks, all members against all,
   first on set sizes, then signatures (252 values, cut 5 standard deviations below the threshold), then on sets.

There is no cap on groups or buckets, and steps 3 and 4 differ in nothing but how work is laid out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, attach, components, look_up, salt_of, stage

BANDS, ROWS = 42, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Standard deviations of the agreeing share of a signature below the threshold from where on a pair is compared on
#: sets: a pair that holds is passed over with probability 3e-7, less than by the bands.
SIGMAS = 5
#: Members of a block in step 4.
BLOCK = 256
#: Shingles that the sets of a group hold at most to be joined in one task (8 bytes each).
GROUP_ITEMS = 4_000_000
#: Sets of a group from which on copies are first joined around leaders.
LEAD_SETS = 64
#: Members that one copy of a leader's set is joined with.
LEADER_ROWS = 2000

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDER = _rng.permutation(2 * PERMUTATIONS)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles hashed at once, so that the products stay in a core's cache.
_CHUNK = 512


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: ASCII lower case, words split at ASCII white space.

    Fewer words than a shingle: the whole sequence as one.  No words: empty.
    """
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(found))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = _mix(out * _STEP + h[i : i + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """2 * PERMUTATIONS 32-bit values: minima and maxima under odd multiplications, in one fixed random order."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(h), _CHUNK):
        v = np.multiply.outer(_MUL, h[i : i + _CHUNK])
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate([low, high])[_ORDER]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, different bands never meaning the same."""
    v = sig.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for i in range(ROWS):
        out = _mix(out * _STEP + v[:, i])
    return out.view(np.int64)


def _sketch(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, sids, bands = [], [], []
            for t in f["text"]:
                s = shingle_set(t, words)
                n.append(len(s))
                if len(s):
                    sids.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(signature(s)))
                else:
                    sids.append(None)
                    bands.append(None)
            yield pd.DataFrame({"id": f["id"], "size": n, "sid": sids, "bands": bands})

    return run


def _sets(words: int, *more: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "items": [shingle_set(t, words).tobytes() for t in f["text"]], **{c: f[c] for c in more}})

    return run


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, on sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == 0 or den * len(x) < num * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def set_components(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> dict[int, int]:
    """Component (smallest id) of every id, over the links between the sets; an id that stands twice is one node.

    Sets in ascending size; shingles ordered by how many of these sets hold them, rarest first.  Two sets that are
    linked share one of their first shingles: of the smaller set's size - ceil(2 num size / (num + den)) + 1, of the
    larger one's size - ceil(num size / den) + 1 (prefix filter).  Shingles of one set alone take up their places of
    the prefix but are never looked up.
    """
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)

    if len(sets) == 2:
        if linked(sets[0], sets[1], num, den):
            join(*ids)
        return {i: find(i) for i in root}
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(held), np.int64)
    place[np.argsort(held, kind="stable")] = np.arange(len(held))
    at, single = place[at], int((held == 1).sum())
    start = np.concatenate([[0], np.cumsum([len(x) for x in sets])])[:-1]
    _lead(ids, sets, at, start, num, den, find, join)
    index: dict[int, dict[int, list[int]]] = {}
    for k, s in enumerate(sets):
        size = len(s)
        mine = np.sort(at[start[k] : start[k] + size])
        mine = mine[np.searchsorted(mine, single) :]
        alone = size - len(mine)
        probe = size + num * size // -den + 1 - alone
        own, near = find(ids[k]), set()
        for x in mine[: max(0, probe)].tolist():
            for label, found in index.get(x, {}).items():
                if find(label) != own:
                    near.update(found)
        for j in sorted(near, reverse=True):
            if find(ids[j]) != find(ids[k]) and linked(sets[j], s, num, den):
                join(ids[j], ids[k])
        keep = size + 2 * num * size // -(num + den) + 1 - alone
        for x in mine[: max(0, keep)].tolist():
            index.setdefault(x, {}).setdefault(own, []).append(k)
    return {i: find(i) for i in root}


def _lead(ids: list[int], sets: list[np.ndarray], at: np.ndarray, start: np.ndarray, num: int, den: int, find, join) -> None:
    """Joins copies fast: one set is compared with all others in a single pass over the group's shingles.  Goes on
    with sets not yet joined while that finds copies; what is left over is the index's work."""
    size = np.array([len(x) for x in sets])
    free, misses = np.ones(len(sets), bool), 0
    flag = np.zeros(int(at.max()) + 1, bool)
    for k in range(len(sets)):
        if free.sum() < LEAD_SETS or misses > 8:
            return
        if free[k]:
            mine = at[start[k] : start[k] + size[k]]
            flag[mine] = True
            both = np.add.reduceat(flag[at], start, dtype=np.int64)
            flag[mine] = False
            ok = den * both >= num * (size[k] + size - both)
            for j in np.flatnonzero(ok).tolist():
                join(ids[j], ids[k])
            free &= ~ok
            misses = misses + 1 if ok.sum() < LEAD_SETS // 4 else 0


def _group(num: int, den: int):
    def run(mine: pd.DataFrame) -> pd.DataFrame:
        found = set_components(mine["id"].tolist(), [np.frombuffer(x, np.uint64) for x in mine["items"]], num, den)
        return pd.DataFrame({"node": list(found), "component": list(found.values())})

    return run


def _confirm(num: int, den: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(f["x"], f["y"])]
            yield f.loc[ok, ["a", "b"]]

    return run


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int, scope: Scope) -> DataFrame:
    """The pairs (a, b) that hold on full sets.  A leader b of many pairs has its set copied once per LEADER_ROWS pairs."""
    with Scope() as own:
        pairs = own.stage(pairs.distinct(), "pairs")
        copies = own.stage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / LEADER_ROWS).cast("int").alias("copies")), "leaders")
        most = copies.agg(F.max("copies")).first()[0] or 1
        leaders = copies.join(sets.withColumnRenamed("id", "b"), "b")
        if most > 1:  # leaders in more than one copy are few: one per LEADER_ROWS pairs at most
            hot = F.broadcast(copies.where("copies > 1")) if copies.where("copies > 1").count() <= 10_000 else copies.where("copies > 1")
            pairs = pairs.join(hot, "b", "left").withColumn("part", F.when(F.col("copies").isNull(), 0).otherwise(salt_of("a", salts=1 << 20) % F.col("copies"))).drop("copies")
            leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        else:
            pairs, leaders = pairs.withColumn("part", F.lit(0)), leaders.withColumn("part", F.lit(0))
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        both = left.join(leaders.select("b", "part", F.col("items").alias("y")), ["b", "part"])
        return scope.stage(both.select("a", "b", "x", "y").mapInPandas(_confirm(num, den), "a long, b long"), "links")


def _block(ratio: float):
    least = ratio - SIGMAS * (ratio * (1 - ratio) / (2 * PERMUTATIONS)) ** 0.5

    def run(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left = mine[mine["block"] == i] if i != j else mine
        right = mine[mine["block"] == j] if i != j else mine
        sig = lambda f: np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(len(f), -1)
        s, t = sig(left), sig(right)
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        comps, compt = left["comp"].to_numpy(), right["comp"].to_numpy()
        sizes, sizet = left["size"].to_numpy(), right["size"].to_numpy()
        out = []
        for k in range(len(ids)):
            ok = (compt != comps[k]) & (np.minimum(sizet, sizes[k]) >= (ratio - 1e-9) * np.maximum(sizet, sizes[k])) & ((other > ids[k]) if i == j else True)
            ok[ok] = (t[ok] == s[k]).mean(axis=1) >= least
            out += [(max(ids[k], o), min(ids[k], o)) for o in other[ok]]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"id": f["id"], "size": [len(x) // 8 for x in f["items"]], "sig": [signature(np.frombuffer(x, np.uint64)).tobytes() for x in f["items"]]})


def near_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Links: similarity[1] * intersection >= similarity[0] * union of the distinct word shingle sets.  component_id is
    the smallest id reachable over links, kept says that it is the row's own.  Null, empty and wordless texts have
    no shingle and are linked with nothing, not even one another.  Rows with a null id aren't linked: component_id is
    null and kept true.  Rows of one id count as one document (their sets are compared separately).  Other columns
    are ignored, an empty table gives an empty result.
    """
    num, den = similarity
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    usable = "id is not null and sid is not null"
    kept = Scope()
    with Scope() as scope:
        sketch = scope.stage(rows.mapInPandas(_sketch(words), "id long, size long, sid binary, bands array<long>"), "sketch")
        alone = stage(sketch.where(f"not ({usable})").select("id", "size"), "alone")
        # of equal sets, which have equal bands, the smallest id's goes on
        first = attach(sketch.where(usable), ["sid"], [F.min("id").alias("rep")], scope=scope)
        same = scope.stage(first.select("id", "size", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "bands")
        keyed = same.where("bands is not null").select("id", F.explode("bands").alias("key"))
        bucket = attach(keyed, ["key"], [F.min("id").alias("lead"), F.max("id").alias("last")], "lead <> last", scope=scope)
        bucket = kept.stage(bucket.select("key", "id", "lead").distinct(), "buckets")
        same = stage(same.select("id", "size", "rep"), "same")
    with Scope() as scope:
        group = components(bucket.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")))
        member = scope.stage(same.join(group.select(F.col("node").alias("id"), F.col("component").alias("group")), "id"), "members")
        large = scope.stage(member.groupBy("group").agg(F.sum("size").alias("items")).where(F.col("items") > GROUP_ITEMS), "large")
        comp = _small(rows, member.join(large, "group", "left_anti"), words, num, den)
        if not large.isEmpty():
            ids = scope.stage(member.join(large, "group", "left_semi").select("id").distinct(), "large_ids")
            comp = comp.unionByName(_large(rows, bucket.join(ids, "id", "left_semi"), ids, words, num, den, scope))
        comp = stage(comp, "components")
    kept.close()
    comp = _one_document(same, comp)
    out = look_up(same, "rep", comp.withColumnRenamed("node", "rep")).select("id", "size", F.coalesce("component", "rep").alias("component"))
    out = out.unionByName(alone.select("id", "size", F.col("id").alias("component")))
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _small(rows: DataFrame, member: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, component) of the groups that are one task's work each."""
    # members grow with the documents: a broadcast would serve small tables only, and hide what larger ones cost
    sets = rows.join(member.select("id", "group").distinct().hint("merge"), "id").select(F.col("group").alias("id"), "text", F.col("id").alias("doc"))
    sets = sets.mapInPandas(_sets(words, "doc"), "id long, items binary, doc long").where("octet_length(items) > 0").select(F.col("id").alias("group"), F.col("doc").alias("id"), "items")
    return sets.groupBy("group").applyInPandas(_group(num, den), "node long, component long")


def _large(rows: DataFrame, bucket: DataFrame, ids: DataFrame, words: int, num: int, den: int, scope: Scope) -> DataFrame:
    """(node, component) of the larger groups, bucket by bucket."""
    bucket = scope.stage(bucket, "large_buckets")
    sets = rows.join(ids, "id", "left_semi").mapInPandas(_sets(words), "id long, items binary").where("octet_length(items) > 0").dropDuplicates(["id", "items"])
    sets = scope.stage(sets, "sets")
    links = confirm(bucket.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")), sets, num, den, scope)
    for step in range(3):
        comp = components(links)
        with Scope() as own:
            member = bucket.select("key", "id").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
            member = own.stage(member, "large_members")
            mixed = own.stage(attach(member, ["key"], [F.min("comp").alias("c0"), F.max("comp").alias("c1")], "c0 <> c1", scope=own).select("key", "id", "comp", "c0", "n"), "mixed")
            if mixed.isEmpty():
                return comp
            if step < 2:
                outside = own.stage(mixed.where("comp <> c0").select("key", "id", "comp"), "outside")
                more = attach(outside, ["key"], [F.min("id").alias("lead")], scope=own).where("id <> lead").join(comp.select(F.col("node").alias("lead"), "component"), "lead", "left")
                pairs = more.where(F.coalesce("component", "lead") != F.col("comp")).select(F.col("id").alias("a"), F.col("lead").alias("b"))
            else:
                pairs = rest_pairs(mixed, sets, num / den)
            links = scope.stage(links.unionByName(confirm(pairs, sets, num, den, own)), "links")
    return components(links)


def _one_document(same: DataFrame, comp: DataFrame) -> DataFrame:
    """``comp``, with the components joined that rows of one id and different texts belong to."""
    several = same.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last")
    if several.isEmpty():
        return comp
    edges = same.join(several, "id").select(F.col("rep").alias("a"), "b").where("a <> b")
    return components(edges.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def rest_pairs(mixed: DataFrame, sets: DataFrame, ratio: float) -> DataFrame:
    """Pairs of different components within a bucket whose signatures say they may be linked."""
    sig = sets.join(mixed.select("id").distinct(), "id", "left_semi").mapInPandas(_signatures, "id long, size long, sig binary")
    # buckets of the same members under another band are looked at once
    who = mixed.groupBy("key").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.count(F.lit(1)).alias("m"))
    once = who.groupBy("who", "m").agg(F.min("key").alias("key")).select("key")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = mixed.join(once, "key", "left_semi").join(sig, "id").withColumn("block", (salt_of("id", salts=1 << 20) % parts).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    spread = rows.select("key", "id", "comp", "size", "sig", "block", F.explode(pair).alias("p")).select("key", "id", "comp", "size", "sig", "block", "p.i", "p.j")
    return spread.groupBy("key", "i", "j").applyInPandas(_block(ratio), "a long, b long")
