"""Near-duplicate documents by bottom-k sketches of one hash function.

1.  A document's set is its distinct n-word shingles as 64-bit hashes.  Its sketch
    is the K smallest of them.  Documents of equal sets (size and two 64-bit sums)
    are one class, which goes on as its smallest document.
2.  Inverted lists.  Retained values are ranked by how many classes retain them,
    rarest first.  Two sets of similarity ``percent`` / 100 or more share at least s
    retained values, so one at least is among the first (retained - s + 1) of both;
    only these are put into lists.  For a set of K or fewer shingles s follows from the
    sizes alone and no link is lost (``heads``).  For two larger sets s is SHARED: of
    10**8 such pairs of similarity 0.8 exactly fewer than two share less, far fewer above.
3.  Each list links its members to its pivot, the member with most values that
    others retain too (then the smallest).  Where members are still in different
    components, short lists (SMALL members or fewer) compare all such pairs.  Members
    of longer lists meet once for each pivot, in blocks of documents of like size;
    block pairs are compared as matrices.  Nothing has a cap.
4.  Estimates.  A pair goes on if 128 one-bit minima (one for each 1/128 of the hash
    range) and then the sketch of the union of both allow a similarity of 0.8 (within
    SIGMAS standard deviations).  For two sets of K or fewer shingles the second test is exact.
5.  Verification counts the intersection of the full sets.  Links are exact.

Components come from distributed contraction.  What is broadcast is a bit filter
of fixed size.

Null, empty and blank texts have the empty set, 0 shingles, and are linked with
nothing.  A document of fewer than n words has its whole sequence as one shingle.
``id`` is a document's identity: rows of one id are one document if their texts
are equal.  Null ids are in components of their own class like others but never
the name of one unless alone.  Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import IdFilter, components
from .kernel import Words, chunks, mix, shingles, strings
from .shared import Workspace, ship

K = 64
SHARED = 32
SIGMAS = 6.0
SMALL = 16
BLOCK = 512
BLOCK_ITEMS = 400_000
BITS_APART = 36
SIGNED = np.int64


def _sets(column: pa.Array, n: int):
    """The sorted distinct shingle hashes of each row."""
    data, off = strings(column)
    for _, _, piece, own in chunks(data, off):
        g, to = shingles(Words(piece, own), n)
        for k in range(len(own) - 1):
            yield np.unique(g[to[k] : to[k + 1]])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(SIGNED)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, n (set size), f1, f2 (sums over the set), b1, b2 (one-bit minima), sketch."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            size, sums, bits, low = [], [], [], []
            for s in _sets(b.column(1), n):
                size.append(len(s))
                sums.append((int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) if len(s) else (0, 0))
                part = s >> np.uint64(57)
                first = np.flatnonzero(np.diff(part, prepend=np.uint64(255)))
                odd = part[first][(mix(s[first]) & np.uint64(1)) == 1].astype(object)
                mask = sum(1 << int(p) for p in odd)
                bits.append((mask & (2**64 - 1), mask >> 64))
                low.append(s[:K])
            both = np.array(sums, np.uint64).reshape(-1, 2).view(SIGNED)
            mask = np.array(bits, np.uint64).reshape(-1, 2).view(SIGNED)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in (*both.T, *mask.T)), _lists(low)], ["id", "n", "f1", "f2", "b1", "b2", "sketch"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, b1 bigint, b2 bigint, sketch array<bigint>")


def _full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, set) of the documents in ``ids`` and a few others."""
    held = docs.sparkSession.sparkContext.broadcast(IdFilter(ids))

    def run(batches):
        for b in batches:
            at = pa.array(np.flatnonzero(held.value.test(np.asarray(b.column(1)))))
            part = b.take(at)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([*_sets(part.column(2), n)])], ["id", "set"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.select("id", IdFilter.slot("id"), "text").mapInArrow(run, "id bigint, set array<bigint>")


def _similar(percent: int) -> str:
    """Possible by the sizes alone, by one-bit minima, and not yet in one component."""
    return f"100 * least(n, n2) >= {percent} * greatest(n, n2) and bit_count(b1 ^ c1) + bit_count(b2 ^ c2) <= {BITS_APART}"


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, work: Workspace, name: str, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity asked for."""
    pairs = work.cut(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), f"{name}-pairs")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.lit(1).alias("one")).select("id")
    sk = ends.join(classes.select("id", "n", "sketch"), "id")
    s1, s2 = sk.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), sk.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    # sketch of the union: its K smallest values; the share held by both estimates the similarity
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    held = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    slack = SIGMAS * (percent / 100 * (1 - percent / 100)) ** 0.5
    # sketches of K or fewer values are the sets themselves, with a union of up to twice K: not cut, it is exact
    both = F.size(F.array_intersect("sa", "sb"))
    exact = 100 * both >= percent * (F.col("na") + F.col("nb") - both)
    enough = F.when((F.col("na") <= K) & (F.col("nb") <= K), exact).otherwise(held >= percent / 100 * F.size(union) - slack * F.sqrt(F.size(union)))
    likely = work.cut(pairs.join(s1, "a").join(s2, "b").where(enough).select("a", "b"), f"{name}-likely")
    ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).groupBy("id").agg(F.lit(1).alias("one")).select("id")
    full = _full_sets(docs, ends, id_col, text_col, n)
    full = work.cut(full.join(ends, "id", "left_semi").groupBy("id").agg(F.any_value("set").alias("set")), f"{name}-sets")
    common = F.size(F.array_intersect("set", "other"))
    total = F.size("set") + F.size("other") - common
    links = likely.join(full.withColumnRenamed("id", "a"), "a").join(full.select(F.col("id").alias("b"), F.col("set").alias("other")), "b").where(100 * common >= percent * total).select("a", "b")
    links = work.cut(links, f"{name}-links")
    work.drop(f"{name}-sets", f"{name}-pairs", f"{name}-likely")
    return links


def heads(n: Column, percent: int) -> Column:
    """How many of its rarest retained values a set of n shingles puts into lists.

    With K or fewer shingles all of them are retained.  A partner of as many at most
    retains all of its own too, and at least percent * n of them are shared.  A larger
    partner has m <= n * 100 / percent and retains K of them; at most (100 - percent) * m
    / 100 of those are not shared.
    """
    whole = F.ceil(n * percent / 100.0)
    larger = K - F.floor(n * (100 - percent) / float(percent))
    return F.when(n > K, F.lit(K - SHARED + 1)).otherwise(n - F.least(whole, larger) + 1).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable), kept."""
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    sig = work.cut(sketches(docs, id_col, text_col, n), "sketches")
    key = ["n", "f1", "f2"]
    classes = sig.where("n > 0").groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("b1").alias("b1"), F.any_value("b2").alias("b2"), F.any_value("sketch").alias("sketch"))
    classes = work.cut(classes, "classes")
    base = classes.where("id is not null")

    # inverted lists of the rarest retained values
    posted = base.select("id", F.explode("sketch").alias("v"))
    often = posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = posted.join(often, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("many"))
    room = heads(F.col("n"), percent) - (F.least("n", F.lit(K)) - F.size("many")).cast("int")  # values retained by no other come first and need no list
    head = ranked.join(base.select("id", "n", "b1", "b2"), "id").where(room > 0).withColumn("shared", F.size("many")).withColumn("many", F.slice("many", F.lit(1), F.greatest(room, F.lit(0))))
    alone = (F.least("n", F.lit(K)) - F.col("shared")).cast("int")
    lists = head.select(F.explode("many.v").alias("v"), "id", "n", "b1", "b2", alone.alias("alone"))
    lists = work.cut(lists, "lists")

    # stars
    middle = lists.groupBy("v").agg(F.min(F.struct("alone", "id", "n", "b1", "b2")).alias("m"), F.count("*").alias("members")).where("members > 1")
    middle = work.cut(middle.select("v", "members", F.col("m.id").alias("b"), F.col("m.n").alias("n2"), F.col("m.b1").alias("c1"), F.col("m.b2").alias("c2")), "pivots")
    star = lists.join(middle, "v").where("id <> b").where(_similar(percent)).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    links = [_verified(star, classes, docs, work, "star", id_col, text_col, n, percent)]
    roots = components(links[0], work, "star")

    # members of one short list in different components
    placed = lists.join(middle.select("v", "members", F.col("b").alias("pivot")), "v").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = work.cut(placed, "placed")
    few = placed.where(f"members <= {SMALL}")
    other = few.select("v", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("root").alias("root2"))
    rest = few.join(other, "v").where("id < b and root <> root2").where(_similar(percent)).select(F.col("id").alias("a"), "b")
    links.append(_verified(rest, classes, docs, work, "rest", id_col, text_col, n, percent))

    # members of longer lists, once for each pivot
    many = placed.where(f"members > {SMALL}").groupBy("pivot", "id").agg(*(F.any_value(c).alias(c) for c in ("n", "b1", "b2", "root")))
    links.append(_blocked(many, docs, work, id_col, text_col, n, percent))

    linked = reduce(DataFrame.unionByName, links)
    roots = components(linked, work, "all")
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or root is not null").select(*key, F.coalesce("root", "id").alias("component"))
    out = sig.select("id", *key).join(named, key, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


KEYS = ["pivot", "c1", "s1", "c2", "s2"]


def _pairs_of_block(t: pa.Table, percent: int):
    """Rows of the first and second block of a group, and which pairs can be similar and are apart."""
    cols = {c: t.column(c).to_numpy() for c in ("id", "n", "b1", "b2", "root", "cls", "sub", "c1", "s1", "c2", "s2")}
    one = np.flatnonzero((cols["cls"] == cols["c1"]) & (cols["sub"] == cols["s1"]))
    two = np.flatnonzero((cols["cls"] == cols["c2"]) & (cols["sub"] == cols["s2"]))
    n1, n2 = cols["n"][one][:, None], cols["n"][two][None, :]
    x = {c: cols[c].view(np.uint64) for c in ("b1", "b2")}  # signs don't count
    apart = np.bitwise_count(x["b1"][one][:, None] ^ x["b1"][two][None, :]).astype(np.int16)
    apart += np.bitwise_count(x["b2"][one][:, None] ^ x["b2"][two][None, :])
    ok = (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (apart <= BITS_APART) & (cols["root"][one][:, None] != cols["root"][two][None, :])
    return cols, one, two, ok


def _blocked(many: DataFrame, docs: DataFrame, work: Workspace, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Links between components among documents that share a pivot.

    Similar sets differ in size by one class at most, classes being powers of
    100 / percent.  A class of a pivot is cut into blocks of at most BLOCK documents
    and about BLOCK_ITEMS shingles; each pair of blocks of like size is one group.
    A first pass finds which documents can have a partner, a second brings their sets.
    """
    apart = many.groupBy("pivot").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("pivot")
    cls = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent))).cast("int")
    many = work.cut(many.join(apart, "pivot", "left_semi").withColumn("cls", cls), "many")
    size = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_ITEMS) / F.max("n")))).cast("int")
    blocks = many.groupBy("pivot", "cls").agg(F.ceil(F.count("*") / size).cast("int").alias("s"))
    blocks = blocks.groupBy("pivot").agg(F.map_from_entries(F.collect_list(F.struct("cls", "s"))).alias("blocks"))
    rows = many.join(blocks, "pivot")
    count = lambda c: F.coalesce(F.try_element_at("blocks", c), F.lit(0))
    own, up, down = count(F.col("cls")), count(F.col("cls") + 1), count(F.col("cls") - 1)
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id"), own.cast("bigint")).cast("int"))
    c, s = F.col("cls"), F.col("sub")
    group = lambda c1, s1, c2, s2: F.struct(c1.alias("c1"), s1.alias("s1"), c2.alias("c2"), s2.alias("s2"))
    each = lambda k, f: F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), f)).otherwise(F.array().cast("array<struct<c1:int,s1:int,c2:int,s2:int>>"))
    groups = F.concat(
        each(own, lambda j: group(c, F.least(s, j), c, F.greatest(s, j))),
        each(up, lambda j: group(c, s, c + 1, j)),
        each(down, lambda j: group(c - 1, j, c, s)),
    )
    rows = rows.withColumn("g", F.explode(groups)).select("pivot", "g.*", "id", "n", "b1", "b2", "root", "cls", "sub")
    schema = "pivot bigint, c1 int, s1 int, c2 int, s2 int, id bigint, n bigint, b1 bigint, b2 bigint, root bigint, cls int, sub int"

    def hopeful(t: pa.Table) -> pa.Table:
        _, one, two, ok = _pairs_of_block(t, percent)
        hit = np.unique(np.concatenate([one[ok.any(1)], two[ok.any(0)]]))
        return t.take(pa.array(hit))

    rows = rows.repartition(*KEYS)  # else the groups of one pivot stay in the task that its join left them in
    hits = work.cut(rows.groupBy(*KEYS).applyInArrow(hopeful, schema), "hopeful")
    ends = hits.groupBy("id").agg(F.lit(1).alias("one")).select("id")
    full = work.cut(_full_sets(docs, ends, id_col, text_col, n).join(ends, "id", "left_semi").groupBy("id").agg(F.any_value("set").alias("set")), "block-sets")

    def linked(t: pa.Table) -> pa.Table:
        cols, one, two, ok = _pairs_of_block(t, percent)
        sets = t.column("set").combine_chunks()
        length = np.asarray(sets.value_lengths(), np.int64)
        row = np.repeat(np.arange(len(length)), length)
        _, item, often = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
        keep = often[item] > 1
        number = np.cumsum(often > 1) - 1
        row, item = row[keep], number[item[keep]]
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        place = np.full((2, len(length)), -1)
        place[0, one], place[1, two] = np.arange(len(one)), np.arange(len(two))
        common = np.zeros((len(one), len(two)), np.float32)
        for low in range(0, int((often > 1).sum()), 4096):
            at = slice(*np.searchsorted(item, [low, low + 4096]))
            x = np.zeros((2, max(len(one), len(two)), 4096), np.float32)
            for side in (0, 1):
                p = place[side, row[at]]
                x[side, p[p >= 0], item[at][p >= 0] - low] = 1
            common += x[0, : len(one)] @ x[1, : len(two)].T
        total = length[one][:, None] + length[two][None, :] - common
        i, j = np.nonzero(ok & (100 * common >= percent * total))
        # of links between the same two components one is enough
        a, b = cols["id"][one[i]], cols["id"][two[j]]
        r = np.sort(np.stack([cols["root"][one[i]], cols["root"][two[j]]], 1), 1)
        first = np.unique(r, axis=0, return_index=True)[1] if len(r) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b)[first]), "b": pa.array(np.maximum(a, b)[first])})

    links = work.cut(hits.join(full, "id").groupBy(*KEYS).applyInArrow(linked, "a bigint, b bigint"), "block-links")
    work.drop("block-sets", "hopeful")
    return links


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of documents that are kept.

    Texts are not shuffled: rows outside a bit filter of the dropped ids pass at
    once, and only the others are joined with those ids.
    """
    work = Workspace(docs.sparkSession, "dedup")
    gone = near_duplicates(docs, id_col, text_col, n, percent).where("not kept").select(F.col(id_col).cast("bigint").alias("id"))
    gone = work.cut(gone.groupBy("id").agg(F.lit(1).alias("one")).select("id"), "gone")
    part = IdFilter(gone).split(docs, id_col)
    return part[False].unionByName(part[True].join(gone, part[True][id_col].cast("bigint") == gone["id"], "left_anti"))
