"""Near-duplicate documents by SetSketch registers: banded candidates, a joint estimate, then full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, release
from .components import components
from .textscan import SMALL, mix64, shingles, slices

#: Bands of so many registers each. A pair of Jaccard 0.85 shares no band with probability 1.2e-5, one of 0.8 with 5e-4.
BANDS, PER_BAND = 24, 6
REGISTERS = BANDS * PER_BAND
#: Base of the register scale and rate of the exponentials; 16-bit registers then never overflow.
B, RATE, TOP = 1.001, 20.0, 65535
#: A pair is verified unless its estimate is below the threshold by this much (5 standard deviations at 0.8).
SLACK = 0.16
#: Pairs whose likelihoods are laid out at once: each takes a dozen rows of GRID doubles.
PAIRS, GRID = 256, 201
#: Nodes that may share a rarest element before only those of one band are paired for it.
TOGETHER = 16
_rng = np.random.default_rng(99)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes: floor(1 - log_B of the least exponential), truncated, for each register.

    The registers of a union are the maxima of the registers of its parts.
    """
    u = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(u), 2048):
        h = (u[None, a : a + 2048] ^ _XOR) * _MUL
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets by maximum likelihood from both sketches and the set sizes.

    a, b: registers, one row a pair. The likelihood is that of the numbers of registers above, below and equal.
    """
    if len(a) > PAIRS:
        return np.concatenate([estimate(*(x[lo : lo + PAIRS] for x in (a, b, na, nb))) for lo in range(0, len(a), PAIRS)])
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, GRID)[None, :] * most

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12, 1)

    above, below = p(u - v * j), p(v - u * j)
    equal = np.clip(1 - above - below, 1e-12, 1)
    like = up * np.log(above) + down * np.log(below) + (a.shape[1] - up - down) * np.log(equal)
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, its distinct k-word shingles (lower-cased A-Z) as sorted hashes."""
    for s in slices(column, SMALL):
        s = s.lower()
        start, end, row = s.spans()
        h, at = shingles(s.hashes(start, end), row, s.n, k)
        cut = np.searchsorted(at, np.arange(s.n + 1))
        for i in range(s.n):
            yield np.unique(h[cut[i] : cut[i + 1]])


def _node(u: np.ndarray) -> bytes:
    return np.array([u.sum(dtype=np.uint64), mix64(u ^ np.uint64(0xABCDEF123)).sum(dtype=np.uint64)], ">u8").tobytes()


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept for each row: components of links with 100 * |A & B| >= percent * |A | B|.

    A set holds the distinct k-word shingles of the whole text in lower case, or the whole sequence where it has
    fewer words. Rows with equal sets are one node of the graph. Nodes that share a band of sketch registers are
    candidates, but the pairs of a band are not written out: every node of a band is compared with the band's
    leader, and links are merged into components. Only bands that hold several components go on: nodes whose sets
    have too many elements of their own to be linked with anything are left out, and the rest are compared with the
    most typical node of the band. Then pairs of different components that share one of their rarest elements are
    compared, which all links that are left must do. So a band of thousands of near copies costs about one
    comparison each, and no link between components is passed over. An element that more than TOGETHER nodes have among
    their rarest, as in texts made of few templates, pairs only nodes that share a band too. Candidates whose joint estimate comes near the
    threshold are confirmed on full sets.

    component_id is the smallest key of the component, and kept says key = component_id. Empty and null texts are
    linked with nothing. A null key counts as larger than any other; of rows that share the smallest key all are
    kept. Other columns are ignored; an empty table gives no rows.
    """
    seen, comps = _classes(docs, k, percent, key, text)
    names = comps.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = comps.join(names, "comp").select("node", "component_id")
    # wordless rows have no node and meet nothing, so they take no part in the join
    out = seen.where("node is not null").select("id", "n", "node").join(named, "node").select("id", "n", "component_id")
    out = out.unionByName(seen.where("node is null").select("id", "n", F.col("id").alias("component_id")))
    component = F.col("component_id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns: of each component of near_duplicates() one row, that of the smallest key.

    Rows without words all stay. Of equal rows of the smallest key one stays.
    """
    seen, comps = _classes(docs, k, percent, key, text)
    # null keys count as larger than any other
    best = comps.groupBy("comp").agg(F.min("one").alias("one")).select(F.xxhash64("one.id").alias("_i"), F.col("one.th").alias("_t"))
    wordless = seen.where("node is null").select(F.xxhash64("id").alias("_i"), F.col("th").alias("_t")).distinct()
    marked = docs.select(F.struct("*").alias("_row"), F.xxhash64(key).alias("_i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    kept = marked.join(best, ["_i", "_t"], "left_semi").dropDuplicates(["_i", "_t"])
    return kept.unionByName(marked.join(wordless, ["_i", "_t"], "left_semi")).select("_row.*")


def _classes(docs: DataFrame, k: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """id, th, n, node for each row, and node, one, id, comp for each node."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, regs = [], [], []
            for u in _sets(batch.column(2), k):
                n.append(len(u))
                node.append(_node(u) if len(u) else None)
                regs.append(registers(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(regs, pa.binary())], names=["id", "th", "n", "node", "regs"])

    seen = keep(rows.mapInArrow(sketch, f"id {kind}, th long, n long, node binary, regs binary"))
    # one text stands for a node; min over a struct puts null ids first, so they are told apart
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("one")
    nodes = keep(seen.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("regs").alias("regs"), first))
    links = _links(nodes, rows, k, percent)
    comps = components(links)
    found = nodes.select("node", "one", F.when(~F.col("one.none"), F.col("one.id")).alias("id")).join(comps, "node", "left").select("node", "one", "id", F.coalesce("comp", "node").alias("comp"))
    return seen, keep(found)


def _links(nodes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: enough links to span every component, each confirmed on full sets."""
    width = 2 * PER_BAND
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("regs"), i * width + 1, F.lit(width)), i)))
    banded = keep(nodes.select("node", "n", band.alias("band")))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band")
    banded = keep(banded.join(shared, "band"))
    in_use = banded.select("node").distinct()
    sets = _full_sets(nodes.join(in_use, "node").select("node", "one"), rows, k)
    slim = nodes.select("node", "n", "regs")

    def spread(by: DataFrame) -> DataFrame:
        """Pairs of each node with the leaders of its bands: the node with the least share of elements of its own."""
        lead = F.min(F.struct(((F.col("n") - F.col("common")) / F.col("n")).alias("own"), "node", "n", "common", "comp")).alias("lead")
        chosen = by.groupBy("band").agg(lead)
        met = by.join(chosen.select("band", "lead"), "band").where("node != lead.node and comp != lead.comp")
        return met.where(possible("n", "lead.n", "common", "lead.common")).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))

    def possible(na: str, nb: str, sa: str, sb: str) -> F.Column:
        """Whether sets of such sizes, of which so many elements are not their own, can reach the threshold."""
        most = F.least(na, nb, sa, sb)
        return most * 100 >= (F.col(na) + F.col(nb) - most) * percent

    def open_bands(by: DataFrame) -> DataFrame:
        """The rows of bands with several components."""
        several = by.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("band")
        return keep(by.join(several, "band"))

    def tell(pairs: DataFrame) -> DataFrame:
        found = keep(_confirmed(pairs, slim, sets, percent))
        release(nodes.sparkSession)
        return found

    by = banded.select("band", "node", "n", F.col("n").alias("common"), F.col("node").alias("comp"))
    first = keep(spread(by).distinct())
    links = tell(first)
    merged = components(links)
    by = open_bands(by.drop("comp").join(merged, "node", "left").select("band", "node", "n", F.coalesce("comp", "node").alias("comp")))
    rare = keep(_rarest(by.select("node", "n").distinct(), sets, percent))
    by = open_bands(by.join(rare.select("node", "common").distinct(), "node").select("band", "node", "n", "common", "comp"))
    if by.isEmpty():
        return links
    second = keep(spread(by).distinct().join(first, ["a", "b"], "left_anti"))
    links = links.union(tell(second))
    merged = components(links)
    # what could still be linked shares one of its rarest elements with the other: all pairs of different components
    # (at the first that they share, neither can have fewer behind it than a link needs)
    by = open_bands(by.drop("comp").join(merged, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp")))
    bands = by.groupBy("node").agg(F.first("comp").alias("comp"), F.collect_list("band").alias("bands"))
    left = keep(rare.join(bands, "node").select("e", "node", "n", "behind", "comp", "bands"))
    crowded = left.groupBy("e").agg((F.count(F.lit(1)) > TOGETHER).alias("crowded"))
    at = F.when(F.col("crowded"), F.transform("bands", lambda b: F.xxhash64("e", b))).otherwise(F.array("e"))
    left = left.join(crowded, "e").select(F.explode(at).alias("at"), "node", "n", "behind", "comp")
    x, y = (left.select("at", *(F.col(c).alias(c + side) for c in ("node", "n", "behind", "comp"))) for side in "xy")
    met = x.join(y, "at").where(F.expr("nodex < nodey and compx != compy") & possible("nx", "ny", "behindx", "behindy"))
    third = met.select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct().join(first.union(second), ["a", "b"], "left_anti")
    return links.union(tell(third))


def _rarest(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, n, common, e, behind: elements e of a node's set, rarest first, one more than a linked set may lack.

    Sets of which so many elements are common reach the threshold only if they share one of these, whatever the
    order, as long as it is one for all sets. common is the number of elements that some other node has too, behind of
    those that follow e in the order, e included. Nodes that have too many of their own to be linked with any other are left out.
    """
    held = keep(nodes.join(sets, "node").select("node", "n", F.explode("set").alias("e")))
    often = held.groupBy("e").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = held.join(often, "e")
    ranked = shared.select("node", "n", "e", F.row_number().over(Window.partitionBy("node").orderBy("c", "e")).alias("at"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("common"))
    # n - ceil(n * percent / 100) + 1 elements, the node's own among them, which come first and meet nothing
    reach = F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.col("common"))
    return ranked.where((F.col("at") <= reach) & (F.col("common") * 100 >= F.col("n") * percent)).select("node", "n", "common", "e", (F.col("common") - F.col("at") + 1).alias("behind"))


def _full_sets(reps: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """node, set: sorted shingle hashes of one text for each node."""
    texts = rows.join(reps.select(F.col("one.id").alias("i"), F.col("one.th").alias("t")), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            found = list(_sets(batch.column(0), k))
            if found:
                ends = np.cumsum([0, *map(len, found)])
                values = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([_node(u) for u in found], pa.binary()), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values).cast(pa.list_(pa.int64()))], names=["node", "set"])

    return keep(texts.mapInArrow(full, "node binary, set array<long>").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, slim: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold on full sets, after the joint estimate has dropped those far below it."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                good = estimate(ra, rb, na, nb) >= percent / 100 - SLACK
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(good))

    x = slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    y = slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    likely = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(near, "a binary, b binary, na long, nb long")
    x, y = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = likely.join(x, "a").join(y, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"))
    return both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, links at 85 percent."""
    return near_duplicates(docs, 3, 85)
