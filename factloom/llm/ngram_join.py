"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's set holds its distinct word shingles, as 64-bit hashes. Equal sets are collapsed first:
one representative (the smallest doc_id) stands for its class, and only representatives are joined.
Each of `ORDERS` global orders ranks shingles by how often their hashed cell occurs in the corpus
(rare first; one table, as large as the corpus asks for up to a bound), then by a hash of its own. Two sets with Jaccard similarity
of at least num/den must share a token among the first |x| - ceil(|x| num/den) + 1 tokens under
every order, so a pair is verified only if it passes the filters of all orders.

Candidates meet under the first order: tokens in few prefixes yield pairs, of which those stay that
share so much of their prefixes that the sizes' least overlap can be reached; a token in many prefixes
(a large group of near copies) yields none. Candidates are then compared in tiles of bounded size (see tiles()): a tile applies the filters
of all orders, counts overlaps exactly and returns only links that join parts not yet joined in it.
No candidate is capped or dropped; components equal those of all links.

Defined cases: null or blank texts have the empty set, are linked with nothing and are their own
component; null ids can't be reached by others, have component null and are otherwise counted;
repeated rows are one class and each answered; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .common import ARRAYS, bound_batches, frugal, pack_arrays, table, tree_sum, written
from .graph import components

ORDERS = 3
#: Cells of the table of counts, at least and at most, those of a piece of it, and the largest count of a cell. Tokens
#: of a cell rank alike: with many more tokens than cells, those of hundreds of sets would pass for rare ones.
CELLS = 1 << 20
MOST_CELLS = 1 << 26
CHUNK = 1 << 18
MOST = (1 << 16) - 1
#: A token in more prefixes than this goes to tiles.
FEW = 64
#: Tokens of all sets in a tile, or in each of its two sides.
BLOCK = 2_000_000
#: Sets that stand for the heaviest components of a crowded token, and rounds of comparing with them. They
#: save comparisons; what is compared in the end is the same.
PIVOTS = 8
ROUNDS = 3
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], dtype=np.uint64)


def least_shared(n: int, num: int, den: int) -> int:
    """Tokens of a prefix: of two sets that link, prefixes this long share a token."""
    return n - -(-n * num // den) + 1


def ranked(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """A key for each token, by which the given global order ranks."""
    cell = cell_of(tokens, len(classes)).astype(np.int64)
    return (classes[cell].astype(np.uint64) << np.uint64(58)) | (textops.mix(tokens ^ SEEDS[order]) >> np.uint64(6))


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, num: int, den: int) -> np.ndarray:
    """The first tokens under an order, in that order."""
    n = least_shared(len(tokens), num, den)
    keys = ranked(tokens, classes, order)
    if n < len(tokens):
        first = np.argpartition(keys, n - 1)[:n]
        return tokens[first[np.argsort(keys[first], kind="stable")]]
    return tokens[np.argsort(keys, kind="stable")]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= num * (len(a) + len(b) - both)


HEADS = "doc_id long, n_shingles long, s1 long, s2 long, head array<bigint>"


def heads(docs: DataFrame, width: int, num: int, den: int, classes) -> DataFrame:
    """Of each document's set: its size, a 128-bit signature, and its prefix under the first order."""

    @frugal
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, parts = [], [], [], []
            for tokens in textops.shingle_sets(batch["text"].to_pylist(), width):
                n.append(len(tokens))
                s1.append(int(signed(textops.mix(tokens ^ SEEDS[0]).sum(keepdims=True))[0]))
                s2.append(int(signed(textops.mix(tokens ^ SEEDS[1]).sum(keepdims=True))[0]))
                parts.append(signed(prefix(tokens, classes.value, 0, num, den)) if len(tokens) else np.empty(0, dtype=np.int64))
            ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
            head = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, dtype=np.int64)])))
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, long), pa.array(s1, long), pa.array(s2, long), head], names=["doc_id", "n_shingles", "s1", "s2", "head"]
            )

    return docs.mapInArrow(sign, HEADS)


def rarity_classes(docs: DataFrame, width: int) -> np.ndarray:
    """For each hashed cell, the magnitude (log2) of how many documents' sets hit it.

    Counts stop at `MOST`, in a task's table and in sums of them. What a task sends is about as large as
    the tokens that it has, as a table's empty stretches pack to nothing.
    """
    cells = cells_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunks = cells // CHUNK

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint16)
        waiting, size = [], 0

        def add() -> None:
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            total[at] = np.minimum(total[at] + n, MOST)

        for batch in batches:
            for tokens in textops.shingle_sets(batch["text"].to_pylist(), width):
                waiting.append(cell_of(tokens, cells).astype(np.uint32))
                size += len(tokens)
                if size > CELLS:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        part = TaskContext.get().partitionId()
        for k, piece in enumerate(np.split(total, chunks)):
            if piece.any():
                rows = pack_arrays(part, piece, 1).assign(chunk=k)
                yield pa.RecordBatch.from_pandas(rows.astype({"part": "int32", "chunk": "int32"}), preserve_index=False)

    seen = tree_sum(docs.select("text").mapInArrow(count, ARRAYS), (cells,), "uint16", chunks)
    classes = np.empty(cells, dtype=np.uint8)
    for a in range(0, cells, CHUNK):
        classes[a : a + CHUNK] = np.log2(seen[a : a + CHUNK].astype(np.float32) + 1)
    return classes


def cells_for(size: int) -> int:
    """Cells for texts of so many bytes: a power of two, one for every 128 bytes or more up to MOST_CELLS."""
    return min(MOST_CELLS, max(CELLS, 1 << (size // 128).bit_length()))


def cell_of(tokens: np.ndarray, cells: int) -> np.ndarray:
    return tokens >> np.uint64(65 - int(cells).bit_length())


class Postings:
    """Which of a list of token arrays hold a token; tokens of one array only are left out."""

    def __init__(self, arrays: list[np.ndarray]):
        sizes = [len(x) for x in arrays]
        tokens = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(arrays)), sizes)
        _, name, count = np.unique(tokens, return_inverse=True, return_counts=True)
        again = count[name] > 1
        name, owner = name[again], owner[again]
        order = np.argsort(name, kind="stable")
        self.holders = owner[order]
        self.start = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(np.bincount(name, minlength=len(count)), out=self.start[1:])
        self.names = name
        self.edges = np.searchsorted(owner, np.arange(len(arrays) + 1))

    def sharing(self, i: int) -> np.ndarray:
        """The arrays that share a token with array i, once for each token, i among them."""
        names = self.names[self.edges[i] : self.edges[i + 1]]
        first, size = self.start[names], self.start[names + 1] - self.start[names]
        skip = np.repeat(first - (np.cumsum(size) - size), size)
        return self.holders[skip + np.arange(len(skip))]


def _tile(rows: pd.DataFrame, cross: bool, classes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links among rows (id, side, tokens): a spanning set of them; cross: only pairs of both sides."""
    rows = rows.sort_values("id", ignore_index=True)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"]]
    ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    heads = [Postings([prefix(x, classes, k, num, den) for x in sets]) for k in range(ORDERS)]
    whole = Postings(sets)
    root = np.arange(n)
    links = []
    for i in range(n):
        # what shares a token in the prefix of every order; the rest is done for these rows alone
        share = np.zeros(n, dtype=bool)
        share[heads[0].sharing(i)] = True
        near = i + 1 + np.flatnonzero(share[i + 1 :])
        near = near[(np.minimum(sizes[near], sizes[i]) * den >= np.maximum(sizes[near], sizes[i]) * num) & (root[near] != root[i])]
        if cross:
            near = near[side[near] != side[i]]
        for head in heads[1:]:
            if not len(near):
                break
            share = np.zeros(n, dtype=bool)
            share[head.sharing(i)] = True
            near = near[share[near]]
        if not len(near):
            continue
        both = np.bincount(whole.sharing(i), minlength=n)[near]
        for j in near[both * den >= num * (sizes[near] + sizes[i] - both)]:
            if root[j] != root[i]:
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return links


def _long(x: int | str) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else F.col(x).cast("long")


def _unit(component: str, token: int | str = 0, part: int | str = 0, group: int | str = 0, known: str | None = None) -> Column:
    """The key of a unit of sets; `known`: its sets are known to be in one component, `group`."""
    sure = F.lit(False) if known is None else F.col(known)
    return F.struct(_long(component).alias("a"), _long(token).alias("b"), _long(part).alias("c"), _long(group).alias("d"), sure.alias("known"))


def _dealt(sets: DataFrame, block: int, by: list[str]) -> DataFrame:
    """sets with `part`: those of equal `by` in parts of about `block` tokens each."""
    counts = sets.groupBy(*by).agg(F.ceil(F.sum("n") / block).alias("parts"))
    return sets.join(counts, by).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")


def tiles(pairs: DataFrame, often: DataFrame, sizes: DataFrame, block: int, compared: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Tiles (x, y, id, side) of sets to be compared, the pairs (a, b) that stand in none, links found on the way.

    pairs: candidates (a, b). often: crowded tokens (token, id). sizes: id, n. compared: the links of
    tiles. Pairs and shared crowded tokens lead from set to set; a cluster of sets with at most `block`
    tokens in all is one tile, so a set travels once however many partners it has. Of larger clusters,
    the pairs are left as pairs, and the sets of crowded tokens are cut into units (large_tiles).
    """
    often = written(often.select("token", "id").distinct(), "often")
    stars = often.join(often.groupBy("token").agg(F.min("id").alias("a")), "token").select("a", F.col("id").alias("b"))
    labels = components(pairs.unionByName(stars))
    weighed = labels.join(sizes.withColumnRenamed("id", "v"), "v")
    clusters = weighed.groupBy("component").agg(F.sum("n").alias("weight"))
    of = written(weighed.join(clusters, "component").select(F.col("v").alias("id"), "component", "n", "weight"), "clusters")
    small = of.where(F.col("weight") <= block).select(_unit("component").alias("x"), "id")
    small = small.select("x", F.col("x").alias("y"), "id", F.lit(0).alias("side"))
    big = of.where(F.col("weight") > block)
    left_pairs = pairs.join(big.select(F.col("id").alias("a")), "a", "left_semi")
    if big.isEmpty():
        return small, left_pairs, None
    large, found = large_tiles(often.join(big, "id"), block, compared)
    return small.unionByName(large), left_pairs, found


def large_tiles(often: DataFrame, block: int, compared: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Tiles for clusters of over `block` tokens, and links that are known already.

    often: token, id, component, n. Sets go into units of the same first token, by hash where these are
    over `block`. Each unit is compared with itself; then, in rounds, with a few pivots of its first
    token, members of the heaviest components so far. That leaves a large group of near copies in one
    component, but for few members. Units are then made anew, the sets of a heavy component apart from
    all others, and units that share a token meet unless both are of one component: of a group in u
    units u times those few are compared, not u times u. Without such a group every two units that share
    a token meet.
    """
    sets = written(often.groupBy("id", "component", "n").agg(F.min("token").alias("first")), "firsts")
    units = written(_dealt(sets, block, ["first"]).withColumn("u", _unit("component", "first", "part")), "units")
    own = units.select(F.col("u").alias("x"), F.col("u").alias("y"), "id", F.lit(0).alias("side"))
    found = written(compared(own), "links")
    for _ in range(ROUNDS):
        groups = components(found).select(F.col("v").alias("id"), F.col("component").alias("group"))
        often_linked = found.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links"))
        members = units.join(groups, "id").join(often_linked, "id", "left")
        weighed = members.groupBy("first", "group").agg(F.sum("n").alias("weight"), F.max(F.struct(F.coalesce("links", F.lit(0)), "id"))["id"].alias("id"))
        order = Window.partitionBy("first").orderBy(F.desc("weight"), "group")
        pivots = weighed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS).select("first", "id")
        pivots = written(pivots, "pivots")
        met = units.join(pivots.select("first").distinct(), "first", "left_semi").select(F.col("u").alias("x"), "id", F.lit(0).alias("side"))
        met = met.unionByName(units.select("first", F.col("u").alias("x")).distinct().join(pivots, "first").select("x", "id", F.lit(1).alias("side")))
        more = written(compared(met.withColumn("y", F.col("x"))), "links")
        ends = [groups.select(F.col("id").alias(s), F.col("group").alias("g" + s)) for s in "ab"]
        new = more.where("a <> b").join(ends[0], "a", "left").join(ends[1], "b", "left").where("not ga <=> gb or ga is null")
        if new.isEmpty():
            break
        found = written(found.unionByName(more), "links")
    groups = components(found).select(F.col("v").alias("id"), F.col("component").alias("group"))
    heavy = sets.join(groups, "id").groupBy("group").agg(F.sum("n").alias("weight")).where(F.col("weight") * PIVOTS >= block).select("group", F.lit(True).alias("known"))
    sets = sets.join(groups, "id", "left").join(heavy, "group", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    sets = sets.withColumn("group", F.when(F.col("known"), F.col("group")).otherwise(F.lit(0)))
    units = written(_dealt(sets, block, ["first", "group", "known"]).select("id", _unit("component", "first", "part", "group", "known").alias("u")), "units")
    by_token = often.select("token", "id").join(units, "id").select("token", "u").distinct()
    meet = by_token.select("token", F.col("u").alias("x")).join(by_token.select("token", F.col("u").alias("y")), "token")
    meet = written(meet.where("x <= y and not (x.known and y.known and x.d = y.d)").select("x", "y").distinct(), "meet")
    left = meet.join(units.withColumnRenamed("u", "x"), "x").select("x", "y", "id", F.lit(0).alias("side"))
    right = meet.where("x <> y").join(units.withColumnRenamed("u", "y"), "y").select("x", "y", "id", F.lit(1).alias("side"))
    return left.unionByName(right), found


def links(docs: DataFrame, sets: DataFrame, width: int, num: int, den: int, classes, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs with Jaccard at least num/den.

    docs: doc_id, text. sets: rep (a doc_id), n_shingles, head, one row for each different set.
    """
    rows = sets.select(F.explode("head").alias("token"), F.col("rep").alias("id"), F.col("n_shingles").alias("n"), F.size("head").cast("long").alias("p"))
    counts = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    rows = written(rows.join(counts, "token"), "shared")
    often = rows.where(F.col("c") > few)
    crowded = often.groupBy("id").agg(F.count("*").alias("o"))
    seldom = rows.where(F.col("c") <= few).join(crowded, "id", "left").select("token", F.struct("id", "n", F.coalesce("o", F.lit(0)).alias("o"), (F.col("n") - F.col("p")).alias("rest")).alias("a"))
    fits = (F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num) & (F.col("a.id") < F.col("b.id"))
    met = seldom.join(seldom.withColumnRenamed("a", "b"), "token").where(fits).groupBy("a", "b").agg(F.count("*").alias("shared"))
    # what the prefixes share, crowded tokens at most, and all that follows one of them must reach the
    # overlap that the two sizes ask for
    most = F.col("shared") + F.least("a.o", "b.o") + F.greatest("a.rest", "b.rest")
    pairs = written(met.where(most * (num + den) >= (F.col("a.n") + F.col("b.n")) * num).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(often.select(F.col("id").alias("doc_id"))).distinct()

    @frugal
    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[bytes]] = [[] for _ in range(ORDERS)]
            for tokens in textops.shingle_sets(batch["text"].to_pylist(), width):
                columns[0].append(tokens.tobytes())
                for k in range(1, ORDERS):
                    columns[k].append(np.sort(prefix(tokens, classes.value, k, num, den)).tobytes() if len(tokens) else b"")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.binary()) for x in columns)], names=["id", "tokens", *others])

    others = [f"p{k}" for k in range(1, ORDERS)]
    schema = "id long, tokens binary" + "".join(f", {p} binary" for p in others)
    # rows of an id are in one partition after the join, so equal ones go without another shuffle
    wanted = docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    wanted = written(wanted.mapInArrow(tokens_of, schema), "sets")

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = np.ones(batch.num_rows, dtype=bool)
            for x in [*others, "tokens"]:  # the cheap filters first
                for i, (a, b) in enumerate(zip(batch["a_" + x], batch["b_" + x], strict=True)):
                    if passed[i]:
                        a, b = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
                        passed[i] = linked(a, b, num, den) if x == "tokens" else len(np.intersect1d(a, b, assume_unique=True)) > 0
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(passed))

    sides = [wanted.select(F.col("id").alias(s), *(F.col(x).alias(f"{s}_{x}") for x in ["tokens", *others])) for s in "ab"]
    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        cross = pdf["side"].nunique() > 1
        return pd.DataFrame(_tile(pdf, cross, classes.value, num, den), columns=["a", "b"], dtype="int64")

    def compared(dealt: DataFrame) -> DataFrame:
        return dealt.join(wanted.select("id", "tokens"), "id").groupBy("x", "y").applyInPandas(tile, "a long, b long")

    sizes = sets.groupBy(F.col("rep").alias("id")).agg(F.sum("n_shingles").alias("n"))
    dealt, apart, found = tiles(pairs, often, sizes, block, compared)
    near = apart.join(sides[0], "a").join(sides[1], "b").mapInArrow(verify, "a long, b long")
    near = near.unionByName(compared(dealt))
    return near if found is None else near.unionByName(found)


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of at least num/den lead to.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = docs.sparkSession.sparkContext.broadcast(rarity_classes(docs, width))
    key = ["n_shingles", "s1", "s2"]
    headed = written(heads(docs, width, num, den, classes), "heads")
    some = headed.where("n_shingles > 0 and doc_id is not null")
    sets = written(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("head", "doc_id").alias("head")), "classes")
    reps = sets.drop("head")
    # an id that has several sets joins them
    several = some.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("k1"), F.max(F.struct(*key)).alias("k2")).where("k1 <> k2").select("doc_id")
    same_id = some.join(several, "doc_id").join(reps, key).select("doc_id", "rep").distinct()
    same_id = same_id.join(same_id.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
    labels = components(links(docs, sets, width, num, den, classes).unionByName(same_id))
    reps = reps.join(labels, reps["rep"] == labels["v"], "left").select(*key, F.coalesce("component", "rep").alias("component"))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return headed.drop("head").join(reps, key, "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs but for those whose component has a smaller doc_id.

    Of rows that repeat an id the one with the least hash of its text stays; rows without id all stay.
    """
    gone = jaccard_components(docs, width, num, den).where("component_id < doc_id").select("doc_id").distinct()
    kept = docs.select(F.struct(*docs.columns).alias("row"), "doc_id").join(gone, "doc_id", "left_anti")
    own = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).orderBy(F.xxhash64("row.text"), F.xxhash64("row"))
    return kept.withColumn("k", F.row_number().over(own)).where("k = 1").select("row.*")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)
