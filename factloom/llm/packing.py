"""Best-fit packing of token pieces into sequences, hierarchical with residual bins.

Texts are tokenised where they are read. Documents longer than a sequence are cut; only the first
piece may be shorter than a sequence. Pieces are dealt to partitions by hash and packed there by
best fit, longest first. Bins that are nearly full, or that no bin left anywhere could still join, are
done, and so are bins over half full beyond the number of those that could join them. The others become items of their own, are dealt to `FAN_IN` times fewer partitions and packed again,
until one partition is left. Rounds move bins (id, length), never pieces or texts; in the end every
piece learns its sequence and its place there through the chain of merges.

`packed_along` keeps an order of documents as well: pieces are dealt by stretches of `STRETCH` documents
instead of by hash, the rounds pack what `FAN_IN` neighbours left over, and sequences are numbered along the
order, so that their prefixes hold what its prefixes hold but for the few bins that no neighbour filled.

Defined cases: null texts count as empty, and an empty text is the one token END; repeated ids and
rows are packed each; an empty `documents` gives an empty result; no piece is dropped.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, frugal, table, written

SEQUENCE = 1024
END = 2
#: A bin with at most so much room left is done.
NEARLY = 8
FAN_IN = 8
#: Documents that are packed together where their order counts.
STRETCH = 2_048
#: Bits of an item's number for its piece, where items are numbered by places of documents.
PIECE_BITS = 24
VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
PIECES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

MERGES = "item long, bin long, offset long, filled long, done boolean"

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids as little-endian bytes, those of the tokenizers library.

    Texts of common characters go through tiktoken with the same vocabulary, which gives the same ids
    in a fifth of the time; a text with any other character, or with a special token, doesn't.
    """

    def __init__(self, path: str, ranks: str | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import public_tokenizers

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        special = "".join(f"|{re.escape(t.content)}" for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = re.compile(rf"[^\t\n\r -~\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u2030-\u205e\u20ac]{special}")

    def encode(self, text: str) -> bytes:
        if self.fast is None or self.odd.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast._core_bpe.encode_ordinary(text)).tobytes()


def encoder(path: str, ranks: str | None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, ranks)
    return _encoders[path]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, ids: bool = False, position: str | None = None) -> DataFrame:
    """Per piece: item (unique), doc_id, piece, start, length, ids_crc32, and the ids if asked for.

    position: a column with the unique place of each document; items are then numbered along it.
    """
    bound_batches(docs.sparkSession)

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (encoder(path, None) if path else encoder(tokenizer_path(), tokenizer_path(RANKS))).encode
        end = array("I", [END]).tobytes()
        item = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows = []
                places = batch["position"].to_pylist() if position else repeat(None)
                for doc_id, text, place in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), places):
                    item = item if place is None else place << PIECE_BITS
                    raw = encode(text or "") + end
                    n = len(raw) // 4
                    first = n % size or size
                    edges = [0, *range(first, n + 1, size)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = raw[4 * a : 4 * b]
                        rows.append((item, doc_id, k, a, b - a, zlib.crc32(part), part if ids else None))
                        item += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    place = [F.col(position).cast("long").alias("position")] if position else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place)
    found = rows.mapInArrow(cut, "item long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return found if ids else found.drop("ids")


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """The bin of each item by best fit, longest first; bins are numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by room left
    some: list[int] = []  # the rooms that have bins, in order
    n = 0
    for i in order:
        length = int(lengths[i])
        k = bisect_left(some, length)
        if k < len(some):
            left = some[k]
            b = room[left].pop()
            if not room[left]:
                del some[k]
            left -= length
        else:
            b, n, left = n, n + 1, size - length
        bins[i] = b
        if left:
            if not room[left]:
                insort(some, left)
            room[left].append(b)
    return bins


def pack(items: DataFrame, size: int = SEQUENCE, partitions: int | None = None, stretch: int | None = None) -> DataFrame:
    """items: item (long, unique), length (1 to size). Returns item, sequence_id, offset.

    Each round writes its merges (item, bin, offset in the bin); a bin's id is the id of its first
    item, so ids stay unique in all rounds.

    stretch: so many item ids are packed together, and what neighbouring stretches leave over after
    them; `partitions` is then the number of stretches. A bin's items stand in the order of their ids,
    and its id is the least of them.
    """
    spark = items.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def round_of(fewer: np.ndarray):
        def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
            pdf["bin"] = best_fit(pdf["length"].to_numpy(), size)
            pdf = pdf.sort_values(["bin", "item"], ignore_index=True) if stretch else pdf.sort_values("bin", kind="stable", ignore_index=True)
            grouped = pdf.groupby("bin")
            pdf["offset"] = grouped["length"].cumsum() - pdf["length"]
            pdf["filled"] = grouped["length"].transform("sum")
            pdf["bin"] = grouped["item"].transform("first")
            rest = (size - pdf["filled"]).to_numpy()
            pdf["done"] = (rest <= NEARLY) | (fewer[rest] == 0)
            # of bins over half full, which can't join each other, as many stay as there are items that fit
            half = pdf.loc[(rest < size / 2) & ~pdf["done"] & (pdf["item"] == pdf["bin"]), ["item", "filled"]].sort_values(["filled", "item"])
            place = half.groupby("filled").cumcount().to_numpy()
            over = half["item"][place >= fewer[size - half["filled"].to_numpy()]]
            pdf["done"] |= pdf["bin"].isin(over)
            return pdf[["item", "bin", "offset", "filled", "done"]]

        @frugal
        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat([*batches, pd.DataFrame({"item": [], "length": []}, dtype="int64")])
            if len(pdf):
                yield fit_group(pdf)

        return fit_group if stretch else fit

    chain, left = [], items.select("item", "length")
    while True:
        # how many items are left of each length or less: what no item fits can't be filled any more
        fewer = np.zeros(size + 1, dtype=np.int64)
        for length, n in left.groupBy("length").count().collect():  # at most `size` rows
            fewer[length] = n
        fewer = np.cumsum(fewer)
        if stretch:
            merged = left.groupBy(F.expr(f"item div {stretch}L")).applyInPandas(round_of(fewer), MERGES)
            stretch *= FAN_IN
        else:
            dealt = left.repartition(partitions, F.xxhash64("item", F.lit(partitions)))
            merged = dealt.mapInPandas(round_of(fewer), MERGES)
        merged = written(merged, "merged")
        chain.append(merged)
        if partitions == 1:
            break
        left = merged.where("item = bin and not done").select("item", F.col("filled").alias("length"))
        partitions = -(-partitions // FAN_IN)
    placed = chain[0].select("item", "bin", "offset", "done")
    for merged in chain[1:]:
        up = merged.select(F.col("item").alias("bin"), F.col("bin").alias("upper"), F.col("offset").alias("shift"), F.col("done").alias("upper_done"))
        placed = placed.join(up, "bin", "left").select(
            "item", F.coalesce("upper", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
    return placed.select("item", F.col("bin").alias("sequence_id"), "offset")


def packed(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Every piece of every document with sequence_id and offset."""
    cut = written(pieces(docs, path, size), "pieces")
    # a whole sequence needs no partner
    whole = cut.where(F.col("length") == size).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    partial = cut.where(F.col("length") < size)
    return whole.unionByName(partial.join(pack(partial, size), "item"))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: the place of each row in the order in which docs was written.

    A table's order is that of its files' names and of the rows in each, however reads are split.
    What isn't a table yet is written first.
    """
    spark = docs.sparkSession
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.children().isEmpty() or "_metadata" not in [a.name() for a in _listed(plan.metadataOutput())]:
        docs = written(docs.select("doc_id", "text"), "ordered")
    at = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", at["file_path"].alias("file"), at["row_index"].alias("place"))
    # one row for each file
    sizes = {r["file"]: r["n"] for r in rows.groupBy("file").agg((F.max("place") + 1).alias("n")).collect()}
    starts, start = [], 0
    for file in sorted(sizes, key=lambda f: (len(f), f)):
        starts.append((file, start))
        start += sizes[file]
    starts = spark.createDataFrame(starts, "file string, start long")
    return rows.join(F.broadcast(starts), "file").select("doc_id", "text", (F.col("start") + F.col("place")).alias("position"))


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def packed_along(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, stretch: int = STRETCH) -> DataFrame:
    """Every piece of every document with sequence_id and offset, along the order of docs as written.

    Stretches of documents are packed for themselves, then what neighbours leave over, in rounds as pack()
    does. A sequence's id is that of its first piece, so ids ascend along the order.
    """
    cut = written(pieces(in_order(docs), path, size, position="position"), "pieces")
    whole = cut.where(F.col("length") == size).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    partial = cut.where(F.col("length") < size)
    last = partial.agg(F.max("item")).first()[0]
    if last is None:
        return whole
    items = stretch << PIECE_BITS
    return whole.unionByName(partial.join(pack(partial, size, last // items + 1, items), "item"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
