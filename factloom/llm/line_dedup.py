"""Line dedup by a log-template tree.

Lines are split into tokens at white space; tokens with a digit are variable fields (`<*>`). The
tree has a fixed depth: the token count, then the first `DEPTH` tokens. In a leaf, a line joins the
template it shares the most positions with, if these are at least `SIMILAR` of its tokens, and the
template keeps `<*>` wherever they differ. A leaf of more than `SHARE` lines is parsed in shares by a
salt, and the templates of all shares again as lines by another one, for as long as that merges a
tenth of them. What is left then holds few similar lines for its size, which random shares would keep
apart. So it is dealt by tokens: lines that differ in d places at most agree in one of any d + 1, hence
for each of the d + 1 places where the leaf varies most, lines with the same token there are parsed
together (again in this way, if they are many). No task ever has a leaf of many lines whole, and
lines that are similar always meet.

A template is recurring if it stands in at least `MIN_DOCS` different
documents; each of its lines goes, but for those of the document that has it first (smallest id).

Passages also recur inside lines that differ. So each text is cut into overlapping stretches as well,
its whole sequence of tokens, over the ends of lines: they begin and end where the hash of two tokens
is the least among `WINDOW` neighbours, and have at least `STRETCH` tokens. A stretch is a line of the
tree of its own, without variable fields: one that stands token for token in `MIN_DOCS` documents goes
from all but the first. Any `STRETCH + 2 * WINDOW` tokens that repeat hold a whole stretch, so no such
passage stays; up to `WINDOW` tokens at each of its ends may.

Lines and tokens move as 64-bit hashes, counted before they are shuffled. Tokens travel only for
lines of leaves that hold several different lines, told by a table of fixed size, then exactly.

Defined cases: null texts stay null; lines under `MIN_TOKENS` tokens stay unless a recurring stretch
covers them, blank lines always; a line whose tokens all go is cut with its end; a
document that has no text left but white space, as lines of it went, is dropped with its row
(`keep_empty=True` keeps it); texts without lines stay; rows of equal id count as one document;
rows without an id are documents by their text, equal texts one, with a number from 2^62 on;
other columns, whatever their names, pass through;
n_chars, where there is such a column, follows the text; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import ARRAYS, bound_batches, frugal, pack_arrays, table, tree_sum, written

DEPTH = 3
SIMILAR = 0.8
MIN_DOCS = 2
MIN_TOKENS = 5
#: Tokens of a stretch, at least, and places among which one is where a stretch may begin.
STRETCH = 20
WINDOW = 15
#: Lines of a leaf that are parsed in one task.
SHARE = 2_000
#: Templates of a leaf are parsed again as lines while a round leaves at most this share of them.
SHRINKS = 0.9
#: Lines that are compared with every template.
FEW = 64
#: The hash that stands for a variable field, and cells of the table of leaves.
FIELD = -1
CELLS = 1 << 20
#: Documents without an id are numbered from here on.
NO_ID = 1 << 62
#: Hashes of a document's lines that go, at most, in one row.
HEAVY = 200_000


def parse(lines: list[np.ndarray], weights: list[int], names: list[int]) -> list[int]:
    """The template each line of one leaf joins; lines are equally long arrays of token hashes.

    The heaviest lines found templates first (then the least name). Where a line and its template
    differ, the template holds FIELD from then on. A line is compared with those templates only that
    have its token at one of so many places that a similar one can't differ in all of them; the places
    where the leaf's lines differ most are taken.
    """
    size = len(lines[0]) if lines else 0
    templates = np.empty((16, size), dtype=np.int64)
    n = 0
    found = [0] * len(lines)
    places: list[int] = []
    holders: dict[tuple[int, int], list[int]] = {}
    if len(lines) > FEW:
        kinds = (np.diff(np.sort(np.stack(lines), axis=0), axis=0) != 0).sum(axis=0)
        places = np.argsort(-kinds, kind="stable")[: size - math.ceil(SIMILAR * size) + 1].tolist()
    for i in sorted(range(len(lines)), key=lambda i: (-weights[i], names[i])):
        line = lines[i]
        if places:
            near = np.array(sorted({t for p in places for t in holders.get((p, int(line[p])), ())}), dtype=np.int64)
        else:
            near = np.arange(n)
        if len(near):
            same = (templates[near] == line).sum(axis=1)
            best = int(near[np.argmax(same)])
            if same.max() >= SIMILAR * size:
                changed = np.flatnonzero(templates[best] != line)
                for p in places:
                    if p in changed and templates[best, p] != FIELD:
                        holders.setdefault((p, FIELD), []).append(best)
                templates[best, changed] = FIELD
                found[i] = best
                continue
        if n == len(templates):
            templates = np.concatenate([templates, np.empty_like(templates)])
        templates[n] = line
        for p in places:
            holders.setdefault((p, int(line[p])), []).append(n)
        found[i] = n
        n += 1
    return found


class Lines:
    """The long enough lines and the stretches of a group of documents, as hashes of their tokens.

    doc: of each line, its document in the group; place: which line of the document it is; start: its
    first token in tokens; size: how many it has; leaf and masked: hashes. token_*: of each token, its
    bytes, its line and its document; before: of each document, how many lines stand before it.
    """

    def __init__(self, group: list[bytes]):
        buf = np.frombuffer(b"\n".join([*group, b""]), dtype=np.uint8)
        space = textops.SPACES[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        digits = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
        tokens = textops.range_hash(textops.prefix_hash(buf), start, end).view(np.int64) if len(start) else np.empty(0, dtype=np.int64)
        self.raw = tokens
        self.tokens = np.where(digits[end] > digits[start], FIELD, tokens)
        feeds = np.flatnonzero(buf == 10)
        line = numbered(start, feeds)
        first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(first, len(line)))
        at = np.arange(len(line)) - np.repeat(first, size)
        up, _ = textops.powers(int(size.max(initial=0)) + 1)
        if len(first):
            masked = textops.mix(np.add.reduceat(self.tokens.view(np.uint64) * up[at], first) + size.astype(np.uint64)).view(np.int64)
        else:
            masked = np.empty(0, dtype=np.int64)
        long = size >= MIN_TOKENS
        self.start, self.size, self.masked = first[long], size[long], masked[long]
        leaf = self.size.astype(np.uint64)
        for k in range(DEPTH):
            leaf = textops.mix(leaf * np.uint64(textops.BASE) + self.tokens[self.start + k].view(np.uint64))
        self.leaf = leaf.view(np.int64)
        ends = np.cumsum([len(x) + 1 for x in group])
        byte = start[self.start] if len(self.start) else self.start
        self.doc = np.searchsorted(ends, byte, "right")
        self.token_start, self.token_end, self.token_line = start, end, line
        self.token_doc = numbered(start, ends)
        self.feeds = feeds
        self.before = before = np.searchsorted(feeds, np.concatenate([[0], ends[:-1]]))
        self.place = line[self.start] - before[self.doc] if len(self.start) else self.start

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch its first token, the token after its last, and its hash."""
        n = len(self.raw) - WINDOW
        none = np.empty(0, dtype=np.int64)
        if n <= 0:
            return none, none, none
        raw = self.raw.view(np.uint64)
        pair = textops.mix(raw[:-1] * np.uint64(textops.BASE) + raw[1:])
        # windows of WINDOW pairs, those that lie in one document
        least = over_windows(np.minimum, pair)
        least[self.token_doc[:n] != self.token_doc[WINDOW:]] = 0
        edge = np.zeros(WINDOW - 1, dtype=np.uint64)
        anchors = np.flatnonzero(over_windows(np.maximum, np.concatenate([edge, least, edge])) == pair)
        last = np.searchsorted(anchors, anchors + STRETCH)
        begin, last = anchors[last < len(anchors)], last[last < len(anchors)]
        stop = anchors[last]
        inside = self.token_doc[begin] == self.token_doc[stop]
        begin, stop = begin[inside], stop[inside]
        return begin, stop, textops.range_hash(textops.sums(raw), begin, stop).view(np.int64)

    def without(self, texts: list[str], drops: list[np.ndarray]) -> list[str]:
        """The texts of the group, each without its lines and stretches whose hashes its drop holds."""
        size = [len(d) for d in drops]
        keys = doc_keys(np.repeat(np.arange(len(drops)), size), np.concatenate([*drops, np.empty(0, dtype=np.int64)]))
        line = np.isin(doc_keys(self.doc, self.masked), keys)
        places: dict[int, set[int]] = {}
        for doc, place in zip(self.doc[line].tolist(), self.place[line].tolist(), strict=True):
            places.setdefault(doc, set()).add(place)
        begin, stop, hashes = self.stretches()
        gone = np.isin(doc_keys(self.token_doc[begin], hashes), keys)
        edges = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.add.at(edges, begin[gone], 1)
        np.add.at(edges, stop[gone], -1)
        cut = np.cumsum(edges[:-1]) > 0
        touched: dict[int, set[int]] = {}
        for k in np.unique(self.token_line[cut]).tolist():
            doc = int(np.searchsorted(self.before, k, "right")) - 1
            touched.setdefault(doc, set()).add(k - int(self.before[doc]))
        out = []
        for doc, text in enumerate(texts):
            drop, shorter = places.get(doc, ()), touched.get(doc, ())
            if not drop and not shorter:
                out.append(text)
                continue
            kept = []
            for k, line in enumerate(text.split("\n")):
                if k in drop:
                    continue
                if k in shorter:
                    line = self._spliced(line, int(self.before[doc]) + k, cut)
                if line is not None:
                    kept.append(line)
            out.append("\n".join(kept))
        return out

    def _spliced(self, line: str, number: int, cut: np.ndarray) -> str | None:
        """The line of that number in the group without the tokens marked in cut; None if none is left.

        The space before a token goes with it, at the line's start that after it.
        """
        raw = line.encode("utf-8", "surrogatepass")
        at = int(self.feeds[number - 1]) + 1 if number else 0
        a, b = np.searchsorted(self.token_line, [number, number + 1]).tolist()
        edge = np.flatnonzero(np.diff(np.concatenate([[True], cut[a:b], [True]]).view(np.int8)))
        parts = []
        for first, last in zip((edge[0::2] + a).tolist(), (edge[1::2] + a).tolist(), strict=True):
            begin = at if first == a else int(self.token_end[first - 1]) if parts else int(self.token_start[first])
            end = at + len(raw) if last == b else int(self.token_end[last - 1])
            parts.append(raw[begin - at : end - at])
        return b"".join(parts).decode("utf-8", "surrogatepass") if parts else None


def over_windows(least: np.ufunc, values: np.ndarray) -> np.ndarray:
    """The least (or most) of each WINDOW values in a row, from those of half as many."""
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        values = least(values[:-step], values[step:])
        width += step
    return values


def numbered(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each start, how many bounds stand at or before it; both ascend."""
    counts = np.diff(np.searchsorted(starts, bounds, "left"), prepend=0, append=len(starts))
    return np.repeat(np.arange(len(bounds) + 1), counts)


def doc_keys(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of a document's number and a hash."""
    return textops.mix(hashes.view(np.uint64) + textops.mix(doc.astype(np.uint64) + np.uint64(1)))


def line_hashes(docs: DataFrame, kind_of_doc: str = "long") -> DataFrame:
    """doc, leaf, masked of each long enough line, and of each stretch without a leaf (kind 1); equal
    ones of a row count once. kind_of_doc: the type of doc."""

    @frugal
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch["doc"].to_numpy(zero_copy_only=False)
            for at, group in textops.buffers(batch["text"].to_pylist()):
                lines = Lines(group)
                once = firsts(lines.doc, lines.masked)
                yield batch_of(docs[at + lines.doc[once]], pa.array(lines.leaf[once]), lines.masked[once], 0)
                begin, _, hashes = lines.stretches()
                doc = lines.token_doc[begin]
                once = firsts(doc, hashes)
                yield batch_of(docs[at + doc[once]], pa.nulls(len(once), pa.int64()), hashes[once], 1)

    def firsts(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return np.unique(doc_keys(doc, hashes), return_index=True)[1]

    def batch_of(doc: np.ndarray, leaf: pa.Array, masked: np.ndarray, kind: int) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(masked), kind, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.string() if kind_of_doc == "string" else pa.int64()), leaf, pa.array(masked), kinds], names=["doc", "leaf", "masked", "kind"])

    return docs.select("doc", "text").mapInArrow(split, f"doc {kind_of_doc}, leaf long, masked long, kind int")


def marked_cells(leaves: DataFrame) -> np.ndarray:
    """A table of fixed size that tells by a leaf's cell whether it may be among leaves."""

    @frugal
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, dtype=np.int32)
        for pdf in batches:
            total[pdf["leaf"].to_numpy().view(np.uint64) >> np.uint64(44)] = 1
        yield pack_arrays(TaskContext.get().partitionId(), total, 8)

    return tree_sum(leaves.select("leaf").mapInPandas(mark, ARRAYS), (CELLS,), "int32", 8) > 0


def templates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """masked, template: of each masked line in a leaf with several different lines, its template."""
    distinct = lines.groupBy("leaf", "masked").agg(F.count("*").alias("weight"))
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(distinct.join(leaves, "leaf"), "leaves")
    cells = docs.sparkSession.sparkContext.broadcast(marked_cells(shared))

    @frugal
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in textops.buffers(batch["text"].to_pylist()):
                lines = Lines(group)
                at = np.flatnonzero(cells.value[lines.leaf.view(np.uint64) >> np.uint64(44)])
                _, once = np.unique(lines.masked[at], return_index=True)
                at = at[once]
                words = [lines.tokens[s : s + n].tobytes() for s, n in zip(lines.start[at], lines.size[at], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.leaf[at]), pa.array(lines.masked[at]), pa.array(words, pa.binary())], names=["leaf", "masked", "tokens"])

    spelled = docs.select("text").mapInArrow(spell, "leaf long, masked long, tokens binary").dropDuplicates(["leaf", "masked"])
    worded = spelled.join(shared, ["leaf", "masked"]).select(F.col("leaf").alias("group"), "masked", "tokens", "weight", "n")
    return resolved(worded).select("masked", "template")


_PARSED = "group long, masked long, template long, tokens binary, weight long, n long"


def parse_shares(rows: DataFrame, salt: int) -> DataFrame:
    """Templates of the lines of each share of each group; rows: group, masked, tokens, weight, n (lines of the group).

    Returns group, masked, template, tokens (of a template, at its own row), weight and n.
    """
    shares = F.ceil(F.col("n") / SHARE)
    share = F.when(shares == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("masked", F.lit(salt)), shares))
    arrow = pa.schema([(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in (c.split() for c in _PARSED.split(", "))])

    @frugal
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (group, share); many groups have few lines, so they are taken from a stream."""
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[c].to_pylist() for c in ("group", "share", "masked", "tokens", "weight", "n")]
            for group, share, *row in zip(*columns, strict=True):
                if (group, share) != key:
                    out += parsed(key, held)
                    key, held = (group, share), []
                held.append(row)
            yield rows_of(out)
        yield rows_of(parsed(key, held))

    def parsed(key, held: list[list]) -> list[tuple]:
        held.sort(key=lambda r: r[0])
        lines = [np.frombuffer(r[1], dtype=np.int64) for r in held]
        found = parse(lines, [r[2] for r in held], [r[0] for r in held])
        groups: dict[int, list[int]] = {}
        for i, t in enumerate(found):
            groups.setdefault(t, []).append(i)
        out = []
        for at in groups.values():
            first = lines[at[0]]  # of the least name, as they are sorted
            if len(at) > 1:
                words = np.stack([lines[i] for i in at])
                first = np.where((words == first).all(axis=0), first, FIELD)
            weight = sum(held[i][2] for i in at)
            out += [(key[0], held[i][0], held[at[0]][0], first.tobytes() if i == at[0] else None, weight, held[i][3]) for i in at]
        return out

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    dealt = rows.select("group", share.cast("long").alias("share"), "masked", "tokens", "weight", "n")
    return dealt.repartition("group", "share").sortWithinPartitions("group", "share").mapInArrow(local, _PARSED)


def followed(merged: DataFrame, further: DataFrame) -> DataFrame:
    """masked, template of both steps: further says of some templates which they have joined."""
    up = further.select(F.col("masked").alias("template"), F.col("template").alias("upper"))
    return merged.join(up, "template", "left").select("masked", F.coalesce("upper", "template").alias("template"))


def resolved(rows: DataFrame) -> DataFrame:
    """masked, template of the lines of groups of any size; rows: group, masked, tokens, weight, n."""
    last = written(parse_shares(rows, 0), "templates")
    merged, stuck = last.select("masked", "template"), None
    for salt in itertools.count(1):
        many = last.where(F.col("n") > SHARE)
        after = F.count_if(F.col("template") == F.col("masked"))
        left = written(many.groupBy("group").agg(F.count("*").alias("before"), after.alias("after")), "left")
        tops = many.where("template = masked").select("group", "masked", "tokens", "weight")
        # many groups of few lines are the rule: nothing more to do for them
        slow = left.where((F.col("after") > SHRINKS * F.col("before")) & (F.col("after") > SHARE))
        if not slow.isEmpty():
            own = tops.join(slow.select("group", F.col("after").alias("n")), "group")
            stuck = own if stuck is None else stuck.unionByName(own)
        again = left.where((F.col("after") <= SHRINKS * F.col("before")) | (F.col("after") <= SHARE))
        if again.isEmpty():
            return merged if stuck is None else followed(merged, by_places(stuck))
        last = written(parse_shares(tops.join(again.select("group", F.col("after").alias("n")), "group"), salt), "templates")
        merged = followed(merged, last)


def varied_places(rows: DataFrame) -> DataFrame:
    """group, places: of each group's lines the d + 1 places with most different tokens, all that vary if these are fewer."""

    @frugal
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [np.frombuffer(t, dtype=np.int64) for t in pdf["tokens"]]
            size = np.array([len(x) for x in lines])
            place = np.concatenate([np.arange(n) for n in size]) if len(size) else size
            yield pd.DataFrame({"group": np.repeat(pdf["group"].to_numpy(), size), "size": np.repeat(size, size), "place": place, "token": np.concatenate([*lines, np.empty(0, dtype=np.int64)])}).drop_duplicates()

    told = rows.select("group", "tokens").mapInPandas(tokens, "group long, size long, place long, token long")
    kinds = told.groupBy("group", "size", "place").agg(F.countDistinct("token").alias("kinds")).where("kinds > 1")
    most = (F.col("size") - F.ceil(SIMILAR * F.col("size")) + 1).cast("int")
    ranked = kinds.groupBy("group", "size").agg(F.sort_array(F.collect_list(F.struct((-F.col("kinds")).alias("k"), "place"))).alias("p"))
    return ranked.select("group", F.slice(F.transform("p", lambda x: x["place"]), F.lit(1), most).alias("places"))


def by_places(rows: DataFrame) -> DataFrame:
    """masked, template of groups of many lines that are seldom similar: place after place, lines of one token there meet."""
    rows = written(rows, "stuck")
    places = written(varied_places(rows), "places")
    merged = rows.select("masked", F.col("masked").alias("template"))
    passes = places.agg(F.max(F.size("places")).alias("n")).first()["n"] or 0

    for k in range(passes):

        @frugal
        def dealt(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                token = [np.frombuffer(t, dtype=np.int64)[p] for t, p in zip(pdf["tokens"], pdf["place"], strict=True)]
                key = pdf["group"].to_numpy().view(np.uint64) * np.uint64(textops.BASE) + np.uint64(k)
                sub = textops.mix(textops.mix(key) + np.array(token, dtype=np.int64).view(np.uint64)).view(np.int64)
                yield pdf[["masked", "tokens", "weight"]].assign(group=sub)

        own = rows.join(places.where(F.size("places") > k).select("group", F.get("places", F.lit(k)).alias("place")), "group")
        subs = written(own.select("group", "masked", "tokens", "weight", "place").mapInPandas(dealt, "masked long, tokens binary, weight long, group long"), "subs")
        shared = subs.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        met = subs.join(shared, "group").select("group", "masked", "tokens", "weight", "n")
        found = written(resolved_whole(met), "met")
        merged = followed(merged, found.select("masked", "template"))
        changed = found.select("masked", "template", F.col("tokens").alias("new"), F.col("weight").alias("sum"))
        kept = rows.join(changed, "masked", "left").where("template is null or template = masked")
        rows = written(kept.select("group", "masked", F.coalesce("new", "tokens").alias("tokens"), F.coalesce("sum", "weight").alias("weight")), "stuck")
    return merged


def resolved_whole(rows: DataFrame) -> DataFrame:
    """masked, template, tokens, weight as of resolved(): tokens and weight of each template, at its own row."""
    found = written(resolved(rows), "whole")
    members = rows.join(found, "masked").select("template", "masked", "tokens", "weight")

    @frugal
    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the lines of a template agree in, over the templates of a batch."""
        for pdf in batches:
            out = []
            for template, own in pdf.groupby("template"):
                words = np.stack([np.frombuffer(t, dtype=np.int64) for t in own["tokens"]])
                out.append((template, np.where((words == words[0]).all(axis=0), words[0], FIELD).tobytes(), int(own["weight"].sum())))
            yield pd.DataFrame(out, columns=["template", "tokens", "weight"])

    schema = "template long, tokens binary, weight long"
    # combined where the lines are, then once more by template
    partial = members.select("template", "tokens", "weight").mapInPandas(common, schema)
    summed = partial.groupBy("template").applyInPandas(lambda pdf: next(common(iter([pdf]))), schema)
    up = summed.select(F.col("template").alias("masked"), "tokens", "weight")
    return found.join(up, "masked", "left").select("masked", "template", "tokens", "weight")


def gone_stretches(stretches: DataFrame, min_docs: int) -> DataFrame:
    """doc, masked of each recurring stretch that isn't in its first document."""
    if min_docs > 2:
        seen = stretches.select("doc", "masked").distinct().groupBy("masked").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    else:
        seen = stretches.groupBy("masked").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last")
    return stretches.join(seen.select("masked", "first"), "masked").where("doc <> first").select("doc", "masked")


def by_text(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """doc, masks: the set of each document's hashes that go, for its texts.

    An id that very many rows share may have any number of them; where there are more than `HEAVY`,
    each of its texts, by a hash in `own`, has those that stand in it instead.
    """
    sets = lambda df, by: df.groupBy(*by).agg(F.collect_set("masked").alias("masks"))
    gone = written(gone, "gone")
    heavy = written(gone.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("doc"), "heavy")
    if heavy.isEmpty():
        return sets(gone, ["doc"])
    texts = keyed.join(heavy, "doc", "left_semi").select(F.struct("doc", F.xxhash64("text").alias("own")).alias("doc"), "text").where("text is not null")
    own = line_hashes(texts.select(F.to_json("doc").alias("doc"), "text"), "string").select(F.from_json("doc", "doc long, own long").alias("d"), "masked").select("d.doc", "d.own", "masked")
    found = own.join(gone, ["doc", "masked"], "left_semi").distinct()
    light = sets(gone.join(heavy, "doc", "left_anti"), ["doc"]).select("doc", F.lit(None).cast("long").alias("own"), "masks")
    return light.unionByName(sets(found, ["doc", "own"]))


def dedup_lines(docs: DataFrame, keep_empty: bool = False, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of docs (doc_id, text among them), with recurring lines and stretches dropped from text."""
    bound_batches(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)))
    keyed = docs.select(doc.alias("doc"), "text").where("text is not null")
    both = written(line_hashes(keyed), "lines", partition="kind")
    lines = both.where("kind = 0").select("doc", "leaf", "masked")
    stretches = both.where("kind = 1").select("doc", "masked")
    named = templates(keyed, lines)
    # counted for each masked line before any line meets its template
    by_line = lines.groupBy("masked").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    by_line = written(by_line.join(named, "masked", "left").withColumn("template", F.coalesce("template", "masked")), "masked")
    recurring = by_line.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last")
    if min_docs > 2:
        members = lines.join(by_line.select("masked", "template"), "masked").select("template", "doc").distinct()
        recurring = recurring.join(members.groupBy("template").count().where(F.col("count") >= min_docs).select("template"), "template")
    marked = by_line.select("masked", "template").join(recurring.select("template", "first"), "template").select("masked", "first")
    gone = lines.join(marked, "masked").where("doc <> first").select("doc", "masked").unionByName(gone_stretches(stretches, min_docs))
    gone = by_text(docs.select(doc.alias("doc"), "text"), gone)

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select(doc.alias("doc"), F.struct(*docs.columns).alias("row"))
    if "own" in gone.columns:
        whole = whole.withColumn("own", F.xxhash64("row.text"))
        joined = whole.join(gone.where("own is null").drop("own"), "doc", "left")
        heavy = gone.where("own is not null").withColumnRenamed("masks", "heavy_masks")
        joined = joined.join(heavy, ["doc", "own"], "left").withColumn("masks", F.coalesce("heavy_masks", "masks")).drop("heavy_masks", "own")
    else:
        joined = whole.join(gone, "doc", "left")

    @F.pandas_udf("string")
    @frugal
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, masks in batches:
            out = texts.to_numpy(dtype=object, copy=True)
            at = np.flatnonzero(texts.notna())
            found = out[at].tolist()
            for first, group in textops.buffers(found):
                these = at[first : first + len(group)]
                out[these] = Lines(group).without(out[these].tolist(), masks.iloc[these].tolist())
            yield pd.Series(out, dtype=object)

    hit = F.col("masks").isNotNull() & F.col("row.text").isNotNull()
    joined = joined.withColumn("hit", hit)
    text = F.when(F.col("hit"), without(F.when(F.col("hit"), F.col("row.text")), F.col("masks"))).otherwise(F.col("row.text"))
    result = joined.withColumn("kept", text)
    if not keep_empty:
        result = result.where(~F.col("hit") | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("hit"), F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return result.select(*(columns[c].alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines: doc_id, text, n_chars (documents left empty stay, empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return dedup_lines(docs, keep_empty=True)
