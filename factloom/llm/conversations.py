"""Repair of the structure of conversations: the cheapest edits that make roles read (s?(ua)+)?.

Rows of a conversation, in order of turns, are kept (0), given another role (1) or deleted (2, the only
way for a blank row or a copy of an earlier one); a row cut off in its text costs 5 more if it stays;
an empty user or assistant row may be put in anywhere (5). What the roles may be is an automaton of
four states, so the least costs from every place and state on are an array [turns, conversations,
states]. Conversations are bucketed by length; all of a bucket move one turn at a time, from the last
turn to the first, and edits are traced from the first to the last, one step for all of them. Of equal
costs the edits whose initials (D, I, K, R) come first are taken; in a state a letter leads to one
place only, so the trace is one path.

Conversations of at most `ROWS` rows and `BYTES` bytes are sorted together and streamed through tasks.
A longer one is cut into segments of its sorted rows: each segment's costs are a 4 x 4 table, found
with the same arrays for all segments at once; a scan over the tables (one small row for every 65,536
rows) gives the costs at every segment's end, then the state at its start, and each segment traces
its own rows. Only the hash of the repaired text reads a long conversation in order in one task; it
holds a batch at a time. Audits and hashes are one cell for a conversation, as asked.

Defined cases: null conv_id, turn, role and text count as one space where text is needed; rows of
one turn go by role, then text (in a long conversation by a hash of both); repeated rows are rows;
a conversation of which no row is left has zeros, an empty audit and the hash of the empty text;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, written
from .spelling import crc32_sql

ROWS, BYTES = 10_000, 16 << 20
#: Rows of a long conversation's segment, as a power of two.
SEGMENT = 16
#: Segments whose costs are computed side by side.
TOGETHER = 8
SPACES = " \t\n\x0b\x0c\r"
NEVER = 1 << 40
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. A new row, or one of a new role, leads on like this.
EXPECTED = ("user", "user", "assistant", "user")
NEXT = np.array([2, 2, 3, 2])
#: State after a row whose role starts with s, u, a or else, by state; -1 where that mustn't follow.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Cost of a row that stays: sound, blank, a copy, cut off.
STAYS = np.array([0, NEVER, NEVER, CUT])
LAST = np.array([0, NEVER, NEVER, 0])
#: Rows put in behind the last one, by state.
TAIL = (0, 2, 1, 0)
RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text, alive: rows after damage; a dropped row stays as one that isn't alive."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")) % 20
    text = F.when(F.col("what") <= 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    found = conversations.select(conv_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), words("role").alias("role"), words("text").alias("text"), what.alias("what"))
    return found.select(
        "key", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("what") != 0).alias("alive"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def conv_key(conv_id: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def faulty(rows: DataFrame) -> DataFrame:
    """rows with `role_no` (s, u, a, else: 0 to 3) and `fault` (0 none, 1 blank, 3 cut off; copies are found later)."""
    ending = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(ending == "", 1).when(ending.isin(".", "!", "?"), 0).otherwise(3)
    initial = F.left("role", F.lit(1))
    return rows.withColumns({"role_no": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3), "fault": fault})


def _relaxed(costs: np.ndarray) -> np.ndarray:
    for _ in range(2):
        costs = np.minimum(costs, costs[:, NEXT] + INSERT)
    return costs


def backward(codes: np.ndarray, lengths: np.ndarray, end: np.ndarray, closing: bool = True) -> np.ndarray:
    """Least costs [turn, conversation, state] from there on; codes [turn, conversation] are 4 * role + fault.

    end: costs after the last row by state; closing: rows may be put in there.
    """
    turns, n = codes.shape
    back = np.empty((turns + 1, n, 4), dtype=np.int64)
    back[turns] = _relaxed(end) if closing else end
    for t in range(turns - 1, -1, -1):
        after, stays, to = back[t + 1], STAYS[codes[t] & 3][:, None], KEPT[codes[t] >> 2]
        kept = np.where(to >= 0, stays + np.take_along_axis(after, np.maximum(to, 0), 1), NEVER)
        costs = np.minimum(np.minimum(after + DELETE, stays + RENAME + after[:, NEXT]), kept)
        back[t] = np.where((t < lengths)[:, None], _relaxed(costs), after)
    return back


def trace(codes: np.ndarray, lengths: np.ndarray, end: np.ndarray, back: np.ndarray, start: np.ndarray, closing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Letters [step, conversation] (0 where done) of the cheapest edits, and the states that they end in."""
    turns, n = codes.shape
    every, place, state, letters = np.arange(n), np.zeros(n, dtype=np.int64), start.astype(np.int64), []
    while True:
        here, over = back[place, every, state], place >= lengths
        going = ~(over & (here == end[every, state])) if closing else ~over
        if not going.any():
            return np.array(letters, dtype=np.uint8).reshape(-1, n), state
        after, code = back[np.minimum(place + 1, turns), every], codes[np.minimum(place, turns - 1), every]
        stays, to, on = STAYS[code & 3], KEPT[code >> 2, state], NEXT[state]
        options = (  # in order of their letters
            (ord("D"), ~over & (here == DELETE + after[every, state]), state, 1),
            (ord("I"), here == INSERT + back[place, every, on], on, 0),
            (ord("K"), ~over & (to >= 0) & (here == stays + after[every, np.maximum(to, 0)]), to, 1),
            (ord("R"), ~over & (here == stays + RENAME + after[every, on]), on, 1),
        )
        letter, left = np.zeros(n, dtype=np.uint8), going.copy()
        step, following = np.zeros(n, dtype=np.int64), state.copy()
        for mark, fits, to_state, moved in options:
            chosen = left & fits
            letter[chosen], following[chosen], step[chosen] = mark, to_state[chosen], moved
            left &= ~chosen
        letters.append(letter)
        place, state = place + step, following


def repaired(letters: str, rows: Iterator[tuple[str, str]], state: int = 0) -> Iterator[str]:
    """The lines of a conversation after its edits; rows: role and text."""
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = int(KEPT["sua".find(role[:1]) if role[:1] else 3, state])
        else:
            role, state = EXPECTED[state], int(NEXT[state])
        yield f"{role}:{text}"


def solve(codes: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Least cost and audit of each conversation, in buckets of lengths up to the next power of two."""
    cost, audit = np.zeros(len(codes), dtype=np.int64), [""] * len(codes)
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        padded = np.zeros((int(sizes[members].max(initial=1)) or 1, len(members)), dtype=np.int64)
        for j, i in enumerate(members):
            padded[: sizes[i], j] = codes[i]
        end = np.tile(LAST, (len(members), 1))
        back = backward(padded, sizes[members], end)
        letters, _ = trace(padded, sizes[members], end, back, np.zeros(len(members)))
        cost[members] = back[0, :, 0]
        for j, i in enumerate(members):
            audit[i] = letters[:, j].tobytes().replace(b"\0", b"").decode()
    return cost, audit


def _illegal(role_no: np.ndarray) -> np.ndarray:
    """Whether each row but the first mustn't follow the one before."""
    pair = role_no[:-1] * 4 + role_no[1:]
    return ~np.isin(pair, (1, 6, 9))  # su, ua, au


def _whole(chunk: pa.Table) -> pa.RecordBatch:
    """Results of the conversations of a chunk, which holds all their rows in order."""
    frame = pd.DataFrame({c: chunk.column(c).to_numpy(zero_copy_only=False) for c in ("key", "role", "text", "alive", "role_no", "fault")})
    turn = chunk.column("turn")
    frame["turn"], frame["timed"] = turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero((frame["key"] != frame["key"].shift()).to_numpy())
    keys = frame["key"].to_numpy()[first]
    frame["conv"] = np.searchsorted(first, np.arange(len(frame)), side="right") - 1
    frame = frame[frame["alive"].astype(bool)].reset_index(drop=True)
    fault = frame["fault"].to_numpy(dtype=np.int64).copy()
    fault[(fault != 1) & frame.duplicated(["conv", "role", "text"]).to_numpy()] = 2
    conv, role_no, turn, timed = frame["conv"].to_numpy(), frame["role_no"].to_numpy(dtype=np.int64), frame["turn"].to_numpy(dtype=np.int64), frame["timed"].to_numpy(dtype=bool)
    cuts = np.searchsorted(conv, np.arange(len(keys) + 1))
    codes, texts, roles = role_no * 4 + fault, frame["text"].to_numpy(), frame["role"].to_numpy()
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    cost, audit = solve([codes[a:b] for a, b in spans])
    out: dict[str, list] = {c: [] for c in ("key", *_COUNTS, "audit", "repaired_sha256")}
    for i, (a, b) in enumerate(spans):
        known = np.unique(turn[a:b][timed[a:b]])
        gaps = int(known[-1] - known[0]) + 1 - len(known) if len(known) else 0
        lines = "\n".join(repaired(audit[i], zip(roles[a:b], texts[a:b], strict=True)))
        faults = np.bincount(fault[a:b], minlength=4)
        row = (keys[i], gaps, *faults[1:].tolist(), int(_illegal(role_no[a:b]).sum()), int(cost[i]), audit[i], hashlib.sha256(lines.encode()).hexdigest())
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64() if c in _COUNTS else pa.string()) for c in out]))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations in chunks, out of rows that are sorted by conversation."""
    held: list[pa.RecordBatch] = []

    def cut(everything: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        rows = pa.Table.from_batches(held)
        n = len(rows)
        if not everything:
            key = rows.column("key").to_numpy(zero_copy_only=False)
            n = int(np.argmax(key == key[-1]))
        if n:
            yield _whole(rows.slice(0, n).combine_chunks())
        held = rows.slice(n).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * ROWS or sum(b.nbytes for b in held) >= BYTES:
            yield from cut(False)
    if held:
        yield from cut(True)


def repair_short(rows: DataFrame) -> DataFrame:
    """Results of conversations that fit in memory; rows of faulty()."""
    ordered = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("key", "turn", "role", "text", "alive", "role_no", "fault").mapInArrow(frugal(_by_conversation), RESULT)


# conversations in segments

_PIECE = "key string, seg long, codes binary, n long, blank long, duplicate long, truncated long, illegal long, first_role int, last_role int, first_turn long, last_turn long, turns long"


def _piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """A segment's rows in order as one row: their codes, counts, and what its ends look like."""
    pdf = pdf.sort_values("at")
    role, fault = pdf["role_no"].to_numpy(dtype=np.int64), pdf["fault"].to_numpy(dtype=np.int64)
    known = pdf["turn"].to_numpy(dtype=np.int64)[pdf["timed"].to_numpy(dtype=bool)]
    ends = (int(known[0]), int(known[-1]), len(np.unique(known))) if len(known) else (0, 0, 0)
    row = (pdf["key"].iloc[0], int(pdf["seg"].iloc[0]), (role * 4 + fault).astype(np.uint8).tobytes(), len(pdf), *np.bincount(fault, minlength=4)[1:].tolist())
    return pd.DataFrame([(*row, int(_illegal(role).sum()), int(role[0]), int(role[-1]), *ends)], columns=[c.split()[0] for c in _PIECE.split(", ")])


def _tensors(pdf: pd.DataFrame, copies: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(segments, codes, lengths) for a few segments at a time, each `copies` times side by side."""
    for k in range(0, len(pdf), TOGETHER):
        part = pdf.iloc[k : k + TOGETHER]
        own = [np.frombuffer(blob, dtype=np.uint8) for blob in part["codes"]]
        codes = np.zeros((max(map(len, own)), len(own)), dtype=np.int64)
        for j, c in enumerate(own):
            codes[: len(c), j] = c
        yield part, np.repeat(codes, copies, axis=1), np.repeat([len(c) for c in own], copies)


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each segment 4 x 4 costs, from the state at its start to that at its end."""
    units = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for pdf in batches:
        for part, codes, lengths in _tensors(pdf, 4):
            costs = backward(codes, lengths, np.tile(units, (len(part), 1)), closing=False)[0].reshape(-1, 4, 4)
            tables = np.minimum(costs, NEVER).transpose(0, 2, 1).reshape(-1, 16).tolist()
            yield pd.DataFrame({"key": part["key"], "seg": part["seg"], "table": tables})


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of each segment of a conversation, from its last to its first."""
    pdf = pdf.sort_values("seg")
    costs, ends = _relaxed(LAST[None, :])[0], []
    for t in reversed(pdf["table"].tolist()):
        ends.append(costs.tolist())
        costs = (np.array(t, dtype=np.int64).reshape(4, 4) + costs[None, :]).min(axis=1)
    return pd.DataFrame({"key": pdf["key"], "seg": pdf["seg"], "ends": ends[::-1], "cost": int(costs[0])})


def _traced(pdf: pd.DataFrame, starts: np.ndarray | None) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(segments, letters, last states); from all four states each where starts is None.

    A row may be put in before any row of a segment, so what stands behind its last row is left to the
    next; behind the last segment of all, the costs say what is put in there.
    """
    for part, codes, lengths in _tensors(pdf, 4 if starts is None else 1):
        n = 4 if starts is None else 1
        begin = np.tile(np.arange(4), len(part)) if starts is None else starts[part.index]
        end = np.repeat(np.array(part["ends"].tolist(), dtype=np.int64), n, axis=0)
        back = backward(codes, lengths, end, closing=False)
        yield part, *trace(codes, lengths, end, back, begin, closing=False)


def _moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each segment the state it ends in, by the state it starts in."""
    for pdf in batches:
        for part, _, state in _traced(pdf, None):
            yield pd.DataFrame({"key": part["key"], "seg": part["seg"], "to": state.reshape(-1, 4).tolist()})


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state that each segment of a conversation starts in, and what is put in behind the last."""
    pdf = pdf.sort_values("seg")
    state, starts = 0, []
    for to in pdf["to"]:
        starts.append(state)
        state = int(to[state])
    return pd.DataFrame({"key": pdf["key"], "seg": pdf["seg"], "start": starts, "tail": [""] * (len(pdf) - 1) + ["I" * TAIL[state]]})


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The letters of each segment's edits, cut behind each row's; what is put in at the end stays with the last row."""
    for pdf in batches:
        pdf = pdf.reset_index(drop=True)
        for part, letters, _ in _traced(pdf, pdf["start"].to_numpy()):
            for j, r in enumerate(part.itertuples()):
                cut = re.findall("I*[DKR]", letters[:, j].tobytes().replace(b"\0", b"").decode())
                cut[-1] += r.tail
                yield pd.DataFrame({"key": r.key, "seg": r.seg, "i": np.arange(len(cut)), "letters": cut})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of conversations whose rows come in order: key, role, text, letters."""
    schema = pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    key, audit, digest, state, empty = None, [], hashlib.sha256(), 0, True

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": [key], "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]}, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    yield told()
                key, audit, digest, state, empty = row["key"], [], hashlib.sha256(), 0, True
            audit.append(row["letters"])
            for line in repaired(row["letters"], iter([(row["role"], row["text"])]), state):
                digest.update(("" if empty else "\n").encode() + line.encode())
                empty = False
            for letter in row["letters"]:
                state = state if letter == "D" else int(KEPT[row["role_no"], state]) if letter == "K" else int(NEXT[state])
    if key is not None:
        yield told()


def repair_long(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Results of conversations of any length; rows of faulty(), alive ones, of a conversation that has some."""
    own = F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text").cast("binary"), 256)
    rows = rows.where("alive").drop("alive").withColumns({"own": own, "salt": F.monotonically_increasing_id() % 1024})
    # sorted slices of about one size: equal rows may lie in several, as they are told apart by nothing
    ordered = rows.repartitionByRange("key", F.asc_nulls_first("turn"), "own", "salt").sortWithinPartitions("key", F.asc_nulls_first("turn"), "own")
    placed = written(ordered.select("*", F.monotonically_increasing_id().alias("at")).drop("salt"), "conversation-rows")
    first = placed.groupBy("key", "own").agg(F.min("at").alias("first"))
    fault = F.when((F.col("fault") != 1) & (F.col("at") != F.col("first")), 2).otherwise(F.col("fault"))
    bits = F.shiftright("at", segment)
    coded = placed.select("key", "own", "at", "turn", "role_no", "fault").join(first, ["key", "own"])
    coded = coded.select("key", bits.alias("seg"), "at", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("timed"), "role_no", fault.alias("fault"))
    pieces = written(coded.groupBy("key", "seg").applyInPandas(_piece, _PIECE), "segments")
    costs = pieces.select("key", "seg", "codes").mapInPandas(frugal(_tables), "key string, seg long, table array<long>")
    ends = costs.groupBy("key").applyInPandas(_ends, "key string, seg long, ends array<long>, cost long")
    ended = written(pieces.select("key", "seg", "codes").join(ends, ["key", "seg"]), "segment-ends")
    starts = ended.mapInPandas(frugal(_moves), "key string, seg long, to array<long>").groupBy("key").applyInPandas(_scan, "key string, seg long, start long, tail string")
    edits = ended.join(starts, ["key", "seg"]).select("key", "seg", "codes", "ends", "start", "tail")
    edits = edits.mapInPandas(frugal(_edits), "key string, seg long, i long, letters string")
    return _finished(placed, pieces, ended, edits, segment)


def _finished(placed: DataFrame, pieces: DataFrame, ended: DataFrame, edits: DataFrame, segment: int) -> DataFrame:
    """Results from rows, segments and edits."""
    starts = placed.groupBy("key", F.shiftright("at", segment).alias("seg")).agg(F.min("at").alias("low"))
    letters = edits.join(starts, ["key", "seg"]).select((F.col("low") + F.col("i")).alias("at"), "letters")
    lines = placed.select("key", "at", "role", "role_no", "text").join(letters, "at")
    texts = lines.repartition("key").sortWithinPartitions("key", "at").select("key", "role", "role_no", "text", "letters")
    texts = texts.mapInArrow(frugal(_texts), "key string, audit string, repaired_sha256 string")
    counts = pieces.drop("codes").groupBy("key").applyInPandas(_totals, "key string, gaps long, blank long, duplicate long, truncated long, illegal long")
    cost = ended.groupBy("key").agg(F.max("cost").alias("cost"))
    return counts.join(cost, "key").join(texts, "key").select("key", *_COUNTS, "audit", "repaired_sha256")


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """A conversation's counts from those of its segments."""
    pdf = pdf.sort_values("seg")
    roles = np.stack([pdf["last_role"].to_numpy()[:-1], pdf["first_role"].to_numpy()[1:]], axis=1).astype(np.int64)
    illegal = int(pdf["illegal"].sum()) + int(sum(_illegal(pair).sum() for pair in roles))
    known = pdf[pdf["turns"] > 0]
    first, last = known["first_turn"].to_numpy(dtype=np.int64), known["last_turn"].to_numpy(dtype=np.int64)
    distinct = int(known["turns"].sum() - (last[:-1] == first[1:]).sum())
    gaps = int(last[-1] - first[0]) + 1 - distinct if len(known) else 0
    return pd.DataFrame([(pdf["key"].iloc[0], gaps, *(int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")), illegal)], columns=["key", *_COUNTS[:-1]])


def repair(conversations: DataFrame, rows: int = ROWS, size: int = BYTES, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged conversations."""
    damage = faulty(damaged(conversations))
    sizes = damage.groupBy("key").agg(F.count_if("alive").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = written(sizes.where((F.col("n") > rows) | (F.col("bytes") > size)).where("n > 0").select("key"), "long-conversations")
    out = repair_short(damage.join(long, "key", "left_anti"))
    if not long.isEmpty():
        out = out.unionByName(repair_long(damage.join(long, "key", "left_semi"), segment))
    kind = conversations.schema["conv_id"].dataType
    conv_id = F.when(F.col("key") != "", F.substr(F.col("key"), F.lit(2)).cast(kind))
    return out.select(conv_id.alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all of `conversations`."""
    return repair(table(spark, sf_dir, "conversations"))


def op11_sql() -> str:
    """The same rows in DuckDB SQL: costs from the last row to the first, edits from the first to the last."""
    space = r"[\x20\x09-\x0D]"
    letter = """CASE WHEN p <= n AND c = 2 + CASE s WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END THEN 'D'
        WHEN c = 5 + CASE WHEN s = 2 THEN b3 ELSE b2 END THEN 'I'
        WHEN p <= n AND k IS NOT NULL AND c = stay + CASE k WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END THEN 'K' ELSE 'R' END"""
    return f"""
    WITH RECURSIVE
    src AS (SELECT coalesce('=' || conv_id, '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS w FROM conversations),
    dam AS (SELECT key, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN w = 1 THEN '' WHEN w = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN w = 3 THEN 2 ELSE 1 END)) AS rep FROM src WHERE w <> 0),
    num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, encode(role), encode(text), rep) AS p, count(*) OVER (PARTITION BY key) AS n FROM dam),
    seen AS (SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY p) > 1 AS again FROM num),
    rws AS (SELECT *, CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?]{space}*\\z') THEN 3 ELSE 0 END AS fault FROM seen),
    cst AS (SELECT *, CAST(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS BIGINT) AS stay FROM rws),
    bk(key, p, b0, b1, b2, b3) AS (
      SELECT key, max(p) + 1, CAST(0 AS BIGINT), CAST(10 AS BIGINT), CAST(5 AS BIGINT), CAST(0 AS BIGINT) FROM cst GROUP BY key
      UNION ALL
      SELECT key, p, least(c0, 5 + least(c2, c3 + 5)), least(c1, 5 + least(c2, c3 + 5)), least(c2, c3 + 5), least(c3, c2 + 5) FROM (
        SELECT c.key, c.p, least(b0 + 2, stay + 1 + b2, CASE r WHEN 's' THEN stay + b1 WHEN 'u' THEN stay + b2 ELSE 1000000000 END) AS c0,
          least(b1 + 2, stay + 1 + b2, CASE r WHEN 'u' THEN stay + b2 ELSE 1000000000 END) AS c1,
          least(b2 + 2, stay + 1 + b3, CASE r WHEN 'a' THEN stay + b3 ELSE 1000000000 END) AS c2,
          least(b3 + 2, stay + 1 + b2, CASE r WHEN 'u' THEN stay + b2 ELSE 1000000000 END) AS c3
        FROM bk JOIN cst c ON c.key = bk.key AND c.p = bk.p - 1)),
    tr(key, p, s, audit, lines, done) AS (
      SELECT DISTINCT key, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]), FALSE FROM cst
      UNION ALL
      SELECT key, CASE WHEN done OR e = 'I' THEN p ELSE p + 1 END, CASE WHEN done OR e = 'D' THEN s WHEN e = 'K' THEN k WHEN s = 2 THEN 3 ELSE 2 END,
        CASE WHEN done THEN audit ELSE audit || e END,
        CASE WHEN done OR e = 'D' THEN lines ELSE list_append(lines, (CASE WHEN e = 'K' THEN role WHEN s = 2 THEN 'assistant' ELSE 'user' END) || ':' || (CASE WHEN e = 'I' THEN '' ELSE text END)) END, done
      FROM (SELECT *, {letter} AS e FROM (
        SELECT tr.key, tr.p, tr.s, tr.audit, tr.lines, coalesce(c.n, tr.p - 1) AS n, c.role, c.text, c.stay, b.b2, b.b3, a.b0 AS a0, a.b1 AS a1, a.b2 AS a2, a.b3 AS a3,
          CASE tr.s WHEN 0 THEN b.b0 WHEN 1 THEN b.b1 WHEN 2 THEN b.b2 ELSE b.b3 END AS c, c.p IS NULL AND tr.s IN (0, 3) AS done,
          CASE WHEN c.r = 's' AND tr.s = 0 THEN 1 WHEN c.r = 'u' AND tr.s <> 2 THEN 2 WHEN c.r = 'a' AND tr.s = 2 THEN 3 END AS k
        FROM tr JOIN bk b ON b.key = tr.key AND b.p = tr.p LEFT JOIN bk a ON a.key = tr.key AND a.p = tr.p + 1 LEFT JOIN cst c ON c.key = tr.key AND c.p = tr.p
        WHERE NOT tr.done))),
    cnt AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
        count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(r) OVER (PARTITION BY key ORDER BY p) || r AS pair FROM rws) GROUP BY key)
    SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      coalesce(b0, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS key FROM conversations) i
      LEFT JOIN cnt USING (key) LEFT JOIN (SELECT key, b0 FROM bk WHERE p = 1) USING (key) LEFT JOIN (SELECT * FROM tr WHERE done) USING (key)"""
