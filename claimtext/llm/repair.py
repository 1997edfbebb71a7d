"""Conversation structure repair by a grammar-compressed dynamic program.

A conversation's rows stand by turn (nulls first), then by role, then by the
SHA-256 of role and text.  Each row is one symbol: the initial of its role, in
capitals if its text is truncated, or ``D`` if it is blank or a duplicate.
Pairs of symbols that are frequent in the whole corpus become rules (Re-Pair,
some of the most frequent pairs in each round).  The cheapest edits are those
of a path through the states start, s, u and a.  Every symbol has a transfer
matrix: the least cost between any two states and, among equal costs, the
ASCII-least string of edits, as a rope of its children's.  Rules are evaluated
bottom-up, once for all conversations.

The order of edit strings agrees with their concatenation, so the product is
exact: of two strings over the same rows between the same states, one that
goes on where the other ends has inserts more, and costs more.

A conversation is cut into segments of at most ``SEGMENT`` rows and, beyond
one row, ``SEGMENT_BYTES`` of text: rows are dealt by ranges of their order,
so the segments of a large conversation are made and evaluated in many tasks.
Its segments' matrices then stream through one task in order, where only the
edits chosen so far are held (four bytes a row at most; the audit, one cell of
the result, is one byte a row).  SHA-256 of a repaired conversation is
sequential by its definition: its rows stream through one task.

Defined results: null role or text is one space; a null conv_id is a
conversation of its own; null turns do not count for gaps.  Rows that are equal in all
columns are duplicates of the first of them.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import SPACE_CHARS, checkpointed

SEGMENT = 1 << 12
SEGMENT_BYTES = 4 << 20
ROUNDS, RULES, LEAST = 10, 64, 2  # rounds of new rules, pairs looked at in a round, least count of a pair
FIRST_RULE = 0x100
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5  # costs
TRUNCATED = 5  # an undeleted truncated row
START, S, U, A = range(4)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ENDS = (START, A)
LEGAL = {"su", "ua", "au"}
BASE = "DsuaoSUAO"
MEMO = 20_000  # sequences whose matrix a worker keeps
_STATS = ("blank long, duplicate long, truncated long, illegal long, head string, tail string, "
          "first_turn long, last_turn long, n_turns long")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32(conv_id:turn) mod 20 says; nulls are one space."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    marked = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                                  kind.alias("kind")).where("kind != 0")
    k = F.col("kind")
    return marked.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("copy")).drop("copy")


# Matrices.  An entry is (cost, rope) or None; a rope is a string or a pair of ropes.

def flat(rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += (x[1], x[0])
    return "".join(out)


def _best(x, y):
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return x if x[1] is y[1] or flat(x[1]) <= flat(y[1]) else y


def _then(x, y):
    return None if x is None or y is None else (
        x[0] + y[0], x[1] + y[1] if isinstance(x[1], str) and isinstance(y[1], str) and len(x[1]) + len(y[1]) < 32
        else (x[1], y[1]))


def product(m: list, n: list) -> list:
    """Min-plus product of two matrices, 16 entries each, by rows."""
    out = []
    for p in range(0, 16, 4):
        for q in range(4):
            best = None
            for r in range(4):
                if m[p + r] is not None and n[4 * r + q] is not None:
                    best = _best(best, _then(m[p + r], n[4 * r + q]))
            out.append(best)
    return out


def _inserts() -> list:
    """From each state to each by inserts alone."""
    out = []
    for p in range(4):
        reached = {p: (0, "")}
        for _ in range(3):
            for (a, role), b in STEP.items():
                if role != "s" and a in reached:
                    reached[b] = _best(reached.get(b), (reached[a][0] + INSERT, reached[a][1] + "I"))
        out += [reached.get(q) for q in range(4)]
    return out


INSERTS = _inserts()


def _row(symbol: str) -> list:
    """The matrix of one row: inserts before it, then what can be done with it."""
    out = [None] * 16
    more = TRUNCATED if symbol in "SUAO" else 0
    for p in range(4):
        out[5 * p] = (DELETE, "D")
        for role in "" if symbol == "D" else "sua":
            q = STEP.get((p, role))
            if q is not None and symbol.lower() == role:
                out[4 * p + q] = _best(out[4 * p + q], (KEEP + more, "K"))
            elif q is not None and role != "s":
                out[4 * p + q] = _best(out[4 * p + q], (REROLE + more, "R"))
    return product(INSERTS, out)


def rule_matrices(rules: list[str]) -> dict[str, list]:
    """Bottom-up: the matrix of every symbol; a rule's symbols are rows' or earlier rules'."""
    out = {x: _row(x) for x in BASE}
    for k, (left, right) in enumerate(rules):
        out[chr(FIRST_RULE + k)] = product(out[left], out[right])
    return out


def compressed(text: str, rules: list[str]) -> str:
    for k, pair in enumerate(rules):
        text = text.replace(pair, chr(FIRST_RULE + k))
    return text


def evaluate(symbols: str, matrices: dict[str, list]) -> list:
    """The matrix of a sequence of symbols, as a balanced product."""
    parts = [matrices[x] for x in symbols]
    while len(parts) > 1:
        parts = [product(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return [x and (x[0], flat(x[1])) for x in parts[0]]


# Segments.

def segments(rows: DataFrame) -> DataFrame:
    """Rows in order, cut into numbered segments; numbers rise with the order inside a conversation."""
    last = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    role = F.substring("role", 1, 1)
    initial = F.when(role.isin("s", "u", "a"), role).otherwise("o")
    given = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    marked = given.select(
        "*", F.when(last == "", "D").when(F.substring(last, -1, 1).isin(".", "!", "?"), initial)
        .otherwise(F.upper(initial)).alias("kind"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("id"))  # parts equal rows; their order is of no account
    order = ["conv_id", "turn", "role", "digest", "id"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("id")
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = (f"seg long, conv_id {conv}, turns array<long>, roles array<string>, texts array<string>, "
              "kinds string, digests array<binary>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, held, size, ready, whole = TaskContext.get().partitionId() << 26, [], 0, [], 0
        types = None

        def batch_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1][0][0] for x in found], types),
                 pa.array([[r[1] for r in x[1]] for x in found], pa.list_(pa.int64())),
                 pa.array([[r[2] for r in x[1]] for x in found], pa.list_(pa.string())),
                 pa.array([[r[3] for r in x[1]] for x in found], pa.list_(pa.string())),
                 pa.array(["".join(r[4] for r in x[1]) for x in found], pa.string()),
                 pa.array([[None if r[4] == "D" else r[5] for r in x[1]] for x in found], pa.list_(pa.binary()))],
                names=["seg", "conv_id", "turns", "roles", "texts", "kinds", "digests"])

        for batch in batches:
            types = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (row[0] != held[0][0] or len(held) == SEGMENT or size + len(row[3]) > SEGMENT_BYTES):
                    ready.append((seg, held))
                    whole += size
                    seg, held, size = seg + 1, [], 0
                    if whole > SEGMENT_BYTES:
                        yield batch_of(ready)
                        ready, whole = [], 0
                held.append(row)
                size += len(row[3]) + 100
        if held:
            yield batch_of([*ready, (seg, held)])

    return dealt.mapInArrow(run, schema)


def sequences(cut: DataFrame) -> DataFrame:
    """(seg, conv_id, symbols and counts) of each segment, duplicates found over the whole conversation."""
    bits = SEGMENT.bit_length() - 1
    rows = cut.select("seg", "conv_id", F.posexplode("digests").alias("pos", "digest")).where("digest is not null")
    place = F.shiftleft("seg", bits) + F.col("pos")  # rises with the order of rows
    first = rows.groupBy("conv_id", "digest").agg(F.min(place).alias("place"))
    of_seg = first.groupBy(F.shiftright("place", bits).alias("of")).agg(
        F.collect_list(F.col("place").bitwiseAND(SEGMENT - 1).cast("int")).alias("firsts"))  # at most SEGMENT of them
    given = cut.select("seg", "conv_id", "kinds", "turns", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("roles"))
    conv = cut.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kinds, turns, roles, firsts in zip(*[batch.column(c).to_pylist() for c in range(2, 6)]):
                new = set(firsts or ())
                symbols = "".join(x if i in new else "D" for i, x in enumerate(kinds))
                blank = kinds.count("D")
                known = [t for t in turns if t is not None]
                out.append((symbols, blank, symbols.count("D") - blank, sum(map(symbols.count, "SUAO")),
                            sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])), roles[0], roles[-1],
                            min(known, default=None), max(known, default=None), len(set(known))))
            columns = list(zip(*out)) or [()] * 10
            texts = (0, 5, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *[pa.array(c, pa.string() if k in texts else pa.int64()) for k, c in enumerate(columns)]],
                names=["seg", "conv_id", "symbols", *[x.split()[0] for x in _STATS.split(", ")]])

    return given.join(of_seg, F.col("seg") == F.col("of"), "left").drop("of").mapInArrow(
        run, f"seg long, conv_id {conv}, symbols string, {_STATS}")


def learn_rules(seqs: DataFrame, rounds: int = ROUNDS, rules: int = RULES, least: int = LEAST) -> list[str]:
    """Re-Pair over all sequences: in each round the most frequent pairs of which none disturbs another."""
    found: list[str] = []
    for _ in range(rounds):
        known = list(found)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = compressed("\n".join(batch.column(0).to_pylist()), known)
                x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                pair = (x[:-1] << 32 | x[1:])[(x[:-1] != 10) & (x[1:] != 10)]
                pair, n = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n, pa.int64())], names=["pair", "n"])

        counted = seqs.select("symbols").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(rules).collect()
        lefts, rights = set(), set()
        for row in top:
            left, right = chr(row.pair >> 32), chr(row.pair & 0xFFFFFFFF)
            if left not in rights and right not in lefts and left not in lefts and right not in rights:
                found.append(left + right)
                lefts.add(left)
                rights.add(right)
        if len(found) == len(known):
            break
    return found


def transfers(seqs: DataFrame, rules: list[str]) -> DataFrame:
    """The sequences with their matrix: costs and edits, 16 of each, null where there is no way."""
    shared = seqs.sparkSession.sparkContext.broadcast((rules, rule_matrices(rules)))  # ROUNDS * RULES rules at most
    names = [c for c in seqs.columns if c != "symbols"]
    schema = ", ".join(f"{c} {seqs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, matrices = shared.value
        memo: dict[str, list] = {}
        for batch in batches:
            symbols = batch.column(len(names)).to_pylist()
            out = []
            for short in compressed("\n".join(symbols), rules).split("\n"):
                if short not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[short] = evaluate(short, matrices)
                out.append(memo[short])
            if not symbols:
                out = []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1],
                 pa.array([[x and x[0] for x in m] for m in out], pa.list_(pa.int64())),
                 pa.array([[x and x[1] for x in m] for m in out], pa.list_(pa.string()))],
                names=[*names, "costs", "edits"])

    return seqs.select(*names, "symbols").mapInArrow(run, f"{schema}, costs array<long>, edits array<string>")


# The edits chosen so far are a chain of nodes (node before, edits, state before, segment), one node a segment.

def _earlier(x, tail_x: str, y, tail_y: str) -> bool:
    """Whether the edits of x and tail_x come before those of y and tail_y, for chains of one length."""
    xs, ys = [tail_x], [tail_y]
    while x is not y:
        xs.append(x[1])
        ys.append(y[1])
        x, y = x[0], y[0]
    return "".join(reversed(xs)) < "".join(reversed(ys))


def _extended(ways: dict, matrix: list, seg: int) -> dict:
    """ways (state: cost, node) after one more matrix."""
    out: dict = {}
    for p, (cost, node) in ways.items():
        for q in range(4):
            if (entry := matrix[4 * p + q]) is not None:
                total = cost + entry[0]
                old = out.get(q)
                if old is None or total < old[0] or total == old[0] and _earlier(node, entry[1], old[1][0], old[1][1]):
                    out[q] = (total, (node, entry[1], p, seg))
    return out


class _Conversation:
    """Takes a conversation's segments in order."""

    def __init__(self):
        self.ways: dict = {START: (0, None)}
        self.sums = [0, 0, 0, 0]
        self.tail = self.first = self.last = None
        self.turns = 0

    def add(self, row: dict) -> None:
        matrix = [None if c is None else (c, e) for c, e in zip(row["costs"], row["edits"])]
        self.ways = _extended(self.ways, matrix, row["seg"])
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.sums[k] += row[name]
        if self.tail is not None:
            self.sums[3] += self.tail + row["head"] not in LEGAL
        self.tail = row["tail"]
        if row["n_turns"]:
            self.turns += row["n_turns"] - (self.last == row["first_turn"])
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]

    def result(self) -> tuple[list[tuple[int, int, str]], tuple]:
        """(seg, state before, edits) of the segments, and the report."""
        ended = _extended(self.ways, INSERTS, -1)
        cost, node = ended[min((q for q in ENDS if q in ended), key=lambda q: ended[q][0])]
        for q in ENDS:
            if q in ended and ended[q][0] == cost and ended[q][1] is not node and _earlier(
                    ended[q][1][0], ended[q][1][1], node[0], node[1]):
                node = ended[q][1]
        chain, tail = [], node[1]
        node = node[0]
        while node is not None:
            chain.append((node[3], node[2], node[1] + tail))
            node, tail = node[0], ""
        chain.reverse()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return chain, (gaps, *self.sums, cost, "".join(x[2] for x in chain))


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def choose(matrices: DataFrame) -> DataFrame:
    """(conv_id, seg, state, edits) of each segment; a conversation's last one has its report too."""
    conv = matrices.schema["conv_id"].dataType.simpleString()
    ordered = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    names = ["conv_id", "seg", "state", "edits", *REPORT, "audit"]
    schema = f"conv_id {conv}, seg long, state int, edits string, " + ", ".join(
        f"{x} long" for x in REPORT) + ", audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield from batch.to_pylist()

        def batch_of(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [kind, pa.int64(), pa.int32(), pa.string(),
                                                            *[pa.int64()] * len(REPORT), pa.string()])], names=names)

        out, size = [], 0
        for conv, parts in groupby(rows(), itemgetter("conv_id")):
            state = _Conversation()
            for row in parts:
                state.add(row)
            chain, report = state.result()
            for k, (seg, before, edits) in enumerate(chain):
                out.append((conv, seg, before, edits, *(report if k + 1 == len(chain) else [None] * 7)))
                size += len(edits) + 100
                if size > SEGMENT_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(run, schema)


def edited(state: int, edits: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of a segment's repaired rows."""
    at = 0
    for edit in edits:
        role, text = ("", "") if edit == "I" else (roles[at], texts[at])
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == U else "user"
        state = STEP[state, role[0]]
        yield role, text


def repaired_rows(cut: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, position (rises inside a conversation), role and text of all repaired conversations."""
    conv = cut.schema["conv_id"].dataType.simpleString()
    ways = chosen.select(F.col("seg").alias("of"), "state", "edits")
    met = cut.select("conv_id", "seg", "roles", "texts").join(ways, F.col("seg") == F.col("of")).drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                conv, seg, roles, texts, state, edits = (c[k].as_py() for c in batch.columns)
                rows = list(edited(state, edits, roles, texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(rows), batch.schema.field(0).type),
                     pa.array(np.arange(len(rows), dtype=np.int64) + (seg << 16)),
                     pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())],
                    names=["conv_id", "position", "role", "text"])

    return met.mapInArrow(run, f"conv_id {conv}, position long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the rows ``role:text``, joined by newlines, in order."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").select(
        "conv_id", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = sha = kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha is None or own != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = own, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())],
                                             names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def repair(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """A report on each conversation (REPORT and audit) and the repaired rows.

    ``folder``, which all machines see, keeps the segments that the rows are read from.
    """
    spark = conversations.sparkSession
    made = segments(conversations)
    made.write.option("compression", "zstd").parquet(folder)
    cut = spark.read.schema(made.schema).parquet(folder)
    seqs = checkpointed(sequences(cut))
    chosen = checkpointed(choose(transfers(seqs, learn_rules(seqs))))
    report = chosen.where("audit is not null").select("conv_id", *REPORT, "audit")
    return report, repaired_rows(cut, chosen)
