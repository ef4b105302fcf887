"""Repair of conversation structure by dynamic programming over a grammar.

Rows of a conversation, in order of turn, must read ``(s?(ua)+)?`` by role initials. A row may be
kept (0), given another role of user and assistant (2) or deleted (3, a must for blank rows and
duplicates), and empty turns may be inserted anywhere (2); rows that stay though they are cut off
add 1. The cheapest edits are wanted; of equally cheap ones those whose initials K, R, D, I are
least in ASCII order.

* A row is a symbol: its initial and whether it is cut off, or that it must go.
* Re-Pair over the symbol rows of all conversations: the most frequent pairs of neighbours become
  symbols of their own, round after round. The counts are made where the rows lie; a bounded
  table of pairs comes to the driver, and the rules go back.
* Every symbol has one min-plus matrix over the four states of the pattern. A rule's matrix is
  the product of those of its two parts, made once, bottom-up, and shared by all conversations.
  An entry holds the cost and the audit as a rope: the two parts' ropes, not their text. Audits of
  equal cost never begin with one another, since only inserts could follow, so the least rope of
  a product is that of its parts.
* A conversation's result is the product of the few symbols that are left of it. Conversations
  that lie in several segments, because they are long or lie on a border of two tasks, are folded
  segment by segment, and a way back through the states gives each segment its own audit.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.operators.scale import salted_join, shuffle_tasks

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
STATES = 4  # nothing yet, after the system turn, after a user turn, after an assistant turn
ACCEPTED = (0, 3)
AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
INITIALS = "sua?"  # the last stands for every other role
GONE = 8  # symbols: 2 * initial + cut off, or 8 for a row that must be deleted
BASE_SYMBOLS = 9
MAX_SYMBOLS = 256  # a symbol is a byte
PAIRS_A_ROUND = 24
ROUNDS = 8
SEGMENT_ROWS, SEGMENT_CHARS = 4_096, 4 << 20
NOT_SPACE = r"[^\x20\x09-\x0D]"

Entry = tuple[int, object]  # cost and rope: a string or a pair of ropes
Matrix = list[list["Entry | None"]]


def flat(rope) -> str:
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack.extend((top[1], top[0]))
    return "".join(out)


def less(a: Entry, b: Entry | None) -> bool:
    if b is None or a[0] != b[0]:
        return b is None or a[0] < b[0]
    return a[1] is not b[1] and flat(a[1]) < flat(b[1])


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product: over all states between, the cheapest and then least audit."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for k, a in enumerate(left[i]):
            if a is None:
                continue
            for j, b in enumerate(right[k]):
                if b is not None:
                    both = (a[0] + b[0], b[1] if a[1] == "" else a[1] if b[1] == "" else (a[1], b[1]))
                    if less(both, out[i][j]):
                        out[i][j] = both
    return out


def _inserts() -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        state, entry = i, (0, "")
        while out[i][state] is None:
            out[i][state] = entry
            state, entry = (3 if state == 2 else 2), (entry[0] + INSERT, entry[1] + "I")
    return out


INSERTS = _inserts()


def base_matrix(symbol: int) -> Matrix:
    """Any inserts, then one row kept, given another role or deleted."""
    row: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        row[i][i] = (DELETE, "D")
        if symbol == GONE:
            continue
        extra = CUT_OFF * (symbol % 2)
        for initial in "ua":
            to = AFTER.get((initial, i))
            if to is not None and less(edit := (REROLE + extra, "R"), row[i][to]):
                row[i][to] = edit
        to = AFTER.get((INITIALS[symbol // 2], i))
        if to is not None and less(edit := (KEEP + extra, "K"), row[i][to]):
            row[i][to] = edit
    return times(INSERTS, row)


def rule_matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """The matrix of each base symbol, then of each rule, bottom-up."""
    known = [base_matrix(s) for s in range(BASE_SYMBOLS)]
    for left, right in rules:
        known.append(times(known[left], known[right]))
    return known


def compress(symbols: bytes, rules: list[tuple[int, int]], first: int = BASE_SYMBOLS) -> bytes:
    """Replace each rule's pair by the rule's symbol, rule after rule, from the left."""
    for number, pair in enumerate(rules, start=first):
        symbols = symbols.replace(bytes(pair), bytes([number]))
    return symbols


def product(symbols: bytes, known: list[Matrix]) -> Matrix:
    """The matrices multiplied in a balanced tree, so that ropes stay shallow."""
    if not symbols:
        return [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]
    row = [known[s] for s in symbols]
    while len(row) > 1:
        row = [times(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


def learn_rules(segments: DataFrame, rounds: int = ROUNDS, a_round: int = PAIRS_A_ROUND) -> list[tuple[int, int]]:
    """Re-Pair rules from ``symbols`` of all segments.

    A round counts all pairs of neighbours in the rows as compressed so far and makes rules of the
    most frequent ones, of equal ones the first, as long as symbols are left. Neighbouring pairs
    that overlap are counted once each.
    """
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        known = list(rules)

        def count(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for batch in batches:
                for symbols, n in Counter(batch["symbols"]).items():
                    short = compress(symbols, known)
                    for pair, times_here in Counter(zip(short, short[1:])).items():
                        total[pair] += n * times_here
            rows = [(a, b, n) for (a, b), n in total.items()]
            yield pd.DataFrame(rows, columns=["a", "b", "n"])

        pairs = segments.select("symbols").mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        free = MAX_SYMBOLS - BASE_SYMBOLS - len(rules)
        best = pairs.filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(min(a_round, free)).collect() if free else []
        if not best:
            break
        rules.extend((r.a, r.b) for r in best)
    return rules


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged as crc32 of ``conv_id:turn`` names; nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter("kind != 0").select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """One row for equal rows ``(conv_id, turn, role, text)``, with ``copies`` and ``symbol``.

    A row is a duplicate unless it is the first of its conversation with that role and text; that
    first one has the smallest turn, so the turn alone tells it from others.
    """
    said = F.xxhash64("conv_id", "role", "text", F.lit(1))
    other = F.xxhash64(F.lit(2), "text", "role", "conv_id")
    grouped = C.stored(
        rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumns({"said": said, "other": other}),
        "damaged-turns",
    )
    # nulls come first, and min leaves them out: a null turn is known by its count
    firsts = grouped.groupBy("said", "other").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    joined = salted_join(grouped, firsts, ["said", "other"], "inner", ["turn"])
    last = F.regexp_extract("text", rf"({NOT_SPACE})[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = last == ""
    cut_off = ~last.isin(".", "!", "?")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        initial.alias("initial"),
        blank.alias("blank"),
        cut_off.alias("cut_off"),
        F.col("turn").eqNullSafe(F.col("first.turn")).alias("is_first"),
        (2 * place + cut_off.cast("int")).alias("symbol"),
    )


SEGMENT = """conv string, at long, complete boolean, symbols binary, roles array<string>, texts array<string>,
blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string,
first_turn string, last_turn string, turns long"""


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def segments(rows: DataFrame, most_rows: int = SEGMENT_ROWS, most_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Stretches of a conversation's rows in order, with what is counted in them.

    The whole table is sorted by conversation, turn (nulls first), role and text and dealt out in
    ranges, so a conversation that holds a large share of all rows lies in many tasks. ``at``
    orders the segments; ``complete`` is true if no other can belong to the conversation.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(shuffle_tasks(rows.sparkSession), *order)
    placed = C.stored(ranged.withColumn("piece", F.spark_partition_id()), "ordered-turns")
    placed = placed.repartition("piece").sortWithinPartitions("piece", *order)
    # as strings, because pandas has no long integers with nulls
    placed = placed.withColumns({"conv": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")}).drop("conv_id")
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def described(rows_here: list) -> tuple:
        symbols, roles, texts, initials = bytearray(), [], [], []
        blank = duplicate = truncated = 0
        for r in rows_here:
            for copy in range(r.copies):
                repeated = copy > 0 or not r.is_first
                if r.blank:
                    blank += 1
                elif repeated:
                    duplicate += 1
                elif r.cut_off:
                    truncated += 1
                symbols.append(GONE if r.blank or repeated else r.symbol)
                roles.append(r.role)
                texts.append(r.text)
                initials.append(r.initial)
        known = [r.turn for r in rows_here if r.turn is not None]
        illegal = sum(p not in legal for p in zip(initials, initials[1:]))
        ends = (known[0], known[-1]) if known else (None, None)
        return bytes(symbols), roles, texts, blank, duplicate, truncated, illegal, initials[0], initials[-1], *ends, len(set(known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, here, chars, at, first_at, entire, out = None, [], 0, 0, 0, True, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                new = (r.piece, r.conv)
                full = len(here) >= most_rows or chars >= most_chars
                if here and (new != key or full):
                    # neighbours in the ranges before and after may belong to it
                    complete = entire and new != key and at != first_at and new[0] == key[0]
                    out.append((key[1], key[0] << 32 | at, complete, *described(here)))
                    at += 1
                    entire = new != key
                    here, chars = [], 0
                if key is None or new[0] != key[0]:
                    first_at = at
                key = new
                here.append(r)
                chars += len(r.text) * r.copies
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=names(SEGMENT))
                out = []
        if here:
            out.append((key[1], key[0] << 32 | at, False, *described(here)))
        yield pd.DataFrame(out, columns=names(SEGMENT))

    found = C.stored(placed.mapInPandas(run, SEGMENT), "segments")
    longs = {c: F.col(c).cast("long") for c in ("first_turn", "last_turn")}
    return found.withColumns(longs)


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> list[str]:
    """``role:text`` of the rows that stay, after edits that begin in a state."""
    out, row = [], 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        if edit == "K":
            role, initial = roles[row], roles[row][:1]
        else:  # only user or assistant can follow, never both
            role, initial = ("assistant", "a") if state == 2 else ("user", "u")
        out.append(f"{role}:{texts[row] if edit != 'I' else ''}")
        row += edit != "I"
        state = AFTER[initial, state]
    return out


def best_end(row: list[Entry | None]) -> tuple[int, str, Entry]:
    """The best way to an accepted state: the state before closing inserts, these, and cost and rope of all."""
    best, last, closing = None, 0, ""
    for k, a in enumerate(row):
        for b in (INSERTS[k][j] for j in ACCEPTED):
            if a is not None and b is not None and less(both := (a[0] + b[0], (a[1], b[1])), best):
                best, last, closing = both, k, b[1]
    return last, closing, best


class Solver:
    """Matrices of rules and of the symbol rows met; short ones are remembered up to a bound."""

    def __init__(self, rules: tuple, remembered: int = 20_000):
        self.rules, self.known, self.remembered, self.seen = rules, rule_matrices(rules), remembered, {}

    def matrix(self, symbols: bytes) -> Matrix:
        found = self.seen.get(symbols)
        if found is None:
            found = product(compress(symbols, self.rules), self.known)
            if len(symbols) <= 64:
                if len(self.seen) >= self.remembered:
                    self.seen = {}
                self.seen[symbols] = found
        return found


@functools.lru_cache(maxsize=1)
def solver(rules: tuple) -> Solver:
    """A worker's own solver, kept from one batch to the next."""
    return Solver(rules)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _gaps(first, last, turns):
    return F.coalesce(F.col(last) - F.col(first) + 1 - F.col(turns), F.lit(0)).cast("long")


def _whole(found: DataFrame, rules: tuple) -> DataFrame:
    """Results of conversations that lie in one segment."""

    @F.pandas_udf("cost long, audit string, repaired_sha256 string")
    def solve(symbols: pd.Series, roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for s, r, t in zip(symbols, roles, texts):
            _, _, (cost, rope) = best_end(solver(rules).matrix(bytes(s))[0])
            audit = flat(rope)
            rows.append((cost, audit, hashlib.sha256("\n".join(repaired(r, t, audit, 0)).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["cost", "audit", "repaired_sha256"])

    solved = found.filter("complete").withColumn("r", solve("symbols", "roles", "texts"))
    return solved.withColumn("gaps", _gaps("first_turn", "last_turn", "turns")).select("conv", *RESULT[:5], "r.*")


FOLDED = "at long, state int, audit string, cost long"
JOINED = """conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,
repaired_sha256 string"""


def fold(steps: list[tuple[int, list]]) -> list[tuple[int, int, str, int]]:
    """``at, state before, audit`` of a conversation's segments ``(at, 16 entries)`` in order, and the cost with the first."""
    row: list[Entry | None] = [(0, ""), None, None, None]
    ways = []
    for _, entries in steps:
        new: list[Entry | None] = [None] * STATES
        way: list[tuple[int, str] | None] = [None] * STATES
        for i, a in enumerate(row):
            for j in range(STATES):
                b = entries[STATES * i + j]
                if a is not None and b is not None and less(both := (a[0] + b[0], (a[1], b[1])), new[j]):
                    new[j], way[j] = both, (i, b[1])
        row = new
        ways.append(way)
    state, closing, (cost, _) = best_end(row)
    out = []
    for (at, _), way in zip(reversed(steps), reversed(ways)):
        before, audit = way[state]
        out.append((at, before, audit + closing, 0))
        state, closing = before, ""
    out.reverse()
    out[0] = (*out[0][:3], cost)
    return out


def _split(found: DataFrame, rules: tuple) -> DataFrame:
    """Results of conversations in several segments.

    The matrices of a conversation meet in one task, a few short strings for each segment, and so
    do the repaired texts at the end, one after another, since a hash has to read them in order.
    """
    part = found.filter("NOT complete")

    @F.pandas_udf("costs array<long>, audits array<string>")
    def matrices(symbols: pd.Series) -> pd.DataFrame:
        rows = []
        for s in symbols:
            entries = [e for line in solver(rules).matrix(bytes(s)) for e in line]
            rows.append(([-1 if e is None else e[0] for e in entries], ["" if e is None else flat(e[1]) for e in entries]))
        return pd.DataFrame(rows, columns=["costs", "audits"])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, steps = None, []
        for batch in batches:
            for s in batch.itertuples(index=False):
                if steps and s.conv != key:
                    yield pd.DataFrame(fold(steps), columns=names(FOLDED))
                    steps = []
                key = s.conv
                steps.append((s.at, [None if c < 0 else (int(c), a) for c, a in zip(s.costs, s.audits)]))
        if steps:
            yield pd.DataFrame(fold(steps), columns=names(FOLDED))

    @F.pandas_udf("text string, n long")
    def mend(roles: pd.Series, texts: pd.Series, audits: pd.Series, states: pd.Series) -> pd.DataFrame:
        rows = [repaired(r, t, a, int(s)) for r, t, a, s in zip(roles, texts, audits, states)]
        return pd.DataFrame([("\n".join(x), len(x)) for x in rows], columns=["text", "n"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, has = None, False

        def result() -> pd.DataFrame:
            counts = [total[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
            gaps = 0 if ends is None else ends[1] - ends[0] + 1 - turns
            return pd.DataFrame([(key, gaps, *counts, "".join(audits), digest.hexdigest())], columns=names(JOINED))

        for batch in batches:
            for s in batch.itertuples(index=False):
                if has and s.conv != key:
                    yield result()
                    has = False
                if not has:
                    key, has, total, audits, digest, begun = s.conv, True, Counter(), [], hashlib.sha256(), False
                    ends, turns, last = None, 0, None
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    total[c] += getattr(s, c)
                total["illegal"] += last is not None and (last, s.first_initial) not in {("s", "u"), ("u", "a"), ("a", "u")}
                last = s.last_initial
                if s.first_turn is not None:
                    first, upto = int(s.first_turn), int(s.last_turn)
                    turns += s.turns - (ends is not None and ends[1] == first)
                    ends = (first if ends is None else ends[0], upto)
                audits.append(s.audit)
                if s.n:
                    digest.update(b"\n" * begun + s.text.encode())
                    begun = True
        if has:
            yield result()

    given = part.select("conv", "at", matrices("symbols").alias("m")).select("conv", "at", "m.*")
    plan = C.stored(given.repartition("conv").sortWithinPartitions("conv", "at").mapInPandas(folded, FOLDED), "segment-audits")
    mended = part.join(plan, "at").withColumn("r", mend("roles", "texts", "audit", "state"))
    counted = ["blank", "duplicate", "truncated", "illegal", "cost", "first_initial", "last_initial", "turns", "audit"]
    ends = [F.col(c).cast("string").alias(c) for c in ("first_turn", "last_turn")]
    last = mended.select("conv", "at", *counted, *ends, "r.*").repartition("conv").sortWithinPartitions("conv", "at")
    return last.mapInPandas(joined, JOINED)


def repair(rows: DataFrame, most_rows: int = SEGMENT_ROWS, most_chars: int = SEGMENT_CHARS, rounds: int = ROUNDS) -> DataFrame:
    """One row per conversation of ``rows (conv_id, turn, role, text, copies)``, none of them null but ids and turns.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    Rows with a null conv_id form one conversation. Null turns come first; equal turns are ordered
    by role and text in code-point order. A role counts by its first character.
    """
    found = segments(marked(rows), most_rows, most_chars)
    rules = tuple(learn_rules(found, rounds))
    done = _whole(found, rules).unionByName(_split(found, rules))
    return done.select(F.col("conv").cast("long").alias("conv_id"), *RESULT)


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged ``conversations``, with a row for every conv_id of the input.

    Conversations of which no row is left have zeros, an empty audit and the hash of nothing. An
    empty table gives no rows; other columns are not looked at.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    done = repair(damaged(turns)).withColumnRenamed("conv_id", "found_id").withColumn("found", F.lit(True))
    every = turns.select("conv_id").distinct()
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(b""), 256)}
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in RESULT]
    )


def query(spark, folder: str) -> DataFrame:
    return repair_damaged(C.table(spark, folder, "conversations"))
