"""Repair of conversation structure by signature deduplication (operator 12).

A conversation's rows, in the order of their turns, are encoded as one character
each: the class of the role's initial and the row's first fault.  The strings are
put together from bounded pieces, every distinct one is solved once, and the
cheapest audits are joined back to the conversations that share it.  Then the edits
are replayed over the texts in order.

A signature is solved by recursion on its halves, memoised by substring.  A part's
solution is a table: for each state of the role grammar before it and each state
after it, the least cost and the ASCII-least audit of that cost.  Two audits of the
same part, states and cost never are one the beginning of the other (the longer one
would hold more inserts, each of which costs), so least parts make least wholes and
tables can be combined in any order.

What is sequential by its nature is the digest of the repaired conversation: its rows
pass one task in order, batch by batch, so memory stays bounded; everything else is
spread, whatever a conversation's share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package
from streamweave.llm import worker
from streamweave.llm.common import arrow_udf, cut, table
from streamweave.operators.ranking import numbered

#: Rows of a piece of a signature.
PIECE = 512
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"

ROLES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
#: A row's character: four for each of s, u, a and other initials, one for each fault.
ALPHABET = "ABCDEFGHIJKLMNOP"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: States of (s?(ua)+)? by what came last: nothing, s, u, a.  A whole conversation ends in nothing or a.
STATES, FINAL = range(4), (0, 3)
#: (state, initial) -> state; and the state that a free choice of user or assistant leads to.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FREE = {0: 2, 1: 2, 2: 3, 3: 2}

Table = dict[tuple[int, int], tuple[int, str]]


def combined(left: Table, right: Table) -> Table:
    """The table of two parts that follow one another."""
    out: Table = {}
    for (a, b), (c1, s1) in left.items():
        for d in STATES:
            if (b, d) in right:
                c2, s2 = right[b, d]
                found = (c1 + c2, s1 + s2)
                if (a, d) not in out or found < out[a, d]:
                    out[a, d] = found
    return out


def _inserts() -> Table:
    """Any number of inserts; more than two are never cheapest."""
    one = {(s, s): (0, "") for s in STATES} | {(s, FREE[s]): (INSERT, "I") for s in STATES}
    return combined(one, one)


INSERTS = _inserts()


def _row(character: str) -> Table:
    """One row, with inserts before it."""
    role, fault = divmod(ALPHABET.index(character), 4)
    edits: Table = {(s, s): (DELETE, "D") for s in STATES}
    if fault not in (1, 2):
        extra = TRUNCATED if fault == 3 else 0
        for s in STATES:
            edits[s, FREE[s]] = (REROLE + extra, "R")
        for (s, initial), after in STEP.items():
            if (ROLES + " ")[role] == initial:
                edits[s, after] = min(edits.get((s, after), (99, "")), (KEEP + extra, "K"))
    return combined(INSERTS, edits)


class Solver:
    """Solves signatures; tables of substrings of at most PIECE characters are kept, MEMO of them at most."""

    MEMO = 20_000

    def __init__(self):
        self.known: dict[str, Table] = {}

    def part(self, signature: str) -> Table:
        found = self.known.get(signature)
        if found is None:
            if len(signature) == 1:
                found = _row(signature)
            else:
                half = len(signature) // 2
                found = combined(self.part(signature[:half]), self.part(signature[half:]))
            if len(signature) <= PIECE:
                if len(self.known) >= self.MEMO:
                    self.known.clear()
                self.known[signature] = found
        return found

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits, the ASCII-least of them."""
        whole = combined(self.part(signature), INSERTS) if signature else INSERTS
        return min(whole[0, f] for f in FINAL if (0, f) in whole)


def illegal(signature: str) -> int:
    """Neighbours whose initials aren't su, ua or au."""
    roles = [ALPHABET.index(c) // 4 for c in signature]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(roles, roles[1:], strict=False))


def number_of(signature: str, fault: str) -> int:
    return sum(signature.count(c) for c in ALPHABET[FAULTS.index(fault) :: 4])


def solved(signatures: DataFrame) -> DataFrame:
    """Add the answers to distinct signatures: counts, illegal neighbours, cost, audit."""
    kind = pa.struct([(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])

    def solve(batches):
        solver = worker.KEPT.setdefault("conversations", Solver())
        for parts in batches:
            rows = []
            for s in parts.to_pylist():
                cost, audit = solver.solve(s)
                rows.append({f: number_of(s, f) for f in FAULTS[1:]} | {"illegal": illegal(s), "cost": cost, "audit": audit})
            yield pa.array(rows, kind)

    udf = arrow_udf(signatures.sparkSession, solve, "struct<blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>")
    return signatures.withColumn("answer", udf("signature")).select("signature", "answer.*")


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage to (conv_id, turn, role, text): rows go, change, or get `n` = 2 copies."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    hit = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), draw.alias("draw"), role.alias("role"), text.alias("text")).where("draw <> 0")
    return hit.select(
        "conv_id",
        "turn",
        F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def as_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of undamaged conversations; nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"), F.lit(1).cast("long").alias("n"))


#: The order of a conversation: by turn (nulls first), then by role and text, so that repeats are neighbours.
ORDER = ("turn", "role", "digest")


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256).alias("digest")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature) of each conversation of (conv_id, turn, role, text, n); cut.

    Texts stay behind: a row is known by its digest from here on.  Equal rows are
    counted first; what repeats an earlier role and text is found by joining each
    (conversation, role, digest) with its first turn, on the turn as well, so that a
    text that a conversation repeats without end is no hot key.  Rows are numbered over all
    conversations at once, in sorted ranges, and gathered PIECE at a time.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANK_CHARACTERS))
    fault = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    begins = F.substring("role", 1, 1)
    initial = F.when(begins == "s", 0).when(begins == "u", 1).when(begins == "a", 2).otherwise(3)
    light = rows.select("conv_id", "turn", "role", _digest(), fault.alias("fault"), initial.alias("initial"), "n")
    counted = light.groupBy("conv_id", *ORDER, "fault", "initial").agg(F.sum("n").alias("n"))
    marked = counted.withColumn("first", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at")))
    earliest = marked.groupBy("conv_id", "role", "digest").agg(F.min("first").alias("first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "role", "digest")] + [F.col("a.turn").eqNullSafe(F.col("b.first.at"))]
    both = marked.alias("a").join(earliest.alias("b"), same, "left").select("a.*", F.col("b.first").isNotNull().alias("is_first"))
    letter = lambda f: F.substring(F.lit(ALPHABET), (F.col("initial") * 4 + f + 1).cast("int"), F.lit(1))
    own = letter(F.when((F.col("fault") != 1) & ~F.col("is_first"), 2).otherwise(F.col("fault")))
    again = letter(F.when(F.col("fault") == 1, 1).otherwise(2))
    coded = both.select("conv_id", *ORDER, F.concat(own, F.repeat(again, (F.col("n") - 1).cast("int"))).alias("letters"))
    ranked = numbered(coded, "conv_id", *ORDER, name="rank").withColumn("piece", F.expr(f"rank div {PIECE}"))
    one = F.array_sort(F.collect_list(F.struct("rank", "letters")))
    pieces = ranked.groupBy("conv_id", "piece").agg(one.alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"))
    pieces = pieces.select("conv_id", F.struct("piece", F.array_join(F.transform("rows", lambda r: r["letters"]), "").alias("letters"), "low", "high", "turns").alias("p"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a conversation's length / PIECE
    before = F.struct(F.lit(None).cast("long").alias("high"), F.lit(0).cast("long").alias("turns"))
    # A turn that goes on in the next piece is one turn.
    turns = F.aggregate("p", before, lambda acc, x: F.struct(F.coalesce(x["high"], acc["high"]).alias("high"), (acc["turns"] + x["turns"] - F.coalesce(acc["high"] == x["low"], F.lit(False)).cast("long")).alias("turns")), lambda acc: acc["turns"])
    low, high = F.array_min(F.transform("p", lambda x: x["low"])), F.array_max(F.transform("p", lambda x: x["high"]))
    gaps = F.coalesce(high - low + 1 - turns, F.lit(0)).cast("long")
    return cut(whole.select("conv_id", gaps.alias("gaps"), F.array_join(F.transform("p", lambda x: x["letters"]), "").alias("signature")))


class Replay:
    """Replays an audit over a conversation's rows as they come."""

    NAMES = {"u": "user", "a": "assistant"}

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.begun = audit, 0, 0, hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.begun else b"") + f"{role}:{text}".encode("utf-8", "replace"))
        self.begun = True

    def _free(self, text: str) -> None:
        self.state = FREE[self.state]
        self._line(self.NAMES["u" if self.state == 2 else "a"], text)

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._free("")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._insert()
            edit = self.audit[self.at]
            if edit == "K":
                self.state = STEP[self.state, role[0]]
                self._line(role, text)
            elif edit == "R":
                self._free(text)
            self.at += 1

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, ..., repaired_sha256): the audits' rows with the digest of what replaying them gives.

    Audits (conv_id, audit, ...) go before their conversation's rows in one sorted
    stream, and each conversation is digested as its rows pass: no more than a batch
    and an audit are held.
    """
    ship_package(rows.sparkSession)
    facts = [c for c in audits.columns if c != "conv_id"]
    none = lambda c: F.lit(None).cast(dict(audits.dtypes)[c]).alias(c)
    lines = rows.select("conv_id", *[none(c) for c in facts], F.lit(True).alias("line"), "turn", "role", _digest(), "text", "n")
    heads = audits.select("conv_id", *facts, F.lit(False).alias("line"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    ordered = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "line", *ORDER).drop("turn", "digest")
    schema = audits.withColumn("repaired_sha256", F.lit("")).schema

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("conversations")
        head, now, kind = None, None, None
        for batch in batches:
            done = []
            kind = pa.schema([batch.schema.field(c) for c in ("conv_id", *facts)]).append(pa.field("repaired_sha256", pa.string()))
            columns = [batch.column(c) for c in ("line", "role", "text", "n")]
            for i in range(batch.num_rows):
                if not columns[0][i].as_py():
                    if now is not None:
                        done.append(head | {"repaired_sha256": now.end()})
                    head = {c: batch.column(c)[i].as_py() for c in ("conv_id", *facts)}
                    now = Replay(head["audit"])
                else:
                    now.row(columns[1][i].as_py(), columns[2][i].as_py(), columns[3][i].as_py())
            if done:
                yield pa.RecordBatch.from_pylist(done, kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": now.end()}], kind)

    return ordered.mapInArrow(replay, schema)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audited(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, the NUMBERS, audit) for every conv_id of `ids`, from rows (conv_id, turn, role, text, n).

    Conversations without rows have zeros and an empty audit.  A signature that
    very many conversations share is one row on the side of the answers and is split by the
    join's skew handling on the other, as both sides are shuffled from files.
    """
    coded = signatures(rows)
    answers = cut(solved(coded.select("signature").distinct()))
    found = coded.join(answers, "signature").drop("signature")
    every = ids.select("conv_id").distinct()
    both = every.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    return both.select("i.conv_id", *[F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in NUMBERS], F.coalesce("f.audit", F.lit("")).alias("audit"))


def repair(conversations: DataFrame) -> DataFrame:
    """Audit conversations (conv_id, turn, role, text) as they are: (conv_id, NUMBERS, audit, repaired_sha256).

    Rows stand in the order of their turns, null turns first, ties by role and text;
    each row's first fault counts.  Nulls in role and text are one space (so such a
    text is blank and such a role is none of the grammar), a null conv_id is a
    conversation of its own.  A role counts by its initial, as written; an empty one is none of
    the grammar.  Repeated rows are duplicates of their first.  An empty table gives
    an empty result, other columns are left out.
    """
    rows = as_rows(conversations)
    return replayed(rows, audited(rows, conversations))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations damaged as the contract says, audited and repaired."""
    given = table(spark, sf_dir, "conversations")
    rows = damage(given)
    return replayed(rows, audited(rows, given)).select("conv_id", *NUMBERS, "audit", "repaired_sha256")


def oracle() -> str:
    """The same for DuckDB: each conversation's rows one by one, the best audit for each state kept."""
    steps = ", ".join(f"({a}, '{r}', {b})" for (a, r), b in STEP.items())
    free = ", ".join(f"({a}, {b}, '{'user' if b == 2 else 'assistant'}')" for a, b in FREE.items())
    inserts = ", ".join(f"({a}, {b}, {c}, '{s}')" for (a, b), (c, s) in INSERTS.items())
    bare = "regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '')"
    return f"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
drawn AS (SELECT given.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS draw FROM given, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged),
facts AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN {bare} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT contains('.!?', right({bare}, 1)) THEN 'truncated' ELSE 'none' END AS fault FROM placed),
step(a, initial, b) AS (VALUES {steps}), free(a, b, name) AS (VALUES {free}), ins(a, b, c, s) AS (VALUES {inserts}),
edits AS MATERIALIZED (SELECT conv_id, pos, s.a, s.b, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS c, 'K' AS s FROM facts JOIN step s USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, pos, f.a, f.b, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R' FROM facts, free f WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, pos, f.a, f.a, 4, 'D' FROM facts, free f),
moves AS MATERIALIZED (SELECT conv_id, pos, i.a, e.b, i.c + e.c AS c, i.s || e.s AS s FROM edits e JOIN ins i ON i.b = e.a),
walk(conv_id, pos, state, cost, audit) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '' FROM facts
  UNION ALL SELECT * FROM (SELECT w.conv_id, m.pos, m.b, w.cost + m.c AS cost, w.audit || m.s AS audit FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1 AND m.a = w.state)
    QUALIFY row_number() OVER (PARTITION BY conv_id, pos, b ORDER BY cost, audit) = 1),
sums AS (SELECT conv_id, max(pos) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM facts GROUP BY conv_id),
pairs AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS two FROM facts) WHERE two NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
best AS (SELECT * FROM (SELECT w.conv_id, w.cost + i.c AS cost, w.audit || i.s AS audit FROM walk w JOIN sums ON sums.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = n JOIN ins i ON i.a = w.state WHERE i.b IN ({", ".join(map(str, FINAL))}))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
letters AS (SELECT conv_id, k, audit[k] AS edit, CASE WHEN audit[k] <> 'I' THEN sum(CASE WHEN audit[k] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) END AS pos FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
kept AS (SELECT l.conv_id, l.k, edit, f.role, coalesce(f.text, '') AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS nth, CASE WHEN edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END AS system
  FROM letters l LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.pos = l.pos WHERE edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system_rows) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole FROM (SELECT *, max(system) OVER (PARTITION BY conv_id) AS system_rows FROM kept) GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM i.conv_id"""
